"""Comparison of tables and blocks, block skipping, point lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fixed6


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, <columns>, cnt): rows that one side has more often; one aggregate, no sort."""
    both = a.select(*a.columns, F.lit(1).alias("_s")).unionByName(b.select(*a.columns, F.lit(-1).alias("_s")))
    d = both.groupBy(*a.columns).agg(F.sum("_s").alias("_d")).where("_d <> 0")
    return d.select(F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), *a.columns, F.abs("_d").alias("cnt"))


def normal_cell(c: Column, kind: str) -> Column:
    """A cell as text for comparison: empty numbers are null, doubles have six decimals."""
    if kind == "string":
        return F.coalesce(c.cast("string"), F.lit("null"))
    text = fixed6(c.cast("double")) if kind == "double" else c.cast("string")
    return F.coalesce(text, F.lit("null"))


def rows_equal(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """(rows, mismatches) of two tables in order: values count only where present, nulls everywhere, and -0.0 equals 0.0."""
    cols = [c for c in a.columns if c != key]
    j = a.select(key, *[F.col(c).alias(f"_a{i}") for i, c in enumerate(cols)], F.lit(True).alias("_ina")).join(b.select(key, *[F.col(c).alias(f"_b{i}") for i, c in enumerate(cols)], F.lit(True).alias("_inb")), key, "full")
    same = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    for i in range(len(cols)):
        same = same & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("mismatches"))


def verify(a: DataFrame, b: DataFrame, key: str = "row_id") -> None:
    """Raise unless both tables are equal."""
    rows, bad = rows_equal(a, b, key).head()
    if bad:
        raise AssertionError(f"{bad} of {rows} rows differ")


def zone_map(df: DataFrame) -> DataFrame:
    """(block_id, lo, hi, n) for rows (block_id, v)."""
    return df.groupBy("block_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))


def scan_between(df: DataFrame, zones: DataFrame, low, high) -> DataFrame:
    """Rows with a value in [low, high]: both bounds reach the scan of ``df``, and a stored zone map (a row a block) tells which blocks are alive."""
    alive = zones.where((F.col("hi") >= low) & (F.col("lo") <= high)).select("block_id")
    return df.where(F.col("v").between(low, high)).join(alive, "block_id", "left_semi")
