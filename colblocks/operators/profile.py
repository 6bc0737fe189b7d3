"""Profiles of columns: what values they hold and how well they would encode."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import decimal_exponent
from .stats import top_values


def profile_numbers(df: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """min, max, nulls, zeros and distinct present values."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v") == 0).alias("zeros"), F.countDistinct("v").alias("uniq"))


def profile_strings(df: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Lengths in bytes; the average is whole and over all rows, nulls too."""
    size = F.octet_length("v").cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.floor(F.coalesce(F.sum(size), F.lit(0)) / F.count(F.lit(1))).alias("average_length"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v") == "").alias("empty"), F.countDistinct("v").alias("uniq"))


def random_element(df: DataFrame, seed: int = 42, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """A present value of each block: that of the row whose number hashes lowest."""
    rank = F.when(F.col("v").isNotNull(), F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))))
    return df.groupBy(*by).agg(F.min_by("v", rank).alias("random_element"))


def exponent_share(df: DataFrame, bits: str = "bits") -> DataFrame:
    """(blocks, single, pct): blocks whose values all have one binary exponent."""
    from ..functions.scalar import ieee_exponent

    per = df.where(F.col(bits).isNotNull()).groupBy("block_id").agg(F.countDistinct(ieee_exponent(F.col(bits))).alias("e"))
    return per.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("e") <= 1).alias("single"), F.round(100.0 * F.count_if(F.col("e") <= 1) / F.count(F.lit(1)), 6).alias("pct"))


def profile_with_tops(df: DataFrame, strings: bool = False, by: tuple[str, ...] = ("block_id",), k: int = 3) -> DataFrame:
    """The profile with the top values as an array, empty places left out."""
    tops = top_values(df, k, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("value").cast("string").alias("value"), "pct"))), lambda t: F.struct(t["value"].alias("value"), t["pct"].alias("pct"))).alias("top"))
    return (profile_strings if strings else profile_numbers)(df, by).join(tops, list(by), "left")


def decimal_applicability(df: DataFrame, largest: int = 15, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Per block the present values and those that are a whole number of ``largest`` decimal places at most."""
    # 53 bits: any whole number that a double holds exactly.
    e = decimal_exponent(F.abs("v"), 53, largest)
    return df.where(F.col("v").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(e).alias("convertible"))


def applicability_summary(per_block: DataFrame) -> DataFrame:
    return per_block.agg(F.round(100.0 * F.sum("convertible") / F.sum("n"), 6).alias("pct"), F.count_if(F.col("n") == F.col("convertible")).alias("positive_blocks"))


def _symbol_sizes(table: pa.Table) -> pa.Table:
    from .codec import compress_symbols, train_symbols

    data = b"".join(table.column("v").cast(pa.binary()).to_pylist())
    size = len(compress_symbols(data, train_symbols(data[: 1 << 14])))
    return pa.table({"block_id": table.column("block_id")[:1], "raw": pa.array([len(data)], pa.int64()), "compressed": pa.array([size], pa.int64())})


def symbol_table_ratio(df: DataFrame) -> DataFrame:
    """(block_id, raw, compressed, ratio): what a symbol table makes of the distinct present strings of each block."""
    distinct = df.where(F.col("v").isNotNull()).select("block_id", "v").distinct()
    out = distinct.groupBy("block_id").applyInArrow(_symbol_sizes, "block_id long, raw long, compressed long")
    return out.withColumn("ratio", F.round(F.col("raw") / F.col("compressed"), 6))
