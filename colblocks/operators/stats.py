"""Statistics of blocks. Rows are (block_id, pos, v); a null is stored as 0 or the empty string and counts as that value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stored(v: str | Column, zero) -> Column:
    return F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(zero))


def previous_present(by: tuple[str, ...], v: str = "v") -> Column:
    """The last value before a row that isn't null; before any, the stored value of the first row (0 if that is null)."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(v, ignorenulls=True).over(w)


def change(by: tuple[str, ...], zero, v: str = "v") -> Column:
    """Whether a row begins a new run: nulls never do, nor does the first row."""
    return F.col(v).isNotNull() & (F.col("pos") > 0) & (F.col(v) != F.coalesce(previous_present(by, v), F.lit(zero)))


def number_stats(df: DataFrame, by: tuple[str, ...] = ("block_id",), zero=0) -> DataFrame:
    """n, nulls, uniq, vmin, vmax, runs, avg_run (whole number), sorted per block."""
    prev = F.coalesce(previous_present(by), F.lit(zero))
    here = F.col("v").isNotNull() & (F.col("pos") > 0)
    marked = df.select(*by, stored("v", zero).alias("x"), F.col("v").isNull().alias("null"), (here & (F.col("v") != prev)).alias("chg"), (here & (F.col("v") < prev)).alias("down"))
    per_value = marked.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.count_if("null").alias("nulls"), F.count_if("chg").alias("chg"), F.count_if("down").alias("down"))
    out = per_value.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.count(F.lit(1)).alias("uniq"), F.min("x").alias("vmin"), F.max("x").alias("vmax"), (F.sum("chg") + 1).alias("runs"), (F.sum("down") == 0).alias("sorted"))
    return out.select(*by, "n", "nulls", "uniq", "vmin", "vmax", "runs", F.floor(F.col("n") / F.col("runs")).alias("avg_run"), "sorted")


def string_stats(df: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """n, nulls, uniq, total_length, total_unique_length and total_size (offsets and bytes) per block."""
    per_value = df.groupBy(*by, stored("v", "").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"))
    size = F.octet_length("x").cast("long")
    out = per_value.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.count(F.lit(1)).alias("uniq"), F.sum(F.col("n") * size).alias("total_length"), F.sum(size).alias("total_unique_length"))
    return out.withColumn("total_size", 4 * (F.col("n") + 1) + F.col("total_length"))


def histogram(df: DataFrame, by: tuple[str, ...] = ("block_id",), zero=0) -> DataFrame:
    return df.groupBy(*by, stored("v", zero).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def null_maps(df: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Kind of the map of present values and the positions it stores: the rarer of present and null ones, none if all agree."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("ones"))
    kind = F.when(F.col("ones") == 0, "ALLZEROS").when(F.col("ones") == F.col("n"), "ALLONES").when(F.col("ones") < F.floor(F.col("n") / 2), "REGULAR").otherwise("FLIPPED")
    out = out.withColumn("type", kind)
    return out.withColumn("positions", F.when(F.col("type") == "REGULAR", F.col("ones")).when(F.col("type") == "FLIPPED", F.col("n") - F.col("ones")).otherwise(0))


def null_map_positions(df: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """(block, pos): the rows that a block's map lists."""
    kinds = null_maps(df, by).select(*by, "type")
    listed = ((F.col("type") == "REGULAR") & F.col("v").isNotNull()) | ((F.col("type") == "FLIPPED") & F.col("v").isNull())
    return df.join(kinds, list(by)).where(listed).select(*by, "pos")


def null_map_decode(rows: DataFrame, kinds: DataFrame, positions: DataFrame, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """(block, pos, present) from the kinds and the listed positions."""
    j = rows.join(kinds.select(*by, "type"), list(by)).join(positions.withColumn("_in", F.lit(True)), [*by, "pos"], "left")
    listed = F.col("_in").isNotNull()
    present = F.when(F.col("type") == "ALLONES", True).when(F.col("type") == "ALLZEROS", False).when(F.col("type") == "REGULAR", listed).otherwise(~listed)
    return j.select(*by, "pos", present.alias("present"))


def top_values(df: DataFrame, k: int = 3, by: tuple[str, ...] = ("block_id",), of_all: bool = False) -> DataFrame:
    """The ``k`` most frequent present values of a block with rank and percent of present (or all) rows; ties go to the smaller value."""
    whole = df.groupBy(*by).agg(F.count(F.lit(1) if of_all else "v").alias("_n"))
    counts = df.where(F.col("v").isNotNull()).groupBy(*by, F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cnt"), "value")) if by else F.row_number().over(Window.orderBy(F.desc("cnt"), "value"))
    top = counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    whole = F.broadcast(whole) if not by else whole
    j = top.join(whole, list(by)) if by else top.join(whole)
    return j.select(*by, "rank", "value", "cnt", F.round(100.0 * F.col("cnt") / F.col("_n"), 6).alias("pct"))


def run_pictures(df: DataFrame, cells: int = 20, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """A character per row of the first ``cells``: N null, . as before, x changed (the first present row counts as changed)."""
    prev = previous_present(by)
    flag = F.when(F.col("v").isNull(), "N").when(prev.isNotNull() & (F.col("v") == prev), ".").otherwise("x")
    marked = df.where(F.col("pos") < cells).select(*by, "pos", flag.alias("c"))
    return marked.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("picture"))


def double_bits_profile(df: DataFrame, bits: str = "bits", by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    from ..functions.scalar import ieee_exponent, ieee_mantissa

    e, m = ieee_exponent(F.col(bits)), ieee_mantissa(F.col(bits))
    return df.where(F.col(bits).isNotNull()).groupBy(*by).agg(F.countDistinct(bits).alias("distinct_values"), F.countDistinct(e).alias("distinct_exponents"), F.countDistinct(m).alias("distinct_mantissas"), F.min(e).alias("min_exponent"), F.max(e).alias("max_exponent"))
