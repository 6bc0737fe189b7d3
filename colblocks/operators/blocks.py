"""Row ids, blocks, the long form, samples."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..scratch import Scratch

#: Bytes of a range of the order: small tables are cut for the sake of their tasks, others so that a task sorts a range in little memory,
#: large ones into larger ranges from FEW on, since up to so many a shuffle writes without sorting in memory itself.
SMALL_RANGE, RANGE, LARGE_RANGE, FEW = 4 << 20, 8 << 20, 32 << 20, 200
#: Rows of a task to which whole blocks are dealt.
SMALL_DEAL, LARGE_DEAL = 1 << 15, 1 << 18
_LOCAL = (1 << 33) - 1


def range_count(df: DataFrame) -> int:
    """Ranges to cut a table into, from the size that the optimizer gives its plan; as many as a shuffle has where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 53:
        return tasks
    return max(1, min(tasks, size // SMALL_RANGE), min(FEW, size // RANGE), size // LARGE_RANGE)


class Numbered:
    """A table staged in its order, with the number of rows before each of its ranges.

    Spark's range partitioner cuts the order (one shuffle); each range is sorted and written by a task of its own with the places of
    its rows. Only the counts of the ranges come to the driver. Whatever is computed from the rows later reads the written
    table, so numbers never depend on a second run of the sampler, and a lost executor costs a task of a scan.
    """

    def __init__(self, df: DataFrame, *order: str, partitions: int | None = None):
        n = partitions or range_count(df)
        cut = df.repartitionByRange(n, *order) if n > 1 else df.coalesce(1)
        rows = cut.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
        self.staged = Scratch(df.sparkSession, "rows").stage(rows, "ordered")
        counts = self.staged.groupBy(F.shiftright("_place", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        self.before, self.n = {}, 0
        for r in counts:
            self.before[r["p"]] = self.n
            self.n += r["n"]

    def rows(self) -> DataFrame:
        """All rows with ``row_id``."""
        local = F.col("_place").bitwiseAND(F.lit(_LOCAL))
        if len(self.before) <= 1:
            return self.staged.withColumn("row_id", local).drop("_place")
        spark = self.staged.sparkSession
        starts = F.broadcast(spark.createDataFrame(list(self.before.items()), "_p long, _before long"))
        out = self.staged.join(starts, F.shiftright("_place", 33) == F.col("_p"))
        return out.withColumn("row_id", F.col("_before") + local).drop("_place", "_p", "_before")

    def lookup(self, *row_ids: int) -> DataFrame:
        """The rows of the given numbers; their places are pushed into the scan, which skips all other row groups."""
        starts, parts = list(self.before.values()), list(self.before)
        wanted = [(i, at - 1) for i in row_ids if 0 <= i < self.n and (at := bisect.bisect_right(starts, i))]
        places = [(parts[at] << 33) + i - starts[at] for i, at in wanted]
        out, row_id = self.staged.where(F.col("_place").isin(*places)), F.lit(None).cast("long")
        for (i, _), place in zip(wanted, places):
            row_id = F.when(F.col("_place") == place, F.lit(i).cast("long")).otherwise(row_id)
        return out.withColumn("row_id", row_id).drop("_place")


def with_row_id(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """``row_id``: the place of a row in the order given, from 0; nulls first. The ordered table is written once (see Numbered)."""
    return Numbered(df, *order, partitions=partitions).rows()


def with_block(df: DataFrame, size: int) -> DataFrame:
    """``block_id`` and ``pos`` in the block from ``row_id``; the last block may be short."""
    return df.withColumns({"block_id": F.floor(F.col("row_id") / size).cast("long"), "pos": F.col("row_id") % size})


def dealt(df: DataFrame, rows: int, key: str = "block_id") -> DataFrame:
    """``df``, of ``rows`` rows, dealt out by ``key`` to as many tasks as that takes: what a task holds doesn't grow with the table.

    Groups and windows of a block are then made where its rows are. Spark's own exchanges would deal to a fixed number of tasks,
    or join small ones until there are as few as cores.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // LARGE_DEAL), min(tasks, rows // SMALL_DEAL)), key)


def blocks(df: DataFrame, size: int, *order: str) -> DataFrame:
    return with_block(with_row_id(df, *order), size)


def ranges(n_rows: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of all blocks."""
    return [(a, min(size, n_rows - a)) for a in range(0, n_rows, size)]


def take_blocks(df: DataFrame, limit: int = 0, random: bool = False, seed: int = 42) -> DataFrame:
    """The first ``limit`` blocks (0: all), in the order of the rows or in a seeded random one."""
    if not limit:
        return df
    if not random:
        return df.where(F.col("block_id") < limit)
    chosen = df.select("block_id").distinct().orderBy(F.xxhash64(F.lit(seed), "block_id"), "block_id").limit(limit)
    return df.join(F.broadcast(chosen), "block_id", "left_semi")


def family(spark_type: str) -> str | None:
    """The value type a Spark type is encoded as; None is skipped. 64-bit integers and timestamps are extensions."""
    names = {"int": "int", "smallint": "int", "tinyint": "int", "bigint": "long", "timestamp": "long", "timestamp_ntz": "long", "double": "double", "float": "double", "string": "string"}
    return names.get(spark_type)


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_id, column, type, i, d, s): a row per value; i holds integers, d doubles and s strings."""
    kinds = {c: family(t) for c, t in df.dtypes if c not in ("row_id", "block_id", "pos") and (columns is None or c in columns)}
    kinds = {c: k for c, k in kinds.items() if k}
    def cell(c: str, kind: str) -> Column:
        v = F.unix_micros(F.col(c).cast("timestamp")) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)
        return F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), *[(v.cast(t) if kind in own else F.lit(None).cast(t)).alias(n) for n, t, own in (("i", "long", ("int", "long")), ("d", "double", ("double",)), ("s", "string", ("string",)))])
    keep = [c for c in ("row_id", "block_id", "pos") if c in df.columns]
    return df.select(*keep, F.explode(F.array(*[cell(c, k) for c, k in kinds.items()])).alias("_c")).select(*keep, "_c.*")


def sampled(df: DataFrame, runs: int, length: int, offset: Column | None = None, seed: int = 42, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """One run of ``length`` rows in each of ``runs`` equal slices of a block; short blocks are taken whole.

    ``offset`` maps (slice ``_slice``, last start ``_last``, block_id) to the start of the run in its slice; by default a seeded hash.
    The last slice takes the remainder.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    df = df.withColumn("_size", size)
    width = F.floor(F.col("_size") / runs).cast("long")
    df = df.withColumn("_width", F.greatest(width, F.lit(1)))
    df = df.withColumn("_slice", F.least(F.floor(F.col("pos") / F.col("_width")), F.lit(runs - 1)).cast("long"))
    own = F.when(F.col("_slice") == runs - 1, F.col("_size") - F.col("_slice") * F.col("_width")).otherwise(F.col("_width"))
    df = df.withColumn("_last", F.greatest(own - length, F.lit(0)))
    start = F.pmod(F.xxhash64(F.lit(seed), *by, "_slice"), F.col("_last") + 1) if offset is None else offset
    df = df.withColumn("_start", F.col("_slice") * F.col("_width") + start)
    whole = F.col("_size") <= runs * length
    return df.where(whole | F.col("pos").between(F.col("_start"), F.col("_start") + length - 1)).drop("_size", "_width", "_slice", "_last", "_start")


def random_ranges(df: DataFrame, count: int = 3, length: int = 65_000, seed: int = 42, start: Column | None = None) -> DataFrame:
    """``count`` stretches (``stretch``) of at most ``length`` rows from seeded random starts, by a range join on ``row_id``.

    ``start`` maps (stretch, rows ``_n``) to a start; by default a hash. The starts are ``count`` rows, so they are broadcast.
    """
    spark = df.sparkSession
    n = df.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("_n"))
    begin = F.pmod(F.xxhash64(F.lit(seed), "stretch"), F.greatest(F.col("_n"), F.lit(1))) if start is None else start
    starts = spark.range(count).withColumnRenamed("id", "stretch").join(F.broadcast(n)).select("stretch", begin.alias("_start"))
    return df.join(F.broadcast(starts), F.col("row_id").between(F.col("_start"), F.col("_start") + length - 1)).drop("_start")


def random_range(df: DataFrame, length: int = 65_000, seed: int = 42) -> DataFrame:
    return random_ranges(df, 1, length, seed).drop("stretch")


def sample_blocks(df: DataFrame, config: Config) -> DataFrame:
    return sampled(df, config.sample_runs, config.sample_run_length, seed=config.seed)
