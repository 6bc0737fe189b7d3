"""Parts, offsets and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import align_up


def _greedy(limit: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_id")
        filled = np.cumsum(table.column("size").to_numpy())
        part, start, number = np.zeros(len(filled), np.int64), 0, 0
        while start < len(filled):  # a step a part, not a block
            before = filled[start - 1] if start else 0
            end = int(np.searchsorted(filled, before + limit, "right"))
            part[start:end] = number
            start, number = end, number + 1
        return table.append_column("part", pa.array(part))

    return run


def pack_parts(sizes: DataFrame, limit: int) -> DataFrame:
    """``sizes(column, block_id, size)`` with ``part``: blocks in order join a part while its sizes' sum stays within ``limit``.

    The greedy choice depends on all before, so a task folds the blocks of a column: 16 bytes for each 65,536 values. A block
    over the limit raises.
    """
    checked = sizes.select("column", "block_id", F.when(F.col("size") <= limit, F.col("size")).otherwise(F.raise_error(F.lit("a block is larger than a part")).cast("long")).cast("long").alias("size"))
    return checked.groupBy("column").applyInArrow(_greedy(limit), "column string, block_id long, size long, part long")


def part_sizes(packed: DataFrame) -> DataFrame:
    """(column, part, blocks, bytes): a part's file has its blocks, their number and their offsets."""
    return packed.groupBy("column", "part").agg(F.count(F.lit(1)).alias("blocks"), (F.sum("size") + 4 + 4 * F.count(F.lit(1))).alias("bytes"))


def chunk_offsets(packed: DataFrame, align: int = 16) -> DataFrame:
    """(column, part, chunk, block_id, offset): chunks stand at multiples of ``align`` after the header."""
    own = Window.partitionBy("column", "part")
    before = F.sum(align_up(F.col("size"), align)).over(own.orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1))
    head = align_up(4 + 4 * F.count(F.lit(1)).over(own), align)
    chunk = F.row_number().over(own.orderBy("block_id")).cast("long") - 1
    return packed.select("column", "part", chunk.alias("chunk"), "block_id", (head + F.coalesce(before, F.lit(0))).alias("offset"))


def compression_report(sizes: DataFrame) -> DataFrame:
    """(column, raw, compressed), and a row Total, from (column, raw, compressed) per block."""
    return sizes.rollup("column").agg(F.sum("raw").alias("raw"), F.sum("compressed").alias("compressed")).withColumn("column", F.coalesce("column", F.lit("Total")))


def scheme_report(choice: DataFrame) -> DataFrame:
    """(column, scheme, blocks, tuples, first_block, last_block) by description of the cascade."""
    return choice.groupBy("column", "scheme").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("tuples"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"))


def scheme_ranges(choice: DataFrame) -> DataFrame:
    """(column, scheme, first_block, last_block, tuples): the stretches of neighbouring blocks with one scheme."""
    own = Window.partitionBy("column").orderBy("block_id")
    marked = choice.withColumn("_run", F.row_number().over(own) - F.row_number().over(Window.partitionBy("column", "scheme").orderBy("block_id")))
    return marked.groupBy("column", "scheme", "_run").agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"), F.sum("n").alias("tuples")).drop("_run")


def ratio_rollup(sizes: DataFrame) -> DataFrame:
    """(column, ratio_avg, ratio_weighted, scheme): mean ratio of blocks, ratio of sums, most frequent scheme."""
    counts = sizes.groupBy("column", "scheme").agg(F.count(F.lit(1)).alias("k")).groupBy("column").agg(F.max_by("scheme", F.struct(F.col("k"), F.col("scheme"))).alias("scheme"))
    return sizes.groupBy("column").agg(F.round(F.avg(F.col("raw") / F.col("compressed")), 6).alias("ratio_avg"), F.round(F.sum("raw") / F.sum("compressed"), 6).alias("ratio_weighted")).join(counts, "column")
