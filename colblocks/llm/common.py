"""Shared plumbing of the training-data operators: skew-proof joins, text constants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401

#: The six white-space characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is heavy if it holds more than one part in HEAVY_PARTS of all rows, so there are at most HEAVY_PARTS heavy keys.
HEAVY_PARTS = 2_000
#: Bits of a page of a broadcast bitmap (those of Spark's bitmaps), and of all its pages at most: 8 MB.
PAGE_BITS, MAP_BITS = 15, 26


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does just that on pure ASCII and is far cheaper than translate()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, payload: list[str], spread: list[str]) -> DataFrame:
    """Left outer join to a table with unique keys, of which some may hold a large share of the left rows.

    ``weight`` counts the left rows of a right key and ``total`` bounds their sum, so at most HEAVY_PARTS keys are heavy and
    that side is broadcast. Rows of the heavy keys are then dealt out by ``spread`` in the shuffle for the other keys,
    where no key holds more than one part in HEAVY_PARTS. The left side is read once.
    """
    heavy_row = F.col(weight) * HEAVY_PARTS > F.lit(total)
    heavy = right.where(heavy_row).select(*on, F.struct(*payload).alias("_heavy"))
    light = right.where(~heavy_row).select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(on)], F.struct(*payload).alias("_light"))
    j = left.join(F.broadcast(heavy), on, "left")
    free = F.col("_heavy").isNull()
    for k in on:  # rows without a key match nothing, so they are dealt out freely too
        free = free & F.col(k).isNotNull()
    j = j.withColumn("_k", F.when(free, F.xxhash64(*on)).otherwise(F.xxhash64(F.lit(7), *spread)))
    light = light.withColumn("_rk", F.xxhash64(*[f"_r{i}" for i in range(len(on))]))
    cond = [F.col("_k") == F.col("_rk"), *[F.when(free, F.col(k)) == F.col(f"_r{i}") for i, k in enumerate(on)]]
    for i in cond[1:]:
        cond[0] = cond[0] & i
    j = j.join(light, cond[0], "left")
    return j.select(*left.columns, *[F.coalesce(F.col(f"_heavy.{p}"), F.col(f"_light.{p}")).alias(p) for p in payload])


def maybe_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``_maybe``: false only where the whole numbers ``on`` are not among those of ``keys``.

    Rows are told apart by a broadcast bitmap of hashed keys with a bit in 16 set, so wide ones that a join would drop need no shuffle. The bitmap
    is bounded: with more than 2^22 keys it tells fewer rows apart, and none wrongly.
    """
    bits = min(MAP_BITS, max(PAGE_BITS, (16 * keys.count()).bit_length()))
    spot = F.xxhash64(F.lit(11), *[F.col(c).cast("long") for c in on]).bitwiseAND(F.lit((1 << bits) - 1))
    page, bit = F.shiftrightunsigned(spot, PAGE_BITS), spot.bitwiseAND(F.lit((1 << PAGE_BITS) - 1))
    pages = keys.select(page.alias("_page"), bit.alias("_bit")).repartition("_page")  # before any partial bitmap, which each task would have of each page
    pages = pages.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    marked = rows.withColumn("_at", page).withColumn("_bit", bit).join(F.broadcast(pages), F.col("_at") == F.col("_page"), "left")
    is_set = F.expr("cast(conv(hex(substring(_map, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(_bit % 8 as int)) <> 0")
    return marked.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("_maybe"))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    return np.arange(int(lens.sum())) + np.repeat(starts - np.cumsum(lens) + lens, lens)
