"""Seeded columns for tests and examples: (row_id, v), a pure function of the row number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 65_000


def uniform(seed: int, *on: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *on), 11) / float(1 << 53)


def whole(seed: int, low: int, high: int, *on: str | Column) -> Column:
    return (F.floor(uniform(seed, *on) * (high - low)) + low).cast("long")


def word(seed: int, length: int, *on: str | Column) -> Column:
    """Alphanumeric characters from hashes."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return F.concat(*[F.substring(F.lit(letters), (whole(seed + i, 0, len(letters), *on) + 1).cast("int"), F.lit(1)) for i in range(length)])


def column(spark: SparkSession, kind: str, name: str, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """A generated column by value type and the scheme that it is made for."""
    r = F.col("row_id")
    nth = lambda n: (r % n).alias("k")
    runs = F.floor(r / 21)
    made = {
        ("int", "ONE_VALUE"): F.lit(100),
        ("int", "TRUNCATE_8"): F.lit(32_767) + F.when(r > 0, whole(seed, 0, 127, r)).otherwise(0),
        ("int", "TRUNCATE_16"): F.lit((1 << 31) // 2 - 1) + whole(seed, 0, 32_767, r),
        ("int", "DICTIONARY_8"): whole(seed, -(1 << 31), 1 << 31, nth(255)),
        ("int", "DICTIONARY_16"): whole(seed, -(1 << 31), 1 << 31, nth(1020)),
        ("int", "RLE"): F.when(uniform(seed + 1, runs) < 0.7, whole(seed, 0, 100_000, runs)).otherwise(whole(seed, 0, 100_000, r)),
        ("int", "FREQUENCY"): F.when(uniform(seed + 1, r) < 0.99, 7).otherwise(whole(seed, 0, 1 << 31, r)),
        ("double", "ONE_VALUE"): F.lit(100.0),
        ("double", "DICTIONARY_8"): uniform(seed, nth(255)) * 1_999_998 - 999_999,
        ("double", "DICTIONARY_16"): uniform(seed, nth(1020)) * 1_999_998 - 999_999,
        ("double", "RANDOM"): uniform(seed, r) * 1_999_998 - 999_999,
        ("double", "FREQUENCY"): F.when(uniform(seed + 1, r) < 0.99, 5.5).otherwise(uniform(seed, r)),
        ("string", "ONE_VALUE"): F.lit("Hello Compression !"),
        ("string", "DICTIONARY_8"): word(seed, 10, nth(255)),
        ("string", "DICTIONARY_16"): F.when(uniform(seed - 1, r) >= 0.1, word(seed, 10, nth(1020))),
        ("string", "COMPRESSED_DICTIONARY"): word(seed, 6, nth(32_766)),
    }
    if (kind, name) not in made:
        raise ValueError(f"no column {kind}/{name}")
    return spark.range(rows).select(F.col("id").alias("row_id")).withColumn("v", made[kind, name].cast(kind))
