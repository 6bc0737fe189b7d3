"""Whole conversions: delimited text to part files and back, with reports, timings and verification."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import blocks as B
from ..operators import compare as C
from ..operators.packing import compression_report
from ..sources import csvio, parts
from . import encode as E


def table_to_parts(df: DataFrame, path: str, *order: str, config: Config = Config(), verify: bool = True, columns: list[str] | None = None, only_type: str | None = None, block: int | None = None) -> dict:
    """Encode a table into part files; returns the report, timings in seconds and the schema.

    ``columns``, ``only_type`` and ``block`` restrict what is converted; what is left out isn't in the metadata either. With
    ``verify`` the files are read again and compared row by row.
    """
    spark = df.sparkSession
    kinds = {c: k for c, k in E.column_kinds(df, columns).items() if only_type in (None, k)}
    rows = B.blocks(df, config.block_size, *order)
    if block is not None:
        rows = rows.where(F.col("block_id") == block)
    started = time.time()
    staged = f"{path}/.encoded-{uuid.uuid4().hex}"
    E.encode_blocks(rows, config, list(kinds)).write.parquet(staged)
    encoded = spark.read.parquet(staged)
    parts.write_parts(encoded, path, config)
    encoded_at = time.time()
    if verify:
        want = rows.select("row_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c) for c in kinds])
        parts.register(spark)
        C.verify(spark.read.format("colblocks").load(path), want)
    sizes = encoded.select("column", F.col("raw_size").alias("raw"), (F.col("data_size") + F.col("nullmap_size")).alias("compressed"))
    report = {r["column"]: (r["raw"], r["compressed"]) for r in compression_report(sizes).collect()}
    store, root = parts._store(staged)
    store.delete_dir(root)
    return {"report": report, "kinds": kinds, "encode_s": encoded_at - started, "verify_s": time.time() - encoded_at}


def csv_to_parts(spark: SparkSession, csv_path: str, schema: list[tuple[str, str]], path: str, order: list[str], sep: str = "|", **options) -> dict:
    """Parse and encode; ``order`` names the columns that put the rows in order."""
    started = time.time()
    df = csvio.read_csv(spark, csv_path, schema, sep)
    stats = {r["column"]: (r["null_count"], r["empty_count"]) for r in csvio.table_stats(df).collect()}
    parsed = time.time() - started
    return table_to_parts(df, path, *order, **options) | {"stats": stats, "parse_s": parsed}


def parts_to_csv(spark: SparkSession, path: str, out: str, sep: str = "|") -> None:
    """Text in the order of the rows; nulls as ``null``."""
    parts.register(spark)
    csvio.write_csv(spark.read.format("colblocks").load(path), out, ["row_id"], sep)


def compare_csv(spark: SparkSession, a: str, b: str, schema: list[tuple[str, str]], sep: str = "|") -> DataFrame:
    """(side, line, cnt): rows that one file has more often, numbers normalised, the order left aside."""
    def lines(path: str) -> DataFrame:
        df = csvio.read_csv(spark, path, schema, sep)
        kinds = {n: csvio.ALIASES[t] for n, t in schema if t in csvio.ALIASES}
        return df.select(F.concat_ws(sep, *[C.normal_cell(F.col(n), k) for n, k in kinds.items()]).alias("line"))

    return C.multiset_diff(lines(a), lines(b))


def part_report(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, parts, blocks, tuples, bytes) from the chunk index; nothing is decoded."""
    index = spark.read.parquet(f"{path}/index")
    return index.groupBy("column", "type").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("tuples"), F.sum("size").alias("bytes"))
