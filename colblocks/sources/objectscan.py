"""Whole part files fetched by range requests, decoded, and measured."""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import WIDTH
from ..plans.encode import _ARROW, decode_cell
from .parts import _store, unchunk

#: Bytes of a range request.
REQUEST_BYTES = 16 << 20
_FIELDS = [("column", pa.string()), ("part", pa.int64()), ("requests", pa.int64()), ("bytes", pa.int64()), ("chunks", pa.int64()), ("tuples", pa.int64()), ("decoded_bytes", pa.int64()), ("fetch_s", pa.float64()), ("decode_s", pa.float64())]
SCHEMA = "column string, part long, requests long, bytes long, chunks long, tuples long, decoded_bytes long, fetch_s double, decode_s double"


def ranges_of(size: int, request: int = REQUEST_BYTES) -> list[tuple[int, int]]:
    """(offset, length) of the requests that fetch an object."""
    return [(a, min(request, size - a)) for a in range(0, size, request)]


def _fetch(path: str, request: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            rows = []
            for column, number, part in zip(*(batch.column(c).to_pylist() for c in ("column", "column_no", "part"))):
                started = time.perf_counter()
                with store.open_input_file(f"{root}/column{number:05d}_part{part:05d}") as f:
                    wanted = ranges_of(f.size(), request)
                    data = b"".join(f.read_at(n, at) for at, n in wanted)
                fetched = time.perf_counter()
                (count,) = struct.unpack_from("<I", data)
                tuples = decoded = 0
                for at in struct.unpack_from(f"<{count}I", data, 4):
                    kind, how, n, payload, nullmap = unchunk(memoryview(data)[at:])
                    values = decode_cell(payload, how, nullmap, kind, _ARROW[kind])
                    tuples += n
                    decoded += n * WIDTH[kind] if kind in WIDTH else 4 * (n + 1) + values.nbytes
                rows.append((column, part, len(wanted), len(data), count, tuples, decoded, fetched - started, time.perf_counter() - fetched))
            cols = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], names=[n for n, _ in _FIELDS])

    return run


def scan_objects(spark: SparkSession, path: str, columns: list[str] | None = None, request: int = REQUEST_BYTES) -> DataFrame:
    """A row per part file: requests, bytes, chunks, values, decoded bytes and the seconds of fetching and decoding.

    A task takes one file at a time, part files being bounded; ``columns`` leaves all other files unread.
    """
    files = spark.read.parquet(f"{path}/index").select("column", "column_no", "part").distinct()
    if columns is not None:
        files = files.where(F.col("column").isin(*columns))
    return files.mapInArrow(_fetch(path, request), SCHEMA)


def scan_summary(scans: DataFrame) -> DataFrame:
    """(files, requests, bytes, tuples, decoded_bytes, task_s, gbit_per_s, mib_per_s) of a scan: rates per second of task time."""
    out = scans.agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("requests", "bytes", "tuples", "decoded_bytes")], F.sum(F.col("fetch_s") + F.col("decode_s")).alias("task_s"))
    return out.withColumns({"gbit_per_s": F.col("bytes") * 8 / 1e9 / F.col("task_s"), "mib_per_s": F.col("decoded_bytes") / (1 << 20) / F.col("task_s")})
