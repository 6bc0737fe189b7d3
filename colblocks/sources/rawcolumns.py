"""Raw column files: a little-endian array per column, a byte per row that says whether it is present, strings with slots."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.encode import _ARROW, _SPARK, column_kinds, to_stored
from .csvio import column_file
from .parts import _store

_DTYPE = {"int": "<i4", "long": "<i8", "double": "<f8"}


def pack_numbers(values: np.ndarray, kind: str) -> bytes:
    return values.astype(_DTYPE[kind]).tobytes()


def pack_strings(values: list[bytes]) -> bytes:
    """Count, (size, offset) slots, bytes; offsets count from the start of the file."""
    size = np.fromiter(map(len, values), "<u8", len(values))
    offset = 8 + 16 * len(values) + np.cumsum(size) - size
    return struct.pack("<Q", len(values)) + np.stack([size, offset.astype("<u8")], axis=1).tobytes() + b"".join(values)


def unpack_strings(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<Q", data)
    slots = np.frombuffer(data, "<u8", 2 * n, 8).reshape(-1, 2).tolist()
    return [data[o : o + s] for s, o in slots]


def _writer(path: str, kinds: dict[str, str]):
    def run(table: pa.Table) -> pa.Table:
        store, root = _store(path)
        table = table.sort_by("row_id")
        part, first = table.column("_part")[0].as_py(), table.column("row_id")[0].as_py()
        folder = f"{root}/part-{part:05d}"
        temporary = f"{root}/.part-{part:05d}-{uuid.uuid4().hex}"
        store.create_dir(temporary, recursive=True)
        for i, (name, kind) in enumerate(kinds.items()):
            values, present = to_stored(table.column(name), kind)
            for suffix, data in ((kind, pack_strings(values) if kind == "string" else pack_numbers(values, kind)), ("bitmap", present.astype(np.uint8).tobytes())):
                with store.open_output_stream(f"{temporary}/{column_file(i, name, suffix)}", compression=None) as out:
                    out.write(data)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)
        store.move(temporary, folder)
        return pa.table({"part": pa.array([part], pa.int64()), "first": pa.array([first], pa.int64()), "n": pa.array([table.num_rows], pa.int64())})

    return run


def write_columns(rows: DataFrame, path: str, rows_per_part: int = 1 << 20) -> DataFrame:
    """Files of ``rows`` (with row_id), a folder per part of consecutive rows; returns (part, first, n)."""
    kinds = column_kinds(rows)
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    parts = rows.select("row_id", F.floor(F.col("row_id") / rows_per_part).alias("_part"), *[F.col(c).cast(k if k != "long" else "bigint").alias(c) for c, k in kinds.items()])
    return parts.groupBy("_part").applyInArrow(_writer(path, kinds), "part long, first long, n long")


def _reader(path: str, schema: list[tuple[int, str, str]]):
    def run(batches):
        store, root = _store(path)
        for batch in batches:
            for part, first in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist()):
                out, n = {}, 0
                for i, name, kind in schema:
                    read = lambda suffix: store.open_input_file(f"{root}/part-{part:05d}/{column_file(i, name, suffix)}").read()  # noqa: B023, E731
                    present = np.frombuffer(read("bitmap"), np.uint8).astype(bool)
                    data, n = read(kind), len(present)
                    if kind == "string":
                        out[name] = pa.array([v if p else None for v, p in zip(unpack_strings(data), present.tolist())], pa.binary()).cast(pa.string())
                    else:
                        out[name] = pa.array(np.frombuffer(data, _DTYPE[kind]), mask=~present).cast(_ARROW[kind])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), *out.values()], names=["row_id", *out])

    return run


def read_columns(spark: SparkSession, path: str, schema: list[tuple[str, str]], rows_per_part: int = 1 << 20, only_type: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """row_id and the columns of a directory written by ``write_columns``; ``schema`` has name and value type of all columns."""
    store, root = _store(path)
    parts = sorted(int(f.base_name[5:]) for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
    own = [(i, n, k) for i, (n, k) in enumerate(schema) if (only_type is None or k == only_type) and (columns is None or n in columns)]
    out = T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(n, _SPARK[k]) for _, n, k in own]])
    index = spark.createDataFrame([(p, p * rows_per_part) for p in parts], "part long, first long").repartition(max(1, len(parts)))
    return index.mapInArrow(_reader(path, own), out)
