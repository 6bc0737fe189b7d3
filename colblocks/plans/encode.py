"""Encoding and decoding whole tables: a group is a column of a block."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SCHEMES, WIDTH, Config
from ..operators import blocks as B
from ..operators import codec as K

#: A row per column of a block.
ENCODED = "column string, column_no int, type string, block_id long, tuple_count int, scheme string, description string, raw_size long, data_size long, nullmap_type string, nullmap_size long, lo double, hi double, ilo long, ihi long, nan boolean, present long, nullmap binary, payload binary"
_FIELDS = [("column", pa.string()), ("column_no", pa.int32()), ("type", pa.string()), ("block_id", pa.int64()), ("tuple_count", pa.int32()), ("scheme", pa.string()), ("description", pa.string()), ("raw_size", pa.int64()), ("data_size", pa.int64()), ("nullmap_type", pa.string()), ("nullmap_size", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("ilo", pa.int64()), ("ihi", pa.int64()), ("nan", pa.bool_()), ("present", pa.int64()), ("nullmap", pa.binary()), ("payload", pa.binary())]


def to_stored(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray | list[bytes], np.ndarray]:
    """(stored values, present): nulls are stored as zero or the empty string."""
    present = column.is_valid().to_numpy().astype(bool)
    if kind == "string":
        return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()], present
    filled = column.fill_null(0)
    return filled.to_numpy().astype(np.float64 if kind == "double" else np.int64), present


def encode_column(values, present: np.ndarray, kind: str, config: Config) -> tuple[K.Stream, int, str, bytes]:
    """(stream, raw bytes, kind of null map, null map)."""
    encoder = K.Encoder(config)
    if kind == "string":
        stream, raw = encoder.strings(values, present), 4 * (len(values) + 1) + sum(map(len, values))
    else:
        stream, raw = encoder.numbers(values, present, kind), len(values) * WIDTH[kind]
    return stream, raw, *K.encode_present(present)


def bounds(values, present: np.ndarray, kind: str) -> tuple:
    """(lo, hi, ilo, ihi, nan): doubles without their NaNs, whole numbers as such; null where there is nothing to bound."""
    if kind == "string" or not present.any():
        return None, None, None, None, False
    some = values[present]
    if kind != "double":
        return None, None, int(some.min()), int(some.max()), False
    real = some[~np.isnan(some)]
    nan = len(real) < len(some)
    return (float(real.min()), float(real.max()), None, None, nan) if len(real) else (None, None, None, None, nan)


def _fragmenter(kinds: list[str]):
    """Rows of a batch -> a row per block and column with the column's cells as one Arrow message."""

    def run(batches):
        for batch in batches:
            block, pos = batch.column("block_id").to_numpy(), batch.column("pos").to_numpy()
            if (np.diff(block) < 0).any():
                order = np.argsort(block, kind="stable")
                batch, block, pos = batch.take(pa.array(order)), block[order], pos[order]
            edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            rows = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                places = pos[a:b]
                dense = bool((np.diff(places) == 1).all())
                for i in range(len(kinds)):
                    cells = {"v": batch.column(f"_{i}").slice(a, b - a)} | ({} if dense else {"pos": pa.array(places)})
                    rows.append((i, int(block[a]), int(places[0]), dense, pa.RecordBatch.from_pydict(cells).serialize().to_pybytes()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FRAGMENT)], names=[n for n, _ in _FRAGMENT])

    return run


_FRAGMENT = [("column_no", pa.int32()), ("block_id", pa.int64()), ("start", pa.int64()), ("dense", pa.bool_()), ("cells", pa.binary())]
_CELL = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _gathered(table: pa.Table, names: list[str], kinds: dict[str, str]) -> tuple[str, str, int, np.ndarray | list[bytes], np.ndarray]:
    """(name, kind, block, stored values in order, present) of a group of fragments."""
    table = table.sort_by("start")
    i, block = table.column("column_no")[0].as_py(), table.column("block_id")[0].as_py()
    kind = kinds[names[i]]
    value, place = pa.field("v", _CELL[kind]), pa.field("pos", pa.int64())
    cells, places = [], []
    for start, dense, data in zip(*(table.column(c).to_pylist() for c in ("start", "dense", "cells"))):
        got = pa.ipc.read_record_batch(pa.py_buffer(data), pa.schema([value] if dense else [value, place]))
        cells.append(got.column(0))
        places.append(np.arange(start, start + len(got)) if dense else got.column(1).to_numpy())
    column, at = pa.chunked_array(cells), np.concatenate(places)
    if (np.diff(at) < 0).any():
        column = column.take(pa.array(np.argsort(at, kind="stable")))
    return names[i], kind, block, *to_stored(column, kind)


def _own(config: Config, column: str) -> Config:
    return config.configure(overrides={path: scheme for (name, path), scheme in config.overrides.items() if name == column})


def _encoder(kinds: dict[str, str], config: Config, of: dict[str, str] | None = None):
    names, of = list(kinds), of or {c: c for c in kinds}

    def run(table: pa.Table) -> pa.Table:
        source, kind, block, values, present = _gathered(table, names, kinds)
        rows = []
        for no, (name, own) in enumerate(of.items()):
            if own == source:
                stream, raw, how, nullmap = encode_column(values, present, kind, _own(config, name))
                rows.append((name, no, kind, block, len(present), stream.names[0], stream.description, raw, len(stream.data), how, len(nullmap), *bounds(values, present, kind), int(present.sum()), nullmap, stream.data))
        return pa.table({n: pa.array(c, t) for c, (n, t) in zip(zip(*rows), _FIELDS)})

    return run


def _estimator(kinds: dict[str, str], config: Config):
    names = list(kinds)

    def run(table: pa.Table) -> pa.Table:
        name, kind, block, values, present = _gathered(table, names, kinds)
        encoder = K.Encoder(_own(config, name))
        if kind == "string":
            found, sampled = encoder.string_costs(values, present, sorted(set(values))), set()
        else:
            found = encoder.estimates(values, present, kind)
            sampled = set(found) & K.SAMPLED
        codes = SCHEMES[kind]
        best = max(found, key=lambda s: (found[s], codes[s]))
        uniq = len(set(values)) if kind == "string" else len(np.unique(values))
        rows = [(name, kind, block, len(present), uniq, s, r, s in sampled, s == best) for s, r in found.items()]
        return pa.table({n: pa.array(c, t) for c, (n, t) in zip(zip(*rows), _ESTIMATE)})

    return run


_ESTIMATE = [("column", pa.string()), ("type", pa.string()), ("block_id", pa.int64()), ("n", pa.int64()), ("uniq", pa.int64()), ("scheme", pa.string()), ("ratio", pa.float64()), ("sampled", pa.bool_()), ("best", pa.bool_())]
ESTIMATES = "column string, type string, block_id long, n long, uniq long, scheme string, ratio double, sampled boolean, best boolean"


def column_kinds(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The columns that can be encoded and their value types; other types are skipped, as in a schema file."""
    kinds = {c: B.family(t) for c, t in df.dtypes if c not in ("row_id", "block_id", "pos") and (columns is None or c in columns)}
    return {c: k for c, k in kinds.items() if k}


def _pieces(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    types, cast = dict(rows.dtypes), {"int": "int", "long": "long", "double": "double", "string": "string"}
    values = [(F.unix_micros(F.col(c).cast("timestamp")) if types[c].startswith("timestamp") else F.col(c).cast(cast[k])).alias(f"_{i}") for i, (c, k) in enumerate(kinds.items())]
    return rows.select(F.col("block_id").cast("long").alias("block_id"), F.col("pos").cast("long").alias("pos"), *values).mapInArrow(_fragmenter(list(kinds.values())), "column_no int, block_id long, start long, dense boolean, cells binary")


def encode_blocks(rows: DataFrame, config: Config = Config(), columns: list[str] | None = None, of: dict[str, str] | None = None) -> DataFrame:
    """Encoded columns of ``rows`` with block_id and pos. One shuffle of whole column pieces, by column and block; a task holds one such at a time.

    ``of`` names the columns to return and the column of ``rows`` that each is made of: what is encoded in several ways is shuffled once.
    """
    kinds = column_kinds(rows, list(of.values()) if of else columns)
    return _pieces(rows, kinds).groupBy("column_no", "block_id").applyInArrow(_encoder(kinds, config, of), ENCODED)


def estimate_blocks(rows: DataFrame, config: Config = Config(), columns: list[str] | None = None) -> DataFrame:
    """(column, type, block_id, n, uniq, scheme, ratio, sampled, best): what each usable scheme is expected to make of a column of a block.

    The ratio follows from the block's statistics or, where ``sampled``, from its sample; ``best`` marks the one that the encoder takes.
    """
    kinds = column_kinds(rows, columns)
    return _pieces(rows, kinds).groupBy("column_no", "block_id").applyInArrow(_estimator(kinds, config), ESTIMATES)


def encode(df: DataFrame, *order: str, config: Config = Config(), columns: list[str] | None = None) -> DataFrame:
    """Encoded columns of a table in the order given."""
    return encode_blocks(B.blocks(df, config.block_size, *order), config, columns)


def decode_cell(payload: bytes, nullmap_type: str, nullmap: bytes, kind: str, spark_type: pa.DataType) -> pa.Array:
    """The values of an encoded column with their nulls."""
    values = K.decode_strings(payload) if kind == "string" else K.decode_numbers(payload, kind)
    present = K.decode_present(nullmap_type, nullmap, len(values))
    if kind == "string":
        return pa.array([v if p else None for v, p in zip(values, present.tolist())], pa.binary()).cast(pa.string())
    return pa.array(values, mask=~present).cast({"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[kind]).cast(spark_type)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_SPARK = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def _decoder(kinds: dict[str, str], block_size: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block_id")[0].as_py()
        by = {r["column"]: r for r in table.to_pylist()}
        n = table.column("tuple_count")[0].as_py()
        out = {"row_id": pa.array(np.arange(n) + block * block_size)}
        for name, kind in kinds.items():
            r = by[name]
            out[name] = decode_cell(r["payload"], r["nullmap_type"], r["nullmap"], kind, _ARROW[kind])
        return pa.table(out)

    return run


def decode(encoded: DataFrame, kinds: dict[str, str], block_size: int = Config().block_size) -> DataFrame:
    """row_id and the named columns of a table; only their payloads are shuffled."""
    schema = T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(c, _SPARK[k]) for c, k in kinds.items()]])
    rows = encoded.where(F.col("column").isin(*kinds)).select("column", "block_id", "tuple_count", "nullmap_type", "nullmap", "payload")
    return rows.groupBy("block_id").applyInArrow(_decoder(kinds, block_size), schema)


def report(encoded: DataFrame) -> DataFrame:
    """(column, raw, data, nullmaps, ratio) per column: the ratio leaves null maps and frames out."""
    return encoded.groupBy("column").agg(F.sum("raw_size").alias("raw"), F.sum("data_size").alias("data"), F.sum("nullmap_size").alias("nullmaps")).withColumn("ratio", F.round(F.col("raw") / F.col("data"), 6))


def describe(encoded: DataFrame) -> DataFrame:
    """(column, description, blocks, tuples, first_block, last_block) by the whole cascade."""
    return encoded.groupBy("column", "description").agg(F.count(F.lit(1)).alias("blocks"), F.sum("tuple_count").alias("tuples"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"))


def _timed(repetitions: int):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                K.decode_strings(r["payload"]) if r["type"] == "string" else K.decode_numbers(r["payload"], r["type"])  # warm-up
                start = time.perf_counter()
                for _ in range(repetitions):
                    K.decode_strings(r["payload"]) if r["type"] == "string" else K.decode_numbers(r["payload"], r["type"])
                rows.append((r["column"], r["raw_size"], r["data_size"], (time.perf_counter() - start) / repetitions * 1e6))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["column", "raw", "data", "us"])

    return run


def decode_speed(encoded: DataFrame, repetitions: int = 1) -> DataFrame:
    """(column, data, raw, data_per_chunk, us, mb_per_s) per column and for all: time in the decoders alone."""
    timed = encoded.select("column", "type", "raw_size", "data_size", "payload").mapInArrow(_timed(repetitions), "column string, raw long, data long, us double")
    out = timed.rollup("column").agg(F.sum("data").alias("data"), F.sum("raw").alias("raw"), F.avg("data").alias("data_per_chunk"), F.sum("us").alias("us"))
    return out.withColumn("column", F.coalesce("column", F.lit("Total"))).withColumn("mb_per_s", F.col("raw") / F.col("us"))


def decision_log(encoded: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """What was decided for each column and block, what came of it, and beside it what had been expected."""
    out = encoded.select("column", "type", "block_id", "scheme", "description", F.col("raw_size").alias("before"), F.col("data_size").alias("after"), F.round(F.col("raw_size") / F.col("data_size"), 6).alias("ratio"))
    if estimates is None:
        return out
    best = estimates.where("best").select("column", "block_id", "uniq", F.col("scheme").alias("expected_scheme"), F.round("ratio", 6).alias("estimate"), "sampled")
    return out.join(best, ["column", "block_id"], "left").withColumn("comment", F.when(F.col("scheme") != F.col("expected_scheme"), F.lit("fell back")))


def _symbols(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            table = K.symbol_table(r["payload"])
            if table is not None:
                rows.append((r["column"], r["block_id"], r["scheme"], len(table[0]), sum(map(len, table[0])), table[1], table[2]))
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["column", "block_id", "scheme", "symbols", "symbol_bytes", "before", "after"])


def symbol_log(encoded: DataFrame) -> DataFrame:
    """(column, block_id, scheme, symbols, symbol_bytes, before, after, ratio) of the blocks with a symbol table, read from their streams."""
    own = encoded.where("type = 'string'").select("column", "block_id", "scheme", "payload")
    out = own.mapInArrow(_symbols, "column string, block_id long, scheme string, symbols long, symbol_bytes long, before long, after long")
    return out.withColumn("ratio", F.round(F.col("before") / F.col("after"), 6))
