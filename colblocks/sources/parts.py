"""Part files: encoded blocks of a column packed greedily, aligned, with a metadata file; and a Spark data source over them."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..config import Config
from ..operators.packing import pack_parts
from ..plans.encode import _ARROW, _SPARK, decode_cell

ALIGN = 16
#: Layout of the frame before a chunk, as a format string: struct objects cannot travel to the workers.
FRAME = "<BBxxIII"
FRAME_BYTES = struct.calcsize(FRAME)
#: Encoded bytes that a reading task is meant to take.
SPLIT_BYTES = 4 << 20
INDEX = "column string, column_no int, type string, block_id long, n long, present long, part long, offset long, size long, lo double, hi double, ilo long, ihi long, nan boolean"
_NULLMAPS = ["ALLZEROS", "ALLONES", "REGULAR", "FLIPPED"]
_TYPES = ["int", "long", "double", "string"]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def chunk(kind: str, nullmap_type: str, n: int, payload: bytes, nullmap: bytes) -> bytes:
    """Frame, payload, null map."""
    return struct.pack(FRAME, _TYPES.index(kind), _NULLMAPS.index(nullmap_type), n, len(payload), len(nullmap)) + payload + nullmap


def unchunk(data: bytes) -> tuple[str, str, int, bytes, bytes]:
    kind, how, n, size, nulls = struct.unpack_from(FRAME, data)
    at = FRAME_BYTES
    return _TYPES[kind], _NULLMAPS[how], n, data[at : at + size], data[at + size : at + size + nulls]


def _writer(path: str):
    def run(table: pa.Table) -> pa.Table:
        store, root = _store(path)
        table = table.sort_by("block_id")
        rows = table.to_pylist()
        r0 = rows[0]
        chunks = [chunk(r["type"], r["nullmap_type"], r["n"], r["payload"], r["nullmap"]) for r in rows]
        head, offsets = 4 + 4 * len(chunks), []
        at = -(-head // ALIGN) * ALIGN
        for c in chunks:
            offsets.append(at)
            at += -(-len(c) // ALIGN) * ALIGN
        name = f"column{r0['column_no']:05d}_part{r0['part']:05d}"
        temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary, compression=None) as out:
            out.write(struct.pack(f"<I{len(offsets)}I", len(chunks), *offsets))
            done = head
            for c, o in zip(chunks, offsets):
                out.write(bytes(o - done) + c)
                done = o + len(c)
        store.move(temporary, f"{root}/{name}")  # a repeated task replaces the file by the same bytes
        table = table.append_column("offset", pa.array(offsets, pa.int64())).append_column("size", pa.array(list(map(len, chunks)), pa.int64()))
        return table.select([f.split()[0] for f in INDEX.split(", ")])

    return run


def write_parts(encoded: DataFrame, path: str, config: Config = Config()) -> None:
    """A file per column and part of at most ``part_bytes`` bytes, the chunk index as Parquet and a small metadata file.

    ``encoded`` should be a written table: packing looks at its sizes and then fetches the payloads.
    """
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    sizes = encoded.select("column", "block_id", (F.col("data_size") + F.col("nullmap_size") + FRAME_BYTES).alias("size"))
    placed = encoded.join(pack_parts(sizes, config.part_bytes).select("column", "block_id", "part"), ["column", "block_id"])
    placed = placed.withColumn("n", F.col("tuple_count").cast("long"))
    placed.groupBy("column", "part").applyInArrow(_writer(path), INDEX).write.mode("overwrite").parquet(f"{path}/index")
    got = encoded.sparkSession.read.parquet(f"{path}/index")
    columns = [r.asDict() for r in got.groupBy("column_no", "column", "type").agg((F.max("part") + 1).alias("parts")).orderBy("column_no").collect()]
    blocks = got.agg(F.countDistinct("block_id")).head()[0]
    with store.open_output_stream(f"{root}/metadata") as out:
        out.write(json.dumps({"block_size": config.block_size, "num_chunks": blocks, "columns": columns}).encode())


def read_metadata(path: str) -> dict:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/metadata") as f:
        return json.loads(f.read())


class PartReader:
    """Random access to the chunks of a part file."""

    def __init__(self, path: str):
        store, file = _store(path)
        self.file = store.open_input_file(file)
        (self.count,) = struct.unpack("<I", self.file.read(4))
        self.offsets = struct.unpack(f"<{self.count}I", self.file.read(4 * self.count))

    def frame(self, i: int) -> tuple[str, str, int, int, int]:
        self.file.seek(self.offsets[i])
        kind, how, n, size, nulls = struct.unpack(FRAME, self.file.read(FRAME_BYTES))
        return _TYPES[kind], _NULLMAPS[how], n, size, nulls

    def column(self, i: int) -> pa.Array:
        kind, how, n, size, nulls = self.frame(i)
        data = self.file.read(size + nulls)
        return decode_cell(data[:size], how, data[size:], kind, _ARROW[kind])

    def close(self) -> None:
        self.file.close()


class BlockPartition(InputPartition):
    """Neighbouring blocks that a task reads: per column (number, part, offsets, sizes)."""

    def __init__(self, blocks: list[int], columns: dict[str, tuple[int, list[int], list[int], list[int]]]):
        self.blocks, self.columns = blocks, columns


def may_hold(c: dict, op: str, v: int | float) -> bool:
    """Whether a block with these bounds may hold a value that meets the comparison. NaN equals itself and is above all numbers."""
    if not c["present"]:
        return False
    if c["type"] == "string":
        return True
    whole = c["type"] in ("int", "long")
    if whole != isinstance(v, int):
        return True  # compared in another type than the bounds are in
    lo, hi, nan = (c["ilo"], c["ihi"], False) if whole else (c["lo"], c["hi"], c["nan"])
    if v != v:
        return nan or op.startswith("Less")
    if lo is None:  # nothing but NaN
        return op.startswith("Greater")
    return {"EqualTo": lo <= v <= hi, "GreaterThan": nan or hi > v, "GreaterThanOrEqual": nan or hi >= v, "LessThan": lo < v, "LessThanOrEqual": lo <= v}[op]


class BlocksReader(DataSourceReader):
    """Tasks of neighbouring blocks; blocks whose values can't meet the pushed filters are never opened."""

    def __init__(self, path: str, schema: T.StructType, limit: int, split: int = SPLIT_BYTES):
        self.path, self.schema, self.limit, self.split, self.filters = path, schema, limit, split, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and type(f.value) in (int, float):
                self.filters.append((f.attribute[0], type(f).__name__, f.value))
            yield f  # rows are filtered by Spark; this only skips blocks

    def _index(self):
        import pyarrow.dataset as ds

        store, root = _store(self.path)
        return ds.dataset(f"{root}/index", filesystem=store, format="parquet")

    def _dead(self, index) -> set[int]:
        """Blocks that no pushed filter's bounds leave alive; only the filtered columns of the index are read."""
        dead: set[int] = set()
        for name in {n for n, _, _ in self.filters} - {"row_id"}:
            tests = [(op, v) for n, op, v in self.filters if n == name]
            for batch in index.to_batches(filter=pc.field("column") == name, columns=["block_id", "type", "present", "lo", "hi", "ilo", "ihi", "nan"]):
                dead.update(c["block_id"] for c in batch.to_pylist() if not all(may_hold(c, op, v) for op, v in tests))
        return dead

    def partitions(self) -> list[InputPartition]:
        index, names = self._index(), [f.name for f in self.schema if f.name != "row_id"]
        # Without a column of their own, row numbers still come from the blocks of some column.
        wanted = pc.field("column").isin(names) if names else pc.field("column_no") == 0
        if self.limit:
            wanted = wanted & (pc.field("block_id") < self.limit)
        places = index.to_table(filter=wanted, columns=["column", "column_no", "block_id", "part", "offset", "size", "n"])
        dead = self._dead(index)
        if dead:
            places = places.filter(pc.invert(pc.is_in(places.column("block_id"), pa.array(sorted(dead), pa.int64()))))
        places = places.sort_by([("block_id", "ascending"), ("column_no", "ascending")])
        block, size = places.column("block_id").to_numpy(), places.column("size").to_numpy()
        task = np.cumsum(size) // self.split
        first = np.flatnonzero(np.diff(block, prepend=-1))
        task = np.repeat(task[first], np.diff(np.append(first, len(block)))) if len(block) else task
        edges = np.append(np.flatnonzero(np.diff(task, prepend=-1)), len(task))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own, columns = places.slice(a, b - a), {}
            for c in own.column("column").unique().to_pylist():
                t = own.filter(pc.field("column") == c)
                columns[c] = (t.column("column_no")[0].as_py(), *[t.column(k).to_pylist() for k in ("part", "offset", "size")])
            out.append(BlockPartition(own.column("block_id").unique().to_pylist(), columns))
        return out or [BlockPartition([], {})]  # Spark asks for a partition at least

    def read(self, partition: BlockPartition) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.path)
        size, open_files = read_metadata(self.path)["block_size"], {}
        for i, block in enumerate(partition.blocks):
            columns, n = {}, 0
            for name, (number, part, offset, length) in partition.columns.items():
                if open_files.get(name, (None,))[0] != part[i]:
                    if name in open_files:
                        open_files[name][1].close()
                    open_files[name] = part[i], store.open_input_file(f"{root}/column{number:05d}_part{part[i]:05d}")
                f = open_files[name][1]
                f.seek(offset[i])
                kind, how, n, payload, nullmap = unchunk(f.read(length[i]))
                columns[name] = decode_cell(payload, how, nullmap, kind, _ARROW[kind])
            rows = pa.array(np.arange(block * size, block * size + n))
            yield pa.RecordBatch.from_arrays([rows if f.name == "row_id" else columns[f.name] for f in self.schema], names=self.schema.fieldNames())
        for _, f in open_files.values():
            f.close()


class BlocksSource(DataSource):
    """``spark.read.format("colblocks").option("columns", "a,b").option("type", "double").option("blocks", n).option("split", bytes).load(path)``.

    Spark doesn't prune the columns of such a source, so the option does.
    """

    @classmethod
    def name(cls) -> str:
        return "colblocks"

    def schema(self) -> T.StructType:
        meta, only, kind = read_metadata(self.options["path"]), self.options.get("columns"), self.options.get("type")
        if kind is not None and kind not in _TYPES:
            raise ValueError(f"unknown type {kind!r}")
        names = [c.strip() for c in only.split(",")] if only else None
        own = [c for c in meta["columns"] if (names is None or c["column"] in names) and (kind is None or c["type"] == kind)]
        return T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(c["column"], _SPARK[c["type"]]) for c in own]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BlocksReader(self.options["path"], schema, int(self.options.get("blocks", 0)), int(self.options.get("split", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlocksSource)
