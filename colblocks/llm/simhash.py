"""SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join
from .components import connected_components

#: Words of a text handled at a time; longer texts are summed piece by piece.
PIECE = 100_000
#: Bit 0 of each of 22 segments: 21 of three bits and the last bit alone.
SEGMENT_BITS = 0x9249249249249249
SEGMENT_MASK = SEGMENT_BITS - (1 << 64)
SEGMENTS = [(3 * i, 3 if i < 21 else 1) for i in range(22)]


#: Fingerprints of a grid cell that are compared in the cell; a larger cell is verified by words, which costs its members alone.
CROWD = 32


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles in order, repeats included, by pieces; fewer words are one shingle, no words none."""
    words = (text or "").encode().lower().split()  # both touch ASCII only
    if not words:
        return
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + shingle - 1] if n > 1 else words
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        m = max(1, len(part) - shingle + 1)
        last = ends[shingle - 1 :] if len(part) >= shingle else ends[-1:]
        yield np.array([h(joined[s:e], 42) for s, e in zip(starts[:m].tolist(), last.tolist())], np.uint64)


def simhash_of(pieces: Iterable[np.ndarray]) -> int:
    """Bit by bit whether it is set in over half of the hashes; 0 without any."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash over the word shingles; 0 without words."""
    return simhash_of(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps)], names=["doc_id", "th", "fp"])

    return run


def popcount_code(fp: Column) -> Column:
    """The 22 segment popcounts, each in the place of its segment's bits."""
    m = F.lit(SEGMENT_MASK)
    return fp.bitwiseAND(m) + F.shiftrightunsigned(fp, 1).bitwiseAND(m) + F.shiftrightunsigned(fp, 2).bitwiseAND(m)


def grid_cells(fp: Column) -> Column:
    """The cells within Manhattan distance 1 of the embedding: two fingerprints within distance 2 share one of them."""
    code = popcount_code(fp)
    near = [code]
    for at, width in SEGMENTS:
        count = F.shiftrightunsigned(code, at).bitwiseAND(F.lit(7 if width == 3 else 1))
        near.append(F.when(count < width, code.bitwiseXOR(F.shiftleft(count.bitwiseXOR(count + 1), at))))
        near.append(F.when(count > 0, code.bitwiseXOR(F.shiftleft(count.bitwiseXOR(count - 1), at))))
    return F.array_compact(F.array(*near))


def fingerprint_links(distinct: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints of ``distinct(fp)`` reachable over at most 2 differing bits.

    1. Lower bound: popcounts of 22 segments; differing bits are never fewer than the Manhattan distance of the counts. The
       grid has cells of width 1 and each fingerprint stands in all cells within distance 1, so two within distance 2 share a cell: the
       range join is the equality of cells. Cells are first counted, and who shares none is out.
    2. Verification: in a cell of ``crowd`` fingerprints or fewer each is compared with those behind it by the bits in which they differ;
       every such pair within 2 bits is an edge.
    3. Larger cells, which near copies of one text fill, have as many pairs as the square of their size. Their fingerprints are
       verified by words instead, just as exactly: two differ in at most 2 bits if and only if some word is at most 1 bit from both. At
       most 65 fingerprints surround a word, all of them linked, and the least of them gets an edge to each other.
    """
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("fp").repartition(tasks, "fp")  # a fingerprint has some 45 cells: small files must not meet in a few tasks
    cells = spread.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.stage(shared, "shared")
    # Merged at every size: shared cells grow with the corpus, and the merge lets AQE split the cell of a large group.
    held = scratch.stage(cells.join(shared.hint("merge"), "cell"), "held")
    groups = held.where(F.col("n") <= crowd).groupBy("cell").agg(F.collect_list("fp").alias("fps"))  # at most ``crowd`` of them
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    behind = F.transform("fps", lambda x, i: F.transform(F.filter(F.slice("fps", i + 2, F.size("fps")), lambda y: differ(x, y) <= 2), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    paired = groups.select(F.explode(F.flatten(behind)).alias("e")).select("e.*")
    crowded = scratch.stage(held.where(F.col("n") > crowd).select("fp").distinct(), "crowded").repartition(tasks, "fp")
    words = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)])
    around = crowded.select("fp", F.explode(words).alias("word")).groupBy("word").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    return paired.unionByName(around.select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b")))


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp, component_id) per row of ``docs(doc_id, text)``; component_id is the smallest doc_id
    reachable, th the hash of the text.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Null doc_ids never name a component unless
    all of its members are null. Repeated rows are returned as often as they come.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.stage(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, th long, fp long"), "prints")
    classes = scratch.stage(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "classes")
    parts = connected_components(fingerprint_links(classes, scratch), scratch)
    rooted = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.stage(rooted.join(least, "root").select("fp", "n", "component_id"), "named")
    total = named.agg(F.sum("n")).head()[0] or 0
    return hot_join(prints, named, ["fp"], "n", total, ["component_id"], ["doc_id"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
