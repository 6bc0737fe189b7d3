"""SimHash near-dedup at a similarity: fingerprints and, where their bits cannot reach, min-hash bands propose; exact shingle sets decide.

At a Jaccard similarity of 0.8 two fingerprints of 64 bits differ in about 10 bits and up to 18, while the segment popcounts of
unrelated ones are about 20 apart: no grid of a radius that finds the copies leaves anything out. So the links of simhash.py, within 2
bits, are one source of candidates here and bands of min-hashes are the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_among, ranges
from .components import connected_components
from .simhash import fingerprint_links, shingle_hashes, simhash_of

#: A pair of similarity 0.8 shares one of the bands with a probability of 0.9993, one of 0.85 with 0.99999.
BANDS, ROWS = 24, 6
_FACTORS, _TERMS = (np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Sets of one side in a task; larger groups are cut and their cuts compared pairwise.
LARGEST = 2000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def bands_of(hashes: np.ndarray) -> list[int]:
    least = np.min([(hashes[a : a + 512, None] * _FACTORS + _TERMS).min(axis=0) for a in range(0, len(hashes), 512)], axis=0)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _marker(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands, prints = [], [], []
            for t in batch.column("text"):
                pieces = list(shingle_hashes(t.as_py(), shingle))
                prints.append(simhash_of(pieces))
                s = np.unique(np.concatenate([np.zeros(0, np.uint64), *pieces]))
                keys.append(int(np.array([xxhash.xxh64_intdigest(s.tobytes(), 1)], np.uint64).view(np.int64)[0]) if len(s) else None)
                bands.append(bands_of(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "th", "k", "bands", "fp"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):  # sets are larger than texts
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("root"), pa.array(sets, pa.list_(pa.int64()))], names=["k", "root", "hashes"])

    return run


def _linker(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        keys, lists = table.column("k").to_numpy(), table.column("hashes").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        start = np.cumsum(size) - size
        flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        label, mark = np.arange(len(keys)), np.zeros(len(flat), bool)
        for i in range(len(keys) - 1):
            rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])  # who is connected already need not be compared
            rest = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])]
            mark[own := flat[start[i] : start[i] + size[i]]] = True
            for part in (rest[a : a + 256] for a in range(0, len(rest), 256)):
                both = np.add.reduceat(mark[flat[ranges(start[part], size[part])]], np.cumsum(size[part]) - size[part], dtype=np.int64)
                roots = np.unique(label[part[both >= similarity * (size[part] + size[i] - both)]])
                label[np.isin(label, roots)] = label[i]
            mark[own] = False
        return pa.table({"a": keys, "b": keys[label]}).filter(pa.array(keys != keys[label]))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, th, component_id) per row of ``docs(doc_id, text)``: texts link if the Jaccard similarity of their sets of ``shingle``
    words is ``similarity`` or more.

    component_id is the smallest doc_id reachable, th the hash of the text. Texts without words link with nothing, repeated rows and equal
    sets always. Texts whose fingerprints lie within 2 bits or that share a band of min-hashes, directly or through others, form a group;
    within a group sets are compared exactly, by cuts of bounded size.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    marks = scratch.stage(texts.mapInArrow(_marker(shingle), "doc_id long, th long, k long, bands array<long>, fp long"), "marks")
    nodes = marks.where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.any_value("bands").alias("bands"), F.min("fp").alias("fp"))
    nodes = scratch.stage(nodes, "nodes")
    bands = nodes.select("k", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("band", "lo")
    banded = bands.join(shared.hint("merge"), "band").select(F.col("k").alias("a"), F.col("lo").alias("b"))
    # Equal or linked fingerprints: each class by its least node, and an edge between the classes of linked ones.
    classes = scratch.stage(nodes.groupBy("fp").agg(F.min("k").alias("least")), "classes")
    linked = fingerprint_links(classes, scratch).join(classes.select(F.col("fp").alias("a"), F.col("least").alias("_a")), "a")
    linked = linked.join(classes.select(F.col("fp").alias("b"), F.col("least").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = nodes.join(classes, "fp").where("k <> least").select(F.col("k").alias("a"), F.col("least").alias("b"))
    groups = connected_components(banded.unionByName(linked).unionByName(same), scratch)
    groups = scratch.stage(nodes.select("k", "th").join(groups.withColumnRenamed("node", "k"), "k"), "groups")
    members = maybe_among(texts.select("th", "text"), groups, ["th"]).where("_maybe")  # most texts are in no group and are not shuffled
    sets = members.join(groups, "th").select("k", "root", "text").mapInArrow(_sets(shingle), "k long, root long, hashes array<long>")
    sets = scratch.stage(sets.groupBy("k", "root").agg(F.any_value("hashes").alias("hashes")), "sets")
    large = groups.groupBy("root").count().where(F.col("count") > LARGEST).select("root", F.ceil(F.col("count") / LARGEST).cast("int").alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    cut = F.pmod(F.xxhash64(F.lit(5), "k"), cuts).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), cuts - 1), lambda j: F.struct(F.least(cut, j).alias("i"), F.greatest(cut, j).alias("j")))
    tasks = sets.join(F.broadcast(large), "root", "left").select("root", "k", "hashes", F.explode(tasks).alias("task"))
    links = tasks.groupBy("root", "task").applyInArrow(_linker(similarity), "a long, b long")
    parts = connected_components(links, scratch)
    rooted = nodes.select("k", "first").join(parts.withColumnRenamed("node", "k"), "k", "left").select("k", "first", F.coalesce("root", "k").alias("root"))
    rooted = scratch.stage(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = marks.select("doc_id", "th", "k").join(rooted.join(least, "root").select("k", "component"), "k", "left")
    return named.select("doc_id", "th", F.coalesce("component", "doc_id").alias("component_id"))
