"""Language ID: nearest of several TF-IDF n-gram centroids per language by cosine, with distance-based rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 4096
PIECE = 1 << 20
#: Samples of a size class that it takes to reject by its least cosine.
FLOOR_SAMPLES = 20
_LETTER = regex.compile(r"\p{L}")
_KEEP = np.zeros(256, bool)
_KEEP[0x61:0x7B] = _KEEP[0x80:] = True


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the 2- and 3-grams of bytes, in lower case, anything but letters as one blank."""
    out = np.zeros(DIMS, np.int64)
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    keep = _KEEP[raw]
    mask = keep.copy()
    mask[0] = True
    mask[1:] |= keep[:-1]
    b = np.where(keep, raw, 32)[mask].astype(np.uint32)
    for at in range(0, len(b), PIECE):
        x = b[at : at + PIECE + 2]
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] + x[2:] * np.uint32(0xC2B2AE3D)
        fresh = min(PIECE, len(b) - at)
        for codes in (two[:fresh], three[:fresh]):
            out += np.bincount((codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIMS)
    return out


@dataclass
class Centroids:
    """The fitted model: languages, idf, unit centroids with their language, and the least cosine accepted by text size."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    lang_of: np.ndarray
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, cosine, rejected) per row of counts."""
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(cos)), best], 0, 1)
        return self.lang_of[best], score, score < self.floor[size_class(counts)]


def size_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), 31)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit rows; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-12), c)
    return c


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [ngram_counts(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "counts"])


def fit(docs: DataFrame, per_lang: int = 400, clusters: int = 4, slack: float = 0.6, seed: int = 5, max_langs: int = 256, max_rows: int = 12_000) -> Centroids | None:
    """Fit on at most about ``per_lang`` rows of ``docs(doc_id, text, lang)`` per language, ``max_rows`` in all, a hash sample, of the
    ``max_langs`` most frequent languages (the model's bounds: its size and what reaches the driver don't grow with the corpus).

    Rows with a null text or lang or without a letter are not learned from. A text is rejected if its cosine is under
    ``slack`` times the least that sampled texts of its size class (power of two of n-grams) reach; a class with fewer than
    FLOOR_SAMPLES of them goes by the next smaller one, the smallest rejects none. None if nothing can be learned from.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not sizes:
        return None
    per_lang = max(1, min(per_lang, max_rows // len(sizes)))
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(rate)
    place = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    u = F.shiftrightunsigned(place, 11) / float(1 << 53)
    got = rows.where(u < rate).mapInArrow(_count_rows, "doc_id long, lang string, counts binary").collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["counts"]))
    if not got:
        got = rows.where(F.col("lang").isin(*sizes)).orderBy(place).limit(per_lang).mapInArrow(_count_rows, "doc_id long, lang string, counts binary").collect()
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in got])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    langs = sorted({r["lang"] for r in got})
    own = np.array([langs.index(r["lang"]) for r in got])
    model = Centroids(langs, idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(32))
    x = model.vectors(counts)
    parts = [kmeans(x[own == i], clusters, seed + i) for i in range(len(langs))]
    model.centroids, model.lang_of = np.concatenate(parts), np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)])
    best = np.stack([(x @ p.T).max(axis=1) for p in parts], axis=1)[np.arange(len(x)), own]
    least, kinds = np.full(32, np.inf), size_class(counts)
    np.minimum.at(least, kinds, best)
    least[np.bincount(kinds, minlength=32) < FLOOR_SAMPLES] = np.inf
    least[0] = 0.0
    for i in range(1, 32):  # larger texts lie closer: a class without samples takes the floor of the next smaller one
        least[i] = least[i] if np.isfinite(least[i]) else least[i - 1]
    model.floor = slack * least
    return model


def _predictor(model: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(batch), 512):
                part = [t.as_py() for t in texts.slice(at, 512)]
                ok = np.array([bool(t and _LETTER.search(t)) for t in part])
                counts = np.stack([ngram_counts(t) if o else np.zeros(DIMS, np.int64) for t, o in zip(part, ok)])
                lang, score, rejected = model.predict(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(at, 512) for i in range(batch.num_columns)],
                        pa.array([model.langs[k] if o else "und" for k, o in zip(lang, ok)], pa.string()),
                        pa.array(np.where(ok, score, 0.0).astype(float)),
                        pa.array(rejected | ~ok),
                    ],
                    names=[*batch.schema.names, "_lang_pred", "_score", "_rejected"],
                )

    return run


def held_out_rule():
    """Documents whose crc32 of the doc_id as text leaves 1 modulo 3 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, train: DataFrame | None = None, **fit_options) -> DataFrame:
    """All columns of ``docs`` with _lang_pred, _score (cosine, 0 to 1) and _rejected.

    Learns from ``train`` (by default those of ``docs`` that aren't held out). 'und' with score 0, rejected, if the text
    is null or has no letter (category L), or if nothing could be learned. Whole texts are read; rows are independent, so ties and repeats
    get equal answers. Columns of ``docs`` named like the three new ones are an error. No shuffle: the model (languages x clusters x DIMS floats) travels with the tasks.
    """
    from pyspark.sql import types as T

    model = fit(train if train is not None else docs.where(~held_out_rule()), **fit_options)
    if model is None:
        return docs.withColumns({"_lang_pred": F.lit("und"), "_score": F.lit(0.0), "_rejected": F.lit(True)})
    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_rejected", T.BooleanType())])
    return docs.mapInArrow(_predictor(model), schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), docs.where(~held_out_rule()))
    return out.select("doc_id", held_out_rule().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))
