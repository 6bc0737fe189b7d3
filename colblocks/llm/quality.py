"""Quality rules: repetition counts and tokeniser fertility with rejection bands per script."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ranges

#: Directory of the public vocabulary files, and the one with byte fallback.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
#: Words kept tokenised within a task.
CACHE_WORDS = 400_000
#: The scripts told apart and the first and last code point of their main blocks.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]

SQL_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, byte_share double, entropy double"
_NAMES = [c.split()[0] for c in SQL_SCHEMA.split(", ")]


def repeat_words(ids: np.ndarray, window: int = 5) -> int:
    """Words in windows of ``window`` words that are found twice or more; ids: one number a distinct word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base, code = int(ids.max()) + 1, ids[:n].astype(np.int64)
    top = base
    for j in range(1, window):
        if top * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            top = int(code.max()) + 1
        code, top = code * base + ids[j : j + n], top * base
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    cover = np.zeros(len(ids) + 1, np.int64)
    twice = np.flatnonzero(counts[inverse] > 1)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return n


def script_of(text: str) -> str:
    """The script with most letters; 'other' without any."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if text.isascii():
        return "latin" if ((cp | 32) - 97 < 26).any() else "other"
    counts = {name: int(((cp >= a) & (cp <= b)).sum()) for name, a, b in SCRIPTS}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class Fertility:
    """Token ids of words, cached within a task: no piece of the vocabulary crosses the start of a word."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self._clear()

    def _clear(self):
        self.index: dict[bytes, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def number(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The numbers of the words of each text; new words are encoded all at once."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        index, known = self.index, len(self.index)
        out = [np.array([index.setdefault(w, len(index)) for w in words], np.int64) for words in texts]
        if len(index) > known:
            got = self.sp.encode([w.decode() for w in islice(index, known, None)], num_threads=1)
            n = np.fromiter(map(len, got), np.int64, len(got))
            self.size = np.concatenate([self.size, n])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in got for i in x), np.int32, int(n.sum()))])
            self.start = np.cumsum(self.size) - self.size
        return out

    def measure(self, texts: list[str | None]) -> list[tuple]:
        texts = [t or "" for t in texts]
        words = [t.encode().split() for t in texts]
        return [self._row(t, w) for t, w in zip(texts, self.number(words))]

    def _row(self, text: str, ids: np.ndarray) -> tuple:
        tokens = self.flat[ranges(self.start[ids], self.size[ids])] if len(ids) else self.flat[:0]
        chars = len(text) - sum(map(text.count, BLANKS))
        n = len(tokens)
        entropy = byte_share = per = None
        if n:
            p = np.bincount(tokens, minlength=len(self.is_byte)) / n
            byte_share, p = float(p[self.is_byte].sum()), p[p > 0]
            entropy, per = float(-(p * np.log2(p)).sum()), chars / n
        local = np.unique(ids, return_inverse=True)[1] if len(ids) else ids
        return len(ids), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat_words(local), script_of(text), n, per, byte_share, entropy


def _measurer(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(model_file)
        types = [pa.int64()] * 6 + [pa.string(), pa.int64()] + [pa.float64()] * 3
        for batch in batches:
            texts = batch.column("text")
            rows = []
            for at in range(0, len(texts), 1000):
                rows += fertility.measure(texts.slice(at, 1000).to_pylist())
            cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in types[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, types[1:])]], names=_NAMES)

    return run


#: Measures of a band and the width of the steps in which their quartiles are told.
MEASURES = {"chars_per_token": 1 / 1024, "byte_share": 1 / 65_536, "entropy": 1 / 1024}


def bands(measures: DataFrame, reach: float) -> DataFrame:
    """(script, <measure>_low, <measure>_high): the quartiles of each measure widened by ``reach`` times their distance.

    Quartiles come from counts of steps of MEASURES, so they are exact to a step, the same in every run, and no more than some
    thousand rows a script.
    """
    steps = F.array(*[F.struct(F.lit(m).alias("m"), F.floor(F.col(m) / w).alias("step")) for m, w in MEASURES.items()])
    counts = measures.select("script", F.explode(steps).alias("s")).groupBy("script", "s.m", "s.step").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("script", "m")
    counts = counts.withColumns({"upto": F.sum("c").over(own.orderBy("step")), "n": F.sum("c").over(own)})
    quart = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("n"), F.col("step")))
    quarts = counts.groupBy("script", "m").agg(quart(1).alias("q1"), quart(3).alias("q3"))
    at = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c))) * MEASURES[m]
    wide = lambda m: reach * (at(m, "q3") - at(m, "q1"))
    rest = [at(m, "q1") - wide(m) for m in MEASURES], [at(m, "q3") + (F.greatest(F.lit(0.05), wide(m)) if m == "byte_share" else wide(m)) for m in MEASURES]
    return quarts.groupBy("script").agg(*[c.alias(f"{m}_{side}") for side, cs in zip(("low", "high"), rest) for m, c in zip(MEASURES, cs)])


def quality(docs: DataFrame, tokenizers: str = TOKENIZERS, reach: float = 4.0, min_words: int = 10, max_repeat_percent: int = 20, min_tokens: int = 50) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts, token measures, base_failed, band_failed, kept.

    The public vocabulary in ``tokenizers`` gives characters per token, the share of byte-fallback tokens and the entropy of the
    tokens. Bands are fitted per script on all documents with ``min_tokens`` tokens (see ``bands``). A document leaves its band
    by too few or too many characters per token, too many byte tokens or too low or too high an entropy; texts under ``min_tokens``
    tokens say too little and are judged by the base rules alone. There are as many bands as SCRIPTS, so they are broadcast. Null
    or empty texts have zero counts, null measures and fail. Rows are independent, repeats included; other columns are left out, so
    none can clash.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    m = scratch.stage(docs.select("doc_id", "text").mapInArrow(_measurer(f"{tokenizers}/{VOCABULARY}"), SQL_SCHEMA), "measures")
    own = bands(m.where(F.col("n_tokens") >= min_tokens), reach)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    off = F.lit(False)
    for c in MEASURES:
        off = off | (F.col(c) > F.col(f"{c}_high"))
        if c != "byte_share":
            off = off | (F.col(c) < F.col(f"{c}_low"))
    out = m.join(F.broadcast(own), "script", "left").withColumns({"base_failed": failed, "band_failed": F.coalesce((F.col("n_tokens") >= min_tokens) & off, F.lit(False))})
    return out.select(*_NAMES, "base_failed", "band_failed", (~F.col("base_failed") & ~F.col("band_failed")).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
