"""SentencePiece encoding and decoding by matching all pieces at once against a suffix array of a batch's words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import ranges
from .quality import TOKENIZERS, VOCABULARY

#: Code points of distinct words that are indexed together, and characters of text handled together.
INDEX_CHARS, BATCH_CHARS = 400_000, 4_000_000
#: Words kept encoded within a task.
CACHE_WORDS = 400_000
#: Characters of a word that is merged by rounds, along with all others.
LONG_WORD = 64
NEVER = np.iinfo(np.int64).max
MARK = "▁"
_PARTS = re.compile(r"▁*[^▁\n]+|▁+|\n+")


class Vocabulary:
    """Pieces, merge order and byte tokens of a public .model file (BPE with byte fallback)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        spelled = [b"" if sp.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        for b, t in enumerate(self.bytes.tolist()):
            spelled[t] = bytes([b])
        self.size = np.array(list(map(len, spelled)))
        self.at, self.spelled = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(spelled), np.uint8)
        # Dense codes of the characters in pieces; 0 is any other character.
        alphabet = sorted({c for i in plain for c in self.pieces[i]})
        self.code = {ord(c): k + 1 for k, c in enumerate(alphabet)}
        self.points, self.max_len = np.array(sorted(self.code)), max(len(self.pieces[i]) for i in plain)
        self.single = np.full(len(alphabet) + 1, -1)
        for i in plain:
            if len(self.pieces[i]) == 1:
                self.single[self.code[ord(self.pieces[i])]] = i
        long = [i for i in plain if len(self.pieces[i]) > 1]
        self.ids, self.lens = np.array(long), np.array([len(self.pieces[i]) for i in long])
        self.keys = self._keys([[self.code[ord(c)] for c in self.pieces[i]] for i in long], 0)
        self.ends = self._keys([[self.code[ord(c)] for c in self.pieces[i]] for i in long], 0xFFFF)
        # Merges go by falling score, equal scores from the left: rank 0 merges first.
        self.rank = np.unique(-score[self.ids], return_inverse=True)[1]

    def _keys(self, rows: list[list[int]], fill: int) -> np.ndarray:
        out = np.full((len(rows), self.max_len), fill, ">u2")
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return out.view(f"S{2 * self.max_len}").ravel()

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared to ``depth`` characters at least (prefix doubling from four characters of 16 bits)."""
    ends = np.concatenate([codes, np.zeros(3, codes.dtype)]).astype(np.uint64)
    n, k = len(codes), 4
    key = ends[:n] << np.uint64(48) | ends[1 : n + 1] << np.uint64(32) | ends[2 : n + 2] << np.uint64(16) | ends[3:]
    order = np.argsort(key)
    while k < depth:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        k *= 2
    return order


class Edges:
    """Places of pieces of two characters or more, sorted by position: start, length and number in v.ids.

    Zeros in ``codes`` part the words. The text is indexed by stretches, each long enough for pieces that begin in it.
    """

    def __init__(self, codes: np.ndarray, v: Vocabulary, stretch: int = 2 * INDEX_CHARS):
        self.v, self.n, self.wide = v, len(codes), v.max_len + 1
        keys, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for at in range(0, len(codes), stretch):
            start, which = self._occurrences(codes[at : at + stretch + v.max_len - 1], min(stretch, len(codes) - at))
            keys.append((start + at) * self.wide + v.lens[which])
            pieces.append(which.astype(np.int32))
        keys, pieces = np.concatenate(keys), np.concatenate(pieces)
        order = np.argsort(keys)
        self.keys, self.pieces = keys[order], pieces[order]

    def _occurrences(self, codes: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of all pieces that begin in the first ``upto`` characters: a binary search of each in the suffix array."""
        v, width = self.v, self.v.max_len
        order = suffix_array(codes, width)
        order = order[order < upto]
        padded = np.concatenate([codes, np.zeros(width, codes.dtype)]).astype(">u2")
        # No piece holds a 0, so keys may run over the end of a word.
        rows = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)]
        keys = np.ascontiguousarray(rows[order]).view(f"S{2 * width}").ravel()
        lo, hi = np.searchsorted(keys, v.keys, "left"), np.searchsorted(keys, v.ends, "right")
        count = hi - lo
        return order[ranges(lo, count)], np.repeat(np.arange(len(count)), count)

    def piece(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of the piece that stands there, or -1."""
        key = start * self.wide + length
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.pieces[at], -1) if len(self.keys) else np.full(len(key), -1)

    def rank(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Rank of the merge that makes this piece, NEVER without one."""
        e = self.piece(start, length)
        return np.where(e >= 0, self.v.rank[e], NEVER)


def relax(edges: Edges, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the tokens of all words, by the order of merges: the edge of least rank that spans two neighbouring
    tokens is contracted, the leftmost of equals, until a word has no such edge. What the agenda of a BPE model does.

    Words of LONG_WORD characters or fewer take a contraction each in a round for all of them, and longer ones an agenda of their own.
    """
    long = ends - starts > LONG_WORD
    done_s, done_e = _rounds(edges, starts[~long], ends[~long])
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        s, e = _agenda(edges, a, b)
        done_s.append(s)
        done_e.append(e)
    s, e = np.concatenate(done_s), np.concatenate(done_e)
    order = np.argsort(s, kind="stable")
    return s[order], (e - s)[order]


def _rounds(edges: Edges, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    token = ranges(starts, ends - starts)
    word = np.repeat(np.arange(len(starts)), ends - starts)
    stop = token + 1
    done_s, done_e = [token[:0]], [token[:0]]
    n = edges.n
    pair, stale = np.full(len(token), NEVER), np.ones(len(token), bool)
    while len(token):
        # Only pairs beside the last contraction have changed.
        i = np.flatnonzero(stale)
        pair[i] = NEVER
        i = i[i + 1 < len(token)]
        i = i[word[i + 1] == word[i]]
        span = stop[i + 1] - token[i]
        i, span = i[span < edges.wide], span[span < edges.wide]
        rank = edges.rank(token[i], span)
        pair[i] = np.where(rank < NEVER, rank * n + token[i], NEVER)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(pair, first)
        size = np.diff(np.append(first, len(token)))
        live = np.repeat(best < NEVER, size)
        done_s.append(token[~live])
        done_e.append(stop[~live])
        m = np.flatnonzero(live & (pair == np.repeat(best, size)))
        stop[m] = stop[m + 1]
        stale[:] = False
        stale[m] = True
        stale[np.maximum(m - 1, 0)] = True
        keep = live
        keep[m + 1] = False
        token, stop, word, pair, stale = token[keep], stop[keep], word[keep], pair[keep], stale[keep]
    return done_s, done_e


def _agenda(edges: Edges, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """One word by a heap of its pairs: n log n steps whatever its length."""
    n, wide = end - start, edges.wide
    lo, hi = np.searchsorted(edges.keys, [start * wide, end * wide])
    at, size = edges.keys[lo:hi] // wide - start, (edges.keys[lo:hi] % wide).astype(np.uint8).tobytes()
    rank = array("q", edges.v.rank[edges.pieces[lo:hi]].tobytes())
    first = array("q", np.searchsorted(at, np.arange(n + 1)).tobytes())

    def look(a: int, b: int) -> int:
        """Rank of the piece from a to b."""
        for e in range(first[a], first[a + 1]):
            if size[e] == b - a:
                return rank[e]
        return -1

    stop, before, now = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", [-1]) * n
    heap = []
    for a in range(n - 1):
        now[a] = look(a, a + 2)
        if now[a] >= 0:
            heap.append(now[a] * n + a)
    heapify(heap)
    while heap:
        r, a = divmod(heappop(heap), n)
        if now[a] != r:
            continue  # one of the two has been merged since
        b = stop[a]
        stop[a], now[b] = stop[b], -1
        if stop[a] < n:
            before[stop[a]] = a
            now[a] = look(a, stop[stop[a]])
            if now[a] >= 0:
                heappush(heap, now[a] * n + a)
        else:
            now[a] = -1
        p = before[a]
        if p >= 0:
            now[p] = look(p, stop[a])
            if now[p] >= 0:
                heappush(heap, now[p] * n + p)
    s, a = [], 0
    while a < n:
        s.append(a)
        a = stop[a]
    s = np.array(s, np.int64) + start
    return s, np.append(s[1:], end)


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all words, number of tokens of each)."""
    points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    codes = v.codes(points)
    codes[ends] = 0
    edges = Edges(codes, v)
    s, length = relax(edges, starts, ends)
    ids = np.where(length == 1, v.single[codes[s]], v.ids[edges.piece(s, length)])
    which = np.searchsorted(ends, s, "right")
    if (ids < 0).any():  # characters outside the vocabulary, as the bytes of their UTF-8 form
        rows = [v.bytes[list(chr(points[p]).encode())] if i < 0 else [i] for i, p in zip(ids.tolist(), s.tolist())]
        which = np.repeat(which, [len(r) for r in rows])
        ids = np.concatenate(rows)
    return ids.astype(np.int32), np.bincount(which, minlength=len(words))


class Encoder:
    """Encodes whole texts; within a task each distinct word is encoded once, until CACHE_WORDS words are kept."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self):
        self.number: dict[str, int] = {}
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, number of tokens of each). Null and empty texts have none.

        Pieces never cross the start of a word or the end of a line.
        """
        if len(self.number) > CACHE_WORDS:
            self._clear()
        number, known = self.number, len(self.number)
        place = [[number.setdefault(w, len(number)) for w in _PARTS.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts]
        words, flat, counts, at = list(islice(number, known, None)), [self.flat], [self.counts], 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and size < INDEX_CHARS:
                size += len(words[end]) + 1
                end += 1
            ids, n = encode_words(words[at:end], self.v)
            flat.append(ids)
            counts.append(n)
            at = end
        self.flat, self.counts = np.concatenate(flat), np.concatenate(counts)
        sizes = list(map(len, place))
        use = np.fromiter(chain.from_iterable(place), np.int64, sum(sizes))
        starts, n = (np.cumsum(self.counts) - self.counts)[use], self.counts[use]
        of = np.repeat(np.arange(len(texts)), sizes)
        return self.flat[ranges(starts, n)], np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)


def decode_ids(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of token ids, ``counts`` tokens each: byte tokens join to UTF-8 (what isn't valid becomes U+FFFD), control tokens say nothing."""
    n = v.size[ids]
    data = v.spelled[ranges(v.at[ids], n)].tobytes()
    ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)].tolist()
    out, start = [], 0
    for end in ends:
        text = data[start:end].replace(MARK.encode(), b" ").decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
        start = end
    return out


def _coder(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model_file)
        encoder = Encoder(v)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < BATCH_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                part = texts[at:end]
                ids, counts = encoder.encode(part)
                same = [d == (t or "").replace(MARK, " ") for d, t in zip(decode_ids(ids, counts, v), part)]
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                rows = [*[batch.column(i).slice(at, end - at) for i in range(batch.num_columns)], lists, pa.array(counts), pa.array(same)]
                yield pa.RecordBatch.from_arrays(rows, names=[*batch.schema.names, "_ids", "_n_tokens", "_round_trip"])
                at = end

    return run


def encode(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of ``docs`` with _ids, _n_tokens and _round_trip: the text equals what its ids decode to.

    The ids equal those of the public library for the same .model file. Null and empty texts have no tokens. A mark U+2581 in
    a text decodes to a space, as in the library. Rows are independent; a task handles BATCH_CHARS characters at a time, or
    one longer text, and indexes INDEX_CHARS characters of distinct words at a time; a word of any length takes time in
    proportion to n log n. Columns named like the three new ones are an error. No shuffle.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_n_tokens", T.LongType()), T.StructField("_round_trip", T.BooleanType())])
    return docs.mapInArrow(_coder(f"{tokenizers}/{vocabulary}"), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).selectExpr("doc_id", "_n_tokens AS n_tokens", "_ids AS ids", "_round_trip AS round_trip")
