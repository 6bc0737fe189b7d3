"""Suffix-array dedup: bytes covered by long strings of earlier documents, by deep-shallow sorting of shared windows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges

#: Bytes of a window and of the grams whose least hash stands for it. Hashes have HASH_BITS bits.
WINDOW, GRAM, HASH_BITS = 50, 24, 46
#: Bytes that multikey quicksort orders before blind tries take over.
SHALLOW = 16
#: Runs under one key, over all parts, that a place takes; the windows of a key with more are dealt over several by a hash of their bytes.
HOT_RUNS = 1 << 15
#: Bits of a segment's place within its bucket. A bucket is sorted place by place, about CHUNK windows at a time.
PLACE_BITS, CHUNK = 6, 1 << 20
#: Bits of buckets, one for each MB at most, that even a small corpus is dealt over.
SPREAD_BITS = 5
OFF = np.uint64((1 << 64) - 1)


# ---- sorting -------------------------------------------------------------------------------------------------------


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in the order of its bytes."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        m = -(-(n - k) // 8)
        out[k::8] = np.frombuffer(data[k : k + 8 * m].tobytes(), ">u8")
    return out


def _regroup(order, group, live, by, own, key) -> np.ndarray:
    """Put the live places in the order ``by``; groups end where ``own`` or ``key`` change. Returns the places that may still split."""
    order[live] = order[live][by]
    key, own = key[by], own[by]
    new = np.ones(len(live), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    group[live] = live[first[np.cumsum(new) - 1]]  # a group is named by its first place
    size = np.diff(np.append(first, len(live)))
    return np.repeat(size > 1, size)


def multikey_sort(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of the suffixes at ``starts`` by their first ``depth`` bytes; equal ones share a group number.

    Multikey sorting with words of eight bytes in place of characters: numpy orders a level of all groups at once, where a quicksort
    would split them one by one; after a word only groups of two or more are sorted by the next.
    """
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))  # places whose group may still split
    for at in range(0, depth, 8):
        word, own = words[starts[order[live]] + at], group[live]
        by = np.argsort(word)
        if at:  # groups stay together: by group, then by the rank of the word
            rank = np.empty(len(live), np.int64)
            rank[by] = np.cumsum(np.diff(word[by], prepend=word[by[:1]]) != 0)
            by = np.argsort(own << 32 | rank)
        live = live[_regroup(order, group, live, by, own, word)] if len(live) else live
    return order, group


def blind_trie_sort(data: np.ndarray, words: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray, at: int, depth: int) -> None:
    """Order the groups that agree on their first ``at`` bytes up to ``depth``; changes ``order`` and ``group``.

    The tries of all groups grow level by level. A node looks, from the byte after its parent's branch, for the first one at which any
    of its strings leaves the node's first. There it branches, on that byte alone; a node without such a byte is a leaf of equal strings.
    """
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    size = np.diff(np.append(np.flatnonzero(first), len(group)))
    live = np.flatnonzero(np.repeat(size > 1, size))
    agreed = np.full(len(live), at)
    while len(live):
        own, place = group[live], starts[order[live]]
        head = np.ones(len(live), bool)
        head[1:] = own[1:] != own[:-1]
        heads, node = np.flatnonzero(head), np.cumsum(head) - 1
        leaves = np.full(len(live), depth)
        todo = np.flatnonzero(~head)
        d, lead = agreed[todo], place[heads[node[todo]]]
        while len(todo):  # eight bytes at a time
            x = words[place[todo] + d] ^ words[lead + d]
            off = np.flatnonzero(x)
            byte = (x[off].byteswap().view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            leaves[todo[off]] = np.minimum(d[off] + byte, depth)
            on = (x == 0) & (d + 8 < depth)
            todo, d, lead = todo[on], d[on] + 8, lead[on]
        branch = np.minimum.reduceat(leaves, heads)[node]
        keep = branch < depth
        live, own, place, branch = live[keep], own[keep], place[keep], branch[keep]
        if not len(live):
            break
        byte = data[place + branch]
        by = np.argsort(own << 8 | byte)
        on = _regroup(order, group, live, by, own, byte)
        live, agreed = live[on], branch[by][on] + 1


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes at ``starts`` in the order of their first ``depth`` bytes; equal ones share a group number.

    Behind the last suffix's ``depth`` bytes at least eight more have to follow.
    """
    words = words_of(data)
    order, group = multikey_sort(words, starts, SHALLOW)
    blind_trie_sort(data, words, starts, order, group, SHALLOW, depth)
    return order, group


def least_of_equal(data: np.ndarray, starts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each window the least value among all windows with the same bytes."""
    if not len(starts):
        return value
    order, group = deep_shallow_sort(data, starts)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(value[order], first)
    out = np.empty_like(value)
    out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


# ---- windows of a part of the corpus ---------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """HASH_BITS-bit hashes of all GRAM-byte grams (GRAM = 16 + 8), by doubling."""
    mul = 0x9E3779B97F4A7C15
    h, j = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    eight = None
    while j < 16:
        h = h[:-j] * np.uint64(pow(mul, j, 1 << 64)) + h[j:]
        j *= 2
        eight = h if j == 8 else eight
    n = len(data) - GRAM + 1
    h = h[:n] * np.uint64(pow(mul, 8, 1 << 64)) + eight[16 : 16 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h >> np.uint64(64 - HASH_BITS)


def window_keys(data: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
    """The least hash of the grams of each window, piece by piece so that the passes over a piece stay in the cache."""
    n, w = len(data) - WINDOW + 1, WINDOW - GRAM + 1
    out = np.empty(n, np.uint64)
    for a in range(0, n, piece):
        h = gram_hashes(data[a : min(a + piece, n) + WINDOW - 1])
        j = 1
        while j * 2 <= w:
            h = np.minimum(h[:-j], h[j:])
            j *= 2
        out[a : a + piece] = np.minimum(h[: len(h) - (w - j)], h[w - j :])
    return out


class Part:
    """The documents of a range of doc_ids as one buffer, in the order of doc_id."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        self.ids = ids
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        self.row_order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        texts = [texts[i] for i in self.row_order]
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts) + bytes(WINDOW + 8), np.uint8)
        named = [ids[i] for i in self.row_order]
        self.rank = np.concatenate([[0], np.cumsum([a != b for a, b in zip(named[1:], named)])]) if named else np.zeros(0, np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, document, key) of all runs of neighbouring windows of a document with one key.

        The key of a window is the least hash of its grams, so equal windows have equal keys.
        """
        key = window_keys(self.data)
        count = np.maximum(self.size - WINDOW + 1, 0)
        new = np.empty(len(key), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[self.at] = True
        new[self.at + count] = True  # from here to the next document no window fits
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(key)))
        # Of documents that begin at one place all but the last are empty.
        doc = np.searchsorted(self.at, first, "right") - 1
        fits = first < (self.at + count)[doc] if len(self.at) else np.zeros(len(first), bool)
        return first[fits], windows[fits], doc[fits], key[first[fits]]

    def segments(self, shared: np.ndarray, split: np.ndarray, bits: int):
        """Distinct strings of the runs with shared keys: per run its segment; per segment start, windows, place, least rank.

        The high ``bits`` of a place are the bucket. A key with a ``split`` of s > 0 has its windows one by one, dealt over 2^s places by
        their bytes. Segments are numbered by place, then by first appearance.
        """
        start, windows, doc, key = self.runs()
        at = np.minimum(np.searchsorted(shared, key), max(len(shared) - 1, 0))
        hit = shared[at] == key if len(shared) else np.zeros(len(key), bool)
        start, windows, doc, key, parted = start[hit], windows[hit], doc[hit], key[hit], split[at[hit]].astype(np.int64) if len(shared) else np.zeros(0, np.int64)
        n = np.where(parted > 0, windows, 1)
        start = ranges(start, n)
        doc, key, parted, windows = np.repeat(doc, n), np.repeat(key, n), np.repeat(parted, n), np.repeat(np.where(parted > 0, 1, windows), n)
        seen: dict[bytes, int] = {}
        raw = self.data.tobytes()
        of = np.fromiter((seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(start.tolist(), (windows + WINDOW - 1).tolist())), np.int64, len(start))
        _, first = np.unique(of, return_index=True)
        mixed = key[first]
        hot = np.flatnonzero(parted[first] > 0)
        own = window_hashes(self.data, start[first[hot]]) & ((1 << parted[first[hot]]) - 1)
        mixed[hot] += (own + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        place = bucket_of(mixed, bits + PLACE_BITS)
        order = np.argsort(place, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        first = first[order]
        return (start, windows, doc, number[of] if len(of) else of), (start[first], windows[first], place[order], self.rank[doc[first]], key[first])


def window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A small hash of all bytes of each window."""
    weights = np.random.default_rng(23).integers(1, 1 << 62, WINDOW, dtype=np.uint64) | np.uint64(1)
    out = np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 16):
        rows = sliding_window_view(data, WINDOW)[starts[a : a + (1 << 16)]].astype(np.uint64)
        out[a : a + (1 << 16)] = ((rows * weights).sum(axis=1, dtype=np.uint64) >> np.uint64(32)).astype(np.int64)
    return out


def pack_sorted(keys: np.ndarray, zstd: zstandard.ZstdCompressor) -> bytes:
    """Sorted hashes as differences, all their low bytes first: the high ones are nearly all zero and compress away."""
    return zstd.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(blob: bytes, zstd: zstandard.ZstdDecompressor) -> np.ndarray:
    step = np.frombuffer(zstd.decompress(blob), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(step).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys are least hashes, so small ones abound; mixed once more they fall into all buckets alike."""
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def bucket_bits(total: int, bucket_bytes: int) -> int:
    """Bits of the buckets of a corpus of ``total`` bytes: of at most ``bucket_bytes`` each, and enough of them for several tasks.

    Each part writes each bucket a letter, so their number is that of the parts times that of the buckets: small buckets would make it
    grow with the square of the corpus long before a letter is worth its handling.
    """
    fit = lambda size: math.ceil(total / size).bit_length()
    return max(1, fit(bucket_bytes), min(SPREAD_BITS, fit(1 << 20)))


def chunks(place: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """The segments by place, places whole, in pieces of CHUNK windows and what their last place has beyond."""
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order].astype(np.int64), prepend=-1))
    before = (np.cumsum(windows[order]) - windows[order])[first]
    return np.split(order, first[np.flatnonzero(np.diff(before // CHUNK, prepend=-1))][1:])


def by_bucket(keys: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its keys) of sorted hashes; within a bucket they stay sorted."""
    bucket = bucket_of(keys, bits)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
    return [(int(bucket[a]), order[a:b]) for a, b in zip(first, np.append(first, len(keys))[1:].astype(int))]


def _arrow(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, t) for c, (name, t) in zip(cols, fields)})


#: What parts and buckets of hashes send each other: hashes, a byte about each, and a payload.
LETTER = "part int, bucket long, keys binary, marks binary, body binary"
_LETTER = [("part", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("marks", pa.binary()), ("body", pa.binary())]


def _offer(bits: int):
    """part -> its distinct keys by bucket; marks count a key's runs, up to 127, and flag those that two documents of the part hold."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = Part(table)
        _, _, doc, keys = part.runs()
        order = np.lexsort((part.rank[doc], keys))
        keys, rank = keys[order], part.rank[doc][order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(keys)) - 1
        several = rank[first] != rank[last] if len(first) else np.zeros(0, bool)
        marks = np.minimum(last - first + 1, 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
        rows, keys, zstd = [], keys[first], zstandard.ZstdCompressor(level=1)
        for bucket, own in by_bucket(keys, bits):
            rows.append((key[0].as_py(), bucket, pack_sorted(keys[own], zstd), zstd.compress(marks[own].tobytes()), None))
        return _arrow(rows, _LETTER)

    return run


def _share(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """bucket -> for each part those of its keys that another part, or two documents, hold; marks tell how the key is split."""
    packer, zstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    parts, keys = table.column("part").to_pylist(), [unpack_sorted(b, zstd) for b in table.column("keys").to_pylist()]
    marks = [np.frombuffer(zstd.decompress(b), np.uint8) for b in table.column("marks").to_pylist()]
    every, mark = np.concatenate(keys), np.concatenate(marks)
    order = np.argsort(every, kind="stable")
    every, mark = every[order], mark[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    twice = (np.diff(np.append(first, len(every))) > 1) | (np.maximum.reduceat(mark, first) > 127) if len(first) else np.zeros(0, bool)
    held = np.add.reduceat((mark & 127).astype(np.int64), first)[twice] if len(first) else np.zeros(0, np.int64)
    twice = every[first][twice]
    split = np.ceil(np.log2(np.maximum(held / HOT_RUNS, 1))).astype(np.uint8)
    rows = []
    for part, own in zip(parts, keys):
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        hit = twice[at] == own if len(twice) else np.zeros(len(own), bool)
        if hit.any():
            rows.append((part, key[0].as_py(), pack_sorted(own[hit], packer), split[at[hit]].tobytes(), None))
    return _arrow(rows, _LETTER)


def _shared_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(keys, their splits), sorted by key."""
    zstd = zstandard.ZstdDecompressor()
    keys = np.concatenate([np.zeros(0, np.uint64), *[unpack_sorted(b, zstd) for b in table.column("keys").to_pylist()]])
    split = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(b, np.uint8) for b in table.column("marks").to_pylist()]])
    keys, first = np.unique(keys, return_index=True)  # a split key comes from several buckets
    return keys, split[first]


def _ask(bits: int):
    """part and its shared keys -> by bucket, the strings of its runs under those keys."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return _arrow([], _LETTER)
        part, zstd = Part(docs), zstandard.ZstdCompressor(level=1)
        known, split = _shared_of(shared)
        _, (start, windows, place, _, keys) = part.segments(known, split, bits)
        rows, bucket = [], place >> PLACE_BITS
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for a, b in zip(first, np.append(first, len(bucket))[1:].astype(int)):
            n = windows[a:b]
            text = part.data[ranges(start[a:b], n + WINDOW - 1)].tobytes()
            inner = (place[a:b] & ((1 << PLACE_BITS) - 1)).astype(np.uint8).tobytes()
            body = zstd.compress(np.array([len(n)], np.uint32).tobytes() + n.astype(np.uint32).tobytes() + inner + text)
            own = np.unique(keys[a:b])
            rows.append((key[0].as_py(), int(bucket[a]), pack_sorted(own, zstd), split[np.searchsorted(known, own)].tobytes(), body))
        return _arrow(rows, _LETTER)

    return run


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """bucket -> for each part a bit per window that it asked for: an earlier part has the same bytes."""
    zstd, texts, windows, places = zstandard.ZstdDecompressor(), [], [], []
    for body in table.column("body").to_pylist():
        raw = zstd.decompress(body)
        m = int(np.frombuffer(raw, np.uint32, 1)[0])
        windows.append(np.frombuffer(raw, np.uint32, m, 4))
        places.append(np.frombuffer(raw, np.uint8, m, 4 + 4 * m))
        texts.append(memoryview(raw)[4 + 5 * m :])
    of = np.repeat(table.column("part").to_numpy(), list(map(len, windows)))
    counts = [int(n.sum()) for n in windows]
    data, n = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(windows).astype(np.int64)
    del texts
    size, first = n + WINDOW - 1, np.cumsum(n) - n
    at, earlier = np.cumsum(size) - size, np.zeros(int(n.sum()), bool)
    for own in chunks(np.concatenate(places), n):
        text = np.concatenate([data[ranges(at[own], size[own])], np.zeros(WINDOW + 8, np.uint8)])
        part = np.repeat(of[own], n[own])
        earlier[ranges(first[own], n[own])] = least_of_equal(text, ranges(np.cumsum(size[own]) - size[own], n[own]), part) < part
    bits = [np.packbits(x).tobytes() for x in np.split(earlier, np.cumsum(counts)[:-1])]
    rows = list(zip(table.column("part").to_pylist(), [key[0].as_py()] * len(bits), table.column("keys").to_pylist(), table.column("marks").to_pylist(), bits))
    return _arrow(rows, _LETTER)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def _remove(bits: int, keep_bytes: bool):
    """part and the answers -> its documents without the bytes covered by windows of earlier documents."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _arrow([], _RESULT)
        part = Part(docs)
        cover = np.zeros(len(part.data) + 1, np.int32)
        if answers.num_rows:
            (start, windows, doc, number), (s_start, s_windows, s_place, s_rank, _) = part.segments(*_shared_of(answers), bits)
            by = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()))
            buckets, first = np.unique(s_place >> PLACE_BITS, return_index=True)  # segments are in the order of their buckets
            size = np.add.reduceat(s_windows, first) if len(first) else first
            earlier = [np.unpackbits(np.frombuffer(by[b], np.uint8), count=n) for b, n in zip(buckets.tolist(), size.tolist())]
            rank = np.repeat(s_rank, s_windows)
            rank = np.where(np.concatenate(earlier).astype(bool), -1, rank) if earlier else rank
            least = least_of_equal(part.data, ranges(s_start, s_windows), rank)
            first = np.cumsum(s_windows) - s_windows
            gone = least[ranges(first[number], windows)] < np.repeat(part.rank[doc], windows)
            where = ranges(start, windows)[gone]
            cover[where] += 1  # a window stands in one run, so its place comes once
            cover[where + WINDOW] -= 1
        covered = np.cumsum(cover[:-1]) > 0
        gone = np.concatenate([[0], np.cumsum(covered)])
        rows = []
        for at, n, i in zip(part.at.tolist(), part.size.tolist(), part.row_order):
            if gone[at] == gone[at + n]:
                kept = part.data[at : at + n].tobytes()
                rows.append((part.ids[i], n, 0, 0, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
                continue
            c = covered[at : at + n]
            kept = part.data[at : at + n][~c].tobytes()
            spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
            rows.append((part.ids[i], n, int(c.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
        return _arrow(rows, _RESULT)

    return run


def part_numbers(held: list[int], part_bytes: int) -> tuple[list[int], list[int]]:
    """(first part, number of parts) of each range by its bytes: small neighbours share a part, a large one has several to itself."""
    first, pieces, part, fill = [], [], 0, 0
    for b in held:
        if fill and fill + b > part_bytes:
            part, fill = part + 1, 0
        own = max(1, math.ceil(b / part_bytes))
        first.append(part)
        pieces.append(own)
        part, fill = (part, fill + b) if own == 1 else (part + own, 0)
    return first, pieces


def remove_repeats(docs: DataFrame, part_bytes: int = 3 << 20, bucket_bytes: int = 32 << 20, max_cuts: int = 4096, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs(doc_id, text)``.

    Removes each byte covered by a 50-byte string that also starts in a document with a smaller doc_id. Texts are their UTF-8
    bytes; null and empty texts have none and texts under 50 bytes lose none. Rows that share a doc_id don't remove from each
    other; a null doc_id counts as smaller than all others.

    The corpus is cut into parts, ranges of doc_id of about ``part_bytes`` and of a document at least, which is never cut; and the
    hashes into buckets, each for at most ``bucket_bytes`` of the corpus and sorted by smaller places, so that the letters between parts
    and buckets stay few. Five steps:
    1. A part offers the distinct keys of its windows (the least hash of a window's grams).
    2. A bucket names the keys that more than one document has; windows under other keys are unique, so none is missed.
    3. A part sends each distinct string under its shared keys once, however many copies it holds.
    4. A bucket sorts these windows as suffixes, deep-shallow, and tells each part which of its windows earlier parts have.
    5. A part sorts its own windows likewise, joins both answers and removes what they cover.
    Texts are shuffled once (the exchange by part is used three times). A string in a third of all documents reaches its
    bucket once a part. Around the ends of a passage that many documents share their strings differ, though one key has them all: a
    key with more than HOT_RUNS runs has its windows dealt over the places of all buckets by a hash of their bytes, which equal windows
    share. Columns other than the two are left out, so none can clash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total, n, low, high = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).head()
    bits = bucket_bits(total, bucket_bytes)
    # Ranges of doc_id with about as many documents each; their bytes are summed, and ranges are joined to parts or cut into several.
    tops = max(1, min(4 * math.ceil(total / part_bytes), max_cuts))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / tops for i in range(1, tops)], 20 * tops)).head()[0] if tops > 1 and n else []
    inner = sorted({float(c) for c in cuts or []} - {float(low or 0)})
    d = docs.withColumn("_d", F.coalesce("doc_id", F.lit(low or 0)).cast("double"))
    d = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_d", outputCol="_p").transform(d) if inner else d.withColumn("_p", F.lit(0.0))
    held = {int(r["_p"]): r["b"] for r in d.groupBy("_p").agg(F.sum(size).alias("b")).collect()}  # a sum for each of ``max_cuts`` ranges at most
    edges = [float(low or 0), *inner, float(high or 0) + 1]
    first, pieces = part_numbers([held.get(i, 0) for i in range(len(inner) + 1)], part_bytes)
    of = lambda values: F.get(F.lit(values), F.col("_p").cast("int"))
    inside = (F.col("_d") - of(edges[:-1])) / (of(edges[1:]) - of(edges[:-1]))  # a range too large for a part is divided evenly by doc_id
    part = (of(first) + F.greatest(F.lit(0), F.least(of(pieces) - 1, F.floor(inside * of(pieces))))).cast("int")
    parts = d.select(part.alias("part"), "doc_id", "text")
    by_part = parts.groupBy("part")
    shared = by_part.applyInArrow(_offer(bits), LETTER).groupBy("bucket").applyInArrow(_share, LETTER)
    asked = by_part.cogroup(shared.groupBy("part")).applyInArrow(_ask(bits), LETTER)
    answers = asked.groupBy("bucket").applyInArrow(_answer, LETTER)
    return by_part.cogroup(answers.groupBy("part")).applyInArrow(_remove(bits, keep_bytes), RESULT)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False).drop("kept")
