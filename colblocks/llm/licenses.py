"""License scans: fuzzy search for short notices with pigeonhole seeds and bounded-error matching."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Phrases that count wherever their words stand in a row, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices as words in lower case, and their labels. A place may differ from a notice by ``edits_of`` characters.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("gnu lesser general public license version 3", "lgpl-3.0"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc"),
    ("mozilla public license", "mpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("all rights reserved", "reserved"),
]


def edits_of(text: str) -> int:
    """One edit for each eleven characters, eight at most."""
    return min(8, len(text) // 11)


_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPANS)])
SQL_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,start:long,end:long,edits:int>>"


def normal(text: str | None) -> str:
    """The words in lower case, one space before and after each; ' ' without words."""
    raw = np.frombuffer((b" " + (text or "").encode() + b" ").lower(), np.uint8)
    word = _WORD[raw]
    keep = word.copy()
    keep[0] = True
    keep[1:] |= word[:-1]
    return np.where(word, raw, 32).astype(np.uint8)[keep].tobytes().decode()


class Covered:
    """Ranges that don't overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        """Take the range unless it overlaps one taken before."""
        i = bisect_right(self.starts, a)
        if (i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


@dataclass
class Scanner:
    """Seeds and patterns of the notices; built once a task.

    A notice with k edits allowed is cut into k + 1 pieces, of which one at least stands unchanged in any match, so looking
    for the pieces loses none. A found piece tells within k characters where the notice begins; found beginnings within k characters
    of each other share a window, a notice and 3 k characters long at most, in which the regex library looks for the best match.
    """

    notices: list = field(default_factory=lambda: NOTICES)

    def __post_init__(self):
        self.seeds, by_seed = ahocorasick.Automaton(), {}
        self.edits = [edits_of(text) for text, _ in self.notices]
        self.crumbs = [[text[a:b] for a, b in _cut(len(text), len(text) // 4)] for text, _ in self.notices]
        for i, (text, _) in enumerate(self.notices):
            k = self.edits[i]
            for a, b in _cut(len(text), k + 1):
                by_seed.setdefault(text[a:b], []).append((i, b))
        for seed, places in by_seed.items():
            self.seeds.add_word(seed, places)
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}") for (text, _), k in zip(self.notices, self.edits)]

    def windows(self, norm: str) -> Iterator[tuple[int, int, int]]:
        """(notice, from, to): stretches of bounded length that hold all matches."""
        begins: dict[int, set[int]] = {}
        for end, places in self.seeds.iter(norm):
            for i, upto in places:
                begins.setdefault(i, set()).add(end + 1 - upto)
        for i, own in begins.items():
            k, size, first, last = self.edits[i], len(self.notices[i][0]), None, None
            for at in [*sorted(own), None]:
                if first is not None and (at is None or at - first > k):
                    yield i, max(0, first - k), min(len(norm), last + size + k)
                    first = None
                if first is None:
                    first = at
                last = at

    def _likely(self, i: int, window: str) -> bool:
        """Whether all but k crumbs of the notice stand in the window: an edit spoils one crumb at most."""
        return sum(c not in window for c in self.crumbs[i]) <= self.edits[i]

    def fuzzy(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in the normal text: of matches that overlap the one with the fewest edits, then the longest, the first."""
        found = set()
        for i, a, b in self.windows(norm):
            shortest = len(self.notices[i][0]) - self.edits[i]
            while b - a >= shortest and self._likely(i, norm[a:b]) and (m := self.patterns[i].search(norm, a, b)):
                body = m.group()
                found.add((i, m.start() + len(body) - len(body.lstrip()), m.end() - len(body) + len(body.rstrip()), sum(m.fuzzy_counts)))
                # A worse place may stand before the best one, so what precedes it is searched too; behind it the next window does.
                b = m.start()
        taken, best = Covered(), []
        for m in sorted(found, key=lambda m: (m[3], m[1] - m[2], m[1], m[0])):
            if taken.add(m[1], m[2]):
                best.append(m)
        return best

    def scan(self, text: str | None) -> dict:
        norm = normal(text)
        places, labels, base, spans, score = [], set(), set(), [], 0.0
        hits = [(label, at, at + len(phrase) + 1) for phrase, label in BASE.items() for at in _places(norm, f" {phrase} ")]
        fuzzy = self.fuzzy(norm)
        if hits or fuzzy:
            blank = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32)
            word = lambda at: int(np.searchsorted(blank, at, "left"))  # noqa: E731  (blanks before a place)
        for label, a, b in hits:
            places.append(word(a))
            base.add(label)
            spans.append((label, word(a), word(b) - 1, 0))
        if base:
            score = 1.0
        for i, a, b, edits in fuzzy:
            text_i, label = self.notices[i]
            labels.add(label)
            spans.append((label, max(0, word(a) - 1), max(0, word(b) - 1), edits))
            score = max(score, 1 - edits / len(text_i))
        if spans:
            at = [m.span() for m in _WORDS.finditer(text.translate(_UPPER))]
            spans = [(label, a, b, at[a][0], at[min(b, len(at) - 1)][1], e) for label, a, b, e in sorted(set(spans))]
        return {
            "n_words": norm.count(" ") - 1,
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | labels)),
            "score": score,
            "spans": [dict(zip(("label", "first_word", "last_word", "start", "end", "edits"), s)) for s in spans],
        }


def _cut(size: int, parts: int) -> list[tuple[int, int]]:
    cuts = [size * j // parts for j in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _places(norm: str, phrase: str) -> Iterator[int]:
    at = norm.find(phrase)
    while at >= 0:
        yield at
        at = norm.find(phrase, at + 1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        rows = [{"doc_id": d.as_py()} | scanner.scan(t.as_py()) for d, t in zip(batch.column("doc_id"), batch.column("text"))]
        yield pa.RecordBatch.from_pylist(rows, SCHEMA)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: word and phrase counts, labels, score and spans (words and code points).

    Text in lower case (A-Z) is cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Base labels come from places where a phrase's
    words stand in a row; ``labels`` adds notices found within their bounded number of character edits. ``score`` is 1 for an
    exact phrase, else 1 - edits / length of the best notice, 0 without any. Null and empty texts have no words, empty
    labels and null places. Of places of notices that overlap, that with the fewest edits is reported, of equals the longest, then the
    first. Other columns of ``docs`` are left out, so none can clash. Time grows in proportion to the text. Rows are handled on their own, in one pass and without a shuffle; only a row's text is in memory.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SQL_SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
