"""Byte encoders and decoders of a block, in numpy; they run inside Arrow group functions only.

A stream is a tag (scheme code, number of values) and the parts of its scheme. Parts that are streams again are encoded one level
down, so a cascade ends after ``max_depth`` levels. Sizes are this format's own.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..config import DOUBLE_SCHEMES, INT_SCHEMES, STRING_SCHEMES, WIDTH, Config
from ..functions.scalar import FRACTIONS, NO_EXPONENT

_INT = {v: k for k, v in INT_SCHEMES.items()}
_DOUBLE = {v: k for k, v in DOUBLE_SCHEMES.items()}
_STRING = {v: k for k, v in STRING_SCHEMES.items()}
#: Values that are packed together with one width.
MINI = 128
#: Schemes whose ratio is estimated by encoding a sample; all others follow from statistics.
SAMPLED = frozenset({"RLE", "PFOR", "BP", "FREQUENCY", "PFOR_DELTA", "PSEUDODECIMAL", "DOUBLE_BP"})
_DTYPE = {"int": np.dtype("<i4"), "long": np.dtype("<i8"), "double": np.dtype("<f8")}


@dataclass
class Stream:
    """What an encoder makes: bytes and the names of the schemes, outermost first."""

    data: bytes
    names: tuple[str, ...]

    @property
    def description(self) -> str:
        return " -> ".join(self.names)


def join(*parts: bytes) -> bytes:
    return struct.pack(f"<B{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def split(data: bytes | memoryview) -> list[memoryview]:
    view = memoryview(data)
    n = view[0]
    sizes = struct.unpack_from(f"<{n}I", view, 1)
    out, at = [], 1 + 4 * n
    for size in sizes:
        out.append(view[at : at + size])
        at += size
    return out


# ---- bit packing -------------------------------------------------------------------------------------------------------


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned values, one at least; exact, as the float exponent of halves below 2^32."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.maximum(np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]), 1)


def pack_bits(x: np.ndarray, width: int) -> bytes:
    if width == 0 or not len(x):
        return b""
    bits = np.unpackbits(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: memoryview, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 64), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()


def _grouped(x: np.ndarray, widths: np.ndarray) -> bytes:
    """Mini-blocks packed by width, narrow ones first, each group in the order of the rows."""
    out = [pack_bits(x[widths == w].ravel(), int(w)) for w in np.unique(widths)]
    return join(widths.astype(np.uint8).tobytes(), b"".join(out))


def _ungrouped(data: memoryview) -> np.ndarray:
    widths, body = split(data)
    widths = np.frombuffer(widths, np.uint8)
    out, at = np.zeros((len(widths), MINI), np.uint64), 0
    for w in np.unique(widths).tolist():
        own = widths == w
        size = int(own.sum()) * MINI * w // 8
        out[own] = unpack_bits(body[at : at + size], int(own.sum()) * MINI, w).reshape(-1, MINI)
        at += size
    return out


def _minis(x: np.ndarray, kind: str) -> np.ndarray:
    """Values as unsigned words of their width, in rows of MINI; the last row is filled with its last value."""
    u = x.astype(np.int32).view(np.uint32).astype(np.uint64) if kind == "int" else x.astype(np.int64).view(np.uint64)
    fill = -len(u) % MINI
    return (np.concatenate([u, np.full(fill, u[-1])]) if fill else u).reshape(-1, MINI)


def _signed(u: np.ndarray, n: int, kind: str) -> np.ndarray:
    u = u.ravel()[:n]
    return u.astype(np.uint32).view(np.int32).astype(np.int64) if kind == "int" else u.view(np.int64)


def bp_encode(x: np.ndarray, kind: str) -> bytes:
    m = _minis(x, kind)
    return _grouped(m, bit_lengths(m).max(axis=1))


def bp_decode(data: memoryview, n: int, kind: str) -> np.ndarray:
    return _signed(_ungrouped(data), n, kind)


def pfor_encode(x: np.ndarray, kind: str) -> bytes:
    """Each mini-block takes the width that costs least when wider values are kept apart as exceptions."""
    m = _minis(x, kind)
    bits = bit_lengths(m)
    top = 32 if kind == "int" else 64
    over = np.stack([(bits > w).sum(axis=1) for w in range(1, top + 1)], axis=1)
    cost = np.arange(1, top + 1) * MINI / 8 + over * (4 + top / 8)
    widths = cost.argmin(axis=1) + 1
    wide = bits > widths[:, None]
    at = np.flatnonzero(wide.ravel()).astype("<u4")
    exceptions = m.ravel()[at].astype("<u4" if kind == "int" else "<u8")
    return join(_grouped(np.where(wide, 0, m), widths), at.tobytes(), exceptions.tobytes())


def pfor_decode(data: memoryview, n: int, kind: str) -> np.ndarray:
    body, at, exceptions = split(data)
    u = _ungrouped(body).ravel()
    u[np.frombuffer(at, "<u4")] = np.frombuffer(exceptions, "<u4" if kind == "int" else "<u8")
    return _signed(u, n, kind)


# ---- null maps ---------------------------------------------------------------------------------------------------------


def encode_present(present: np.ndarray) -> tuple[str, bytes]:
    n, ones = len(present), int(present.sum())
    if ones == 0:
        return "ALLZEROS", b""
    if ones == n:
        return "ALLONES", b""
    kind = "REGULAR" if ones < n // 2 else "FLIPPED"
    at = np.flatnonzero(present if kind == "REGULAR" else ~present)
    # Positions, their runs, or plain bits: whichever is shortest.
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    runs = np.stack([at[first], np.diff(np.append(first, len(at)))]).astype("<u4").tobytes()
    plain, listed = np.packbits(present if kind == "REGULAR" else ~present).tobytes(), at.astype("<u4").tobytes()
    tag, body = min(((0, listed), (1, runs), (2, plain)), key=lambda t: len(t[1]))
    return kind, bytes([tag]) + body


def decode_present(kind: str, data: bytes | memoryview, n: int) -> np.ndarray:
    if kind in ("ALLZEROS", "ALLONES"):
        return np.full(n, kind == "ALLONES")
    tag, body, out = data[0], memoryview(data)[1:], np.zeros(n, bool)
    if tag == 0:
        out[np.frombuffer(body, "<u4")] = True
    elif tag == 1:
        start, size = np.frombuffer(body, "<u4").reshape(2, -1).astype(np.int64)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + size, -1)
        out = np.cumsum(step[:-1]) > 0
    else:
        out = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
    return out if kind == "REGULAR" else ~out


# ---- symbol tables -----------------------------------------------------------------------------------------------------

ESCAPE = 255


def train_symbols(sample: bytes, rounds: int = 4) -> list[bytes]:
    """At most 255 strings of up to 8 bytes whose use saves most bytes of the sample; symbols grow by joining neighbours."""
    table: list[bytes] = []
    for _ in range(rounds):
        coded = compress_symbols(sample, table, raw=True)
        gain: dict[bytes, int] = {}
        before = b""
        for s in coded:
            gain[s] = gain.get(s, 0) + len(s)
            if before and len(before) + len(s) <= 8:
                gain[before + s] = gain.get(before + s, 0) + len(before) + len(s)
            before = s
        table = sorted(gain, key=lambda s: (-gain[s], s))[:ESCAPE]
    return table


def _matcher(table: list[bytes]):
    import re

    by_length = sorted(table, key=lambda s: (-len(s), s))
    return re.compile(b"|".join(map(re.escape, [*by_length])) + (b"|" if table else b"") + rb"[\x00-\xff]", re.S)


def compress_symbols(data: bytes, table: list[bytes], raw: bool = False):
    """Greedy longest match; a byte outside the table is escaped."""
    parts = _matcher(table).findall(data)
    if raw:
        return parts
    code = {s: bytes([i]) for i, s in enumerate(table)}
    return b"".join([code.get(p) or bytes([ESCAPE]) + p for p in parts])


def expand_symbols(data: bytes | memoryview, table: list[bytes]) -> bytes:
    codes = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(codes == ESCAPE)
    # In a row of equal bytes ESCAPE every other one, from the first, is a mark; the byte after a mark stands for itself.
    first = np.flatnonzero(np.diff(marks, prepend=-2) != 1)
    row = np.repeat(marks[first], np.diff(np.append(first, len(marks)))) if len(marks) else marks
    marks = marks[(marks - row) % 2 == 0]
    symbol = codes.astype(np.int64)
    symbol[marks + 1] += 256
    symbol = np.delete(symbol, marks)
    spelled = [*table, *[b""] * (256 - len(table)), *[bytes([i]) for i in range(256)]]
    size = np.fromiter(map(len, spelled), np.int64, 512)
    start, n = np.cumsum(size) - size, size[symbol]
    at = np.arange(int(n.sum())) + np.repeat(start[symbol] - np.cumsum(n) + n, n)
    return np.frombuffer(b"".join(spelled), np.uint8)[at].tobytes()


def _table_bytes(table: list[bytes]) -> bytes:
    return join(bytes(map(len, table)), b"".join(table)) if table else b""


def _table_from(data: memoryview) -> list[bytes]:
    if not len(data):
        return []
    sizes, body = split(data)
    ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(int)).tolist()
    return [bytes(body[a:b]) for a, b in zip([0, *ends], ends)]


# ---- numbers -----------------------------------------------------------------------------------------------------------


def runs_of(x: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths): a null extends the run that it stands in; doubles are told apart by their bits."""
    bits = x.view(np.int64) if x.dtype.kind == "f" else x
    at = np.flatnonzero(present)
    if not len(at):
        return x[:1], np.array([len(x)])
    new = at[np.concatenate([[True], bits[at[1:]] != bits[at[:-1]]])]
    start = new.copy()
    if start[0] > 0:  # leading nulls are stored as zero and run on only into zeros
        start = np.concatenate([[0], start if bits[start[0]] != 0 else start[1:]])
        values = np.concatenate([[x.dtype.type(0)], x[start[1:]]]).astype(x.dtype)
    else:
        values = x[start]
    return values, np.diff(np.append(start, len(x)))


@dataclass
class Encoder:
    """Chooses and applies schemes. ``level`` falls by one with each nested stream; at 0 streams are stored as they are."""

    config: Config = field(default_factory=Config)

    # choice

    def _sample(self, x, present):
        c = self.config
        n, k, size = len(x), c.sample_runs, c.sample_run_length
        if n <= k * size:
            return x, present
        width = n // k
        rng = np.random.default_rng(c.seed)
        picks = []
        for i in range(k):
            last = (n - i * width if i == k - 1 else width) - size
            a = i * width + int(rng.integers(0, max(last, 0) + 1))
            picks.append(np.arange(a, min(a + size, n)))
        at = np.concatenate(picks)
        return x[at], present[at]

    def _candidates(self, x, present, kind, level, nested):
        """(scheme, estimate or None to be sampled) of the schemes that are on and usable."""
        c, n, w = self.config, len(x), WIDTH[kind]
        bits = x.view(np.int64) if kind == "double" else x
        values, counts = np.unique(bits, return_counts=True)
        u, on = len(values), c.schemes(kind)
        average = n // max(1, len(runs_of(x, present)[0]))
        out = {"UNCOMPRESSED": 1.0}
        if "ONE_VALUE" in on and (u <= 1 or not present.any()) and not nested:
            out["ONE_VALUE"] = float(n)
        if "DICT" in on and level > 1:
            out["DICT"] = n * w / (int(u * w + n * max(int(u).bit_length(), 1) / 8.0) + 10 + n * 2 // 128)
        for b in (8, 16):
            if f"DICTIONARY_{b}" in on and u <= 1 << b:
                out[f"DICTIONARY_{b}"] = n * w / ((4 if kind == "int" else 8) + u * w + n * b / 8)
        if "RLE" in on and average >= c.rle_min_run and level > 0:
            out["RLE"] = None
        if "FREQUENCY" in on and 100.0 * u / n <= c.frequency_max_unique_percent:
            out["FREQUENCY"] = None
        if kind == "double":
            if "PSEUDODECIMAL" in on and u / n >= c.pseudodecimal_min_unique:
                out["PSEUDODECIMAL"] = None
            if "DOUBLE_BP" in on:
                out["DOUBLE_BP"] = None
        else:
            out |= {s: None for s in ("PFOR", "BP") if s in on}
            span = int(values[-1]) - int(values[0])
            for b in (8, 16):
                if f"TRUNCATION_{b}" in on and span < 1 << b:
                    out[f"TRUNCATION_{b}"] = 8.0 * w / b
            if "PFOR_DELTA" in on and bool((np.diff(x[present]) >= 0).all()) and present.all():
                out["PFOR_DELTA"] = None
        return out

    def numbers(self, x: np.ndarray, present: np.ndarray, kind: str, level: int | None = None, nested: bool = False, estimating: bool = False, path: tuple = ()) -> Stream:
        """Encode stored values. A result larger than the raw values is thrown away for them."""
        codes = DOUBLE_SCHEMES if kind == "double" else INT_SCHEMES
        level = self.config.max_depth if level is None else level
        raw = len(x) * WIDTH[kind]
        forced = self.config.overrides.get(path)
        if len(x) == 0 or (level <= 0 and forced is None):
            scheme = "UNCOMPRESSED"
        elif forced is not None:
            scheme = forced
        elif not nested and not estimating and self._candidates(x, present, kind, level, nested).get("ONE_VALUE"):
            scheme = "ONE_VALUE"
        elif self.config.enable_for and kind == "int" and level > 1 and int(x.min()) >= 128:
            scheme = "FOR"
        else:
            scheme = self._choose(x, present, kind, level, nested, estimating, codes)
        body, names = getattr(self, f"_{scheme.lower()}")(x, present, kind, level, estimating, path)
        if forced is None and scheme != "UNCOMPRESSED" and len(body) > raw:
            scheme, (body, names) = "UNCOMPRESSED", self._uncompressed(x, present, kind, level, estimating, path)
        return Stream(struct.pack("<BI", codes[scheme], len(x)) + body, (scheme, *names))

    def estimates(self, x: np.ndarray, present: np.ndarray, kind: str) -> dict[str, float]:
        """Estimated ratio of each usable scheme: from the statistics of the block, or from its sample, encoded."""
        sx, sp = self._sample(x, present)
        level, out = self.config.max_depth, {}
        for scheme, ratio in self._candidates(x, present, kind, level, False).items():
            if ratio is None:
                ratio = len(sx) * WIDTH[kind] / max(len(getattr(self, f"_{scheme.lower()}")(sx, sp, kind, level, True, ())[0]), 1)
            out[scheme] = float(ratio)
        return out

    def _choose(self, x, present, kind, level, nested, estimating, codes) -> str:
        if self.config.try_all and not estimating:
            tries = {s: len(getattr(self, f"_{s.lower()}")(x, present, kind, level, True, ())[0]) for s in self._candidates(x, present, kind, level, nested)}
            return min(tries, key=lambda s: (tries[s], -codes[s]))
        sx, sp = (x, present) if estimating else self._sample(x, present)
        best, score = "UNCOMPRESSED", (1.0, 0)
        for scheme, ratio in self._candidates(x, present, kind, level, nested).items():
            if ratio is None:
                size = len(getattr(self, f"_{scheme.lower()}")(sx, sp, kind, level, True, ())[0])
                ratio = len(sx) * WIDTH[kind] / max(size, 1)
            if (ratio, codes[scheme]) > score:
                best, score = scheme, (ratio, codes[scheme])
        return best

    def _nested(self, x, kind, level, estimating, path, step) -> Stream:
        x = np.ascontiguousarray(x)
        return self.numbers(x, np.ones(len(x), bool), kind, level - 1, True, estimating, (*path, step))

    # schemes: (bytes, names of nested streams)

    def _uncompressed(self, x, present, kind, level, estimating, path):
        return x.astype(_DTYPE[kind]).tobytes(), ()

    def _one_value(self, x, present, kind, level, estimating, path):
        at = np.flatnonzero(present)[:1]
        return (x[at] if len(at) else x[:1] * 0).astype(_DTYPE[kind]).tobytes(), ()

    def _dict(self, x, present, kind, level, estimating, path):
        values, code = np.unique(x.view(np.int64) if kind == "double" else x, return_inverse=True)
        values = values.view(np.float64) if kind == "double" else values
        return join(values.astype(_DTYPE[kind]).tobytes(), struct.pack("<I", len(code)), bp_encode(code, "int")), ("BP",)

    def _rle(self, x, present, kind, level, estimating, path):
        values, lengths = runs_of(x, present)
        v, c = self._nested(values, kind, level, estimating, path, "values"), self._nested(lengths, "int", level, estimating, path, "counts")
        return join(v.data, c.data), (f"[{v.description}]", f"[{c.description}]")

    def _pfor(self, x, present, kind, level, estimating, path):
        return pfor_encode(x, kind), ()

    def _bp(self, x, present, kind, level, estimating, path):
        return bp_encode(x, kind), ()

    def _pfor_delta(self, x, present, kind, level, estimating, path):
        return pfor_encode(np.diff(x, prepend=x.dtype.type(0)), "long"), ()

    def _for(self, x, present, kind, level, estimating, path):
        base = x.min()
        wide = "long" if int(x.max()) - int(base) >= 1 << 31 else "int"  # the span of 32-bit values may take 33 bits
        s = self._nested(x - base, wide, level, estimating, path, "residuals")
        return join(base.astype(_DTYPE[kind]).tobytes(), wide.encode(), s.data), (f"[{s.description}]",)

    def _truncation(self, x, dtype):
        base = x.min()
        return join(base.astype("<i8").tobytes(), (x - base).astype(dtype).tobytes())

    def _truncation_8(self, x, present, kind, level, estimating, path):
        return self._truncation(x, np.uint8), ()

    def _truncation_16(self, x, present, kind, level, estimating, path):
        return self._truncation(x, np.dtype("<u2")), ()

    def _fixed(self, x, kind, dtype):
        values, code = np.unique(x.view(np.int64) if kind == "double" else x, return_inverse=True)
        return join((values.view(np.float64) if kind == "double" else values).astype(_DTYPE[kind]).tobytes(), code.astype(dtype).tobytes())

    def _dictionary_8(self, x, present, kind, level, estimating, path):
        return self._fixed(x, kind, np.uint8), ()

    def _dictionary_16(self, x, present, kind, level, estimating, path):
        return self._fixed(x, kind, np.dtype("<u2")), ()

    def _frequency(self, x, present, kind, level, estimating, path):
        bits = x.view(np.int64) if kind == "double" else x
        if (~present).sum() >= 0.9 * len(x):
            top = bits.dtype.type(0)
        else:
            values, first, counts = np.unique(bits, return_index=True, return_counts=True)
            most = np.flatnonzero(counts == counts.max())
            top = bits[first[most[np.argmin(x[first[most]])]]]
        other = present & (bits != top)
        _, marks = encode_present(other)
        s = self._nested(x[other], kind, level, estimating, path, "exceptions")
        return join(np.array([top]).astype("<i8").tobytes(), encode_present(other)[0].encode(), marks, s.data), (f"[{s.description}]",)

    def _pseudodecimal(self, x, present, kind, level, estimating, path):
        exponent, number = np.full(len(x), NO_EXPONENT), np.zeros(len(x), np.int64)
        todo = np.flatnonzero(np.isfinite(x) & ~np.signbit(x))
        limit = (1 << self.config.pseudodecimal_max_bits) - 1
        for e, f in enumerate(FRACTIONS):
            if not len(todo):
                break
            with np.errstate(over="ignore"):
                n = np.floor(x[todo] / f + 0.5)
            ok = (n <= limit) & (n * f == x[todo])
            exponent[todo[ok]], number[todo[ok]] = e, n[ok]
            todo = todo[~ok]
        patch = exponent == NO_EXPONENT
        if patch.sum() > len(x) / 2 and path not in self.config.overrides:  # loses against any other
            return bytes(8 * len(x) + 1000), ()
        streams = self._nested(number[~patch], "int", level, estimating, path, "numbers"), self._nested(exponent, "int", level, estimating, path, "exponents"), self._nested(x[patch], "double", level, estimating, path, "patches")
        return join(*[s.data for s in streams]), tuple(f"[{s.description}]" for s in streams)

    def _double_bp(self, x, present, kind, level, estimating, path):
        return bp_encode(x.view("<i4").astype(np.int64), "int"), ()

    # strings

    def string_costs(self, values: list[bytes], present: np.ndarray, distinct: list[bytes]) -> dict[str, float]:
        n, c, on = len(values), self.config, self.config.string_schemes
        u, total, unique = len(distinct), sum(map(len, values)), sum(map(len, distinct))
        raw, there = 4 * (n + 1) + total, int(present.sum())
        cost = {"UNCOMPRESSED": 1.0}
        if u <= 1 or not there:
            cost["ONE_VALUE"] = float(n)
        many = u >= there // 2
        if "DICT" in on and not (many and "FSST" in on):
            size = int(int(28 + c.fsst_header + n * u.bit_length() / 8.0) + 4 * (1 + u) + (0.5 * unique if unique >= c.fsst_min_bytes else unique))
            cost["DICT"] = raw / size
        if "FSST" in on and many and total > c.fsst_min_bytes:
            cost["FSST"] = 1.0
        for b in (8, 16):
            if f"DICTIONARY_{b}" in on and u <= (1 << b) - 1:
                cost[f"DICTIONARY_{b}"] = raw / (n * b / 8 + 4 * (1 + u) + 8 + unique)
        return cost

    def strings(self, values: list[bytes], present: np.ndarray) -> Stream:
        n, distinct = len(values), sorted(set(values))
        cost = self.string_costs(values, present, distinct) if n else {"UNCOMPRESSED": 1.0}
        scheme = self.config.overrides.get(()) or max(cost, key=lambda s: (cost[s], STRING_SCHEMES[s]))
        if n == 0:
            scheme = "UNCOMPRESSED"
        body, names = getattr(self, f"_string_{scheme.lower()}")(values, present, distinct)
        return Stream(struct.pack("<BI", STRING_SCHEMES[scheme], n) + body, (scheme, *names))

    def _lengths(self, values) -> Stream:
        x = np.fromiter(map(len, values), np.int64, len(values))
        return self.numbers(x, np.ones(len(x), bool), "int", 2, True, False, ("lengths",))

    def _string_uncompressed(self, values, present, distinct):
        s = np.cumsum([0, *map(len, values)]).astype("<u4")
        return join(s.tobytes(), b"".join(values)), ()

    def _string_one_value(self, values, present, distinct):
        at = np.flatnonzero(present)[:1]
        return values[at[0]] if len(at) else b"", ()

    def _string_dict(self, values, present, distinct):
        number = {v: i for i, v in enumerate(distinct)}
        code = np.fromiter((number[v] for v in values), np.int64, len(values))
        fsst = "FSST" in self.config.string_schemes and sum(map(len, distinct)) >= self.config.fsst_min_bytes
        runs = runs_of(code, np.ones(len(code), bool))
        inner = self if len(code) / len(runs[0]) <= self.config.rle_force_run else Encoder(self.config.configure(overrides={("codes",): "RLE"}))
        c = inner.numbers(code, np.ones(len(code), bool), "int", 2, True, False, ("codes",))
        lengths, data, table = self._lengths(distinct), b"".join(distinct), []
        if fsst:
            table = train_symbols(data[: 1 << 14])
            data = compress_symbols(data, table)
        return join(_table_bytes(table), data, lengths.data, c.data), ("FSST" if fsst else "RAW", f"[{c.description}]")

    def _string_fsst(self, values, present, distinct):
        data = b"".join(values)
        step = max(1, len(data) >> 14)
        table = train_symbols(data[: 1 << 14] if step == 1 else b"".join(data[a : a + 512] for a in range(0, len(data), step * 512)))
        lengths = self._lengths(values)
        return join(_table_bytes(table), compress_symbols(data, table), lengths.data), (f"[{lengths.description}]",)

    def _string_fixed(self, values, distinct, dtype):
        number = {v: i for i, v in enumerate(distinct)}
        return join(np.cumsum([0, *map(len, distinct)]).astype("<u4").tobytes(), b"".join(distinct), np.fromiter((number[v] for v in values), dtype, len(values)).tobytes())

    def _string_dictionary_8(self, values, present, distinct):
        return self._string_fixed(values, distinct, np.uint8), ()

    def _string_dictionary_16(self, values, present, distinct):
        return self._string_fixed(values, distinct, np.dtype("<u2")), ()


# ---- decoding ----------------------------------------------------------------------------------------------------------


def decode_numbers(data: bytes | memoryview, kind: str) -> np.ndarray:
    """Stored values of a stream: 64-bit integers or doubles."""
    view = memoryview(data)
    code, n = struct.unpack_from("<BI", view)
    body, name = view[5:], (_DOUBLE if kind == "double" else _INT)[code]
    wide = np.float64 if kind == "double" else np.int64
    plain = lambda v: np.frombuffer(v, _DTYPE[kind]).astype(wide)
    if name == "UNCOMPRESSED":
        return plain(body)
    if name == "ONE_VALUE":
        return np.full(n, plain(body)[0])
    if name == "BP":
        return bp_decode(body, n, kind)
    if name == "PFOR":
        return pfor_decode(body, n, kind)
    if name == "PFOR_DELTA":
        return np.cumsum(pfor_decode(body, n, "long"))
    if name == "DOUBLE_BP":
        return bp_decode(body, 2 * n, "int").astype("<i4").view("<f8")
    parts = split(body)
    if name == "DICT":
        return plain(parts[0])[bp_decode(parts[2], n, "int")]
    if name == "RLE":
        return np.repeat(decode_numbers(parts[0], kind), decode_numbers(parts[1], "int"))
    if name == "FOR":
        return plain(parts[0])[0] + decode_numbers(parts[2], bytes(parts[1]).decode())
    if name.startswith("TRUNCATION"):
        return np.frombuffer(parts[0], "<i8")[0] + np.frombuffer(parts[1], np.uint8 if name.endswith("_8") else "<u2").astype(np.int64)
    if name.startswith("DICTIONARY"):
        return plain(parts[0])[np.frombuffer(parts[1], np.uint8 if name.endswith("_8") else "<u2")]
    if name == "FREQUENCY":
        out = np.full(n, np.frombuffer(parts[0], "<i8")[0])
        out = out.view(np.float64) if kind == "double" else out
        out[decode_present(bytes(parts[1]).decode(), parts[2], n)] = decode_numbers(parts[3], kind)
        return out
    exponent = decode_numbers(parts[1], "int")
    out = np.empty(n)
    fits = exponent != NO_EXPONENT
    out[fits] = decode_numbers(parts[0], "int") * np.array(FRACTIONS)[exponent[fits]]
    out[~fits] = decode_numbers(parts[2], "double")
    return out


def decode_runs(data: bytes | memoryview, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a run-length stream without expanding it."""
    view = memoryview(data)
    if (_DOUBLE if kind == "double" else _INT)[view[0]] != "RLE":
        raise ValueError("not a run-length stream")
    parts = split(view[5:])
    return decode_numbers(parts[0], kind), decode_numbers(parts[1], "int")


def _cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    e = ends.tolist()
    return [data[a:b] for a, b in zip(e, e[1:])]


def decode_strings(data: bytes | memoryview) -> list[bytes]:
    view = memoryview(data)
    code, n = struct.unpack_from("<BI", view)
    name, body = _STRING[code], view[5:]
    if name == "ONE_VALUE":
        return [bytes(body)] * n
    parts = split(body)
    if name == "UNCOMPRESSED":
        return _cut(bytes(parts[1]), np.frombuffer(parts[0], "<u4"))
    if name.startswith("DICTIONARY"):
        words = _cut(bytes(parts[1]), np.frombuffer(parts[0], "<u4"))
        return [words[i] for i in np.frombuffer(parts[2], np.uint8 if name.endswith("_8") else "<u2").tolist()]
    table = _table_from(parts[0])
    text = expand_symbols(parts[1], table) if len(parts[0]) else bytes(parts[1])
    words = _cut(text, np.concatenate([[0], np.cumsum(decode_numbers(parts[2], "int"))]))
    return words if name == "FSST" else [words[i] for i in decode_numbers(parts[3], "int").tolist()]


def symbol_table(data: bytes | memoryview) -> tuple[list[bytes], int, int] | None:
    """(symbols, bytes of the strings, bytes of their coded form) of a stream of strings; None if it has no symbol table."""
    view = memoryview(data)
    name = _STRING[struct.unpack_from("<BI", view)[0]]
    parts = split(view[5:]) if name in ("DICT", "FSST") else []
    if not parts or not len(parts[0]):
        return None
    return _table_from(parts[0]), int(decode_numbers(parts[2], "int").sum()), len(parts[1])
