"""Round trips of the byte encoders, by scheme and at the edges, and the choice of schemes on generated columns."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colblocks.config import DOUBLE_SCHEMES, INT_SCHEMES, STRING_SCHEMES, WIDTH, Config
from colblocks.operators import codec as K

RNG = np.random.default_rng(11)
N = 65_000
EDGE = [1, -1, 0, -10, 10, -300, -2147483648, 2147483647, -2, 128]
ODD = [0.0, -0.0, float("nan"), float("inf"), float("-inf"), -1.5, 0.1, 1e300, 3.25, 12345.67, 5e-324]


def numbers(x, kind, present=None, config=None):
    present = np.ones(len(x), bool) if present is None else present
    x = np.where(present, x, 0).astype(np.float64 if kind == "double" else np.int64)
    stream = K.Encoder(config or Config()).numbers(x, present, kind)
    got = K.decode_numbers(stream.data, kind)
    assert len(got) == len(x)
    assert np.array_equal(got.view(np.int64)[present], x.view(np.int64)[present])
    return stream, len(x) * WIDTH[kind] / len(stream.data)


def strings(values, config=None):
    stream = K.Encoder(config or Config()).strings(values, np.ones(len(values), bool))
    assert K.decode_strings(stream.data) == values
    return stream


@pytest.mark.parametrize(
    "x, kind, scheme",
    [
        (np.full(N, 100), "int", "ONE_VALUE"),
        (np.repeat(RNG.integers(0, 100_000, N // 20), 20), "int", "RLE"),
        (RNG.choice(RNG.integers(-(2**31), 2**31, 255), N), "int", "DICT"),
        (RNG.integers(-(2**31), 2**31, N), "int", "UNCOMPRESSED"),
        (np.full(N, 100.0), "double", "ONE_VALUE"),
        (RNG.choice(RNG.uniform(-999_999, 999_999, 255), N), "double", "DICT"),
        (RNG.uniform(-999_999, 999_999, N), "double", "UNCOMPRESSED"),
        (np.where(RNG.random(N) < 0.99, 5.5, RNG.random(N)), "double", "FREQUENCY"),
        (np.round(RNG.uniform(0, 99_999, N), 2), "double", "PSEUDODECIMAL"),
    ],
)
def test_choice(x, kind, scheme):
    stream, ratio = numbers(x, kind)
    assert stream.names[0] == scheme and ratio >= 0.95


@pytest.mark.parametrize("kind, scheme", [("int", s) for s in INT_SCHEMES if s != "ONE_VALUE"] + [("double", s) for s in DOUBLE_SCHEMES if s != "ONE_VALUE"])
def test_forced(kind, scheme):
    config = Config(overrides={(): scheme})
    if scheme.startswith("TRUNCATION"):
        samples = [RNG.integers(-(10**9), -(10**9) + 200, 999)]
    elif scheme == "PFOR_DELTA":
        samples = [np.sort(RNG.integers(-(10**6), 10**9, 3000))]
    else:
        samples = [np.array(EDGE if kind == "int" else ODD * 30), RNG.integers(0, 50, 3000), np.array([7])]
    for x in samples:
        stream, _ = numbers(x, kind, config=config)
        assert stream.names[0] == scheme
        numbers(x, kind, RNG.random(len(x)) > 0.3, config)
        if kind == "int":
            numbers(x, "long", config=config)


def test_strings():
    words = [RNG.bytes(10) for _ in range(255)]
    assert strings([b"Hello Compression !"] * N).names[0] == "ONE_VALUE"
    assert strings([words[i % 255] for i in range(N)]).names[:2] == ("DICT", "RAW")
    many = [b"%06x" % i for i in RNG.permutation(9000)]
    assert strings([many[i % 9000] for i in range(30_000)]).names[:2] == ("DICT", "FSST")
    assert strings([b"the quick %d brown fox" % i for i in range(3000)]).names[0] == "FSST"
    assert "RLE" in strings([words[i // 50 % 255] for i in range(5000)]).description
    for s in STRING_SCHEMES:
        if s != "ONE_VALUE":
            strings([words[i % 99] for i in range(500)], Config(overrides={(): s}))
    for values in ([], [b""], [b"", b"x" * 9000, b"\xff\x00", "ünï".encode()]):
        strings(values)


@pytest.mark.parametrize("rows", [[0] * 9, [1] * 9, [0, 1] * 50, [1] * 50 + [0] * 50, [0] * 99 + [1], [1, 0]])
def test_null_maps(rows):
    p = np.array(rows, bool)
    kind, data = K.encode_present(p)
    assert (K.decode_present(kind, data, len(p)) == p).all()
    ones = sum(rows)
    assert kind == ("ALLZEROS" if not ones else "ALLONES" if ones == len(p) else "REGULAR" if ones < len(p) // 2 else "FLIPPED")


def test_nulls_in_runs():
    config = Config(overrides={(): "RLE"})
    for x, p in (([0, 0, 7, 7, 3], [0, 0, 1, 1, 1]), ([5, 0, 5, 6], [1, 0, 1, 1]), ([0, 0, 0], [0, 0, 0]), ([0, 0, 0], [0, 1, 1])):
        stream, _ = numbers(np.array(x), "int", np.array(p, bool), config)
    values, lengths = K.decode_runs(numbers(np.array([4, 4, 9]), "int", None, config)[0].data, "int")
    assert values.tolist() == [4, 9] and lengths.tolist() == [2, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**31), 2**31 - 1), st.sampled_from(EDGE)), max_size=300))
def test_any_int(values):
    p = np.array([v is not None for v in values], bool)
    x = np.array([v or 0 for v in values], np.int64)
    numbers(x, "int", p)
    numbers(x, "int", p, Config(try_all=True, enable_for=True).all_schemes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(), st.decimals(-1000, 1000, places=2).map(float)), max_size=300))
def test_any_double(values):
    p = np.array([v is not None for v in values], bool)
    x = np.array([v or 0.0 for v in values], np.float64)
    numbers(x, "double", p)
    numbers(x, "double", p, Config(try_all=True).all_schemes())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=200))
def test_any_string(values):
    strings(values)
    strings(values, Config(overrides={(): "FSST"}))
