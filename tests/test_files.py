"""Part files under filters, packing, the encoder's estimates, numbering, symbol tables, windowed statistics."""

import math
import pickle
import random

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from colblocks.config import SCHEMES, WIDTH, Config
from colblocks.operators import blocks as B
from colblocks.operators import codec as K
from colblocks.operators import packing
from colblocks.plans import encode as P
from colblocks.sources import objectscan, parts
from colblocks.streaming.encode import windowed_stats


def test_bounds_lose_nothing():
    """Whatever a block holds, a filter that one of its values meets leaves the block alive."""
    rng = random.Random(1)
    pools = {"double": [math.nan, -0.0, 0.0, 1.5, -2.0, math.inf, -math.inf, 3.25], "long": [2**53 + 1, 2**53, -(2**62), 0, 7, -1]}
    # NaN equals itself and is above all numbers.
    key = lambda x: (1, 0.0) if x != x else (0, x)
    ops = {"EqualTo": lambda a, b: key(a) == key(b), "GreaterThan": lambda a, b: key(a) > key(b), "GreaterThanOrEqual": lambda a, b: key(a) >= key(b), "LessThan": lambda a, b: key(a) < key(b), "LessThanOrEqual": lambda a, b: key(a) <= key(b)}
    pruned = 0
    for _ in range(3000):
        kind = rng.choice(["double", "long"])
        values = [rng.choice(pools[kind]) for _ in range(rng.randint(0, 3))]
        stored = np.array([*values, 0], np.float64 if kind == "double" else np.int64)
        present = np.array([True] * len(values) + [False])
        c = dict(zip(("lo", "hi", "ilo", "ihi", "nan"), P.bounds(stored, present, kind))) | {"type": kind, "present": len(values)}
        op, v = rng.choice(list(ops)), rng.choice(pools[kind])
        alive = parts.may_hold(c, op, v)
        assert alive or not any(ops[op](x, v) for x in values), (values, op, v)
        pruned += not alive
    assert pruned > 500


def test_modules_travel_by_value():
    for f in (parts._writer("/x"), parts.unchunk, parts.chunk, objectscan._fetch("/x", 1), P._encoder({"a": "int"}, Config())):
        pickle.loads(cloudpickle.dumps(f))


def test_pack_parts_is_greedy(spark):
    rng = random.Random(2)
    rows = [(c, i, rng.randint(1, 60)) for c in "ab" for i in range(300)]
    want = {}
    for c in "ab":
        part, fill = 0, 0
        for _, i, n in (r for r in rows if r[0] == c):
            part, fill = (part, fill + n) if fill + n <= 100 else (part + 1, n)
            want[c, i] = part
    got = packing.pack_parts(spark.createDataFrame(rows, "column string, block_id long, size long"), 100).collect()
    assert {(r["column"], r["block_id"]): r["part"] for r in got} == want


def test_numbering_over_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), F.lit("x").alias("v"))
    own = B.Numbered(df, "k", partitions=7)
    assert len(own.before) > 1 and own.rows().where("k <> row_id").isEmpty() and own.rows().count() == 3000
    assert sorted((r["row_id"], r["k"]) for r in own.lookup(0, 1500, 2999, 5000, -1).collect()) == [(0, 0), (1500, 1500), (2999, 2999)]
    assert B.Numbered(df.limit(0), "k").rows().count() == 0
    stretches = B.random_ranges(own.rows(), 3, 100).groupBy("stretch").count().collect()
    assert all(0 < r["count"] <= 100 for r in stretches)


def test_sampled_choice(spark):
    """The chosen scheme is the one whose sample, encoded by force, is smallest for its size; ties go to the higher code."""
    rng = np.random.default_rng(5)
    config = Config()
    for kind, x in (("int", np.repeat(rng.integers(0, 1000, 300), 20)), ("int", rng.integers(0, 1 << 20, 6000)), ("double", np.round(rng.random(6000) * 100, 2)), ("double", rng.normal(size=6000))):
        x = x.astype(np.float64 if kind == "double" else np.int64)
        present = np.ones(len(x), bool)
        encoder = K.Encoder(config)
        got = encoder.estimates(x, present, kind)
        sx, sp = encoder._sample(x, present)
        assert len(sx) == 640
        for scheme, ratio in got.items():
            if scheme in K.SAMPLED:
                body = getattr(encoder, f"_{scheme.lower()}")(sx, sp, kind, 3, True, ())[0]
                assert ratio == len(sx) * WIDTH[kind] / max(len(body), 1)
        best = max(got, key=lambda s: (got[s], SCHEMES[kind][s]))
        stream = encoder.numbers(x, present, kind)
        assert stream.names[0] in (best, "UNCOMPRESSED")
        assert (K.decode_numbers(stream.data, kind) == x).all()


def test_symbol_table_of_a_stream():
    words = [f"prefix-{i % 50}-suffix".encode() for i in range(4000)]
    stream = K.Encoder(Config(overrides={(): "FSST"})).strings(words, np.ones(len(words), bool))
    symbols, before, after = K.symbol_table(stream.data)
    assert 0 < len(symbols) <= 255 and before == sum(map(len, words)) and after < before / 2 and K.decode_strings(stream.data) == words
    assert K.symbol_table(K.Encoder().strings([b"a", b"b"], np.ones(2, bool)).data) is None


@pytest.mark.parametrize("table", [[], [b"ab", b"\xff", b"\xff\xff"]])
def test_escaped_bytes(table):
    rng = random.Random(4)
    for _ in range(200):
        data = bytes(rng.choice([255, 97, 98, 0]) for _ in range(rng.randint(0, 40)))
        assert K.expand_symbols(K.compress_symbols(data, table), table) == data


def test_windowed_stats(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("t"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    windowed_stats(stream, "t", "v").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    got = {r["window"]["start"].minute + 60 * r["window"]["start"].hour: (r["n"], r["nulls"], r["vmin"], r["vmax"]) for r in spark.table("windowed").collect()}
    assert got == {0: (60, 12, 1, 59), 60: (60, 12, 61, 119), 120: (60, 12, 121, 179), 180: (20, 4, 181, 199)}
