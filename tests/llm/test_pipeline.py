"""Each stage of the pipeline against a plain version of its decisions on its own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_operators import EDGE, plain_components, plain_lines

import corpus_pipeline as P
from colblocks.llm import common
from colblocks.llm.shingles import near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["small", "edge"])
def docs(request, spark):
    if request.param == "small":
        return spark.read.parquet(f"{SF}/documents.parquet")
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumn("keeper", F.lit(1)).withColumn("component_id", F.lit("x"))


def plain_shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def rows(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, docs, tmp_path):
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, before, SF)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, out)
        before = out
    a, b = seen["language_id"]
    assert set(rows(a)) - set(rows(b)) <= {k for k in rows(a) if not any(c.isalpha() for c in k[1] or "")}
    a, b = seen["line_dedup"]
    assert rows(b) == collections.Counter((d, kept) for d, _, _, kept in plain_lines(list(rows(a).elements())))
    a, b = seen["simhash"]
    own = list(rows(a).elements())
    sets = [plain_shingles(t) for _, t in own]
    groups = plain_components(list(range(len(own))), lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    least = collections.defaultdict(list)
    for i, root in groups.items():
        least[root].append(own[i][0])
    assert sorted(map(repr, (d for d, _ in rows(b).elements()))) == sorted(repr(min((x for x in g if x is not None), default=None)) for g in least.values())
    a, b = seen["mixing"]
    words = lambda t: len((t or "").encode().split())
    assert abs(sum(words(t) for _, t in rows(b).elements()) - sum(words(t) for _, t in rows(a).elements())) <= len({r["source"] for r in a.collect()})
    a, b = seen["pieces"]
    assert b.count() == a.count() and b.where("NOT round_trip").isEmpty()


def test_run(spark):
    assert P.run(spark, SF).count() > 100


def test_empty(spark, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies(spark, monkeypatch):
    """Copies with a few changed words don't survive the stages of near-duplicates; documents below 0.8 do."""
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    for i, w in enumerate(texts):
        for step, changes in ((100, 1), (200, 2), (300, 6)):  # similarities of about 0.92, 0.84 and 0.59
            copy = list(w)
            for k in range(changes):
                copy[10 + 18 * k] = f"new{i}"
            rows.append((step + i, " ".join(copy)))
    rows += [(400, None), (401, ""), (402, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr("colblocks.llm.shingles.LARGEST", 2)
    df = dict(P.STAGES)["simhash"](spark, df, SF)
    assert sorted(r["doc_id"] for r in df.collect()) == [*range(40), *range(300, 340), 400, 401, 402]
    assert len(P.STAGES) == 5


def test_texts_stay(spark, tmp_path):
    """Near-duplicates shuffle the texts of groups, not all texts, where nothing is small enough to broadcast."""
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(1500)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i] + " end") for i in range(6)] + [(2000, texts[0]), (None, texts[1]), (None, "one text"), (None, "another")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")

    def stages():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        out = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {out.apply(i).stageId(): out.apply(i).shuffleWriteBytes() for i in range(out.size())}

    last, threshold = max(stages()), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_duplicates(spark.read.parquet(f"{tmp_path}/docs")).select("doc_id", "component_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    of = {i: i for i in range(300)} | {1000 + i: i for i in range(6)} | {2000: 0}
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [*of.items(), (None, 1), (None, None), (None, None)]))
    assert sum(n for stage, n in stages().items() if stage > last) < 0.3 * sum(len(t) for _, t in rows)


def test_maybe_among(spark):
    """No key is missed, with nulls too, and most others are told apart; a bitmap too small tells fewer apart and misses none."""
    rows = spark.range(20_000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), (F.col("id") * 3).alias("j"), F.lit("wide").alias("text"))
    keys = rows.where("j % 100 = 0 OR k IS NULL").select("k", "j")
    for bits in (26, 12):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "MAP_BITS", bits)
            m.setattr(common, "PAGE_BITS", min(15, bits))
            marked = common.maybe_among(rows, keys, ["k", "j"])
            assert marked.columns == ["k", "j", "text", "_maybe"]
            assert marked.where("_maybe AND (j % 100 = 0 OR k IS NULL)").count() == keys.count() == 201
            assert marked.where("_maybe").count() < 201 + 20_000 / (8 if bits == 26 else 2) and marked.count() == 20_000
    assert common.maybe_among(rows, keys.limit(0), ["k", "j"]).where("_maybe").isEmpty()
