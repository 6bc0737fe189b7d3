"""Each operator against a plain version on the smallest tables, and on a table of edge cases."""

import base64
import collections
import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colblocks.llm import components, graph, langid, licenses, line_dedup, mixing, pieces, quality, queries, simhash, substrings, vectors, warc
from colblocks.llm.common import Scratch, hot_join

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
LINE = "This line stands in many documents, word for word"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, LINE + "\nown line of four\nx", "en", "a"),
    (5, "  " + LINE.upper() + "\r\nown line of five\n" + LINE, "en", None),
    (6, LINE, "en", "b"),
    (7, "12345 67890 !!!", "en", "b"),
    (8, LONG, "en", "z"),
    (9, LONG + " end", "de", "é"),
    (10, "日本語 のテキスト 🎉 CC BY and General  Public-License; all\nrights reserved", "ja", "日本"),
    (11, "same text twice over here now", "en", "a"),
    (12, "same text twice over here now", "en", "a"),
    (12, "same text twice over here now", "en", "a"),
    (13, "a b c d e a b c d e a b c d e", "en", "c"),
    (None, LINE + "\nno id", "en", "a"),
    (14, "ab" * 100, "en", "a"),
    (15, "x" + "ab" * 60, "en", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    # Extra columns with names that operators use within.
    return df.withColumns({c: F.lit(1) for c in ("keeper", "n", "fp", "h1", "part", "size", "whole", "root", "pos", "cell", "component_id", "score", "html")})


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def keyed(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- plain versions ------------------------------------------------------------------------------------------------------


def plain_lines(rows):
    key = lambda x: x.strip(BLANKS).translate(UPPER)
    holders, best = collections.Counter(), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k] += 1
            best[k] = max(best.get(k, -1), -1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and holders[key(x)] >= 3 and best[key(x)] != (-1 if d is None else d) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(ids, linked):
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def plain_repeats(rows):
    first = {}
    rank = lambda d: -1 if d is None else d
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in sorted(data, key=lambda r: rank(r[0])):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], rank(d))
    out = []
    for d, b in data:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < rank(d):
                cover[p : p + 50] = True
        spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(b) else 0
        out.append((d, len(b), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()))
    return out


def plain_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


# ---- operators -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 3])
def test_lines(spark, edge, batches):
    got = sorted((repr((r["doc_id"], r["_n_lines"], r["_n_dropped"], r["_kept"])) for r in line_dedup.dedup_lines(edge, batches=batches, fanout=2).collect()))
    assert got == sorted(map(repr, plain_lines([(r[0], r[1]) for r in EDGE])))


def test_line_index_compacts(spark):
    index = line_dedup.LineIndex(spark, Scratch(spark, "t"), fanout=2)
    for b in range(5):
        index.add(spark.range(b, b + 3).selectExpr("id AS h1", "id AS h2", "1L AS n", f"{10 - b}L AS keeper"))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    assert {(r["h1"], r["n"], r["keeper"]) for r in index.keys().collect()} == {(i, sum(b <= i < b + 3 for b in range(5)), 10 - max(0, i - 2)) for i in range(7)}
    assert sum(r.where("keeper IS NOT NULL").count() for r in index._runs()) == 7  # only a key's first batch may name its keeper
    assert sum(r.where("is_new").count() for r in index._runs()) == 7
    index.close()


def test_simhash(spark, edge):
    got = simhash.simhash_components(edge).collect()
    fps = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got}
    assert fps == {d: plain_fingerprint(t) for d, t, *_ in EDGE}
    ids = sorted(d for d in fps if d is not None)
    want = plain_components(ids, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want and len(got) == len(EDGE)


@pytest.mark.parametrize("crowd", [1, 3, 32])
def test_fingerprint_links(spark, crowd):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(4):
            b ^= 1 << int(rng.integers(64))
            b ^= 1 << int(rng.integers(64)) if rng.random() < 0.7 else 0
            fps.add(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    scratch = Scratch(spark, "t")
    edges = simhash.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), scratch, crowd)
    roots = {r["node"]: r["root"] for r in components.connected_components(edges, scratch).collect()}
    own = sorted(map(signed, fps))
    want = plain_components(own, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    groups = lambda m: {frozenset(x for x in own if m.get(x, x) == r) for r in {m.get(x, x) for x in own}}
    assert groups(roots) == groups(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[200] == got[201] and 300 not in got
    assert len(set(got.values())) == 3


def test_hot_join(spark):
    left = spark.range(9000).selectExpr("id", "IF(id % 3 = 0, 7, id) AS k")
    right = left.groupBy("k").count().withColumn("x", F.col("k") * 2)
    out = hot_join(left, right.where("k <> 8"), ["k"], "count", 9000, ["x"], ["id"])
    assert out.count() == 9000 and out.where("k <> 8 AND NOT x <=> k * 2").isEmpty() and out.where("k = 8 AND x IS NULL").count() == 1


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.05
    x[200:220] = x[5]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None]), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("cell", F.lit(1))
    for options in (vectors.GraphOptions(shard=150), vectors.GraphOptions(shard=60, books=4, largest=100)):
        got = {r["vec_id"]: r for r in vectors.near_vectors(df, 0.95, options).collect()}
        u = x.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        links = (u @ u.T >= 0.95).sum(axis=1) - 1
        mine = np.array([got[i]["n_links"] for i in range(400)])
        assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum()
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904))
        assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905 and got[150]["component_id"] == 0


def true_links(rows, threshold=0.95):
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T >= threshold


def plain_groups(linked):
    return plain_components(list(range(len(linked))), lambda a, b: linked[a, b])


def test_vectors_dense_group(spark):
    """A group over many cells: all of its links count, and no pair is listed."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 64))
    x[:400] = x[0]
    x[:400, :4] += rng.normal(size=(400, 4)) * 0.5
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95, vectors.GraphOptions(shard=30)).collect()}
    linked = true_links(rows)
    want = linked.sum(axis=1) - 1
    mine = np.array([got[i]["n_links"] for i in range(len(x))])
    assert want.sum() > 50_000 and (mine <= want).all() and mine.sum() >= 0.99 * want.sum()
    assert {i: got[i]["component_id"] for i in got} == plain_groups(linked)


@pytest.mark.parametrize("books", [1, 3])
def test_vectors_crowded_cell(spark, books):
    """Pairs and small groups in crowded cells: cuts lose none of them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x[300:600] = x[:300] + rng.normal(size=(300, 32)) * 0.1
    x[600:650] = x[:50] + rng.normal(size=(50, 32)) * 0.1
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    options = vectors.GraphOptions(shard=900 // books, books=books, largest=70)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95, options).collect()}
    linked = true_links(rows)
    assert linked.sum() > len(x) + 600 and [got[i]["n_links"] for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
    assert {i: got[i]["component_id"] for i in got} == plain_groups(linked)


@pytest.mark.parametrize("options", [{"shard": 4, "books": 3}, {"shard": 4}, {"shard": 10, "spread": 0.0}])
def test_vectors_recall(spark, options):
    """Links over the borders of many small cells; what the first reach misses the audit brings back."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(30, 8)), 40, axis=0) + rng.normal(size=(1200, 8)) * 0.25
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95, vectors.GraphOptions(**options)).collect()}
    want = true_links(rows).sum(axis=1) - 1
    mine = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (mine <= want).all() and mine.sum() >= 0.9 * want.sum() and got[0]["recall"] >= 0.9


def test_vectors_double_and_repeated_ids(spark):
    """Doubles stay doubles, large ones don't overflow, and rows that share a vec_id are vectors of their own."""
    a, c = np.array([1.0, 0.0]), 0.95
    at = lambda cos: [cos, float(np.sqrt(1 - cos * cos))]
    rows = [(1, a.tolist()), (2, at(c + 1e-12)), (3, at(-0.5)), (4, (np.array(at(-0.5)) * 1e250).tolist()), (5, [1e-250, -2e-250]), (6, [1.0, -2.0]), (7, at(-0.9))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
    twice = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.001]), (7, [0.001, 1.0])]
    got = vectors.near_vectors(spark.createDataFrame(twice, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]
    assert vectors.near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")).head()["recall"] is None


def test_graph_recall():
    """Range search of the graph: clusters, pairs among noise, one cone; nothing under the threshold."""
    rng = np.random.default_rng(11)
    noise = lambda n: vectors.unit(rng.normal(size=(n, 64)))
    clusters = vectors.unit(noise(80)[rng.integers(80, size=1200)] + noise(1200) * 0.22)
    pairs = np.concatenate([noise(400)] * 2)
    pairs = vectors.unit(pairs + noise(800) * 0.2)
    cone = vectors.unit(noise(1) + noise(900) * rng.uniform(0, 0.4, size=(900, 1)))
    for x in (clusters, pairs, cone):
        edges, starts = graph.build(x), graph.medoids(x.astype(np.float32))
        assert ((edges >= -1) & (edges < len(x))).all() and (edges != np.arange(len(x))[:, None]).all()
        got = np.concatenate([np.stack([i, j], axis=1) for i, j, _, _ in graph.range_search(x, edges, starts, x, 0.95)])
        true = x @ x.T >= 0.95
        assert true[got[:, 0], got[:, 1]].all() and len(np.unique(got, axis=0)) == len(got)
        assert len(got) - len(x) >= 0.98 * (true.sum() - len(x))
    assert graph.range_search(x[:1], graph.build(x[:1]), np.array([0]), x[:1], 0.95).__next__()[1].tolist() == [0]


def test_vectors_reach():
    """The sure reach covers every link, from either end."""
    rng = np.random.default_rng(10)
    for d in (2, 5, 12):
        x = vectors.unit(rng.normal(size=(600, d)))
        home, _, near = vectors.reached_cells(x.astype(np.float32), vectors.spherical_kmeans(x.astype(np.float32), 40), vectors.sure_reach(0.9))
        i, j = np.nonzero(x @ x.T >= 0.9)
        assert near[i, home[j]].all()


def test_licenses(spark, edge, docs):
    scanner = licenses.Scanner()
    for t in [r[1] for r in docs] + [r[1] for r in EDGE]:
        got = scanner.scan(t)
        assert tuple(got[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_licenses(t)
        assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(","))
    got = scanner.scan("Foo. Licensd under the Apache-License,\nversion 2.0! bar")
    assert got["labels"] == "apache-2.0" and 0.9 < got["score"] < 1 and got["n_base"] == 0
    s = got["spans"][0]
    assert (s["first_word"], s["last_word"], s["edits"]) == (1, 8, 1) and (s["start"], s["end"]) == (5, 50)
    assert licenses.scan_licenses(edge).count() == len(EDGE)


def least_edits(pattern, text):
    """Edits of the best place of a pattern in a text, by dynamic programming."""
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        step = row[:-1] + np.array([t != c for t in text])
        for j in range(1, len(text) + 1):
            new[j] = min(step[j - 1], row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def test_fuzzy_loses_nothing():
    rng = np.random.default_rng(0)
    for text, label in (licenses.NOTICES[1], licenses.NOTICES[8], licenses.NOTICES[17]):
        scanner, k = licenses.Scanner([(text, label)]), licenses.edits_of(text)
        for _ in range(60):
            places, planted = [], 0
            for _ in range(int(rng.integers(1, 4))):
                s = list(text)
                for _ in range(rng.integers(0, k + 2)):
                    i = int(rng.integers(len(s)))
                    s[i : i + int(rng.integers(2))] = ["q"] * int(rng.integers(2))
                places.append("".join(s))
                planted += least_edits(text, places[-1]) <= k
            norm = " " + " zz ".join(places) + " "
            got = scanner.fuzzy(norm)
            assert len(got) >= planted and bool(got) == (least_edits(text, norm) <= k)
            assert all(least_edits(text, norm[a:b]) <= e <= k for _, a, b, e in got)
            assert min((e for *_, e in got), default=None) in (None, least_edits(text, norm))


def test_licenses_close_together_and_long():
    scanner = licenses.Scanner()
    got = scanner.scan("Mozila public license mozilla public license mozilla publc license")
    assert [(s["label"], s["edits"]) for s in got["spans"]] == [("mpl", 1), ("mpl", 0), ("mpl", 1)]
    assert scanner.scan("GNU General Public License, version 3")["labels"] == "gpl,gpl-3.0"
    started = time.time()
    got = scanner.scan("Licensed under the Apach License, Version 2.0. " * 5000 + "cc by " * 5000)
    assert len(got["spans"]) == 10_000 and got["n_base"] == 5000 and time.time() - started < 20


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "one"), (6, "u", "one"), (None, "u", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("keeper", F.lit(1))
    for least in (0, 5):
        manifest, root = warc.write_warc(pages, Scratch(spark, "t"), least, bundle_bytes=1000, frame_bytes=500)
        got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in warc.read_warc(manifest, root).collect())
        want = collections.Counter()
        for p, _, h in rows:
            b = (h or "").encode()
            best = max((q for q, _, g in rows if (g or "") == (h or "") and q is not None), default=None)
            back = len(b) >= least and best != p
            want[(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if back else "response", best if back else None, None if back else (h or ""))] += 1
        assert got == want
        for r in manifest.collect():
            head, block = next(warc.parse(warc.read_record(root, r["bundle"], r["frame"], r["offset"], r["length"])))
            assert head["WARC-Record-ID"] == f"<{r['record_id']}>"
        assert manifest.select("record_id").distinct().count() == len(rows)
    assert warc.read_warc(*warc.write_warc(pages.limit(0), Scratch(spark, "t"))).count() == 0


def test_langid(spark, edge, docs):
    got = {r["doc_id"]: r for r in langid.op6(spark, SF).collect()}
    right = [got[d]["lang_pred"] == lang for d, t, lang, _ in docs if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, *_ in docs)
    assert np.mean(right) >= 0.95 and not any(r["rejected"] for r in got.values())
    out = {r["doc_id"]: r for r in langid.identify(edge).collect()}
    assert all(out[d]["_lang_pred"] == "und" and out[d]["_score"] == 0 and out[d]["_rejected"] for d in (1, 2, 3, 7))
    assert all(0 <= r["_score"] <= 1 for r in out.values())
    assert langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).where("_lang_pred <> 'und'").isEmpty()
    far = langid.identify(spark.createDataFrame([(1, "zzqx " * 400)], "doc_id long, text string"), spark.read.parquet(f"{SF}/documents.parquet")).head()
    assert far["_rejected"]


def test_langid_brute_force(spark, docs):
    """Every prediction and score from n-grams counted in plain Python and cosines in double precision."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table.where(~langid.held_out_rule()))
    got = keyed(langid.op6(spark, SF))

    def counts(text):
        raw, out = f" {text.lower()} ".encode(), np.zeros(langid.DIMS)
        line = [raw[0]] if not (0x61 <= raw[0] < 0x7B or raw[0] >= 0x80) else [raw[0]]
        for before, b in zip(raw, raw[1:]):
            letter, was = (0x61 <= b < 0x7B or b >= 0x80), (0x61 <= before < 0x7B or before >= 0x80)
            if letter or was:
                line.append(b if letter else 32)
        mod = 1 << 32
        pair = lambda i: (line[i] * 0x9E3779B1 + line[i + 1] * 0x85EBCA77) % mod
        place = lambda c: ((c ^ (c >> 15)) * 0x2C1B3C6D % mod) >> 20
        for i in range(len(line) - 1):
            out[place(pair(i))] += 1
        for i in range(len(line) - 2):
            out[place((pair(i) + line[i + 2] * 0xC2B2AE3D) % mod)] += 1
        return out

    for d, t, *_ in docs:
        if t is None or not any(c.isalpha() for c in t):
            assert got[d]["lang_pred"] == "und"
            continue
        v = np.log1p(counts(t)) * model.idf.astype(float)
        cos = model.centroids.astype(float) @ v / np.linalg.norm(v)
        best = cos.max()
        assert abs(got[d]["score"] - min(1.0, max(0.0, best))) < 1e-4
        assert got[d]["lang_pred"] in {model.langs[model.lang_of[i]] for i in np.flatnonzero(cos > best - 1e-5)}


@pytest.mark.parametrize("part_bytes, cuts", [(300, 4096), (300, 3), (1 << 20, 4096)])
def test_repeats(spark, edge, part_bytes, cuts):
    rows = [(d, None if t is None else t[:3000]) for d, t, *_ in EDGE]
    df = edge.withColumn("text", F.substring("text", 1, 3000))
    got = [tuple(r) for r in substrings.remove_repeats(df, part_bytes, 200, cuts, keep_bytes=False).drop("kept").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_repeats(rows)))


def test_repeats_hot_passage(spark, monkeypatch):
    """The windows around a passage that most documents share, under one key but unlike, are split over buckets."""
    monkeypatch.setattr(substrings, "HOT_RUNS", 4)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 9))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, " ".join(word() for _ in range(8)) + passage + (" ".join(word() for _ in range(8)) if i % 3 else rows_end) if i % 7 else word() * 30) for i in range(90) for rows_end in ["the same end of every third of these texts, and a long one"]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part_bytes in (500, 5000):
        assert sorted(tuple(r) for r in substrings.remove_repeats(df, part_bytes, 400, keep_bytes=False).drop("kept").collect()) == sorted(plain_repeats(rows))


def test_repeats_in_places(spark, monkeypatch):
    """A bucket sorted in many small chunks, with keys split over the places of all buckets, gives the same."""
    monkeypatch.setattr(substrings, "CHUNK", 20)
    monkeypatch.setattr(substrings, "HOT_RUNS", 3)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdef"), 7)) for _ in range(60)]
    rows = [(int(i), " ".join(rng.choice(words, 6)) + " ".join(words[i % 5 : i % 5 + 12]) + " ".join(rng.choice(words, 4))) for i in rng.permutation(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part_bytes, bucket_bytes in ((700, 1 << 20), (700, 3000), (1 << 20, 1 << 20)):
        assert sorted(tuple(r) for r in substrings.remove_repeats(df, part_bytes, bucket_bytes, keep_bytes=False).drop("kept").collect()) == sorted(plain_repeats(rows))


def test_chunks():
    place, windows = np.array([3, 0, 3, 1, 0, 7], np.uint8), np.array([5, 9, 1, 4, 2, 8])
    for size in (1, 6, 12, 100):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(substrings, "CHUNK", size)
            got = substrings.chunks(place, windows)
        assert sorted(np.concatenate(got).tolist()) == list(range(6))
        assert sum(len(set(place[c])) for c in got) == 4  # no place in two chunks
        assert size > 1 or len(got) == 4


def test_repeats_letters_in_proportion(spark, monkeypatch):
    """On 2 GB of texts, which are only measured here: a part writes each bucket a letter, and these must stay few for each GB."""
    seen = []
    monkeypatch.setattr(substrings, "_offer", lambda bits: seen.append(bits) or (lambda table: table))
    docs = spark.range(2048, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr("repeat('some text of a page\n', 52429)").alias("text"))
    substrings.remove_repeats(docs)
    assert (2 << 30) / (3 << 20) * 2 ** seen[0] < 200_000 * 2


def test_part_numbers():
    first, pieces = substrings.part_numbers([3, 3, 3, 3, 25, 0, 4, 10, 1], 10)
    assert (first, pieces) == ([0, 0, 0, 1, 2, 5, 5, 6, 7], [1, 1, 1, 1, 3, 1, 1, 1, 1])


def test_deep_shallow_sort():
    rng = np.random.default_rng(1)
    data = np.concatenate([np.tile(rng.integers(97, 99, 300), 3), rng.integers(97, 98, 200)]).astype(np.uint8)
    data = np.concatenate([data, np.zeros(60, np.uint8)])
    starts = np.arange(len(data) - 60)
    order, group = substrings.deep_shallow_sort(data, starts)
    text = [bytes(data[s : s + 50]) for s in starts[order]]
    assert text == sorted(text)
    assert all((a == b) == (g == h) for a, b, g, h in zip(text, text[1:], group, group[1:]))


def test_pieces(spark, edge, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{quality.TOKENIZERS}/{quality.VOCABULARY}")
    v = pieces.Vocabulary(f"{quality.TOKENIZERS}/{quality.VOCABULARY}")
    texts = [r[1] for r in docs[:60]] + ["  a", "a  b\n\n c ", "日本語 🎉🎉", "\x00a", "a▁b", "tab\there\r\n", "x" * 3000, "\n", " \n ", "a" + " " * 50 + "b", "", None]
    flat, n = pieces.Encoder(v).encode(texts)
    got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [sp.encode(t or "") for t in texts]
    assert pieces.decode_ids(flat, n, v) == [sp.decode(x) if x else "" for x in got]
    out = pieces.encode(edge).collect()
    assert len(out) == len(EDGE) and all(r["_round_trip"] for r in out) and all(r["_ids"] == sp.encode(r["text"] or "") for r in out)


def test_long_words():
    """Words beyond the rounds, and beyond a stretch of the index, get the public library's ids in near-linear time."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{quality.TOKENIZERS}/{quality.VOCABULARY}")
    v, rng = pieces.Vocabulary(f"{quality.TOKENIZERS}/{quality.VOCABULARY}"), np.random.default_rng(4)
    made = lambda n, letters: "".join(rng.choice(list(letters), n))
    for text in [made(n, "aeioutnsr") for n in (63, 64, 65, 66, 700)] + ["the" * 400, "é" * 300 + "漢字" * 90, made(20_000, "abcdefghijklmnop0123")]:
        assert pieces.Encoder(v).encode([text])[0].tolist() == sp.encode(text)
    codes = v.codes(np.frombuffer("overlapping stretches of an index".encode("utf-32-le"), np.uint32).astype(np.int64))
    whole, cut = pieces.Edges(codes, v), pieces.Edges(codes, v, stretch=7)
    assert (whole.keys == cut.keys).all() and (whole.pieces == cut.pieces).all()
    started = time.time()
    pieces.Encoder(v).encode([made(300_000, "abcdefghijklmnopqrstuvwxyz0123456789+/")])
    assert time.time() - started < 20


def test_mixing(spark, edge):
    for df in (edge, spark.read.parquet(f"{SF}/documents.parquet")):
        a, b = [sorted(mixing.mix(df).select("doc_id", "source", "_size", "_source_size", "_target", "_taken").collect(), key=repr) for _ in range(2)]
        assert a == b and len(a) == df.count()
        sums = collections.defaultdict(lambda: [0, 0, 0])
        for r in a:
            assert r["_taken"] <= 3 * r["_size"]
            sums[r["source"]][0] += r["_size"]
            sums[r["source"]][1] += r["_taken"]
            assert r["_source_size"] > 0 or r["_taken"] == 0
            sums[r["source"]][2] = r["_target"]
        # The same water-filling, clamped source by source.
        names, total = sorted(sums, key=lambda s: (s is None, (s or "").encode())), sum(s[0] for s in sums.values())
        weight, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
        while True:
            free = [s for s in names if s not in fixed]
            level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
            over = [s for s in free if weight[s] * level > 3 * sums[s][0]]
            if not over:
                break
            fixed |= {s: 3 * sums[s][0] for s in over}
        for s in names:
            want = fixed.get(s, weight[s] * level)
            assert abs(sums[s][2] - want) < 1e-6 and abs(sums[s][1] - want) <= 1
        words = mixing.repetitions(mixing.mix(df)).select(F.sum(mixing.n_words())).head()[0]
        assert words == sum(r["_taken"] for r in a)


def test_quality(spark, edge, docs):
    got = keyed(quality.op10(spark, SF))
    for d, t, *_ in docs:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(t)
        assert not (r["kept"] and r["base_failed"])
    out = quality.quality(edge).collect()
    assert len(out) == len(EDGE)
    for r in out:
        t = next(t for d, t, *_ in EDGE if d == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(t)


def test_quality_brute_force(spark, docs):
    """Token measures, quartiles, bands and the verdict from a plain tokenisation of every text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{quality.TOKENIZERS}/{quality.VOCABULARY}")
    got, again = keyed(quality.op10(spark, SF)), keyed(quality.op10(spark, SF))
    assert {d: tuple(r) for d, r in got.items()} == {d: tuple(r) for d, r in again.items()}
    own = {}
    for d, t, *_ in docs:
        tokens = [i for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for i in sp.encode(w)]
        if tokens:
            p = np.array(list(collections.Counter(tokens).values())) / len(tokens)
            own[d] = (len(tokens), sum(c not in BLANKS for c in t) / len(tokens), sum(map(sp.is_byte, tokens)) / len(tokens), float(-(p * np.log2(p)).sum()))
        r = got[d]
        assert r["n_tokens"] == (own[d][0] if d in own else 0)
        if d in own:
            assert np.allclose([r["chars_per_token"], r["byte_share"], r["entropy"]], own[d][1:])
    edges = {}
    for script in {r["script"] for r in got.values()}:
        rows = [own[d] for d, r in got.items() if r["script"] == script and d in own and own[d][0] >= 50]
        for i, (m, w) in enumerate(quality.MEASURES.items()):
            steps = sorted(int(np.floor(r[i + 1] / w + 1e-9)) for r in rows)
            if steps:
                q1, q3 = (steps[-(-len(steps) * q // 4) - 1] * w for q in (1, 3))
                edges[script, m] = q1 - 4 * (q3 - q1), q3 + max(0.05 if m == "byte_share" else 0, 4 * (q3 - q1))
    for d, r in got.items():
        off = d in own and own[d][0] >= 50 and any(own[d][i + 1] > edges[r["script"], m][1] or (m != "byte_share" and own[d][i + 1] < edges[r["script"], m][0]) for i, m in enumerate(quality.MEASURES))
        assert r["kept"] == (not r["base_failed"] and not off)


def test_simhash_and_repeats_whole_table(spark, docs):
    got = keyed(simhash.op2(spark, SF))
    fps = {d: plain_fingerprint(t) for d, t, *_ in docs}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == fps
    assert {d: r["component_id"] for d, r in got.items()} == plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert sorted(tuple(r) for r in substrings.op7(spark, SF).collect()) == sorted(plain_repeats([(d, t) for d, t, *_ in docs]))


def test_repeat_words():
    rng = np.random.default_rng(4)
    for base in (2, 5, 1 << 20):
        ids = rng.integers(0, base, 200)
        ids[100:110] = ids[20:30]
        windows = collections.Counter(tuple(ids[i : i + 5]) for i in range(196))
        cover = {i + j for i in range(196) if windows[tuple(ids[i : i + 5])] > 1 for j in range(5)}
        assert quality.repeat_words(ids) == len(cover)


def test_empty_tables(spark, edge):
    none = edge.limit(0)
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for f in (line_dedup.dedup_lines, simhash.simhash_components, licenses.scan_licenses, langid.identify, substrings.remove_repeats, pieces.encode, mixing.mix, quality.quality):
        assert f(none).count() == 0
    assert vectors.near_vectors(vec).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLE[name]).to_arrow_table()
    rows = lambda t: sorted(repr(tuple(r[c] for c in sorted(t.column_names))) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)
