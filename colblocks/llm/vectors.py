"""Embedding near-dedup: a robust-pruned graph over overlapping k-means shards, its lists united, range search from medoids in every cell in reach."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .common import Scratch, hot_join
from .components import connected_components


@dataclass(frozen=True)
class GraphOptions:
    """Bounds of the search. ``sample`` vectors or more fit the cells' centroids; everything else covers all vectors."""

    sample: int = 20_000
    shard: int = 1500  # vectors a cell is meant to hold
    largest: int = 20_000  # members, or vectors from elsewhere, in a task; larger cells are cut and their cuts compared pairwise
    books: int = 8192  # most cells; with more vectors the cells grow
    spread: float = 3.0  # how far to the side, in standard deviations, the other end of a link is looked for
    audit: int = 2000
    recall: float = 0.9  # least audited recall; under it all cells that any link can reach are visited, and then compared exactly


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 3, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 1024] @ c.T).argmax(axis=1) for a in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def sure_reach(threshold: float) -> float:
    """No link leads farther across the border of two cells: the sine of the angle that ``threshold`` allows."""
    return math.sqrt(max(0.0, 1 - threshold**2)) if threshold > 0 else 1.0


def likely_reach(threshold: float, length: int, o: GraphOptions) -> float:
    """As far as links go whose ends differ by a random direction, up to ``spread`` standard deviations of its part across the border."""
    sure = sure_reach(threshold)
    return min(sure, o.spread * sure / threshold / math.sqrt(length)) if threshold > 0 else sure


def linked_blocks(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(i, j, from, to): all pairs of rows of ``x`` and ``y`` (unit, double) with cosine at ``threshold`` or more, by ranges of ``x``, in order.

    Single precision decides only what lies farther from the threshold than its error can be; the rest is computed in double.
    """
    error = 1.2e-7 * (x.shape[1] + 4)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    for a in range(0, len(x), 256):
        s = x32[a : a + 256] @ y32.T
        i, j = np.nonzero(s >= threshold - error)
        close = np.flatnonzero(s[i, j] <= threshold + error)
        wrong = [c[np.einsum("pd,pd->p", x[a + i[c]], y[j[c]]) < threshold] for c in (close[b : b + 65536] for b in range(0, len(close), 65536))]
        keep = np.ones(len(i), bool)
        keep[np.concatenate(wrong or [close])] = False
        yield a + i[keep], j[keep], a, min(a + 256, len(x))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit_book(vectors: DataFrame, n: int, o: GraphOptions) -> np.ndarray:
    """Centroids of the cells, so many that a cell holds about ``shard`` vectors."""
    k = max(1, min(o.books, math.ceil(n / o.shard)))
    sample = max(o.sample, 8 * k)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(11), "k1", "k2"), 11) / float(1 << 53)
    rows = vectors.where(u <= min(1.0, sample / max(n, 1))).select("k1", "embedding").limit(2 * sample).toArrow().sort_by("k1")
    if not len(rows):  # a sample of a few vectors may come out empty
        rows = vectors.orderBy("k1", "k2").select("k1", "embedding").limit(k).toArrow()
    return spherical_kmeans(unit(_matrix(rows.column("embedding"))).astype(np.float32), k)


def reached_cells(x: np.ndarray, book: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each vector, the next cell that it reaches (or its home), and whether it lies within ``reach`` of the border of its home and each cell."""
    sims = x @ book.T
    home = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (book[home] @ book.T)))
    near = sims.max(axis=1, keepdims=True) - sims <= reach * apart + 1e-5
    every = np.arange(len(x))
    near[every, home] = False
    others = np.where(near, sims, -np.inf)
    second = np.where(near.any(axis=1), others.argmax(axis=1), home)
    near[every, home] = True
    return home, second, near


def _assigner(book: np.ndarray, reach: float):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                home, second, near = reached_cells(unit(_matrix(pa.chunked_array([part.column("embedding")]))).astype(np.float32), book, reach)
                ends = np.concatenate([[0], near.sum(axis=1).cumsum()]).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(near)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(second.astype(np.int32)), cells], names=["id", "n", "embedding", "home", "second", "cells"])

    return run


def _builder(table: pa.Table) -> pa.Table:
    """The lists of the graph of one shard, by id."""
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    edges = graph.build(unit(_matrix(table.column("embedding"))))
    ends = np.concatenate([[0], (edges >= 0).sum(axis=1).cumsum()]).astype(np.int32)
    return pa.table({"id": ids, "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[edges[edges >= 0]]))})


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values of a column of lists, in order; a null list has none."""
    size = column.combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _counter(threshold: float, exact: bool):
    """Counts the links of a cut of a cell's members among themselves, with another cut, and with vectors of other cells that reach it.

    Each pair counts once for either end: a member counts a foreign vector only if it doesn't reach that one's home, where it would count it.
    A row names, beside the counts, one vector that its own is connected to, so that all that are linked here are connected. Links are found by range search of the graph over the members and the vectors that
    share their shard, or, if ``exact``, by comparing all.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("home", "ascending"), ("id", "ascending")])
        ids, n, home = (table.column(c).to_numpy() for c in ("id", "n", "home"))
        x, cell = unit(_matrix(table.column("embedding"))), table.column("cell")[0].as_py()
        own = (home == cell) & (table.column("cut").to_numpy() == table.column("i")[0].as_py())
        mine, other = np.flatnonzero(own), np.flatnonzero(~own)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        reacher, reaches = _lists(table.column("cells").take(pa.array(mine)))
        others, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        root, label = np.full(len(ids), -1), np.arange(len(mine))

        def add(at: np.ndarray, weight: np.ndarray):
            others[:] += np.bincount(at, weight, minlength=len(ids)).astype(np.int64)
            found[:] += np.bincount(at, minlength=len(ids))

        def connect(i: np.ndarray, j: np.ndarray):
            nonlocal label
            start = np.flatnonzero(np.diff(i, prepend=-1))
            root[i[start]] = mine[j[start]]
            for hits in np.split(j, start[1:]) if len(start) else []:
                roots = np.unique(label[hits])
                if len(roots) > 1:
                    to = np.arange(len(mine))
                    to[roots] = roots[0]
                    label = to[label]

        m = x[mine]
        nodes = mine if exact else np.flatnonzero(own | (table.column("second").to_numpy() == cell))
        number = np.full(len(ids), -1)
        number[mine] = np.arange(len(mine))
        if not exact and len(mine):
            if table.column("whole")[0].as_py():
                edges = graph.restricted(ids[nodes], *_lists(table.column("near").take(pa.array(nodes))))
            else:  # a cut of a crowded cell has few of the united lists' ends
                edges = graph.build(x[nodes])
            starts = graph.medoids(x[nodes].astype(np.float32))

        def linked(queries: np.ndarray):
            if exact:
                yield from linked_blocks(queries, m, threshold)
                return
            for i, j, a, b in graph.range_search(x[nodes], edges, starts, queries, threshold):
                j = number[nodes[j]]
                yield i[j >= 0], j[j >= 0], a, b

        for i, j, _, _ in linked(m) if within and len(mine) else ():
            connect(mine[i], j)
            i, j = i[i != j], j[i != j]
            add(mine[i], n[mine[j]])
        for i, j, a, b in linked(x[other]) if len(mine) and len(other) else ():
            i = other[i]
            connect(i, j)
            add(i, n[mine[j]])
            homes = np.unique(home[other[a:b]])
            mutual = np.zeros((len(mine), len(homes)), bool)
            at = np.minimum(np.searchsorted(homes, reaches), len(homes) - 1)
            same = homes[at] == reaches
            mutual[reacher[same], at[same]] = True
            alone = (home[i] == cell) | ~mutual[j, np.searchsorted(homes, home[i])]
            add(mine[j[alone]], n[i[alone]])
        root[mine] = mine[label]
        some = (found > 0) | (root >= 0) & (root != np.arange(len(ids)))
        return pa.table({"id": ids[some], "others": others[some], "found": found[some], "root": ids[root[some]]})

    return run


def count_links(classes: DataFrame, book: np.ndarray, threshold: float, reach: float, exact: bool, scratch: Scratch, o: GraphOptions) -> DataFrame:
    """(id, others, found, root): links of distinct vectors ``classes(id, n, embedding)`` of one length, several rows to a vector.

    The sums of ``others`` (weighted by n) and ``found`` are a vector's links; the edges from id to root connect what is linked. No pair is
    listed, so a group of any size costs rows for its members and the cells they reach.
    """
    kind = dict(classes.dtypes)["embedding"]
    placed = classes.select("id", "n", "embedding").mapInArrow(_assigner(book, reach), f"id long, n long, embedding {kind}, home int, second int, cells array<int>")
    placed = scratch.stage(placed, "cells")
    member, shared = F.col("home") == F.col("cell"), F.col("second") == F.col("cell")
    sizes = placed.select("home", "second", F.explode("cells").alias("cell"))
    sizes = sizes.groupBy("cell").agg(F.count(F.when(member, 1)).alias("m"), F.count(F.when(~member, 1)).alias("f"), F.count(F.when(member | shared, 1)).alias("s"))
    cuts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / o.largest)).cast("int").alias(c + "_cuts")
    sizes = scratch.stage(sizes.select("cell", cuts("m"), cuts("f"), cuts("s")), "sizes")  # a row per cell, ``books`` at most
    rows = placed.withColumn("near", F.lit(None).cast("array<long>"))
    if not exact:  # each vector stands in the shards of its home and of the next cell in reach; a shard is a cell's, cut by size
        shards = placed.select("id", "embedding", F.explode(F.array_distinct(F.array("home", "second"))).alias("cell")).join(F.broadcast(sizes), "cell")
        shards = shards.select("id", "embedding", "cell", F.pmod(F.xxhash64(F.lit(13), "id"), "s_cuts").alias("cut"))
        lists = shards.groupBy("cell", "cut").applyInArrow(_builder, "id long, near array<long>")
        lists = scratch.stage(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")  # two lists a vector
        rows = placed.join(lists, "id", "left")
    rows = rows.withColumn("cell", F.explode("cells")).withColumn("near", F.when(member | shared, F.col("near")))
    # Task (i, j): cut i of the members with cut j, or with part -j of the others; part 0 goes along with (i, i).
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("cut", F.pmod(F.xxhash64(F.lit(13), "id"), F.when(member, F.col("m_cuts")).otherwise(F.col("f_cuts"))).cast("int"))
    cut, every = F.col("cut"), F.sequence(F.lit(0), F.col("m_cuts") - 1)
    parts = F.filter(F.sequence(F.lit(0), F.col("f_cuts") - 1), lambda k: k > 0)
    task = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    inside = F.concat(F.transform(every, lambda k: task(F.least(cut, k), F.greatest(cut, k))), F.transform(parts, lambda k: task(cut, -k)))
    outside = F.transform(every, lambda k: task(k, F.when(cut == 0, k).otherwise(-cut)))
    rows = rows.select("cell", "cut", "id", "n", "embedding", "home", "second", "near", ((F.col("s_cuts") == 1) & (F.col("m_cuts") == 1)).alias("whole"), F.when(member, F.col("cells")).alias("cells"), F.explode(F.when(member, inside).otherwise(outside)).alias("task"))
    return scratch.stage(rows.select("*", "task.i", "task.j").drop("task").groupBy("cell", "i", "j").applyInArrow(_counter(threshold, exact), "id long, others long, found long, root long"), "found")


def audit_recall(classes: DataFrame, found: DataFrame, n: int, threshold: float, o: GraphOptions) -> float | None:
    """Share of the true links of about ``audit`` vectors, counted by brute force over all, that ``found`` counts; None if they have none.

    Half of the vectors are hash-sampled of all, so that lost links show, and half of those with links, so that there are some to count.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(29), "id"), 11) / float(1 << 53)
    share = lambda rows, m: rows.where(u <= min(1.0, o.audit / 2 / max(m, 1))).select("id").limit(o.audit)
    linked = found.where("found > 0").select("id").distinct()
    wanted = share(classes, n).unionByName(share(linked, linked.count())).distinct()  # 2 * audit ids at most
    probe = classes.select("id", "embedding").join(F.broadcast(wanted), "id", "left_semi").toArrow()
    if not len(probe):
        return None
    ids, p = probe.column("id").to_numpy(), unit(_matrix(probe.column("embedding")))

    def run(batches):
        for batch in batches:
            if len(batch):
                own, true = batch.column("id").to_numpy(), np.zeros(len(ids), np.int64)
                for i, j, _, _ in linked_blocks(unit(_matrix(pa.chunked_array([batch.column("embedding")]))), p, threshold):
                    true += np.bincount(j[own[i] != ids[j]], minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[true > 0]), pa.array(true[true > 0])], names=["id", "true"])

    true = classes.select("id", "embedding").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    got = true.join(found.groupBy("id").agg(F.sum("found").alias("found")), "id", "left")
    total, good = got.agg(F.sum("true"), F.sum(F.coalesce("found", F.lit(0)))).head()
    return good / total if total else None


def near_vectors(vectors: DataFrame, threshold: float = 0.95, options: GraphOptions | None = None) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: (vec_id, n_links, component_id, kept, recall).

    Vectors link if their cosine in double precision is ``threshold`` or more. Null, empty or zero vectors and such with null or
    non-finite components link with nothing, nor do vectors of different lengths. Equal vectors are one node of
    the graph, weighted by their number, so copies cost nothing however many there are. A null vec_id is counted as a link
    but never names a component that has another; rows that share a vec_id are vectors of their own. ``recall`` is the audited share of
    true links between distinct vectors, null where the audit met none; it is the options' ``recall`` at least, or else the search is done again as far as any link can reach, and then by comparing all that is in reach, which misses nothing.
    """
    o = options or GraphOptions()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    # Single precision stays as it is; all else is compared in double.
    e = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    keyed = vectors.select("vec_id", e.alias("embedding"), fine.alias("fine"))
    keyed = keyed.withColumns({"k1": F.when(F.col("fine"), F.xxhash64("embedding")), "k2": F.when(F.col("fine"), F.xxhash64(F.lit(1), "embedding"))})
    classes = keyed.where("fine").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding"))
    classes = scratch.stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # a node's own number, fixed once written
    found, recalls = None, []
    for length, n in sorted(tuple(r) for r in classes.groupBy(F.size("embedding")).count().collect()):
        own = classes.where(F.size("embedding") == length)
        book = fit_book(own, n, o)
        likely, sure = likely_reach(threshold, length, o), sure_reach(threshold)
        for reach, exact in [(r, False) for r in sorted({likely, sure})] + [(sure, True)]:
            part = count_links(own, book, threshold, reach, exact, scratch, o)
            recalls.append(audit_recall(own, part, n, threshold, o))
            if recalls[-1] is None or recalls[-1] >= o.recall:
                break
            scratch.drop(part)
            recall = recalls.pop()
        else:
            raise RuntimeError(f"audited recall {recall} of vectors of length {length} is under {o.recall}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id long, others long, found long, root long")
    degree = found.groupBy("id").agg(F.sum("others").alias("others"))
    links = found.select(F.col("id").alias("a"), F.col("root").alias("b"))
    roots = connected_components(links, scratch).withColumnRenamed("node", "id")
    named = classes.select("id", "k1", "k2", "n", "first").join(degree, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = scratch.stage(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("k1", "k2", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    named = scratch.stage(named, "result")
    total = named.agg(F.sum("n")).head()[0] or 0
    out = hot_join(keyed.drop("embedding"), named, ["k1", "k2"], "n", total, ["links", "component"], ["vec_id"])
    component = F.coalesce("component", "vec_id")
    recall = min((r for r in recalls if r is not None), default=None)
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
