"""Mixing sources to target weights: capped water-filling and seeded repetitions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import with_row_id
from .common import Scratch

#: Bits of a step of the search for the boundary of a source's last, fractional repetition, and steps: 2^24 buckets in all.
STEP_BITS, STEPS = 12, 2


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) by capped water-filling over ``sizes(source, size)``.

    Sources in code-point order, null last, get ``weights`` in turn and share the total of all sizes. Shares over
    ``max_epochs`` times a source's size are clamped there and the excess goes to the others by weight, until none is over.
    The sums of a round are single numbers, so the driver holds no list of sources; a source clamped once stays clamped.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One order over all sources, already summed to a row each: by ranges, since there may be as many as hosts.
    by = with_row_id(by.withColumn("_none", F.col("source").isNull()), "_none", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("row_id", F.lit(len(weights))) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    by = scratch.stage(by.select("source", "source_size", weight.alias("w"), cap.alias("cap")), "sources")
    total, w_all = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("w"), F.lit(0.0))).head()
    # A source is clamped exactly if cap / w <= level; the level only rises from round to round.
    level, clamped = total / w_all if w_all else 0.0, -1
    while True:
        over = F.col("cap") < F.col("w") * F.lit(level)
        n, caps, w_over = by.where(over).agg(F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).head()
        if n == clamped or w_all - w_over <= 0:
            break
        clamped, level = n, (total - caps) / (w_all - w_over)
    return by.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def _marked(docs: DataFrame, size, seed: int) -> DataFrame:
    """_size, the seeded place _u of a document in the order of its source, and the bucket _b of that place."""
    out = docs.withColumns({"_size": size, "_u": F.xxhash64(F.lit(seed), "doc_id", "text")})
    return out.withColumn("_b", F.shiftrightunsigned("_u", 64 - STEP_BITS * STEPS))


def _plan(marked: DataFrame, scratch: Scratch, weights, max_epochs: int) -> DataFrame:
    """Per source: whole repetitions, words of the fractional one, and the bucket in which it ends with the words before."""
    targets = source_targets(marked.select("source", F.col("_size").alias("size")), scratch, weights, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = scratch.stage(targets.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "targets")
    # Bucket by bucket: of a source's 2^STEP_BITS sums the one in which the rest ends, then the same within that bucket.
    rows, at = marked.select("source", "_b", "_size"), targets.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("before"), "rest")
    for step in range(STEPS):
        shift = STEP_BITS * (STEPS - 1 - step)
        own = rows.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_b", shift + STEP_BITS) == F.col("cut")))
        hist = own.groupBy("source", F.shiftright("_b", shift).alias("b"), "before", "rest").agg(F.sum("_size").alias("s"))
        hist = hist.withColumn("ahead", F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy("b")) - F.col("s"))
        ends = (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("s") >= F.col("rest"))
        at = scratch.stage(hist.where(ends).select(F.col("source").alias("_s"), F.col("b").alias("cut"), F.col("ahead").alias("before"), "rest"), f"cut{step}")
    per = targets.join(at.drop("rest"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return scratch.stage(per.select(*[F.col(c).alias(f"_p_{c}") for c in ("source", "source_size", "target", "whole", "rest", "cut", "before")]), "plan")


def _apply(marked: DataFrame, plan: DataFrame) -> DataFrame:
    cols = [c for c in marked.columns if c not in ("_u", "_b")]
    j = marked.join(plan, F.col("source").eqNullSafe(F.col("_p_source")))
    out = [F.col("_p_source_size").alias("_source_size"), F.col("_p_target").alias("_target"), F.col("_p_whole").alias("_whole")]
    at = F.coalesce(F.col("_b") == F.col("_p_cut"), F.lit(False))
    ahead = F.col("_p_before") + F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("_u", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = j.where(at).withColumn("_ahead", ahead)
    edge = edge.select(*cols, *out, F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_p_rest") - F.col("_ahead"))).cast("long").alias("_part"))
    rest = j.where(~at).select(*cols, *out, F.when(F.col("_b") < F.col("_p_cut"), F.col("_size")).otherwise(F.lit(0)).cast("long").alias("_part"))
    return rest.unionByName(edge).withColumn("_taken", F.col("_whole") * F.col("_size") + F.col("_part"))


def mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 17, keep_text: bool = True) -> DataFrame:
    """The columns of ``docs(doc_id, text, source, ...)`` with _size, _source_size, _target, _whole, _part and _taken.

    ``_whole`` repetitions of a document are taken in full; ``_part`` words of one more are, less than all only for the document in
    which the fractional repetition of its source ends. Documents stand in a seeded hash order of (doc_id, text); those
    before the boundary are taken once more. Thus a source's words meet its target to the word, no document exceeds
    ``max_epochs`` times its size, and reruns agree. Null or empty texts have size 0; a null source is a source of its own.
    Rows alike in all columns are interchangeable: which of them the boundary cuts is arbitrary, the set of rows is not.

    The boundary is found by histograms of hash buckets per source (combined before their shuffle), in two steps down to one of
    2^24 buckets; only the documents of that bucket are put in order. Columns of ``docs`` named like the working columns, which
    begin with an underscore, are an error. Texts are never shuffled. The plan has a row per source; Spark checks
    its size before it broadcasts it and else splits hot sources.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    marked = _marked(docs, n_words(), seed)
    slim = scratch.stage(marked.drop(*[c for c in docs.columns if c not in ("doc_id", "source")]), "sizes")
    plan = _plan(slim, scratch, weights, max_epochs)
    return _apply(marked if keep_text else slim, plan)


def repetitions(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken; a fractional repetition ends with its last word."""
    columns = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_whole", "_part", "_taken")]
    whole = F.col("_whole").cast("int") + F.when((F.col("_part") == F.col("_size")) & (F.col("_part") > 0), 1).otherwise(0)
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    copies = F.when(cut, F.concat(F.array_repeat(F.lit(False), whole), F.array(F.lit(True)))).otherwise(F.array_repeat(F.lit(False), whole))
    out = mixed.withColumn("_cut", F.explode(copies))
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_cut"), F.array_join(F.slice(words, F.lit(1), F.col("_part").cast("int")), "")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs, keep_text=False)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))
