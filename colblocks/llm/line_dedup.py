"""Line dedup: levelled sorted runs of line hashes, compacted periodically (DataFrame functions only)."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ascii_lower, hot_join

#: Bytes of keys that a level's worth of batches take before there are more.
BATCH_BYTES = 16 << 20


class LineIndex:
    """An LSM-like index of line keys: runs bucketed and sorted by (h1, h2) on levels 0, 1, ....

    A run row is (h1, h2, n, keeper, is_new). ``add`` merge-joins a batch with the keys of all runs: a key that no run holds (the
    anti-join) enters with its keeper, a key seen before only leaves a row with its count. So each key has a keeper in one
    row of one run, that of its first batch. When a level holds ``fanout`` runs they are merged into one of the next level. Runs and
    batches are bucketed alike, so a join moves no run again.
    """

    SCHEMA = "h1 long, h2 long, n long, keeper long, is_new boolean"

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 4):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        name, path = f"colblocks_run_{uuid.uuid4().hex[:16]}", self.scratch.path(f"level{level}")
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n, keeper), one row a key; batches come in the order in which they may name keepers."""
        out = batch.withColumn("is_new", F.lit(True))
        for run in self._runs():
            seen = run.where("is_new").select("h1", "h2", F.lit(True).alias("_seen"))
            out = out.join(seen.hint("merge"), ["h1", "h2"], "left").withColumn("is_new", F.col("is_new") & F.col("_seen").isNull()).drop("_seen")
        self._write(out.withColumn("keeper", F.when(F.col("is_new"), F.col("keeper"))), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._write(self._merged(old), level + 1)
        for name, path in old:
            self._forget(name, path)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes a union of bucketed scans for bucketed though their partitions stay apart.
        both = self.spark.read.schema(self.SCHEMA).parquet(*[path for _, path in runs])
        return both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("keeper").alias("keeper"), F.max("is_new").alias("is_new"))  # one keeper a key: the others are null

    def _forget(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        gone = type("Staged", (), {"_scratch_path": path})
        self.scratch.drop(gone)

    def keys(self) -> DataFrame:
        """(h1, h2, n, keeper): documents of all batches, and the keeper that the first batch with the key named."""
        return self._merged([run for level in self.levels for run in level]).select("h1", "h2", "n", "keeper")

    def close(self) -> None:
        for level in self.levels:
            for name, path in level:
                self._forget(name, path)
        self.levels = []


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def batch_count(size: int, fanout: int) -> int:
    """Batches for ``size`` bytes of keys: a level's worth, and one more for each doubling beyond BATCH_BYTES. Each batch reads all runs before it."""
    return fanout + max(0, math.ceil(math.log2(max(1, size) / BATCH_BYTES)))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """All columns of ``docs`` with (_n_lines, _n_dropped, _kept): lines that ``min_docs`` documents or more hold stay in one.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased; keys under ``min_chars`` code points
    are left alone. Of the others, a key found in ``min_docs`` documents loses all its lines but those of the largest doc_id.
    Null and empty texts have one empty line and are kept as ''. A null doc_id ranks below all others. Rows that repeat a
    doc_id count as documents of their own; all that carry the largest one keep the line. Columns named like the working
    columns are carried through untouched, as long as they don't begin with an underscore.

    The keys (128 bits of XXH64 each) are computed once and written; documents enter the index in batches (``batch_count`` by
    default) from the largest doc_id down, so the anti-join's first sight of a key names its keeper. Hot keys are joined by broadcast (at most HEAVY_PARTS of them).
    The text is shuffled once, to meet the positions of its dropped lines.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k")))
    lines = F.transform(F.filter(lines, lambda x: F.length(x["k"]) >= min_chars), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(1), x["k"]).alias("h2")))
    hashed = scratch.stage(docs.select("doc_id", F.xxhash64(text).alias("th"), lines.alias("lines")).where(F.size("lines") > 0), "hashed")

    pairs = hashed.select("doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("h")).select("doc_id", "h.*")
    if batches is None:
        batches = batch_count(16 * (hashed.agg(F.sum(F.size("lines"))).head()[0] or 0), fanout)
    cuts = hashed.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).head()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    batch = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        batch = F.when(F.col("doc_id") > cuts[i], F.lit(i)).otherwise(batch)
    runs = scratch.path("batches")
    pairs.groupBy(batch.alias("batch"), "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).write.partitionBy("batch").parquet(runs)
    schema = "h1 long, h2 long, n long, keeper long, batch int"
    index = LineIndex(spark, scratch, fanout)
    for b in range(len(cuts) + 1):
        index.add(spark.read.schema(schema).parquet(runs).where(F.col("batch") == b).drop("batch"))
    hot = scratch.stage(index.keys().where(F.col("n") >= min_docs), "hot")
    index.close()

    total = hot.agg(F.sum("n")).head()[0] or 0
    placed = hashed.select("doc_id", "th", F.explode("lines").alias("l")).select("doc_id", "th", "l.*")
    placed = hot_join(placed, hot.withColumn("found", F.lit(True)), ["h1", "h2"], "n", total, ["keeper", "found"], ["doc_id", "pos"])
    drops = placed.where(F.col("found") & ~F.col("keeper").eqNullSafe(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_drop"))
    out = docs.withColumn("_t", text)
    out = out.join(drops, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("_t") == F.col("_th")), "left")
    split = F.split("_t", "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(F.array_join(F.transform(rest, lambda i: F.get(F.col("_lines"), i)), "\n"))
    out = out.withColumn("_lines", split).select(*docs.columns, F.size("_lines").cast("long").alias("_n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"), kept.alias("_kept"))
    return out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), h AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.doc_id, k.pos, k.line, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS dropped FROM k LEFT JOIN h ON k.key = h.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
