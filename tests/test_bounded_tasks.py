"""What a task holds depends on fixed counts of rows, not on the size of a table or the number of shuffle partitions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from colblocks.config import Config
from colblocks.operators import blocks as B
from colblocks.operators import select as X
from colblocks.plans import encode as P
from test_queries import SF

#: Tasks for the 6,000 rows of lineitem at 1,024 rows a task.
TASKS = 6


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(B, "LARGE_DEAL", 1024, raising=False)


def tasks(spark, name):
    return entry.queries()[name](spark, SF).rdd.getNumPartitions()


def test_ranges_of_the_order(spark):
    assert B.range_count(spark.range(1 << 27)) == 128
    assert B.range_count(spark.range(1 << 30)) == 256


@pytest.mark.parametrize("name", ["scheme_choice", "scheme_choice_all_schemes", "scheme_costs_double"])
def test_statistics_of_columns(spark, name):
    assert tasks(spark, name) >= TASKS


def test_choice_without_groups(spark):
    rows = [(i // 100, None if i % 9 == 0 else i % 7, float(i % 100 if i < 300 else i), "" if i % 3 else f"text {i % 40}") for i in range(1000)]
    table, kinds = spark.createDataFrame(rows, "block_id long, a int, b double, c string"), {"a": "int", "b": "double", "c": "string"}
    for config in (Config(), Config().all_schemes()):
        got, want = X.choices_of(table, kinds, config), X.choose(X.costs_of(table, kinds, config))
        assert got.columns == want.columns and got.count() == 30 and got.exceptAll(want).isEmpty()


def test_run_packing(spark):
    assert tasks(spark, "run_packing_cost") >= TASKS
    plan = entry.queries()["run_packing_cost"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # of the one pass over the runs


def test_statistics_of_a_number(spark):
    assert tasks(spark, "block_stats_double") >= TASKS


def test_a_column_in_several_ways(spark):
    rows = spark.range(2000).select((F.col("id") / 500).cast("long").alias("block_id"), (F.col("id") % 500).alias("pos"), (F.col("id") % 9).cast("int").alias("v"), F.lit(5).alias("w"))
    of, config = {"DICT": "v", "RLE": "v", "BP": "v", "ONE_VALUE": "w"}, Config(overrides={(s, ()): s for s in ("DICT", "RLE", "BP", "ONE_VALUE")})
    got = P.encode_blocks(rows, config, of=of)
    want = P.encode_blocks(rows.select("block_id", "pos", *[F.col(c).alias(s) for s, c in of.items()]), config)
    assert got.count() == 16 and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("name", ["forced_schemes_int", "scheme_roundtrip_int", "scheme_roundtrip_double", "double_scheme_depths"])
def test_forced_schemes_send_a_column_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_1#" in plan or name == "double_scheme_depths"
    assert "_2#" not in plan  # the third column of the pieces to encode
