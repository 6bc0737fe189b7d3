"""Encoding a table end to end: blocks, part files, the data source, raw columns, CSV, streams."""

import random

import pytest
from pyspark.sql import functions as F

from colblocks.config import Config
from colblocks.operators import blocks as B
from colblocks.operators import compare as C
from colblocks.plans import encode as P
from colblocks.sources import csvio, parts, rawcolumns
from colblocks.streaming.encode import encode_stream

SMALL = Config(block_size=256)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice([None, 5, 5, 5, -7]), rng.choice([None, 1.25, -0.5, round(rng.random() * 1000, 2)]), rng.choice([None, "", "a", "b" * 9000 if i == 77 else "ünï"]), None if i < 600 else 3, i % 7 == 0)
        for i in range(1000)
    ]
    return spark.createDataFrame(rows, "k long, a int, b double, c string, d int, skipped boolean")


def test_encode_decode(spark, table):
    enc = P.encode(table, "k", config=SMALL)
    kinds = P.column_kinds(table)
    assert kinds == {"k": "long", "a": "int", "b": "double", "c": "string", "d": "int"}
    got = P.decode(enc, kinds, SMALL.block_size)
    C.verify(got, B.with_row_id(table.drop("skipped"), "k"))
    assert enc.where("column = 'd'").orderBy("block_id").select("nullmap_type", "scheme").first() == ("ALLZEROS", "ONE_VALUE")
    assert {r["column"] for r in P.report(enc).collect()} == set(kinds)
    assert P.describe(enc).agg(F.sum("tuples")).head()[0] == 5000
    assert P.decode_speed(enc).where("column = 'Total'").count() == 1
    assert P.decision_log(enc).count() == 20


def test_overrides_and_all_schemes(spark, table):
    forced = Config(block_size=256, overrides={("a", ()): "RLE", ("b", ()): "DICT"})
    enc = P.encode(table.select("k", "a", "b"), "k", config=forced)
    assert {tuple(r) for r in enc.where("column <> 'k'").select("column", "scheme").distinct().collect()} == {("a", "RLE"), ("b", "DICT")}
    C.verify(P.decode(enc, {"k": "long", "a": "int", "b": "double"}, 256), B.with_row_id(table.select("k", "a", "b"), "k"))
    tried = P.encode(table.drop("skipped"), "k", config=Config(block_size=256, try_all=True).all_schemes())
    C.verify(P.decode(tried, P.column_kinds(table), 256), B.with_row_id(table.drop("skipped"), "k"))


def test_part_files_and_source(spark, table, tmp_path):
    path, config = str(tmp_path / "parts"), Config(block_size=256, part_bytes=6000)
    enc = P.encode(table.drop("c"), "k", config=config).cache()
    parts.write_parts(enc, path, config)
    meta = parts.read_metadata(path)
    assert meta["num_chunks"] == 4 and [c["column"] for c in meta["columns"]] == ["k", "a", "b", "d"]
    parts.register(spark)
    df = spark.read.format("colblocks").load(path)
    C.verify(df, B.with_row_id(table.drop("c", "skipped"), "k"))
    assert spark.read.format("colblocks").option("columns", "b").load(path).columns == ["row_id", "b"]
    assert spark.read.format("colblocks").option("type", "int").load(path).columns == ["row_id", "a", "d"]
    some = df.where("k > 700")
    assert some.count() == 299
    reader = parts.BlocksReader(path, df.schema, 0)
    list(reader.pushFilters([parts.GreaterThan(("k",), 700)]))
    assert [p.blocks for p in reader.partitions()] == [[2, 3]]
    one = parts.PartReader(f"{path}/column00000_part00000")
    assert one.column(0).to_pylist()[:3] == [0, 1, 2] and one.frame(0)[:3] == ("long", "ALLONES", 256)
    with pytest.raises(Exception, match="larger than a part"):
        parts.write_parts(enc, str(tmp_path / "p2"), Config(block_size=256, part_bytes=10))


def test_raw_columns(spark, table, tmp_path):
    rows, path = B.with_row_id(table.drop("skipped"), "k"), str(tmp_path / "raw")
    assert rawcolumns.write_columns(rows, path, 300).agg(F.sum("n")).head()[0] == 1000
    schema = list(P.column_kinds(table).items())
    C.verify(rawcolumns.read_columns(spark, path, schema, 300), rows)
    assert rawcolumns.read_columns(spark, path, schema, 300, only_type="double").columns == ["row_id", "b"]


def test_csv(spark, tmp_path):
    text = "null|null|null|x\n|||y\n 7 | 7 | 7 |z\n0|0|0|w\n"
    (tmp_path / "t.csv").write_text(text)
    schema = csvio.parse_schema("columns:\n  - {name: i, type: integer}\n  - name: d\n    type: float\n  - name: s\n    type: string\n  - name: t\n    type: bigint\n")
    assert schema == [("i", "integer"), ("d", "float"), ("s", "string"), ("t", "bigint")]
    df = csvio.read_csv(spark, str(tmp_path / "t.csv"), schema)
    assert [tuple(r) for r in df.collect()] == [(None, None, None), (None, None, ""), (7, 7.0, " 7 "), (0, 0.0, "0")]
    assert {tuple(r) for r in csvio.table_stats(df).collect()} == {("i", 2, 3), ("d", 2, 3), ("s", 1, 1)}
    assert csvio.read_csv(spark, str(tmp_path / "t.csv"), schema, only_type="string").columns == ["s"]
    (tmp_path / "bad.csv").write_text("1|2\n")
    with pytest.raises(Exception):
        csvio.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()
    (tmp_path / "bad2.csv").write_text("1x|2|a|b\n")
    with pytest.raises(Exception, match="bad value"):
        csvio.read_csv(spark, str(tmp_path / "bad2.csv"), schema).collect()
    csvio.write_csv(df.withColumn("row_id", F.monotonically_increasing_id()), str(tmp_path / "out"), ["row_id"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == sorted(["null|null|null", "null|null|", "7|7.0| 7 ", "0|0.0|0"])
    assert csvio.schema_of_ddl('CREATE TABLE t ("a" varchar(10), b decimal(3, 2) NOT NULL, c bigint, d date)') == [("a", "string"), ("b", "double"), ("c", "bigint"), ("d", "skip")]
    assert csvio.name_and_type("/x/3_price.double") == ("price", "double")
    assert spark.createDataFrame([("12abc",), ("3.7",), ("",)], "x string").select(csvio.parse_int(F.col("x"), prefix=True)).collect()[0][0] == 12


def test_row_ids_in_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 50).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("x"), "id")
    got = B.with_row_id(df, "g", "x", "id", partitions=13).orderBy("g", "x", "id").select("row_id").collect()
    assert [r[0] for r in got] == list(range(5000))


def test_blocks_and_samples(spark):
    b = B.with_block(spark.range(5000).withColumn("row_id", F.col("id")), 1000)
    assert B.ranges(2500, 1000) == [(0, 1000), (1000, 1000), (2000, 500)]
    assert B.take_blocks(b, 2).count() == 2000 and B.take_blocks(b, 2, random=True).select("block_id").distinct().count() == 2
    s = B.sample_blocks(b, Config(sample_runs=5, sample_run_length=10))
    assert s.count() == 250 and s.groupBy("block_id").count().where("count <> 50").isEmpty()
    assert B.sampled(b, 10, 100).count() == 5000
    assert B.random_range(b, 100).count() <= 100


def test_stream(spark, table, tmp_path):
    table.drop("skipped").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.drop("skipped").schema).parquet(str(tmp_path / "in"))
    encode_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "k", config=SMALL).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("tuple_count")).head()[0] == 5000


def test_config():
    with pytest.raises(ValueError):
        Config().disable("int", "ONE_VALUE")
    with pytest.raises(ValueError):
        Config().enable("int", "NONE")
    assert "FOR" in Config().enable("int", "FOR").int_schemes and Config().configure(block_size=5).block_size == 5
