"""Text to part files and back; generated columns."""

import pytest
from pyspark.sql import functions as F

from colblocks.config import Config
from colblocks.operators import blocks as B
from colblocks.operators.profile import symbol_table_ratio
from colblocks.plans import convert
from colblocks.plans import encode as E
from colblocks.sources import generators


def test_text_round_trip(spark, tmp_path):
    lines = [f"{i}|{'null' if i % 5 == 0 else i % 3}|{i / 4}|{'' if i % 7 == 0 else 'w%d' % (i % 4)}|x" for i in range(700)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    schema = [("k", "integer"), ("a", "smallint"), ("b", "double"), ("s", "string"), ("skipped", "bigint")]
    out = str(tmp_path / "parts")
    got = convert.csv_to_parts(spark, str(tmp_path / "in.csv"), schema, out, ["k"], config=Config(block_size=128))
    assert set(got["report"]) == {"k", "a", "b", "s", "Total"} and got["stats"]["a"] == (140, 140 + 187)
    assert convert.part_report(spark, out).where("blocks <> 6 OR tuples <> 700").isEmpty()
    convert.parts_to_csv(spark, out, str(tmp_path / "back"))
    rows = spark.read.text(str(tmp_path / "back"))
    assert rows.count() == 700
    short = schema[:4]
    (tmp_path / "short.csv").write_text("".join(x.rpartition("|")[0] + "\n" for x in lines))
    (tmp_path / "other.csv").write_text("".join(x.rpartition("|")[0] + "\n" for x in lines[1:]))
    assert convert.compare_csv(spark, str(tmp_path / "short.csv"), str(tmp_path / "other.csv"), short).collect()[0]["side"] == "left"
    only = convert.table_to_parts(spark.range(300).withColumn("v", F.col("id") * 1.5), str(tmp_path / "p2"), "id", config=Config(block_size=128), only_type="double", block=1)
    assert set(only["report"]) == {"v", "Total"}


@pytest.mark.parametrize("kind, name, scheme", [("int", "ONE_VALUE", "ONE_VALUE"), ("int", "RLE", "RLE"), ("int", "DICTIONARY_8", "DICT"), ("double", "DICTIONARY_8", "DICT"), ("double", "FREQUENCY", "FREQUENCY"), ("double", "RANDOM", "UNCOMPRESSED"), ("string", "ONE_VALUE", "ONE_VALUE"), ("string", "DICTIONARY_16", "DICT")])
def test_generated_columns(spark, kind, name, scheme):
    df = generators.column(spark, kind, name, rows=8000)
    enc = E.encode_blocks(B.with_block(df, 65_536))
    row = enc.head()
    assert row["scheme"] == scheme and row["raw_size"] / row["data_size"] >= 0.95


def test_symbol_ratio(spark):
    df = B.with_block(generators.column(spark, "string", "COMPRESSED_DICTIONARY", rows=3000), 1000)
    assert symbol_table_ratio(df).where("ratio > 0.5").count() == 3
