"""Queries on values that the given tables hold only at size, each against its SQL twin."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from colblocks.operators import schemes as E
from test_queries import rows


@pytest.fixture(scope="module")
def customers(tmp_path_factory):
    """Balances among which a rounded one is -0.0, as round(-0.004, 2) is."""
    folder = tmp_path_factory.mktemp("odd")
    balance = [-0.0, 0.0, 7.0, 1023.0, -3.25, 9999.99, 0.1, -0.0] + [i / 100 for i in range(600)]
    n = len(balance)
    table = {"c_custkey": pa.array(range(n), pa.int64()), "c_name": [f"Customer#{i:09}" for i in range(n)], "c_nationkey": pa.array([i % 25 for i in range(n)], pa.int32()), "c_acctbal": balance, "c_mktsegment": ["BUILDING"] * n}
    pq.write_table(pa.table(table), f"{folder}/customer.parquet")
    return str(folder)


def check(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet'")
    got, want = entry.queries()[name](spark, folder).toArrow(), con.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert rows(got, sorted(want.column_names)) == rows(want, sorted(want.column_names))


def test_negative_zero_max_exponent(spark, customers):
    check(spark, customers, "max_exponent_roundtrip")
    b = spark.createDataFrame([(0, 0, -0.0), (0, 1, 0.0), (0, 2, -1.5), (0, 3, None)], "block_id long, pos long, v double")
    enc = E.max_exponent_encode(b, E.max_exponent(b.withColumn("v", F.abs("v"))))
    assert [str(r["value"]) for r in E.max_exponent_decode(enc).orderBy("pos").collect()] == ["-0.0", "0.0", "-1.5", "0.0"]


def test_negative_zero_and_null_exponents(spark, customers, tmp_path):
    check(spark, customers, "pseudodecimal_exponents_balance")
    table = pq.read_table(f"{customers}/customer.parquet").slice(0, 6)
    some = pa.array([-0.0, None, 0.25, -1.0, float("nan"), 3e9])
    pq.write_table(table.set_column(3, "c_acctbal", some), f"{tmp_path}/customer.parquet")
    check(spark, str(tmp_path), "pseudodecimal_exponents_balance")
    b = spark.createDataFrame([(0, 0, -0.0), (0, 1, 0.0), (0, 2, -1.5), (0, 3, None), (0, 4, 0.25)], "block_id long, pos long, v double")
    enc = E.pseudodecimal_encode(b)
    assert [str(r["value"]) for r in E.pseudodecimal_decode(enc).orderBy("pos").collect()] == ["-0.0", "0.0", "-1.5", "0.0", "0.25"]
    assert [tuple(r) for r in E.exception_groups(enc).collect()] == [(0, 1)]


def test_negative_zero_signs(spark, customers):
    check(spark, customers, "scalar_signs")
