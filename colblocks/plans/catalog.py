"""All queries of the encoding engine, each with its SQL twin for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar as S
from ..operators import blocks as B
from ..operators import compare as C
from ..operators import packing as P
from ..operators import profile as R
from ..operators import schemes as E
from ..operators import select as X
from ..operators import stats as A
from ..scratch import Scratch
from ..sources import csvio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Total orders of the tables (l_orderkey and l_linenumber don't make one).
ORDER = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "documents": ["doc_id"],
}
BLOCK = {"lineitem": 4096, "orders": 1024, "events": 1024, "customer": 512, "part": 512, "documents": 256}
CONFIG = Config()
WIDE = Config().all_schemes()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_NUMBERED: dict[tuple, B.Numbered] = {}


def numbered(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None, order: list[str] | None = None) -> B.Numbered:
    """The block table of a table: put in order and written once a session and state of its file, then read by every query over it."""
    path, order = f"{sf_dir}/{table}.parquet", order or ORDER[table]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = store.getFileStatus(place).getModificationTime(), store.getContentSummary(place).getLength()
    key = (spark.sparkContext.applicationId, path, *state, tuple(columns or ()), tuple(order))
    if key not in _NUMBERED:
        df = spark.read.parquet(path)
        _NUMBERED[key] = B.Numbered(df.select(*columns) if columns else df, *order)
    return _NUMBERED[key]


def block_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return B.with_block(numbered(spark, sf_dir, table).rows(), BLOCK[table])


def cut(spark: SparkSession, sf_dir: str, table: str, **columns: str | Column) -> DataFrame:
    """Blocks of a table with the named expressions; the scan of the block table reads their columns only."""
    return block_table(spark, sf_dir, table).select("row_id", "block_id", "pos", *[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in columns.items()])


def dealt(spark: SparkSession, sf_dir: str, table: str, **columns: str | Column) -> DataFrame:
    """What ``cut`` gives, dealt out by block."""
    return B.dealt(cut(spark, sf_dir, table, **columns), numbered(spark, sf_dir, table).n)


def cut_sql(table: str, name: str = "b", **columns: str) -> str:
    exprs = "".join(f", {e} AS {n}" for n, e in columns.items())
    inner = f"SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER[table])}) - 1 AS row_id FROM {table}"
    return f"{name} AS (SELECT row_id, row_id // {BLOCK[table]} AS block_id, row_id % {BLOCK[table]} AS pos{exprs} FROM ({inner}))"


NULLED = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"
#: Runs and order of a block, nulls passed over; needs b(block_id, pos, v).
MARKS = """m AS (SELECT *, v IS NOT NULL AND pos > 0 AND v <> coalesce(last_value(v IGNORE NULLS) OVER w, {zero}) AS chg,
  v IS NOT NULL AND pos > 0 AND v < coalesce(last_value(v IGNORE NULLS) OVER w, {zero}) AS down
  FROM b WINDOW w AS (PARTITION BY block_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


# ---- statistics of blocks ----------------------------------------------------------------------------------------------


def _number_stats(name: str, table: str, expr: str, zero: str) -> None:
    sql = f"""WITH {cut_sql(table, v=expr)}, {MARKS.format(zero=zero)}
    SELECT block_id, count(*) AS n, count(*) - count(v) AS nulls, count(DISTINCT coalesce(v, {zero})) AS uniq, min(coalesce(v, {zero})) AS vmin, max(coalesce(v, {zero})) AS vmax,
      1 + count_if(chg)::BIGINT AS runs, count(*) // (1 + count_if(chg)::BIGINT) AS avg_run, count_if(down) = 0 AS sorted FROM m GROUP BY block_id"""
    query(name, sql)(lambda spark, d: A.number_stats(dealt(spark, d, table, v=expr), zero=0.0 if "." in zero else 0))


_number_stats("block_stats_int", "lineitem", "l_linenumber", "0")
_number_stats("block_stats_long", "lineitem", "l_orderkey", "0")
_number_stats("block_stats_double", "lineitem", "l_quantity", "0.0::DOUBLE")
_number_stats("block_stats_nullable", "events", NULLED, "0.0::DOUBLE")


def _string_stats(name: str, table: str, expr: str) -> None:
    sql = f"""WITH {cut_sql(table, v=expr)}, u AS (SELECT block_id, coalesce(v, '') AS x, count(*) AS c, count(*) - count(v) AS z FROM b GROUP BY ALL)
    SELECT block_id, sum(c)::BIGINT AS n, sum(z)::BIGINT AS nulls, count(*) AS uniq, sum(c * strlen(x))::BIGINT AS total_length, sum(strlen(x))::BIGINT AS total_unique_length,
      (4 * (sum(c) + 1) + sum(c * strlen(x)))::BIGINT AS total_size FROM u GROUP BY block_id"""
    query(name, sql)(lambda spark, d: A.string_stats(cut(spark, d, table, v=expr)))


_string_stats("block_stats_string", "orders", "o_orderpriority")
_string_stats("block_stats_string_nullable", "events", "nullif(event_type, 'error')")
_string_stats("block_stats_text", "documents", "text")

VARIED = "CASE WHEN event_id < 1024 THEN value WHEN event_id < 2048 THEN NULL WHEN event_id % 7 = 0 AND event_id % 2048 < 1024 THEN value WHEN event_id % 2048 >= 1024 AND event_id % 5 > 0 THEN value END"


@query("null_map_types", f"""WITH {cut_sql('events', v=VARIED)}, k AS (SELECT block_id, count(*) AS n, count(v) AS ones FROM b GROUP BY block_id)
SELECT block_id, n, ones, CASE WHEN ones = 0 THEN 'ALLZEROS' WHEN ones = n THEN 'ALLONES' WHEN ones < n // 2 THEN 'REGULAR' ELSE 'FLIPPED' END AS type,
  CASE WHEN ones = 0 OR ones = n THEN 0 WHEN ones < n // 2 THEN ones ELSE n - ones END AS positions FROM k""")
def null_map_types(spark, d):
    return A.null_maps(cut(spark, d, "events", v=VARIED))


@query("null_map_roundtrip", f"WITH {cut_sql('events', v=VARIED)} SELECT block_id, pos, v IS NOT NULL AS present FROM b")
def null_map_roundtrip(spark, d):
    b = cut(spark, d, "events", v=VARIED)
    return A.null_map_decode(b, A.null_maps(b), A.null_map_positions(b))


@query("value_histogram", f"WITH {cut_sql('lineitem', v='l_linenumber')} SELECT block_id, v AS value, count(*) AS cnt FROM b GROUP BY ALL")
def value_histogram(spark, d):
    return A.histogram(cut(spark, d, "lineitem", v="l_linenumber"))


# ---- schemes -----------------------------------------------------------------------------------------------------------


@query("one_value_blocks", """WITH b AS (SELECT (row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1) // 1024 AS block_id, o_orderstatus AS v FROM orders)
SELECT block_id, min(v) AS value, count(*) AS n FROM b GROUP BY block_id HAVING count(DISTINCT v) = 1""")
def one_value_blocks(spark, d):
    b = B.with_block(numbered(spark, d, "orders", ["o_orderstatus", "o_orderkey"], ["o_orderstatus", "o_orderkey"]).rows(), 1024)
    return E.one_value_encode(b.withColumn("v", F.col("o_orderstatus")), "")


@query("one_value_decode", """WITH b AS (SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS r, o_orderstatus AS v FROM orders)
SELECT r // 1024 AS block_id, r % 1024 AS pos, v AS value FROM b QUALIFY min(v) OVER (PARTITION BY r // 1024) = max(v) OVER (PARTITION BY r // 1024)""")
def one_value_decode(spark, d):
    return E.one_value_decode(one_value_blocks(spark, d))


def _dictionaries(kind: str, table: str, column: str, zero) -> None:
    b = cut_sql(table, v=column)
    query(f"dict_encode_{kind}", f"WITH {b} SELECT row_id, block_id, pos, dense_rank() OVER (PARTITION BY block_id ORDER BY v) - 1 AS code FROM b")(lambda spark, d: E.dict_encode(cut(spark, d, table, v=column), zero, "row_id"))
    query(f"dict_entries_{kind}", f"WITH {b}, u AS (SELECT DISTINCT block_id, v FROM b) SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY v) - 1 AS code, v AS value FROM u")(lambda spark, d: E.dict_entries(cut(spark, d, table, v=column), zero))

    def roundtrip(spark, d):
        rows = cut(spark, d, table, v=column)
        return E.mismatches(E.dict_decode(E.dict_encode(rows, zero), E.dict_entries(rows, zero)), rows)

    query(f"dict_roundtrip_{kind}", f"SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM {table}")(roundtrip)


_dictionaries("int", "lineitem", "l_linenumber", 0)
_dictionaries("double", "lineitem", "l_discount", 0.0)
_dictionaries("string", "orders", "o_orderpriority", "")


@query("fixed_dict_fits", f"WITH {cut_sql('lineitem', v='l_suppkey')} SELECT block_id, count(DISTINCT v) <= 256 AS fits8, count(DISTINCT v) <= 65536 AS fits16 FROM b GROUP BY block_id")
def fixed_dict_fits(spark, d):
    b = cut(spark, d, "lineitem", v="l_suppkey")
    return E.fixed_dict_fits(b, 0, 8).withColumnRenamed("fits", "fits8").join(E.fixed_dict_fits(b, 0, 16).withColumnRenamed("fits", "fits16"), "block_id")


RUNS = f"WITH {cut_sql('lineitem', v='l_orderkey')}, {MARKS.format(zero='0')}, r AS (SELECT *, sum(chg::INT) OVER (PARTITION BY block_id ORDER BY pos)::BIGINT AS run_id FROM m)"


@query("rle_encode", RUNS + " SELECT block_id, run_id, max(v) AS value, count(*) AS cnt, min(pos) AS start FROM r GROUP BY block_id, run_id")
def rle_encode(spark, d):
    return E.rle_encode(dealt(spark, d, "lineitem", v="l_orderkey"), 0)


RUNS_NULL = f"WITH {cut_sql('events', v=NULLED.replace('value', '(user_id % 5)'))}, {MARKS.format(zero='0')}, r AS (SELECT *, sum(chg::INT) OVER (PARTITION BY block_id ORDER BY pos)::BIGINT AS run_id FROM m)"


@query("rle_encode_nullable", RUNS_NULL + " SELECT block_id, run_id, coalesce(max(v), 0) AS value, count(*) AS cnt, min(pos) AS start FROM r GROUP BY block_id, run_id")
def rle_encode_nullable(spark, d):
    return E.rle_encode(cut(spark, d, "events", v=NULLED.replace("value", "(user_id % 5)")), 0)


@query("rle_decode", f"WITH {cut_sql('lineitem', v='l_orderkey')} SELECT block_id, pos, v AS value FROM b")
def rle_decode(spark, d):
    return E.rle_decode(rle_encode(spark, d))


@query("rle_agg_without_decode", f"WITH {cut_sql('lineitem', v='l_orderkey')} SELECT block_id, sum(v)::BIGINT AS total, count(*) AS n FROM b GROUP BY block_id")
def rle_agg_without_decode(spark, d):
    return E.rle_sum(rle_encode(spark, d))


@query("for_encode", f"WITH {cut_sql('part', v='p_size')}, r AS (SELECT *, min(v) OVER (PARTITION BY block_id)::BIGINT AS base FROM b) SELECT row_id, block_id, pos, base, v - base AS residual, max(v - base) OVER (PARTITION BY block_id) <= 255 AS fits8, max(v - base) OVER (PARTITION BY block_id) <= 65535 AS fits16 FROM r")
def for_encode(spark, d):
    return E.for_encode(cut(spark, d, "part", v="p_size"), "row_id")


@query("truncation_encode", f"WITH {cut_sql('lineitem', v='l_suppkey')}, r AS (SELECT *, min(v) OVER (PARTITION BY block_id) AS base FROM b) SELECT row_id, block_id, pos, base, v - base AS residual, max(v - base) OVER (PARTITION BY block_id) <= 255 AS fits8, max(v - base) OVER (PARTITION BY block_id) <= 65535 AS fits16 FROM r")
def truncation_encode(spark, d):
    return E.for_encode(cut(spark, d, "lineitem", v="l_suppkey"), "row_id")


@query("for_decode", f"WITH {cut_sql('part', v='p_size')} SELECT row_id, v::BIGINT AS value FROM b")
def for_decode(spark, d):
    return E.for_decode(for_encode(spark, d)).select("row_id", "value")


@query("delta_encode", f"WITH {cut_sql('orders', v='o_orderkey')} SELECT row_id, block_id, pos, v - coalesce(lag(v) OVER (PARTITION BY block_id ORDER BY pos), 0) AS delta FROM b")
def delta_encode(spark, d):
    return E.delta_encode(cut(spark, d, "orders", v="o_orderkey"), "row_id")


@query("delta_decode", f"WITH {cut_sql('orders', v='o_orderkey')} SELECT row_id, v AS value FROM b")
def delta_decode(spark, d):
    return E.delta_decode(delta_encode(spark, d)).select("row_id", "value")


@query("bitpack_cost", f"WITH {cut_sql('lineitem', v='l_linenumber')}, m AS (SELECT block_id, pos // 32 AS m, max(CASE WHEN v < 0 THEN 32 WHEN v = 0 THEN 1 ELSE length(bin(v)) END) AS b FROM b GROUP BY ALL) SELECT block_id, sum(b * 32)::BIGINT AS bits_total, sum(b * 4 + 1)::BIGINT AS bytes FROM m GROUP BY block_id")
def bitpack_cost(spark, d):
    return E.bitpack_cost(cut(spark, d, "lineitem", v="l_linenumber"))


def _frequency(kind: str, table: str, expr: str, zero) -> None:
    b = cut_sql(table, v=expr)
    z = "0.0::DOUBLE" if isinstance(zero, float) else "0"
    tops = f"""c AS (SELECT block_id, coalesce(v, {z}) AS x, count(*) AS n, count(v) AS p FROM b GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY n DESC, x) AS r, sum(n) OVER (PARTITION BY block_id) AS nn, sum(p) OVER (PARTITION BY block_id) AS pp, sum(CASE WHEN x = {z} THEN p ELSE 0 END) OVER (PARTITION BY block_id) AS zp FROM c),
    t AS (SELECT block_id, CASE WHEN nn - pp >= 0.9 * nn THEN {z} ELSE x END AS top, (pp - CASE WHEN nn - pp >= 0.9 * nn THEN zp ELSE p END)::BIGINT AS exceptions FROM k WHERE r = 1)"""
    query(f"frequency_tops_{kind}", f"WITH {b}, {tops} SELECT * FROM t")(lambda spark, d: E.frequency_tops(cut(spark, d, table, v=expr), zero))
    query(f"frequency_encode_{kind}", f"WITH {b}, {tops} SELECT block_id, pos, v AS value FROM b JOIN t USING (block_id) WHERE v <> top")(lambda spark, d: E.frequency_encode(r := cut(spark, d, table, v=expr), E.frequency_tops(r, zero)))

    def roundtrip(spark, d):
        rows = cut(spark, d, table, v=expr)
        t = E.frequency_tops(rows, zero)
        return E.mismatches(E.frequency_decode(rows.select("block_id", "pos"), t, E.frequency_encode(rows, t)), rows)

    query(f"frequency_roundtrip_{kind}", f"SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM {table}")(roundtrip)


_frequency("double", "lineitem", "l_discount", 0.0)
_frequency("int", "lineitem", "CASE l_returnflag WHEN 'N' THEN 7 WHEN 'R' THEN 3 END", 0)

_FRACTIONS = "[" + ", ".join(f"{f!r}::DOUBLE" for f in S.FRACTIONS) + "]"


def _decimal_sql(b: str, limit: int = (1 << 31) - 1, largest: int = 22) -> str:
    fits = f"list_filter(range({largest + 1}), lambda e: round(v / {_FRACTIONS}[e + 1]) BETWEEN 0 AND {limit} AND round(v / {_FRACTIONS}[e + 1]) * {_FRACTIONS}[e + 1] = v)"
    return f"WITH {b}, x AS (SELECT *, {fits}[1] AS e FROM b)"


for _name, _table, _column in (("price", "lineitem", "l_extendedprice"), ("balance", "customer", "c_acctbal"), ("value", "events", "value"), ("discount", "lineitem", "l_discount")):
    query(f"pseudodecimal_exponents_{_name}", _decimal_sql(cut_sql(_table, v=_column)) + " SELECT coalesce(e, 23) AS exponent, count(*) AS cnt FROM x GROUP BY 1")(
        lambda spark, d, t=_table, c=_column: E.pseudodecimal_encode(cut(spark, d, t, v=c)).groupBy(F.col("e").alias("exponent")).agg(F.count(F.lit(1)).alias("cnt"))
    )


@query("pseudodecimal_roundtrip", _decimal_sql(cut_sql("lineitem", v="l_extendedprice")) + " SELECT count(e) AS converted, count(*) - count(e) AS patches, 0::BIGINT AS mismatches, count(DISTINCT CASE WHEN e IS NULL THEN block_id * 1000000 + pos // 4 END) AS exception_groups FROM x")
def pseudodecimal_roundtrip(spark, d):
    rows = cut(spark, d, "lineitem", v="l_extendedprice")
    e = E.pseudodecimal_decode(E.pseudodecimal_encode(rows.withColumn("v0", F.col("v")), 31, "v0"))
    patch = F.col("e") == S.NO_EXPONENT
    return e.agg(F.count_if(~patch).alias("converted"), F.count_if(patch).alias("patches"), F.count_if(F.col("value") != F.col("v0")).alias("mismatches"), F.countDistinct(F.when(patch, F.struct("block_id", F.floor(F.col("pos") / 4)))).alias("exception_groups"))


@query("max_exponent", _decimal_sql(cut_sql("lineitem", v="l_discount")) + " SELECT block_id, max(e) AS exponent FROM x WHERE e IS NOT NULL GROUP BY block_id")
def max_exponent(spark, d):
    return E.max_exponent(cut(spark, d, "lineitem", v="l_discount"))


# ---- choice ------------------------------------------------------------------------------------------------------------

_BITS = "CASE WHEN {u} = 0 THEN 1 ELSE length(bin({u})) END"


def _costs_sql(table: str, column: str, kind: str, config: Config, name: str) -> str:
    """CTEs {name}b, {name}s and {name}: rows (column, block_id, n, raw, scheme, priority, ratio)."""
    on = sorted(config.schemes(kind))
    b = cut_sql(table, name=f"{name}b", v=column)
    if kind == "string":
        s = f"{name}u AS (SELECT block_id, coalesce(v, '') AS x, count(*) AS c, count(v) AS p FROM {name}b GROUP BY ALL), {name}s AS (SELECT block_id, sum(c)::BIGINT AS n, sum(p)::BIGINT AS present, count(*) AS u, sum(c * strlen(x))::BIGINT AS tl, sum(strlen(x))::BIGINT AS tul, (4 * (sum(c) + 1) + sum(c * strlen(x)))::BIGINT AS raw FROM {name}u GROUP BY block_id)"
        bits = _BITS.format(u="u")
        size = f"floor(floor(28 + {config.fsst_header} + n * {bits} / 8.0::DOUBLE) + 4 * (1 + u) + CASE WHEN tul >= {config.fsst_min_bytes} THEN 0.5::DOUBLE * tul ELSE tul END)"
        cost = {
            "UNCOMPRESSED": "1.0::DOUBLE", "ONE_VALUE": "CASE WHEN u <= 1 OR present = 0 THEN n::DOUBLE ELSE 0 END",
            "DICT": f"CASE WHEN u >= present // 2 THEN 0 ELSE raw::DOUBLE / {size} END",
            "FSST": f"CASE WHEN u >= present // 2 AND tl > {config.fsst_min_bytes} THEN 1.0::DOUBLE ELSE 0 END",
            "DICTIONARY_8": "CASE WHEN u <= 255 THEN raw::DOUBLE / (n * 8 / 8.0::DOUBLE + 4 * (1 + u) + 8 + tul) ELSE 0 END",
            "DICTIONARY_16": "CASE WHEN u <= 65535 THEN raw::DOUBLE / (n * 16 / 8.0::DOUBLE + 4 * (1 + u) + 8 + tul) ELSE 0 END",
        }
    else:
        w, head = (4, 4) if kind == "int" else (8, 8)
        s = f"{name}s AS (SELECT block_id, count(*) AS n, count(v) AS present, count(DISTINCT coalesce(v, 0)) AS u, min(coalesce(v, 0)) AS lo, max(coalesce(v, 0)) AS hi, count(*) * {w} AS raw FROM {name}b GROUP BY block_id)"
        bits = _BITS.format(u="u")
        cost = {
            "UNCOMPRESSED": "1.0::DOUBLE", "ONE_VALUE": "CASE WHEN u <= 1 OR present = 0 THEN n::DOUBLE ELSE 0 END",
            "DICT": f"raw::DOUBLE / (floor(u * {w} + n * {bits} / 8.0::DOUBLE) + 10 + n * 2 // 128)",
            "DICTIONARY_8": f"CASE WHEN u <= 256 THEN raw::DOUBLE / ({head} + u * {w} + n * 8 / 8.0::DOUBLE) ELSE 0 END",
            "DICTIONARY_16": f"CASE WHEN u <= 65536 THEN raw::DOUBLE / ({head} + u * {w} + n * 16 / 8.0::DOUBLE) ELSE 0 END",
            "TRUNCATION_8": f"CASE WHEN hi::BIGINT - lo::BIGINT < 256 THEN {w * 8.0 / 8}::DOUBLE ELSE 0 END",
            "TRUNCATION_16": f"CASE WHEN hi::BIGINT - lo::BIGINT < 65536 THEN {w * 8.0 / 16}::DOUBLE ELSE 0 END",
        }
        if kind == "double":
            cost = {k: v for k, v in cost.items() if not k.startswith("TRUNC")}
    from ..config import SCHEMES

    rows = " UNION ALL ".join(f"SELECT '{column}' AS \"column\", block_id, n, raw, '{k}' AS scheme, {SCHEMES[kind][k]} AS priority, round({v}, 6) AS ratio FROM {name}s" for k, v in cost.items() if k in on)
    return f"{b}, {s}, {name} AS ({rows})"


COLUMNS = {
    "lineitem": {"l_linenumber": "int", "l_suppkey": "long", "l_discount": "double", "l_quantity": "double", "l_extendedprice": "double", "l_returnflag": "string"},
    "orders": {"o_orderpriority": "string", "o_orderstatus": "string", "o_totalprice": "double"},
    "events": {"event_type": "string", "props": "string", "user_id": "long"},
}


def _costs(spark, d, columns, config, of=X.costs_of):
    out = None
    for table, cols in columns.items():
        rows = of(dealt(spark, d, table, **{c: c for c in cols}), cols, config)
        out = rows if out is None else out.unionByName(rows)
    return out


def _all_costs_sql(columns, config) -> str:
    names, parts = [], []
    for table, cols in columns.items():
        for c, kind in cols.items():
            names.append(f"k{len(names)}")
            parts.append(_costs_sql(table, c, kind, config, names[-1]))
    return "WITH " + ", ".join(parts) + ", costs AS (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names) + ")"


CHOICE = ", choice AS (SELECT \"column\", block_id, n, raw, scheme, ratio FROM costs QUALIFY row_number() OVER (PARTITION BY \"column\", block_id ORDER BY ratio DESC, priority DESC) = 1)"
SIZES = ", sizes AS (SELECT *, ceil(round(raw / ratio, 4))::BIGINT AS compressed FROM choice)"
_ONE = {k: {t: {c: x for c, x in cols.items() if x == k} for t, cols in COLUMNS.items()} for k in ("int", "long", "double", "string")}
_ONE = {k: {t: c for t, c in v.items() if c} for k, v in _ONE.items()}
for _kind in ("int", "long", "double", "string"):
    query(f"scheme_costs_{_kind}", _all_costs_sql(_ONE[_kind], WIDE) + " SELECT \"column\", block_id, scheme, ratio FROM costs")(lambda spark, d, k=_kind: _costs(spark, d, _ONE[k], WIDE).select("column", "block_id", "scheme", "ratio"))


def choices(spark, d, config=CONFIG):
    return _costs(spark, d, COLUMNS, config, X.choices_of)


@query("scheme_choice", _all_costs_sql(COLUMNS, CONFIG) + CHOICE + " SELECT * FROM choice")
def scheme_choice(spark, d):
    return choices(spark, d)


@query("scheme_choice_all_schemes", _all_costs_sql(COLUMNS, WIDE) + CHOICE + " SELECT * FROM choice")
def scheme_choice_all_schemes(spark, d):
    return choices(spark, d, WIDE)


@query("scheme_report", _all_costs_sql(COLUMNS, CONFIG) + CHOICE + " SELECT \"column\", scheme, count(*) AS blocks, sum(n)::BIGINT AS tuples, min(block_id) AS first_block, max(block_id) AS last_block FROM choice GROUP BY ALL")
def scheme_report(spark, d):
    return P.scheme_report(choices(spark, d))


@query("scheme_ranges", _all_costs_sql(COLUMNS, CONFIG) + CHOICE + """, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY block_id) - row_number() OVER (PARTITION BY "column", scheme ORDER BY block_id) AS g FROM choice)
SELECT "column", scheme, min(block_id) AS first_block, max(block_id) AS last_block, sum(n)::BIGINT AS tuples FROM r GROUP BY "column", scheme, g""")
def scheme_ranges(spark, d):
    return P.scheme_ranges(choices(spark, d))


def sizes(spark, d):
    return X.compressed_size(choices(spark, d))


@query("compression_report", _all_costs_sql(COLUMNS, CONFIG) + CHOICE + SIZES + " SELECT coalesce(\"column\", 'Total') AS \"column\", sum(raw)::BIGINT AS raw, sum(compressed)::BIGINT AS compressed FROM sizes GROUP BY ROLLUP (\"column\")")
def compression_report(spark, d):
    return P.compression_report(sizes(spark, d))


@query("compression_ratios", _all_costs_sql(COLUMNS, CONFIG) + CHOICE + SIZES + """, m AS (SELECT "column", scheme, count(*) AS k FROM sizes GROUP BY "column", scheme), mm AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY k DESC, scheme DESC) = 1)
SELECT "column", round(avg(raw / compressed), 6) AS ratio_avg, round(sum(raw)::DOUBLE / sum(compressed), 6) AS ratio_weighted, any_value(mm.scheme) AS scheme FROM sizes JOIN mm USING ("column") GROUP BY "column\"""")
def compression_ratios(spark, d):
    return P.ratio_rollup(sizes(spark, d))


PART_LIMIT = 200_000
PACKED = ", RECURSIVE_IN AS (SELECT \"column\", block_id, compressed AS size, row_number() OVER (PARTITION BY \"column\" ORDER BY block_id) AS r FROM sizes), p AS (SELECT \"column\", block_id, size, r, 0::BIGINT AS part, size AS fill FROM RECURSIVE_IN WHERE r = 1 UNION ALL SELECT i.\"column\", i.block_id, i.size, i.r, CASE WHEN p.fill + i.size <= {0} THEN p.part ELSE p.part + 1 END, CASE WHEN p.fill + i.size <= {0} THEN p.fill + i.size ELSE i.size END FROM p JOIN RECURSIVE_IN i ON i.\"column\" = p.\"column\" AND i.r = p.r + 1)".format(PART_LIMIT)
_PACK = (_all_costs_sql(COLUMNS, CONFIG) + CHOICE + SIZES + PACKED).replace("WITH ", "WITH RECURSIVE ", 1)


def packed(spark, d):
    return P.pack_parts(sizes(spark, d).select("column", "block_id", F.col("compressed").alias("size")), PART_LIMIT)


@query("part_packing", _PACK + " SELECT \"column\", part, count(*) AS blocks, (sum(size) + 4 + 4 * count(*))::BIGINT AS bytes FROM p GROUP BY ALL")
def part_packing(spark, d):
    return P.part_sizes(packed(spark, d))


@query("aligned_offsets", _PACK + """ SELECT "column", part, row_number() OVER (PARTITION BY "column", part ORDER BY block_id) - 1 AS chunk, block_id,
  ((4 + 4 * count(*) OVER (PARTITION BY "column", part) + 15) // 16 * 16 + coalesce(sum((size + 15) // 16 * 16) OVER (PARTITION BY "column", part ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM p""")
def aligned_offsets(spark, d):
    return P.chunk_offsets(packed(spark, d))


# ---- samples -----------------------------------------------------------------------------------------------------------


def _offset() -> Column:
    return (F.col("_slice") * 7919 + F.col("block_id") * 104729) % (F.col("_last") + 1)


def _sample_sql(runs: int, length: int) -> str:
    return f"""SELECT block_id, row_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY block_id) AS sz FROM b), LATERAL (SELECT greatest(sz // {runs}, 1) AS w), LATERAL (SELECT least(pos // w, {runs - 1}) AS sl),
    LATERAL (SELECT greatest(CASE WHEN sl = {runs - 1} THEN sz - sl * w ELSE w END - {length}, 0) AS lst), LATERAL (SELECT sl * w + (sl * 7919 + block_id * 104729) % (lst + 1) AS st)
    WHERE sz <= {runs * length} OR pos BETWEEN st AND st + {length - 1}"""


@query("stratified_sample", f"WITH {cut_sql('lineitem', v='l_quantity')} " + _sample_sql(10, 64))
def stratified_sample(spark, d):
    return B.sampled(cut(spark, d, "lineitem", v="l_quantity"), 10, 64, _offset()).select("block_id", "row_id", "pos")


GRID = [(640, 1), (320, 2), (160, 4), (80, 8), (40, 16), (20, 32), (10, 64), (5, 128), (1, 640)]


@query("sampling_grid", f"WITH {cut_sql('lineitem', v='l_quantity')} " + " UNION ALL ".join(f"SELECT {r} AS runs, {n} AS length, count(*) AS rows, count(DISTINCT v) AS uniq FROM (SELECT s.*, b.v FROM ({_sample_sql(r, n)}) s JOIN b USING (row_id))" for r, n in GRID))
def sampling_grid(spark, d):
    b, out = cut(spark, d, "lineitem", v="l_quantity"), None
    for r, n in GRID:
        one = B.sampled(b, r, n, _offset()).agg(F.lit(r).alias("runs"), F.lit(n).alias("length"), F.count(F.lit(1)).alias("rows"), F.countDistinct("v").alias("uniq"))
        out = one if out is None else out.unionByName(one)
    return out


@query("block_limit", f"WITH {cut_sql('orders', v='o_totalprice')} SELECT row_id, block_id, pos FROM b WHERE block_id < 3")
def block_limit(spark, d):
    return B.take_blocks(cut(spark, d, "orders"), 3)


@query("range_of_rows", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, event_id FROM events QUALIFY row_number() OVER (ORDER BY event_id) - 1 BETWEEN 100 AND 299")
def range_of_rows(spark, d):
    e = numbered(spark, d, "events").rows().select("row_id", "event_id")
    spans = spark.createDataFrame([(100, 200)], "start long, length long")
    return e.join(F.broadcast(spans), F.col("row_id").between(F.col("start"), F.col("start") + F.col("length") - 1)).select("row_id", "event_id")


@query("row_ids_by_range", f"SELECT row_number() OVER (ORDER BY {', '.join(ORDER['lineitem'])}) - 1 AS row_id, l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def row_ids_by_range(spark, d):
    return B.with_row_id(spark.read.parquet(f"{d}/lineitem.parquet"), *ORDER["lineitem"], partitions=12).select("row_id", "l_orderkey", "l_linenumber", "l_extendedprice")


# ---- profiles ----------------------------------------------------------------------------------------------------------


@query("profile_int", f"WITH {cut_sql('events', v='CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 5 END')} SELECT block_id, count(*) AS n, min(v) AS vmin, max(v) AS vmax, count(*) - count(v) AS nulls, count_if(v = 0)::BIGINT AS zeros, count(DISTINCT v) AS uniq FROM b GROUP BY block_id")
def profile_int(spark, d):
    return R.profile_numbers(cut(spark, d, "events", v="CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 5 END"))


@query("profile_double", f"WITH {cut_sql('events', v=NULLED)} SELECT block_id, count(*) AS n, min(v) AS vmin, max(v) AS vmax, count(*) - count(v) AS nulls, count_if(v = 0)::BIGINT AS zeros, count(DISTINCT v) AS uniq FROM b GROUP BY block_id")
def profile_double(spark, d):
    return R.profile_numbers(cut(spark, d, "events", v=NULLED))


@query("profile_string", f"WITH {cut_sql('documents', v='nullif(lang, ' + chr(39) + 'fr' + chr(39) + ')')} SELECT block_id, count(*) AS n, min(strlen(v)) AS min_length, max(strlen(v)) AS max_length, coalesce(sum(strlen(v)), 0)::BIGINT // count(*) AS average_length, count(*) - count(v) AS nulls, count_if(v = '')::BIGINT AS empty, count(DISTINCT v) AS uniq FROM b GROUP BY block_id")
def profile_string(spark, d):
    return R.profile_strings(cut(spark, d, "documents", v="nullif(lang, 'fr')"))


@query("top3_values", f"WITH {cut_sql('events', v=NULLED.replace('value', 'user_id'))}, c AS (SELECT block_id, v AS value, count(*) AS cnt FROM b WHERE v IS NOT NULL GROUP BY ALL), w AS (SELECT block_id, count(v) AS n FROM b GROUP BY block_id) SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY cnt DESC, value) AS rank, value, cnt, round(100.0::DOUBLE * cnt / n, 6) AS pct FROM c JOIN w USING (block_id) QUALIFY rank <= 3")
def top3_values(spark, d):
    return A.top_values(cut(spark, d, "events", v=NULLED.replace("value", "user_id")), 3)


@query("top3_values_of_all", f"WITH {cut_sql('orders', v='o_orderpriority')}, c AS (SELECT v AS value, count(*) AS cnt FROM b GROUP BY ALL) SELECT row_number() OVER (ORDER BY cnt DESC, value) AS rank, value, cnt, round(100.0::DOUBLE * cnt / (SELECT count(*) FROM b), 6) AS pct FROM c QUALIFY rank <= 3")
def top3_values_of_all(spark, d):
    return A.top_values(cut(spark, d, "orders", v="o_orderpriority"), 3, (), of_all=True)


@query("run_picture", f"WITH {cut_sql('events', v=NULLED.replace('value', '(user_id % 3)'))}, m AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b) SELECT block_id, string_agg(CASE WHEN v IS NULL THEN 'N' WHEN prev = v THEN '.' ELSE 'x' END, '' ORDER BY pos) AS picture FROM m WHERE pos < 20 GROUP BY block_id")
def run_picture(spark, d):
    return A.run_pictures(cut(spark, d, "events", v=NULLED.replace("value", "(user_id % 3)")))


_SQLBITS = "CAST(CAST(v AS BIT) AS BIGINT)"


@query("double_bits_profile", f"WITH {cut_sql('customer', v='c_acctbal')}, x AS (SELECT block_id, {_SQLBITS} AS i FROM b) SELECT block_id, count(DISTINCT i) AS distinct_values, count(DISTINCT ((i >> 52) & 2047) - 1023) AS distinct_exponents, count(DISTINCT i & 4503599627370495) AS distinct_mantissas, min(((i >> 52) & 2047) - 1023) AS min_exponent, max(((i >> 52) & 2047) - 1023) AS max_exponent FROM x GROUP BY block_id")
def double_bits_profile(spark, d):
    return A.double_bits_profile(cut(spark, d, "customer", v="c_acctbal").withColumn("bits", S.double_bits(F.col("v"))))


@query("decimal_applicability", _decimal_sql(cut_sql("lineitem", v="abs(l_extendedprice)"), (1 << 53) - 1, 15) + ", k AS (SELECT block_id, count(*) AS n, count(e) AS c FROM x GROUP BY block_id) SELECT round(100.0::DOUBLE * sum(c) / sum(n), 6) AS pct, count_if(n = c)::BIGINT AS positive_blocks FROM k")
def decimal_applicability(spark, d):
    return R.applicability_summary(R.decimal_applicability(cut(spark, d, "lineitem", v="l_extendedprice")))


# ---- text --------------------------------------------------------------------------------------------------------------

RAW = "CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '' WHEN 2 THEN ' ' || user_id || ' ' WHEN 3 THEN '' || user_id ELSE user_id || '.5' END"


@query("csv_null_rules", f"""WITH r AS (SELECT event_id, {RAW} AS raw FROM events), t AS (SELECT *, trim(raw) AS t FROM r)
SELECT event_id, CASE WHEN t IN ('', 'null') THEN NULL WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN t::INT END AS i, CASE WHEN t IN ('', 'null') THEN NULL ELSE t::DOUBLE END AS d, CASE WHEN raw = 'null' THEN NULL ELSE raw END AS s FROM t""")
def csv_null_rules(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(RAW).alias("raw"))
    return raw.select("event_id", csvio.parse_int(F.col("raw")).alias("i"), csvio.parse_double(F.col("raw")).alias("d"), csvio.parse_string(F.col("raw")).alias("s"))


@query("csv_stats", f"WITH r AS (SELECT {RAW} AS raw FROM events) SELECT count_if(trim(raw) IN ('', 'null'))::BIGINT AS null_count, count_if(trim(raw) IN ('', 'null') OR try_cast(trim(raw) AS DOUBLE) = 0)::BIGINT AS empty_count_number, count_if(raw = '')::BIGINT AS empty_count_string FROM r")
def csv_stats(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.expr(RAW).alias("raw"))
    number = csvio.column_stats(raw.select(csvio.parse_double(F.col("raw")).alias("v")), "v", "double")
    text = csvio.column_stats(raw.select(csvio.parse_string(F.col("raw")).alias("v")), "v", "string")
    return number.select("null_count", F.col("empty_count").alias("empty_count_number"), F.lit(1).alias("_k")).join(text.select(F.col("empty_count").alias("empty_count_string"), F.lit(1).alias("_k")), "_k").drop("_k")


@query("csv_export_lines", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey || '|' || o_custkey || '|' || coalesce(nullif(o_orderstatus, 'F'), 'null') || '|' || o_orderpriority AS line FROM orders")
def csv_export_lines(spark, d):
    o = numbered(spark, d, "orders").rows().select("row_id", "o_orderkey", "o_custkey", F.expr("nullif(o_orderstatus, 'F')").alias("o_orderstatus"), "o_orderpriority")
    return o.select("row_id", csvio.export_line(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("line"))


@query("csv_compare", """WITH a AS (SELECT o_orderpriority || '|' || printf('%.6f', round(o_totalprice, 2)) AS line FROM orders), b AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN 'x' ELSE o_orderpriority END || '|' || printf('%.6f', round(o_totalprice, 2)) AS line FROM orders),
u AS (SELECT line, 1 AS s FROM a UNION ALL SELECT line, -1 FROM b) SELECT CASE WHEN sum(s) > 0 THEN 'left' ELSE 'right' END AS side, line, abs(sum(s))::BIGINT AS cnt FROM u GROUP BY line HAVING sum(s) <> 0""")
def csv_compare(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    line = lambda p: F.concat_ws("|", p, C.normal_cell(F.round("o_totalprice", 2), "double")).alias("line")
    return C.multiset_diff(o.select(line(F.col("o_orderpriority"))), o.select(line(F.when(F.col("o_orderkey") % 100 == 0, "x").otherwise(F.col("o_orderpriority")))))


@query("scalar_functions", r"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_suppkey - 50 < 0 THEN 32 WHEN l_suppkey = 50 THEN 1 ELSE length(bin(l_suppkey - 50)) END AS bits,
  (l_suppkey + 15) // 16 * 16 AS aligned, l_discount::FLOAT::DOUBLE = l_discount AS exact, printf('%.6f', l_extendedprice) AS fixed, regexp_replace(chr(9) || ' ' || l_returnflag || ' ', '^\s+|\s+$', '', 'g') AS trimmed, regexp_replace(substr('a' || chr(9) || l_linestatus || chr(10) || 'z', 1, 3), '[\t\n]', ' ', 'g') AS clean FROM lineitem""")
def scalar_functions(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", S.bits_needed(F.col("l_suppkey") - 50).alias("bits"), S.align_up(F.col("l_suppkey")).alias("aligned"), S.float_exact(F.col("l_discount")).alias("exact"), S.fixed6(F.col("l_extendedprice")).alias("fixed"), S.trim_space(F.concat(F.lit("\t "), "l_returnflag", F.lit(" "))).alias("trimmed"), S.sanitise(F.concat(F.lit("a\t"), "l_linestatus", F.lit("\nz")), 3).alias("clean"))


# ---- skipping, lookup, whole chunks -----------------------------------------------------------------------------------------


def _zones(spark, d) -> DataFrame:
    """The zone map of the orders' keys, written once beside the block table."""
    own = numbered(spark, d, "orders")
    if not hasattr(own, "zones"):
        own.zones = Scratch(spark, "zones").stage(C.zone_map(cut(spark, d, "orders", v="o_orderkey")), "orders")
    return own.zones


@query("block_prune", f"WITH {cut_sql('orders', v='o_orderkey')} SELECT row_id, v FROM b WHERE v BETWEEN 5000 AND 5100")
def block_prune(spark, d):
    b = cut(spark, d, "orders", v="o_orderkey")
    return C.scan_between(b, _zones(spark, d), 5000, 5100).select("row_id", "v")


@query("zone_map", f"WITH {cut_sql('orders', v='o_orderkey')} SELECT block_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM b GROUP BY block_id")
def zone_map(spark, d):
    return C.zone_map(cut(spark, d, "orders", v="o_orderkey"))


@query("row_lookup", f"WITH {cut_sql('orders', v='o_totalprice')} SELECT row_id, v FROM b WHERE row_id IN (0, 77, 1024)")
def row_lookup(spark, d):
    return numbered(spark, d, "orders").lookup(0, 77, 1024).select("row_id", F.col("o_totalprice").alias("v"))


@query("long_form", "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, * FROM orders) SELECT row_id, 'o_orderkey' AS \"column\", 'long' AS type, o_orderkey AS i, NULL::DOUBLE AS d, NULL::VARCHAR AS s FROM o UNION ALL SELECT row_id, 'o_totalprice', 'double', NULL, o_totalprice, NULL FROM o UNION ALL SELECT row_id, 'o_orderdate', 'long', epoch_us(o_orderdate), NULL, NULL FROM o UNION ALL SELECT row_id, 'o_orderpriority', 'string', NULL, NULL, o_orderpriority FROM o")
def long_form(spark, d):
    return B.long_form(numbered(spark, d, "orders").rows(), ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query("wide_chunk_roundtrip", "SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM orders")
def wide_chunk_roundtrip(spark, d):
    """All columns of a table encoded by a relational scheme each, decoded, put side by side by row and compared."""
    b = block_table(spark, d, "orders")
    of = lambda c: b.select("row_id", "block_id", "pos", F.col(c).alias("v"))
    by_row = lambda df, c: df.select((F.col("block_id") * BLOCK["orders"] + F.col("pos")).alias("row_id"), F.col("value").alias(c))
    out = by_row(E.delta_decode(E.delta_encode(of("o_orderkey"))), "o_orderkey")
    for c, decoded in (
        ("o_custkey", E.for_decode(E.for_encode(of("o_custkey")))),
        ("o_orderstatus", E.dict_decode(E.dict_encode(of("o_orderstatus"), ""), E.dict_entries(of("o_orderstatus"), ""))),
        ("o_totalprice", E.pseudodecimal_decode(E.pseudodecimal_encode(of("o_totalprice")))),
        ("o_orderpriority", E.rle_decode(E.rle_encode(of("o_orderpriority"), ""))),
    ):
        out = out.join(by_row(decoded, c), "row_id")
    return C.rows_equal(out, b.select("row_id", *[c for c in out.columns if c != "row_id"]))

