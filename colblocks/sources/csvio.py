"""Delimited text with an external schema: reading with explicit null rules, column counts, export."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import trim_space

#: The names of a schema file and the value types they stand for; any other name is skipped.
ALIASES = {"integer": "int", "smallint": "int", "double": "double", "float": "double", "string": "string"}
#: How a DDL type is named in a schema file.
DDL = {"decimal": "double", "numeric": "double", "float": "double", "real": "double", "double": "double", "integer": "integer", "int": "integer", "smallint": "integer", "bigint": "bigint", "varchar": "string", "char": "string", "text": "string", "string": "string", "time": "skip", "date": "skip", "timestamp": "skip", "boolean": "skip", "bool": "skip"}
_SPARK = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
#: Stands for a null field while fields are read as text.
_NEVER = "\u0001never\u0001"


def parse_schema(text: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of a YAML schema: a list ``columns`` of maps with name and type."""
    out, name = [], None
    for line in text.splitlines():
        m = re.match(r"[\s{,-]*name:\s*['\"]?([^'\",}]+?)['\"]?\s*(?:,\s*type:\s*['\"]?(\w+)['\"]?\s*}?)?\s*$", line)
        if m:
            name = m[1]
            if m[2]:
                out.append((name, m[2].lower()))
                name = None
        elif (m := re.match(r"\s*-?\s*type:\s*['\"]?(\w+)", line)) and name:
            out.append((name, m[1].lower()))
            name = None
    return out


def schema_of_ddl(ddl: str) -> list[tuple[str, str]]:
    """(name, schema type) of the columns of a CREATE TABLE statement."""
    body = ddl[ddl.index("(") + 1 : ddl.rindex(")")]
    out = []
    for field in re.split(r",(?![^(]*\))", body):
        m = re.match(r"\s*[\"`]?(\w+)[\"`]?\s+(\w+)", field)
        if m:
            out.append((m[1], DDL.get(m[2].lower(), "skip")))
    return out


def struct_type(schema: list[tuple[str, str]]) -> T.StructType:
    """The Spark schema without skipped columns."""
    return T.StructType([T.StructField(n, _SPARK[ALIASES[t]]) for n, t in schema if t in ALIASES])


def parse_int(c: Column, prefix: bool = False) -> Column:
    """Trimmed; null if empty or ``null``. Strict by default (null if it isn't a whole number); ``prefix`` takes leading digits."""
    t = trim_space(c)
    value = F.when(t.rlike(r"^[+-]?\d"), F.regexp_extract(t, r"^[+-]?\d+", 0).cast("int")) if prefix else F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))
    return F.when(t.isin("", "null"), F.lit(None)).otherwise(value)


def parse_double(c: Column) -> Column:
    t = trim_space(c)
    return F.when(t.isin("", "null"), F.lit(None)).otherwise(t.try_cast("double"))


def parse_string(c: Column) -> Column:
    """Not trimmed; null only if ``null``; an empty field is a value."""
    return F.when(c != "null", c)


_PARSERS = {"int": parse_int, "double": parse_double, "string": parse_string}


def read_csv(spark: SparkSession, path: str, schema: list[tuple[str, str]], sep: str = "|", columns: list[str] | None = None, only_type: str | None = None, strict: bool = True) -> DataFrame:
    """Typed columns of a file without header. Rows with too few or too many fields raise; so do bad numbers if ``strict``.

    ``columns`` and ``only_type`` project before parsing; an unknown type raises.
    """
    if only_type is not None and only_type not in ALIASES:
        raise ValueError(f"unknown type {only_type!r}")
    # Without pruning each row is parsed whole, so ragged rows are seen whatever columns are asked for.
    raw = spark.read.option("columnPruning", False).schema(T.StructType([T.StructField(n, T.StringType()) for n, _ in schema])).csv(path, sep=sep, quote="", nullValue=_NEVER, mode="FAILFAST")
    out = []
    for name, kind in schema:
        if kind not in ALIASES or (columns is not None and name not in columns) or (only_type is not None and ALIASES[kind] != ALIASES[only_type]):
            continue
        field = F.coalesce(F.col(name), F.lit(""))  # the reader gives null for an empty field only
        value = _PARSERS[ALIASES[kind]](field)
        if strict and ALIASES[kind] != "string":
            value = F.when(value.isNull() & ~trim_space(field).isin("", "null"), F.raise_error(F.concat(F.lit(f"bad value in {name}: "), field)).cast(ALIASES[kind])).otherwise(value)
        out.append(value.alias(name))
    return raw.select(*out)


def column_stats(df: DataFrame, column: str, kind: str) -> DataFrame:
    """(null_count, empty_count): empty strings, or numbers stored as 0, which nulls are too."""
    c = F.col(column)
    empty = F.count_if(c == "") if kind == "string" else F.count_if(c.isNull() | (c == 0))
    return df.agg(F.count_if(c.isNull()).alias("null_count"), empty.alias("empty_count"))


def table_stats(df: DataFrame) -> DataFrame:
    """(column, null_count, empty_count) of all columns in one pass."""
    aggs, rows = [], []
    for i, (c, t) in enumerate(df.dtypes):
        empty = F.count_if(F.col(c) == "") if t == "string" else F.count_if(F.col(c).isNull() | (F.col(c) == 0))
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), empty.alias(f"e{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"), F.col(f"e{i}").alias("empty_count")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def export_line(df: DataFrame, columns: list[str], sep: str = "|") -> Column:
    """A row as text: fields parted by ``sep``, nulls as ``null``."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, sep: str = "|") -> None:
    """Text files without header, in the order given: the files sorted by name are the sorted table."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(export_line(df, [c for c in df.columns if c != "row_id"], sep).alias("value")).write.text(path)


def column_file(index: int, name: str, kind: str) -> str:
    return f"{index + 1}_{name}.{kind}"


def name_and_type(path: str) -> tuple[str, str]:
    """Column name and type from a path ``.../[<number>_]<name>.<type>``."""
    m = re.fullmatch(r"(?:\d+_)?(.+)\.(\w+)", Path(path).name)
    if not m:
        raise ValueError(f"no name and type in {path!r}")
    return m[1], m[2]
