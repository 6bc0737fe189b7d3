"""The choice of a scheme per block as data: cost rows, then the best of each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCHEMES, WIDTH, Config
from ..functions.scalar import bits_needed


def _d(c: Column) -> Column:
    return c.cast("double")


def numeric_costs(kind: str, config: Config, level: int = 3) -> dict[str, Column]:
    """Estimated ratio of the schemes whose size follows from the statistics of the whole block."""
    w = WIDTH[kind]
    n, u = F.col("n"), F.col("uniq")
    raw = _d(n * w)
    dict_size = F.floor(_d(u * w) + _d(n * bits_needed(u)) / 8.0) + 10 + F.floor(n * 2 / 128)
    out = {
        "UNCOMPRESSED": F.lit(1.0),
        "ONE_VALUE": F.when((u <= 1) | (F.col("nulls") == n), _d(n)).otherwise(F.lit(0.0)),
        "DICT": raw / _d(dict_size) if level > 1 else F.lit(0.0),
    }
    head = 4 if kind == "int" else 8
    for bits in (8, 16):
        out[f"DICTIONARY_{bits}"] = F.when(u <= (1 << bits), raw / (head + _d(u * w) + _d(n * bits) / 8.0)).otherwise(F.lit(0.0))
    if kind in ("int", "long"):
        span = F.col("vmax").cast("long") - F.col("vmin").cast("long")
        for bits in (8, 16):
            out[f"TRUNCATION_{bits}"] = F.when(span < (1 << bits), F.lit(w * 8.0 / bits)).otherwise(F.lit(0.0))
    return out


def string_costs(config: Config, level: int = 3) -> dict[str, Column]:
    n, u, tul = F.col("n"), F.col("uniq"), F.col("total_unique_length")
    present = n - F.col("nulls")
    bits = bits_needed(u)
    size = F.floor(28 + config.fsst_header + _d(n * bits) / 8.0)
    size = size + 4 * (1 + u)
    size = F.floor(_d(size) + F.when(tul >= config.fsst_min_bytes, 0.5 * _d(tul)).otherwise(_d(tul)))
    many = u >= F.floor(present / 2)
    out = {
        "UNCOMPRESSED": F.lit(1.0),
        "ONE_VALUE": F.when((u <= 1) | (F.col("nulls") == n), _d(n)).otherwise(F.lit(0.0)),
        "FSST": F.when(many & (F.col("total_length") > config.fsst_min_bytes), F.lit(1.0)).otherwise(F.lit(0.0)),
    }
    dictionary = _d(F.col("total_size")) / _d(size)
    out["DICT"] = F.when(many, F.lit(0.0)).otherwise(dictionary) if "FSST" in config.string_schemes else dictionary
    for b in (8, 16):
        out[f"DICTIONARY_{b}"] = F.when(u <= (1 << b) - 1, _d(F.col("total_size")) / (_d(n * b) / 8.0 + 4 * _d(1 + u) + 8 + _d(tul))).otherwise(F.lit(0.0))
    return out


def block_stats(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Statistics of several columns of a table of blocks in one pass: (column, kind, block_id, n, nulls, uniq, vmin, vmax, lengths).

    Values stand in one long table with a field per family, so the table of blocks is made once, whatever the number of columns.
    A table that is dealt out by block is not shuffled again.
    """
    zero = {"int": ("i", F.lit(0).cast("long")), "long": ("i", F.lit(0).cast("long")), "double": ("d", F.lit(0.0)), "string": ("s", F.lit(""))}
    types = {"i": "long", "d": "double", "s": "string"}

    def cell(no: int, c: str, kind: str) -> Column:
        own, z = zero[kind]
        return F.struct(F.lit(no).alias("no"), F.col(c).isNull().alias("null"), *[(F.coalesce(F.col(c).cast(t), z) if f == own else F.lit(None).cast(t)).alias(f) for f, t in types.items()])

    cells = table.select("block_id", F.explode(F.array(*[cell(no, c, k) for no, (c, k) in enumerate(columns.items())])).alias("c")).select("block_id", "c.*")
    per_value = cells.groupBy("block_id", "no", *types).agg(F.count(F.lit(1)).alias("n"), F.count_if("null").alias("nulls"))
    size = F.octet_length("s").cast("long")
    out = per_value.groupBy("block_id", "no").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.count(F.lit(1)).alias("uniq"), F.min("i").alias("vmin"), F.max("i").alias("vmax"), F.sum(F.col("n") * size).alias("total_length"), F.sum(size).alias("total_unique_length"))
    named = {n: F.element_at(F.array(*map(F.lit, texts)), F.col("no") + 1) for n, texts in (("column", columns), ("kind", columns.values()))}
    return out.withColumns(named | {"total_size": 4 * (F.col("n") + 1) + F.col("total_length")}).drop("no")


def _cost_rows(table: DataFrame, columns: dict[str, str], config: Config) -> DataFrame:
    """(column, block_id, n, raw, costs) with the (ratio, priority, scheme) of all enabled schemes."""
    raw, rows = None, None
    for kind in dict.fromkeys(columns.values()):
        costs = string_costs(config) if kind == "string" else numeric_costs(kind, config)
        own = F.array(*[F.struct(F.round(c, 6).alias("ratio"), F.lit(SCHEMES[kind][s]).alias("priority"), F.lit(s).alias("scheme")) for s, c in costs.items() if s in config.schemes(kind)])
        size = F.col("total_size") if kind == "string" else F.col("n") * WIDTH[kind]
        here = F.col("kind") == kind
        raw, rows = (F.when(here, size), F.when(here, own)) if raw is None else (raw.when(here, size), rows.when(here, own))
    return block_stats(table, columns).select("column", "block_id", "n", raw.alias("raw"), rows.alias("costs"))


def costs_of(table: DataFrame, columns: dict[str, str], config: Config) -> DataFrame:
    """(column, block_id, n, raw, scheme, priority, ratio) of the enabled schemes for columns of a table of blocks."""
    return _cost_rows(table, columns, config).withColumn("_c", F.explode("costs")).select("column", "block_id", "n", "raw", "_c.scheme", "_c.priority", "_c.ratio")


def choices_of(table: DataFrame, columns: dict[str, str], config: Config) -> DataFrame:
    """What ``choose`` makes of ``costs_of``; each row has all its costs, so nothing is grouped."""
    best = _cost_rows(table, columns, config).withColumn("_c", F.array_max("costs"))
    return _worth(best.select("column", "block_id", "n", "raw", "_c.scheme", "_c.ratio"))


def _worth(choice: DataFrame) -> DataFrame:
    return choice.withColumn("ratio", F.when(F.col("ratio") >= 1, F.col("ratio")).otherwise(F.raise_error(F.lit("no scheme reaches a ratio of 1")).cast("double")))


def choose(costs: DataFrame, overrides: dict | None = None) -> DataFrame:
    """(column, block_id, n, raw, scheme, ratio): the highest ratio, of equals the higher scheme code; an override wins.

    Raises if no scheme reaches a ratio of 1.
    """
    rank = F.struct("ratio", "priority")
    if overrides:
        forced = F.lit(False)
        for (column, path), scheme in overrides.items():
            if path in ("", "root"):
                forced = forced | ((F.col("column") == column) & (F.col("scheme") == scheme))
        rank = F.struct(forced, "ratio", "priority")
    best = costs.groupBy("column", "block_id").agg(F.max_by(F.struct("n", "raw", "scheme", "ratio"), rank).alias("b")).select("column", "block_id", "b.*")
    return best if overrides else _worth(best)


def compressed_size(choice: DataFrame) -> DataFrame:
    return choice.withColumn("compressed", F.ceil(F.round(F.col("raw") / F.col("ratio"), 4)).cast("long"))
