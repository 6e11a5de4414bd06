"""Named queries over the shared tables, each with an independent SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = ("features", "categories", "frequencies", "sampling", "testing", "models", "boosting", "storage", "jobs", "protocols")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def tidy(df: DataFrame, digits: int = 6, exact: Sequence[str] = ()) -> DataFrame:
    """Doubles rounded (but the ``exact`` ones), integers as bigint, so both engines print the same values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exact:
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def six_sql(expr: str, name: str, digits: int = 6, stats: Sequence[str] = ("mean", "sd", "min", "max", "sum", "n_distinct")) -> str:
    """The six summaries of one expression in SQL."""
    forms = {
        "mean": f"round(avg({expr}), {digits})",
        "sd": f"round(stddev_samp({expr}), {digits})",
        "min": f"round(cast(min({expr}) AS DOUBLE), {digits})",
        "max": f"round(cast(max({expr}) AS DOUBLE), {digits})",
        "sum": f"round(coalesce(sum(cast({expr} AS DOUBLE)), 0), {digits})",
        "n_distinct": f"count(DISTINCT {expr})",
    }
    return ", ".join(f"{forms[s]} AS {name}_{s}" for s in stats)


def codes_sql(table: str, col: str) -> str:
    """``level, code`` of a label column in case-insensitive order."""
    return (
        f"(SELECT level, row_number() OVER (ORDER BY lower(level), level) AS code "
        f"FROM (SELECT DISTINCT {col} AS level FROM {table} WHERE {col} IS NOT NULL))"
    )
