"""Readers and writers: CSV with missing-value tokens, parquet, id lists, mapping tables, score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.missing import null_tokens


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    na_values: Sequence[str] | None = None,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    """Parquet by default, CSV when the path says so.

    A CSV with ``na_values`` is read as text; the tokens become NULL and each column is then cast to the
    schema's type (a value that does not fit becomes NULL). Without a schema CSV types are inferred, which
    costs a pass over the file.
    """
    if ".csv" not in path:
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    options = {"header": str(header).lower(), "sep": sep, "quote": '"', "escape": '"'}
    if na_values is None:
        reader = spark.read.options(**options)
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if schema is None:
        text = spark.read.options(**options).csv(path)
        return text.select(*[null_tokens(F.col(f"`{c}`"), na_values).alias(c) for c in text.columns])
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    text = spark.read.options(**options).schema(raw).csv(path)
    return text.select(
        *[null_tokens(F.col(f"`{f.name}`"), na_values).try_cast(f.dataType).alias(f.name) for f in wanted.fields]
    )


def read_id_list(spark: SparkSession, path: str, name: str = "row_number") -> DataFrame:
    """Headerless one-column list of ids."""
    return spark.read.schema(f"`{name}` bigint").option("header", "false").csv(path)


def read_mapping(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """Two label columns of a CSV mapping table, with blanks at the ends kept as they are."""
    table = (
        spark.read.option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    return table.select(old, new)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """CSV with a header when the path says so, parquet otherwise; there is no row-name column."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if ".csv" in path:
        writer.option("header", "true").csv(path)
    else:
        writer.parquet(path)


def write_scores(scored: DataFrame, path: str, key: str, score: str = "score", mode: str = "overwrite") -> None:
    """Keyed predictions."""
    write_table(scored.select(key, score), path, mode)
