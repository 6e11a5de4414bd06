"""Round trips through files: typed CSV with missing-value tokens, parquet, id lists, mapping tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..session import checkpoint_root
from ..sources import tables as io
from .registry import load, query, tidy


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/evenlend-files/{uuid.uuid4().hex}"


@query(
    "io_roundtrip",
    """
    SELECT 'csv' AS form, c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer
    UNION ALL SELECT 'parquet', c_custkey, c_mktsegment, c_acctbal FROM customer
    """,
)
def io_roundtrip(spark, sf_dir):
    """Missing values written as empty text or NA come back as NULL, with the declared types."""
    (customer,) = load(spark, sf_dir, "customer")
    picked = customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    folder = _folder(spark)
    text = picked.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_acctbal") < 0, F.lit("NA")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
    )
    io.write_table(text, f"{folder}/customer.csv")
    io.write_table(picked, f"{folder}/customer")
    schema = "c_custkey bigint, c_mktsegment string, c_acctbal double"
    back = io.read_table(spark, f"{folder}/customer.csv", schema, na_values=("", "NA"))
    same = io.read_table(spark, f"{folder}/customer", schema)
    return jn.union_all(back.withColumn("form", F.lit("csv")), same.withColumn("form", F.lit("parquet")))


@query(
    "io_lists",
    """
    WITH n AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
    SELECT c_custkey, coalesce(CASE WHEN r_name LIKE 'A%' THEN r_name || ', all' END, n_name) AS home
    FROM n JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE rn IN (SELECT s_suppkey FROM supplier)
    """,
)
def io_lists(spark, sf_dir):
    """A headerless list of row numbers and a mapping file with quoted commas, both read back and applied."""
    customer, supplier, nation, region = load(spark, sf_dir, "customer", "supplier", "nation", "region")
    folder = _folder(spark)
    supplier.select("s_suppkey").write.csv(f"{folder}/rows.csv", header=False)
    pairs = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).filter("r_name LIKE 'A%'")
    io.write_table(pairs.select(F.col("n_name").alias("old"), F.concat("r_name", F.lit(", all")).alias("new")), f"{folder}/map.csv")
    picked = jn.sample_by_rownum(customer, io.read_id_list(spark, f"{folder}/rows.csv"), "c_custkey")
    homes = picked.join(F.broadcast(nation), picked["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", F.col("n_name").alias("home"))
    return tidy(jn.recode_by_table(homes, "home", io.read_mapping(spark, f"{folder}/map.csv", "old", "new"), "old", "new"))
