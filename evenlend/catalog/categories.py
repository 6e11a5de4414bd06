"""Scorecard preparation: relabelling, merging, dummies, level orders, binning, recoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import binning as bi, categorical as ca, joins as jn
from .registry import load, query, tidy


@query(
    "relabel_codes",
    """
    WITH r AS (SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY lower(o_orderpriority), o_orderpriority) AS k FROM orders)
    SELECT o_orderkey, CASE k WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN NULL WHEN 5 THEN 'low' END AS o_orderpriority
    FROM r
    """,
)
def relabel_codes(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    picked = orders.select("o_orderkey", "o_orderpriority")
    return ca.relabel(picked, "o_orderpriority", ["urgent", "high", "medium", None, "low"])


@query(
    "merge_collapse_levels",
    """
    SELECT p_partkey, CASE WHEN p_size BETWEEN 40 AND 50 THEN '40+' ELSE cast(p_size AS VARCHAR) END AS p_size,
           CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'compact' WHEN p_type IN ('LARGE', 'PROMO') THEN 'bulky'
                ELSE p_type END AS p_type,
           coalesce(nullif(p_brand, 'Brand#1'), 'unknown') AS p_brand
    FROM part
    """,
)
def merge_collapse_levels(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    picked = part.select("p_partkey", "p_size", "p_type", F.nullif("p_brand", F.lit("Brand#1")).alias("p_brand"))
    merged = ca.merge_levels(picked, "p_size", range(40, 51), "40+")
    collapsed = ca.collapse_levels(merged, "p_type", {"compact": ["SMALL", "MEDIUM"], "bulky": ["LARGE", "PROMO"]})
    return collapsed.withColumn("p_brand", sc.fill_label(F.col("p_brand")))


@query(
    "explicit_na_dummies",
    """
    WITH h AS (SELECT p_partkey, nullif(p_type, 'PROMO') AS t FROM part),
    top AS (SELECT t FROM h WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, lower(t), t LIMIT 1),
    levels AS (SELECT DISTINCT t AS level FROM h WHERE t IS NOT NULL AND t <> (SELECT t FROM top)),
    cells AS (
      SELECT p_partkey, 'p_type_' || level AS feature,
             coalesce(CASE WHEN t IS NULL THEN NULL WHEN t = level THEN '1' ELSE '0' END, '0') AS value FROM h, levels
      UNION ALL SELECT p_partkey, 'p_type_NA', CASE WHEN t IS NULL THEN '1' ELSE '0' END FROM h)
    SELECT * FROM cells
    """,
)
def explicit_na_dummies(spark, sf_dir):
    """Dummy columns without the most frequent level, as labels, with missing values made explicit."""
    (part,) = load(spark, sf_dir, "part")
    holes = part.select("p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("p_type"))
    wide = ca.ints_to_labels(ca.dummies(holes, ["p_type"]), exclude=["p_partkey"])
    names = [c for c in wide.columns if c != "p_partkey"]
    return ca.explicit_na(wide, names).unpivot(["p_partkey"], names, "feature", "value")


@query(
    "levels_by_frequency",
    """
    WITH n AS (SELECT p_type AS level, count(*) AS n FROM part GROUP BY p_type)
    SELECT level, n, row_number() OVER (ORDER BY n DESC, lower(level), level) AS ord FROM n
    """,
)
def levels_by_frequency(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    return tidy(ca.levels_by_freq(part, "p_type"))


@query(
    "locale_levels",
    """
    WITH m AS (SELECT DISTINCT CASE WHEN p_size > 40 THEN lower(p_type) WHEN p_size > 25 THEN p_type ELSE p_name END AS level FROM part)
    SELECT level, row_number() OVER (ORDER BY lower(level), level) AS ord FROM m
    """,
)
def locale_levels(spark, sf_dir):
    """Levels that differ only in case stay together."""
    (part,) = load(spark, sf_dir, "part")
    mixed = part.select(
        F.when(F.col("p_size") > 40, F.lower("p_type"))
        .when(F.col("p_size") > 25, F.col("p_type"))
        .otherwise(F.col("p_name"))
        .alias("label")
    )
    return tidy(ca.levels_sorted(mixed, "label"))


@query(
    "recode_by_table",
    """
    WITH map AS (SELECT n_name AS old, min(r_name) AS new FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 2 GROUP BY n_name)
    SELECT c_custkey, coalesce(map.new, n_name) AS home
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN map ON map.old = n_name
    """,
)
def recode_by_table(spark, sf_dir):
    """Labels replaced by a mapping table; labels it does not list stay."""
    customer, nation, region = load(spark, sf_dir, "customer", "nation", "region")
    mapping = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).filter("n_regionkey <> 2")
    homes = jn.lookup_join(
        customer.select("c_custkey", F.col("c_nationkey").alias("k")),
        nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("home")),
        "k",
        "inner",
    ).select("c_custkey", "home")
    return jn.recode_by_table(homes, "home", mapping, "n_name", "r_name")


@query(
    "bin_quantile",
    """
    WITH b AS (SELECT [quantile_cont(c_acctbal, i / 4.0) FOR i IN [0, 1, 2, 3, 4]] AS e FROM customer)
    SELECT c_custkey, c_acctbal,
           cast(CASE WHEN c_acctbal <= e[1] THEN NULL WHEN c_acctbal <= e[2] THEN 1 WHEN c_acctbal <= e[3] THEN 2
                WHEN c_acctbal <= e[4] THEN 3 WHEN c_acctbal <= e[5] THEN 4 END AS BIGINT) AS c_acctbal_bin
    FROM customer, b
    """.replace(
        "[quantile_cont(c_acctbal, i / 4.0) FOR i IN [0, 1, 2, 3, 4]]", "quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1])"
    ),
)
def bin_quantile(spark, sf_dir):
    """Four right-closed quantile bins; the minimum falls outside the first one."""
    (customer,) = load(spark, sf_dir, "customer")
    return tidy(bi.bin_quantile(customer.select("c_custkey", "c_acctbal"), "c_acctbal", 4, labels=False), exact=("c_acctbal",))


def _many_bins_sql() -> str:
    cols = ("l_quantity", "l_extendedprice", "l_tax", "l_discount")
    steps = ", ".join(str(i / 10) for i in range(11))
    breaks = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{steps}]))) AS b_{c}" for c in cols)
    index = ", ".join(
        f"CASE WHEN {c} > b_{c}[1] AND {c} <= b_{c}[len(b_{c})] "
        f"THEN len([x FOR x IN b_{c} IF x < {c}]) END AS {c}_bin"
        for c in cols
    )
    groups = ", ".join(f"{c}_bin" for c in cols)
    return f"""
    WITH b AS (SELECT {breaks} FROM lineitem), i AS (SELECT {index} FROM lineitem, b)
    SELECT {groups}, count(*) AS n FROM i GROUP BY {groups}
    """


@query("bin_quantile_many", _many_bins_sql())
def bin_quantile_many(spark, sf_dir):
    """Ten bins of several columns from one pass; equal edges collapse."""
    (lines,) = load(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_tax", "l_discount"]
    binned = bi.bin_quantile(lines.select(*cols), cols, 10, labels=False)
    return tidy(binned.groupBy(*[f"{c}_bin" for c in cols]).agg(F.count(F.lit(1)).alias("n")))


@query(
    "bin_pretty",
    """
    SELECT l_orderkey, l_linenumber, greatest(1, cast(ceil(l_quantity / 5) AS BIGINT)) AS l_quantity_bin,
           CASE WHEN l_quantity <= 5 THEN '[0,5]' ELSE '(' || cast((ceil(l_quantity / 5) - 1) * 5 AS INT) || ',' || cast(ceil(l_quantity / 5) * 5 AS INT) || ']' END AS l_quantity_label
    FROM (SELECT l_orderkey, cast(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem)
    """,
)
def bin_pretty(spark, sf_dir):
    """Ten intervals with round edges that cover 1..50: five wide, lowest edge included."""
    (lines,) = load(spark, sf_dir, "lineitem")
    binned = bi.bin_pretty(lines.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10)
    return tidy(binned.drop("l_quantity"))


def _long_dummies_sql() -> str:
    part = """
    SELECT l_orderkey, cast(l_linenumber AS BIGINT) AS l_linenumber, '{c}' AS "column", cast({c} AS VARCHAR) AS level FROM lineitem
    WHERE {c} IS NULL OR cast({c} AS VARCHAR) <> (
      SELECT v FROM (SELECT cast({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, lower(v), v LIMIT 1)
    """
    return " UNION ALL ".join(part.format(c=c) for c in ("l_orderkey", "l_returnflag"))


@query("dummies_many_levels", _long_dummies_sql())
def dummies_many_levels(spark, sf_dir):
    """Dummy columns of any number of levels in sparse form: an order key and a flag."""
    (lines,) = load(spark, sf_dir, "lineitem")
    keyed = lines.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("k"), "l_returnflag")
    long = ca.dummies_long(keyed, ["l_orderkey", "l_linenumber"], ["k", "l_returnflag"])
    return tidy(long.withColumn("column", F.when(F.col("column") == "k", "l_orderkey").otherwise(F.col("column"))))
