"""Counts, shares, contingency tables and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as ag, frequency as fr, ordering as od
from .registry import load, query, tidy

HOLES = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority, o_totalprice FROM orders)"


def _orders(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        "o_totalprice",
    )


@query("freq_one_way", f"SELECT status, count(*) AS n FROM {HOLES} WHERE status IS NOT NULL GROUP BY status")
def freq_one_way(spark, sf_dir):
    return fr.freq(_orders(spark, sf_dir), "status", dropna=True)


@query("freq_two_way", f"SELECT status, priority, count(*) AS n FROM {HOLES} GROUP BY status, priority")
def freq_two_way(spark, sf_dir):
    return fr.freq(_orders(spark, sf_dir), "status", "priority")


@query(
    "freq_complete",
    """
    WITH d AS (SELECT p_type, p_brand, p_size FROM part),
    g AS (SELECT t.p_type, b.p_brand, s.p_size FROM (SELECT DISTINCT p_type FROM d) t, (SELECT DISTINCT p_brand FROM d) b, (SELECT DISTINCT p_size FROM d) s),
    n AS (SELECT p_type, p_brand, p_size, count(*) AS n FROM d GROUP BY ALL)
    SELECT g.p_type, g.p_brand, cast(g.p_size AS BIGINT) AS p_size, coalesce(n.n, 0) AS n
    FROM g LEFT JOIN n ON n.p_type = g.p_type AND n.p_brand = g.p_brand AND n.p_size = g.p_size
    """,
)
def freq_complete(spark, sf_dir):
    """Every combination of levels, with zeros."""
    (part,) = load(spark, sf_dir, "part")
    return tidy(fr.freq_complete(part, ["p_type", "p_brand", "p_size"]))


@query(
    "contingency_nway",
    """
    WITH d AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, nullif(c_nationkey, 3) AS nation
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3),
    g AS (SELECT * FROM (SELECT DISTINCT status FROM d), (SELECT DISTINCT priority FROM d), (SELECT DISTINCT segment FROM d), (SELECT DISTINCT nation FROM d)),
    n AS (SELECT status, priority, segment, nation, count(*) AS n FROM d GROUP BY ALL)
    SELECT g.status, g.priority, g.segment, cast(g.nation AS BIGINT) AS nation, coalesce(n.n, 0) AS n,
           round(coalesce(n.n, 0) / (SELECT count(*) FROM d)::DOUBLE, 9) AS prop
    FROM g LEFT JOIN n USING (status, priority, segment, nation)
    """,
)
def contingency_nway(spark, sf_dir):
    """Four-way table with zero cells and shares of the grand total; rows with a missing dimension are left out."""
    orders, customer = load(spark, sf_dir, "orders", "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.nullif("c_nationkey", F.lit(3)).alias("nation"),
    )
    dims = ["status", "priority", "segment", "nation"]
    return tidy(fr.contingency(joined, dims, normalize=True), 9)


@query(
    "prop_within",
    f"""
    SELECT status, priority, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY status))::DOUBLE, 9) AS prop
    FROM {HOLES} GROUP BY status, priority
    """,
)
def prop_within(spark, sf_dir):
    return tidy(fr.prop_within(_orders(spark, sf_dir), ["status", "priority"]), 9)


@query(
    "prop_one_key",
    f"SELECT status, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS prop FROM {HOLES} GROUP BY status",
)
def prop_one_key(spark, sf_dir):
    return tidy(fr.prop_within(_orders(spark, sf_dir), ["status"]), 9)


@query(
    "prop_total",
    f"""
    WITH d AS {HOLES}, g AS (SELECT * FROM (SELECT DISTINCT status FROM d WHERE status IS NOT NULL), (SELECT DISTINCT priority FROM d)),
    n AS (SELECT status, priority, count(*) AS n FROM d GROUP BY ALL),
    u AS (SELECT g.status, g.priority, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (status, priority)
          UNION ALL SELECT status, priority, n FROM n WHERE status IS NULL)
    SELECT status, priority, n, round(n / (SELECT count(*) FROM d)::DOUBLE, 9) AS prop FROM u
    """,
)
def prop_total(spark, sf_dir):
    return tidy(fr.prop_total(_orders(spark, sf_dir), ["status", "priority"], complete=True), 9)


@query(
    "share_by",
    """
    SELECT c_mktsegment, o_orderpriority, count(*) AS n,
           round(count(*) / (sum(count(*)) OVER (PARTITION BY c_mktsegment))::DOUBLE, 9) AS prop
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, o_orderpriority
    """,
)
def share_by(spark, sf_dir):
    """The table behind a stacked share chart."""
    orders, customer = load(spark, sf_dir, "orders", "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return tidy(fr.share_by(joined, "c_mktsegment", "o_orderpriority"), 9)


@query(
    "null_counts",
    f"""
    SELECT 'status' AS "column", count(*) FILTER (WHERE status IS NULL) AS n_missing FROM {HOLES}
    UNION ALL SELECT 'priority', count(*) FILTER (WHERE priority IS NULL) FROM {HOLES}
    UNION ALL SELECT 'o_orderkey', 0 UNION ALL SELECT 'o_totalprice', 0
    """,
)
def null_counts(spark, sf_dir):
    return ag.null_counts(_orders(spark, sf_dir))


def _profile_sql(table: str, cols: tuple[str, ...]) -> str:
    one = (
        "SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS n_missing, cast(min({c}) AS DOUBLE) AS min, "
        "round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(avg({c}), 6) AS mean, "
        "round(quantile_cont({c}, 0.75), 6) AS q3, cast(max({c}) AS DOUBLE) AS max FROM {t}"
    )
    return " UNION ALL ".join(one.format(c=c, t=table) for c in cols)


@query(
    "profile_columns",
    _profile_sql(
        "(SELECT cast(p_size AS DOUBLE) AS p_size, nullif(p_partkey, 5)::DOUBLE AS p_partkey FROM part)",
        ("p_size", "p_partkey"),
    ),
)
def profile_columns(spark, sf_dir):
    """Minimum, quartiles, mean, maximum and missing count per column."""
    (part,) = load(spark, sf_dir, "part")
    picked = part.select(F.col("p_size").cast("double").alias("p_size"), F.nullif("p_partkey", F.lit(5)).cast("double").alias("p_partkey"))
    return tidy(ag.profile(picked, ["p_size", "p_partkey"]), 6)


@query(
    "label_profile",
    """
    WITH l AS (SELECT 'p_brand' AS "column", coalesce(p_brand, '(Missing)') AS level FROM part UNION ALL SELECT 'p_type', coalesce(p_type, '(Missing)') FROM part
               UNION ALL SELECT 'size', coalesce(nullif(p_size, 7)::VARCHAR, '(Missing)') FROM part),
    c AS (SELECT "column", level, count(*) AS n FROM l GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS place FROM c)
    SELECT "column", place::INTEGER AS place, level, n FROM r WHERE place <= 6
    UNION ALL SELECT "column", 7, '(Other)', sum(n)::BIGINT FROM r WHERE place > 6 GROUP BY "column"
    """,
)
def label_profile(spark, sf_dir):
    """The six most frequent labels of each column, and the others together."""
    (part,) = load(spark, sf_dir, "part")
    picked = part.select("p_brand", "p_type", F.nullif("p_size", F.lit(7)).alias("size"))
    return ag.label_profile(picked, ["p_brand", "p_type", "size"])


@query(
    "distinct_counts",
    """
    SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS n_distinct FROM part
    UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part
    """,
)
def distinct_counts(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    return ag.distinct_counts(part, ["p_brand", "p_type", "p_name"])


@query("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    return ag.distinct_values(events, "event_type")


@query(
    "scalar_reductions",
    """
    SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers, max(o_totalprice) AS largest, min(o_totalprice) AS smallest,
           sum(floor(o_totalprice)::BIGINT)::BIGINT AS total, round(avg(floor(o_totalprice)), 4) AS mean
    FROM orders
    """,
)
def scalar_reductions(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    whole = F.floor("o_totalprice")
    return orders.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_custkey").alias("n_customers"),
        F.max("o_totalprice").alias("largest"),
        F.min("o_totalprice").alias("smallest"),
        F.sum(whole).alias("total"),
        F.round(F.avg(whole.cast("double")), 4).alias("mean"),
    )


@query(
    "top_importance",
    """
    SELECT l_partkey, cast(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_partkey
    ORDER BY quantity DESC, l_partkey LIMIT 9
    """,
)
def top_importance(spark, sf_dir):
    """The nine largest totals, equal ones by key."""
    (lines,) = load(spark, sf_dir, "lineitem")
    totals = lines.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return od.top_k(totals, "quantity", 9, ["l_partkey"])


@query(
    "quantiles_by_group",
    """
    SELECT l_returnflag, 'l_extendedprice' AS "column", count(*) AS n,
           round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
           round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
    FROM lineitem GROUP BY l_returnflag
    """,
)
def quantiles_by_group(spark, sf_dir):
    """Exact quantiles of groups that each hold a third of the rows."""
    (lines,) = load(spark, sf_dir, "lineitem")
    rows = od.exact_quantiles(lines, ["l_extendedprice"], [0.1, 0.5, 0.99], ["l_returnflag"])
    parts = [F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p50", "p99"))]
    return tidy(rows.select("l_returnflag", "column", "n", *parts), 4)
