"""Id and row-number samples, rebalanced sets, exact stratified samples and reject inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn, reweight as rw, sampling as sa
from ..operators.ordering import with_row_number
from .registry import load, query, tidy

SEED = 11


def score_sql(key: str, seed: int = SEED) -> str:
    return f"((({key} + {seed}) % 2147483648) * 2654435761) % 4294967296"


def _score(key: str):
    return sa.arithmetic_score(F.col(key), SEED)


@query("sample_by_ids", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def sample_by_ids(spark, sf_dir):
    customer, events = load(spark, sf_dir, "customer", "events")
    return jn.sample_by_ids(customer.select("c_custkey", "c_acctbal"), events.select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query(
    "split_by_ids",
    """
    SELECT 'train' AS part, p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_partkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'test', p_partkey, p_size::BIGINT FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)
    """,
)
def split_by_ids(spark, sf_dir):
    """Training and test rows from two saved id lists."""
    part, customer = load(spark, sf_dir, "part", "customer")
    train_ids = customer.select(F.col("c_custkey").alias("p_partkey"))
    test_ids = part.join(train_ids, "p_partkey", "left_anti")
    train, test = sa.split_by_ids(part.select("p_partkey", "p_size"), train_ids, test_ids, "p_partkey")
    return tidy(jn.union_all(*[t.select(F.lit(n).alias("part"), "*") for n, t in (("train", train), ("test", test))]))


@query(
    "sample_by_rownum",
    """
    WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F')
    SELECT o_orderkey, o_totalprice FROM n WHERE rn IN (SELECT s_suppkey FROM supplier)
    """,
)
def sample_by_rownum(spark, sf_dir):
    """Rows of one group whose position in key order is on a list."""
    orders, supplier = load(spark, sf_dir, "orders", "supplier")
    group = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return jn.sample_by_rownum(group, supplier.select(F.col("s_suppkey").alias("row_number")), "o_orderkey")


@query(
    "row_numbers",
    "SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS row_number FROM orders",
)
def row_numbers(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    return with_row_number(orders.select("o_orderstatus", "o_orderkey"), "o_orderkey", groups=["o_orderstatus"])


def _ranked(extra: str = "") -> str:
    return (
        f"r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {score_sql('o_orderkey')}, o_orderkey) AS rk, "
        f"count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders {extra})"
    )


@query(
    "undersample_minority",
    f"""
    WITH {_ranked()}, s AS (SELECT count(*) // 4 AS size FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey, o_orderstatus FROM r, s WHERE o_orderstatus <> 'P' OR rk <= size
    """,
)
def undersample_minority(spark, sf_dir):
    """One group cut to a quarter, the others whole."""
    (orders,) = load(spark, sf_dir, "orders")
    size = orders.filter("o_orderstatus = 'P'").count() // 4
    return sa.undersample(orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"P": size}, "o_orderkey", _score("o_orderkey"))


@query(
    "rebalance",
    f"""
    WITH {_ranked()} SELECT o_orderkey, o_totalprice FROM r WHERE rk <= (SELECT min(n) FROM r)
    """,
)
def rebalance(spark, sf_dir):
    """Equal group sizes by undersampling, without the protected attribute."""
    (orders,) = load(spark, sf_dir, "orders")
    picked = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sa.blind(sa.rebalance(picked, "o_orderstatus", "o_orderkey", _score("o_orderkey")), "o_orderstatus")


@query(
    "rebalance_collect",
    f"""
    WITH {_ranked()}, s AS (SELECT count(*) // 5 AS base, count(*) // 3 AS extra FROM orders WHERE o_orderstatus = 'P')
    SELECT o_orderkey, o_orderstatus FROM r, s WHERE o_orderstatus IN ('P', 'F') AND rk <= base + extra
    """,
)
def rebalance_collect(spark, sf_dir):
    """The minority sample grown with further rows, and as many majority rows."""
    (orders,) = load(spark, sf_dir, "orders")
    n = orders.filter("o_orderstatus = 'P'").count()
    return sa.rebalance_collect(
        orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "P", "F", n // 5, n // 3, "o_orderkey", _score("o_orderkey")
    )


@query(
    "rebalance_by_rownum",
    """
    WITH n AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, o_orderstatus FROM n
    WHERE (o_orderstatus = 'F' AND rn IN (SELECT s_suppkey FROM supplier)) OR (o_orderstatus = 'P' AND rn IN (SELECT p_partkey FROM part))
    """,
)
def rebalance_by_rownum(spark, sf_dir):
    """Saved row-number lists, one per group."""
    orders, supplier, part = load(spark, sf_dir, "orders", "supplier", "part")
    lists = {
        "F": supplier.select(F.col("s_suppkey").alias("row_number")),
        "P": part.select(F.col("p_partkey").alias("row_number")),
    }
    return sa.rebalance_by_rownum(orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", lists, "o_orderkey")


@query(
    "stratified_exact",
    f"""
    WITH t AS (SELECT l_orderkey * 64 + l_linenumber AS k, l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {score_sql('k')}, k, l_quantity, l_extendedprice) AS rk,
                 count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM t)
    SELECT k, l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM r WHERE rk <= n // 3
    """,
)
def stratified_exact(spark, sf_dir):
    """A third of every stratum, to the row; lines of equal number are ranked by their amounts."""
    (lines,) = load(spark, sf_dir, "lineitem")
    amounts, strata = ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"]
    keyed = lines.select((F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("k"), *strata, *amounts)
    sizes = keyed.groupBy(*strata).agg(F.floor(F.count(F.lit(1)) / 3).alias("size"))
    return sa.stratified_exact(keyed, strata, sizes, ["k", *amounts], score=_score("k"))


APPROVED = "o_orderstatus <> 'P'"
STRATA = ["o_orderpriority", "band"]
WEIGHTS = """
    t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, cast(floor(o_totalprice / 100000) AS BIGINT) AS band FROM orders),
    a AS (SELECT o_orderpriority, band, count(*) / (SELECT count(*) FROM t)::DOUBLE AS p FROM t GROUP BY ALL),
    b AS (SELECT o_orderpriority, band, count(*) / (SELECT count(*) FROM t WHERE o_orderstatus <> 'P')::DOUBLE AS p FROM t WHERE o_orderstatus <> 'P' GROUP BY ALL),
    c AS (SELECT o_orderpriority, band, a.p / b.p AS ratio FROM a JOIN b USING (o_orderpriority, band)),
    n AS (SELECT o_orderpriority, band, count(*) AS n FROM t GROUP BY ALL),
    w AS (SELECT o_orderpriority, band, n, ratio, n * ratio AS up, cast(round_even(n * ratio / (SELECT max(ratio) FROM c), 0) AS BIGINT) AS weight
          FROM n LEFT JOIN c USING (o_orderpriority, band))
"""


def _populations(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    everyone = orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 100000).alias("band")
    )
    return everyone, everyone.filter(APPROVED)


@query(
    "strata_weights",
    f"WITH {WEIGHTS} SELECT o_orderpriority, band, n, round(ratio, 8) AS ratio, round(up, 6) AS up, weight FROM w",
)
def strata_weights(spark, sf_dir):
    """Cell sizes that move an approved-only population towards all applicants."""
    everyone, approved = _populations(spark, sf_dir)
    out = rw.augmentation_weights(everyone, approved, everyone, STRATA)
    return out.select(*STRATA, "n", F.round("ratio", 8).alias("ratio"), F.round("up", 6).alias("up"), "weight")


@query(
    "attach_strata_weight",
    f"""
    WITH {WEIGHTS} SELECT t.o_orderkey, t.o_orderpriority, t.band, coalesce(w.weight, 0) AS weight
    FROM t LEFT JOIN w ON w.o_orderpriority = t.o_orderpriority AND w.band = t.band AND w.band > 0
    """,
)
def attach_strata_weight(spark, sf_dir):
    everyone, approved = _populations(spark, sf_dir)
    weights = rw.augmentation_weights(everyone, approved, everyone, STRATA).filter("band > 0")
    return jn.attach_strata_weight(everyone.select("o_orderkey", *STRATA), weights, STRATA, "weight")


@query(
    "reject_inference",
    f"""
    WITH {WEIGHTS}, r AS (SELECT t.*, row_number() OVER (PARTITION BY o_orderpriority, band ORDER BY {score_sql('o_orderkey')}, o_orderkey) AS rk FROM t)
    SELECT r.o_orderkey, r.o_orderpriority, r.band FROM r JOIN w USING (o_orderpriority, band) WHERE rk <= weight
    """,
)
def reject_inference(spark, sf_dir):
    """Weights, then an exact resample without replacement."""
    everyone, approved = _populations(spark, sf_dir)
    target = everyone.select("o_orderkey", *STRATA)
    return rw.reject_inference_sample(everyone, approved, target, STRATA, "o_orderkey", _score("o_orderkey"))


@query(
    "reject_inference_check",
    f"""
    WITH {WEIGHTS}
    SELECT o_orderpriority, band, weight AS n, weight AS n_keys,
           round(weight / (sum(weight) OVER (PARTITION BY o_orderpriority))::DOUBLE, 9) AS prop
    FROM w WHERE weight > 0
    """,
)
def reject_inference_check(spark, sf_dir):
    """Cell counts, shares and distinct keys of the resample."""
    everyone, approved = _populations(spark, sf_dir)
    sample = rw.reject_inference_sample(everyone, approved, everyone, STRATA, "o_orderkey", _score("o_orderkey"))
    return tidy(rw.sample_check(sample, STRATA, "o_orderkey"), 9)
