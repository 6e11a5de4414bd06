"""Feature engineering: multi-level summaries, star joins, derived columns, row-wise statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import missing as m, rowwise as rw, scalars as sc
from ..operators import aggregate as ag, categorical as ca, columns as co, joins as jn
from .registry import codes_sql, load, query, six_sql, tidy

STATS = ("mean", "sd", "min", "max", "sum", "n_distinct")


@query(
    "six_stat_summary",
    f"""
    SELECT l_orderkey, {six_sql('l_quantity', 'l_quantity', 7)}, {six_sql('l_linenumber', 'l_linenumber', 7)},
           {six_sql('f.code', 'l_returnflag', 7)}, {six_sql('s.code', 'l_linestatus', 7)}
    FROM lineitem
    LEFT JOIN {codes_sql('lineitem', 'l_returnflag')} f ON f.level = l_returnflag
    LEFT JOIN {codes_sql('lineitem', 'l_linestatus')} s ON s.level = l_linestatus
    GROUP BY l_orderkey
    """,
)
def six_stat_summary(spark, sf_dir):
    (lines,) = load(spark, sf_dir, "lineitem")
    picked = lines.select("l_orderkey", "l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")
    return tidy(ag.encode_and_summarise(picked, "l_orderkey"), 7)


@query(
    "hot_group_summary",
    f"""
    SELECT l_returnflag, {six_sql('l_quantity', 'l_quantity', 4)}, {six_sql('l_partkey', 'l_partkey', 4)}
    FROM lineitem GROUP BY l_returnflag
    """,
)
def hot_group_summary(spark, sf_dir):
    """Three keys hold all rows: distinct counts go through the spread aggregate."""
    (lines,) = load(spark, sf_dir, "lineitem")
    return tidy(ag.summarise_all(lines, "l_returnflag", cols=["l_quantity", "l_partkey"], group_cells=10_000), 4)


def single_six(expr: str, name: str, counted: str | None = None) -> str:
    """The six summaries at single precision, which hides the summation order of either engine."""
    forms = {"mean": "avg({})", "sd": "stddev_samp({})", "min": "min({})", "max": "max({})", "sum": "coalesce(sum({}), 0)"}
    shown = [f"cast(cast({f.format(expr)} AS REAL) AS DOUBLE) AS {name}_{s}" for s, f in forms.items()]
    return ", ".join([*shown, f"count(DISTINCT {counted or expr}) AS {name}_n_distinct"])


def _nested_sql() -> str:
    inner_cols = {"l_quantity": "l_quantity", "l_linenumber": "l_linenumber", "l_returnflag": "f.code"}
    inner = ", ".join(
        f"avg({e}) AS {n}_mean, stddev_samp({e}) AS {n}_sd, min({e}) AS {n}_min, max({e}) AS {n}_max, "
        f"coalesce(sum(cast({e} AS DOUBLE)), 0) AS {n}_sum, count(DISTINCT {e}) AS {n}_n_distinct"
        for n, e in inner_cols.items()
    )
    outer = [single_six("floor(o_totalprice)", "o_totalprice"), single_six("c.code", "o_orderstatus")]
    outer += [
        single_six(f"g.{n}_{s}", f"{n}_{s}", f"round(g.{n}_{s}, 9)" if s in ("mean", "sd") else None)
        for n in inner_cols
        for s in STATS
    ]
    return f"""
    WITH g AS (
      SELECT l_orderkey, {inner} FROM lineitem
      LEFT JOIN {codes_sql('lineitem', 'l_returnflag')} f ON f.level = l_returnflag GROUP BY l_orderkey)
    SELECT o_custkey, {', '.join(outer)}
    FROM orders LEFT JOIN g ON g.l_orderkey = o_orderkey
    LEFT JOIN {codes_sql('orders', 'o_orderstatus')} c ON c.level = o_orderstatus
    GROUP BY o_custkey
    """


@query("nested_summary", _nested_sql())
def nested_summary(spark, sf_dir):
    """Lines summarised per order, attached to the orders, summarised again per customer."""
    lines, orders = load(spark, sf_dir, "lineitem", "orders")
    grand = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_linenumber", "l_returnflag")
    child = orders.select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    wide = ag.summarise_nested(grand, child, "o_orderkey", "o_custkey")
    return wide.select(
        "o_custkey",
        *[
            F.col(c).cast("bigint").alias(c) if c.endswith("n_distinct") else F.col(c).cast("float").cast("double").alias(c)
            for c in wide.columns
            if c != "o_custkey"
        ],
    )


@query(
    "star_features",
    f"""
    WITH base AS (
      SELECT c_custkey, c_nationkey, c_acctbal, c_acctbal >= 0 AS is_train FROM customer WHERE c_acctbal >= 0
      UNION ALL SELECT c_custkey, NULL, c_acctbal, false FROM customer WHERE c_acctbal < 0),
    o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY o_custkey),
    e AS (SELECT user_id, round(avg(value), 4) AS value_mean, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id)
    SELECT c_custkey, cast(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, is_train,
           o.n AS orders__n, o.hi AS orders__hi, e.value_mean AS events__value_mean, e.kinds AS events__kinds
    FROM base LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey
    """,
)
def star_features(spark, sf_dir):
    """Two applicant frames united, then joined with two one-row-per-applicant summaries."""
    customer, orders, events = load(spark, sf_dir, "customer", "orders", "events")
    train = customer.filter("c_acctbal >= 0").select("c_custkey", "c_nationkey", "c_acctbal")
    test = customer.filter("c_acctbal < 0").select("c_custkey", "c_acctbal")
    base = jn.union_marked(train, test)
    loans = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi")
    )
    history = events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.round(F.avg("value"), 4).alias("value_mean"), F.count_distinct("event_type").alias("kinds")
    )
    wide = jn.star_join(base, {"orders": loans, "events": history}, "c_custkey")
    return tidy(wide, 4, exact=("c_acctbal", "orders__hi"))


@query(
    "marked_split",
    """
    WITH u AS (SELECT o_orderkey, o_totalprice, avg(o_totalprice) OVER () AS m, o_orderstatus = 'F' AS is_train FROM orders)
    SELECT o_orderkey, o_totalprice > m AS above_all FROM u WHERE NOT is_train
    """,
)
def marked_split(spark, sf_dir):
    """Two frames united to compute over both, then one of them taken back."""
    (orders,) = load(spark, sf_dir, "orders")
    both = jn.union_marked(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"))
    mean = both.agg(F.avg("o_totalprice")).scalar()
    _, rest = jn.split_by_marker(both.withColumn("above_all", F.col("o_totalprice") > mean))
    return rest.select("o_orderkey", "above_all")


def _payment_sql() -> str:
    parts = []
    for n in ("ratio", "diff", "late", "early"):
        finite = f"FILTER (WHERE NOT isnan({n}) AND NOT isinf({n}))"
        blown = f"coalesce(bool_or(isinf({n})), false)"
        for stat, agg in (("mean", "avg"), ("sd", "stddev_samp"), ("sum", "sum")):
            value = f"{agg}({n}) {finite}"
            if stat == "sum":
                value = f"coalesce({value}, 0)"
            parts.append(f"CASE WHEN {blown} THEN NULL ELSE round({value}, 6) END AS {n}_{stat}")
        parts.append(f"CASE WHEN isinf(max({n}) FILTER (WHERE NOT isnan({n}))) THEN NULL ELSE round(max({n}) FILTER (WHERE NOT isnan({n})), 6) END AS {n}_max")
        parts.append(f"count(DISTINCT {n}) FILTER (WHERE NOT isnan({n})) AS {n}_n_distinct")
    return f"""
    WITH p AS (
      SELECT l_suppkey,
        CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END
             ELSE l_tax / l_discount END AS ratio,
        cast(l_quantity - l_linenumber AS DOUBLE) AS diff,
        cast(CASE WHEN l_quantity - 25 > 0 THEN l_quantity - 25 ELSE 0 END AS DOUBLE) AS late,
        cast(CASE WHEN 25 - l_quantity > 0 THEN 25 - l_quantity ELSE 0 END AS DOUBLE) AS early
      FROM lineitem)
    SELECT l_suppkey, {', '.join(parts)} FROM p GROUP BY l_suppkey
    """


@query("payment_features", _payment_sql())
def payment_features(spark, sf_dir):
    """Payment ratio with zero denominators, differences and positive parts, summarised and cleaned."""
    (lines,) = load(spark, sf_dir, "lineitem")
    derived = co.with_features(
        lines.select("l_suppkey", "l_tax", "l_discount", "l_quantity", "l_linenumber"),
        [
            ("ratio", m.ieee_div(F.col("l_tax"), F.col("l_discount"))),
            ("diff", F.col("l_quantity") - F.col("l_linenumber")),
            ("late", F.col("l_quantity") - 25),
            ("early", F.lit(25) - F.col("l_quantity")),
            ("late", m.positive_part(F.col("late"))),
            ("early", m.positive_part(F.col("early"))),
        ],
    )
    stats = ("mean", "sd", "sum", "max", "n_distinct")
    out = ag.summarise_all(derived, "l_suppkey", stats, ["ratio", "diff", "late", "early"])
    return tidy(m.clean_missing(out), 6)


@query(
    "sentinel_ratio",
    """
    WITH s AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50) AS q, l_extendedprice AS p, l_discount AS d FROM lineitem)
    SELECT l_orderkey, cast(l_linenumber AS BIGINT) AS l_linenumber, q AS quantity,
           round(sqrt(q / p), 6) AS root_ratio, round(ln(1 + p / q), 6) AS log_ratio,
           CASE WHEN d = 0 THEN NULL ELSE round(q / d, 4) END AS per_discount
    FROM s
    """,
)
def sentinel_ratio(spark, sf_dir):
    (lines,) = load(spark, sf_dir, "lineitem")
    q, p, d = F.col("quantity"), F.col("l_extendedprice"), F.col("l_discount")
    out = co.with_features(
        lines.select("l_orderkey", "l_linenumber", m.sentinel_to_null(F.col("l_quantity"), 50.0).alias("quantity"), p, d),
        [
            ("root_ratio", F.sqrt(m.ieee_div(q, p))),
            ("log_ratio", F.log1p(m.ieee_div(p, q))),
            ("per_discount", m.ieee_div(q, d)),
        ],
    )
    cleaned = m.clean_missing(out.drop("l_extendedprice", "l_discount"))
    return tidy(cleaned, 6).withColumn("per_discount", F.round("per_discount", 4))


@query(
    "row_missing_count",
    """
    SELECT o_orderkey, cast((CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) + (CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END)
           + (CASE WHEN o_totalprice < 1000 THEN 1 ELSE 0 END) + (CASE WHEN o_custkey < 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
    FROM orders
    """,
)
def row_missing_count(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    holes = orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.when(F.col("o_totalprice") < 1000, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") >= 100, F.col("o_custkey")).alias("customer"),
    )
    return tidy(holes.select("o_orderkey", rw.row_missing_count(holes).alias("n_missing")))


@query(
    "row_moments",
    """
    WITH f AS (
      SELECT l_orderkey, l_linenumber,
        cast(l_returnflag = 'R' AS INT) AS a, cast(l_linestatus = 'O' AS INT) AS b, cast(l_quantity > 25 AS INT) AS c,
        cast(l_tax = 0 AS INT) AS d, l_quantity AS x, nullif(l_tax, 0.08) * 100 AS y, l_discount * 100 AS z FROM lineitem),
    g AS (SELECT *, (a + b + c + d) / 4.0::DOUBLE AS m, (x + y + z) / 3 AS e FROM f),
    h AS (SELECT *, (a-m)**2 + (b-m)**2 + (c-m)**2 + (d-m)**2 AS s2, (a-m)**4 + (b-m)**4 + (c-m)**4 + (d-m)**4 AS s4 FROM g)
    SELECT l_orderkey, cast(l_linenumber AS BIGINT) AS l_linenumber, cast(a + b + c + d AS DOUBLE) AS flag_sum,
           CASE WHEN s2 = 0 THEN NULL ELSE round(4 * s4 / (s2 * s2), 6) END AS flag_kurtosis,
           round(e, 6) AS score_mean, round(sqrt(((x-e)**2 + (y-e)**2 + (z-e)**2) / 2), 6) AS score_sd
    FROM h
    """,
)
def row_moments(spark, sf_dir):
    (lines,) = load(spark, sf_dir, "lineitem")
    flags = lines.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("a"),
        (F.col("l_linestatus") == "O").cast("int").alias("b"),
        (F.col("l_quantity") > 25).cast("int").alias("c"),
        (F.col("l_tax") == 0).cast("int").alias("d"),
        F.col("l_quantity").alias("x"),
        (F.nullif("l_tax", F.lit(0.08)) * 100).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
    )
    return tidy(
        flags.select(
            "l_orderkey",
            "l_linenumber",
            rw.row_sum(["a", "b", "c", "d"]).alias("flag_sum"),
            rw.row_kurtosis(["a", "b", "c", "d"]).alias("flag_kurtosis"),
            rw.row_mean(["x", "y", "z"]).alias("score_mean"),
            rw.row_sd(["x", "y", "z"]).alias("score_sd"),
        )
    )


@query(
    "group_median_encode",
    """
    WITH h AS (SELECT c_custkey, nullif(c_nationkey, 3) AS nation, CASE WHEN c_nationkey = 7 AND c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer),
    g AS (SELECT nation, CASE WHEN count(*) = count(bal) THEN median(bal) END AS nation_median FROM h WHERE nation IS NOT NULL GROUP BY nation)
    SELECT c_custkey, cast(h.nation AS BIGINT) AS nation, bal, round(nation_median, 4) AS nation_median
    FROM h LEFT JOIN g ON g.nation = h.nation
    """,
)
def group_median_encode(spark, sf_dir):
    """Category replaced by its group median; a group with a missing value has none."""
    (customer,) = load(spark, sf_dir, "customer")
    holes = customer.select(
        "c_custkey",
        F.nullif("c_nationkey", F.lit(3)).alias("nation"),
        F.when((F.col("c_nationkey") == 7) & (F.col("c_acctbal") < 0), None).otherwise(F.col("c_acctbal")).alias("bal"),
    )
    return tidy(ag.encode_by_group_stat(holes, "nation", "bal", "nation_median"), 4, exact=("bal",))


@query(
    "clean_age",
    """
    WITH a AS (SELECT p_partkey, p_size * 42 - 60 AS raw FROM part),
    b AS (SELECT p_partkey, raw, CASE WHEN raw < 0 THEN NULL WHEN raw > 1900 THEN 2021 - raw ELSE raw END AS y FROM a)
    SELECT p_partkey, cast(raw AS BIGINT) AS raw, cast(CASE WHEN y > 100 THEN NULL ELSE y END AS BIGINT) AS age,
           round(abs(raw) * 0.002738::DOUBLE, 6) AS years
    FROM b
    """,
)
def clean_age(spark, sf_dir):
    (part,) = load(spark, sf_dir, "part")
    raw = part.select("p_partkey", (F.col("p_size") * 42 - 60).alias("raw"))
    return tidy(raw.select("*", sc.clean_age(F.col("raw")).alias("age"), sc.days_to_years(F.col("raw")).alias("years")))


@query(
    "select_columns",
    """
    SELECT l_orderkey, l_quantity, l_extendedprice * 2 AS l_extendedprice, l_discount, l_tax,
           upper(l_returnflag) || '!' AS l_returnflag, 'train' AS origin, cast(l_linenumber AS BIGINT) AS position
    FROM lineitem
    """,
)
def select_columns(spark, sf_dir):
    """Name lists, prefixes, regular expressions, type-directed maps, renames and constants."""
    (lines,) = load(spark, sf_dir, "lineitem")
    slim = co.drop_cols(lines, "l_shipdate", "l_partkey", "l_suppkey")
    picked = co.select_regex(slim, r"^l_(?!line)", also=["l_linenumber"])
    shouted = co.map_columns(picked, ["l_returnflag"], lambda c: F.concat(F.upper(c), F.lit("!")))
    scaled = co.map_columns(shouted, lambda f: f.name.endswith("price"), lambda c: c * 2)
    renamed = co.rename(scaled, {"l_linenumber": "position"})
    marked = co.with_constant(renamed, "origin", "train")
    front = co.select_prefix(marked, "l_", also=["origin"])
    return tidy(co.select_features(marked, [c for c in front.columns], "position"), exact=marked.columns)


@query(
    "filter_suite",
    """
    WITH h AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, o_orderpriority, o_totalprice FROM orders),
    kept AS (SELECT * FROM h WHERE status <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
    top AS (SELECT * FROM h WHERE o_totalprice = (SELECT max(o_totalprice) FROM h))
    SELECT 'kept' AS rule, o_orderkey FROM kept
    UNION ALL SELECT 'argmax', o_orderkey FROM top
    UNION ALL SELECT 'present', o_orderkey FROM h WHERE status IS NOT NULL
    UNION ALL SELECT 'finite', o_orderkey FROM h WHERE o_totalprice < 400000 AND o_totalprice >= 1000
    """,
)
def filter_suite(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    holes = orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        "o_orderpriority",
        "o_totalprice",
        F.when(F.col("o_totalprice") < 1000, F.lit(float("nan")))
        .when(F.col("o_totalprice") >= 400000, F.lit(float("inf")))
        .otherwise(F.col("o_totalprice"))
        .alias("edge"),
    )
    rules = {
        "kept": co.filter_any_match(co.filter_not_equal(holes, "status", "P"), "o_orderpriority", ["1-URGENT", "2-HIGH"]),
        "argmax": co.argmax_rows(holes, "o_totalprice"),
        "present": co.drop_missing(holes, ["status"]),
        "finite": holes.filter(m.is_finite(F.col("edge"))),
    }
    return jn.union_all(*[rows.select(F.lit(rule).alias("rule"), "o_orderkey") for rule, rows in rules.items()])


@query(
    "wide_to_long",
    """
    SELECT c_custkey, feature, value FROM (
      SELECT c_custkey, 'c_acctbal' AS feature, c_acctbal AS value FROM customer
      UNION ALL SELECT c_custkey, 'c_nationkey', cast(nullif(c_nationkey, 3) AS DOUBLE) FROM customer)
    """,
)
def wide_to_long(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    wide = customer.select("c_custkey", "c_acctbal", F.nullif("c_nationkey", F.lit(3)).cast("double").alias("c_nationkey"))
    return co.unpivot_columns(wide, "c_custkey", ["c_acctbal", "c_nationkey"])


@query(
    "encode_sorted",
    f"""
    SELECT c_custkey, s.code AS c_mktsegment, n.code AS c_name
    FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_name FROM customer) c
    LEFT JOIN {codes_sql("(SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)", 'seg')} s ON s.level = seg
    LEFT JOIN {codes_sql('customer', 'c_name')} n ON n.level = c_name
    """,
)
def encode_sorted(spark, sf_dir):
    """A short level list, and one that is as long as the table, coded in sorted order."""
    (customer,) = load(spark, sf_dir, "customer")
    holes = customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"), "c_name")
    return tidy(ca.encode_sorted(holes, ["c_mktsegment", "c_name"], cap=1000))


@query(
    "application_features",
    f"""
    WITH codes AS (SELECT p_partkey, t.code AS p_type, b.code AS p_brand, p_size, p_retailprice,
           nullif(p_size, 50) AS tenure
      FROM part LEFT JOIN {codes_sql('part', 'p_type')} t ON t.level = p_type
      LEFT JOIN {codes_sql('part', 'p_brand')} b ON b.level = p_brand),
    med AS (SELECT p_type, median(p_retailprice) AS m FROM codes GROUP BY p_type)
    SELECT p_partkey, c.p_type, p_brand, cast(p_size AS BIGINT) AS p_size, p_retailprice, cast(tenure AS BIGINT) AS tenure,
           round(sqrt(tenure / p_retailprice), 6) AS tenure_share, round(ln(1 + p_retailprice / tenure), 6) AS price_per_tenure,
           round(p_retailprice / p_size, 4) AS price_ratio, round(med.m, 4) AS type_median
    FROM codes c LEFT JOIN med ON med.p_type = c.p_type
    """,
)
def application_features(spark, sf_dir):
    """One applicant table through encoding, sentinels, ratios, group encoding and cleaning."""
    (part,) = load(spark, sf_dir, "part")
    coded = ca.encode_sorted(part.select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice"), ["p_type", "p_brand"])
    tenure, price = F.col("tenure"), F.col("p_retailprice")
    wide = co.with_features(
        coded,
        [
            ("tenure", m.sentinel_to_null(F.col("p_size"), 50)),
            ("tenure_share", F.sqrt(m.ieee_div(tenure, price))),
            ("price_per_tenure", F.log1p(m.ieee_div(price, tenure))),
            ("price_ratio", F.round(m.ieee_div(price, F.col("p_size")), 4)),
        ],
    )
    with_median = ag.encode_by_group_stat(wide, "p_type", "p_retailprice", "type_median")
    rounded = with_median.withColumn("type_median", F.round("type_median", 4))
    return tidy(m.clean_missing(rounded), 6, exact=("p_retailprice",))


def _feature_job_sql() -> str:
    inner = {"l_quantity": "l_quantity", "l_returnflag": "f.code"}
    first = ", ".join(
        f"avg({e}) AS {n}_mean, min({e}) AS {n}_min, max({e}) AS {n}_max, count(DISTINCT {e}) AS {n}_n_distinct"
        for n, e in inner.items()
    )

    def single(expr: str, name: str, stats: tuple[str, ...], counted: str | None = None) -> str:
        forms = {"mean": "avg({})", "min": "min({})", "max": "max({})"}
        shown = [f"cast(cast({forms[s].format(expr)} AS REAL) AS DOUBLE) AS {name}_{s}" for s in stats if s in forms]
        return ", ".join([*shown, f"count(DISTINCT {counted or expr}) AS {name}_n_distinct"])

    stats = ("mean", "min", "max", "n_distinct")
    second = [single("floor(o_totalprice)", "o_totalprice", stats)]
    second += [
        single(f"g.{n}_{s}", f"{n}_{s}", stats, f"round(g.{n}_{s}, 9)" if s == "mean" else None) for n in inner for s in stats
    ]
    loan_columns = [f"o_totalprice_{s}" for s in stats] + [f"{n}_{s}_{t}" for n in inner for s in stats for t in stats]
    event_columns = [f"{c}_{s}" for c in ("value", "event_type") for s in stats]
    loans = ", ".join(f"loans.{c} AS loans__{c}" for c in loan_columns)
    events = ", ".join(f"seen.{c} AS events__{c}" for c in event_columns)
    return f"""
    WITH g AS (SELECT l_orderkey, {first} FROM lineitem LEFT JOIN {codes_sql('lineitem', 'l_returnflag')} f ON f.level = l_returnflag GROUP BY l_orderkey),
    loans AS (SELECT o_custkey, {', '.join(second)} FROM orders LEFT JOIN g ON l_orderkey = o_orderkey GROUP BY o_custkey),
    seen AS (SELECT user_id, {single('floor(value)', 'value', stats)}, {single('k.code', 'event_type', stats)}
             FROM events LEFT JOIN {codes_sql('events', 'event_type')} k ON k.level = event_type GROUP BY user_id),
    base AS (SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey, floor(c_acctbal) AS c_acctbal, s.code AS c_mktsegment, c_acctbal >= 0 AS is_train
             FROM customer LEFT JOIN {codes_sql('customer', 'c_mktsegment')} s ON s.level = c_mktsegment),
    med AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM base GROUP BY c_mktsegment),
    wide AS (SELECT base.*, {loans}, {events} FROM base LEFT JOIN loans ON o_custkey = c_custkey LEFT JOIN seen ON user_id = c_custkey)
    SELECT wide.c_custkey, cast(wide.c_nationkey AS BIGINT) AS c_nationkey, cast(wide.c_acctbal AS DOUBLE) AS c_acctbal, wide.c_mktsegment, is_train,
           {', '.join(f'loans__{c}' for c in loan_columns)}, {', '.join(f'events__{c}' for c in event_columns)},
           cast((CASE WHEN wide.c_nationkey IS NULL THEN 1 ELSE 0 END) + {' + '.join(f'(CASE WHEN loans__{c} IS NULL THEN 1 ELSE 0 END)' for c in loan_columns)}
             + {' + '.join(f'(CASE WHEN events__{c} IS NULL THEN 1 ELSE 0 END)' for c in event_columns)} AS BIGINT) AS na,
           CASE WHEN wide.c_acctbal < 0 OR loans__o_totalprice_mean = 0 THEN NULL
                ELSE cast(cast(sqrt(wide.c_acctbal / loans__o_totalprice_mean) AS REAL) AS DOUBLE) END AS balance_share,
           CASE WHEN wide.c_nationkey = 0 THEN NULL ELSE cast(cast(loans__l_quantity_mean_mean / wide.c_nationkey AS REAL) AS DOUBLE) END AS quantity_ratio,
           cast(med.m AS DOUBLE) AS segment_median
    FROM wide LEFT JOIN med ON med.c_mktsegment = wide.c_mktsegment
    """


@query("feature_job", _feature_job_sql())
def feature_job(spark, sf_dir):
    """Three levels of tables to one cleaned applicant table: summaries, union, joins, counts, ratios, medians."""
    customer, orders, lines, events = load(spark, sf_dir, "customer", "orders", "lineitem", "events")
    stats = ("mean", "min", "max", "n_distinct")
    applicants = customer.select(
        "c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), F.floor("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment"
    )
    base = jn.union_marked(applicants.filter("c_acctbal >= 0"), applicants.filter("c_acctbal < 0"))
    base = ca.encode_sorted(base, ["c_mktsegment"])
    loans = ag.summarise_nested(
        lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_returnflag"),
        orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.floor("o_totalprice").cast("double").alias("o_totalprice")),
        "o_orderkey",
        "c_custkey",
        stats,
    )
    seen = ag.encode_and_summarise(
        events.select(F.col("user_id").alias("c_custkey"), F.floor("value").cast("double").alias("value"), "event_type"), "c_custkey", stats=stats
    )
    wide = jn.star_join(base, {"loans": loans, "events": seen}, "c_custkey")
    doubles = [c for c in wide.columns if c.endswith(("_mean", "_min", "_max"))]
    wide = co.map_columns(wide, doubles, lambda c: c.cast("float").cast("double"))
    wide = wide.withColumn("na", rw.row_missing_count(wide, [c for c in wide.columns if c != "is_train"]))
    derived = co.with_features(
        wide,
        [
            ("balance_share", F.sqrt(m.ieee_div(F.col("c_acctbal"), F.col("loans__o_totalprice_mean"))).cast("float").cast("double")),
            ("quantity_ratio", m.ieee_div(F.col("loans__l_quantity_mean_mean"), F.col("c_nationkey")).cast("float").cast("double")),
        ],
    )
    medians = ag.group_median(base, "c_mktsegment", "c_acctbal", out="segment_median")
    joined = jn.lookup_join(derived, medians, "c_mktsegment").select(*derived.columns, "segment_median")
    return tidy(m.clean_missing(joined), exact=joined.columns)


@query(
    "reattach_ids",
    """
    WITH f AS (SELECT o_custkey, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey)
    SELECT c_custkey, largest FROM customer LEFT JOIN f ON o_custkey = c_custkey
    """,
)
def reattach_ids(spark, sf_dir):
    """Processed features put back on a saved id frame; customers without orders stay."""
    customer, orders = load(spark, sf_dir, "customer", "orders")
    features = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("largest"))
    return jn.reattach(customer, features, "c_custkey")
