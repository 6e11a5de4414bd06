"""End-to-end jobs on the shared tables, mapped to the roles of the loan tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import applicants as ap, presets as ps
from .registry import codes_sql, load, query

SIX = ("mean", "sd", "min", "max", "sum", "n_distinct")
# The applicant columns by name, in SQL that both engines read: customers in the role of applicants.
BASE = {
    "SK_ID_CURR": "c_custkey",
    "CODE_GENDER": "CASE WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END",
    "AMT_INCOME_TOTAL": "floor(c_acctbal) + 1500.0",
    "AMT_CREDIT": "floor(c_acctbal * 3) + 9000.0",
    "AMT_ANNUITY": "c_nationkey * 100 + 50.0",
    "AMT_GOODS_PRICE": "CASE WHEN c_custkey % 11 = 0 THEN 0.0 ELSE c_custkey % 500 + 1.0 END",
    "DAYS_BIRTH": "-(7000 + c_custkey % 9000)",
    "DAYS_EMPLOYED": "CASE WHEN c_custkey % 7 = 0 THEN 365243 ELSE -(c_custkey % 3000 + 1) END",
    "CNT_CHILDREN": "c_custkey % 3",
    "CNT_FAM_MEMBERS": "c_custkey % 5",
    "OWN_CAR_AGE": "CASE WHEN c_custkey % 4 > 0 THEN c_nationkey + 0.0 END",
    "DAYS_LAST_PHONE_CHANGE": "-(c_custkey % 100)",
    "EXT_SOURCE_1": "CASE WHEN c_custkey % 6 > 0 THEN (c_custkey % 64) / 64.0 END",
    "EXT_SOURCE_2": "(c_custkey % 32) / 32.0",
    "EXT_SOURCE_3": "CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 16) / 16.0 END",
    "ORGANIZATION_TYPE": "CASE WHEN c_custkey % 13 > 0 THEN c_mktsegment END",
    "FLAG_DOCUMENT_2": "c_custkey % 2",
    "FLAG_DOCUMENT_3": "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END",
    "FLAG_DOCUMENT_4": "CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END",
    "FLAG_MOBIL": "1",
    "FLAG_PHONE": "c_custkey % 2",
}
SENTINELS = {c: f"CASE WHEN o_orderkey % {k} = 0 THEN 365243 ELSE -(o_orderkey % 40) END" for k, c in enumerate(ps.PREVIOUS_SENTINEL_COLUMNS, 2)}


def _kind(name: str) -> str:
    if name.startswith(("AMT", "OWN", "EXT")):
        return "double"
    return "string" if name in ("CODE_GENDER", "ORGANIZATION_TYPE") else "bigint"


def loan_tables(spark: SparkSession, sf_dir: str) -> ap.LoanTables:
    """Customers as applicants, orders as loans, lines as their monthly balances, events as card and cash movements."""
    customer, orders, lines, events = load(spark, sf_dir, "customer", "orders", "lineitem", "events")
    people = customer.select(*[F.expr(e).cast(_kind(n)).alias(n) for n, e in BASE.items()])
    trained = F.col("SK_ID_CURR") % 5 > 0
    train = people.filter(trained).withColumn("TARGET", (F.col("SK_ID_CURR") % 10 == 1).cast("int"))
    owner = F.col("o_custkey").alias("SK_ID_CURR")
    loan = F.col("o_orderkey").alias("SK_ID_PREV")
    seen = F.col("user_id").alias("SK_ID_CURR")
    moves = F.col("event_id").alias("SK_ID_PREV")
    return ap.LoanTables(
        lines.select(F.col("l_orderkey").alias("SK_ID_BUREAU"), F.col("l_linenumber").alias("MONTHS"), F.col("l_returnflag").alias("STATUS")),
        orders.select(owner, F.col("o_orderkey").alias("SK_ID_BUREAU"), F.floor("o_totalprice").cast("double").alias("DEBT"), F.col("o_orderstatus").alias("ACTIVE")),
        events.select(seen, moves, F.floor("value").cast("double").alias("DRAWN"), F.col("event_type").alias("CARD_STATUS")),
        orders.select(
            owner,
            loan,
            (F.col("o_orderkey") % 50).cast("int").alias("DAYS_INSTALMENT"),
            (F.col("o_orderkey") % 53).cast("int").alias("DAYS_ENTRY_PAYMENT"),
            F.floor("o_totalprice").cast("double").alias("AMT_PAYMENT"),
            (F.col("o_orderkey") % 4 * 1000.0 + 500.0).alias("AMT_INSTALMENT"),
        ),
        events.select(seen, moves, F.floor(F.col("value") / 2).cast("double").alias("CASH"), F.upper("event_type").alias("CASH_STATUS")),
        orders.select(
            owner,
            loan,
            F.col("o_orderpriority").alias("NAME_CONTRACT_TYPE"),
            *[F.expr(e).cast("int").alias(c) for c, e in SENTINELS.items()],
            F.floor("o_totalprice").cast("double").alias("AMT_APPLICATION"),
            (F.col("o_orderkey") % 3 * 700.0 + 300.0).alias("AMT_CREDIT"),
        ),
        train,
        people.filter(~trained),
    )


def _six(columns: dict[str, str], distinct: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """Select list of all summaries and their names; empty groups have infinite extremes."""
    forms = {
        "mean": "avg({v})",
        "sd": "stddev_samp({v})",
        "min": "coalesce(CAST(min({v}) AS DOUBLE), CAST('Infinity' AS DOUBLE))",
        "max": "coalesce(CAST(max({v}) AS DOUBLE), CAST('-Infinity' AS DOUBLE))",
        "sum": "coalesce(sum(CAST({v} AS DOUBLE)), 0)",
    }
    out, names = [], []
    for n, v in columns.items():
        counted = (distinct or {}).get(n, v)
        out += [f"{f.format(v=f'({v})')} AS {n}_{s}" for s, f in forms.items()] + [f"count(DISTINCT {counted}) AS {n}_n_distinct"]
        names += [f"{n}_{s}" for s in SIX]
    return ", ".join(out), names


def _applicant_sql() -> str:
    lines, inner = _six({"MONTHS": "l_linenumber", "STATUS": "f.code"})
    counted = {n: f"round(g.{n}, 9)" for n in inner if n.endswith(("_mean", "_sd"))}
    sides = {}
    sides["bureau"] = _six({"DEBT": "floor(o_totalprice)", "ACTIVE": "s.code", **{n: f"g.{n}" for n in inner}}, counted)
    sides["card"] = _six({"DRAWN": "floor(value)", "CARD_STATUS": "k.code"})
    paid = {"DAYS_INSTALMENT": "a", "DAYS_ENTRY_PAYMENT": "b", "AMT_PAYMENT": "p", "AMT_INSTALMENT": "i", "PAYMENT_PERC": "p / i"}
    sides["payments"] = _six({**paid, "PAYMENT_DIFF": "i - p", "DPD": "greatest(b - a, 0)", "DBD": "greatest(a - b, 0)"})
    sides["cash"] = _six({"CASH": "floor(value / 2)", "CASH_STATUS": "k.code"})
    prior = {"NAME_CONTRACT_TYPE": "s.code", **{c: f"nullif({e}, 365243)" for c, e in SENTINELS.items()}}
    price, credit = "floor(o_totalprice)", "(o_orderkey % 3 * 700.0 + 300.0)"
    sides["previous"] = _six({**prior, "AMT_APPLICATION": price, "AMT_CREDIT": credit, "APP_CREDIT_PERC": f"{price} / {credit}"})
    kinds = {"double": "DOUBLE", "string": "VARCHAR", "bigint": "BIGINT"}
    base = ", ".join(f"CAST({e} AS {kinds[_kind(n)]}) AS {n}" for n, e in BASE.items())
    coded = {"CODE_GENDER": "CASE CODE_GENDER WHEN 'F' THEN 1 WHEN 'M' THEN 2 END", "ORGANIZATION_TYPE": "o.code"}
    summaries = [n for _, names in sides.values() for n in names]
    whole = [n for n in summaries if n.endswith("_n_distinct")]
    missing = " + ".join(f"CASE WHEN {n} IS NULL THEN 1 ELSE 0 END" for n in [*BASE, *summaries])
    d = lambda a, b: f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"  # noqa: E731  zero denominators end as NULL
    root = lambda v: f"CASE WHEN {v} >= 0 THEN sqrt({v}) END"
    job = "nullif(DAYS_EMPLOYED, 365243)"
    mean = "((EXT_SOURCE_1 + EXT_SOURCE_2 + EXT_SOURCE_3) / 3)"
    docs = [f"FLAG_DOCUMENT_{k}" for k in (2, 3, 4)]
    squares = [f"power({c} * 3.0 - ({' + '.join(docs)}), 2)" for c in docs]
    m2, m4 = f"({' + '.join(squares)})", f"({' + '.join(f'{q} * {q}' for q in squares)})"
    derived = {
        "DAYS_EMPLOYED_PERC": root(d(job, "DAYS_BIRTH")),
        "INCOME_CREDIT_PERC": d("AMT_INCOME_TOTAL", "AMT_CREDIT"),
        "INCOME_PER_PERSON": f"ln(1 + {d('AMT_INCOME_TOTAL', 'CNT_FAM_MEMBERS')})",
        "ANNUITY_INCOME_PERC": root(d("AMT_ANNUITY", "(1 + AMT_INCOME_TOTAL)")),
        "LOAN_INCOME_RATIO": d("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "ANNUITY_LENGTH": d("AMT_CREDIT", "AMT_ANNUITY"),
        "CHILDREN_RATIO": d("CNT_CHILDREN", "CNT_FAM_MEMBERS"),
        "CREDIT_TO_GOODS_RATIO": d("AMT_CREDIT", "AMT_GOODS_PRICE"),
        "INC_PER_CHLD": d("AMT_INCOME_TOTAL", "(1 + CNT_CHILDREN)"),
        "SOURCES_PROD": "EXT_SOURCE_1 * EXT_SOURCE_2 * EXT_SOURCE_3",
        "CAR_TO_BIRTH_RATIO": d("OWN_CAR_AGE", "DAYS_BIRTH"),
        "CAR_TO_EMPLOY_RATIO": d("OWN_CAR_AGE", job),
        "PHONE_TO_BIRTH_RATIO": d("DAYS_LAST_PHONE_CHANGE", "DAYS_BIRTH"),
        "PHONE_TO_EMPLOY_RATIO": d("DAYS_LAST_PHONE_CHANGE", job),
        "NEW_EXT_SOURCES_MEAN": mean,
        "NEW_SCORES_STD": f"sqrt((power(EXT_SOURCE_1 - {mean}, 2) + power(EXT_SOURCE_2 - {mean}, 2) + power(EXT_SOURCE_3 - {mean}, 2)) / 2)",
        "DOC_IND_KURT": f"3.0 * {m4} / nullif({m2} * {m2}, 0)",
        "LIVE_IND_SUM": "CAST(FLAG_MOBIL + FLAG_PHONE AS DOUBLE)",
        "NEW_INC_BY_ORG": "med",
    }
    single = lambda v: f"CASE WHEN NOT isinf({v}) THEN CAST(CAST({v} AS REAL) AS DOUBLE) END"
    shown = [f"{single(f'CAST({n} AS DOUBLE)')} AS {n}" if _kind(n) == "double" else f"{coded.get(n, job if n == 'DAYS_EMPLOYED' else n)} AS {n}" for n in BASE]
    shown += [n if n in whole else f"{single(n)} AS {n}" for n in summaries]
    shown += [f"{single(f'({e})')} AS {n}" for n, e in derived.items()]
    joins = " ".join(f"LEFT JOIN {side} ON {side}.id = SK_ID_CURR" for side in sides)
    return f"""
    WITH base AS (SELECT {base}, c_custkey % 5 > 0 AS is_train, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 10 = 1 AS BIGINT) END AS Target FROM customer),
    g AS (SELECT l_orderkey, {lines} FROM lineitem LEFT JOIN {codes_sql('lineitem', 'l_returnflag')} f ON f.level = l_returnflag GROUP BY l_orderkey),
    bureau AS (SELECT o_custkey AS id, {sides['bureau'][0]} FROM orders LEFT JOIN g ON l_orderkey = o_orderkey
      LEFT JOIN {codes_sql('orders', 'o_orderstatus')} s ON s.level = o_orderstatus GROUP BY o_custkey),
    card AS (SELECT user_id AS id, {sides['card'][0]} FROM events LEFT JOIN {codes_sql('events', 'event_type')} k ON k.level = event_type GROUP BY user_id),
    payments AS (SELECT id, {sides['payments'][0]} FROM (
      SELECT o_custkey AS id, o_orderkey % 50 AS a, o_orderkey % 53 AS b, floor(o_totalprice) AS p, CAST(o_orderkey % 4 * 1000.0 + 500.0 AS DOUBLE) AS i FROM orders) GROUP BY id),
    cash AS (SELECT user_id AS id, {sides['cash'][0]} FROM events LEFT JOIN {codes_sql('events', 'event_type')} k ON k.level = event_type GROUP BY user_id),
    previous AS (SELECT o_custkey AS id, {sides['previous'][0]} FROM orders LEFT JOIN {codes_sql('orders', 'o_orderpriority')} s ON s.level = o_orderpriority GROUP BY o_custkey),
    o AS (SELECT ORGANIZATION_TYPE AS level, row_number() OVER (ORDER BY lower(ORGANIZATION_TYPE), ORGANIZATION_TYPE) AS code, median(AMT_INCOME_TOTAL) AS med
      FROM base WHERE ORGANIZATION_TYPE IS NOT NULL GROUP BY ORGANIZATION_TYPE)
    SELECT {', '.join(shown)}, CAST({missing} AS BIGINT) AS na, is_train, Target
    FROM base {joins} LEFT JOIN o ON o.level = ORGANIZATION_TYPE
    """


def _plain(wide: DataFrame) -> DataFrame:
    """Doubles of single precision and integers as bigint, so both engines print the same values."""
    kinds = dict(wide.dtypes)
    cell = {"double": lambda c: c.cast("float").cast("double"), "boolean": lambda c: c, "string": lambda c: c}
    return wide.select(*[cell.get(k, lambda c: c.cast("bigint"))(F.col(f"`{n}`")).alias(n) for n, k in kinds.items()])


APPLICANT_SQL = _applicant_sql()


@query("applicant_job", APPLICANT_SQL)
def applicant_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature job: five summaries per applicant, joined, counted, engineered and cleaned."""
    return _plain(ap.applicant_features(loan_tables(spark, sf_dir)))
