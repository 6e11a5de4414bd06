import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evenlend.operators import trees as tr
from evenlend.plans import applicants as ap, augmentation as au, modelling as mo, presets as ps
from evenlend.sources import tables as io


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    people = range(1, 61)

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    bureau, balance, card, payments, cash, previous, train, test = ([] for _ in range(8))
    for p in people:
        for k in range(p % 4):
            loan = p * 10 + k
            bureau.append((p, loan, rng.choice(["currency 1", "currency 2"]), k))
            balance += [(loan, -m, rng.choice(["0", "1", "C", "X"])) for m in range(k)]
        for k in range(p % 3):
            card.append((p, p * 100 + k, float(k), rng.choice(["Active", "Signed"])))
            payments.append((p, p * 100 + k, -10 * k, -10 * k + 3, 100.0 * k, 0.0 if k == 0 else 90.0))
            cash.append((p, p * 100 + k, k + 1, rng.choice(["Active", "Completed"])))
            previous.append((p, p * 100 + k, rng.choice(["Cash", "Revolving"]), *[365243 if k else -5] * 5, 10.0, 20.0 * k))
        row = (
            p, rng.choice(["F", "M"]), 1000.0 + p, 5000.0 + p, 300.0, 4500.0, -9000 - p, 365243 if p % 7 == 0 else -700, p % 3, 2 + p % 3,
            None if p % 5 == 0 else 4.0, -30, *[None if p % 6 == 0 else rng.random() for _ in range(3)], rng.choice(["Bank", "School", None]), "Y", p % 2, 0, 1,
        )
        (train if p <= 45 else test).append((*row, int(rng.random() < 0.4)) if p <= 45 else row)
    base = (
        "SK_ID_CURR int, CODE_GENDER string, AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double, DAYS_BIRTH int, "
        "DAYS_EMPLOYED int, CNT_CHILDREN int, CNT_FAM_MEMBERS int, OWN_CAR_AGE double, DAYS_LAST_PHONE_CHANGE int, EXT_SOURCE_1 double, EXT_SOURCE_2 double, "
        "EXT_SOURCE_3 double, ORGANIZATION_TYPE string, FLAG_OWN_CAR string, FLAG_DOCUMENT_2 int, FLAG_DOCUMENT_3 int, FLAG_DOCUMENT_4 int"
    )
    sentinel = ", ".join(f"{c} int" for c in ps.PREVIOUS_SENTINEL_COLUMNS)
    return ap.LoanTables(
        frame(balance, "SK_ID_BUREAU int, MONTHS_BALANCE int, STATUS string"),
        frame(bureau, "SK_ID_CURR int, SK_ID_BUREAU int, CREDIT_CURRENCY string, CNT_CREDIT_PROLONG int"),
        frame(card, "SK_ID_CURR int, SK_ID_PREV int, AMT_DRAWINGS double, NAME_CONTRACT_STATUS string"),
        frame(payments, "SK_ID_CURR int, SK_ID_PREV int, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, AMT_PAYMENT double, AMT_INSTALMENT double"),
        frame(cash, "SK_ID_CURR int, SK_ID_PREV int, CNT_INSTALMENT int, NAME_CONTRACT_STATUS string"),
        frame(previous, f"SK_ID_CURR int, SK_ID_PREV int, NAME_CONTRACT_TYPE string, {sentinel}, AMT_APPLICATION double, AMT_CREDIT double"),
        frame(train, f"{base}, TARGET int"),
        frame(test, base),
    )


@pytest.fixture(scope="module")
def wide(tables):
    return ap.applicant_features(tables).cache()


def test_wide_table_keeps_one_row_per_applicant(wide):
    assert wide.count() == 60 and wide.filter("is_train").count() == 45
    assert wide.filter("NOT is_train AND Target IS NOT NULL").count() == 0


def test_wide_table_names_and_values(wide, tables):
    names = set(wide.columns)
    assert {"STATUS_min_n_distinct", "NAME_CONTRACT_STATUS_n_distinct_x", "NAME_CONTRACT_STATUS_n_distinct_y", "PAYMENT_PERC_mean"} <= names
    rows = {r["SK_ID_CURR"]: r for r in wide.collect()}
    assert rows[7]["DAYS_EMPLOYED"] is None and rows[8]["DAYS_EMPLOYED_PERC"] == pytest.approx(math.sqrt(700 / 9008))
    assert rows[1]["PAYMENT_PERC_mean"] is None  # 0/0 only: NaN is left out, nothing remains
    assert rows[1]["PAYMENT_PERC_sum"] == 0.0 and rows[1]["DPD_max"] == 3.0 and rows[1]["DBD_sum"] == 0.0
    assert rows[1]["APP_CREDIT_PERC_max"] is None  # 10/0 is infinite and cleaned
    assert rows[2]["DAYS_FIRST_DUE_n_distinct"] == 1  # the sentinel is not a value
    assert rows[6]["NEW_EXT_SOURCES_MEAN"] is None and rows[4]["NEW_SCORES_STD"] is not None
    scores = [rows[4][c] for c in ps.EXTERNAL_SCORES]
    assert rows[4]["NEW_SCORES_STD"] == pytest.approx(statistics.stdev(scores))
    assert rows[4]["DOC_IND_KURT"] == pytest.approx(1.5) and rows[4]["LIVE_IND_SUM"] == 1.0


def test_missing_count_is_taken_before_ratios(wide):
    rows = {r["SK_ID_CURR"]: r for r in wide.collect()}
    raw = [c for c in wide.columns[: wide.columns.index("na")] if c not in ("Target", "is_train", "DAYS_EMPLOYED")]
    assert rows[7]["na"] >= sum(rows[7][c] is None for c in raw) - sum("PERC" in c and rows[7][c] is None for c in raw)
    assert rows[7]["na"] > 0 and all(r["na"] >= 0 for r in rows.values())


def test_income_by_organisation_is_the_group_median(wide):
    groups = {}
    for r in wide.collect():
        groups.setdefault(r["ORGANIZATION_TYPE"], []).append(r)
    for org, rows in groups.items():
        want = None if org is None else statistics.median(r["AMT_INCOME_TOTAL"] for r in rows)
        assert {r["NEW_INC_BY_ORG"] for r in rows} == {want}


def test_training_sets(wide):
    sets = ap.training_sets(wide.filter("is_train"))
    sizes = {n: {r["CODE_GENDER"]: r["count"] for r in s.groupBy("CODE_GENDER").count().collect()} for n, s in sets.items() if "blind" not in n}
    men = sizes["minority"][2]
    assert sizes["minority"][1] == men // 4 and sizes["rebalanced"] == {1: men // 4, 2: men // 4}
    assert sizes["collected"][1] == sizes["collected"][2] > men // 4
    assert all("CODE_GENDER" not in s.columns for n, s in sets.items() if n.endswith("blind"))


def test_scorecard_table(wide):
    picked = wide.select("SK_ID_CURR", "Target", "CODE_GENDER", "AMT_INCOME_TOTAL", "EXT_SOURCE_1", "CNT_CHILDREN")
    out = ap.scorecard_table(picked, bins=4, merged={})
    assert {"CODE_GENDER", "EXT_SOURCE_1_NA"} <= set(out.columns) and "AMT_INCOME_TOTAL" not in out.columns
    flags = [c for c in out.columns if c.startswith(("AMT_INCOME", "EXT_", "CNT_"))]
    assert {v for r in out.select(*flags).collect() for v in r} == {"0", "1"} and out.count() == 60


def test_scorecard_rows_of_one_file_are_dealt_over_the_tasks(spark):
    rows = spark.range(4000).coalesce(1).selectExpr("id AS SK_ID_CURR", "int(id % 2) AS Target", "double(id) AS AMT_INCOME_TOTAL", "id % 3 AS CODE_GENDER")
    out = ap.scorecard_table(rows, merged={})
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1000 and sum(sizes) == 4000
    assert out.select("SK_ID_CURR").distinct().count() == 4000


@pytest.fixture(scope="module")
def lenders(spark, tmp_path_factory):
    rng = random.Random(9)
    test = [
        (i, rng.choice([1, 2]), -rng.randint(7000, 24000), rng.randint(1, 6), float(rng.randint(1, 400)), rng.choice([*range(1, 19), None]), rng.choice([0, 1]))
        for i in range(800)
    ]
    schema = "SK_ID_CURR int, CODE_GENDER int, DAYS_BIRTH int, NAME_FAMILY_STATUS int, AMT_INCOME_TOTAL double, OCCUPATION_TYPE int, Target int"
    raw = [o for group in ps.STATUS_GROUPS.values() for o in group]
    marital = [o for group in ps.MARITAL_GROUPS.values() for o in group]
    bank = [
        (
            rng.choice(["Female", "Male", "Unknown"]), rng.choice(marital), rng.choice(["chef ", "clerk, senior", "Laborers", None]), rng.choice(raw),
            float(rng.choice([30, 45, 61, -1, 1970, 180])), float(rng.randint(1, 900)), rng.choice([0, 1]),
        )
        for _ in range(900)
    ]
    folder = tmp_path_factory.mktemp("map")
    (folder / "map.csv").write_text('"","oldnames","newnames"\n1,"chef ","Cooking staff"\n2,"clerk, senior","Core staff"\n')
    mapping = io.read_mapping(spark, str(folder / "map.csv"), "oldnames", "newnames")
    bank_schema = "Gender string, Marital_Status string, Occupation string, Application_Status string, Age double, Income double, Loan_Default int"
    return au.harmonise_test(spark.createDataFrame(test, schema)), au.harmonise_second_lender(spark.createDataFrame(bank, bank_schema), mapping)


def test_populations_share_one_form(lenders):
    test, bank = lenders
    assert set(au.DIMENSIONS) <= set(test.columns) & set(bank.columns)
    assert {r[0] for r in bank.select("OCCUPATION_TYPE").distinct().collect()} == {"other", "Core staff", "Laborers", "unknown"}
    assert {r[0] for r in bank.select("CODE_GENDER").distinct().collect()} == {"women", "men", None}
    assert {r[0] for r in bank.select("YEARS_BIRTH").distinct().collect()} == {30.0, 45.0, 61.0, 51.0, None}
    assert "other" in {r[0] for r in test.select("OCCUPATION_TYPE").distinct().collect()}
    assert {r[0] for r in test.select("INCOME_BIN").distinct().collect()} <= {1, 2, 3, 4, None}


def test_decided_applications_only(lenders):
    everyone, approved = au.decided(lenders[1])
    assert {r[0] for r in everyone.select("APPLICATION_STATUS").distinct().collect()} == {"approved", "rejected"}
    assert 0 < approved.count() < everyone.count()


def test_joint_distribution_and_comparison(lenders):
    everyone, approved = au.decided(lenders[1])
    dims = ["CODE_GENDER", "INCOME_BIN", "Target"]
    table = au.joint_distribution(everyone, dims)
    assert table.agg(F.sum("prop")).first()[0] == pytest.approx(1.0) and table.count() == 2 * 4 * 2
    tests = au.compare_populations(everyone, approved)
    assert tests.filter("p_value < 0 or p_value > 1 or p_value is null").count() == 0
    assert tests.select("dimension").distinct().count() == 6


def test_augmented_test_set(lenders):
    test, bank = lenders
    everyone, approved = au.decided(bank)
    sample = au.augmented_test(test, everyone, approved, "SK_ID_CURR")
    assert 0 < sample.count() <= test.count() and sample.select("SK_ID_CURR").distinct().count() == sample.count()


def test_scorecard_and_boost_protocols(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        g, x = rng.choice(["1", "2"]), rng.gauss(0, 1)
        z = rng.gauss(0, 1)
        rows.append((i, g, x, z, int(rng.random() < 1 / (1 + math.exp(0.5 - 0.9 * x - 0.6 * (g == "2"))))))
    df = spark.createDataFrame(rows, "id int, g string, x double, z double, y int")
    report = mo.scorecard_protocol(df, df, ["g", "x", "z"], "g", "y", "id")
    values = {(r["model"], r["metric"]): r["value"] for r in report.metrics.collect()}
    assert values["aware", "auc"] > values["blind", "auc"] > 0.5 and report.test.first()["p_value"] < 0.05
    assert report.scores["blind"].count() == 900 and report.inflation.count() == 5
    numeric = df.withColumn("g", F.col("g").cast("int"))
    boost = mo.boost_protocol(numeric, numeric, ["g", "x", "z"], "g", "y", "id", tr.BoostParams(rounds=2, depth=2, step=0.3, min_weight=1, column_share=1.0, level_share=1.0))
    assert {r["model"] for r in boost.mean_shap.collect()} == {"aware", "blind"}
    assert boost.mean_shap.filter("model = 'blind' AND feature = 'g'").count() == 0
    assert boost.group_shap.select("group").distinct().count() == 2 and boost.scores["aware"].count() == 900


def test_stylised_counterfactual(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(1200):
        g, age = rng.choice([1, 2]), rng.gauss(40, 10)
        risk = 1 / (1 + math.exp(-(-1.5 + 0.02 * age + 0.5 * (g == 2))))
        rows.append((int(rng.random() < risk), g, rng.gauss(100, 10), rng.gauss(300, 30), age, rng.gauss(10, 3) if rng.random() > 0.1 else None))
    df = spark.createDataFrame(rows, "Target int, Gender int, Income double, Score double, Age double, Tenure double")
    scenarios = spark.createDataFrame([(100.0, 360.0, 60.0, 20.0), (100.0, 360.0, 65.0, 20.0)], "Income double, Score double, Age double, Tenure double")
    table, scored = mo.stylised_counterfactual(df, scenarios)
    assert {"Gender_2", "Gender_2:Age"} <= {r["term"] for r in table.collect()}
    for r in scored.collect():
        assert r["aware_1"] != r["aware_2"] and r["blind_1"] == r["blind_2"] and r["blind_gap"] == 0.0
