"""The stylised job, which SQL cannot fit, against a plain Newton fit."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from evenlend.catalog import registry

import __spark_entry__  # noqa: F401  registers the queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="tables not present")


def newton(x, y, steps=30):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    return beta


def test_stylised_job_matches_newton(spark):
    rows = duckdb.sql(
        f"""SELECT o_orderkey, cast(o_orderstatus = 'F' AS INT) AS y, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS second, o_totalprice / 100000 AS income,
            q / 100 AS score, n AS age, d * 10 AS tenure FROM '{SMALL}/orders.parquet'
            LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, round(avg(l_discount), 9) AS d FROM '{SMALL}/lineitem.parquet' GROUP BY ALL) ON l_orderkey = o_orderkey"""
    ).df()
    whole = rows.dropna()
    numeric = whole[["income", "score", "age", "tenure"]].to_numpy(float)
    ones, second, age = np.ones(len(whole)), whole["second"].to_numpy(float), whole["age"].to_numpy(float)
    y = whole["y"].to_numpy(float)
    blind_x = np.column_stack([ones, numeric])
    aware_x = lambda s: np.column_stack([ones, s, numeric, s * age])
    aware, blind = newton(aware_x(second), y), newton(blind_x, y)
    got = registry.QUERIES["stylised_job"](spark, SMALL).toPandas().set_index("o_orderkey")
    assert len(got) == len(rows)
    held = got.loc[whole["o_orderkey"]]
    for name, eta in (("aware_1", aware_x(0 * second) @ aware), ("aware_2", aware_x(0 * second + 1) @ aware), ("blind_1", blind_x @ blind)):
        assert np.abs(held[name].to_numpy(float) - 1 / (1 + np.exp(-eta))).max() < 2e-6
    assert (held["blind_gap"].astype(float) == 0).all()
    assert got.loc[rows[rows["score"].isna()]["o_orderkey"], "aware_1"].isna().all()
