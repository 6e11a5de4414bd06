"""Two-population tests on aggregated counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.formulas import chi2_1df_p, kolmogorov_exact, kolmogorov_tail
from .ordering import BUCKET, bucket_edges, running_totals, values_long


# Samples whose sizes multiply to less get the exact p-value of the two-sample test.
EXACT_PRODUCT = 10_000


def yates_statistic(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Chi-square statistic of a two-sample proportion test with continuity correction."""
    x1, n1, x2, n2 = (c.cast("double") for c in (x1, n1, x2, n2))
    pooled = (x1 + x2) / (n1 + n2)
    gap = F.abs(F.try_divide(x1, n1) - F.try_divide(x2, n2))
    shift = F.least(F.lit(0.5), F.try_divide(gap, 1.0 / n1 + 1.0 / n2))
    total = F.lit(0.0)
    for x, n in ((x1, n1), (x2, n2)):
        for seen, expected in ((x, n * pooled), (n - x, n * (1.0 - pooled))):
            off = F.abs(seen - expected) - shift
            total = total + F.try_divide(off * off, expected)
    return total


def prop_test(cells: DataFrame, x1: str = "x1", n1: str = "n1", x2: str = "x2", n2: str = "n2") -> DataFrame:
    """Adds ``p1, p2, statistic, p_value`` to a table of counts; one row per test."""
    cols = [F.col(c) for c in (x1, n1, x2, n2)]
    tested = cells.withColumns(
        {
            "p1": F.try_divide(cols[0].cast("double"), cols[1].cast("double")),
            "p2": F.try_divide(cols[2].cast("double"), cols[3].cast("double")),
            "statistic": yates_statistic(*cols),
        }
    )
    return tested.withColumn("p_value", chi2_1df_p("statistic"))


def prop_test_by(df_a: DataFrame, df_b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Tests every cell of ``cols`` for equal shares in two populations; denominators are whole populations.

    Both populations are counted in one aggregate, so a missing value is a cell like any other.
    """
    names = list(cols)
    marks = [df.select(*names, F.lit(a).alias("a"), F.lit(b).alias("b")) for df, a, b in ((df_a, 1, 0), (df_b, 0, 1))]
    cells = marks[0].unionByName(marks[1]).groupBy(*names).agg(F.sum("a").alias("x1"), F.sum("b").alias("x2"))
    sizes = cells.withColumns(
        {"n1": df_a.agg(F.count(F.lit(1))).scalar(), "n2": df_b.agg(F.count(F.lit(1))).scalar()}
    )
    return prop_test(sizes)


def ks_2samp(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: one row ``n1, n2, d, p_value``.

    Equal values collapse to one row with two counts before anything is ordered. The p-value is exact, ties included, when
    ``n1 * n2`` is below ``EXACT_PRODUCT`` (the steps of such samples are few), asymptotic otherwise.
    """
    both = a.select(F.col(col).cast("double").alias("v"), F.lit(1).alias("s")).unionAll(
        b.select(F.col(col).cast("double").alias("v"), F.lit(2).alias("s"))
    )
    long = values_long(both, ["v"], ["s"], bucket_edges(both, ["v"]))
    points = long.groupBy("value", BUCKET).agg(
        F.count_if(F.col("s") == 1).alias("n_a"), F.count_if(F.col("s") == 2).alias("n_b")
    )
    steps = running_totals(
        points, "value", {"cum_a": F.col("n_a"), "cum_b": F.col("n_b")}, bucket=BUCKET, with_group_total=True
    )
    distance = F.abs(F.col("cum_a") / F.col("cum_a_all") - F.col("cum_b") / F.col("cum_b_all"))
    row = steps.agg(
        F.max("cum_a_all").alias("n1"), F.max("cum_b_all").alias("n2"), F.max(distance).alias("d")
    ).first()
    if row["d"] is None:
        p = None
    elif row["n1"] * row["n2"] < EXACT_PRODUCT:
        p = kolmogorov_exact([(r["n_a"], r["n_b"]) for r in steps.orderBy("value").select("n_a", "n_b").collect()])
    else:
        p = kolmogorov_tail(row["d"], row["n1"], row["n2"])
    return a.sparkSession.createDataFrame(
        [(row["n1"], row["n2"], row["d"], p)], "n1 bigint, n2 bigint, d double, p_value double"
    )
