"""Feature job: eight loan tables into one wide applicant table, and its training and test sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import missing as m, rowwise as rw
from ..operators import aggregate as ag, categorical as ca, columns as co, joins as jn, sampling as sa
from ..operators.binning import apply_bins, quantile_breaks
from ..operators.ordering import spread_rows
from ..session import cut_lineage
from . import presets as ps

KEY = "SK_ID_CURR"
LOAN = "SK_ID_PREV"
LABEL = "Target"
MARKER = "is_train"


@dataclass(frozen=True)
class LoanTables:
    """The input tables by role; column names follow the public competition data."""

    bureau_balance: DataFrame
    bureau: DataFrame
    card_balance: DataFrame
    payments: DataFrame
    cash_balance: DataFrame
    previous: DataFrame
    train: DataFrame
    test: DataFrame


def payment_summary(payments: DataFrame, infinite_empty: bool = True) -> DataFrame:
    paid, due = F.col("AMT_PAYMENT"), F.col("AMT_INSTALMENT")
    entered, planned = F.col("DAYS_ENTRY_PAYMENT"), F.col("DAYS_INSTALMENT")
    derived = co.with_features(
        payments.drop(LOAN),
        [
            ("PAYMENT_PERC", m.ieee_div(paid, due)),
            ("PAYMENT_DIFF", due - paid),
            ("DPD", m.positive_part(entered - planned)),
            ("DBD", m.positive_part(planned - entered)),
        ],
    )
    return ag.summarise_all(derived, KEY, counts_from=payments, infinite_empty=infinite_empty)


def previous_summary(previous: DataFrame, infinite_empty: bool = True) -> DataFrame:
    coded = ca.encode_sorted(previous.drop(LOAN), co.columns_of_type(previous, T.StringType, exclude=[KEY, LOAN]))
    derived = co.map_columns(coded, ps.PREVIOUS_SENTINEL_COLUMNS, lambda c: m.sentinel_to_null(c, ps.DAY_SENTINEL))
    ratio = m.ieee_div(F.col("AMT_APPLICATION"), F.col("AMT_CREDIT"))
    widened = derived.withColumn("APP_CREDIT_PERC", ratio)
    return ag.summarise_all(widened, KEY, counts_from=previous, infinite_empty=infinite_empty)


def applicant_features(
    tables: LoanTables, suffixes: tuple[str, str] | None = ("_x", "_y"), infinite_empty: bool = True
) -> DataFrame:
    """Wide applicant table with ``Target`` (NULL for the test side) and ``is_train``.

    Children are summarised per applicant before any join. All five joins use the applicant key, on which
    the summaries are already partitioned. With ``infinite_empty`` groups without values have infinite extremes while
    missing cells are counted (``na``), as in the study; they end as NULL either way.
    """
    train = tables.train.withColumnRenamed("TARGET", LABEL)
    base = jn.union_marked(train, tables.test, MARKER)
    base = ca.encode_sorted(base, co.columns_of_type(base, T.StringType, exclude=[KEY]))
    sides = {
        "bureau": ag.summarise_nested(tables.bureau_balance, tables.bureau, "SK_ID_BUREAU", KEY, infinite_empty=infinite_empty),
        "card": ag.encode_and_summarise(tables.card_balance, KEY, [LOAN], infinite_empty=infinite_empty),
        "payments": payment_summary(tables.payments, infinite_empty),
        "cash": ag.encode_and_summarise(tables.cash_balance, KEY, [LOAN], infinite_empty=infinite_empty),
        "previous": previous_summary(tables.previous, infinite_empty),
    }
    wide = jn.star_join(base, sides, KEY, suffixes)
    counted = [c for c in wide.columns if c not in (LABEL, MARKER)]
    wide = wide.withColumn("na", rw.row_missing_count(wide, counted))

    income, credit, annuity = F.col("AMT_INCOME_TOTAL"), F.col("AMT_CREDIT"), F.col("AMT_ANNUITY")
    employed, born, family = F.col("DAYS_EMPLOYED"), F.col("DAYS_BIRTH"), F.col("CNT_FAM_MEMBERS")
    children, car, phone = F.col("CNT_CHILDREN"), F.col("OWN_CAR_AGE"), F.col("DAYS_LAST_PHONE_CHANGE")
    first, second, third = (F.col(c) for c in ps.EXTERNAL_SCORES)
    documents = co.names_matching(tables.train, ps.DOCUMENT_FLAGS)
    contacts = co.names_matching(tables.train, ps.CONTACT_FLAGS)
    # Names and formulas of the study's engineered columns.
    derived = co.with_features(
        wide.withColumn("DAYS_EMPLOYED", m.sentinel_to_null(employed, ps.DAY_SENTINEL)),
        [
            ("DAYS_EMPLOYED_PERC", F.sqrt(m.ieee_div(employed, born))),
            ("INCOME_CREDIT_PERC", m.ieee_div(income, credit)),
            ("INCOME_PER_PERSON", F.log1p(m.ieee_div(income, family))),
            ("ANNUITY_INCOME_PERC", F.sqrt(m.ieee_div(annuity, 1 + income))),
            ("LOAN_INCOME_RATIO", m.ieee_div(credit, income)),
            ("ANNUITY_LENGTH", m.ieee_div(credit, annuity)),
            ("CHILDREN_RATIO", m.ieee_div(children, family)),
            ("CREDIT_TO_GOODS_RATIO", m.ieee_div(credit, F.col("AMT_GOODS_PRICE"))),
            ("INC_PER_CHLD", m.ieee_div(income, 1 + children)),
            ("SOURCES_PROD", first * second * third),
            ("CAR_TO_BIRTH_RATIO", m.ieee_div(car, born)),
            ("CAR_TO_EMPLOY_RATIO", m.ieee_div(car, employed)),
            ("PHONE_TO_BIRTH_RATIO", m.ieee_div(phone, born)),
            ("PHONE_TO_EMPLOY_RATIO", m.ieee_div(phone, employed)),
            ("NEW_EXT_SOURCES_MEAN", rw.row_mean(ps.EXTERNAL_SCORES)),
            ("NEW_SCORES_STD", rw.row_sd(ps.EXTERNAL_SCORES)),
            *([("DOC_IND_KURT", rw.row_kurtosis(documents))] if documents else []),
            *([("LIVE_IND_SUM", rw.row_sum(contacts))] if contacts else []),
        ],
    )
    # the median comes from the base table, which has the same rows and none of the joins
    medians = ag.group_median(base, "ORGANIZATION_TYPE", "AMT_INCOME_TOTAL", out="NEW_INC_BY_ORG")
    coded = jn.lookup_join(derived, medians.filter(F.col("ORGANIZATION_TYPE").isNotNull()), "ORGANIZATION_TYPE")
    return m.clean_missing(coded.select(*derived.columns, "NEW_INC_BY_ORG"))


def training_sets(
    train: DataFrame,
    attr: str = "CODE_GENDER",
    protected: object = 1,
    majority: object = 2,
    minority_size: int | None = None,
    extra_size: int | None = None,
    key: str = KEY,
    seed: int = 0,
    score: Column | None = None,
) -> dict[str, DataFrame]:
    """Biased and rebalanced training sets, each with and without the protected attribute.

    ``minority``: all majority rows and an undersampled protected group (20% of the set by default).
    ``rebalanced``: equal groups by undersampling. ``collected``: equal groups after adding protected rows. ``score``
    orders the rows of a group in all draws (a hash of key and seed by default).
    """
    known = train.filter(F.col(attr).isin(protected, majority))
    counts = {r[attr]: r["n"] for r in known.groupBy(attr).agg(F.count(F.lit(1)).alias("n")).collect()}
    base = minority_size if minority_size is not None else counts[majority] // 4
    half = (base + counts[majority]) // 2
    extra = extra_size if extra_size is not None else max(0, min(half, counts[protected]) - base)
    minority = sa.undersample(known, attr, {protected: base}, key, score, seed)
    even = sa.undersample(known, attr, {protected: base, majority: base}, key, score, seed)
    collected = sa.rebalance_collect(known, attr, protected, majority, base, extra, key, score, seed)
    sets = {"minority": minority, "rebalanced": even, "collected": collected}
    return {**sets, **{f"{name}_blind": sa.blind(rows, attr) for name, rows in sets.items()}}


def scorecard_table(
    df: DataFrame,
    key: str = KEY,
    label: str = LABEL,
    binned: Sequence[str] = ps.BINNED,
    merged: Mapping[str, tuple[str, Sequence[object]]] = ps.MERGED_LEVELS,
    bins: int = 10,
) -> DataFrame:
    """Scorecard form of an applicant table: binned columns as dummies, the rest as labels without gaps.

    Bins of all columns come from one quantile pass; dummy names end in the bin's position. The rows are dealt over the tasks first, as
    a row becomes about a hundred cells.
    """
    present = [c for c in dict.fromkeys(binned) if c in df.columns]
    rest = [c for c in df.columns if c not in (key, label, *present)]
    dealt = spread_rows(df.select(key, label, *present, *rest), key)
    coded = apply_bins(dealt, quantile_breaks(dealt, present, bins), include_lowest=False, labels=False)
    shaped = cut_lineage(coded.select(key, label, *rest, *[F.col(f"{c}_bin").alias(c) for c in present]))  # read for levels and for dummies
    labelled = co.map_columns(shaped, rest, lambda c: c.cast("string"))
    for c, (name, levels) in merged.items():
        if c in rest:
            labelled = ca.merge_levels(labelled, c, levels, name)
    wide = ca.dummies(labelled, present)
    flags = [c for c in wide.columns if c not in (key, label)]
    return ca.explicit_na(wide, flags, "0")
