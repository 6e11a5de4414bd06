"""Right-closed binning with quantile or round-number edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.formulas import pretty_breaks
from ..functions.missing import quoted
from .ordering import exact_quantiles


def bin_index(name: str, breaks: Sequence[float], include_lowest: bool) -> str:
    """SQL text of the 1-based bin of right-closed intervals; NULL outside the edges and, unless included, on the lowest."""
    c = f"double({quoted(name)})"
    edges = [f"double('{float(b)!r}')" for b in breaks]
    first = f"{c} >= {edges[0]}" if include_lowest else f"{c} > {edges[0]}"
    steps = " ".join(f"WHEN {c} <= {edge} THEN {i}" for i, edge in enumerate(edges[1:], start=1))
    return f"CASE WHEN NOT ({first}) OR isnan({c}) THEN NULL {steps} END"


def bin_labels(breaks: Sequence[float], include_lowest: bool) -> list[str]:
    text = [f"{b:.3g}" for b in breaks]
    opening = ["[" if include_lowest and i == 0 else "(" for i in range(len(breaks) - 1)]
    return [f"{o}{a},{b}]" for o, a, b in zip(opening, text, text[1:])]


def apply_bins(df: DataFrame, breaks: Mapping[str, Sequence[float]], include_lowest: bool, labels: bool = True) -> DataFrame:
    """``<col>_bin`` (index, for joins) and ``<col>_label`` (rounded text, for display), in one projection."""
    added = []
    for c, edges in breaks.items():
        index, names = "NULL", []
        if len(edges) > 1:
            index, names = bin_index(c, edges, include_lowest), bin_labels(edges, include_lowest)
        added.append(f"int({index}) AS {quoted(f'{c}_bin')}")
        if labels:
            shown = ", ".join(f"'{t}'" for t in names)
            label = f"get(array({shown}), int({index}) - 1)" if names else "NULL"
            added.append(f"string({label}) AS {quoted(f'{c}_label')}")
    return df.selectExpr("*", *added)


def quantile_breaks(df: DataFrame, cols: Sequence[str], k: int) -> dict[str, list[float]]:
    """Distinct edges of ``k`` quantile bins per column; only the edges reach the driver."""
    rows = exact_quantiles(df, cols, [i / k for i in range(k + 1)]).collect()
    found = {r["column"]: sorted(set(r["quantiles"])) for r in rows}
    return {c: found.get(c, []) for c in cols}


def bin_quantile(
    df: DataFrame, cols: str | Sequence[str], k: int = 10, include_lowest: bool = False, labels: bool = True
) -> DataFrame:
    names = [cols] if isinstance(cols, str) else list(cols)
    return apply_bins(df, quantile_breaks(df, names, k), include_lowest, labels)


def bin_pretty(
    df: DataFrame, cols: str | Sequence[str], k: int = 10, include_lowest: bool = True, labels: bool = True
) -> DataFrame:
    names = [cols] if isinstance(cols, str) else list(cols)
    row = df.agg(
        *[agg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`"))) for c in names for agg in (F.min, F.max)]
    ).first()
    limits = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}
    breaks = {c: pretty_breaks(float(lo), float(hi), k) if lo is not None else [] for c, (lo, hi) in limits.items()}
    return apply_bins(df, breaks, include_lowest, labels)
