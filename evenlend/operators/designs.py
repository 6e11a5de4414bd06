"""What a logit model is made of."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

INTERCEPT = "(Intercept)"
ALIAS_TOLERANCE = 1e-10


class LongLevels(Sequence):
    """Levels that stay a table ``level, folded``; they reach the driver only where they are read one by one."""

    def __init__(self, table: DataFrame, size: int, reference: str) -> None:
        self.table, self.size, self.reference = table, size, reference

    @cached_property
    def _all(self) -> tuple[str, ...]:
        rows = sorted(self.table.collect(), key=lambda r: (r["folded"], r["level"]))
        return (self.reference, *[r["level"] for r in rows if r["level"] != self.reference])

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        return self._all[at]


class LongTerms(Mapping):
    """One column of a table ``term, estimate, se`` as a mapping, without its NULLs; the intercept is at hand, the others are read when asked for."""

    def __init__(self, table: DataFrame, value: str, size: int, intercept: float) -> None:
        self.table, self.value, self.size, self.intercept = table, value, size, intercept

    @cached_property
    def _all(self) -> dict[str, float]:
        rows = self.table.select("term", self.value).dropna().collect()
        return {INTERCEPT: self.intercept, **{r["term"]: r[self.value] for r in rows}}

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        return iter(self._all)

    def __getitem__(self, term: str) -> float:
        return self.intercept if term == INTERCEPT else self._all[term]


class LongNames(Sequence):
    """The terms of such a table without an estimate."""

    def __init__(self, table: DataFrame, first: Sequence[str], size: int) -> None:
        self.table, self.first, self.size = table, first, size

    @cached_property
    def _all(self) -> tuple[str, ...]:
        return (*self.first, *[r["term"] for r in self.table.filter("estimate IS NULL").select("term").collect()])

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        return self._all[at]


@dataclass(frozen=True)
class Design:
    """Which columns a model uses, in order. The first level of a factor is its reference."""

    label: str
    features: tuple[str, ...]
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    interactions: tuple[tuple[str, str], ...] = ()

    @property
    def long(self) -> LongLevels | None:
        """The levels of the only feature, if they are a table."""
        found = self.levels.get(self.features[0]) if len(self.features) == 1 and not self.interactions else None
        return found if isinstance(found, LongLevels) else None

    def blocks(self) -> dict[str, dict[str, Column]]:
        """Model columns by formula term."""
        single: dict[str, dict[str, Column]] = {}
        for name in self.features:
            c = F.col(f"`{name}`")
            if name not in self.levels:
                single[name] = {name: c.cast("double")}
                continue
            text, levels = c.cast("string"), self.levels[name]
            known = text.isin(*levels)
            single[name] = {f"{name}_{v}": F.when(text == v, 1.0).when(known, 0.0) for v in levels[1:]}
        out = dict(single)
        for a, b in self.interactions:
            out[f"{a}:{b}"] = {
                f"{x}:{y}": cx * cy for x, cx in single[a].items() for y, cy in single[b].items()
            }
        return out

    def names(self) -> list[str]:
        """Names of the model columns, without building them."""
        single = {f: [f"{f}_{v}" for v in self.levels[f][1:]] if f in self.levels else [f] for f in self.features}
        mixed = [f"{x}:{y}" for a, b in self.interactions for x in single[a] for y in single[b]]
        return [n for names in single.values() for n in names] + mixed

    def columns(self) -> dict[str, Column]:
        return {name: c for block in self.blocks().values() for name, c in block.items()}


@dataclass(frozen=True)
class LogitModel:
    design: Design
    estimates: Mapping[str, float]
    errors: Mapping[str, float]
    deviance: float
    null_deviance: float
    aic: float
    n: int
    aliased: Sequence[str] = field(default=())
    table: DataFrame | None = None  # ``term, estimate, se`` of all terms but the intercept, where they are too many for the driver

    @property
    def parameters(self) -> int:
        return len(self.estimates)
