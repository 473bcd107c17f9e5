"""Semantic kinds of columns: continuous, categorical, ordinal, affine."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from math import log

from pyspark.sql import DataFrame

from tabgauge.operators.columns import ColumnSpec, as_ref, profile_table


class Check(ABC):
    """How specs are classified; subclass it to classify otherwise."""

    @abstractmethod
    def continuous(self, spec: ColumnSpec) -> bool: ...

    @abstractmethod
    def categorical(self, spec: ColumnSpec) -> bool: ...

    @abstractmethod
    def ordinal(self, spec: ColumnSpec) -> bool: ...

    @abstractmethod
    def affine(self, spec: ColumnSpec) -> bool: ...

    def threshold(self, n: int) -> float | None:
        """The distinct count that kinds of ``n`` rows turn on; None if that can't be said, so that all are counted exactly."""
        return None

    def infer_dtype(self, spec: ColumnSpec) -> str:
        """The kind that the values spell: bool, int, float, datetime, timedelta, category or object."""
        if spec.categories is not None:
            return "category"
        return {"b": "bool", "i": "int", "f": "float", "M": "datetime", "m": "timedelta"}.get(spec.inferred, "object")


class ColumnCheck(Check):
    """Numbers with at least max(min_num_unique, ctl_mult * ln(rows)) distinct values are continuous.

    ``strict_ordinal=False`` counts 32-bit and narrower numbers as ordinal too.
    """

    def __init__(self, min_num_unique: int = 10, ctl_mult: float = 2.5, strict_ordinal: bool = True):
        self.min_num_unique, self.ctl_mult, self.strict_ordinal = min_num_unique, ctl_mult, strict_ordinal

    def threshold(self, n: int) -> float | None:
        return max(self.min_num_unique, self.ctl_mult * log(max(1, n)))

    def continuous(self, spec: ColumnSpec) -> bool:
        return spec.is_number and spec.n > 0 and spec.n_unique >= self.threshold(spec.n)

    def categorical(self, spec: ColumnSpec) -> bool:
        if spec.inferred == "unsupported":
            return False
        return spec.categories is not None or spec.inferred != "M" and not self.continuous(spec)

    def ordinal(self, spec: ColumnSpec) -> bool:
        if spec.categories is not None:
            return spec.ordered
        return spec.inferred in ("b", "M", "m") or spec.is_number and (spec.wide or not self.strict_ordinal)

    def affine(self, spec: ColumnSpec) -> bool:
        return spec.inferred in ("M", "m") or self.continuous(spec)


def classify(df: DataFrame, names: Sequence[str] | None = None, check: Check | None = None) -> DataFrame:
    """(column, inferred, n_rows, n_missing, continuous, categorical, ordinal, affine) of each column."""
    check = check or ColumnCheck()
    rows = [(s.name, check.infer_dtype(s), s.n, s.n_missing, check.continuous(s), check.categorical(s), check.ordinal(s), check.affine(s)) for s in profile_table(df, names, check=check).values()]
    return df.sparkSession.createDataFrame(rows, "column string, inferred string, n_rows long, n_missing long, continuous boolean, categorical boolean, ordinal boolean, affine boolean")


def spec_of(x, check: Check | None = None) -> ColumnSpec:
    """The spec of one column."""
    ref = as_ref(x)
    return profile_table(ref.df, [ref.name], check=check or ColumnCheck())[ref.name]
