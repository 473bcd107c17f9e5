"""Metrics of one column and of two columns."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf, sqrt
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.order import running_sums
from tabgauge.functions.parsing import micros
from tabgauge.operators.base import OneColumnMetric, TwoColumnMetric, as_result, result_row
from tabgauge.operators.classify import Check
from tabgauge.operators.columns import ColumnRef, ColumnSpec
from tabgauge.operators.histogram import Histogram, Joint, aligned_histogram
from tabgauge.operators.kendall import tau_b

# One column


class Mean(OneColumnMetric):
    """Mean of numbers or dates. ``skipna=False`` gives no mean of dates if one is missing; numbers always skip missing ones."""

    name = "mean"

    def __init__(self, check: Check | None = None, upload_to_database: bool = True, skipna: bool = False):
        super().__init__(check, upload_to_database)
        self.skipna = skipna

    def check_column_types(self, spec: ColumnSpec, check: Check | None = None) -> bool:
        return (check or self.check).affine(spec)

    def aggregate(self, c: Column, spec: ColumnSpec) -> Column:
        """One aggregate; dates are averaged as distances from the first one, which keeps microseconds."""
        if spec.inferred in ("M", "m"):
            t = micros(spec.read(c)) if spec.inferred == "M" else spec.read(c).cast("long")
            mean = F.min(t) + F.round(F.avg((t - F.lit(0)).cast("decimal(38,0)")) - F.min(t)).cast("long")
            made = F.timestamp_micros(mean) if spec.inferred == "M" else F.timestamp_micros(mean) - F.timestamp_micros(F.lit(0))
            return made if self.skipna else F.when(F.count(t) == F.count(F.lit(1)), made)
        return F.avg(spec.read(c))

    def compute(self, ref: ColumnRef, spec: ColumnSpec) -> DataFrame:
        kind = {"M": "value_ts", "m": "value_interval"}.get(spec.inferred, "value")
        return as_result(ref.df.agg(self.aggregate(ref.value, spec).alias("value")), self.name, ref.name, None, kind=kind)


class StandardDeviation(OneColumnMetric):
    """Square root of the sum of squared distances from the mean; ``normalize`` divides by n - 1 inside the root.

    ``remove_outliers`` = r leaves out the rows before int(n*r) and from int(n*(1-r)) on in sorted order, missing ones last.
    """

    name = "standard_deviation"

    def __init__(self, check: Check | None = None, remove_outliers: float = 0.0, upload_to_database: bool = True, normalize: bool = False):
        super().__init__(check, upload_to_database)
        self.remove_outliers, self.normalize = remove_outliers, normalize

    def params(self) -> dict[str, Any]:
        return {"remove_outliers": self.remove_outliers}

    def check_column_types(self, spec: ColumnSpec, check: Check | None = None) -> bool:
        return (check or self.check).affine(spec)

    def compute(self, ref: ColumnRef, spec: ColumnSpec) -> DataFrame:
        v = spec.ordinal_value(ref.value)
        first = ref.df.agg(F.min(v)).first()[0] if spec.inferred in ("M", "m") else 0.0
        held = ref.df.select((v - F.lit(first or 0.0)).alias("v")).where("v IS NOT NULL")
        if self.remove_outliers:
            low, high = int(spec.n * self.remove_outliers), int(spec.n * (1 - self.remove_outliers))
            counted = held.groupBy("v").agg(F.count(F.lit(1)).alias("w"))
            summed = running_sums(counted, "v", ["w"])
            kept = F.greatest(F.lit(0), F.least(F.col("cum_w"), F.lit(high)) - F.greatest(F.col("cum_w") - F.col("w"), F.lit(low)))
            middle = held.agg(F.avg("v")).first()[0]
            parts = summed.select((F.col("v") - F.lit(middle)).alias("d"), kept.cast("double").alias("k")).agg(
                F.sum("k").alias("n"), F.sum(F.col("k") * F.col("d")).alias("s"), F.sum(F.col("k") * F.col("d") * F.col("d")).alias("ss"))
            made = parts.select(F.when(F.col("n") > 0, F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))).alias("sxx"), "n")
        else:
            made = held.agg(F.regr_sxx("v", "v").alias("sxx"), F.count("v").alias("n"))
        size = F.sqrt(F.try_divide("sxx", F.col("n") - 1)) if self.normalize else F.sqrt("sxx")
        if spec.inferred in ("M", "m"):
            made = made.select(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (size / 1e6).cast("decimal(18,6)")).alias("value"))
            return as_result(made, self.name, ref.name, None, kind="value_interval")
        return as_result(made.select(size.alias("value")), self.name, ref.name, None)


# Two columns, by histograms


def both(test, a: ColumnSpec, b: ColumnSpec) -> bool:
    return test(a) and test(b)


class HistogramMetric(TwoColumnMetric):
    """A metric of the shares p and q of shared bins: ``aggregate(n_bins, empty)`` over columns p and q."""

    def check_column_types(self, a: ColumnSpec, b: ColumnSpec, check: Check | None = None) -> bool:
        check = check or self.check
        return both(check.continuous, a, b) or both(check.categorical, a, b)

    def aggregate(self, n_bins: Column | int | None, empty: Column | bool) -> Column:
        """``empty`` says that one side has no values; ``n_bins`` is the number of bins, empty ones too, or None."""
        raise NotImplementedError

    def of(self, h: Histogram) -> DataFrame:
        shares = h.shares().select(F.col("p0").alias("p"), F.col("p1").alias("q"))
        return shares.agg(self.aggregate(h.n_bins, not all(h.totals)).alias("value"))

    def compute(self, a: ColumnRef, b: ColumnRef, held: Joint) -> DataFrame:
        return as_result(self.of(aligned_histogram([a, b], self.check, held=held)), self.name, a.name, b.name)


def _nan_if(empty: Column | bool, made: Column) -> Column:
    if isinstance(empty, bool):
        return F.lit(float("nan")) if empty else made
    return F.when(empty, F.lit(float("nan"))).otherwise(made)


class KullbackLeibler(HistogramMetric):
    """Sum of p ln(p/q); infinite where q is 0 and p isn't. NaN if a side is empty."""

    name, symmetric = "kullback_leibler_divergence", False

    def aggregate(self, n_bins, empty) -> Column:
        p, q = F.col("p"), F.col("q")
        return _nan_if(empty, F.sum(F.when(p == 0, 0.0).when(q == 0, F.lit(inf)).otherwise(p * F.ln(F.try_divide(p, q)))))


class JensenShannon(HistogramMetric):
    """The Jensen-Shannon distance, the root of the divergence in nats: at most sqrt(ln 2). NaN if a side is empty."""

    name = "jensen_shannon_divergence"

    def aggregate(self, n_bins, empty) -> Column:
        p, q = F.col("p"), F.col("q")
        m = (p + q) / 2
        side = lambda x: F.when(x == 0, 0.0).otherwise(x * F.ln(F.try_divide(x, m)))
        return _nan_if(empty, F.sqrt(F.greatest(F.lit(0.0), F.sum(side(p) + side(q)) / 2)))


class Hellinger(HistogramMetric):
    """|sqrt p - sqrt q| / sqrt 2."""

    name = "hellinger_distance"

    def aggregate(self, n_bins, empty) -> Column:
        d = F.sqrt("p") - F.sqrt("q")
        return F.sqrt(F.sum(d * d)) / F.lit(sqrt(2))


class Norm(HistogramMetric):
    """The norm of p - q of any order; inf and -inf give the largest and the smallest difference, 0 the number of differences."""

    name = "norm"

    def __init__(self, check: Check | None = None, ord: float = 2.0, upload_to_database: bool = True):
        if check is not None and not isinstance(check, Check):
            raise TypeError("the first argument is a Check; give the order as ord=")
        super().__init__(check, upload_to_database)
        self.ord = float(ord)

    def params(self) -> dict[str, Any]:
        return {"ord": self.ord}

    def aggregate(self, n_bins, empty) -> Column:
        d = F.abs(F.col("p") - F.col("q"))
        if self.ord == inf:
            return F.max(d)
        if self.ord == -inf:
            least = F.min(d)
            if n_bins is None:
                return least
            bins = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
            return F.when(F.count(F.lit(1)) < F.coalesce(bins, F.lit(0)), 0.0).otherwise(least)
        if self.ord == 0:
            return F.count_if(d != 0).cast("double")
        if self.ord < 0:  # a bin without a difference makes the sum infinite, and the norm 0
            gap = F.count_if(d == 0) > 0
            if n_bins is not None:
                gap = gap | (F.count(F.lit(1)) < F.coalesce(F.lit(n_bins) if isinstance(n_bins, int) else n_bins, F.lit(0)))
            return F.when(gap, 0.0).otherwise(F.pow(F.sum(F.when(d > 0, F.pow(d, F.lit(self.ord)))), F.lit(1 / self.ord)))
        return F.pow(F.sum(F.pow(d, F.lit(self.ord))), F.lit(1 / self.ord))


class Bhattacharyya(HistogramMetric):
    """Sum of sqrt(p q)."""

    name = "bhattacharyya_coefficient"

    def aggregate(self, n_bins, empty) -> Column:
        return F.sum(F.sqrt(F.col("p") * F.col("q")))


class TotalVariation(HistogramMetric):
    """Half the sum of |p - q|."""

    name = "total_variation_distance"

    def aggregate(self, n_bins, empty) -> Column:
        return F.sum(F.abs(F.col("p") - F.col("q"))) / 2


HISTOGRAM_METRICS: tuple[type[HistogramMetric], ...] = (KullbackLeibler, JensenShannon, Hellinger, Norm, Bhattacharyya, TotalVariation)

# Two columns, by values


def label(c: Column) -> Column:
    """A value as a category of its own spelling; missing ones are the category "nan"."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


class EarthMovers(TwoColumnMetric):
    """Half the sum of the differences of category shares; missing values are a category. NaN beyond ``MOST`` categories."""

    name = "earth_movers_distance"
    MOST: ClassVar[int] = 10_000

    def check_column_types(self, a: ColumnSpec, b: ColumnSpec, check: Check | None = None) -> bool:
        return both((check or self.check).categorical, a, b)

    def compute(self, a: ColumnRef, b: ColumnRef, held: Joint) -> DataFrame:
        one = lambda r, i: r.df.select(F.lit(i).alias("side"), label(r.value).alias("v"))
        counts = one(a, 0).unionAll(one(b, 1)).groupBy("v").agg(*[F.count_if(F.col("side") == i).alias(f"c{i}") for i in (0, 1)])
        na, nb = (float(s.n) for s in held.specs)
        p, q = (F.col(f"c{i}") / n if n else F.lit(0.0) for i, n in enumerate((na, nb)))
        made = counts.agg((F.sum(F.abs(p - q)) / 2).alias("d"), F.count(F.lit(1)).alias("n"))
        return as_result(made.select(F.when(F.col("n") > self.MOST, F.lit(float("nan"))).otherwise(F.col("d")).alias("value")), self.name, a.name, b.name)


class KolmogorovSmirnov(TwoColumnMetric):
    """The largest difference of the two distribution functions, over values as they are; 1 if a side is empty."""

    name = "kolmogorov_smirnov_distance"

    def check_column_types(self, a: ColumnSpec, b: ColumnSpec, check: Check | None = None) -> bool:
        return both((check or self.check).continuous, a, b)

    def compute(self, a: ColumnRef, b: ColumnRef, held: Joint) -> DataFrame:
        na, nb = (s.n_present for s in held.specs)
        if not na or not nb:
            return result_row(a.df.sparkSession, self.name, a.name, b.name, 1.0)
        values = held.df.select("side", held.all.read(F.col("v")).alias("v")).where("v IS NOT NULL")
        counts = values.groupBy("v").agg(*[F.count_if(F.col("side") == i).alias(f"c{i}") for i in (0, 1)])
        summed = running_sums(counts, "v", ["c0", "c1"])
        made = summed.agg(F.max(F.abs(F.col("cum_c0") / float(na) - F.col("cum_c1") / float(nb))).alias("value"))
        return as_result(made, self.name, a.name, b.name)


class KendallTau(TwoColumnMetric):
    """tau-b of two columns of one table, or of two tables whose rows ``align_on`` names pair up."""

    name = "kendall_tau_correlation"

    def __init__(self, check: Check | None = None, upload_to_database: bool = True, align_on: Sequence[str] | None = None):
        super().__init__(check, upload_to_database)
        self.align_on = list(align_on) if align_on else None

    def check_column_types(self, a: ColumnSpec, b: ColumnSpec, check: Check | None = None) -> bool:
        return a.n == b.n and both((check or self.check).ordinal, a, b)

    def compute(self, a: ColumnRef, b: ColumnRef, held: Joint) -> DataFrame:
        x, y = (s.ordinal_value(r.value).alias(c) for s, r, c in zip(held.specs, (a, b), ("x", "y")))
        return result_row(a.df.sparkSession, self.name, a.name, b.name, tau_b(aligned(a, b, x, y, self.align_on)))


def aligned(a: ColumnRef, b: ColumnRef, x: Column, y: Column, align_on: Sequence[str] | None) -> DataFrame:
    """Rows (x, y) of one table, or of two joined on their keys."""
    if a.df is b.df:
        return a.df.select(x, y)
    if not align_on:
        raise ValueError("columns of two tables need align_on, the names of their rows' key")
    return a.df.select(*align_on, x).join(b.df.select(*align_on, y), list(align_on))


#: Cells that two columns of so many categories can have at most, up to which the counts of cells finish on the driver.
FEW_CELLS = 100_000


def cramers_v_of_cells(a: Sequence, b: Sequence, o: Sequence) -> float:
    """The value from the filled cells; NaN if a column has one category only. Cells without rows count 0.5 each."""
    import numpy as np

    _, i = np.unique(np.asarray(a, object).astype(str), return_inverse=True)
    _, j = np.unique(np.asarray(b, object).astype(str), return_inverse=True)
    grid = np.full((i.max() + 1, j.max() + 1), 0.5)
    grid[i, j] = o
    if min(grid.shape) < 2:
        return float("nan")
    n = grid.sum()
    e = np.outer(grid.sum(1), grid.sum(0)) / n
    return float(np.sqrt(((grid - e) ** 2 / e).sum() / (n * (min(grid.shape) - 1))))


def cramers_v_of(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value) from a table (keys, a, b) of category pairs.

    Cells without rows count 0.5 each. Their part of chi-square follows from the margins, so the grid of all cells is never made:
    over all cells the sum of (0.5-e)^2/e is 0.25 n sum(1/R) sum(1/C) - r c + n, and the filled cells' share of it is taken away.
    """
    keys = list(keys)
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy(*keys, "a").agg(F.sum("o").alias("o"), F.count(F.lit(1)).alias("filled"))
    cols = cells.groupBy(*keys, "b").agg(F.sum("o").alias("o"), F.count(F.lit(1)).alias("filled"))
    r = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("r"))
    c = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    with_ = lambda x, y: x.join(y, keys) if keys else x.crossJoin(y)  # noqa: E731  (one row each without keys)
    size = F.broadcast(with_(r, c))  # a row for each key
    row = with_(rows, size).select(*keys, "a", (F.col("o") + 0.5 * (F.col("c") - F.col("filled"))).alias("R"))
    col = with_(cols, size).select(*keys, "b", (F.col("o") + 0.5 * (F.col("r") - F.col("filled"))).alias("C"))
    whole = with_(row.groupBy(*keys).agg(F.sum("R").alias("n"), F.sum(1 / F.col("R")).alias("ir")), col.groupBy(*keys).agg(F.sum(1 / F.col("C")).alias("ic")))
    whole = F.broadcast(with_(whole, size))
    e = F.col("R") * F.col("C") / F.col("n")
    found = with_(cells.join(row, [*keys, "a"]).join(col, [*keys, "b"]), whole.select(*keys, "n")).groupBy(*keys).agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("filled"), F.sum((0.5 - e) * (0.5 - e) / e).alias("taken"), F.count(F.lit(1)).alias("cells"))
    gaps = 0.25 * F.col("n") * F.col("ir") * F.col("ic") - F.col("r") * F.col("c") + F.col("n") - F.col("taken")
    chi2 = F.col("filled") + F.when(F.col("cells") == F.col("r") * F.col("c"), 0.0).otherwise(gaps)
    least = F.least(F.col("r"), F.col("c")) - 1
    value = F.when(least == 0, F.lit(float("nan"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(chi2, F.col("n") * least))))
    return with_(found, whole).select(*keys, value.alias("value"))


class CramersV(TwoColumnMetric):
    """Cramer's V of two columns of one table (or two, see KendallTau); missing values are a category; 0 if a column has one value only."""

    name = "cramers_v"

    def __init__(self, check: Check | None = None, upload_to_database: bool = True, align_on: Sequence[str] | None = None):
        super().__init__(check, upload_to_database)
        self.align_on = list(align_on) if align_on else None

    def check_column_types(self, a: ColumnSpec, b: ColumnSpec, check: Check | None = None) -> bool:
        return both((check or self.check).categorical, a, b)

    def compute(self, a: ColumnRef, b: ColumnRef, held: Joint) -> DataFrame:
        if any(s.n_unique - (s.n_missing > 0) == 1 for s in held.specs):
            return result_row(a.df.sparkSession, self.name, a.name, b.name, 0.0)
        if not held.specs[0].n:
            return result_row(a.df.sparkSession, self.name, a.name, b.name)
        pairs = aligned(a, b, label(a.value).alias("a"), label(b.value).alias("b"), self.align_on)
        if held.specs[0].n_unique * held.specs[1].n_unique <= FEW_CELLS:
            cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o")).collect()
            return result_row(a.df.sparkSession, self.name, a.name, b.name, cramers_v_of_cells(*zip(*cells)) if cells else None)
        return as_result(cramers_v_of(pairs), self.name, a.name, b.name)


class EarthMoversBinned(TwoColumnMetric):
    """Earth mover's distance of two histograms given as counts, one row per bin; ``position`` is the bin's number from 0 on, and a bin without a row is empty.

    With ``bin_edges`` the ground distance is that of the bins' centres, without it every move costs 1. Two pandas Series are taken in their order.
    """

    name = "earth_movers_distance_binned"

    def __init__(self, check: Check | None = None, bin_edges: Sequence[float] | None = None, upload_to_database: bool = True, position: str | None = None):
        super().__init__(check, upload_to_database)
        self.bin_edges, self.position = (None if bin_edges is None else [float(e) for e in bin_edges]), position

    def params(self) -> dict[str, Any]:
        return {"bin_edges": self.bin_edges}

    def check_column_types(self, a: ColumnSpec, b: ColumnSpec, check: Check | None = None) -> bool:
        return True

    def __call__(self, a: ColumnRef, b: ColumnRef, dataset: str | None = None) -> DataFrame:
        names = [x.name if x.name is not None else "value" for x in (a, b)]
        if not isinstance(a, ColumnRef) and not isinstance(b, ColumnRef):
            df, at = _in_order(a, b), _AT
            x, y = F.col("x"), F.col("y")
        elif a.df is b.df:
            df, at, x, y = a.df, self.position, a.value, b.value
        else:
            if not self.position:
                raise ValueError("histograms of two tables need position, the column with their bins' numbers")
            one = lambda r, c: r.df.select(F.col(self.position).alias(_AT), r.value.alias(c))
            df, at, x, y = one(a, "x").join(one(b, "y"), _AT, "full_outer"), _AT, F.col("x"), F.col("y")
        made = self.of(df, x, y, at, *map(str, names))
        self._keep(made, dataset or getattr(a, "dataset", None) or f"Series_{names[0]}", df.count() if self.store is not None else 0, 1)
        return made

    def of(self, df: DataFrame, x: Column, y: Column, position: str | None, a: str = "x", b: str = "y") -> DataFrame:
        if position is None and self.bin_edges is not None:
            raise ValueError("ordered bins need position, the column with their numbers")
        held = df.select((F.col(position) if position else F.lit(0)).alias("at"), F.coalesce(x.cast("double"), F.lit(0.0)).alias("x"), F.coalesce(y.cast("double"), F.lit(0.0)).alias("y"))
        if self.bin_edges is None:
            sx, sy = held.agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
            if not sx or not sy:
                return result_row(df.sparkSession, self.name, a, b, 0.0 if sx == sy else 1.0)
            return as_result(held.agg((F.sum(F.abs(F.col("x") / sx - F.col("y") / sy)) / 2).alias("value")), self.name, a, b)
        bins = len(self.bin_edges) - 1
        within = F.col("at").between(0, bins - 1)
        rows = held.groupBy(F.when(within, F.col("at").cast("long")).alias("at")).agg(F.sum("x"), F.sum("y")).collect()  # a row for each bin at most
        if any(at is None for at, _, _ in rows):
            raise ValueError(f"position goes from 0 to {bins - 1}, the number of bins less one")
        p, q = [0.0] * bins, [0.0] * bins
        for at, u, v in rows:
            p[at], q[at] = u, v
        sx, sy = sum(p), sum(q)
        if not sx or not sy:
            return result_row(df.sparkSession, self.name, a, b, 0.0 if sx == sy else 1.0)
        centers = [(u + v) / 2 for u, v in zip(self.bin_edges, self.bin_edges[1:])]
        apart = total = 0.0
        for k in range(bins - 1):
            apart += p[k] / sx - q[k] / sy
            total += abs(apart) * (centers[k + 1] - centers[k])
        return result_row(df.sparkSession, self.name, a, b, total)


_AT = "_position"


def _in_order(a, b) -> DataFrame:
    """Two pandas Series side by side, numbered by their order; the shorter one ends in empty bins."""
    from itertools import zip_longest

    from pyspark.sql import SparkSession

    number = lambda v: None if v is None or v != v else float(v)
    rows = [(k, number(x), number(y)) for k, (x, y) in enumerate(zip_longest(a, b))]
    return SparkSession.builder.getOrCreate().createDataFrame(rows, f"{_AT} long, x double, y double")
