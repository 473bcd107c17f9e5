"""Metrics of whole tables: per column, per pair of columns, and differences of two tables."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce
from math import inf
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions import parsing
from tabgauge.functions.order import running_sums
from tabgauge.operators.base import DataFrameMetric, Metric, OneColumnMetric, TwoColumnMetric, TwoDataFrameMetric, scalar
from tabgauge.operators.classify import Check, ColumnCheck
from tabgauge.operators.columns import ColumnRef, profile_table
from tabgauge.operators.histogram import PairedColumn, bin_index, paired, paired_counts
from tabgauge.operators.kendall import tau_of_pairs
from tabgauge.operators.metrics import (
    FEW_CELLS, HISTOGRAM_METRICS, CramersV, EarthMovers, HistogramMetric, KendallTau, KolmogorovSmirnov, Mean, Norm, cramers_v_of, cramers_v_of_cells, label)

MATRIX = "column_a string, column_b string, value float"


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _in_order(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value) of ``df`` for all of ``names``; columns without a value have NULL."""
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return every.join(df, "column", "left").select("column", F.col("value").cast("double").alias("value"))


class OneColumnMap(DataFrameMetric):
    """(column, value): a one-column metric of each column. Dates and intervals are given as seconds."""

    def __init__(self, metric: OneColumnMetric):
        super().__init__(metric.check, metric.upload_to_database)
        self.metric, self.name = metric, f"{metric.name}_map"

    def params(self) -> dict[str, Any]:
        return {"metric": self.metric.to_dict()}

    def compute(self, df: DataFrame) -> DataFrame:
        specs = profile_table(df, check=self.metric.check)
        usable = {c: s for c, s in specs.items() if self.metric.check_column_types(s)}
        number = lambda c, s: F.unix_micros(c) / 1e6 if s.inferred == "M" else c.cast("double")
        if isinstance(self.metric, Mean):  # all columns in one aggregation
            aggs = [number(self.metric.aggregate(ColumnRef(df, c).value, s), s).alias(f"v{i}") for i, (c, s) in enumerate(usable.items())]
            if not aggs:
                return _in_order(df.sparkSession.createDataFrame([], "column string, value double"), df.columns)
            cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value")) for i, c in enumerate(usable)])
            return _in_order(df.agg(*aggs).select(F.explode(cells).alias("s")).select("s.column", "s.value"), df.columns)
        seconds = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.col("value_interval")) / 1e6
        parts = [
            self.metric.compute(ColumnRef(df, c), s).select(F.lit(c).alias("column"), F.coalesce("value", F.unix_micros("value_ts") / 1e6, seconds).alias("value"))
            for c, s in usable.items()]
        return _in_order(_stack(parts) if parts else df.sparkSession.createDataFrame([], "column string, value double"), df.columns)

    def parts(self, rows: list) -> list[tuple[str, str, tuple[str, ...], float | None]]:
        return [(self.metric.name, self.metric.category, (r["column"],), r["value"]) for r in rows]

    def summarize_result(self, result: DataFrame) -> float | None:
        return summary_mean(result).first()[0]


def summary_mean(result: DataFrame) -> DataFrame:
    """Mean of a map's values; those that don't apply or are NaN are left out."""
    return result.agg(F.avg(F.nullif(F.col("value"), F.lit(float("nan")))).alias("value"))


class CorrMatrix(DataFrameMetric):
    """(column_a, column_b, value) of a two-column metric for all ordered pairs of different columns, as float; the diagonal is NULL.

    ``skipna=False`` keeps the summary of a maximum over a table with a diagonal that has no value: NaN.
    """

    def __init__(self, metric: TwoColumnMetric, skipna: bool = False):
        super().__init__(metric.check, metric.upload_to_database)
        self.metric, self.skipna, self.name = metric, skipna, f"{metric.name}_matrix"

    def params(self) -> dict[str, Any]:
        return {"metric": self.metric.to_dict()}

    def compute(self, df: DataFrame) -> DataFrame:
        specs, names, spark = profile_table(df, check=self.metric.check), df.columns, df.sparkSession
        pairs = [(a, b) for i, a in enumerate(names) for b in (names[i + 1 :] if self.metric.symmetric else names) if a != b]
        usable = [(a, b) for a, b in pairs if self.metric.check_column_types(specs[a], specs[b])]
        if isinstance(self.metric, CramersV):
            found = self._cramers(df, specs, usable)
        elif isinstance(self.metric, KendallTau):
            cells = [F.struct(F.lit(k).alias("k"), *[specs[c].ordinal_value(ColumnRef(df, c).value).cast("double").alias(n) for c, n in ((a, "x"), (b, "y"))]) for k, (a, b) in enumerate(usable)]
            taus = tau_of_pairs(df.select(F.explode(F.array(*cells)).alias("s")).select("s.*")) if usable else {}
            found = spark.createDataFrame([(a, b, taus.get(k, float("nan"))) for k, (a, b) in enumerate(usable)], "column_a string, column_b string, value double")
        else:
            rows = [(a, b, scalar(self.metric.compute(ColumnRef(df, a), ColumnRef(df, b), self._joint(df, a, b)))) for a, b in usable]
            found = spark.createDataFrame([(a, b, None if v is None else float(v)) for a, b, v in rows], "column_a string, column_b string, value double")
        if self.metric.symmetric:
            found = found.unionByName(found.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "value"))
        cells = spark.createDataFrame([(a, b) for a in names for b in names], "column_a string, column_b string")
        return cells.join(found, ["column_a", "column_b"], "left").select("column_a", "column_b", F.col("value").cast("float").alias("value"))

    @staticmethod
    def _joint(df: DataFrame, a: str, b: str):
        from tabgauge.operators.histogram import joint

        return joint([ColumnRef(df, a), ColumnRef(df, b)], ColumnCheck())

    def _cramers(self, df: DataFrame, specs, usable) -> DataFrame:
        """All pairs in one plan: a row of pairs explodes to one row per pair, grouped by pair."""
        constant = {c for c, s in specs.items() if s.n_unique - (s.n_missing > 0) == 1}
        zero = df.sparkSession.createDataFrame([(a, b, 0.0) for a, b in usable if a in constant or b in constant], "column_a string, column_b string, value double")
        rest = [(a, b) for a, b in usable if a not in constant and b not in constant]
        long = lambda some: df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), label(ColumnRef(df, a).value).alias("a"), label(ColumnRef(df, b).value).alias("b")) for a, b in some])).alias("s")).select("s.*")
        size = {(a, b): specs[a].n_unique * specs[b].n_unique for a, b in rest}
        few = [p for p in rest if size[p] <= FEW_CELLS]
        found: list[tuple[str, str, float]] = []
        while few:  # as many pairs at once as the driver can hold the cells of
            now, held = [], 0
            while few and (not now or held + size[few[0]] <= 10 * FEW_CELLS):
                held += size[few[0]]
                now.append(few.pop(0))
            cells: dict[tuple[str, str], list] = {}
            for r in long(now).groupBy("column_a", "column_b", "a", "b").agg(F.count(F.lit(1)).alias("o")).collect():
                cells.setdefault((r.column_a, r.column_b), []).append((r.a, r.b, r.o))
            found += [(*p, cramers_v_of_cells(*zip(*c))) for p, c in cells.items()]
        out = zero.unionByName(df.sparkSession.createDataFrame(found, "column_a string, column_b string, value double"))
        many = [p for p in rest if size[p] > FEW_CELLS]
        return out.unionByName(cramers_v_of(long(many), ["column_a", "column_b"])) if many else out

    def parts(self, rows: list) -> list[tuple[str, str, tuple[str, ...], float | None]]:
        return [(self.metric.name, self.metric.category, (r["column_a"], r["column_b"]), r["value"]) for r in rows if r["column_a"] != r["column_b"]]

    def summarize_result(self, result: DataFrame) -> float | None:
        if not self.skipna:
            return float("nan")
        return result.agg(F.max(F.nullif(F.col("value"), F.lit(float("nan")).cast("float")))).first()[0]

    @staticmethod
    def wide(result: DataFrame) -> DataFrame:
        """The matrix as a table: rows are second columns, columns first ones."""
        return result.groupBy("column_b").pivot("column_a").agg(F.first("value"))


class DiffCorrMatrix(TwoDataFrameMetric):
    """(column_a, column_b, value): the matrix of the old table minus that of the new one."""

    def __init__(self, metric: TwoColumnMetric):
        super().__init__(metric.check, metric.upload_to_database)
        self.metric, self.matrix = metric, CorrMatrix(metric)
        self.name = f"diff_{metric.name}"

    def params(self) -> dict[str, Any]:
        return {"metric": self.metric.to_dict()}

    def compute(self, old: DataFrame, new: DataFrame) -> DataFrame:
        a, b = self.matrix.compute(old), self.matrix.compute(new).withColumnRenamed("value", "other")
        return a.join(b, ["column_a", "column_b"], "full_outer").select("column_a", "column_b", (F.col("value") - F.col("other")).alias("value"))

    def summarize_result(self, result: DataFrame) -> float | None:
        return summary_most(result).first()[0]


def summary_most(result: DataFrame) -> DataFrame:
    """The largest absolute value of a matrix."""
    return result.agg(F.max(F.abs(F.nullif(F.col("value"), F.lit(float("nan")).cast("float")))).alias("value"))


class TwoColumnMap(TwoDataFrameMetric):
    """(column, value): a two-column metric of each column of the old table and its namesake in the new one."""

    def __init__(self, metric: TwoColumnMetric):
        super().__init__(metric.check, metric.upload_to_database)
        self.metric, self.name = metric, f"{metric.name}_map"

    def params(self) -> dict[str, Any]:
        return {"metric": self.metric.to_dict()}

    def compute(self, old: DataFrame, new: DataFrame) -> DataFrame:
        names = old.columns
        if missing := [c for c in names if c not in new.columns]:
            raise KeyError(f"columns that the new table lacks: {missing}")
        m = self.metric
        both, columns = paired(old, new, names, m.check, with_bins=isinstance(m, HistogramMetric))
        usable = {c: p for c, p in columns.items() if m.check_column_types(p.old, p.new)}
        if isinstance(m, HistogramMetric):
            found = histogram_metrics(paired_counts(both, usable), usable, {m.name: m}, both)
        elif isinstance(m, KolmogorovSmirnov):
            found = ks_of(value_counts(both, usable, usable, ()), usable, usable) if usable else ks_of(both, {}, ())
        elif isinstance(m, EarthMovers):
            found = nominal_of(value_counts(both, usable, (), usable), usable, usable, m.MOST) if usable else nominal_of(both, {}, (), m.MOST)
        else:
            one = lambda c: m(ColumnRef(old, c), ColumnRef(new, c)).select(F.lit(c).alias("column"), "value")
            found = _stack([one(c) for c in usable]) if usable else both.sparkSession.createDataFrame([], "column string, value double")
        return _in_order(found.select("column", "value"), names)

    def parts(self, rows: list) -> list[tuple[str, str, tuple[str, ...], float | None]]:
        return [(self.metric.name, self.metric.category, (r["column"],), r["value"]) for r in rows]

    def summarize_result(self, result: DataFrame) -> float | None:
        return summary_mean(result).first()[0]


def histogram_metrics(counts: DataFrame, columns: dict[str, PairedColumn], metrics: dict[str, HistogramMetric], both: DataFrame) -> DataFrame:
    """(column, metric, value) of all metrics, by the names given, from one table of counts."""
    facts = [(c, float(p.old.n_present), float(p.new.n_present), p.bins.count if p.bins else None) for c, p in columns.items()]
    known = F.broadcast(both.sparkSession.createDataFrame(facts, "column string, n0 double, n1 double, bins long"))  # a row for each column
    shares = counts.join(known, "column").select("column", F.coalesce(F.try_divide("c0", "n0"), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("c1", "n1"), F.lit(0.0)).alias("q"), "n0", "n1", "bins")
    bins, empty = F.max("bins"), (F.min("n0") == 0) | (F.min("n1") == 0)
    aggs = shares.groupBy("column").agg(*[m.aggregate(bins, empty).alias(f"m{i}") for i, m in enumerate(metrics.values())])
    cells = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, name in enumerate(metrics)])
    return aggs.select("column", F.explode(cells).alias("s")).select("column", "s.metric", "s.value")


def value_counts(both: DataFrame, columns: dict[str, PairedColumn], numbers: Collection[str], texts: Collection[str]) -> DataFrame:
    """(k, v, s, c0, c1): how often each value of the k-th column occurs on each side; v is its number for ``numbers``, s its text for ``texts``, both NULL for missing ones.

    One shuffle, which the plans of several metrics share.
    """
    cells = []
    for k, (c, p) in enumerate(columns.items()):
        v = F.col(f"`{c}`")
        cells.append(F.struct(F.lit(k).alias("k"), (p.all.read(v) if c in numbers else F.lit(None)).cast("double").alias("v"), (v if c in texts else F.lit(None)).cast("string").alias("s")))
    long = both.select("_side", F.explode(F.array(*cells)).alias("x")).select("_side", "x.*")
    return long.groupBy("k", "v", "s").agg(*[F.count_if(F.col("_side") == i).cast("double").alias(f"c{i}") for i in (0, 1)])


def _named(values: DataFrame, columns: dict[str, PairedColumn], chosen: Collection[str], facts) -> DataFrame:
    """``values`` by k with the names of the chosen columns and facts about them; a row for each column is broadcast."""
    rows = [(k, c, *map(float, facts(p))) for k, (c, p) in enumerate(columns.items()) if c in chosen]
    known = values.sparkSession.createDataFrame(rows, "k int, column string, n0 double, n1 double")
    return values.join(F.broadcast(known), "k")


def binned(values: DataFrame, columns: dict[str, PairedColumn]) -> DataFrame:
    """(column, bin, c0, c1) from ``value_counts``; missing values have no bin."""
    rows = [(k, c, p.bins.low if p.bins else None, p.bins.step if p.bins else None, p.bins.count if p.bins else None, p.all.from_text) for k, (c, p) in enumerate(columns.items())]
    known = F.broadcast(values.sparkSession.createDataFrame(rows, "k int, column string, low double, step double, n long, spelled boolean"))  # a row for each column
    text = F.when(F.col("n").isNull(), F.col("s"))
    if any(p.all.from_text for p in columns.values()):  # text that spells numbers counts by the number
        text = F.when(F.col("spelled"), parsing.number(text).cast("string")).otherwise(text)
    held = values.join(known, "k").select("column", bin_index(F.col("v"), F.col("low"), F.col("step"), F.col("n")).alias("b"), text.alias("t"), "c0", "c1").where("b IS NOT NULL OR t IS NOT NULL")
    counted = held.groupBy("column", "b", "t").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return counted.select("column", F.coalesce(F.col("b").cast("string"), F.col("t")).alias("bin"), "c0", "c1")


def ks_of(values: DataFrame, columns: dict[str, PairedColumn], chosen: Collection[str]) -> DataFrame:
    """(column, value): Kolmogorov-Smirnov distances of the chosen columns from the ``value_counts`` of ``columns``."""
    spark = values.sparkSession
    empty = [c for c in chosen if not columns[c].old.n_present or not columns[c].new.n_present]
    fixed = spark.createDataFrame([(c, 1.0) for c in empty], "column string, value double")
    rest = [c for c in chosen if c not in empty]
    if not rest:
        return fixed
    # what doesn't count in a distribution stands first in a running sum, with no weight
    weighed = values.select("k", "v", *[F.when(F.col("v").isNotNull(), F.col(f"c{i}")).otherwise(0.0).alias(f"c{i}") for i in (0, 1)]).where(F.col("c0") + F.col("c1") > 0)
    summed = running_sums(weighed, "v", ["c0", "c1"], ["k"], n=max(min(p.all.n, p.all.n_unique) for p in columns.values()))
    distance = F.max(F.abs(F.col("cum_c0") / F.col("n0") - F.col("cum_c1") / F.col("n1"))).alias("value")
    return fixed.unionByName(_named(summed, columns, rest, lambda p: (p.old.n_present, p.new.n_present)).groupBy("column").agg(distance))


def nominal_of(values: DataFrame, columns: dict[str, PairedColumn], chosen: Collection[str], most: int) -> DataFrame:
    """(column, value): nominal earth mover's distances of the chosen columns from the ``value_counts`` of ``columns``."""
    if not chosen:
        return values.sparkSession.createDataFrame([], "column string, value double")
    counts = values.groupBy("k", label(F.col("s")).alias("s")).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in (0, 1)])
    known = _named(counts.where(F.col("c0") + F.col("c1") > 0), columns, chosen, lambda p: (p.old.n, p.new.n))
    share = lambda i: F.coalesce(F.try_divide(f"c{i}", f"n{i}"), F.lit(0.0))
    found = known.groupBy("column").agg((F.sum(F.abs(share(0) - share(1))) / 2).alias("d"), F.count(F.lit(1)).alias("n"))
    return found.select("column", F.when(F.col("n") > most, F.lit(float("nan"))).otherwise(F.col("d")).alias("value"))


def compare_all(old: DataFrame, new: DataFrame, check: Check | None = None, orders: Sequence[float] = (1.0, 2.0, inf)) -> DataFrame:
    """(column, metric, value) of all distribution metrics that apply to each shared column, from two tables of counts."""
    check = check or ColumnCheck()
    names = [c for c in old.columns if c in new.columns]
    both, columns = paired(old, new, names, check)
    metrics: list[HistogramMetric] = [m(check) for m in HISTOGRAM_METRICS if m is not Norm]
    named = {m.name: m for m in metrics} | {f"norm_{o:g}": Norm(check, ord=o) for o in orders}
    usable = {c: p for c, p in columns.items() if metrics[0].check_column_types(p.old, p.new)}
    ks = [c for c, p in columns.items() if check.continuous(p.old) and check.continuous(p.new)]
    emd = [c for c, p in columns.items() if check.categorical(p.old) and check.categorical(p.new)]
    parts = [both.sparkSession.createDataFrame([], "column string, metric string, value double")]
    counted = {c: p for c, p in columns.items() if c in {*usable, *ks, *emd}}
    if counted:
        # held while all metrics read it; executors that are lost make their part again
        values = value_counts(both, counted, {*ks, *(c for c, p in counted.items() if p.bins)}, {*emd, *(c for c, p in counted.items() if not p.bins)}).persist()
        parts.append(histogram_metrics(binned(values, counted), usable, named, both))
        parts.append(ks_of(values, counted, ks).select("column", F.lit(KolmogorovSmirnov.name).alias("metric"), "value"))
        parts.append(nominal_of(values, counted, emd, EarthMovers.MOST).select("column", F.lit(EarthMovers.name).alias("metric"), "value"))
        rows = _stack(parts).collect()  # a row for each column and metric
        values.unpersist()
        return both.sparkSession.createDataFrame(rows, "column string, metric string, value double")
    return parts[0]


#: Tables' metrics by the name of a configuration.
Metric.registry |= {"one_column_map": OneColumnMap, "two_column_map": TwoColumnMap, "corr_matrix": CorrMatrix, "diff_corr_matrix": DiffCorrMatrix}

