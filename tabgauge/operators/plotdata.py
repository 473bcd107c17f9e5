"""The data behind plots: counts, densities, cross tables and the layout of panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.order import quantiles
from tabgauge.operators.classify import Check, ColumnCheck
from tabgauge.operators.columns import ColumnRef, as_ref, profile_table
from tabgauge.operators.histogram import common_type

#: Characters of a tick label.
LABEL = 25
GRID, CUT = 200, 3.0


def series_names(n: int, names: Sequence[str] | None = None) -> list[str]:
    """Names of ``n`` series: those given, then orig, synth, unnamed0 ..."""
    default = [*("orig", "synth")[:n], *(f"unnamed{i}" for i in range(max(0, n - 2)))]
    given = list(names or [])[:n]
    return [*given, *default[len(given):]]


def color_scheme(n: int, colors: Sequence[str]) -> list[str]:
    """``n`` colours, the given ones over and over."""
    return [colors[i % len(colors)] for i in range(n)]


def tick_label(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, LABEL)


def _sampled(df: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """``size`` of ``n`` rows by a seeded draw without replacement; all rows if there are no more."""
    return df if size >= n else df.orderBy(F.rand(seed)).limit(size)


def categorical_counts(cols: Sequence, sample_size: int | None = 10_000, names: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """(dataset, value, label, n) of columns' values, missing ones left out, all columns drawn down to a common size.

    An empty column leaves nothing to compare: the result is empty.
    """
    refs = [as_ref(c) for c in cols]
    kind = common_type([r.field.dataType for r in refs])
    held = [r.df.select(r.value.cast(kind).cast("string").alias("value")).where("value IS NOT NULL") for r in refs]
    sizes = [h.count() for h in held]
    size = min(sizes) if sample_size is None else min(sample_size, *sizes)
    parts = [_sampled(h, n, size, seed).select(F.lit(name).alias("dataset"), "value") for h, n, name in zip(held, sizes, series_names(len(refs), names))]
    counted = reduce(DataFrame.unionAll, parts).groupBy("dataset", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.lit(size > 0)).select("dataset", "value", tick_label(F.col("value")).alias("label"), "n")


def density(values: DataFrame, column: str, n: int, deviation: float, low: float, high: float, grid: int = GRID, cut: float = CUT, clip: tuple[float, float] | None = None) -> DataFrame:
    """(x, density) by Gaussian kernels of Scott's width on a grid that reaches ``cut`` widths beyond the values.

    Each value adds to the points of the grid, so rows become counts per value first; the grid's size is a parameter.
    """
    width = deviation * n ** -0.2
    a, b = low - cut * width, high + cut * width
    if clip:
        a, b = max(a, clip[0]), min(b, clip[1])
    step = (b - a) / (grid - 1)
    counted = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    points = F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k")
    x = F.lit(a) + F.col("k") * F.lit(step)
    z = (x - F.col("v")) / F.lit(width)
    return counted.select("v", "w", points).groupBy("k").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s")).select(
        x.alias("x"), (F.col("s") / F.lit(n * width * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def continuous_column(col, grid: int = GRID) -> DataFrame:
    """(x, density) of one column; empty if it has fewer than two distinct values."""
    ref = as_ref(col)
    values = ref.df.select(profile_table(ref.df, [ref.name])[ref.name].ordinal_value(ref.value).alias("v")).where("v IS NOT NULL")
    n, deviation, low, high = values.agg(F.count("v"), F.stddev_samp("v"), F.min("v"), F.max("v")).first()
    if n < 2 or not deviation:
        return values.sparkSession.createDataFrame([], "x double, density double")
    return density(values, "v", n, deviation, low, high, grid)


def continuous_window(cols: Sequence, remove_outliers: float = 0.0, sample_size: int | None = None, names: Sequence[str] | None = None, seed: int = 0) -> tuple[DataFrame, tuple[float, float] | None]:
    """(dataset, value) of columns, each drawn down to ``sample_size``, within the window of the first one: its percentiles 50r and 100-50r, or all if these agree."""
    refs = [as_ref(c) for c in cols]
    read = lambda r: r.df.select(profile_table(r.df, [r.name])[r.name].ordinal_value(r.value).alias("value")).where("value IS NOT NULL")
    held = [read(r) for r in refs]
    sizes = [h.count() for h in held]
    drawn = [h if sample_size is None else _sampled(h, n, sample_size, seed) for h, n in zip(held, sizes)]
    parts = reduce(DataFrame.unionAll, [d.select(F.lit(name).alias("dataset"), "value") for d, name in zip(drawn, series_names(len(refs), names))])
    if not min(sizes):
        return parts.where(F.lit(False)), None
    size = sizes[0] if sample_size is None else min(sample_size, sizes[0])
    low, high = quantiles(drawn[0], {"v": F.col("value")}, (0.5 * remove_outliers, 1 - 0.5 * remove_outliers), {"v": size})["v"]
    if low == high:
        low, high = drawn[0].agg(F.min("value"), F.max("value")).first()
    return parts.where(F.col("value").between(low, high)), (low, high)


def continuous(cols: Sequence, remove_outliers: float = 0.0, sample_size: int | None = 10_000, names: Sequence[str] | None = None, seed: int = 0, grid: int = GRID) -> DataFrame:
    """(dataset, x, density) of columns within the window, each by kernels of its own width; clipped to the window if every column varies."""
    kept, window = continuous_window(cols, remove_outliers, sample_size, names, seed)
    found = kept.groupBy("dataset").agg(F.count("value"), F.stddev_samp("value"), F.min("value"), F.max("value")).collect()
    varies = len(found) == len(cols) and all(r[2] for r in found)
    parts = [kept.sparkSession.createDataFrame([], "dataset string, x double, density double")]
    for name, n, deviation, low, high in found:
        if n > 1 and deviation:
            made = density(kept.where(F.col("dataset") == name), "value", n, deviation, low, high, grid, clip=window if varies else None)
            parts.append(made.select(F.lit(name).alias("dataset"), "x", "density"))
    return reduce(DataFrame.unionByName, parts)


def cross_table(df: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """(a, b, n) of the pairs that occur; missing values are left out."""
    a, b = ColumnRef(df, col_a), ColumnRef(df, col_b)
    return df.select(a.value.cast("string").alias("a"), b.value.cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cross_tables(test: DataFrame, synth: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """(a, b, n_test, n_synth) over the grid of both tables' categories, zeros kept; in the order of a, then b."""
    x, y = cross_table(test, col_a, col_b).withColumnRenamed("n", "n_test"), cross_table(synth, col_a, col_b).withColumnRenamed("n", "n_synth")
    own = lambda c: x.select(c).union(y.select(c)).distinct()
    grid = own("a").crossJoin(own("b"))  # a plot's cells
    zero = F.lit(0).cast("long")
    return grid.join(x, ["a", "b"], "left").join(y, ["a", "b"], "left").select("a", "b", F.coalesce("n_test", zero).alias("n_test"), F.coalesce("n_synth", zero).alias("n_synth")).orderBy("a", "b")


def axes_grid(n: int, columns: int = 2) -> list[tuple[int, int, int]]:
    """(panel, row, column) of ``n`` panels."""
    return [(i, i // columns, i % columns) for i in range(n)]


def text_only(spark, text: str) -> DataFrame:
    """A panel that says something."""
    return spark.createDataFrame([("text", text)], "panel string, text string")


def dataset_plan(dfs: Sequence[DataFrame], columns: Sequence[str] | None = None, figure_cols: int = 2, max_categories: int = 10, check: Check | None = None) -> DataFrame:
    """(column, panel, row, col, rows, n_categories): how each column would be plotted; n_categories is 0 for continuous ones.

    The first table's kinds decide; a categorical column with more than ``max_categories`` values over all tables is a ``text`` panel; dates are ``continuous``.
    """
    check = check or ColumnCheck()
    names = list(columns or dfs[0].columns)
    specs = profile_table(dfs[0], names)
    kinds = {c: check.categorical(specs[c]) for c in names}
    both = [reduce(DataFrame.unionAll, [ColumnRef(d, c).df.select(F.lit(c).alias("column"), ColumnRef(d, c).value.cast("string").alias("v")) for d in dfs]) for c in names if kinds[c]]
    counts = {r.column: r.n for r in reduce(DataFrame.unionAll, both).where("v IS NOT NULL").groupBy("column").agg(F.count_distinct("v").alias("n")).collect()} if both else {}
    rows = []
    for i, r, k in axes_grid(len(names), figure_cols):
        c = names[i]
        n = counts.get(c, 0) if kinds[c] else None
        rows.append((c, "continuous" if n is None else "categorical" if n <= max_categories else "text", r, k, ceil(len(names) / figure_cols), n or 0))
    return dfs[0].sparkSession.createDataFrame(rows, "column string, panel string, row int, col int, rows int, n_categories long")


def dataset(dfs: Sequence[DataFrame], columns: Sequence[str] | None = None, remove_outliers: float = 0.0, figure_cols: int = 2, sample_size: int | None = 10_000, max_categories: int = 10,
            check: Check | None = None, seed: int = 0) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The plan of ``dataset_plan`` and each panel's data."""
    plan = dataset_plan(dfs, columns, figure_cols, max_categories, check)
    data = {}
    for r in plan.collect():
        refs = [ColumnRef(d, r.column) for d in dfs]
        if r.panel == "categorical":
            data[r.column] = categorical_counts(refs, sample_size, seed=seed)
        elif r.panel == "continuous":
            kept, window = continuous_window(refs, remove_outliers, sample_size, seed=seed)
            there = {x.dataset for x in kept.select("dataset").distinct().collect()}
            lacking = [i for i, n in enumerate(series_names(len(refs))) if n not in there]
            if lacking:  # nothing to compare
                data[r.column] = text_only(plan.sparkSession, f"{r.column}: column {lacking[0]} " + ("has no values" if window is None else "lies outside the first one's range"))
            else:
                data[r.column] = continuous(refs, remove_outliers, sample_size, seed=seed)
        else:
            data[r.column] = text_only(plan.sparkSession, f"{r.column}: {r.n_categories} categories, more than {max_categories}")
    return plan, data
