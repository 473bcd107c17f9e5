"""Resampling and confidence intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import isnan, sqrt
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.special import beta_quantile
from tabgauge.operators.base import OneColumnMetric, TwoColumnMetric, scalar
from tabgauge.operators.columns import as_ref, profile_table
from tabgauge.operators.histogram import common_type
from tabgauge.operators.metrics import (
    Bhattacharyya, EarthMovers, EarthMoversBinned, Hellinger, HistogramMetric, JensenShannon, KolmogorovSmirnov, KullbackLeibler, Mean, Norm, StandardDeviation, TotalVariation)

#: Distinct values of a column that replicates may be drawn from; the table of their counts goes to every task.
MOST_VALUES = 1_000_000


class ConfidenceInterval(NamedTuple):
    limits: tuple[float, float]
    level: float


def values_and_counts(x) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column (missing ones too) and how often they occur."""
    ref = as_ref(x)
    counted = ref.df.groupBy(ref.value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values: bin the column, or resample a histogram of it")
    rows.sort(key=lambda r: (r.v is None, str(r.v)))
    values = np.empty(len(rows), object)
    values[:] = [r.v for r in rows]
    return values, np.array([r.n for r in rows], np.int64)


Statistic = Callable[..., float]


def replicates(spark, tables: Sequence[tuple[np.ndarray, np.ndarray]], statistic: Statistic, n_samples: int, sizes: Sequence[int], seed: int) -> DataFrame:
    """(replicate, value): the statistic of (values, counts) pairs drawn with replacement, each replicate by a seed of its own."""

    def run(frames):
        for frame in frames:
            out = []
            for i in frame["id"]:
                rng = np.random.default_rng([seed, int(i)])
                drawn = [(v, rng.multinomial(size, n / n.sum()) if n.sum() else n) for (v, n), size in zip(tables, sizes)]
                got = statistic(*drawn)
                out.append(float("nan") if got is None else float(got))
            yield pd.DataFrame({"replicate": frame["id"], "value": out})

    return spark.range(n_samples, numPartitions=min(n_samples, spark.sparkContext.defaultParallelism * 2)).mapInPandas(run, "replicate long, value double")


def bootstrap_statistic(data: Sequence, statistic: Statistic, n_samples: int = 1000, sample_size: int | None = None, seed: int = 0) -> DataFrame:
    """(replicate, value) of a statistic over resampled columns. Columns are drawn independently, each to min(rows, sample_size) rows."""
    refs = [as_ref(x) for x in data]
    tables = [values_and_counts(r) for r in refs]
    most = max(int(n.sum()) for _, n in tables) if sample_size is None else sample_size
    return replicates(refs[0].df.sparkSession, tables, statistic, n_samples, [min(int(n.sum()), most) for _, n in tables], seed)


def bootstrap_binned_statistic(data: Sequence, statistic: Callable[..., float], n_samples: int = 1000, seed: int = 0) -> DataFrame:
    """(replicate, value) of a statistic over histograms (arrays of counts in bin order) that are drawn from their own shares."""
    counts = [np.asarray(x, np.int64) for x in data]
    spark = _active()
    tables = [(np.arange(len(c)), c) for c in counts]
    return replicates(spark, tables, lambda *drawn: statistic(*(n for _, n in drawn)), n_samples, [int(c.sum()) for c in counts], seed)


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


# Statistics of (values, counts) for replicates


def _numbers(drawn: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, n = drawn
    keep = np.array([x is not None for x in v], bool) & (n > 0)
    return np.array([float(x) for x in v[keep]]), n[keep]


def local_mean(drawn) -> float:
    v, n = _numbers(drawn)
    return float((v * n).sum() / n.sum()) if n.sum() else float("nan")


def local_deviation(drawn) -> float:
    v, n = _numbers(drawn)
    return sqrt(float((n * (v - (v * n).sum() / n.sum()) ** 2).sum())) if n.sum() else float("nan")


def _weighted_quantile(v: np.ndarray, n: np.ndarray, q: float) -> float:
    order = np.argsort(v)
    v, ends = v[order], np.cumsum(n[order])
    h = (ends[-1] - 1) * q
    low = int(h)
    x, y = v[np.searchsorted(ends, low, "right")], v[min(len(v) - 1, np.searchsorted(ends, low + 1, "right"))]
    return float(x + (h - low) * (y - x))


def local_shares(a, b, continuous: bool, edges: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares of both over bins of their own (or given) edges, or over categories."""
    if not continuous:
        keys = sorted({str(x) for v, n in (a, b) for x, k in zip(v, n) if x is not None and k})
        at = {k: i for i, k in enumerate(keys)}
        counts = []
        for v, n in (a, b):
            c = np.zeros(len(keys))
            for x, k in zip(v, n):
                if x is not None and k:
                    c[at[str(x)]] += k
            counts.append(c)
    else:
        from tabgauge.operators.histogram import auto_bins

        (va, na), (vb, nb) = _numbers(a), _numbers(b)
        if edges is None:
            v, n = np.concatenate([va, vb]), np.concatenate([na, nb])
            if not n.sum():
                return np.zeros(1), np.zeros(1)
            edges = auto_bins(int(n.sum()), float(v.min()), float(v.max()), _weighted_quantile(v, n, 0.25), _weighted_quantile(v, n, 0.75)).edges
        counts = [np.histogram(v, bins=edges, weights=n)[0] for v, n in ((va, na), (vb, nb))]
    return tuple(c / c.sum() if c.sum() else c * 0.0 for c in counts)


def local_histogram_metric(metric: HistogramMetric, p: np.ndarray, q: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        if isinstance(metric, (KullbackLeibler, JensenShannon)) and not (p.sum() and q.sum()):
            return float("nan")
        if isinstance(metric, KullbackLeibler):
            return float(np.where(p == 0, 0.0, p * np.log(p / q)).sum())
        if isinstance(metric, JensenShannon):
            m = (p + q) / 2
            side = lambda x: np.where(x == 0, 0.0, x * np.log(x / m)).sum()
            return sqrt(max(0.0, float(side(p) + side(q)) / 2))
    if isinstance(metric, Hellinger):
        return float(np.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum() / 2))
    if isinstance(metric, Norm):
        return float(np.linalg.norm(p - q, metric.ord))
    if isinstance(metric, Bhattacharyya):
        return float(np.sqrt(p * q).sum())
    if isinstance(metric, TotalVariation):
        return float(np.abs(p - q).sum() / 2)
    raise NotImplementedError(f"no resampled form of {metric.name}; use bootstrap_statistic with a statistic of your own")


def local_binned_distance(edges: Sequence[float] | None, x: np.ndarray, y: np.ndarray) -> float:
    if not x.sum() or not y.sum():
        return 0.0 if x.sum() == y.sum() else 1.0
    p, q = x / x.sum(), y / y.sum()
    if edges is None:
        return float(np.abs(p - q).sum() / 2)
    centers = (np.asarray(edges[1:]) + np.asarray(edges[:-1])) / 2
    return float((np.abs(np.cumsum(p - q))[:-1] * np.diff(centers)).sum())


def _statistic(metric, refs, fixed_bins: bool) -> Statistic:
    if isinstance(metric, Mean):
        return local_mean
    if isinstance(metric, StandardDeviation) and not metric.remove_outliers:
        return local_deviation
    if isinstance(metric, KolmogorovSmirnov):
        def ks(a, b):
            (va, na), (vb, nb) = _numbers(a), _numbers(b)
            at = np.unique(np.concatenate([va, vb]))
            cdf = lambda v, n: np.concatenate([[0], np.cumsum(n[np.argsort(v)])])[np.searchsorted(np.sort(v), at, "right")] / n.sum()
            return float(np.abs(cdf(va, na) - cdf(vb, nb)).max())
        return ks
    if isinstance(metric, EarthMovers):
        def emd(a, b):
            named = lambda d: (np.array(["nan" if x is None else str(x) for x in d[0]], object), d[1])
            p, q = local_shares(named(a), named(b), False)
            return float(np.abs(p - q).sum() / 2)
        return emd
    if isinstance(metric, HistogramMetric):
        from tabgauge.operators.histogram import aligned_histogram, joint

        held = joint(refs, metric.check)
        continuous = metric.check.continuous(held.all)
        edges = aligned_histogram(refs, metric.check, held=held).edges if continuous and fixed_bins else None
        return lambda a, b: local_histogram_metric(metric, *local_shares(a, b, continuous, edges))
    raise NotImplementedError(f"no resampled form of {metric.name}; use bootstrap_statistic with a statistic of your own")


def compute_bootstrap_interval(metric: OneColumnMetric | TwoColumnMetric, sr_a, sr_b=None, confidence_level: float = 0.95, binned: bool = False,
                               n_samples: int = 1000, seed: int = 0, fixed_bins: bool = False) -> ConfidenceInterval:
    """The basic bootstrap interval (2t - q_high, 2t - q_low) of a metric.

    Replicates bin their values anew, unless ``fixed_bins`` keeps the bins of the point estimate. Replicates are never stored. With ``binned`` the
    inputs are arrays of counts.
    """
    low, high = (1 - confidence_level) / 2 * 100, (1 + confidence_level) / 2 * 100
    if binned:
        edges = metric.bin_edges if isinstance(metric, EarthMoversBinned) else None
        statistic = lambda x, y: local_binned_distance(edges, x, y)
        point = statistic(np.asarray(sr_a), np.asarray(sr_b))
        drawn = bootstrap_binned_statistic([sr_a, sr_b], statistic, n_samples, seed)
    else:
        refs = [as_ref(x) for x in (sr_a, sr_b) if x is not None]
        with metric.not_kept():
            point = scalar(metric(*refs))
        drawn = bootstrap_statistic(refs, _statistic(metric, refs, fixed_bins), n_samples, None, seed)
    if point is None:
        return ConfidenceInterval((float("nan"), float("nan")), confidence_level)
    a, b = drawn.agg(F.when(F.count_if(F.isnan("value")) == 0, F.percentile("value", [low / 100, high / 100]))).first()[0] or (float("nan"), float("nan"))
    return ConfidenceInterval((2 * point - b, 2 * point - a), confidence_level)


def binomial_proportion_interval(success_prop: float, num_samples: int, method: str = "clopper-pearson", confidence_level: float = 0.95, exact_ends: bool = False) -> ConfidenceInterval:
    """An interval of a proportion by method ``normal``, ``clopper-pearson`` or ``agresti-coull``.

    Clopper-Pearson has a NaN end at proportions 0 and 1; ``exact_ends`` gives 0 and 1 there.
    """
    p, n, tail = success_prop, num_samples, (1 - confidence_level) / 2
    z = NormalDist().inv_cdf(1 - tail)
    if method == "normal":
        half = z * sqrt(p * (1 - p) / n)
        limits = (p - half, p + half)
    elif method == "clopper-pearson":
        k = p * n
        limits = (beta_quantile(tail, k, n - k + 1), beta_quantile(1 - tail, k + 1, n - k))
        if exact_ends:
            limits = (0.0 if isnan(limits[0]) else limits[0], 1.0 if isnan(limits[1]) else limits[1])
    elif method == "agresti-coull":
        more = n + z * z
        middle = (p * n + z * z / 2) / more
        half = z * sqrt(middle * (1 - middle) / more)
        limits = (middle - half, middle + half)
    else:
        raise ValueError(f"unknown method {method!r}: normal, clopper-pearson or agresti-coull")
    return ConfidenceInterval(limits, confidence_level)


def compute_binomial_interval(sr_a, sr_b, method: str = "clopper-pearson", confidence_level: float = 0.95) -> ConfidenceInterval:
    """The interval of the first column's proportion, moved by the second one's mean."""
    a, b = as_ref(sr_a), as_ref(sr_b)
    read = lambda r: r.value.cast("int").cast("double") if common_type([r.field.dataType]).typeName() == "boolean" else profile_table(r.df, [r.name])[r.name].read(r.value).cast("double")
    p, n = a.df.agg(F.avg(read(a)), F.count(F.lit(1))).first()
    shift = b.df.agg(F.avg(read(b))).first()[0]
    low, high = binomial_proportion_interval(p, n, method, confidence_level).limits
    return ConfidenceInterval((low - shift, high - shift), confidence_level)
