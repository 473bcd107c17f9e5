"""Values of metrics on small inputs, identities, and independence of the partitioning."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabgauge.metrics as m
from tabgauge.functions import order
from tabgauge.functions.special import beta_cdf, beta_quantile
from tabgauge.operators import kendall
from tabgauge.operators.columns import as_ref, profile_table
from tabgauge.operators.histogram import aligned_histogram
from tabgauge.operators.metrics import HISTOGRAM_METRICS


class Numbers(m.ColumnCheck):
    """Everything that reads as a number is continuous."""

    def continuous(self, spec):
        return spec.is_number

    def categorical(self, spec):
        return False


def s(values, name="x", **kw):
    return pd.Series(values, name=name, **kw)


def test_mean(spark):
    assert m.Mean().value(s(range(100))) == 49.5
    assert m.Mean().value(s(pd.date_range("2020-01-01", periods=3))) == datetime(2020, 1, 2)
    assert m.Mean().value(s(list("abcd"))) is None
    gap = s([pd.Timestamp("2020-01-01"), pd.NaT, pd.Timestamp("2020-01-03")])
    assert m.Mean().value(gap) is None and m.Mean(skipna=True).value(gap) == datetime(2020, 1, 2)
    assert m.Mean().value(s([*map(float, range(20)), np.nan])) == 9.5
    assert m.Mean().value(s([str(k) for k in range(20)])) == 9.5


def test_standard_deviation(spark):
    x = np.random.default_rng(1).normal(size=300)
    assert m.StandardDeviation().value(s(x)) == pytest.approx(math.sqrt(((x - x.mean()) ** 2).sum()))
    assert m.StandardDeviation(normalize=True).value(s(x)) == pytest.approx(x.std(ddof=1))
    for r in (0.1, 0.25):
        y = np.sort(x)[int(300 * r) : int(300 * (1 - r))]
        assert m.StandardDeviation(remove_outliers=r).value(s(x)) == pytest.approx(math.sqrt(((y - y.mean()) ** 2).sum()))
    days = pd.date_range("2020-01-01", periods=20)
    assert m.StandardDeviation().value(s(days)).total_seconds() == pytest.approx(86400 * math.sqrt(((np.arange(20) - 9.5) ** 2).sum()), abs=1e-3)
    assert m.StandardDeviation().value(s(list("abcd"))) is None
    assert m.StandardDeviation(remove_outliers=0.5).value(s(range(100))) is None


def test_earth_movers(spark):
    assert m.EarthMovers().value(s(np.random.default_rng(1).normal(size=99)), s(np.random.default_rng(2).normal(size=99))) is None
    assert m.EarthMovers().value(s(list("aabb")), s(list("abbb"))) == 0.25
    assert m.EarthMovers().value(s(["a", None]), s(["a", "a"])) == 0.5  # a missing value is a category
    assert m.EarthMovers().value(s(["1", "2"] * 9), s([1.0, 2.0] * 9)) == 1.0  # "1" and "1.0" are two


def test_kendall(spark):
    kind = lambda x, c: s(pd.Categorical(list(x), categories=list(c), ordered=True))
    frame = pd.DataFrame({"e": kind("abbccc", "abc"), "f": kind("feeddd", "fed")})
    e, f = as_ref(frame["e"]), as_ref(frame["f"])
    from tabgauge.operators.columns import ColumnRef, categorical

    both = spark.createDataFrame(list(zip("abbccc", "feeddd")), "e string, f string")
    both = categorical(categorical(both, "e", "abc", True), "f", "fed", True)
    assert m.KendallTau().value(ColumnRef(both, "e"), ColumnRef(both, "f")) == pytest.approx(1.0)
    assert profile_table(e.df)["e"].ordered and profile_table(f.df)["f"].categories == ("f", "e", "d")
    assert m.KendallTau().value(s([1.0, 2.0]), s(list("abc"))) is None
    held = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, b double")
    assert math.isnan(m.KendallTau().value(m.column(held, "a"), m.column(held, "b")))
    keyed = spark.createDataFrame([(k, float(k)) for k in range(30)], "k long, a double"), spark.createDataFrame([(k, float(-k)) for k in range(30)], "k long, b double")
    assert m.KendallTau(align_on=["k"]).value(m.column(keyed[0], "a"), m.column(keyed[1], "b")) == pytest.approx(-1.0)
    narrow = held.select(F.col("a").cast("float").alias("a"), "b")
    assert m.KendallTau().value(m.column(narrow, "a"), m.column(narrow, "b")) is None


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())


@pytest.mark.parametrize("slab", [100_000, 40, 7])
def test_kendall_by_slabs(spark, slab):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(400) < 0.4, 5.0, rng.integers(0, 30, 400))  # a frequent value
    y = np.round(x / 2 + rng.normal(size=400) * 6)
    pairs = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(5)
    assert kendall.tau_b(pairs, slab_pairs=slab) == pytest.approx(brute_tau(x, y))


def test_cramers_v(spark):
    b = [1, 2, 3, 2, 3, 1, 3, 1, 2] * 100
    held = spark.createDataFrame([(x, str(x), y) for x, y in zip(np.repeat([1, 2, 3], 300).tolist(), b)], "a long, b string, c long")
    v = lambda p, q: m.CramersV().value(m.column(held, p), m.column(held, q))
    assert v("a", "b") > 0.99 and v("a", "c") == 0.0
    wide = spark.range(200).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert m.CramersV().value(m.column(wide, "x"), m.column(wide, "y")) is None
    one = held.select("a", F.lit("k").alias("k"), F.lit(None).cast("string").alias("n"))
    assert m.CramersV().value(m.column(one, "a"), m.column(one, "k")) == 0.0
    assert math.isnan(m.CramersV().value(m.column(one, "a"), m.column(one, "n")))


@pytest.mark.parametrize("metric, x, y, want", [
    (m.KullbackLeibler(), [1, 0], [1, 0], 0), (m.KullbackLeibler(), [1, 1], [0, 0], math.inf), (m.JensenShannon(), [1, 0], [1, 0], 0), (m.Norm(), [1, 0], [1, 0], 0), (m.Hellinger(), [1, 0], [1, 0], 0),
    (m.TotalVariation(), [1, 0], [1, 0], 0), (m.Norm(ord=1), [1], [0], 2), (m.Hellinger(), [1], [0], 1), (m.TotalVariation(), [1], [0], 1), (m.Bhattacharyya(), [1, 0], [1, 0], 1), (m.Bhattacharyya(), [1], [0], 0),
    (m.JensenShannon(), [1], [0], math.sqrt(math.log(2))), (m.Norm(ord=math.inf), [1, 0], [1, 1], 0.5), (m.Norm(ord=-math.inf), [1, 0, 0, 0], [1, 0, 0, 2], 0.0), (m.Norm(ord=0), [1, 0], [1, 1], 2), (m.Norm(ord=-1), [1, 0], [1, 1], 0.25),
])
def test_histogram_values(spark, metric, x, y, want):
    assert metric.value(s(x), s(y)) == pytest.approx(want)


def test_empty_side(spark):
    empty = s([None, None], dtype=object)
    x = s(["a", "b"])
    assert math.isnan(m.KullbackLeibler().value(x, empty)) and math.isnan(m.JensenShannon().value(x, empty))
    assert m.TotalVariation().value(x, empty) == 0.5 and m.Hellinger().value(x, empty) == pytest.approx(0.5**0.5) and m.Bhattacharyya().value(x, empty) == 0


def test_kolmogorov_smirnov(spark):
    ks = m.KolmogorovSmirnov(Numbers())
    assert ks.value(s([1, 2, 3, 3]), s([1, 1, 2, 3])) == 0.25
    assert ks.value(s([1, 2, 3]), s([11, 12, 13])) == 1
    assert ks.value(s([], dtype=float), s([1, 2])) == 1
    assert 0 <= ks.value(s([1.0, None, 3.0]), s([1, 2, 3])) <= 1
    assert m.KolmogorovSmirnov().value(s(list("ab")), s(list("ab"))) is None


def test_binned_earth_movers(spark):
    emd = lambda x, y, edges=None: m.EarthMoversBinned(bin_edges=edges).value(s(x, "x"), s(y, "y"))
    assert emd([1, 2, 3], [1, 0, 3], [0, 1, 2, 3]) == pytest.approx(0.333, rel=0.1)
    rng = np.random.default_rng(5)
    a, b = rng.normal(10, 1, 10_000), rng.normal(14, 1, 10_000)
    edges = np.histogram_bin_edges(np.concatenate([a, b]), 100)
    assert emd(np.histogram(a, edges)[0], np.histogram(b, edges)[0], edges) == pytest.approx(4.0, rel=0.1)
    assert emd([0, 3, 6, 14, 3], [1, 0, 8, 21, 1]) == pytest.approx(0.20, abs=0.01)
    assert emd([0, 0], [0, 0]) == 0.0 and emd([0, 0], [1, 2]) == 1.0 and emd([1, 2], [1, 2]) == 0.0


def normal_pair(n=600, seed=7):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, n), rng.normal(0.4, 1.3, n)


def numpy_edges(v):
    """Bins by the older rule, without the lower bounds that later releases added."""
    q1, q3 = np.percentile(v, [25, 75])
    fd, sturges = 2 * (q3 - q1) * len(v) ** (-1 / 3), np.ptp(v) / (np.log2(len(v)) + 1)
    return np.linspace(v.min(), v.max(), int(np.ceil(np.ptp(v) / (min(fd, sturges) if fd else sturges))) + 1)


def test_histogram_against_numpy(spark):
    a, b = normal_pair()
    h = aligned_histogram([as_ref(s(a, "x")), as_ref(s(b, "x"))])
    edges = numpy_edges(np.concatenate([a, b]))
    assert h.n_bins == len(edges) - 1 and np.allclose(h.edges, edges)
    rows = h.filled(normalize=False).orderBy("bin").collect()
    assert [r.c0 for r in rows] == np.histogram(a, edges)[0].tolist() and [r.c1 for r in rows] == np.histogram(b, edges)[0].tolist()
    whole = aligned_histogram([as_ref(s([3.0] * 5, "x")), as_ref(s([3.0] * 2, "x"))], Numbers())
    assert whole.edges == (2.5, 3.5)
    given = aligned_histogram([as_ref(s(a, "x"))], bin_edges=[-1, 0, 1])
    assert [r.c0 for r in given.df.orderBy("bin").collect()] == np.histogram(a, [-1, 0, 1])[0].tolist()


def test_identities(spark):
    a, b = (s(v) for v in normal_pair())
    h, tv, bc, js, kl = (k().value(a, b) for k in (m.Hellinger, m.TotalVariation, m.Bhattacharyya, m.JensenShannon, m.KullbackLeibler))
    assert bc == pytest.approx(1 - h * h) and h * h < tv < math.sqrt(2) * h and 0 <= js <= math.sqrt(math.log(2)) and kl >= 0
    assert m.Norm(ord=1).value(a, b) == pytest.approx(2 * tv)
    for k in HISTOGRAM_METRICS:
        if k.symmetric:
            assert k().value(a, b) == pytest.approx(k().value(b, a))


def test_partitioning_does_not_matter(spark):
    a, b = normal_pair(300)
    held = spark.createDataFrame([(float(x), float(y), "abc"[k % 3]) for k, (x, y) in enumerate(zip(a, b))], "x double, y double, g string")
    seen = set()
    for n in (1, 3, 8):
        d = held.repartition(n)
        seen.add(tuple(round(v, 9) for v in (
            m.Hellinger().value(m.column(d, "x"), m.column(d, "y")), m.KolmogorovSmirnov().value(m.column(d, "x"), m.column(d, "y")), m.KendallTau().value(m.column(d, "x"), m.column(d, "y")),
            m.StandardDeviation(remove_outliers=0.2).value(m.column(d, "x")))))
    assert len(seen) == 1


def test_numeric_text_against_numbers(spark):
    metric = m.KullbackLeibler(Numbers())
    assert metric.value(s(["01", "2", "3", "4"]), s(["1", "2", "2", "4"])) == metric.value(s([1, 2, 3, 4]), s([1, 2, 2, 4]))


def test_running_sums_and_quantiles_of_large_tables(spark):
    """Small limits make the ways for large tables run."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=4000).round(2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)
    got = order.quantiles(df, {"v": F.col("v")}, (0.0, 0.25, 0.5, 0.9, 1.0), {"v": len(v)}, at_once=50)["v"]
    assert np.allclose(got, np.percentile(v, [0, 25, 50, 90, 100]))
    hot = spark.createDataFrame([(1.0 if k % 3 else float(k),) for k in range(900)], "v double")
    assert order.quantiles(hot, {"v": F.col("v")}, (0.1, 0.5), {"v": 900}, at_once=20)["v"] == pytest.approx(np.percentile([1.0 if k % 3 else float(k) for k in range(900)], [10, 50]).tolist())
    counts = df.groupBy("v").agg(F.count("v").alias("w"))
    for slab in (10, 100_000):
        rows = order.running_sums(counts, "v", ["w"], slab=slab).orderBy("v").collect()
        values, n = np.unique(v, return_counts=True)
        assert [r.cum_w for r in rows] == np.cumsum(n).tolist() and [r.v for r in rows] == values.tolist()
    keyed = df.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"), "v").groupBy("k", "v").agg(F.count("v").alias("w"))
    rows = order.running_sums(keyed, "v", ["w"], ["k"], slab=20).where("k = 'b'").orderBy("v").collect()
    assert [r.cum_w for r in rows] == np.cumsum(n).tolist()


def test_beta():
    assert beta_quantile(0.025, 3, 2) == pytest.approx(0.194120, abs=1e-6) and beta_quantile(0.975, 4, 1) == pytest.approx(0.993691, abs=1e-6)
    assert math.isnan(beta_quantile(0.5, 0, 3)) and beta_cdf(0.3, 2, 5) == pytest.approx(0.579825)


def test_intervals(spark):
    a, b = s(["a", "b", "c"]), s(["c", "b", "a"])
    found = m.compute_bootstrap_interval(m.EarthMovers(), a, b, n_samples=50)
    assert found.level == 0.95 and found.limits[0] <= found.limits[1]
    x = s(np.random.default_rng(2).normal(5, 1, 400))
    low, high = m.compute_bootstrap_interval(m.Mean(), x, n_samples=300).limits
    assert low < x.mean() < high and high - low == pytest.approx(2 * 1.96 / 20, rel=0.25)
    assert m.compute_bootstrap_interval(m.Mean(), x, n_samples=300).limits == (low, high)  # seeded
    y, z = (s(v) for v in normal_pair(200))
    for metric in (m.Hellinger(), m.KolmogorovSmirnov(), m.KullbackLeibler(), m.JensenShannon(), m.Norm(), m.Bhattacharyya(), m.TotalVariation()):
        for fixed in (False, True):
            found = m.compute_bootstrap_interval(metric, y, z, n_samples=20, fixed_bins=fixed).limits
            assert math.isinf(found[0]) or found[0] <= found[1] or math.isnan(found[0])
    assert m.compute_bootstrap_interval(m.EarthMoversBinned(bin_edges=[0, 1, 2]), [3, 4], [5, 6], binned=True, n_samples=50).limits[0] is not None
    assert math.isnan(m.compute_bootstrap_interval(m.Mean(), s(list("abcd")), n_samples=5).limits[0])


@pytest.mark.parametrize("method", ["normal", "clopper-pearson", "agresti-coull"])
def test_binomial(spark, method):
    for a, b in (([1, 0], [1, 0]), ([1, 0, 1, 1], [1, 0, 1, 0]), ([1, 1], [0, 0])):
        found = m.compute_binomial_interval(s(a), s(b), method, 0.9)
        assert found.level == 0.9 and None not in found.limits
    with pytest.raises(ValueError):
        m.binomial_proportion_interval(0.5, 10, "other")
    assert math.isnan(m.binomial_proportion_interval(0.0, 10).limits[0]) and m.binomial_proportion_interval(0.0, 10, exact_ends=True).limits[0] == 0.0


def test_registry_and_configuration():
    assert m.Norm(ord=3).to_dict() == {"name": "norm", "ord": 3.0} and str(m.Norm()) == "norm" and repr(m.Norm()) == "Norm()"
    config = {"name": "norm", "ord": 1.0}
    check = m.ColumnCheck(3)
    made = m.Mean.from_dict(config, check=check)
    assert isinstance(made, m.Norm) and made.ord == 1.0 and made.check is check and config == {"name": "norm", "ord": 1.0}
    nested = m.Metric.from_dict({"name": "two_column_map", "metric": {"name": "norm", "ord": 1.0}})
    assert isinstance(nested, m.TwoColumnMap) and nested.metric.ord == 1.0
    with pytest.raises(TypeError):
        m.Norm(1)


def test_metrics_of_ones_own(spark):
    class Most(m.OneColumnMetric):
        name = "most"

        def check_column_types(self, spec, check=None):
            return self.check.affine(spec)

        def compute(self, ref, spec):
            from tabgauge.operators.base import as_result

            return as_result(ref.df.agg(F.max(spec.read(ref.value)).alias("value")), self.name, ref.name, None)

    assert Most().value(s(range(50))) == 49 and m.Metric.from_dict({"name": "most"}).value(s(list("ab"))) is None
    assert m.OneColumnMap(Most())(spark.range(40).select("id", F.lit("a").alias("t"))).orderBy("column").collect()[0].value == 39
    del m.Metric.registry["most"]


def test_timedelta(spark):
    d = s([timedelta(seconds=k) for k in range(30)])
    spec = profile_table(as_ref(d).df)["x"]
    assert m.ColumnCheck().continuous(spec) and m.ColumnCheck().ordinal(spec)
