"""All metrics in one place."""

from tabgauge.operators.base import DataFrameMetric, Metric, OneColumnMetric, TwoColumnMetric, TwoDataFrameMetric, scalar
from tabgauge.operators.classify import Check, ColumnCheck, classify
from tabgauge.operators.columns import categorical, column
from tabgauge.operators.intervals import (
    ConfidenceInterval, binomial_proportion_interval, bootstrap_binned_statistic, bootstrap_statistic, compute_binomial_interval, compute_bootstrap_interval)
from tabgauge.operators.metrics import (
    Bhattacharyya, CramersV, EarthMovers, EarthMoversBinned, Hellinger, JensenShannon, KendallTau, KolmogorovSmirnov, KullbackLeibler, Mean, Norm, StandardDeviation, TotalVariation)
from tabgauge.operators.tables import CorrMatrix, DiffCorrMatrix, OneColumnMap, TwoColumnMap, compare_all

__all__ = [
    "Bhattacharyya", "Check", "ColumnCheck", "ConfidenceInterval", "CorrMatrix", "CramersV", "DataFrameMetric", "DiffCorrMatrix", "EarthMovers", "EarthMoversBinned", "Hellinger",
    "JensenShannon", "KendallTau", "KolmogorovSmirnov", "KullbackLeibler", "Mean", "Metric", "Norm", "OneColumnMap", "OneColumnMetric", "StandardDeviation", "TotalVariation",
    "TwoColumnMap", "TwoColumnMetric", "TwoDataFrameMetric", "binomial_proportion_interval", "bootstrap_binned_statistic", "bootstrap_statistic", "categorical", "classify", "column",
    "compare_all", "compute_binomial_interval", "compute_bootstrap_interval", "scalar",
]

#: The metrics' long names.
BhattacharyyaCoefficient, EarthMoversDistance, EarthMoversDistanceBinned, HellingerDistance = Bhattacharyya, EarthMovers, EarthMoversBinned, Hellinger
JensenShannonDivergence, KendallTauCorrelation, KolmogorovSmirnovDistance, KullbackLeiblerDivergence = JensenShannon, KendallTau, KolmogorovSmirnov, KullbackLeibler
TotalVariationDistance = TotalVariation
__all__ += [
    "BhattacharyyaCoefficient", "EarthMoversDistance", "EarthMoversDistanceBinned", "HellingerDistance", "JensenShannonDivergence", "KendallTauCorrelation", "KolmogorovSmirnovDistance",
    "KullbackLeiblerDivergence", "TotalVariationDistance",
]
