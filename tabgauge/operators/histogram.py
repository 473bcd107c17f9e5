"""Aligned histograms of several columns: shared bins of numbers, or shared categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions.order import quantiles
from tabgauge.operators.classify import Check, ColumnCheck
from tabgauge.operators.columns import QUARTERS, ColumnRef, ColumnSpec, profile


@dataclass(frozen=True)
class Bins:
    """``count`` equal bins from ``low`` to ``high``; the last one is closed."""

    low: float
    high: float
    count: int

    @property
    def step(self) -> float:
        return (self.high - self.low) / self.count

    @property
    def edges(self) -> list[float]:
        return [k * self.step + self.low for k in range(self.count)] + [self.high]

    def index(self, v: Column) -> Column:
        return bin_index(v, F.lit(self.low), F.lit(self.step), F.lit(self.count))


def bin_index(v: Column, low: Column, step: Column, count: Column) -> Column:
    """The bin of a number within the bounds: by division, then moved by one where rounding put it beyond an edge."""
    k = F.least(F.greatest(F.floor((v - low) / step), F.lit(0)), count - 1).cast("long")
    return F.when(v < k * step + low, k - 1).when((k < count - 1) & (v >= (k + 1) * step + low), k + 1).otherwise(k)


def auto_bins(n: int, low: float, high: float, q1: float, q3: float) -> Bins:
    """The narrower of Freedman-Diaconis' and Sturges' widths; Sturges' if the quartiles agree."""
    if low == high:
        return Bins(low - 0.5, high + 0.5, 1)
    sturges, fd = (high - low) / (log2(n) + 1.0), 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    return Bins(low, high, max(1, ceil((high - low) / (min(fd, sturges) if fd > 0 else sturges))))


@dataclass(frozen=True)
class Histogram:
    """``df``: (bin, c0, c1, ...) counts by bin; a bin that is empty on all sides may be absent."""

    df: DataFrame
    continuous: bool
    totals: tuple[float, ...]
    n_bins: int | None  # of a continuous one
    edges: tuple[float, ...] | None = None

    def shares(self) -> DataFrame:
        """(bin, p0, p1, ...): counts over their total; all 0 where the total is 0."""
        return self.df.select("bin", *[(F.col(f"c{i}") / float(t) if t else F.lit(0.0)).alias(f"p{i}") for i, t in enumerate(self.totals)])

    def filled(self, normalize: bool = True) -> DataFrame:
        """All bins, empty ones too."""
        held = self.shares() if normalize else self.df
        if self.n_bins is None:
            return held
        bins = held.sparkSession.range(self.n_bins).select(F.col("id").alias("bin"))
        return bins.join(held, "bin", "left").na.fill(0)


def common_type(kinds: Sequence[T.DataType]) -> T.DataType:
    """The type of a concatenation: equal types stay, numbers become double, times timestamp, other mixtures text."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(k, numbers) for k in kinds):
        return T.LongType()
    if all(isinstance(k, (*numbers, T.FloatType, T.DoubleType, T.DecimalType)) for k in kinds):
        return T.DoubleType()
    if all(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return T.TimestampType()
    return T.StringType()


def stacked(refs: Sequence[ColumnRef]) -> tuple[DataFrame, T.StructField]:
    """(side, v) of all columns, by one scan where they are of one table; and the field of v."""
    kind = common_type([r.field.dataType for r in refs])
    metadata = refs[0].field.metadata if all(r.field.metadata == refs[0].field.metadata for r in refs) else {}
    field = T.StructField(refs[0].name, kind, True, metadata)
    if len(refs) > 1 and all(r.df is refs[0].df for r in refs):
        sides = F.array(*[F.struct(F.lit(i).alias("side"), r.value.cast(kind).alias("v")) for i, r in enumerate(refs)])
        return refs[0].df.select(F.explode(sides).alias("s")).select("s.side", "s.v"), field
    parts = [r.df.select(F.lit(i).alias("side"), r.value.cast(kind).alias("v")) for i, r in enumerate(refs)]
    return reduce(DataFrame.unionAll, parts), field


@dataclass(frozen=True)
class Joint:
    """Columns put one below the other, with the specs of each and of all."""

    df: DataFrame
    specs: tuple[ColumnSpec, ...]
    all: ColumnSpec


def joint(refs: Sequence[ColumnRef], check: Check | None = None) -> Joint:
    df, field = stacked(refs)
    # each column is classified by its own type, the concatenation by the common one
    own = [T.StructField(r.name, r.field.dataType, True, r.field.metadata) for r in refs]
    *specs, every = profile(df, [(F.col("v"), [*own, field])], "side", check=check)[0]
    return Joint(df, tuple(specs), every)


def category(spec: ColumnSpec, c: Column) -> Column:
    """What a category is counted by: the number where numbers are spelled, else the value as text."""
    return spec.read(c).cast("string")


def aligned_histogram(refs: Sequence[ColumnRef], check: Check | None = None, bin_edges: Sequence[float] | None = None, held: Joint | None = None) -> Histogram:
    """Counts of each column over shared bins (if their concatenation is continuous) or shared categories. Missing values don't count."""
    check = check or ColumnCheck()
    held = held or joint(refs, check)
    continuous = check.continuous(held.all)
    sides = range(len(refs))
    count = lambda i: F.count_if(F.col("side") == i).cast("double").alias(f"c{i}")
    if not continuous:
        keyed = held.df.select("side", category(held.all, F.col("v")).alias("bin")).where(F.col("bin").isNotNull())
        return Histogram(keyed.groupBy("bin").agg(*map(count, sides)), False, tuple(float(s.n_present) for s in held.specs), None)
    v = held.all.read(F.col("v"))
    values = held.df.select("side", v.alias("v")).where(F.col("v").isNotNull())
    if bin_edges is not None:
        edges = [float(e) for e in bin_edges]
        within = values.where(F.col("v").between(edges[0], edges[-1]))
        if len(edges) > 2:
            within = Bucketizer(splits=edges, inputCol="v", outputCol="_b").transform(within).withColumn("bin", F.col("_b").cast("long"))
        else:
            within = within.withColumn("bin", F.lit(0).cast("long"))
        counted = within.groupBy("bin").agg(*map(count, sides))
        totals = counted.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)) for i in sides]).first()
        return Histogram(counted, True, tuple(totals), len(edges) - 1, tuple(edges))
    one = held.all
    q1, q3 = quantiles(values, {"v": F.col("v")}, QUARTERS, {"v": one.n_present}, uniques={"v": one.n_unique}, brackets={"v": one.brackets})["v"]
    bins = auto_bins(one.n_present, one.low, one.high, q1, q3)
    counted = values.groupBy(bins.index(F.col("v")).alias("bin")).agg(*map(count, sides))
    return Histogram(counted, True, tuple(float(s.n_present) for s in held.specs), bins.count, tuple(bins.edges))


@dataclass(frozen=True)
class PairedColumn:
    """What is known of a column that two tables share."""

    name: str
    old: ColumnSpec
    new: ColumnSpec
    all: ColumnSpec
    bins: Bins | None


def paired(old: DataFrame, new: DataFrame, names: Sequence[str], check: Check, with_bins: bool = True) -> tuple[DataFrame, dict[str, PairedColumn]]:
    """Both tables one below the other, with a ``side``, and the profiles of all columns by one pass over them."""
    kinds = {c: common_type([old.schema[c].dataType, new.schema[c].dataType]) for c in names}
    part = lambda df, side: df.select(F.lit(side).alias("_side"), *[ColumnRef(df, c).value.cast(kinds[c]).alias(c) for c in names])
    both = part(old, 0).unionAll(part(new, 1))
    fields = [[old.schema[c], new.schema[c], T.StructField(c, kinds[c], True, old.schema[c].metadata)] for c in names]
    found = dict(zip(names, profile(both, [(F.col(f"`{c}`"), f) for c, f in zip(names, fields)], "_side", check=check)))
    every = {c: found[c][-1] for c in names}
    numeric = {c: every[c].read(F.col(f"`{c}`")) for c in names if check.continuous(every[c])} if with_bins else {}
    bins: dict[str, Bins] = {}
    if numeric:
        quarter = quantiles(both, numeric, QUARTERS, {c: every[c].n_present for c in numeric}, uniques={c: every[c].n_unique for c in numeric}, brackets={c: every[c].brackets for c in numeric})
        bins = {c: auto_bins(every[c].n_present, every[c].low, every[c].high, *quarter[c]) for c in numeric}
    return both, {c: PairedColumn(c, *found[c], bins.get(c)) for c in names}


def paired_counts(both: DataFrame, columns: Mapping[str, PairedColumn]) -> DataFrame:
    """(column, bin, c0, c1) of all columns in one shuffle; bins as text."""
    cells = []
    for name, p in columns.items():
        v = F.col(f"`{name}`")
        bin_ = p.bins.index(p.all.read(v)).cast("string") if p.bins else category(p.all, v)
        cells.append(F.struct(F.lit(name).alias("column"), bin_.alias("bin")))
    long = both.select("_side", F.explode(F.array(*cells)).alias("s")).select("_side", "s.column", "s.bin").where(F.col("bin").isNotNull())
    count = lambda i: F.count_if(F.col("_side") == i).cast("double").alias(f"c{i}")
    return long.groupBy("column", "bin").agg(count(0), count(1))
