"""Exact quantiles and running sums whose tasks hold a bounded share of the values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import floor, inf, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values up to which one aggregation may keep all of them, or those between two bounds.
AT_ONCE = 100_000
#: Distinct values up to which an exact aggregation holds them all, however many rows there are.
FEW_VALUES = 4_096
#: Rows that one window partition of a running sum should have, and slabs up to which their totals are broadcast.
SLAB, MOST_BROADCAST = 500_000, 100_000
#: Size of the quantile sketches, and how far to either side of a probability bounds are asked of them; their error is about half as much.
SKETCH, MARGIN = 2_000, 0.004


def around(probabilities: Sequence[float], margin: float = MARGIN) -> list[float]:
    """Two probabilities around each."""
    return [min(1.0, max(0.0, x)) for p in probabilities for x in (p - margin, p + margin)]


@dataclass
class _Target:
    """An order statistic that is looked for: ranks ``first`` and ``last`` of a column, within the closed bounds, below which ``below`` values lie and between which ``inside``."""

    column: str
    place: int
    first: int
    last: int
    share: float
    inside: int
    below: int = 0
    low: float = -inf
    high: float = inf
    margin: float = MARGIN
    bracket: tuple[float, float] | None = None


def quantiles(df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float], counts: Mapping[str, int], at_once: int = AT_ONCE,
              uniques: Mapping[str, int] | None = None, brackets: Mapping[str, Sequence[float]] | None = None) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation of each column; ``counts`` has the numbers of its non-null values.

    Columns with few values or few distinct ones (``uniques``) take one exact aggregation. For all others a sketch gives bounds (or ``brackets``, asked at ``around(probabilities)``), and one
    aggregation counts what lies below them and keeps what lies between. Where that is too much, or a bound missed, the same is done again between the bounds. All columns share each pass.
    """
    uniques, brackets = uniques or {}, brackets or {}
    out: dict[str, list[float]] = {k: [0.0] * len(probabilities) for k in columns if counts[k] > 0}
    value = {k: columns[k].cast("double") for k in out}
    easy = [k for k in out if counts[k] <= at_once or uniques.get(k, FEW_VALUES + 1) <= FEW_VALUES]
    open_: list[_Target] = []
    for k in out:
        for i, p in enumerate(probabilities):
            if k not in easy:
                h = (counts[k] - 1) * p
                given = brackets.get(k)
                open_.append(_Target(k, i, floor(h), floor(h) + (h > floor(h)), h - floor(h), counts[k], bracket=(given[2 * i], given[2 * i + 1]) if given and None not in given else None))
    while easy or open_:
        blind = [t for t in open_ if t.bracket is None]
        if blind:
            within = lambda t: value[t.column] if t.low == -inf and t.high == inf else F.when(value[t.column].between(t.low, t.high), value[t.column])
            mid = lambda t: ((t.first + t.last) / 2 - t.below) / max(1, t.inside - 1)
            row = df.agg(*[F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(within(t), F.lit(SKETCH)), F.array(*map(F.lit, around([mid(t)], t.margin)))).alias(f"b{i}") for i, t in enumerate(blind)]).first()
            for i, t in enumerate(blind):
                t.bracket = (row[i][0], row[i][1])
        aggs = [F.percentile(value[k], list(probabilities)).alias(f"e{i}") for i, k in enumerate(easy)]
        kept = [3 * t.margin * t.inside <= at_once or t.inside <= at_once for t in open_]
        for i, (t, keep) in enumerate(zip(open_, kept)):
            v, (a, b) = value[t.column], t.bracket
            between = (v > a) & (v < b)
            aggs += [F.count_if(v < a).alias(f"l{i}"), F.count_if(v == a).alias(f"a{i}"), F.count_if(v == b).alias(f"b{i}"), (F.sort_array(F.collect_list(F.when(between, v))) if keep else F.count_if(between)).alias(f"m{i}")]
        row = df.agg(*aggs).first()
        for i, k in enumerate(easy):
            out[k] = list(row[f"e{i}"])
        easy, rest = [], []
        for i, (t, keep) in enumerate(zip(open_, kept)):
            a, b = t.bracket
            below, at_a, at_b = row[f"l{i}"], row[f"a{i}"], row[f"b{i}"] if b > a else 0
            middle = row[f"m{i}"] if keep else None
            n = len(middle) if keep else row[f"m{i}"]
            found = [a if below <= r < below + at_a else b if below + at_a + n <= r < below + at_a + n + at_b else middle[r - below - at_a] if keep and below + at_a <= r < below + at_a + n else None for r in (t.first, t.last)]
            if None not in found:
                out[t.column][t.place] = found[0] + t.share * (found[1] - found[0])
                continue
            if below <= t.first and t.last < below + at_a + n + at_b:  # found, but too many are between
                t.low, t.high, t.below, t.inside = a, b, below, at_a + n + at_b
            else:
                t.margin *= 4
            t.bracket = None
            rest.append(t)
        open_ = rest
    return out


def _slab_of(cuts: Column, steps: int, v: Column) -> Column:
    """The number of cuts below v, by two short scans: of every m-th cut, and of the m cuts from there on."""
    m = max(1, isqrt(steps))
    heads = F.filter(cuts, lambda x, i: (i % m == 0) & (x < v))
    start = F.greatest(F.size(heads) - 1, F.lit(0)) * m
    return start + F.size(F.filter(F.slice(cuts, start + 1, m), lambda x: x < v))


def running_sums(df: DataFrame, by: str, sums: Sequence[str], keys: Sequence[str] = (), n: int | None = None, slab: int = SLAB) -> DataFrame:
    """``df`` with ``cum_<c>`` for each of ``sums``: the sum over rows of the same ``keys`` whose ``by`` is at most the row's.

    ``by`` is distinct within the keys, so ``df`` is a table of counts by value; ``n`` is the rows of the largest key. Beyond ``slab`` rows, values are cut at approximate quantiles into slabs;
    a window runs over each slab, and the sums of the slabs before it are added (as many rows as there are slabs).
    """
    n = df.count() if n is None else n
    order = Window.partitionBy(*keys, "_slab").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    if n <= slab:
        held = df.withColumn("_slab", F.lit(0))
        return held.select(*df.columns, *[F.sum(c).over(order).alias(f"cum_{c}") for c in sums])
    steps = -(-n // slab)
    cuts = df.groupBy(*keys).agg(F.percentile_approx(by, [i / steps for i in range(1, steps)], 100 * steps).alias("_cuts"))
    held = (df.join(F.broadcast(cuts), list(keys)) if keys else df.crossJoin(F.broadcast(cuts))).withColumn(
        "_slab", _slab_of(F.col("_cuts"), steps, F.col(by))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*keys, "_slab").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums]).select(
        *keys, "_slab", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    joined = held.join(F.broadcast(totals) if steps <= MOST_BROADCAST else totals, [*keys, "_slab"])  # a row for each slab and key
    return joined.select(*df.columns, *[(F.sum(c).over(order) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in sums])
