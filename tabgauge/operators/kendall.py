"""Kendall's tau-b of weighted pairs, by slabs.

Pairs of values are counted first. Both axes are cut at approximate quantiles into slabs. Two pairs in different slabs on both axes are compared by their
slabs alone, through the matrix of slab counts (its size is a parameter). Two in one x slab, or in one y slab but different x slabs, are compared
within that slab, each in a task of its own. A slab of a single value needs no comparison there, so frequent values don't make slabs large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pairs that a slab should have, and the most slabs of an axis.
SLAB_PAIRS, MOST_SLABS = 100_000, 1_000


def weighted_sign_sum(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over unordered pairs of w*w*sign(dx)*sign(dy), one bit of y's rank at a time.

    Among rows whose ranks agree above a bit, the one with the bit set is larger; what stands before it with a smaller x adds, the rest takes away.
    """
    if len(x) < 2:
        return 0.0
    _, rank = np.unique(y, return_inverse=True)
    _, place = np.unique(x, return_inverse=True)
    total = 0.0
    for bit in range(int(rank.max()).bit_length()):
        above, one = rank >> (bit + 1), (rank >> bit) & 1
        order = np.lexsort((place, above))
        g, p, o, v = above[order], place[order], one[order], w[order].astype(np.float64)
        new_group = np.concatenate([[True], g[1:] != g[:-1]])
        new_tie = new_group | np.concatenate([[True], p[1:] != p[:-1]])
        at = np.arange(len(g))
        tie, group = np.maximum.accumulate(np.where(new_tie, at, 0)), np.maximum.accumulate(np.where(new_group, at, 0))
        for mine, sign in ((1, 1.0), (0, -1.0)):
            before = np.concatenate([[0.0], np.cumsum(np.where(o != mine, v, 0.0))])
            total += sign * float(np.sum(np.where(o == mine, v * (before[tie] - before[group]), 0.0)))
    return total


def tau_of_counts(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """tau-b of distinct pairs (x, y) that occur w times; NaN if one column is constant."""
    def tied(v: np.ndarray) -> float:
        _, at = np.unique(v, return_inverse=True)
        n = np.bincount(at, weights=w)
        return float((n * (n - 1) / 2).sum())

    n = float(w.sum())
    every, tx, ty = n * (n - 1) / 2, tied(x), tied(y)
    if every == tx or every == ty:
        return float("nan")
    return weighted_sign_sum(x, y, w) / ((every - tx) * (every - ty)) ** 0.5


def _grid_sum(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """The sign sum over slabs: pairs of rows in different slabs on both axes. The grid has at most (2 * MOST_SLABS)**2 cells."""
    if not len(w):
        return 0.0
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    m = np.zeros((i.max() + 1, j.max() + 1))
    m[i, j] = w
    before = np.zeros_like(m)
    before[1:, 1:] = m.cumsum(0).cumsum(1)[:-1, :-1]
    flipped = m[:, ::-1]
    after = np.zeros_like(m)
    after[1:, 1:] = flipped.cumsum(0).cumsum(1)[:-1, :-1]
    return float((m * before).sum() - (flipped * after).sum())


def tau_b(pairs: DataFrame, slab_pairs: int = SLAB_PAIRS, most_slabs: int = MOST_SLABS) -> float:
    """tau-b of the columns x and y (numbers); rows with a NULL don't count; NaN if one column is constant. The pairs are counted once; up to ``slab_pairs`` distinct ones are settled at once."""
    counted = pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    try:
        n, distinct = counted.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.count(F.lit(1))).first()
        if distinct <= slab_pairs:
            held = counted.toArrow()
            return tau_of_counts(*(held.column(c).to_numpy() for c in ("x", "y", "w")))
        return _tau_by_slabs(counted, n, distinct, slab_pairs, most_slabs)
    finally:
        counted.unpersist()


def _tau_by_slabs(counted: DataFrame, n: float, distinct: int, slab_pairs: int, most_slabs: int) -> float:
    tied = lambda c: counted.groupBy(c).agg(F.sum("w").alias("w")).agg(F.coalesce(F.sum(F.col("w") * (F.col("w") - 1) / 2), F.lit(0.0))).first()[0]
    all_pairs, tx, ty = n * (n - 1) / 2, tied("x"), tied("y")
    if all_pairs == tx or all_pairs == ty:
        return float("nan")
    slabs = int(min(most_slabs, -(-distinct // slab_pairs)))
    cuts = counted.agg(*[F.percentile_approx(c, [i / slabs for i in range(1, slabs)], 100 * slabs) for c in ("x", "y")]).first()
    # a cut c makes two borders, before and after c, so that a frequent value is a slab of its own
    slab = lambda c, at: F.size(F.filter(F.lit(at), lambda b: b < F.col(c))) + F.size(F.filter(F.lit(at), lambda b: b <= F.col(c)))
    held = counted.withColumn("sx", slab("x", sorted(set(cuts[0])))).withColumn("sy", slab("y", sorted(set(cuts[1]))))
    cells = held.groupBy("sx", "sy").agg(F.sum("w").alias("w")).toArrow()

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [weighted_sign_sum(frame["a"].to_numpy(), frame["b"].to_numpy(), frame["w"].to_numpy())]})

    total = _grid_sum(*(cells.column(c).to_numpy() for c in ("sx", "sy", "w")))
    many = lambda by, c: held.join(F.broadcast(held.groupBy(by).agg(F.min(c).alias("_l"), F.max(c).alias("_h")).where("_l < _h").select(by)), by)
    # slabs are at most 2 * most_slabs, so what is broadcast is bounded
    total += many("sx", "x").groupBy("sx").applyInPandas(lambda f: within(f.rename(columns={"x": "a", "y": "b"})), "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
    total += many("sy", "y").groupBy("sy").applyInPandas(lambda f: within(f.rename(columns={"sx": "a", "y": "b"})), "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
    return total / ((all_pairs - tx) * (all_pairs - ty)) ** 0.5


def tau_of_pairs(long: DataFrame, slab_pairs: int = SLAB_PAIRS) -> dict[int, float]:
    """tau-b for each k of a table (k, x, y), all from one count of the pairs; those with more than ``slab_pairs`` distinct ones go by slabs."""
    counted = long.where("x IS NOT NULL AND y IS NOT NULL").groupBy("k", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).persist()
    try:
        sizes = {r["k"]: (r["w"], r["n"]) for r in counted.groupBy("k").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each pair of columns
        large = sorted(k for k, (_, n) in sizes.items() if n > slab_pairs)
        of = lambda f: pd.DataFrame({"k": [f["k"].iloc[0]], "tau": [tau_of_counts(f["x"].to_numpy(), f["y"].to_numpy(), f["w"].to_numpy())]})
        found = {r["k"]: r["tau"] for r in counted.where(~F.col("k").isin(large)).groupBy("k").applyInPandas(of, "k int, tau double").collect()} if len(large) < len(sizes) else {}
        for k in large:
            found[k] = _tau_by_slabs(counted.where(F.col("k") == k).drop("k"), *sizes[k], slab_pairs, MOST_SLABS)
        return found
    finally:
        counted.unpersist()
