"""Isolation forest: fitted on a bounded sample on the driver, scored on the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import quantiles, spread

#: Trees, rows of a tree, rows that trees draw theirs from.
TREES, ROWS, SAMPLE = 100, 256, 200_000


def depth_of(n: float) -> float:
    """The mean depth of a point in a random tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """A tree as a list of (column, cut, left, right), or (-1, depth, 0, 0) at an end; made without recursion."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, None, 0)]
    while todo:
        rows, level, parent, side = todo.pop()
        at = len(nodes)
        if parent is not None:
            p = list(nodes[parent])
            p[2 + side] = at
            nodes[parent] = tuple(p)
        lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        wide = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) <= 1 or not len(wide):
            nodes.append((-1, level + depth_of(len(rows)), 0, 0))
            continue
        c = int(rng.choice(wide))
        cut = float(rng.uniform(lo[c], hi[c]))
        nodes.append((c, cut, 0, 0))
        left = x[rows, c] < cut
        todo += [(rows[left], level + 1, at, 0), (rows[~left], level + 1, at, 1)]
    return nodes


def scores(x: np.ndarray, trees: Sequence[list[tuple]], rows: int) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in trees:
        col, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        left, right = np.array([t[2] for t in tree]), np.array([t[3] for t in tree])
        at = np.zeros(len(x), np.int64)
        while True:
            inner = col[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            go = x[i, col[at[i]]] < cut[at[i]]
            at[i] = np.where(go, left[at[i]], right[at[i]])
        total += cut[at]
    return 2 ** (-total / len(trees) / depth_of(rows))


def scored(df: DataFrame, names: Sequence[str], seed: int = 0) -> DataFrame:
    """Complete rows of df (names only) with a score; scaled by the medians and quartiles of all of them. Trees draw from SAMPLE rows, by hash of their places."""
    full = df.select(*[F.col(n).cast("double").alias(n) for n in names]).na.drop()
    n_rows = full.count()
    if n_rows < 50:
        return full.withColumn("score", F.lit(0.0))
    quartiles = quantiles(full, names, (0.25, 0.5, 0.75), lambda d, n: F.col(f"`{n}`"))
    low, mid, high = np.array([quartiles[n] for n in names], float).T
    spreads = high - low
    spreads[spreads == 0] = 1.0
    sample = spread(full, SAMPLE, n_rows, seed).toPandas().to_numpy(float)
    rng, x = np.random.default_rng(seed), (sample - mid) / spreads
    rows = min(ROWS, len(x))
    trees = [grow(x[rng.choice(len(x), rows, replace=False)], rng, math.ceil(math.log2(rows))) for _ in range(TREES)]
    shared = df.sparkSession.sparkContext.broadcast((trees, mid, spreads, rows))
    cols = list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, mid, spreads, rows = shared.value
        for pdf in batches:
            yield pdf.assign(score=scores((pdf[cols].to_numpy(float) - mid) / spreads, trees, rows))

    return full.mapInPandas(run, ", ".join(f"`{n}` double" for n in names) + ", score double")


def flagged(df: DataFrame, names: Sequence[str], seed: int = 0, contamination="auto") -> tuple[float, int]:
    """Share and number of rows above the limit: 0.5, or the score that the given share of rows passes."""
    s = scored(df, names, seed)
    limit = 0.5 if contamination == "auto" else s.agg(F.percentile_approx("score", 1 - float(contamination), 100_000)).head()[0] or 1.0
    r = s.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score") > limit, 1)).alias("k")).head()
    return (r.k / r.n if r.n else 0.0), r.k
