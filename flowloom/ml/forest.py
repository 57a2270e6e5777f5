"""Isolation forest for flows: fitted on a bounded sample, scored as Arrow batches.

As published: trees on SAMPLE rows each, split at random between a random feature's bounds, to the depth log2(SAMPLE); the score of a row
is 2 to the minus mean path length over the expected one. The threshold is the contamination quantile over all training rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean_number
from ..operators.quantiles import quantiles
from ..workspace import Workspace

TREES, SAMPLE, SEED, CONTAMINATION = 100, 256, 42, 0.05
#: Rows from which the trees draw; those of the smallest hash, whatever the input's size.
POOL = TREES * SAMPLE


def _expected(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Nodes (feature, split, left, right, size): a leaf has feature -1."""
    nodes: list = []

    def add(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        nodes.append(None)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        can = np.flatnonzero(high > low)
        if left == 0 or len(rows) < 2 or not len(can):
            nodes[me] = (-1, 0.0, 0, 0, len(rows))
            return me
        f = int(rng.choice(can))
        cut = rng.uniform(low[f], high[f])
        side = x[rows, f] < cut
        a, b = add(rows[side], left - 1), add(rows[~side], left - 1)
        nodes[me] = (f, cut, a, b, len(rows))
        return me

    add(np.arange(len(x)), depth)
    return nodes


class IsolationForest:
    def __init__(self, features: list[str], trees: list, sample: int):
        self.features, self.trees, self.sample, self.threshold = features, [tuple(np.array(c) for c in zip(*t)) for t in trees], sample, None

    @classmethod
    def grown(cls, rows: DataFrame, features: list[str], trees: int = TREES, seed: int = SEED) -> IsolationForest:
        """A forest without a threshold."""
        cols = [clean_number(f).alias(f) for f in features]
        pool = rows.select(*cols).orderBy(F.xxhash64(F.lit(seed), *features)).limit(POOL).toPandas().to_numpy(float)
        rng = np.random.default_rng(seed)
        n = min(SAMPLE, len(pool))
        depth = int(np.ceil(np.log2(max(n, 2))))
        return cls(features, [grow(pool[rng.choice(len(pool), n, replace=False)], rng, depth) for _ in range(trees if n else 0)], n)

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], contamination: float = CONTAMINATION, trees: int = TREES, seed: int = SEED) -> IsolationForest:
        model = cls.grown(rows, features, trees, seed)
        model.threshold = model.thresholds(rows, (contamination,))[contamination]
        return model

    def thresholds(self, rows: DataFrame, contaminations: tuple[float, ...]) -> dict[float, float]:
        """The score that this share of the rows exceeds, for each contamination; 1 where there are no rows. Rows are scored once."""
        scored = Workspace(rows.sparkSession, "forest").keep(rows.select(self.score().alias("score")), "scores")
        got = {r.share: r.value for r in quantiles(scored, [], ["score"], [1 - c for c in contaminations]).collect()}
        return {c: got.get(1 - c, 1.0) for c in contaminations}

    def _scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, size in self.trees:
            at, path, live = np.zeros(len(x), int), np.zeros(len(x)), np.arange(len(x))
            while len(live):
                node = at[live]
                leaf = feature[node] < 0
                done = live[leaf]
                path[done] += _expected(size[at[done]])
                live, node = live[~leaf], node[~leaf]
                path[live] += 1
                at[live] = np.where(x[live, feature[node]] < cut[node], left[node], right[node])
            total += path
        return 2.0 ** (-total / max(len(self.trees), 1) / max(float(_expected(np.array([self.sample]))[0]), 1e-9))

    def score(self) -> Column:
        """Anomaly score of a row, higher is odder."""

        @F.pandas_udf("double")
        def scored(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(self._scores(frame.to_numpy(float)))

        return scored(F.struct(*[clean_number(f).alias(f) for f in self.features]))

    def flags(self) -> Column:
        return self.score() > F.lit(float(self.threshold))


def scores_of(forests: list[IsolationForest], features: list[str]) -> Column:
    """Scores of a row by each forest."""

    @F.pandas_udf("array<double>")
    def scored(frame: pd.DataFrame) -> pd.Series:
        x = frame.to_numpy(float)
        return pd.Series(list(np.stack([f._scores(x) for f in forests], axis=1)))

    return scored(F.struct(*[clean_number(f).alias(f) for f in features]))
