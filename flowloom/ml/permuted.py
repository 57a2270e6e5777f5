"""How a random forest's verdicts change when one feature's values are those of another row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel

#: Rows that are scored at once.
STEP = 4096


class Tree:
    """A tree as arrays over its nodes: a row goes left where its feature is at most the cut; a leaf leads to itself and has votes.

    on: the features that a leaf's path asks for.
    """

    def __init__(self, root, features: int, classes: int):
        feature, cut, left, right, votes, on = [], [], [], [], [], []

        def add(node, asked: frozenset) -> tuple[int, int]:
            me = len(feature)
            for column, value in ((feature, 0), (cut, 0.0), (left, me), (right, me), (votes, [0.0] * classes), (on, [i in asked for i in range(features)])):
                column.append(value)
            if node.subtreeDepth() == 0:
                counts = list(node.impurityStats().stats())
                total = sum(counts)
                votes[me] = [c / total for c in counts] if total else counts
                return me, 0
            split = node.split()
            feature[me], cut[me] = split.featureIndex(), split.threshold()
            left[me], a = add(node.leftChild(), asked | {feature[me]})
            right[me], b = add(node.rightChild(), asked | {feature[me]})
            return me, max(a, b) + 1

        self.depth = add(root, frozenset())[1]
        self.feature, self.cut, self.left, self.right, self.votes, self.on = (np.array(c) for c in (feature, cut, left, right, votes, on))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return at


def trees_of(model: PipelineModel, features: int) -> list[Tree]:
    forest = model.stages[-2]
    return [Tree(t._java_obj.rootNode(), features, forest.numClasses) for t in forest.trees]


def verdicts(trees: list[Tree], leaves: list[np.ndarray]) -> np.ndarray:
    """The first class of the highest probability."""
    total = np.zeros((len(leaves[0]), trees[0].votes.shape[1]))
    for tree, at in zip(trees, leaves):
        total += tree.votes[at]
    return np.argmax(total / total.sum(axis=1, keepdims=True), axis=1)


def hits(trees: list[Tree], x: np.ndarray, other: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows whose verdict is their label, for each feature with the values of other rows. Only trees and rows whose path asks for
    the feature are walked again."""
    base, out = [t.leaves(x) for t in trees], np.zeros(x.shape[1], np.int64)
    for f in range(x.shape[1]):
        leaves = []
        for tree, at in zip(trees, base):
            some = np.flatnonzero(tree.on[at, f])
            if len(some):
                changed, at = x[some], at.copy()
                changed[:, f] = other[some, f]
                at[some] = tree.leaves(changed)
            leaves.append(at)
        out[f] = (verdicts(trees, leaves) == label).sum()
    return out


def counted(trees: list[Tree], features: int):
    """A function of Arrow batches (label's class, -1 for one that the model lacks, features, the other row's features): hits a feature, and rows."""

    def run(it):
        total, n = np.zeros(features, np.int64), 0
        for batch in it:
            for at in range(0, batch.num_rows, STEP):
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, STEP).columns]
                x = np.stack(columns[1:], axis=1) if len(columns) > 1 else np.zeros((len(columns[0]), 0))
                total += hits(trees, x[:, :features], x[:, features:], columns[0])
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features), pa.int32()), pa.array(total), pa.array(np.full(features, n))], ["f", "hits", "n"])

    return run
