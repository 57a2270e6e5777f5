"""Toxicity severity by cumulative-link ordinal regression on sparse words (operator 2).

P(grade <= k) = sigmoid(theta_k - w.x): one weight a word, of either sign, shared by the ordered thresholds theta. x says which
words of the vocabulary a text holds; an L1 penalty leaves weights to words that carry evidence. The labels say toxic or not. Grades
are 0 (not toxic), 1 (toxic) and 2 (toxic, and more so than half of such texts by a model that was fitted without the text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER_WORDS, Workspace, batches, drop_ids, mix, passes, table, word_hashes, words_in

GRADES = 3
#: Labelled rows the model is fitted on at most (those of least hash). Words of fewer of these rows have no weight.
TRAIN_ROWS, LEAST_ROWS = 20_000, 4
#: Strength of a word's penalty, in standard deviations of its gradient where words say nothing; what remains of it when the chosen
#: words are fitted again; and rounds of a descent (ten times as many for that).
L1, RELAXED, ROUNDS = 2.2, 0.5, 150
#: A text is rejected if it is at least this probable that its grade is 1 or more.
REJECT = 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _slopes(rows: np.ndarray, words: np.ndarray, grades: np.ndarray, n_words: int, w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss's gradient for the weights and for the thresholds."""
    s = np.bincount(rows, weights=w[words], minlength=len(grades))
    low = np.concatenate([[-np.inf], theta, [np.inf]])
    with np.errstate(invalid="ignore"):
        a, b = _sigmoid(low[grades + 1] - s), _sigmoid(low[grades] - s)
    a[grades == GRADES - 1], b[grades == 0] = 1.0, 0.0
    p = np.maximum(a - b, 1e-9)
    g_theta = np.array([(b * (1 - b) / p)[grades == k + 1].sum() - (a * (1 - a) / p)[grades == k].sum() for k in range(GRADES - 1)])
    return np.bincount(words, weights=(1 - a - b)[rows], minlength=n_words), g_theta


def _descend(rows, words, grades, n_words, w, theta, penalty, rounds):
    """Accelerated proximal gradient; each coordinate's step comes from a bound of its curvature."""
    width = np.bincount(rows, minlength=len(grades)) + 1.0  # words and the threshold
    bound = 0.25 * np.bincount(words, weights=width[rows], minlength=n_words) + 1e-9
    bound_theta = 0.5 * width.sum() + 1e-9
    look, look_theta, t = w, theta, 1.0
    for _ in range(rounds):
        g, g_theta = _slopes(rows, words, grades, n_words, look, look_theta)
        new = look - g / bound
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / bound, 0)
        new_theta = np.maximum.accumulate(look_theta - g_theta / bound_theta)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look, w = new + (was - 1) / t * (new - w), new
        look_theta, theta = np.maximum.accumulate(new_theta + (was - 1) / t * (new_theta - theta)), new_theta
    return w, theta


def fit(rows: np.ndarray, words: np.ndarray, grades: np.ndarray, n_words: int, rounds: int = ROUNDS, l1: float = L1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds): rows and words are parallel arrays of the entries of x, grades one a row.

    The descent goes over the words whose gradient exceeds their penalty, and is repeated with those that come to exceed it, until
    none does: the weights of all others are zero at the optimum. A word's penalty grows with the root of its rows, as its
    gradient's noise does. The penalty also shrinks the weights of the words it chooses, so these are fitted once more with little of
    it (the relaxed lasso).
    """
    n = len(grades)
    share = np.array([(grades <= k).sum() + 0.5 for k in range(GRADES - 1)]) / (n + 1)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    bad = (grades > 0).mean() if n else 0.0
    penalty = l1 * np.sqrt(np.maximum(np.bincount(words, minlength=n_words) * bad * (1 - bad), 1e-9)) + 0.1
    w, active = np.zeros(n_words), np.zeros(n_words, bool)
    for _ in range(30 if len(rows) else 0):
        over = ~active & (np.abs(_slopes(rows, words, grades, n_words, w, theta)[0]) > 1.01 * penalty)
        if not over.any():
            break
        active |= over
        use = active[words]
        w, theta = _descend(rows[use], words[use], grades, n_words, w, theta, penalty, rounds)
    use = (w != 0)[words]
    return _descend(rows[use], words[use], grades, n_words, w, theta, RELAXED, 10 * rounds) if use.any() else (w, theta)


def severities(rows: np.ndarray, words: np.ndarray, toxic: np.ndarray, half: np.ndarray, n_words: int) -> np.ndarray:
    """Grades of labelled texts: the toxic texts of each half (0 or 1) are scored by a model of the other half, and split at their median."""
    grades = (toxic > 0).astype(int)
    for side in (0, 1):
        use, place = half[rows] != side, np.cumsum(half != side) - 1
        w, _ = fit(place[rows[use]], words[use], (toxic > 0).astype(int)[half != side], n_words)
        s = np.bincount(rows, weights=w[words], minlength=len(toxic))
        mine = (half == side) & (toxic > 0)
        if mine.any():
            grades[mine & (s > np.median(s[mine]))] = 2
    return grades


def probabilities(score: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade > k) for each k."""
    return 1 - _sigmoid(theta[None, :] - score[:, None])


def _distinct(rows: np.ndarray, hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in the sorted keys) of the words that are among the keys."""
    if not len(keys) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    both = np.unique(rows[hit].astype(np.int64) * len(keys) + at[hit])
    return both // len(keys), both % len(keys)


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, theta: np.ndarray):
        keep = weights != 0
        self.keys, self.weights, self.theta = keys[keep], weights[keep], theta

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        s, e, rows = words_in(data, offsets, LETTER_WORDS)
        at, which = _distinct(rows, word_hashes(data, s, e, LETTER_WORDS), self.keys)
        return np.bincount(at, weights=self.weights[which], minlength=len(offsets) - 1).astype(float)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most `rows` labelled documents, those of the smallest hash of doc_id; without any, nothing is toxic.

    Of repeated labels a toxic one counts; null doc_ids and null labels are left out; of documents that share an id one counts, that of
    the smallest hash. Rows are put in the order of doc_id and halved by its hash, so the model doesn't depend on how they were read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    graded = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("grade"))
    chosen = work.keep(graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "chosen")  # at most `rows` rows of 12 bytes

    def hashed(it):
        for batch in it:
            for at, n, data, offsets in passes(batch.column(2)):
                s, e, r = words_in(data, offsets, LETTER_WORDS)
                h, cut = word_hashes(data, s, e, LETTER_WORDS).view(np.int64), np.searchsorted(r, np.arange(n + 1))
                lists = [np.unique(h[cut[i] : cut[i + 1]]) for i in range(n)]
                yield batches({"doc_id": batch.column(0).slice(at, n), "grade": batch.column(1).slice(at, n), "words": pa.array(lists, pa.list_(pa.int64()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "grade", "t.text")
    features = work.keep(texts.mapInArrow(hashed, "doc_id long, grade int, words array<long>"), "features")
    # The rows are bounded, and so are their words that LEAST_ROWS of them hold.
    common = features.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= LEAST_ROWS)
    common = common.select("word").toArrow().column(0).to_numpy()
    keys = np.sort(common.view(np.uint64) if len(common) else np.zeros(0, np.uint64))

    def indexed(it):
        for batch in it:
            words = batch.column(2)
            size = np.diff(words.offsets.to_numpy())
            flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row, which = _distinct(np.repeat(np.arange(len(size)), size), flat, keys)
            cut = np.searchsorted(row, np.arange(len(size) + 1))
            yield batches({"doc_id": batch.column(0), "grade": batch.column(1), "words": pa.array([which[cut[i] : cut[i + 1]].astype(np.int32) for i in range(len(size))], pa.list_(pa.int32()))})

    got = features.mapInArrow(indexed, "doc_id long, grade int, words array<int>").toArrow().sort_by("doc_id").combine_chunks()
    work.drop()
    grades = got.column(1).to_numpy().astype(int)
    half = (mix(got.column(0).to_numpy().astype(np.uint64)) & np.uint64(1)).astype(int)
    lists = got.column(2).combine_chunks() if got.num_rows else None
    size = np.array([len(x) for x in got.column(2)]) if got.num_rows else np.zeros(0, int)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(int) if lists is not None else np.zeros(0, int)
    at = np.repeat(np.arange(len(size)), size)
    weights, theta = fit(at, flat, severities(at, flat, grades, half, len(keys)), len(keys))
    return Model(keys, weights, theta if len(grades) else np.full(GRADES - 1, 40.0))


SCORED = "doc_id long, score double, p_toxic double, severity double, grade int, rejected boolean"


def score(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """doc_id, linear score, P(grade >= 1), expected severity (0 to 2), most probable grade, rejected.

    Null and empty texts have no words. Repeated rows and null doc_ids get a row each; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded training rows, 16 bytes each

    def work(it):
        for batch in it:
            for at, n, data, offsets in passes(batch.column(1)):
                s = sent.value.scores(data, offsets)
                over = probabilities(s, sent.value.theta)
                each = -np.diff(np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1), axis=1)
                yield batches({"doc_id": batch.column(0).slice(at, n), "score": pa.array(s), "p_toxic": pa.array(over[:, 0]), "severity": pa.array(over.sum(axis=1)), "grade": pa.array(each.argmax(axis=1), pa.int32()), "rejected": pa.array(over[:, 0] >= reject)})

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text").mapInArrow(work, SCORED)


def keep_clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """docs without the rejected ones; rows of null doc_id stay, rows that share a doc_id go together."""
    bad = score(docs, train(docs, labels), reject).where("rejected").select("doc_id").distinct()
    return drop_ids(docs, Workspace(docs.sparkSession, "toxicity-bad").keep(bad, "bad"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
