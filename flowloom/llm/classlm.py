"""Class-based bigram language model with exchange clustering (operator 4).

The exchange algorithm moves words between classes while the training text's class-bigram likelihood grows. The `CORE` most frequent
words are exchanged one by one over their dense bigram counts. All other words of the head, the up to `HEAD` most frequent that occur
twice at least, are then exchanged in Spark: their neighbours' classes are counted (two times CLASSES numbers a word), and each
word takes the class that raises the likelihood most, to first order, first among the core's classes and once more among all.
Words below the head, and unknown ones, are one class, as the document's end is; it also stands before the first word.

A token's probability is P(class | class before) P(word | class), the first interpolated with P(class), the second from counts of all
training words, those below the head included, with a part of a count added for each word and for the unknown one.

Counts cover every training document. Words are known by 64-bit hashes. The head's counts and classes are sent to the tasks; the other
words of all documents meet their counts in a join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Workspace, batches, int64, passes, table, word_hashes, words_in

CORE, CLASSES, SWEEPS, REFINED = 2047, 64, 8, 2
#: Classes of one symbol each: words below the head, and the end.
FIXED, RARE, END_CLASS = 2, CLASSES - 2, CLASSES - 1
#: Words in the head at most: 17 bytes each are sent to the tasks.
HEAD = 1 << 20
#: Counts that a task holds before it passes them on.
HELD = 1 << 21
FOLDS, HELD_OUT = 7, 2
PRIOR_TRANSITION, PRIOR_WORD = 20.0, 0.5
END = np.uint64(0x456E64)


def is_held_out(doc_id) -> bool:
    """Null doc_ids are training documents."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each token, words and an end, in order."""
    s, e, rows = words_in(data, offsets, SPACE_WORDS)
    n = len(offsets) - 1
    at = np.searchsorted(rows, np.arange(n), "right")
    return np.insert(word_hashes(data, s, e, SPACE_WORDS), at, END), np.insert(rows, at, np.arange(n))


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def counted(docs: DataFrame, keys_of, name: str = "key") -> DataFrame:
    """(name, n): how often docs (text) have each of the keys that keys_of gives for the tokens of a pass; summed a task at a time."""

    def work(it):
        held, size = [], 0
        for batch in it:
            for _, _, data, offsets in passes(batch.column(0)):
                held.append(np.unique(keys_of(*tokens(data, offsets)), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out(held.pop())
                        size = 0
        if held:
            yield from out(_summed(held))

    def out(x):
        for at in range(0, len(x[0]), 1 << 16):
            yield batches({name: int64(x[0][at : at + (1 << 16)]), "n": pa.array(x[1][at : at + (1 << 16)], pa.int64())})

    return docs.select("text").mapInArrow(work, f"{name} long, n long")


def _places(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def square(docs: DataFrame, side: int, symbols) -> np.ndarray:
    """Counts of pairs of symbols (below side) one after the other, the last symbol before each text; at most side * side rows
    come to the driver, whatever the input."""

    def pairs(h, rows):
        s = symbols(h)
        return np.concatenate([[side - 1], s[:-1]]) * side + s

    got = counted(docs, pairs).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side, np.int64)
    if got.num_rows:
        out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(side, side)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(m: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol (the last FIXED symbols have the last classes to themselves), by the exchange algorithm.

    A symbol moves to the class that raises sum N(c,d) ln N(c,d) - sum N(c) ln N(c) over left and right contexts most.
    """
    m = m.astype(float)
    v, free = len(m), classes - FIXED
    order = np.argsort(-m[:-FIXED].sum(axis=1), kind="stable")
    of = np.arange(v) - v + classes
    of[order] = np.arange(v - FIXED) % free
    one = np.zeros((v, classes))
    one[np.arange(v), of] = 1
    n = one.T @ m @ one
    left, right = n.sum(axis=1), n.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not m[w].any() and not m[:, w].any():
                continue
            self_n = m[w, w]
            to = np.bincount(of, weights=m[w], minlength=classes)
            fro = np.bincount(of, weights=m[:, w], minlength=classes)
            old = of[w]
            to[old] -= self_n
            fro[old] -= self_n
            out_n, in_n = m[w].sum(), m[:, w].sum()
            n[old] -= to
            n[:, old] -= fro
            n[old, old] -= self_n
            left[old] -= out_n
            right[old] -= in_n
            fn = _f(n)
            rows = (_f(n + to[None, :]) - fn).sum(axis=1)
            cols = (_f(n + fro[:, None]) - fn).sum(axis=0)
            d = np.diag(n)
            corner = _f(d + to + fro + self_n) - _f(d + to) - _f(d + fro) + _f(d)
            gain = rows + cols + corner - (_f(left + out_n) - _f(left)) - (_f(right + in_n) - _f(right))
            gain[free:] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[old] + 1e-9:
                best = int(old)
            moved += best != old
            of[w] = best
            n[best] += to
            n[:, best] += fro
            n[best, best] += self_n
            left[best] += out_n
            right[best] += in_n
        if not moved:
            break
    return of


def refined(docs: DataFrame, keys: np.ndarray, of: np.ndarray, core: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of the head (words keys, classes of) after each word that isn't of the core took the best one.

    n: counts of class pairs. To first order a word with counts to[d] and fro[d] of the classes after and before it raises the
    likelihood by sum to[d] ln(n[c, d] / left[c]) + sum fro[d] ln(n[d, c] / right[c]) in class c.
    """
    sent = docs.sparkSession.sparkContext.broadcast((keys, of, core))

    def contexts(h, rows):
        keys, of, core = sent.value
        at = _places(h, keys)
        c = np.where(at >= 0, of[at] if len(of) else 0, RARE)
        c[h == END] = END_CLASS
        use = np.flatnonzero((at >= 0) & ~(core[at] if len(core) else False))
        before = np.concatenate([[END_CLASS], c[:-1]])
        # The end is a token, so a word always has a next one.
        return np.concatenate([at[use] * (2 * CLASSES) + c[use + 1], at[use] * (2 * CLASSES) + CLASSES + before[use]])

    x = n + 0.5
    gains = np.concatenate([np.log(x) - np.log(x.sum(axis=1, keepdims=True)), (np.log(x) - np.log(x.sum(axis=0, keepdims=True))).T], axis=1)[:RARE].T

    def best(it):
        for batch in it:
            place = batch.column(0).to_numpy()
            counts = np.zeros((len(place), 2 * CLASSES))
            lists = batch.column(1)
            row = np.repeat(np.arange(len(place)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            np.add.at(counts, (row, flat.field("ctx").to_numpy()), flat.field("n").to_numpy())
            yield batches({"place": pa.array(place), "class": pa.array((counts @ gains).argmax(axis=1), pa.int32())})

    dealt = counted(docs, contexts).repartition(F.floor(F.col("key") / (2 * CLASSES)).alias("place"))
    summed = dealt.groupBy(F.floor(F.col("key") / (2 * CLASSES)).alias("place"), (F.col("key") % (2 * CLASSES)).cast("int").alias("ctx")).agg(F.sum("n").alias("n"))
    got = summed.groupBy("place").agg(F.collect_list(F.struct("ctx", "n")).alias("counts")).mapInArrow(best, "place long, class int").toArrow()  # HEAD rows at most
    out = of.copy()
    if got.num_rows:
        out[got.column("place").to_numpy()] = got.column("class").to_numpy()
    return out


class Model:
    """Tables that the tasks need; sizes depend on the constants above only."""

    def __init__(self, keys, counts, of, n, rare, total, distinct, ends):
        """keys, counts, of: the head's words (sorted), counts and classes. n: class pairs. rare: (tokens, words) below the head."""
        self.keys, self.counts, self.of, self.total, self.distinct, self.ends = keys, counts, of, int(total), int(distinct), int(ends)
        share = (n.sum(axis=0) + 1e-3) / (n.sum() + 1e-3 * CLASSES)
        self.step = np.log10((n + PRIOR_TRANSITION * share) / (n.sum(axis=1, keepdims=True) + PRIOR_TRANSITION))
        mass = np.bincount(of, weights=counts + PRIOR_WORD, minlength=CLASSES)
        mass[RARE], mass[END_CLASS] = rare[0] + PRIOR_WORD * (rare[1] + 1), 1
        with np.errstate(divide="ignore"):  # a class may be empty
            self.mass = np.log10(mass)

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head or -1, class) of each token."""
        at = _places(h, self.keys)
        c = np.where(at >= 0, self.of[at] if len(self.of) else 0, RARE)
        c[h == END] = END_CLASS
        return at, c


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<h: long, tf: int>>"


def _bucket() -> Column:
    """Eighths of powers of two of a count."""
    return F.floor(F.log2("n") * 8)


def train(docs: DataFrame, work: Workspace) -> tuple[Model, DataFrame]:
    """The model of docs (text), and the kept counts (h, n) of the words below the head."""
    counts = work.keep(counted(docs, lambda h, rows: h, "h").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("h") != int(END))
    ends = total[0] - (words.agg(F.sum("n")).first()[0] or 0)
    # The head's bound comes from a histogram of counts, of a few hundred rows.
    least, room = 1 << 20, HEAD
    for r in sorted(words.where("n > 1").groupBy(_bucket().alias("b")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r["b"]):
        if r["v"] > room:
            break
        least, room = r["b"], room - r["v"]
    of_head = (F.col("n") > 1) & (_bucket() >= least)
    top = words.where(of_head).select("h", "n").toArrow()  # HEAD rows of 16 bytes
    h, n = (top.column(c).to_numpy() for c in ("h", "n"))
    h = h.view(np.uint64) if len(h) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    keys, n = h[order], n[order]
    core_at = np.sort(np.lexsort((keys, -n))[:CORE])
    core_keys, side = keys[core_at], len(core_at) + FIXED

    def symbols(h):
        s = _places(h, core_keys)
        return np.where(h == END, side - 1, np.where(s < 0, side - 2, s))

    m = square(docs, side, symbols)
    of_core = exchange(m)
    one = np.eye(CLASSES)[of_core]
    pairs = one.T @ m @ one
    core, of = np.zeros(len(keys), bool), np.full(len(keys), RARE)
    core[core_at], of[core_at] = True, of_core[:-FIXED]
    for k in range(REFINED if len(keys) > len(core_at) else 0):
        of = refined(docs, keys, of, core, pairs)
        pairs = class_pairs(docs, keys, of)
    rare = words.where(~of_head).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Model(keys, n, of, pairs, rare, *total, ends), words.where(~of_head).select("h", "n")


def class_pairs(docs: DataFrame, keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    sent = docs.sparkSession.sparkContext.broadcast((keys, of))

    def classes(h):
        keys, of = sent.value
        at = _places(h, keys)
        return np.where(h == END, END_CLASS, np.where(at >= 0, of[at] if len(of) else 0, RARE))

    return square(docs, CLASSES, classes).astype(float)


def score(docs: DataFrame, model: Model, below: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def first(it):
        from pyspark import TaskContext

        m, row = sent.value, TaskContext.get().partitionId() << 40
        log_base, log_word, log_end = np.log10(m.counts + 1.0), np.log10(m.counts + PRIOR_WORD), np.log10(m.ends + 1.0)
        for batch in it:
            for at, n, data, offsets in passes(batch.column(1)):
                h, rows = tokens(data, offsets)
                place, c = m.classes(h)
                end, head = c == END_CLASS, place >= 0
                before = np.concatenate([[END_CLASS], c[:-1]])
                look = lambda t: t[place] if len(t) else np.zeros(len(h))  # noqa: B023, E731
                value = m.step[before, c] - m.mass[c] + np.where(head, look(log_word), 0.0)
                base = np.where(head, look(log_base), np.where(end, log_end, 0.0)) - np.log10(m.total + m.distinct + 1.0)
                add = lambda x: np.bincount(rows, weights=x, minlength=n)  # noqa: B023, E731
                # Words below the head: a row's distinct ones, with how often it has them.
                t = np.flatnonzero(~head & ~end)
                by = t[np.lexsort((h[t], rows[t]))]
                new = np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (rows[by][1:] != rows[by][:-1])]) if len(by) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                tail = pa.StructArray.from_arrays([int64(h[by[begin]]), pa.array(np.diff(np.append(begin, len(by))), pa.int32())], ["h", "tf"])
                cut = np.searchsorted(rows[by[begin]], np.arange(n + 1)).astype(np.int32)
                ids = batch.column(0).slice(at, n)
                yield batches({
                    "row": pa.array(row + np.arange(n), pa.int64()), "doc_id": ids, "held_out": pa.array([is_held_out(x) for x in ids.to_pylist()]),
                    "n_tokens": pa.array(add(None).astype(np.int64)), "n_known": pa.array(add((head | end & (m.ends > 0)).astype(float)).astype(np.int64)),
                    "base": pa.array(add(base)), "score": pa.array(add(value)), "tail": pa.ListArray.from_arrays(pa.array(cut), tail),
                })
                row += n

    seen = work.keep(docs.select("doc_id", "text").mapInArrow(first, SCORED), "first")
    rest = seen.select("row", F.inline("tail")).join(below, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    log = lambda prior: F.sum(F.col("tf") * F.log10(F.col("n") + prior))
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("k"), log(1.0).alias("b"), log(PRIOR_WORD).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = seen.drop("tail").join(rest, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))


def class_model(docs: DataFrame) -> DataFrame:
    """Trains on the rows whose doc_id isn't held out and scores all rows.

    Null and empty texts have the end alone. Null doc_ids train. Repeated rows count as often as they stand. Without training
    rows counts are zero and scores come from the priors. An empty table gives no rows. Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "classlm")
    docs = docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0))
    return score(docs, *train(docs.where(fold != HELD_OUT), work), work)


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model(table(spark, sf_dir, "documents"))
