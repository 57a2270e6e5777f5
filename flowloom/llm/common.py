"""Shared folder, Arrow text kernels and small helpers of the text operators."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Text bytes that one numpy pass holds at most (a single longer text makes a pass of its own).
PASS_BYTES = 512 << 10
#: Rows that are copied out of an Arrow batch at once.
PASS_ROWS = 1024


#: Rows of an Arrow batch at most. Documents are long, and a batch is held several times over, by the JVM and by its worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. From here on the session's Arrow batches hold at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def large_rows(spark: SparkSession, rows: int = 8):
    """While tables whose rows hold gathered groups are written: so few rows an Arrow batch, and so few groups at a time in a task."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    was = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(rows))
    try:
        yield
    finally:
        for k, v in zip(keys, was):
            spark.conf.set(k, v)


#: Ids (8 bytes each) up to which a kept table of them is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without rows of these doc_ids, a kept table of one column; rows of null doc_id stay."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of an equi-join that is sorted and merged whatever Spark takes its size for. It counts an exploded array as one
    row and a kept table as its compressed bytes, so its own choice sends tables of many times the threshold through the driver."""
    return df.hint("merge")


# ---------------------------------------------------------------- Arrow texts


def texts_of(column: pa.Array) -> list[bytes]:
    """The column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Gives memory that finished batches leave in the worker's allocators back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def passes(column: pa.Array):
    """Yields (first row, row count, bytes, offsets) over a string column, PASS_BYTES and PASS_ROWS at a time; null is empty."""
    for first in range(0, len(column), PASS_ROWS):
        part = column.slice(first, PASS_ROWS).fill_null("").cast(pa.large_string())
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            end = int(np.searchsorted(offsets, offsets[at] + PASS_BYTES, "right")) - 1
            end = min(max(end, at + 1), len(part))
            yield first + at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
    release()


def byte_tables(delimiters: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word's byte, byte with A-Z lower-cased) for words made of all bytes but the named set of delimiters."""
    word = np.ones(256, bool)
    if delimiters == "space":
        word[[0x20, *range(0x09, 0x0E)]] = False
    else:  # ASCII that is neither a digit nor a letter
        word[:0x80] = False
        word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return word, lower


SPACE_WORDS = byte_tables("space")
LETTER_WORDS = byte_tables("ascii")


def words_in(data: np.ndarray, offsets: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word in concatenated texts; a text's end also ends a word."""
    inside = tables[0][data]
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cut = offsets[1:-1]
    before[cut[cut < len(inside)]] = False
    after[cut[cut > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for PASS_BYTES places and one more."""
    if not _POWERS:
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(PASS_BYTES, b, np.uint64)]).cumprod() for b in (_BASE, _INVERSE)]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal in, equal out, and all bits of the input reach all bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _polynomial(values: np.ndarray) -> int:
    """Sum of values[i] * base ** i, any number of them."""
    total, power = 0, _powers()[0]
    for at in range(0, len(values), PASS_BYTES):
        part = values[at : at + PASS_BYTES].astype(np.uint64) + np.uint64(1)
        total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased: a polynomial over its bytes by prefix sums, then mixed.

    Words are taken PASS_BYTES bytes at a time, so a very long text costs a table of that size only.
    """
    power, inverse = _powers()
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(int(np.searchsorted(ends, low + PASS_BYTES, "right")), at + 1)
        s, e = starts[at:stop] - low, ends[at:stop] - low
        part = tables[1][data[low : low + int(e[-1])]]
        if len(part) > PASS_BYTES:  # one very long word
            out[at] = np.uint64(_polynomial(part))
        else:
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
            out[at:stop] = (total[e] - total[s]) * inverse[s]
        at = stop
    return mix(out + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, k: int, step: int = 1 << 16) -> np.ndarray:
    """Hash of each run of k words (len(words) - k + 1 of them), by prefix sums over `step` words at a time."""
    n = max(len(words) - k + 1, 0)
    power, inverse = _powers()
    out = np.empty(n, np.uint64)
    for at in range(0, n, step):
        part = mix(words[at : at + step + k - 1].astype(np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)])])
        m = len(part) - k + 1
        out[at : at + m] = mix((total[k : k + m] - total[:m]) * inverse[:m])
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (len(words) - k + 1 of them)."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + words[i : i + n]) * _BASE
    return mix(out)


def word_hash(word: bytes, tables=SPACE_WORDS) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]), tables)[0]


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def batches(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# ---------------------------------------------------------------- graph


def components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node.

    Each round hooks every node that has a smaller neighbour to the smallest one, follows these pointers to their roots, and
    goes on with the edges between different roots only. An edge is joined once a round, and one inside a tree never again; a
    root that outlives two rounds has taken in a neighbour, so rounds grow with the logarithm of a component's size.
    Hub nodes: the minimum is aggregated before its shuffle, the joins are plain equi-joins whose skewed side AQE splits.
    """
    left = work.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    labels, k = None, 0
    while True:
        roots, jump = work.keep(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), f"{name}-{k}-0"), 0
        far = roots.selectExpr("node AS label", "label AS far")
        while roots.join(far, "label", "left_semi").limit(1).count():
            jump += 1
            roots = work.keep(roots.join(far, "label", "left").selectExpr("node", "coalesce(far, label) AS label"), f"{name}-{k}-{jump}")
            far = roots.selectExpr("node AS label", "label AS far")
        if labels is None:
            labels = roots
        else:
            labels = work.keep(labels.join(far, "label", "left").selectExpr("node", "coalesce(far, label) AS label").union(roots), f"{name}-labels-{k}")
        up = roots.selectExpr("node AS b", "label AS y")
        ends = left.join(roots.selectExpr("node AS a", "label AS x"), "a").select("b", "x").distinct()
        ends = ends.join(up, "b", "left").selectExpr("x", "coalesce(y, b) AS y").where("x <> y")
        k += 1
        left = work.keep(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), f"{name}-edges-{k}")
        if not left.limit(1).count():
            return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
