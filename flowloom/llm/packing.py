"""Packing token sequences into windows by non-negative least squares over length combinations (operator 8).

Every document is cut into full windows and a remainder. Remainders are packed block by block: a block is a run of
documents that a task holds (BLOCK_IDS ids, or one longer document), so memory is bounded, nothing is shuffled and a lost
task is redone alone. Within a block:

1. the histogram of remainder lengths is taken, in `GRAIN`-id classes;
2. shallow combinations (one to three classes) that fill a window are enumerated as the columns of a matrix;
3. non-negative least squares solves how often each combination is used so that the columns add up to the histogram;
4. counts are rounded down (never beyond what the histogram has) and the combinations filled with documents;
5. what is left is packed greedily: the longest piece first, then the longest that still fits, and where none fits, a
   piece is cut to fill the gap exactly. The last, partial window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, passes, release, table
from .tokens import VOCABULARY, encoder

WINDOW = 2048
#: Ids of the documents that one block packs (4 bytes each).
BLOCK_IDS = 4 << 20
#: Length classes of this many ids; a combination's gap is filled by a cut piece.
GRAIN = 32


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that makes |ax - b| small: projected gradient steps with Nesterov's momentum."""
    if not a.size:
        return np.zeros(a.shape[1])
    q, c = a.T @ a, a.T @ b
    step = 1.0 / max(np.abs(q).sum(axis=1).max(), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (q @ y - c))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (last - 1) / t * (new - x)
        if np.abs(new - x).max(initial=0.0) < 1e-6 * (1 + np.abs(new).max(initial=0.0)):
            return new
        x = new
    return x


def combinations(window: int, classes: np.ndarray, grain: int = GRAIN) -> list[tuple[int, ...]]:
    """Of the classes present (length = class * grain at most), one to three that fill a window but for less than one grain a part."""
    have, top, out = set(classes.tolist()), window // grain, []
    for a in sorted(have, reverse=True):
        if a == top:
            out.append((a,))
        b = top - a
        if b in have and 0 < b <= a:
            out.append((a, b))
        for b in sorted(have, reverse=True):
            c = top - a - b
            if b <= a and 0 < c <= b and c in have:
                out.append((a, b, c))
    return out


def plan(lengths: np.ndarray, window: int = WINDOW, grain: int = GRAIN) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold each item's ids once, none longer than the window."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    kinds = -(-lengths // grain)
    free: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        free.setdefault(int(kinds[i]), []).append(i)  # pop() gives the longest
    sequences: list[list[tuple[int, int, int]]] = []
    choice = combinations(window, np.array(sorted(free)), grain)
    if choice:
        rows = {k: r for r, k in enumerate(sorted(free))}
        a = np.zeros((len(rows), len(choice)))
        for j, parts in enumerate(choice):
            for k in parts:
                a[rows[k], j] += 1
        times = nnls(a, np.array([len(free[k]) for k in sorted(free)], float))
        for j in np.argsort(-times, kind="stable").tolist():
            parts = choice[j]
            for _ in range(int(times[j] + 1e-6)):
                if any(len(free[k]) < parts.count(k) for k in parts):
                    break
                sequences.append([(i := free[k].pop(), 0, int(lengths[i])) for k in parts])
    left = [(i, 0, int(lengths[i])) for k in sorted(free) for i in free[k]]  # by length, the longest last
    buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]
    for piece in left:
        buckets[piece[2]].append(piece)
    held, top = len(left), window
    # Windows that combinations left a little open come first, the fullest last.
    sequences.sort(key=lambda s: sum(p[2] for p in s))
    at = 0
    while held:
        if at < len(sequences):
            now, at = sequences[at], at + 1
        else:
            now = []
            sequences.append(now)
            at += 1
        gap = window - sum(p[2] for p in now)
        while gap and held:
            while top and not buckets[top]:
                top -= 1
            fit = min(gap, top)
            while fit and not buckets[fit]:
                fit -= 1
            if fit and (fit == gap or fit * 2 > gap or fit == top):
                piece = buckets[fit].pop()
                held -= 1
            else:  # none fits well: a cut of the longest fills the gap
                i, s, n = buckets[top].pop()
                piece = (i, s, gap)
                buckets[n - gap].append((i, s + gap, n - gap))
            now.append(piece)
            gap -= piece[2]
    # Open windows: none of a power of two's length needs padding, so the others are cut into such lengths, least first
    # taken from the smaller windows' pieces.
    out = []
    for now in sequences:
        total = sum(p[2] for p in now)
        while total and total != window and total & (total - 1):
            size, part = 1 << (total.bit_length() - 1), []
            while size:
                i, s, n = now.pop(0)
                if n > size:
                    now.insert(0, (i, s + size, n - size))
                    n = size
                part.append((i, s, n))
                size -= n
            out.append(part)
            total = sum(p[2] for p in now)
        if total:
            out.append(now)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _block(ids: list[np.ndarray], docs: list, first: int, window: int) -> tuple[pa.RecordBatch, int]:
    lengths = np.array([len(x) for x in ids], np.int64)
    full, rest = lengths // window, lengths % window
    cols: list[list] = [[] for _ in range(7)]

    def put(i: int, start: int, n: int, sequence: int, offset: int) -> None:
        crc = zlib.crc32(ids[i][start : start + n].tobytes())
        for col, v in zip(cols, (docs[i], start, n, crc, int(lengths[i]), sequence, offset)):
            col.append(v)

    for i in range(len(ids)):
        for k in range(int(full[i])):
            put(i, k * window, window, first, 0)
            first += 1
    for pieces in plan(rest, window):
        offset = 0
        for i, start, n in pieces:
            put(i, int(full[i]) * window + start, n, first, offset)
            offset += n
        first += 1
    names = [x.split()[0] for x in PIECES.split(", ")]
    return batches({k: pa.array(v, pa.int64()) for k, v in zip(names, cols)}), first


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 1, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `window` tokens; a row a piece (see PIECES).

    sequence_id is the task's number times 2^32 plus a count within the task. Null text: the end id alone. Null or repeated
    doc_ids: each row is a document of its own and keeps its id. An empty table gives no row. Other columns are not read.
    """

    def work(it):
        from pyspark import TaskContext

        words, number = encoder(vocabulary), TaskContext.get().partitionId() << 32
        end, ids, names, size = np.array([end_id], "<u4").tobytes(), [], [], 0
        for batch in it:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, n, data, offsets in passes(texts):
                for d, x in zip(doc_ids[at : at + n], words.ids(data, offsets)):
                    ids.append(np.frombuffer(x + end, "<u4"))
                    names.append(d)
                    size += len(ids[-1])
                if size >= block_ids:
                    out, number = _block(ids, names, number, window)
                    yield out
                    ids, names, size = [], [], 0
                    release()
        words.rest()
        release()
        if ids:
            yield _block(ids, names, number, window)[0]

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text").mapInArrow(work, PIECES)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Tokens, sequences and padding (none at a full window or a power of two) of a packing."""
    totals = pieces.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n")
    return totals.selectExpr("count(*) AS sequences", "sum(n) AS tokens", f"sum(CASE WHEN (n & (n - 1)) = 0 THEN 0 ELSE {window} - n END) AS padding")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
