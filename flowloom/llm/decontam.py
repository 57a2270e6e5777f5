"""Benchmark decontamination by winnowing (operator 6).

Of each run of consecutive k-gram hashes (here 6 of 5-grams) the smallest is kept, in items and documents alike; a span of
10 shared words holds such a run whole, so both keep the same hash there. Around kept hashes that meet, each window that holds the
k-gram is looked up among the items' windows and, where it is one, compared with it as bytes; windows found side by side make up
the extended hit. So a text costs its words and not its meetings: where words repeat, a k-gram meets many places of an item,
but its windows are looked up once. The items' fingerprints are sent to the tasks only while the items are below `BLOCK_BYTES`;
larger benchmarks are searched block by block, each over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER_WORDS, Workspace, batches, drop_ids, grams, passes, table, word_hashes, words_in

#: Bytes of item texts that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20
GRAM = 5
SPANS = "array<struct<start: long, stop: long>>"


def _kept(hashes: np.ndarray, run: int) -> np.ndarray:
    """Which k-grams are the smallest (all that tie) of some run of consecutive ones."""
    keep = np.zeros(len(hashes), bool)
    n = len(hashes) - run + 1
    if n > 0:
        least = hashes[:n].copy()
        for j in range(1, run):
            np.minimum(least, hashes[j : j + n], out=least)
        for j in range(run):
            keep[j : j + n] |= hashes[j : j + n] == least
    return keep


class Windows:
    """The windows of one length of items: hash, a place where the window stands, and the items that hold it."""

    def __init__(self, size: int, grams_kept: set[int], found: dict[int, tuple[tuple[int, int], list[int]]]):
        self.size = size
        self.keys = np.array(sorted(found), np.uint64)
        self.places = [found[k][0] for k in sorted(found)]
        self.items = [found[k][1] for k in sorted(found)]
        self.kept = np.array(sorted(grams_kept), np.uint64)


def _among(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is one of the sorted keys, and where it is or would be."""
    if not len(keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at


class Index:
    """Windows of items by their length: `window` words, or all of an item that has fewer."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.run = window, window - GRAM + 1
        self.names, self.words = [], []
        found: dict[int, dict] = {}
        kept: dict[int, set[int]] = {}
        for name, text in items:
            data = np.frombuffer(text, np.uint8)
            s, e, _ = words_in(data, np.array([0, len(data)]), LETTER_WORDS)
            if not len(s):
                continue
            h, i, size = word_hashes(data, s, e, LETTER_WORDS), len(self.names), min(len(s), window)
            lower = LETTER_WORDS[1][data].tobytes()
            self.names.append(name)
            self.words.append([lower[a:b] for a, b in zip(s.tolist(), e.tolist())])
            table = found.setdefault(size, {})
            for q, w in enumerate(grams(h, size).tolist()):
                place, holders = table.setdefault(w, ((i, q), []))
                if not holders or holders[-1] != i:
                    holders.append(i)
            if size == window:
                g = grams(h, GRAM)
                kept.setdefault(size, set()).update(g[_kept(g, self.run)].tolist())
        self.tables = [Windows(n, kept.get(n, set()), x) for n, x in sorted(found.items())]

    def candidates(self, hashes: np.ndarray, rows: np.ndarray, table: Windows) -> np.ndarray:
        """Places of words where a window of the table may begin: those around kept k-grams that meet, and within one text."""
        n = len(hashes) - table.size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = rows[table.size - 1 :] == rows[:n]
        if table.size < self.window:
            return np.flatnonzero(whole)
        g = grams(hashes, GRAM)
        inside = rows[GRAM - 1 :] == rows[: len(rows) - GRAM + 1]
        meets = _kept(np.where(inside, g, np.uint64(0xFFFFFFFFFFFFFFFF)), self.run) & inside & _among(g, table.kept)[0]
        near = np.zeros(n, bool)
        for j in range(self.run):  # a window's k-grams begin at its words 0 to run - 1
            near |= meets[j : j + n]
        return np.flatnonzero(near & whole)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Words of each text, and for texts with hits their spans and items."""
        starts, ends, rows = words_in(data, offsets, LETTER_WORDS)
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        first = np.concatenate([[0], np.cumsum(counts)])
        hashes, out = word_hashes(data, starts, ends, LETTER_WORDS), {}
        word = lambda p: LETTER_WORDS[1][data[starts[p] : ends[p]]].tobytes()
        for table in self.tables:
            at = self.candidates(hashes, rows, table)
            if not len(at):
                continue
            # The hash of a window's words, as grams() makes it, at the candidates only.
            hit, where = _among(grams(hashes, table.size)[at], table.keys)
            told: dict[int, set[int]] = {}
            for p, k in zip(at[hit].tolist(), where[hit].tolist()):
                i, q = table.places[k]
                if any(word(p + j) != self.words[i][q + j] for j in range(table.size)):
                    continue
                row = int(rows[p])
                spans, items = out.setdefault(row, ([], set()))
                begin = p - int(first[row])
                if spans and spans[-1][0] <= begin <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], begin + table.size)
                else:
                    spans.append((begin, begin + table.size))
                if k not in told.setdefault(row, set()):
                    told[row].add(k)
                    items.update(self.names[x] for x in table.items[k])
        return counts, out


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], e)
        else:
            out.append({"start": s, "stop": e})
    return out


def shared_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (in words, merged) that items' windows cover, items whose windows occur (ids as strings, sorted).

    Null texts have no words; such items are no windows. A null item_id is called "null". Repeated rows and ids give a row each;
    empty tables give no rows, or no spans. Other columns are not read.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    state = docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text", "0L AS n_words", f"CAST(array() AS {SPANS}) spans", "CAST(array() AS array<string>) items")
    work = Workspace(spark, "decontam")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([(r.name, (r.text or "").encode()) for r in part.collect()])
        last = k == blocks - 1

        def search(it, sent=sent, last=last):
            index = Index(sent.value, window)
            for batch in it:
                for at, n, data, offsets in passes(batch.column(1)):
                    rows = batch.slice(at, n)
                    counts, found = index.search(data, offsets)
                    spans, names = rows.column(3).to_pylist(), rows.column(4).to_pylist()
                    for row, (s, names_found) in found.items():
                        spans[row] = _merged(s + [(x["start"], x["stop"]) for x in spans[row]])
                        names[row] = sorted(names_found | set(names[row]))
                    out = {"doc_id": rows.column(0), "text": rows.column(1), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span), "items": pa.array(names, pa.list_(pa.string()))}
                    yield batches({c: v for c, v in out.items() if not (last and c == "text")})

        schema = f"doc_id long, {'' if last else 'text string, '}n_words long, spans {SPANS}, items array<string>"
        state = state.mapInArrow(search, schema)
        if not last:
            state = work.keep(state, f"block-{k}")
    return state


def digests(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.stop - x.start)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that hold an item's window. Rows of null doc_id stay; rows that share a doc_id go together."""
    hit = shared_spans(docs, benchmark, window).where(F.size("spans") > 0).select("doc_id").distinct()
    return drop_ids(docs, Workspace(docs.sparkSession, "decontam-hit").keep(hit, "hit"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
