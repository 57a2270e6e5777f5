"""Anchored and fixed windows over packets.

An anchored window opens at a packet and closes before the first packet WINDOW_US or more later, which opens the next. So a
window's start depends on all before it, but only through one number: the time from which the next packet opens a window. Captures
are cut into chunks of `CHUNK_US`. Each chunk tells, for every packet at which its first window may open, when the window after its
last one may open and how many it holds (neighbours that end alike are one entry). These small tables are followed chunk by chunk,
a row per five minutes; then all chunks fold their own windows, each in a group of its own, however long traffic goes on without a
pause. Packets meet their chunk's windows in one equi-join on (capture, chunk).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

CHUNK_US = 300 * K.SECOND_US
KEY = ["capture", "chunk"]
#: A bound below all times: the capture's first packet opens a window.
ANY = -(1 << 62)


def _chunk() -> Column:
    return F.floor(F.col("ts_us") / CHUNK_US).alias("chunk")


def _jump(times: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the last window begins and how many there are, for windows that begin to open at these places of times."""
    count = np.ones(len(at), np.int64)
    while True:
        after = np.searchsorted(times, times[at] + K.WINDOW_US)
        alive = after < len(times)
        if not alive.any():
            return at, count
        at, count = np.where(alive, after, at), count + alive


def _exits(batches):
    """Per chunk (capture, chunk, times): upto, exits, counts. Of the first window's possible openings up to upto[i] and after
    upto[i - 1] each leads to a next one from exits[i] on, after counts[i] windows."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        cols: list[list] = [[], [], []]
        for chunk, values in zip(batch.column(1).to_pylist(), batch.column(2)):
            times = np.sort(values.values.to_numpy())
            open_at = np.arange(min(int(np.searchsorted(times, chunk * CHUNK_US + K.WINDOW_US)) + 1, len(times)))
            last, count = _jump(times, open_at)
            keep = np.append((last[1:] != last[:-1]) | (count[1:] != count[:-1]), True)
            for col, v in zip(cols, (times[open_at], times[last] + K.WINDOW_US, count)):
                col.append(v[keep])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, longs) for c in cols]], names=[*KEY, "upto", "exits", "counts"])


def _entries(batches):
    """Follows a capture's chunks in order: from when a window may open in each, the number and start of the one before."""
    capture, bound, number, start = object(), 0, 0, None
    for batch in batches:
        out: list[tuple] = []
        for name, chunk, *lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:]):
            upto, exits, counts = (x.values.to_numpy() for x in lists)
            if name != capture:
                capture, bound, number, start = name, ANY, 0, None
            out.append((name, chunk, bound, number, start))
            i = int(np.searchsorted(upto, bound))
            if i < len(upto):
                bound, number = int(exits[i]), number + int(counts[i])
                start = bound - K.WINDOW_US
        kinds = (batch.schema.field(0).type, *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[*KEY, "bound", "number", "start"])


def _starts(batches):
    """Per chunk (capture, chunk, times, bound): the starts of its own windows."""
    for batch in batches:
        out = []
        for values, bound in zip(batch.column(2), batch.column(3).to_pylist()):
            times, starts = np.sort(values.values.to_numpy()), []
            at = int(np.searchsorted(times, bound))
            while at < len(times):
                starts.append(int(times[at]))
                at = int(np.searchsorted(times, starts[-1] + K.WINDOW_US))
            out.append(starts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=[*KEY, "starts"])


def chunk_windows(packets: DataFrame) -> DataFrame:
    """A row a chunk that has packets: capture, chunk, the number and start of the window that is open at its begin (null: none), and
    the starts of its own windows."""
    times = packets.groupBy("capture", _chunk()).agg(F.collect_set("ts_us").alias("times"))
    kind = dict(packets.dtypes)["capture"]
    exits = times.mapInArrow(_exits, f"capture {kind}, chunk long, upto array<long>, exits array<long>, counts array<long>")
    entries = exits.repartition("capture").sortWithinPartitions(*KEY).mapInArrow(_entries, f"capture {kind}, chunk long, bound long, number long, start long")
    own = times.join(entries.select(*KEY, "bound"), KEY).select(*KEY, "times", "bound").mapInArrow(_starts, f"capture {kind}, chunk long, starts array<long>")
    return entries.select(*KEY, "number", "start").join(own, KEY)


def anchored(packets: DataFrame) -> DataFrame:
    """packets with window_id (0, 1, ... within the capture) and window_us, the time of the window's first packet."""
    met = packets.withColumn("chunk", _chunk()).join(chunk_windows(packets), KEY)
    own = F.size(F.filter("starts", lambda s: s <= F.col("ts_us")))
    met = met.withColumn("own", own).withColumn("window_id", F.col("number") + F.col("own") - 1)
    return met.withColumn("window_us", F.coalesce(F.get("starts", F.col("own") - 1), F.col("start"))).select(*packets.columns, "window_id", "window_us")


def fixed(packets: DataFrame, seconds: int = 5) -> DataFrame:
    """packets with window_id on a grid from the capture's first packet."""
    first = packets.groupBy("capture").agg(F.min("ts_us").alias("t0"))
    return packets.join(first, "capture").withColumn("window_id", F.floor((F.col("ts_us") - F.col("t0")) / (seconds * K.SECOND_US)).cast("long")).drop("t0")


def after(packets: DataFrame, ts_us: int) -> DataFrame:
    """Packets from a time on; windows anchor anew there."""
    return packets.where(F.col("ts_us") >= ts_us)
