"""What a running detection has seen: received and dropped packets, windows, the slowest one and the margin, as a session document.

Counts of packets come from `Dataset.observe`, which Spark adds up where the packets are read; counts of windows and of late packets
from the detector, a row a capture. A listener adds the batches up and writes the document every `EVERY_WINDOWS` windows.
"""

from __future__ import annotations

import json
import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .. import constants as K

NAME, EVERY_WINDOWS = "packets", 60


def observed(packets: DataFrame) -> DataFrame:
    """packets, counted in each micro-batch under NAME."""
    return packets.observe(NAME, F.count(F.lit(1)).alias("received"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


class BatchCounts:
    """Windows closed and packets dropped in each micro-batch, from the detector to the listener."""

    def __init__(self):
        self.lock, self.of = threading.Lock(), {}

    def put(self, number: int, windows: int, dropped: int) -> None:
        with self.lock:
            self.of[number] = (windows, dropped)

    def take(self, number: int) -> tuple[int, int]:
        with self.lock:
            return self.of.pop(number, (0, 0))


class SessionWriter(StreamingQueryListener):
    """Keeps the session document of one query at `path`; `closed` says how many windows a batch closed and packets it dropped."""

    def __init__(self, spark: SparkSession, path: str, closed: BatchCounts, every: int = EVERY_WINDOWS):
        self.spark, self.path, self.closed, self.every = spark, path, closed, every
        self.query, self.written, self.busy, self.slowest = None, 0, 0.0, 0.0
        self.totals = {"start": None, "last_update": None, "end": None, "packets": 0, "dropped": 0, "windows": 0, "first_us": None, "last_us": None}

    def document(self) -> dict:
        """The totals, loss in percent, seconds of the slowest window, and margin: the time that the windows last over the time they took."""
        seen = self.totals["packets"]
        margin = self.totals["windows"] * K.WINDOW_US / K.SECOND_US / self.busy if self.busy else None
        return self.totals | {"loss_percent": round(100.0 * self.totals["dropped"] / seen, 2) if seen else 0.0, "slowest_window_s": round(self.slowest, 3), "margin": None if margin is None else round(margin, 3)}

    def _write(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        out = place.getFileSystem(conf).create(place, True)
        out.write(bytearray((json.dumps(self.document()) + "\n").encode()))
        out.close()
        self.written = self.totals["windows"]

    def onQueryStarted(self, event) -> None:
        if self.query is None:
            self.query, self.totals["start"] = event.runId, event.timestamp

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId != self.query:
            return
        t, m = self.totals, p.observedMetrics.get(NAME)
        windows, dropped = self.closed.take(p.batchId)
        if m is not None and m.received:
            t["packets"] += m.received
            t["first_us"] = m.first_us if t["first_us"] is None else min(t["first_us"], m.first_us)
            t["last_us"] = m.last_us if t["last_us"] is None else max(t["last_us"], m.last_us)
        t["windows"], t["dropped"], t["last_update"] = t["windows"] + windows, t["dropped"] + dropped, p.timestamp
        seconds = p.batchDuration / 1000
        if windows:
            self.busy, self.slowest = self.busy + seconds, max(self.slowest, seconds / windows)
        if t["windows"] - self.written >= self.every:
            self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.query:
            self.totals["end"] = datetime.now(timezone.utc).isoformat()
            self._write()
