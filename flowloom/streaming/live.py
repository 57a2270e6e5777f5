"""The whole detection as two streaming queries: packets to alerts, alerts to notices.

The first closes anchored windows batch by batch. A capture's windows are closed up to `LATE_US` before its newest packet; what
stays open is carried to the next batch, which so anchors where this one ended. A packet that comes so late that its time lies before
the end of a closed window is dropped and counted (`late_packets`), as it can't move that window any more; a late one after that counts
like all others. With the flows and fragments of the last
`HISTORY_US` (twice the scans' memory, so that counts of the nearer half are whole) the batch detectors give the alerts
of the newly closed windows, the same as over the whole capture. Only slowloris differs: connections that a triple last held more
than `HISTORY_US` ago aren't known any more.

Each batch writes its state and its alerts below its own number, alerts by one rename, so a batch that is run again leaves
the same tables. The second query folds the policy's state per pair over these alerts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from .. import constants as K
from ..operators import alerts as A
from ..operators import flows as FL
from ..operators import labels as L
from ..operators import windows as W
from . import metrics as M
from . import pipeline as P

LATE_US = 10 * K.SECOND_US
HISTORY_US = 2 * K.SCAN_HISTORY_US
PACKET = "capture string, pkt_no long, ts_us long, src string, dst string, sport int, dport int, flags int, payload_len int, proto string, frame_len int, ip_version int, frag boolean"
ALERT = (
    "capture string, window_id long, window_us long, stage int, idx string, kind string, source string, destination string, num_flows long, num_ports long, "
    "model_verdict string, confidence double, description string, model_unsure struct<verdict: string, confidence: double>"
)
ENDS, LATE = "capture string, end_us long, windows long", "capture string, packets long"
NOTE = "capture string, src string, dst string, window_us long, kind string, verdict string, confidence double"


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


class Detector:
    """Takes packets in micro-batches and writes the alerts of each below `alerts`; tables between batches lie below `state`."""

    def __init__(self, state: str, alerts: str, score: Callable[[DataFrame], DataFrame] = L.rule_verdict, late_us: int = LATE_US, closed: M.BatchCounts | None = None):
        self.state, self.alerts, self.score, self.late_us, self.closed = state, alerts, score, late_us, closed

    def _fs(self, spark: SparkSession, path: str):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place

    def _keep(self, df: DataFrame, number: int, name: str) -> DataFrame:
        path = f"{self.state}/{number}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _last(self, spark: SparkSession, number: int, name: str, schema) -> DataFrame:
        if number == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.state}/{number - 1}/{name}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        carried = self._last(spark, number, "open", PACKET + ", base long")
        names = _names(PACKET)
        ends = self._last(spark, number, "ends", ENDS)  # a row a capture
        batch = batch.select(*names).join(ends.drop("windows"), "capture", "left").withColumn("late", F.coalesce(F.col("ts_us") < F.col("end_us"), F.lit(False)))
        batch = self._keep(batch.select(*names, "late"), number, "batch")  # the source is read once, and so counted once
        late = batch.where("late").groupBy("capture").agg(F.count("*").alias("packets"))
        before = self._last(spark, number, "late", LATE)
        late = self._keep(before.unionByName(late).groupBy("capture").agg(F.sum("packets").alias("packets")), number, "late")
        batch = batch.where("NOT late")
        bases = carried.groupBy("capture").agg(F.max("base").alias("base"))
        met = W.anchored(carried.select(*names).unionByName(batch.select(*names))).join(bases, "capture", "left")
        met = met.withColumn("window_id", F.col("window_id") + F.coalesce("base", F.lit(0))).drop("base")
        met = self._keep(met, number, "windows")
        newest = met.groupBy("capture").agg((F.max("ts_us") - self.late_us).alias("upto"))
        first_open = F.min(F.when(F.col("window_us") + K.WINDOW_US > F.col("upto"), F.col("window_id")))
        edge = met.join(newest, "capture").groupBy("capture").agg(first_open.alias("edge"))  # the newest packet's window is open
        split = met.join(edge, "capture")
        self._keep(split.where("window_id >= edge").select(*names, F.col("edge").alias("base")), number, "open")
        closed = split.where("window_id < edge").select(*names, "window_id", "window_us")
        fresh = closed.select("capture", (F.col("window_us") + K.WINDOW_US).alias("end_us"), (F.col("window_id") + 1).alias("windows"))
        after = self._keep(ends.unionByName(fresh).groupBy("capture").agg(F.max("end_us").alias("end_us"), F.max("windows").alias("windows")), number, "ends")
        if self.closed is not None:
            total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]  # noqa: E731  a row a capture
            self.closed.put(number, total(after, "windows") - total(ends, "windows"), total(late, "packets") - total(before, "packets"))

        flows = self._keep(FL.flows(closed), number, "fresh")
        labelled = self._keep(L.campaigns(self.score(flows)), number, "labels")
        fragments = self._last(spark, number, "fragments", closed.schema)
        history = self._last(spark, number, "flows", flows.schema)
        known = self._last(spark, number, "notes", NOTE)
        packets = fragments.unionByName(closed)
        everything = self._keep(self._recent(history.unionByName(flows)), number, "flows")
        self._keep(self._recent(packets.where("frag")), number, "fragments")
        notes = known.unionByName(labelled.where("kind IS NOT NULL").where(L.unsure()).select(*_names(NOTE)))

        since = closed.groupBy("capture").agg(F.min("window_us").alias("since"))
        found = A.unified(packets, everything, labelled).join(since, "capture").where("window_us >= since").drop("since")
        self._publish(L.with_unsure(found, notes).select(*_names(ALERT)), number)
        newest_note = F.row_number().over(Window.partitionBy("capture", "src", "dst").orderBy(F.desc("window_us")))
        self._keep(notes.withColumn("n", newest_note).where("n = 1").drop("n"), number, "notes")
        if number > 1:
            fs, old = self._fs(spark, f"{self.state}/{number - 2}")
            fs.delete(old, True)

    def _recent(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy("capture").agg((F.max("window_us") - HISTORY_US).alias("oldest"))
        return rows.join(last, "capture").where("window_us >= oldest").select(*rows.columns)

    def _publish(self, alerts: DataFrame, number: int) -> None:
        spark = alerts.sparkSession
        fs, place = self._fs(spark, f"{self.alerts}/batch-{number}")
        if fs.exists(place):
            return
        alerts.write.mode("overwrite").parquet(f"{self.state}/{number}/alerts")
        fs.mkdirs(place.getParent())
        fs.rename(self._fs(spark, f"{self.state}/{number}/alerts")[1], place)


def detect(packets: DataFrame, alerts: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] = L.rule_verdict, session: str | None = None, **trigger) -> StreamingQuery:
    """Starts the first query over a stream of packets (see PACKET). trigger: as DataStreamWriter.trigger takes it.

    session: where the run's document is kept (see metrics.SessionWriter), which ends with the query.
    """
    spark, closed = packets.sparkSession, M.BatchCounts() if session else None
    if session:
        spark.streams.addListener(M.SessionWriter(spark, session, closed))
    detector = Detector(f"{checkpoint}/state", alerts, score, closed=closed)
    return M.observed(packets).writeStream.foreachBatch(detector).option("checkpointLocation", f"{checkpoint}/query").trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def late_packets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """capture, packets: how many packets of a detect() query came too late so far."""
    fs, place = Detector(f"{checkpoint}/state", "")._fs(spark, f"{checkpoint}/state")
    numbers = sorted(int(x.getPath().getName()) for x in fs.listStatus(place)) if fs.exists(place) else []
    done = [n for n in numbers if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/{n}/late/_SUCCESS"))]
    return spark.read.schema(LATE).parquet(f"{checkpoint}/state/{done[-1]}/late") if done else spark.createDataFrame([], LATE)


def notify(spark: SparkSession, alerts: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the second query: the alerts that detect() writes, with the policy's decision, as JSON lines below out."""
    rows = spark.readStream.schema(ALERT).option("recursiveFileLookup", True).parquet(alerts)
    told = P.policy(rows, carry=("num_flows", "num_ports", "confidence", "description"))
    return told.writeStream.outputMode("append").format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


class SilenceWarning(StreamingQueryListener):
    """Tells once when a query has had no packets for `windows` windows, and again after packets came and stopped anew."""

    def __init__(self, warn: Callable[[str], None] = print, windows: int = K.EMPTY_WINDOWS):
        self.warn, self.limit = warn, windows * K.WINDOW_US // K.SECOND_US
        self.since: dict = {}
        self.told: set = set()

    def _seen(self, query, at: str, rows: int) -> None:
        now = datetime.fromisoformat(at.replace("Z", "+00:00"))
        if rows or query not in self.since:
            self.since[query] = now
            self.told.discard(query)
        elif query not in self.told and (now - self.since[query]).total_seconds() >= self.limit:
            self.told.add(query)
            self.warn(f"No packets for {self.limit} s: does this sensor see any traffic?")

    def onQueryStarted(self, event) -> None:
        self._seen(event.runId, event.timestamp, 0)

    def onQueryProgress(self, event) -> None:
        self._seen(event.progress.runId, event.progress.timestamp, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._seen(event.runId, event.timestamp, 0)

    def onQueryTerminated(self, event) -> None:
        self.since.pop(event.runId, None)
        self.told.discard(event.runId)
