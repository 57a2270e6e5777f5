"""The streaming queries give what the batch detectors give over the whole capture."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.operators import alerts as A
from flowloom.operators import flows as FL
from flowloom.operators import labels as L
from flowloom.operators import policy as P
from flowloom.operators import windows as W
from flowloom.streaming import live


def made(spark):
    """A slow scan, a SYN flood and a fragment flood that last over several batches, then one packet that closes all windows."""
    rows = []
    for i in range(40):
        rows.append((i * 4 * K.SECOND_US, "10.0.0.1", "10.0.0.9", 4000 + i, 100 + i, 2, 0, "TCP", False))
    for i in range(200):
        rows.append((50 * K.SECOND_US + i * 60_000, "10.0.0.2", "10.0.0.9", 5000 + i, 80, 2, 0, "TCP", False))
    for i in range(400):
        rows.append((60 * K.SECOND_US + i * 100_000, "10.0.0.3", "10.0.0.9", None, None, None, None, None, True))
    rows.append((400 * K.SECOND_US, "10.0.0.4", "10.0.0.9", 1, 2, 2, 0, "TCP", False))
    rows = [("c", n, *r[:7], r[7], 60, 4, r[8]) for n, r in enumerate(sorted(rows, key=lambda r: r[0]))]
    return spark.createDataFrame(rows, live.PACKET)


def test_stream_equals_batch(spark, tmp_path):
    packets = made(spark)
    for i, (a, b) in enumerate([(0, 58), (58, 90), (90, 1000)]):
        packets.where((F.col("ts_us") >= a * K.SECOND_US) & (F.col("ts_us") < b * K.SECOND_US)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(live.PACKET).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.detect(stream, f"{tmp_path}/alerts", f"{tmp_path}/one", availableNow=True).awaitTermination()
    live.notify(spark, f"{tmp_path}/alerts", f"{tmp_path}/out", f"{tmp_path}/two", availableNow=True).awaitTermination()
    got = spark.read.schema(live.ALERT).option("recursiveFileLookup", True).parquet(f"{tmp_path}/alerts")

    p = W.anchored(packets)
    f = FL.flows(p)
    lab = L.campaigns(L.rule_verdict(f))
    want = L.with_unsure(P.apply_policy(A.unified(p, f, lab)), lab).where(F.col("window_us") < 400 * K.SECOND_US).persist()
    cols = ["window_id", "window_us", "stage", "idx", "kind", "source", "destination", "num_flows", "num_ports", "confidence", "model_unsure"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert {r.kind for r in got.select("kind").distinct().collect()} >= {"slow_scan", "syn_flood", "fragmented_scan"}
    told = spark.read.json(f"{tmp_path}/out")
    cols = ["window_us", "kind", "source", "destination", "notified", "suppressed_repeats", "description"]
    assert sorted(map(str, told.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    packets, d = made(spark), live.Detector(f"{tmp_path}/state", f"{tmp_path}/alerts")
    d(packets, 0)
    before = sorted(map(str, spark.read.parquet(f"{tmp_path}/alerts/batch-0").collect()))
    d(packets, 0)
    assert before and sorted(map(str, spark.read.parquet(f"{tmp_path}/alerts/batch-0").collect())) == before
    d(packets.limit(0), 1)
    assert spark.read.parquet(f"{tmp_path}/alerts/batch-1").count() == 0


def test_silence_is_told_once():
    told = []
    w = live.SilenceWarning(told.append)
    at = lambda s: f"2024-01-01T00:{s // 60:02}:{s % 60:02}.000Z"
    w.onQueryStarted(SimpleNamespace(runId=1, timestamp=at(0)))
    w.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(runId=1, timestamp=at(5), numInputRows=3)))
    for s in (30, 64, 65, 70):
        w.onQueryIdle(SimpleNamespace(runId=1, timestamp=at(s)))
    assert len(told) == 1
    w.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(runId=1, timestamp=at(80), numInputRows=1)))
    w.onQueryIdle(SimpleNamespace(runId=1, timestamp=at(139)))
    assert len(told) == 1
    w.onQueryIdle(SimpleNamespace(runId=1, timestamp=at(140)))
    assert len(told) == 2
