"""Captures that grow under a stream, capture files written by tasks, and packets that come late."""

import struct
import time

import pytest
from pyspark.sql import functions as F
from test_live import made

from flowloom import constants as K
from flowloom.operators import windows as W
from flowloom.sources import pcap
from flowloom.streaming import live


def frame_of(n: int) -> bytes:
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40, 0, 0, 64, 6, 0, bytes([10, 0, 0, n % 200]), bytes([10, 0, 1, 1]))
    return b"\x02" * 12 + b"\x08\x00" + ip + struct.pack(">HHIIBBHHH", 1000 + n, 80, 0, 0, 0x50, 2, 0, 0, 0)


def classic(frames) -> bytes:
    return pcap._header(pcap.ETHERNET) + b"".join(struct.pack("<IIII", ts // 10**6, ts % 10**6, len(d), len(d)) + d for ts, d in frames)


def nextgen(frames) -> bytes:
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for ts, d in frames:
        pad = d + b"\0" * (-len(d) % 4)
        out += block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(d), len(d)) + pad) + block(5, b"\0" * 12)
    return out


FRAMES = [(10**15 + i * 1000, frame_of(i)) for i in range(60)]


@pytest.mark.parametrize("kind,cuts", [(classic, (0, 10, 24, 30, 700, 701, 2500, None)), (nextgen, (0, 10, 30, 48, 50, 900, 2600, None))])
def test_a_growing_capture_is_read_once_whatever_its_cuts(tmp_path, kind, cuts):
    raw, path = kind(FRAMES), tmp_path / "a.pcap"
    stream, rows = pcap.PcapStream({"path": str(tmp_path)}), []
    at = stream.initialOffset()
    for cut in cuts:
        path.write_bytes(raw[:cut])
        end = stream.latestOffset()
        for p in stream.partitions(at, end):
            rows += [r for b in stream.read(p) for r in b.to_pylist()]
        at = end
    assert [(r["pkt_no"], r["ts_us"], r["sport"]) for r in rows] == [(i, ts, 1000 + i) for i, (ts, _) in enumerate(FRAMES)]
    # A new reader knows nothing of what was skipped, and plans a batch that lies behind.
    path.write_bytes(raw[:1200])
    other = pcap.PcapStream({"path": str(tmp_path)})
    again = [r["pkt_no"] for p in other.partitions({"done": "", "sizes": {"a.pcap": 700}}, {"done": "", "sizes": {"a.pcap": 2500}}) for b in pcap.batches(str(tmp_path), name=p.name, mark=p.mark, stop=1200) for r in b.to_pylist()]
    assert again and again == [r["pkt_no"] for r in rows if again[0] <= r["pkt_no"] <= again[-1]]


def test_offsets_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(pcap, "OPEN_FILES", 2)
    stream, at, seen = pcap.PcapStream({"path": str(tmp_path), "max_bytes": "3000"}), None, []
    at = stream.initialOffset()
    for i in range(6):
        (tmp_path / f"{i}.pcap").write_bytes(classic(FRAMES[i * 10 : i * 10 + 10]))
    for _ in range(12):
        end = stream.latestOffset()
        assert sum(end["sizes"].values()) - sum(s for n, s in at["sizes"].items() if n in end["sizes"]) <= 3000
        seen += [r["sport"] - 1000 for p in stream.partitions(at, end) for b in stream.read(p) for r in b.to_pylist()]
        at = end
    assert seen == list(range(60)) and len(at["sizes"]) == 2 and at["done"] == "3.pcap"


def test_a_query_goes_on_after_a_restart(spark, tmp_path):
    pcap.register(spark)
    (tmp_path / "in").mkdir()
    raw, other = classic(FRAMES), classic(FRAMES[:5])

    def run():
        q = spark.readStream.format("pcap").load(str(tmp_path / "in")).select("capture", "pkt_no", "ts_us").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()

    (tmp_path / "in/a.pcap").write_bytes(raw[:1500])
    run()
    (tmp_path / "in/a.pcap").write_bytes(raw)
    (tmp_path / "in/b.pcap").write_bytes(other)
    run()
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("a.pcap", i, ts) for i, (ts, _) in enumerate(FRAMES)] + [("b.pcap", i, ts) for i, (ts, _) in enumerate(FRAMES[:5])]


def test_written_captures_come_back(spark, tmp_path):
    pcap.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(nextgen(FRAMES))
    rows = spark.read.format("pcap").option("frames", True).load(f"file://{tmp_path}/in")
    out = str(tmp_path / "out")
    chosen = rows.where("sport >= 1030").repartitionByRange(3, "ts_us").sortWithinPartitions("ts_us")
    chosen.write.format("pcap").mode("append").save(out)
    back = spark.read.format("pcap").load(out)
    assert sorted(r.sport for r in back.collect()) == list(range(1030, 1060)) and back.select("capture").distinct().count() == 3
    rows.where("sport < 1004").coalesce(1).write.format("pcap").mode("overwrite").save(out)
    assert sorted(r.sport for r in spark.read.format("pcap").load(out).collect()) == [1000, 1001, 1002, 1003]
    mixed = rows.limit(4).coalesce(1).withColumn("link", F.when(F.col("sport") == 1002, 101).otherwise(1).cast("int"))
    with pytest.raises(Exception, match="one link type"):
        mixed.write.format("pcap").mode("append").save(out)
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.endswith(".crc"))[0].startswith("part-") and len(list((tmp_path / "out").iterdir())) == 1
    with pytest.raises(Exception, match="needs the columns"):
        rows.select("ts_us").write.format("pcap").mode("append").save(out)


def test_late_packets_move_no_closed_window(spark, tmp_path):
    s = K.SECOND_US
    rows = [("c", i, t * s, "a", "b", 1, 2, 2, 0, "TCP", 60, 4, False) for i, t in enumerate([20, 22, 25, 29, 30, 34, 35, 39, 40])]
    late = [("c", 90, int(23.5 * s), "a", "b", 1, 2, 2, 0, "TCP", 60, 4, False), ("c", 91, 34 * s, "a", "b", 1, 2, 2, 0, "TCP", 60, 4, False), ("c", 92, 61 * s, "a", "b", 1, 2, 2, 0, "TCP", 60, 4, False)]
    d = live.Detector(f"{tmp_path}/x/state", f"{tmp_path}/alerts")
    d(spark.createDataFrame(rows, live.PACKET), 0)
    d(spark.createDataFrame(late, live.PACKET), 1)
    got = spark.read.parquet(f"{tmp_path}/x/state/0/windows").where("ts_us < 30000000").union(spark.read.parquet(f"{tmp_path}/x/state/1/windows")).select("window_id", "window_us").distinct()
    want = W.anchored(spark.createDataFrame(rows + late[1:], live.PACKET)).select("window_id", "window_us").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in live.late_packets(spark, f"{tmp_path}/x").collect()] == [("c", 1)]
    assert live.late_packets(spark, f"{tmp_path}/none").count() == 0
    assert made(spark).count() == 641


def test_session_document_of_a_stream(spark, tmp_path, monkeypatch):
    import json

    from flowloom.streaming import metrics

    monkeypatch.setattr(metrics, "EVERY_WINDOWS", 2)
    packets = made(spark)
    for i, (a, b) in enumerate([(0, 58), (58, 1000)]):
        packets.where((F.col("ts_us") >= a * K.SECOND_US) & (F.col("ts_us") < b * K.SECOND_US)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(live.PACKET).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.detect(stream, f"{tmp_path}/alerts", f"{tmp_path}/one", session=f"file://{tmp_path}/session.json", availableNow=True)
    q.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    at = time.time()
    while time.time() < at + 20 and not ((tmp_path / "session.json").exists() and json.loads((tmp_path / "session.json").read_text())["end"]):
        time.sleep(0.2)
    got = json.loads((tmp_path / "session.json").read_text())
    assert (got["packets"], got["dropped"], got["first_us"], got["last_us"]) == (641, 0, 0, 400 * K.SECOND_US) and got["windows"] > 10
    assert got["slowest_window_s"] > 0 and got["margin"] > 0 and got["start"] and got["end"] and got["loss_percent"] == 0.0
