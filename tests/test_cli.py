"""The command line over a capture file made here."""

import pytest
from test_alerts import frame, tcp

from flowloom import cli
from flowloom.ml import classify
from flowloom.plans import reports
from flowloom.sources import alert_files, pcap


def test_detect_report_and_dashboard(spark, tmp_path, capsys):
    frames = [(1_000_000_000 + i * 1000, frame((10, 0, 0, 9), (10, 0, 0, 1), 6, tcp(5000, i + 1, 0))) for i in range(12)]
    frames += [(1_100_000_000 + i * 1000, frame((10, 0, 0, 9), (10, 0, 0, 1), 6, tcp(6000 + i, 80, 2))) for i in range(40)]
    pcap.write(frames, str(tmp_path / "c.pcap"))
    cli.detect(spark, str(tmp_path / "c.pcap"), str(tmp_path / "out"))
    rows = alert_files.strict(spark, str(tmp_path / "out/alerts")).collect()
    kinds = {(r.kind, r.notified) for r in rows}
    assert ("stealth_scan", True) in kinds and any(k == "syn_flood" for k, _ in kinds)
    assert alert_files.document(spark, str(tmp_path / "out/session")).first().packets == 52
    cli.detect(spark, str(tmp_path / "c.pcap"), str(tmp_path / "late"), after_s=1050)
    assert "stealth_scan" not in {r.kind for r in alert_files.strict(spark, str(tmp_path / "late/alerts")).collect()}
    cli.main(["report", str(tmp_path / "out/alerts")])
    cli.main(["summarize", str(tmp_path / "out/alerts")])
    said = capsys.readouterr().out
    assert "## Campaigns" in said and "stealth_scan" in said and "## Alerts" in said
    cli.main(["dashboard", str(tmp_path / "out/alerts"), str(tmp_path / "page.html")])
    page = (tmp_path / "page.html").read_text()
    assert "<h2>Incidents</h2>" in page and page.count('class="card"') == 7 and "TRACKER" in page and "not shown" not in page and 'style="width:100%"' in page
    cli.main(["soak", str(tmp_path / "out/alerts"), str(tmp_path / "out/session")])
    said = capsys.readouterr().out
    assert "52 packets" in said and "not stopped cleanly" in said and "10.0.0.9 -> 10.0.0.1" in said
    (tmp_path / "held.csv").write_text("window_time,label\n1090.5,normal\n1050.0,normal\n")
    cli.main(["detect", str(tmp_path / "c.pcap"), str(tmp_path / "held"), "--after-csv", str(tmp_path / "held.csv")])
    assert "stealth_scan" not in {r.kind for r in alert_files.strict(spark, str(tmp_path / "held/alerts")).collect()}


def test_soak_refuses_a_session_without_packets(spark):
    alerts = spark.createDataFrame([("a", None, "port_scan", 0, True), ("a", "b", "dos", 3_600_000_000, None)], "src string, dst string, kind string, t_us long, notified boolean")
    one = lambda packets, end: spark.createDataFrame([(packets, 7, 0, 7_200_000_000, end)], "packets long, windows long, start_us long, last_us long, end_us long")
    with pytest.raises(ValueError):
        reports.soak(alerts, one(0, None))
    said = reports.soak(alerts, one(5, 3_600_000_000))
    assert "1.00 h, stopped cleanly" in said and "| logged | 2 | 2.0 |" in said and "| a -> ? | 1 |" in said and "| recon | 1 | 1.0 |" in said
    assert "2.00 h, not stopped cleanly" in reports.soak(alerts, one(5, None)) and "| logged | 2 | - |" in reports.soak(alerts, None)


def test_dataset_and_training(spark, tmp_path):
    for name, flags in (("calm", 24), ("scan", 2)):
        pcap.write([(1_000_000_000 + i * 10_000, frame((10, 0, 0, i % 7), (10, 0, 0, 99), 6, tcp(5000 + i, i % 30 + 1, flags, b"x" * (i % 5 if flags == 24 else 0)))) for i in range(120)], str(tmp_path / f"{name}.pcap"))
    (tmp_path / "registry.csv").write_text("path,label\n" + "".join(f"{tmp_path}/{n}.pcap,{n}\n" for n in ("calm", "scan", "gone")))
    with pytest.warns(UserWarning, match="gone.pcap"):
        cli.main(["dataset", str(tmp_path / "registry.csv"), str(tmp_path / "data")])
    assert alert_files.document(spark, str(tmp_path / "none")) is None
    rows = spark.read.parquet(str(tmp_path / "data"))
    assert {(r.capture, r.label) for r in rows.select("capture", "label").distinct().collect()} == {("calm.pcap", "calm"), ("scan.pcap", "scan")}
    cli.main(["train", str(tmp_path / "data"), str(tmp_path / "model")])
    model, about = classify.load(str(tmp_path / "model"))
    assert about["feature_set"] == "D" and classify.predict(model, rows).where("verdict = label").count() == rows.count()


def test_metrics_document(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text('{"kind": "dos", "source": "x", "capture": "one", "notified": true}\n{"kind": "odd", "source": "x", "capture": "calm"}\n')
    (tmp_path / "e.csv").write_text("capture,expected,in_training\none,dos,true\ntwo,port_scan,false\n")
    (tmp_path / "n.csv").write_text("capture\ncalm\n")
    cli.main(["metrics", *(str(tmp_path / n) for n in ("a.jsonl", "e.csv", "n.csv"))])
    said = capsys.readouterr().out
    assert "| one | dos | 1 | 1 | True | True | True |" in said and "| calm | 1 | 1 | odd |" in said


def test_live_section(spark, tmp_path, capsys):
    (tmp_path / "live.json").write_text('{"measured_on": "2024-01-01", "interface": "eth0", "generator": "a tool", "note": "once",\n "capture_path": {"flood": {"received": 990, "dropped": 10}, "none": {"received": 0, "dropped": 0}},\n "detections": {"flood": {"detected": true, "by": "tracker", "half_open": 7}, "scan": {"detected": false, "by": "-"}}}')
    cli.main(["live", str(tmp_path / "live.json")])
    said = capsys.readouterr().out
    assert "| flood | 990 | 10 | 1.0 |" in said and "| none | 0 | 0 | 0.0 |" in said and "| flood | detected | tracker | 7 | - |" in said and "| scan | missed |" in said
    cli.main(["live", str(tmp_path / "gone.json")])
    assert "Nothing was measured" in capsys.readouterr().out
