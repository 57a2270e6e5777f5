"""Command line: python -m flowloom.cli COMMAND ...

detect CAPTURE OUT [--after SECONDS | --after-csv TABLE]
                                         alerts of a capture file or folder, as JSON lines, and the session beside them; only of packets
                                         from a time on, or from the least window_time of a held-out table on
soak ALERTS [SESSION]                    report of a long run: rates an hour, busiest pairs, what was shown
metrics ALERTS EXPECTED NORMAL           evaluation of alerts against CSV tables (capture, expected, in_training) and (capture)
live RESULTS                             section on what was measured live, of a JSON document
dataset REGISTRY OUT                     labelled flows of the captures in a CSV table (path, label), as Parquet
train DATA MODEL [--set NAME]            a forest of such flows, saved with its feature set
compare DATA [--set NAME]                forest, boosted trees and logistic regression on a random split
report ALERTS                            incidents and campaigns of alert files
dashboard ALERTS PAGE [--watch SECONDS]  an HTML page, made anew every so often
summarize ALERTS                         alerts, notices and pairs by kind
"""

from __future__ import annotations

import argparse
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions.exprs import format_duration, format_time
from .operators import alerts, flows, incidents, labels, policy, windows
from .plans import analysis, reports
from .sources import alert_files, pcap
from .workspace import Workspace


def session() -> SparkSession:
    s = SparkSession.builder.appName("flowloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def detect(spark: SparkSession, capture: str, out: str, after_s: float | None = None, score=labels.rule_verdict) -> None:
    """score: gives flows verdict, confidence and is_anomaly (see ml.classify.verdicts for trained models)."""
    pcap.register(spark)
    packets = spark.read.format("pcap").load(capture)
    if after_s is not None:
        packets = windows.after(packets, int(after_s * K.SECOND_US))
    work = Workspace(spark, "detect")
    packets = work.keep(windows.anchored(packets), "packets")
    rows = work.keep(flows.context(flows.flows(packets)), "flows")
    labelled = work.keep(labels.campaigns(score(rows)), "labels")
    shown = labels.with_unsure(policy.apply_policy(alerts.unified(packets, rows, labelled)), labelled)
    stamped = shown.withColumn("timestamp", F.date_format(F.timestamp_micros("window_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    alert_files.append_alerts(stamped.drop("stage", "idx", "specificity"), f"{out}/alerts")
    alert_files.write_session(analysis.session(packets), f"{out}/session")
    work.drop()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    x = alert_files.tolerant(alert_files.lines(spark, path))
    shown = F.coalesce(F.try_element_at("fields", F.lit("notified")).try_cast("boolean"), F.lit(True))
    return x.select("src", "dst", "kind", (F.col("seconds") * K.SECOND_US).cast("long").alias("t_us"), "confidence", shown.alias("notified"), F.monotonically_increasing_id().alias("seq"))


def found(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = read_alerts(spark, path)
    i = incidents.incidents(a)
    return a, i, incidents.campaigns(i.withColumn("seq", F.xxhash64("src", "kind", "first_us")))


def readable(rows: DataFrame) -> DataFrame:
    seconds = lambda c: F.col(c) / K.SECOND_US
    return incidents.by_priority(rows).withColumn("from", format_time(seconds("first_us"))).withColumn("lasted", format_duration(seconds("last_us") - seconds("first_us"))).drop("first_us", "last_us")


def since_table(spark: SparkSession, path: str, column: str = "window_time") -> float:
    """The least time, in seconds, of a held-out table, from which on a run is judged."""
    first = alert_files.table(spark, path).agg(F.min(F.col(column).cast("double"))).first()[0]
    if first is None:
        raise ValueError(f"{path} has no {column}")
    return first


def soak(spark: SparkSession, path: str, session_path: str | None = None) -> str:
    """The session is one that detect() or a stream left, or none."""
    return reports.soak(read_alerts(spark, path), None if session_path is None else alert_files.document(spark, session_path))


def dataset(spark: SparkSession, registry: str, out: str) -> None:
    """Flows with features, context, label and capture of every capture that is there."""
    pcap.register(spark)
    rows = [(r.path, r.label) for r in alert_files.table(spark, registry, "path string, label string").collect()]  # the capture registry
    there = alert_files.captures(spark, rows).collect()
    parts = [spark.read.format("pcap").load(r.path).withColumn("label", F.lit(r.label)) for r in there]
    if not parts:
        raise ValueError("none of the captures is there")
    packets = reduce(lambda a, b: a.unionByName(b), parts)
    labels_of = packets.select("capture", "label").distinct()
    found_flows = flows.context(flows.flows(windows.anchored(packets.drop("label"))))
    found_flows.join(F.broadcast(labels_of), "capture").write.mode("overwrite").parquet(out)  # a row a capture


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="flowloom")
    sub = p.add_subparsers(dest="command", required=True)
    commands = {"detect": ["capture", "out"], "report": ["alerts"], "dashboard": ["alerts", "page"], "summarize": ["alerts"], "soak": ["alerts"], "metrics": ["alerts", "expected", "normal"], "live": ["results"], "dataset": ["registry", "out"], "train": ["data", "model"], "compare": ["data"]}
    made = {}
    for name, words in commands.items():
        made[name] = sub.add_parser(name)
        for w in words:
            made[name].add_argument(w)
    made["detect"].add_argument("--after", type=float)
    made["detect"].add_argument("--after-csv")
    made["dashboard"].add_argument("--watch", type=int, default=0)
    made["soak"].add_argument("session", nargs="?")
    for name in ("train", "compare"):
        made[name].add_argument("--set", default="D")
    a, spark = p.parse_args(args), session()
    if a.command == "detect":
        detect(spark, a.capture, a.out, since_table(spark, a.after_csv) if a.after_csv else a.after)
    elif a.command == "soak":
        print(soak(spark, a.alerts, a.session))
    elif a.command == "metrics":
        rows = alert_files.tolerant(alert_files.lines(spark, a.alerts))
        given = lambda name: F.try_element_at("fields", F.lit(name))
        rows = rows.select("kind", given("capture").alias("capture"), F.coalesce(given("notified").try_cast("boolean"), F.lit(True)).alias("notified"))
        print(reports.metrics(rows, alert_files.table(spark, a.expected, "capture string, expected string, in_training boolean"), alert_files.table(spark, a.normal, "capture string")))
    elif a.command == "live":
        print(reports.live(alert_files.live_results(spark, a.results)))
    elif a.command == "dataset":
        dataset(spark, a.registry, a.out)
    elif a.command in ("train", "compare"):
        from .ml import boosting, classify

        rows, features = spark.read.parquet(a.data), flows.feature_set(a.set)
        if a.command == "train":
            classify.save(classify.fit(rows, features), features, a.set, a.model)
        else:
            split = Workspace(spark, "compare").keep(classify.stratified(rows, "label", 0.75), "split")
            print(reports.markdown("Models", boosting.compare(split.where("part = 'train'"), split.where("part = 'test'"), features)))
    elif a.command == "summarize":
        print(reports.markdown("Alerts", reports.summarize(read_alerts(spark, a.alerts))))
    elif a.command == "report":
        _, i, c = found(spark, a.alerts)
        print(reports.markdown("Campaigns", readable(c)))
        print(reports.markdown("Incidents", readable(i)))
    else:
        while True:
            Path(a.page).write_text(reports.dashboard(*found(spark, a.alerts), refresh_s=a.watch))
            if not a.watch:
                return
            time.sleep(a.watch)


if __name__ == "__main__":
    main()
