"""Registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..operators import alerts as A
from ..operators import detectors as D
from ..operators import flows as FL
from ..operators import incidents as I
from ..operators import labels as L
from ..operators import policy as P
from ..operators import windows as W
from ..sources import adapters, alert_files, datasets
from ..workspace import Workspace
from . import analysis as AN
from . import reports as R
from .oracles import FEATURE_DOUBLES, FEATURE_LIST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def win(s: SparkSession, d: str) -> DataFrame:
    return W.anchored(adapters.packets(s, d))


def flw(s: SparkSession, d: str) -> DataFrame:
    return FL.flows(win(s, d))


def kept(s: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """A table that several branches of a query read."""
    return Workspace(s, name).keep(df, "rows")


def flows_once(s: SparkSession, d: str) -> DataFrame:
    """Flows for queries that read them more than once."""
    return kept(s, "flows", flw(s, d))


def long(*cols: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in cols]


def joined(c: str):
    return F.array_join(c, ",").alias(c)


def key_text():
    end = lambda e: F.concat(F.col(f"flow.{e}.ip"), F.lit(":"), F.col(f"flow.{e}.port").cast("string"))
    return F.concat(end("a"), F.lit("|"), end("b"), F.lit("|"), F.col("flow.proto")).alias("flow")


@query
def packet_views(s, d):
    return adapters.packets(s, d).select("pkt_no", "src", "dst", "sport", "dport", "flags", "payload_len", "proto", F.coalesce(F.col("proto") == "TCP", F.lit(False)).alias("is_tcp"))


@query
def flow_keys(s, d):
    return FL.with_flows(adapters.packets(s, d)).select("pkt_no", key_text())


@query
def tcp_flag_classes(s, d):
    return adapters.packets(s, d).select("pkt_no", X.base_flags().alias("base_flags"), X.stealth_type().alias("stealth"), X.is_scan_probe().alias("probe"))


@query
def anchored_windows(s, d):
    return win(s, d).groupBy("window_id", "window_us").agg(F.count("*").alias("packets"))


@query
def fixed_windows(s, d):
    return W.fixed(adapters.packets(s, d)).groupBy("window_id").agg(F.count("*").alias("packets"))


@query
def fragment_flood(s, d):
    return D.fragment_flood(win(s, d)).select("window_id", "src", "dst", "fragments")


@query
def icmp_flood(s, d):
    return D.icmp_flood(win(s, d)).select("window_id", "src", "dst", "packets")


@query
def stealth_scan(s, d):
    return D.stealth_scan(win(s, d)).select("window_id", "src", "packets", "ports", joined("dsts"), joined("types"))


@query
def flow_features(s, d):
    return flw(s, d).select("window_id", "flow_seq", "destination_port", *FEATURE_LIST, *[F.round(F.col(c).cast("double") + 1e-9, 4).alias(c) for c in FEATURE_DOUBLES])


@query
def context_features(s, d):
    return FL.context(flows_once(s, d)).select("window_id", "flow_seq", "ctx_src_flows", "ctx_src_ports", "ctx_src_dsts", F.round("ctx_flows_per_port", 6).alias("ctx_flows_per_port"), "ctx_dst_sources", F.round("ctx_reply_rate", 6).alias("ctx_reply_rate"))


@query
def ack_scan(s, d):
    return D.ack_scan(flw(s, d)).select("window_id", "src", "probes", "ports", joined("dsts"))


@query
def syn_flood(s, d):
    return D.syn_flood(flw(s, d)).select("window_id", "src", "dst", "half_open", "ports")


@query
def slowloris_held(s, d):
    return D.held_open(flw(s, d)).select("window_id", "host_a", "host_b", "port", F.size("conns").cast("long").alias("connections"))


@query
def slow_connections(s, d):
    return D.slow_connections(flw(s, d)).select("window_id", "host_a", "host_b", "port", "connections")


@query
def slow_scan_edges(s, d):
    return D.slow_scan(flows_once(s, d)).select("window_us", "src", "dst", "port", "flow_seq", *long("ports_seen"))


@query
def dist_scan_edges(s, d):
    return D.distributed_scan(flows_once(s, d)).select("window_us", "dst", "port", "flow_seq", *long("ports_seen"))


@query
def fragment_episodes(s, d):
    return D.fragment_episodes(win(s, d)).select("window_us", "src", "dst", "fragments")


@query
def slowloris_alerts(s, d):
    return D.slowloris(flw(s, d)).select("window_us", "host_a", "host_b", "port", *long("connections", "persistent"))


def labelled(s, d):
    return L.campaigns(L.rule_verdict(flows_once(s, d)))


@query
def campaign_labels(s, d):
    return labelled(s, d).select("window_id", "src", "dst", "verdict", "num_flows", "num_ports", "confidence", "kind")


@query
def evasion_suppression(s, d):
    p = win(s, d)
    f = FL.flows(p)
    evaded = D.stealth_scan(p).select("capture", "window_id", "src").union(D.ack_scan(f).select("capture", "window_id", "src"))
    return L.without_evaded(L.campaigns(L.rule_verdict(f)), evaded).where("kind IS NOT NULL").select("window_id", "src", "dst", "kind")


@query
def low_conf_filter(s, d):
    return L.sure_only(labelled(s, d)).select("window_id", "src", "dst", "kind", "confidence")


@query
def unsure_asof(s, d):
    p = win(s, d)
    a = p.where("frag OR proto = 'TCP'").groupBy("capture", "window_us", F.col("src").alias("source"), F.col("dst").alias("destination")).count().withColumn("confidence", F.lit(None).cast("double"))
    return L.with_unsure(a, L.campaigns(L.rule_verdict(FL.flows(p)))).select("window_us", "source", "destination", F.col("model_unsure.verdict").alias("unsure_verdict"), F.col("model_unsure.confidence").alias("unsure_confidence"))


@query
def alert_family_lookup(s, d):
    return adapters.alerts(s, d).select("event_id", "kind", X.family().alias("family"), X.specificity().alias("specificity"))


def policy_input(s, d):
    return adapters.alerts(s, d).selectExpr("capture AS file", "'all' AS capture", "t_us AS window_us", "0 AS stage", "lpad(event_id, 19, '0') AS idx", "kind", "src AS source", "dst AS destination", "event_id")


@query
def policy_single_family(s, d):
    return P.apply_policy(policy_input(s, d).where("kind = 'dos'")).select("event_id", "source", "destination", "notified")


@query
def alert_policy(s, d):
    out = P.apply_policy(policy_input(s, d))
    return out.select("event_id", "source", "destination", "kind", "family", "notified", "upgrade", "suppressed_repeats", X.format_counts(F.col("suppressed_kinds")).alias("suppressed"))


@query
def detect(s, d):
    """All detectors, labels and the policy over one capture. Nine branches read the windowed packets and the flows, so both are kept."""
    work = Workspace(s, "detect")
    p = work.keep(win(s, d), "packets")
    f = work.keep(FL.flows(p), "flows")
    labelled = work.keep(L.campaigns(L.rule_verdict(f)), "labels")
    out = L.with_unsure(P.apply_policy(A.unified(p, f, labelled)), labelled)
    return out.select("window_id", "kind", "source", "destination", "num_flows", "num_ports", "confidence", "description", "family", "notified", "suppressed_repeats", F.col("model_unsure.verdict").alias("unsure"))


def found(s, d):
    return I.incidents(adapters.alerts(s, d).withColumnRenamed("event_id", "seq"))


@query
def incidents(s, d):
    return found(s, d).select("src", "kind", "severity", "alert_count", F.round("confidence", 6).alias("confidence"), "first_us", "last_us", (F.col("last_us") - F.col("first_us")).alias("duration_us"), joined("destinations"))


def _campaigns(alerts: DataFrame) -> DataFrame:
    rows = I.incidents(alerts.withColumnRenamed("event_id", "seq")).withColumn("seq", F.xxhash64("src", "kind", "first_us"))
    return I.campaigns(rows).select("first_us", "last_us", "alert_count", "incidents", F.round("confidence", 6).alias("confidence"), joined("sources"), joined("kinds"), joined("destinations"), "pattern", "severity")


@query
def campaigns(s, d):
    return _campaigns(adapters.site_alerts(s, d))


@query
def sample_campaigns(s, d):
    """Campaigns of what the alert log of a session holds: the table's alerts, appended as JSON lines and read back, with broken lines among them."""
    path = Workspace(s, "alert-log").path
    rows = adapters.alerts(s, d)
    log = rows.select(F.to_json(F.struct("event_id", "src", "dst", "kind", "t_us", "confidence")).alias("value"))
    log.union(rows.where("event_id % 100 = 0").select(F.lit("{not a record"))).write.mode("append").text(path)
    found = s.read.schema("event_id long, src string, dst string, kind string, t_us long, confidence double").json(path)
    return _campaigns(found.where("event_id IS NOT NULL"))


@query
def severity_by_day(s, d):
    return R.severity_by_day(found(s, d))


@query
def type_counts(s, d):
    return R.type_counts(found(s, d))


@query
def top_sources(s, d):
    return R.top_sources(found(s, d), 5)


@query
def newest_alerts(s, d):
    return adapters.alerts(s, d).orderBy(F.desc("event_id")).limit(50).select("event_id", "src", "kind")


@query
def summarize_alerts(s, d):
    return R.summarize(adapters.alerts(s, d))


@query
def soak_rates(s, d):
    return R.soak_rates(adapters.alerts(s, d))


@query
def kinds_per_capture(s, d):
    return R.kinds_per_capture(adapters.alerts(s, d))


# Kinds that the evaluation expects of the adapter's captures.
EXPECTED = (("cap0", "port_scan"), ("cap1", "brute_force"), ("cap2", "dos"), ("cap3", "port_scan"), ("cap9", "slowloris"))


def expected(s):
    return s.createDataFrame(list(EXPECTED), "capture string, expected string")


@query
def wrong_kinds(s, d):
    return R.wrong_kinds(adapters.alerts(s, d), expected(s))


@query
def evaluate_captures(s, d):
    return R.evaluate(adapters.alerts(s, d), expected(s))


@query
def detection_layers(s, d):
    a = adapters.alerts(s, d).withColumn("model_verdict", F.when(F.col("kind") == "anomaly", "anomaly"))
    return a.groupBy(X.layer().alias("layer")).agg(F.count("*").alias("alerts"), F.count_if("notified").alias("notified"))


@query
def ab_difference(s, d):
    a = adapters.alerts(s, d)
    return R.gained(a.where("event_id % 2 = 0"), a.where("event_id % 3 = 0 AND kind <> 'dos'"))


@query
def window_profile(s, d):
    return D.profile(win(s, d)).select("window_id", "src", "attempts", "ports", "dsts", "hint")


@query
def multi_source_windows(s, d):
    return D.multi_source(win(s, d)).select("window_id", "dst", "sources", "attempts")


@query
def episode_activity(s, d):
    return D.longest_pause(D.fragment_flood(win(s, d)), ["src", "dst"])


@query
def protocol_counts(s, d):
    return adapters.packets(s, d).groupBy(F.coalesce("proto", F.lit("other")).alias("proto")).agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"))


@query
def top_ports(s, d):
    return R.top(adapters.packets(s, d).where("dport IS NOT NULL"), "dport", "packets", 10)


@query
def profile_medians(s, d):
    rows = kept(s, "profiles", flw(s, d).select("src", "packets", "duration", "fwd_bytes"))
    x = AN.medians(rows, "src", ["packets", "duration", "fwd_bytes"])
    of = lambda c: F.max(F.when(F.col("feature") == c, F.col("median")))
    return x.groupBy("src").agg(of("packets").alias("packets"), F.round(of("duration"), 6).alias("duration"), of("fwd_bytes").alias("fwd_bytes"))


@query
def class_means(s, d):
    return L.rule_verdict(flw(s, d)).groupBy("verdict").agg(F.count("*").alias("flows"), *[F.round(F.avg(c), 6).alias(c) for c in ("total_fwd_packets", "fwd_bytes")], F.round(X.mean("duration"), 6).alias("duration"))


@query
def confusion_counts(s, d):
    return L.rule_verdict(flw(s, d)).groupBy(F.col("proto").alias("actual"), F.col("verdict").alias("predicted")).agg(F.count("*").alias("flows"))


@query
def time_split_holdout(s, d):
    return R.time_split(flw(s, d), ["window_us", "flow_seq"], K.SPLIT_SHARE).select("flow_seq", "part")


@query
def capped_sample(s, d):
    order = [(F.col("flow_seq") * 48271 + 42) % 2147483647, F.col("flow_seq")]
    return flw(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where("rn <= 100").select("flow_seq", "src")


@query
def normalise_alerts(s, d):
    """Alert lines of several dialects (and broken ones) back to one shape."""
    e = adapters.events(s, d).withColumn("v", F.col("event_id") % 5).withColumn("x", F.col("event_id") % 7)
    src, dst = F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")), F.concat(F.lit("192.168.1."), (F.col("user_id") % 4).cast("string"))
    kind, at, c = F.upper("event_type"), F.lit(1704067200) + F.col("event_id"), F.round(F.col("value") - F.floor("value"), 2)
    line = (
        F.when(F.col("x") == 5, "not json").when(F.col("x") == 6, "[1, 2]")
        .when(F.col("v") == 0, F.to_json(F.struct(src.alias("src"), dst.alias("dst"), kind.alias("type"), at.alias("timestamp"), c.alias("confidence"))))
        .when(F.col("v") == 1, F.to_json(F.struct(src.alias("source_ip"), dst.alias("target"), kind.alias("kind"), at.cast("string").alias("ts"))))
        .when(F.col("v") == 2, F.to_json(F.struct(src.alias("attacker"), kind.alias("label"), F.lit("2024-01-01T00:00:00Z").alias("time"), c.cast("string").alias("score"))))
        .when(F.col("v") == 3, F.to_json(F.struct(src.alias("ip"), kind.alias("attack"), F.lit("2024-01-01T00:00:00+00:00").alias("start"))))
        .otherwise(F.to_json(F.struct(kind.alias("prediction"), F.lit("later").alias("time"))))
    )
    raw = e.select(F.concat(line, F.lit("")).alias("value"), "event_id")
    fields = raw.withColumn("fields", alert_files.as_object(F.col("value")))
    return alert_files.normalised(fields, "event_id")


# ---------------------------------------------------------------- models


def dataset(s, d):
    """Flow features with context, the rule's verdict as label, and hosts as captures."""
    f = FL.context(L.rule_verdict(flw(s, d)).drop("confidence"))
    return f.withColumn("label", F.col("verdict")).drop("verdict", "is_anomaly").withColumn("host", F.col("src"))


@query
def rf_predict(s, d):
    """Share right and mean confidence of a forest on held-out flows, by label."""
    from ..ml import classify as C

    rows = kept(s, "rf-predict", C.stratified(dataset(s, d), "label", 0.75))
    features = FL.feature_set("D")
    model = C.fit(rows.where("part = 'train'"), features, trees=20, depth=8)
    got = C.predict(model, rows.where("part = 'test'"))
    return got.groupBy("label").agg(F.count("*").alias("flows"), F.round(F.avg((F.col("verdict") == F.col("label")).cast("double")), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query
def iforest_flags(s, d):
    """Flag rate of an isolation forest on normal flows, over all flows by label."""
    from ..ml.forest import IsolationForest

    rows = kept(s, "iforest", dataset(s, d))
    model = IsolationForest.fit(rows.where("label = 'normal'"), FL.feature_set("D"))
    return rows.groupBy("label").agg(F.count("*").alias("flows"), F.round(100 * F.avg(model.flags().cast("double")), 6).alias("flag_rate"))


@query
def loco_scores(s, d):
    """Share right for each host, by a model of all others."""
    from ..ml import classify as C

    got = C.leave_one_out(dataset(s, d).withColumn("capture", F.col("host")), FL.feature_set("D"))
    return s.createDataFrame(got, "capture string, label string, flows long, accuracy double")


@query
def contamination_sweep(s, d):
    """Percent flagged at several contaminations: each host's normal flows by a forest of all others, attacks by a forest of all."""
    from ..ml import classify as C

    rows = kept(s, "sweep-flows", dataset(s, d).withColumn("capture", F.col("host")))
    normal = rows.where("label = 'normal'")
    got = C.sweep(normal, FL.feature_set("D"), (0.001, 0.01, 0.05), judged=rows.where("label <> 'normal'").withColumn("capture", F.col("label")))
    return got.select("left_out", "capture", "contamination", "rows", F.round("flag_rate", 6).alias("flag_rate"))


@query
def feature_importance(s, d):
    """Accuracy that a forest loses when a feature is permuted: mean and deviation of five repeats."""
    from ..ml import classify as C

    rows = kept(s, "importance-flows", C.stratified(dataset(s, d), "label", 0.75))
    features = FL.feature_set("D")
    model = C.fit(rows.where("part = 'train'"), features, trees=20, depth=8)
    return C.permutation_importance(model, rows.where("part = 'test'"), features)


@query
def model_comparison(s, d):
    """Accuracy and macro recall of three kinds of models on held-out flows."""
    from ..ml import boosting, classify as C

    rows = kept(s, "comparison-flows", C.stratified(dataset(s, d), "label", 0.75))
    return boosting.compare(rows.where("part = 'train'"), rows.where("part = 'test'"), FL.feature_set("D"), trees=20, depth=8, rounds=3)


# ---------------------------------------------------------------- comparisons

PROFILE = ["packets", "fwd_bytes", "duration", "pkt_len_mean"]


@query
def nearest_profile(s, d):
    f = flows_once(s, d)
    got = AN.nearest_profile(f.where("src = '10.0.2.1'"), f.where("src <> '10.0.2.1'"), "src", PROFILE)
    return got.select("feature", F.round("target", 6).alias("target"), "nearest", "outside")


@query
def relative_gap(s, d):
    f = flw(s, d).where("proto <> 'ICMP'").withColumn("side", F.col("proto") == "UDP")
    got = R.relative_gap(f, "side", ["fwd_bytes", "packets", "pkt_len_mean"])
    return got.select("feature", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "gap")], "marked")


@query
def payload_stats(s, d):
    return AN.payload_stats(adapters.packets(s, d))


@query
def direction_check(s, d):
    return AN.direction_check(adapters.packets(s, d))


@query
def probe_ports(s, d):
    return AN.probe_ports(win(s, d)).select("window_id", "src", "dst", "ports", "probe_ports", "ephemeral")


@query
def session_summary(s, d):
    x = AN.session(win(s, d))
    return x.select("packets", "windows", F.round(AN.session_hours(F.col("start_us"), F.lit(None), F.col("last_us")), 6).alias("hours"))


@query
def packet_lines(s, d):
    return AN.describe(adapters.packets(s, d))


@query
def window_growth(s, d):
    """Packets of each window against the capture's window before: windows are numbered, so that is a join on the number."""
    w = kept(s, "growth", win(s, d).groupBy("capture", "window_id").agg(F.count("*").alias("packets")))
    before = w.select("capture", (F.col("window_id") + 1).alias("window_id"), F.col("packets").alias("before"))
    return w.join(before, ["capture", "window_id"], "left").select("window_id", "packets", F.round(F.col("packets") / F.col("before"), 6).alias("ratio"))


@query
def unsure_incidents(s, d):
    """Incidents, each with the layer that raised it and whether a model's unsure verdict stands on its source and kind."""
    a = adapters.alerts(s, d)
    pairs = a.where("confidence < 0.1").select("src", "kind").distinct().withColumn("unsure", F.lit(True))
    got = found(s, d).join(pairs, ["src", "kind"], "left")
    layer = F.when(F.col("kind") == "anomaly", "anomaly").when(F.col("confidence").isNull(), "tracker").otherwise("model")
    return got.select("src", "kind", "first_us", layer.alias("layer"), F.coalesce("unsure", F.lit(False)).alias("unsure"))


@query
def family_counts(s, d):
    return adapters.alerts(s, d).groupBy(X.family().alias("family")).agg(F.count("*").alias("alerts"), F.count_if("notified").alias("notified"))


@query
def evaluation_totals(s, d):
    return R.totals(R.evaluate(adapters.alerts(s, d), expected(s)))


# ---------------------------------------------------------------- reports and training data


@query
def port_filter(s, d):
    return adapters.packets(s, d).where(X.has_port(443)).select("pkt_no", "src", "dst")


@query
def confidence_text(s, d):
    return adapters.alerts(s, d).select("event_id", X.format_confidence().alias("text"))


@query
def pair_layers(s, d):
    a = adapters.alerts(s, d).withColumn("model_verdict", F.when(F.col("kind") == "anomaly", "anomaly"))
    return R.layers(a, ["src", "dst"])


@query
def day_chart(s, d):
    return R.day_chart(found(s, d))


@query
def hidden_incidents(s, d):
    return R.shown_and_hidden(found(s, d), 25)


@query
def kind_shares(s, d):
    return R.shares(adapters.alerts(s, d), "kind", "event_id").withColumn("share", F.round("share", 6))


# Captures that the evaluation takes as normal, and whether the model has seen the others.
NORMAL = (("cap4",), ("cap8",))
SEEN = (("cap0", True), ("cap1", True), ("cap2", False), ("cap3", False), ("cap9", False))


@query
def normal_captures(s, d):
    return R.normal_captures(adapters.alerts(s, d), s.createDataFrame(list(NORMAL), "capture string"))


@query
def evaluation_summary(s, d):
    a, e = adapters.alerts(s, d), expected(s)
    return R.summary(R.evaluate(a, e), R.wrong_kinds(a, e), s.createDataFrame(list(SEEN), "capture string, in_training boolean"))


@query
def predictions_by_source(s, d):
    return L.rule_verdict(flw(s, d)).groupBy("src", "verdict").agg(F.count("*").alias("flows"))


@query
def stealth_counts(s, d):
    return AN.stealth_counts(adapters.packets(s, d))


@query
def tracker_ports(s, d):
    return AN.tracker_ports(flows_once(s, d))


@query
def top_verdicts(s, d):
    return AN.top_verdicts(L.rule_verdict(flw(s, d)))


@query
def profile_votes(s, d):
    f = flows_once(s, d)
    nearest = AN.nearest_profile(f.where("src = '10.0.2.1'"), f.where("src <> '10.0.2.1'"), "src", PROFILE)
    first = L.rule_verdict(f).groupBy("src").agg(F.min_by("verdict", "flow_seq").alias("label"))
    return AN.profile_votes(nearest, first, "src")


@query
def loss_rates(s, d):
    """Alerts held back stand in for a capture's dropped packets."""
    counters = adapters.alerts(s, d).groupBy("capture").agg(F.count_if("notified").alias("received"), F.count_if(~F.col("notified")).alias("dropped"))
    return AN.loss(counters)


@query
def unknown_numbers(s, d):
    lines = lambda proto: AN.describe(adapters.packets(s, d).where(F.col("proto") == proto)).select(F.col("line").alias("value"))
    return AN.unknown_numbers(lines("UDP"), lines("TCP"))


@query
def training_flows(s, d):
    x = datasets.training_flows(adapters.packets(s, d))
    return x.select("flow_seq", "src", "dst", "destination_port", "total_fwd_packets", "total_bwd_packets", "fwd_bytes", "bwd_bytes", "syn_count", "ack_count", F.round("duration", 4).alias("duration"))


@query
def aligned_features(s, d):
    """Columns of a model that flows have, lack and hold nulls in."""
    f = flw(s, d).withColumn("is_ipv6", F.lit(0)).withColumn("first_flags", F.col("flags"))
    return datasets.aligned(datasets.without_metadata(f), ["flow_seq", "ctx_src_flows", "fwd_bytes", "first_flags", "is_ipv6"])


@query
def renamed_flows(s, d):
    """Flows under the names of a public table, with infinite and undefined rates, brought back."""
    f = flw(s, d)
    rate = F.when(F.col("duration") == 0, F.when(F.col("flow_seq") % 2 == 0, float("inf")).otherwise(float("nan"))).otherwise(F.col("packets").cast("double"))
    x = f.select("flow_seq", "proto", F.col("dport").alias("Destination Port"), F.col("fwd_bytes").alias("Total Length of Fwd Packets"), rate.alias("Flow Packets/s"))
    names = {k: v for k, v in K.FLOW_TABLE_NAMES.items() if k in x.columns}
    return datasets.renamed(x, names, keep=("flow_seq",))


@query
def schema_columns(s, d):
    """Label and features of a table that says nothing about itself, and how many values each has."""
    a = adapters.alerts(s, d)
    label = datasets.label_column(a)
    names = [label, *datasets.feature_columns(a, label)]
    counts = a.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "name", "values")
    return counts.select(F.when(F.col("name") == label, "label").otherwise("feature").alias("role"), "name", "values")


@query
def dashboard_cards(s, d):
    a = adapters.site_alerts(s, d)
    rows = kept(s, "cards", I.incidents(a.withColumnRenamed("event_id", "seq")).withColumn("seq", F.xxhash64("src", "kind", "first_us")))
    return R.cards(a, rows, I.campaigns(rows))


@query
def incident_marks(s, d):
    """Incidents by source and kind with the layer of their alerts and whether one of these carries a model's unsure verdict."""
    p = kept(s, "marks", win(s, d))
    labelled = L.campaigns(L.rule_verdict(FL.flows(p)))
    held = p.where("frag OR proto = 'TCP'").groupBy("capture", "window_us", F.col("src").alias("source"), F.col("dst").alias("destination")).agg(F.min("pkt_no").alias("seq"), F.bool_or("frag").alias("frag"))
    a = L.with_unsure(held.withColumn("confidence", F.lit(None).cast("double")), labelled)
    kind = F.when(F.col("frag"), "fragmented_scan").otherwise("stealth_scan")
    a = a.select(F.col("source").alias("src"), F.col("destination").alias("dst"), kind.alias("kind"), F.col("window_us").alias("t_us"), "confidence", "seq", F.col("model_unsure").isNotNull().alias("unsure"))
    return R.marked_incidents(I.incidents(a), a).select("src", "kind", "first_us", "alert_count", "layer", "unsure", "review")


@query
def soak_pairs(s, d):
    return R.soak_pairs(adapters.site_alerts(s, d))


@query
def kind_bars(s, d):
    return R.bars(R.type_counts(found(s, d)), "incidents")
