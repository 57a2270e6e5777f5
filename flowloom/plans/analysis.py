"""Checks and comparisons around the detectors: profiles, payloads, directions, sessions, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import is_scan_probe, loss_percent, mean_3, stealth_type
from ..operators import flows as FL
from ..operators.quantiles import quantiles


def medians(rows: DataFrame, by: str, features: list[str]) -> DataFrame:
    """(by, feature, median), exact."""
    return quantiles(rows, [by], features, [0.5]).select(by, "feature", F.col("value").alias("median"))


def nearest_profile(target: DataFrame, known: DataFrame, by: str, features: list[str]) -> DataFrame:
    """For each feature the known group whose median is nearest to the target's, and whether the target's lies outside all."""
    t = quantiles(target, [], features, [0.5]).select("feature", F.col("value").alias("target"))
    k = medians(known, by, features)
    gap = F.abs(F.col("median") - F.col("target"))
    x = k.join(F.broadcast(t), "feature")  # a row a feature
    return x.groupBy("feature", "target").agg(F.min_by(by, F.struct(gap, F.col(by))).alias("nearest"), ((F.first("target") < F.min("median")) | (F.first("target") > F.max("median"))).alias("outside"))


def payload_stats(packets: DataFrame) -> DataFrame:
    return packets.where("proto = 'TCP'").groupBy("src").agg(F.count("*").alias("packets"), F.min("payload_len").alias("payload_min"), F.max("payload_len").alias("payload_max"), F.count_if(F.col("payload_len") > 0).alias("with_payload"))


def direction_check(packets: DataFrame) -> DataFrame:
    """Packets of flows by where they come from: real replies (other address), replies as counted (other address or port), same-address flows."""
    x = FL.with_flows(packets).withColumn("first", F.min_by(F.struct("src", "sport"), "pkt_no").over(Window.partitionBy("capture", "flow")))
    other = F.col("src") != F.col("first.src")
    return x.agg(F.count("*").alias("packets"), F.count_if(other).alias("real_replies"), F.count_if(other | (F.col("sport") != F.col("first.sport"))).alias("counted_replies"), F.count_if(F.col("src") == F.col("dst")).alias("same_address"))


def probe_ports(packets: DataFrame) -> DataFrame:
    """Per window and pair the distinct ports of all first flags and of those without ACK, and how many lie in the ephemeral range."""
    x = packets.where("proto = 'TCP'")
    clear = (F.col("flags").bitwiseAND(F.lit(K.ACK)) == 0)
    return x.groupBy("capture", "window_id", "src", "dst").agg(F.countDistinct("dport").alias("ports"), F.countDistinct(F.when(clear, F.col("dport"))).alias("probe_ports"), F.countDistinct(F.when(F.col("dport") >= 32768, F.col("dport"))).alias("ephemeral"))


def session(packets: DataFrame) -> DataFrame:
    """start, last and number of packets and windows of a run."""
    return packets.agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("packets"), F.countDistinct("capture", "window_id").alias("windows"))


def session_hours(start: Column, end: Column, last: Column) -> Column:
    """Hours from start to end, or to the last update of a run that didn't end; null for none."""
    hours = (F.coalesce(end, last) - start) / (3600 * K.SECOND_US)
    return F.when(hours > 0, hours)


def loss(counters: DataFrame) -> DataFrame:
    return counters.withColumn("loss_percent", loss_percent(F.col("received"), F.col("dropped")))


def unknown_numbers(text: DataFrame, known: DataFrame) -> DataFrame:
    """Numbers in lines (value) of one document that another's lines don't have."""
    of = lambda df: df.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1))).alias("number")).distinct()
    return of(text).join(of(known), "number", "left_anti")


def describe(packets: DataFrame) -> DataFrame:
    """A line a packet."""
    ends = F.concat(F.col("src"), F.when(F.col("sport").isNotNull(), F.concat(F.lit(":"), F.col("sport").cast("string"))).otherwise(""), F.lit(" -> "), F.col("dst"), F.when(F.col("dport").isNotNull(), F.concat(F.lit(":"), F.col("dport").cast("string"))).otherwise(""))
    return packets.select("pkt_no", F.concat(F.coalesce("proto", F.lit("other")), F.lit(" "), ends, F.lit(" "), F.col("frame_len").cast("string"), F.lit(" bytes")).alias("line"))


def profile_votes(nearest: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """Votes of nearest_profile()'s features for the labels (by, label) of their nearest groups, and features outside all groups."""
    x = labels.withColumnRenamed(by, "nearest").join(F.broadcast(nearest), "nearest")  # nearest: a row a feature
    return x.groupBy("label").agg(F.count("*").alias("votes"), F.count_if("outside").alias("outside"))


def stealth_counts(packets: DataFrame) -> DataFrame:
    """Packets of malformed flags by their type and by their source (side, name, packets)."""
    x = packets.where("proto = 'TCP'").withColumn("scan_type", stealth_type()).where("scan_type IS NOT NULL")
    return x.select(F.explode(F.array(F.struct(F.lit("type").alias("side"), F.col("scan_type").alias("name")), F.struct(F.lit("source").alias("side"), F.col("src").alias("name")))).alias("x")).groupBy("x.side", "x.name").agg(F.count("*").alias("packets"))


def tracker_ports(flows: DataFrame) -> DataFrame:
    """What scan trackers see of flows' first packets: counts with and without ACK (and of those to ephemeral ports), and the most
    distinct ports of a pair and of a target, over all flows and over probes alone."""
    x = flows.where("proto <> 'ICMP'").withColumn("probe", is_scan_probe())
    tcp, far = F.col("proto") == "TCP", F.col("dport") >= K.EPHEMERAL_PORT
    counts = x.agg(
        F.count_if(tcp & ~F.col("probe")).alias("ack_first"), F.count_if(tcp & ~F.col("probe") & far).alias("ack_ephemeral"),
        F.count_if(tcp & F.col("probe")).alias("probe_first"), F.count_if(tcp & F.col("probe") & far).alias("probe_ephemeral"), F.count_if(F.col("proto") == "UDP").alias("udp_flows"),
    )
    ports = x.groupBy("src", "dst", "dport").agg(F.bool_or("probe").alias("probe"))
    most = lambda keys, n: ports.groupBy(*keys).agg(F.countDistinct("dport").alias("a"), F.countDistinct(F.when(F.col("probe"), F.col("dport"))).alias("b")).agg(F.coalesce(F.max("a"), F.lit(0)).alias(f"{n}_all"), F.coalesce(F.max("b"), F.lit(0)).alias(f"{n}_probes"))
    return counts.crossJoin(most(["src", "dst"], "pair")).crossJoin(most(["dst"], "target"))  # one row each


def top_verdicts(scored: DataFrame, n: int = 3) -> DataFrame:
    """The commonest verdicts, with their flows and mean confidence."""
    return scored.groupBy("verdict").agg(F.count("*").alias("flows"), mean_3("confidence").alias("confidence")).orderBy(F.desc("flows"), "verdict").limit(n)


def margin(windows: int, seconds: float) -> float:
    """Traffic time over processing time."""
    return windows * K.WINDOW_US / K.SECOND_US / seconds if seconds else float("inf")
