"""Campaign labels of a window's attack flows, and the suppressions before an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import campaign_label, mean_3

WIN = ("capture", "window_id", "window_us")


def rule_verdict(flows: DataFrame) -> DataFrame:
    """Stands in for the classifier: a verdict by rule, a confidence from the flow's number, no anomalies."""
    syn_only = (F.col("syn_count") > 0) & (F.col("ack_count") == 0)
    verdict = F.when(F.col("proto") == "UDP", F.when(F.col("replied"), "normal").otherwise("udp_scan")).when(syn_only & (F.col("dport") == 80), "syn_flood").when(syn_only, "scan").when((F.col("ack_count") > 0) & (F.col("dport") == 80), "dos").otherwise("normal")
    return flows.where("proto <> 'ICMP'").withColumn("verdict", verdict).withColumn("confidence", F.lit(0.5) + (F.col("flow_seq") % 50) / 100.0).withColumn("is_anomaly", (F.col("verdict") == "normal") & (F.col("flow_seq") % 7 == 0))


def campaigns(scored: DataFrame) -> DataFrame:
    """Attack flows per (window, source, destination): the most frequent verdict (ties: the first seen), flows, ports, confidence.

    scored: flows with verdict, confidence, is_anomaly. A flow is an attack if its verdict isn't normal or it is an anomaly; only
    classifier verdicts have confidence.
    """
    keys = [*WIN, "src", "dst"]
    x = scored.where((F.col("verdict") != "normal") | F.col("is_anomaly")).withColumn("reason", F.when(F.col("verdict") != "normal", F.col("verdict")).otherwise("anomaly"))
    x = x.withColumn("c", F.when(F.col("verdict") != "normal", F.col("confidence")))
    whole = x.groupBy(*keys).agg(F.count("*").alias("num_flows"), F.countDistinct("dport").alias("num_ports"), mean_3("c").alias("confidence"), F.min("flow_seq").alias("first_seq"))
    votes = x.groupBy(*keys, "reason").agg(F.count("*").alias("n"), F.min("flow_seq").alias("seq"))
    top = votes.groupBy(*keys).agg(F.max_by("reason", F.struct(F.col("n"), -F.col("seq"))).alias("verdict"))
    return whole.join(top, keys).withColumn("kind", campaign_label())


def without_evaded(labelled: DataFrame, evasion_sources: DataFrame) -> DataFrame:
    """labelled without udp_scan rows of sources that scanned by malformed flags or ACKs in the same window."""
    udp = labelled.where("kind = 'udp_scan'").join(evasion_sources.select("capture", "window_id", "src").distinct(), ["capture", "window_id", "src"], "left_anti")
    return udp.select(*labelled.columns).union(labelled.where("kind IS NULL OR kind <> 'udp_scan'"))


def unsure(c: str = "confidence") -> Column:
    return F.coalesce(F.col(c) < K.MODEL_CONFIDENCE, F.lit(False))


def sure_only(labelled: DataFrame) -> DataFrame:
    """Labelled groups that become alerts."""
    return labelled.where(F.col("kind").isNotNull() & ~unsure())


def with_unsure(alerts: DataFrame, labelled: DataFrame) -> DataFrame:
    """alerts (capture, source, destination, window_us, confidence) with model_unsure, the latest unsure verdict on the same pair up
    to the alert's window, where the alert has no confidence of its own."""
    notes = labelled.where(F.col("kind").isNotNull() & unsure()).select("capture", F.col("src").alias("source"), F.col("dst").alias("destination"), "window_us", F.struct("verdict", "confidence").alias("note"))
    w = Window.partitionBy("capture", "source", "destination").orderBy("window_us", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = alerts.withColumn("side", F.lit(1)).unionByName(notes.withColumn("side", F.lit(0)), allowMissingColumns=True)
    out = both.withColumn("held", F.last("note", ignorenulls=True).over(w)).where("side = 1")
    return out.withColumn("model_unsure", F.when(F.col("confidence").isNull(), F.col("held"))).drop("side", "note", "held")
