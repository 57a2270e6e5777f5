"""Bidirectional flows, their features, and per-source context.

Both are grouped by (capture, window, flow key): one exchange serves first packet, direction and all aggregates. A flow of one
window is bounded by what five seconds can carry; `scope=()` groups whole captures, as training data does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import base_flags, flow_key, flows_per_port

SCOPE = ("capture", "window_id")
FEATURES = (
    "total_fwd_packets", "total_bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std", "bwd_pkt_len_max", "bwd_pkt_len_mean",
    "pkt_len_mean", "pkt_len_std", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min", "duration", "flow_bytes_per_sec", "flow_packets_per_sec",
    "syn_count", "rst_count", "ack_count", "psh_count", "fin_count", "is_tcp",
)
CONTEXT = ("ctx_src_flows", "ctx_src_ports", "ctx_src_dsts", "ctx_flows_per_port", "ctx_dst_sources", "ctx_reply_rate")


def with_flows(packets: DataFrame) -> DataFrame:
    """packets that belong to a flow, with its key."""
    return packets.withColumn("flow", flow_key()).where(F.col("flow").isNotNull())


def flows(packets: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """A row a flow: scope, window_us, flow, flow_seq (first packet), the first packet's fields, the 25 features, destination_port
    and the facts that detectors ask for (replied, lone ACK probe, SYN without ACK, initiator's ACK, closed).

    The initiator is the sender of the first packet in capture order; features know it by address and port, detectors by
    address. Gaps between packets are taken over sorted times.
    """
    keys = [*scope, "flow"]
    w = Window.partitionBy(*keys)
    first = F.min_by(F.struct("src", "dst", "sport", "dport", "flags", "proto", "ip_version", "ts_us"), "pkt_no").over(w)
    x = with_flows(packets).withColumn("first", first).withColumn("gap", (F.col("ts_us") - F.lag("ts_us").over(w.orderBy("ts_us", "pkt_no"))) / 1e6)
    by_host, tcp = F.col("src") == F.col("first.src"), F.col("proto") == "TCP"
    fwd = by_host & (F.col("sport") == F.col("first.sport"))
    b = base_flags()
    on = lambda bit: F.coalesce(b.bitwiseAND(F.lit(bit)) != 0, F.lit(False))
    size = F.col("frame_len").cast("double")
    only = lambda c, cond: F.when(cond, c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    count = lambda cond: F.count(F.when(cond, 1))
    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    per_s = lambda total: F.when(span > 0, total / span).otherwise(0.0)
    odd_flags, odd_reply = on(K.ACK) & (b == K.ACK) & (F.col("payload_len") == 0), on(K.RST)
    v4_reply = (F.col("first.ip_version") == 4) & (F.col("ip_version") == 4) & ~fwd
    return x.groupBy(*keys).agg(
        F.first("first").alias("first"), F.min("pkt_no").alias("flow_seq"), F.count("*").alias("packets"), *([F.min("window_us").alias("window_us")] if "window_us" in packets.columns else []),
        count(fwd).alias("total_fwd_packets"), count(~fwd).alias("total_bwd_packets"), F.coalesce(F.sum(only(F.col("frame_len"), fwd)), F.lit(0)).alias("fwd_bytes"), F.coalesce(F.sum(only(F.col("frame_len"), ~fwd)), F.lit(0)).alias("bwd_bytes"),
        zero(F.max(only(size, fwd))).alias("fwd_pkt_len_max"), zero(F.min(only(size, fwd))).alias("fwd_pkt_len_min"), zero(F.avg(only(size, fwd))).alias("fwd_pkt_len_mean"), zero(F.stddev_samp(only(size, fwd))).alias("fwd_pkt_len_std"),
        zero(F.max(only(size, ~fwd))).alias("bwd_pkt_len_max"), zero(F.avg(only(size, ~fwd))).alias("bwd_pkt_len_mean"), zero(F.avg(size)).alias("pkt_len_mean"), zero(F.stddev_samp(size)).alias("pkt_len_std"),
        zero(F.avg("gap")).alias("flow_iat_mean"), zero(F.stddev_samp("gap")).alias("flow_iat_std"), zero(F.max("gap")).alias("flow_iat_max"), zero(F.min("gap")).alias("flow_iat_min"),
        F.round(span, 4).alias("duration"), per_s(F.sum(size)).alias("flow_bytes_per_sec"), per_s(F.count("*")).alias("flow_packets_per_sec"),
        count(on(K.SYN)).alias("syn_count"), count(on(K.RST)).alias("rst_count"), count(on(K.ACK)).alias("ack_count"), count(on(K.PSH)).alias("psh_count"), count(on(K.FIN)).alias("fin_count"),
        F.max(tcp.cast("int")).alias("is_tcp"), F.coalesce(F.bool_or(v4_reply), F.lit(False)).alias("replied"),
        F.coalesce(F.bool_and(F.when(tcp, F.when(by_host, odd_flags).otherwise(odd_reply))), F.lit(False)).alias("ack_probe"),
        (F.coalesce(F.bool_or(tcp & by_host & on(K.SYN)), F.lit(False)) & ~F.coalesce(F.bool_or(tcp & by_host & on(K.ACK)), F.lit(False))).alias("half_open"),
        F.coalesce(F.bool_or(by_host & on(K.ACK)), F.lit(False)).alias("initiator_ack"), F.coalesce(F.bool_or(on(K.FIN) | on(K.RST)), F.lit(False)).alias("closed"),
    ).select("*", "first.src", "first.dst", "first.sport", "first.dport", "first.flags", "first.proto", "first.ip_version", F.col("first.ts_us").alias("first_us"), F.col("first.dport").alias("destination_port")).drop("first")


def context(flow_rows: DataFrame, scope: tuple[str, ...] = SCOPE, ipv6_context: bool = False) -> DataFrame:
    """flow_rows with the six context features: per source and per destination over five-second cells from the scope's first flow.

    IPv6 ends count as one unknown host unless ipv6_context is set. Distinct counts are pre-aggregated; hot sources are rows of
    two equi-joins.
    """
    end = lambda c: F.col(c) if ipv6_context else F.when(F.col("ip_version") == 4, F.col(c)).otherwise("unknown")
    start = flow_rows.groupBy(*scope).agg(F.min("first_us").alias("t0"))
    x = flow_rows.join(start, list(scope)).withColumn("cell", F.floor((F.col("first_us") - F.col("t0")) / K.CONTEXT_WINDOW_US)).withColumn("c_src", end("src")).withColumn("c_dst", end("dst"))
    x = x.withColumn("c_port", F.when(F.col("proto").isin("TCP", "UDP"), F.col("dport")).otherwise(0))
    by_src = x.groupBy(*scope, "cell", "c_src").agg(F.count("*").alias("ctx_src_flows"), F.countDistinct("c_port").alias("ctx_src_ports"), F.countDistinct("c_dst").alias("ctx_src_dsts"), F.avg(F.col("replied").cast("int")).alias("ctx_reply_rate"))
    by_dst = x.groupBy(*scope, "cell", "c_dst").agg(F.countDistinct("c_src").alias("ctx_dst_sources"))
    out = x.join(by_src, [*scope, "cell", "c_src"]).join(by_dst, [*scope, "cell", "c_dst"])
    return out.withColumn("ctx_flows_per_port", flows_per_port("ctx_src_flows", "ctx_src_ports")).drop("cell", "c_src", "c_dst", "c_port", "t0")


def feature_set(name: str, base: tuple[str, ...] = ("destination_port", *FEATURES)) -> list[str]:
    """Feature names of set A (base), B (base and context), C (B without what padding or direction gives away), D (C, is_tcp kept last)."""
    risky = lambda f: f in ("destination_port", "total_bwd_packets", "rst_count", "ack_count") or f.startswith("bwd_")
    kept = [f for f in base if not risky(f)]
    sets = {"A": list(base), "B": [*base, *CONTEXT], "C": [*kept, *CONTEXT], "D": [*[f for f in kept if f != "is_tcp"], *CONTEXT, "is_tcp"]}
    if name not in sets:
        raise ValueError(f"no feature set {name}")
    return sets[name]


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """df's named features in order; a missing one is an error."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing features: {missing}")
    return df.select(*names)


