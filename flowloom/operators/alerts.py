"""One relation of all alerts of a capture, in the order in which the policy sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import one_or_multiple
from . import detectors as D
from . import labels as L

COLUMNS = ("capture", "window_id", "window_us", "stage", "idx", "kind", "source", "destination", "num_flows", "num_ports", "model_verdict", "confidence", "description")


def _alert(rows: DataFrame, stage: int, kind: str | Column, source: str | Column, destination: str | Column, flows: str, ports: str | Column, idx: Column, text: Column, verdict: Column | None = None, confidence: Column | None = None) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None)
    values = (F.lit(stage), idx.cast("string"), kind, c(source), c(destination), F.col(flows).cast("long"), c(ports).cast("long"), (none if verdict is None else verdict).cast("string"), (none if confidence is None else confidence).cast("double"), text)
    return rows.select("capture", "window_id", "window_us", *[v.alias(n) for v, n in zip(values, COLUMNS[3:])])


def unified(packets: DataFrame, flows: DataFrame, campaigns: DataFrame) -> DataFrame:
    """All detectors' alerts, over kept tables of packets, flows and labels.campaigns. stage and idx give the emission order within a window; idx sorts as text."""
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    num = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    frag, icmp, stealth, ack, syn = D.fragment_episodes(packets), D.icmp_flood(packets), D.stealth_scan(packets), D.ack_scan(flows), D.syn_flood(flows)
    evaded = stealth.select("capture", "window_id", "src").union(ack.select("capture", "window_id", "src"))
    labelled = L.sure_only(L.without_evaded(campaigns, evaded))
    parts = [
        _alert(frag, 0, "fragmented_scan", "src", "dst", "fragments", F.lit(0), F.concat("src", "dst"), say("FRAGMENTED SCAN (", F.col("fragments"), " fragments - evasion attempt)")),
        _alert(icmp, 1, "icmp_flood", "src", "dst", "packets", F.lit(0), F.concat("src", "dst"), say("ICMP FLOOD (", F.col("packets"), " packets)")),
        _alert(stealth, 2, "stealth_scan", "src", one_or_multiple(F.col("dsts")), "packets", "ports", F.col("src"), say("STEALTH SCAN (", F.array_join("types", ","), ", ", F.col("packets"), " packets, ", F.col("ports"), " ports)")),
        _alert(ack, 3, "ack_scan", "src", one_or_multiple(F.col("dsts")), "probes", "ports", F.col("src"), say("ACK SCAN (", F.col("probes"), " lone ACK probes, ", F.col("ports"), " ports - firewall mapping)")),
        _alert(syn, 4, "syn_flood", "src", "dst", "half_open", F.lit(1), F.concat("src", "dst"), say("SYN FLOOD (", F.col("half_open"), " half-open)")),
        _alert(D.slow_scan(flows), 5, "slow_scan", "src", "dst", "ports_seen", "ports_seen", F.concat(num("flow_seq"), F.lit("a")), say("SLOW PORT SCAN (", F.col("ports_seen"), " ports over time)")),
        _alert(D.distributed_scan(flows), 5, "distributed_scan", F.lit("multiple"), "dst", "ports_seen", "ports_seen", F.concat(num("flow_seq"), F.lit("b")), say("DISTRIBUTED SCAN (", F.col("ports_seen"), " ports on target)")),
        _alert(labelled, 6, F.col("kind"), "src", "dst", "num_flows", "num_ports", num("first_seq"), say("CAMPAIGN (", F.col("verdict"), ", ", F.col("num_flows"), " flows, ", F.col("num_ports"), " ports)"), F.col("verdict"), F.col("confidence")),
        _alert(D.slowloris(flows), 7, "slowloris", "host_a", "host_b", "connections", F.lit(1), F.concat("host_a", "host_b", F.lpad(F.col("port").cast("string"), 5, "0")), say("SLOWLORIS (", F.col("persistent"), " connections held open on port ", F.col("port"), ")")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
