"""Column expressions of packets, flows, alerts and incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def has_bit(flags: Column | str, bit: int) -> Column:
    return F.coalesce((F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def base_flags(flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(F.lit(K.BASE_FLAGS))


def flow_key() -> Column:
    """Both ends in order (by address, then port), and the protocol; null without an address or a known protocol."""
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    key = F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("proto").alias("proto"))
    return F.when(F.col("src").isNotNull() & F.col("proto").isin("TCP", "UDP", "ICMP"), key)


def stealth_type(flags: str = "flags") -> Column:
    """NULL, FIN, XMAS or SYN-FIN; null for any other flags."""
    b = base_flags(flags)
    both = K.SYN | K.FIN
    return F.when(b == 0, "NULL").when(b == K.FIN, "FIN").when(b == (K.FIN | K.PSH | K.URG), "XMAS").when(b.bitwiseAND(F.lit(both)) == both, "SYN-FIN")


def is_scan_probe(flags: str = "flags") -> Column:
    return F.col(flags).isNull() | (F.col(flags).bitwiseAND(F.lit(K.ACK)) == 0)


def slowloris_triple() -> Column:
    return F.struct(F.least("src", "dst").alias("host_a"), F.greatest("src", "dst").alias("host_b"), F.least("sport", "dport").alias("port"))


def one_or_multiple(values: Column) -> Column:
    return F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise("multiple")


def flows_per_port(flows: str, ports: str) -> Column:
    return F.when(F.col(ports) == 0, 0.0).otherwise(F.col(flows) / F.col(ports))


def campaign_label(verdict: str = "verdict", flows: str = "num_flows", ports: str = "num_ports") -> Column:
    """Kind of a (source, destination) group of attack flows; null where nothing is worth an alert. The order of rules counts."""
    v, n, p, ratio = F.col(verdict), F.col(flows), F.col(ports), flows_per_port(flows, ports)
    few, many, some = p <= K.LABEL_FEW_PORTS, n > K.LABEL_ATTACK_FLOWS, n >= K.LABEL_SUSPICIOUS
    return (
        F.when((v == "anomaly") & some, "anomaly")
        .when((v == "udp_scan") & some, "udp_scan")
        .when((v == "syn_flood") & many & few, "syn_flood")
        .when((v == "dos") & many & (few | (ratio >= K.LABEL_FLOOD_RATIO)), "dos")
        .when((v == "scan") & some & (ratio <= K.LABEL_SCAN_RATIO), "port_scan")
        .when(p >= K.LABEL_SCAN_PORTS, "port_scan")
        .when(many & few, "brute_force")
        .when(some, "suspicious")
    )


def family(kind: str = "kind") -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in K.FAMILY.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.col(kind)), F.col(kind))


def specificity(kind: str = "kind") -> Column:
    return F.when(F.col(kind).isin(*K.GENERIC), 1).otherwise(2)


def has_any(text: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def severity(kind: Column, count: Column) -> Column:
    return (
        F.when(has_any(kind, K.HIGH_IMPACT), "HIGH")
        .when(has_any(kind, K.EVASION), "MEDIUM")
        .when(F.contains(kind, F.lit("brute")), F.when(count >= K.BRUTE_HIGH, "HIGH").otherwise("MEDIUM"))
        .when(F.contains(kind, F.lit("scan")), F.when(count >= K.SCAN_MEDIUM, "MEDIUM").otherwise("LOW"))
        .when(count >= K.OTHER_MEDIUM, "MEDIUM")
        .otherwise("LOW")
    )


def incident_gap_us(kind: Column) -> Column:
    """Kinds that name "slow" (slowloris among them) stay open longer."""
    return F.when(F.contains(kind, F.lit("slow")), K.SLOW_INCIDENT_GAP_US).otherwise(K.INCIDENT_GAP_US)


def is_low_confidence(c: str = "confidence") -> Column:
    return F.coalesce(F.col(c) < K.LOW_CONFIDENCE, F.lit(False))


def rank(severity: str = "severity") -> Column:
    return F.when(F.col(severity) == "HIGH", 3).when(F.col(severity) == "MEDIUM", 2).otherwise(1)


def real_values(values: Column) -> Column:
    return F.filter(values, lambda x: ~x.isin(*K.PLACEHOLDERS))


def first_key(m: Column, keys) -> Column:
    """Value of the first key that is present, even if that value is null."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(m, k), F.element_at(m, k)).otherwise(out)
    return out


def parse_seconds(x: Column) -> Column:
    """Epoch seconds of a number, a numeric text or an ISO time (without a zone: the session's); 0.0 for anything else."""
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.unix_micros(F.try_to_timestamp(x)) / 1e6)
    return F.coalesce(F.when(x.rlike(r"^\s*[+-]?(\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?\s*$"), x.try_cast("double")), iso, F.lit(0.0))


def format_time(seconds: Column) -> Column:
    return F.when(seconds == 0, "-").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))


def day_of(seconds: Column) -> Column:
    return F.when(seconds == 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def format_duration(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))


def format_counts(counts: Column) -> Column:
    """A map of kinds and counts as "kind xN", by kind."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e.key, F.lit(" x"), e.value.cast("string"))), ", ")


def percent_of(value: Column, most: Column) -> Column:
    return F.when(most == 0, 0).otherwise(F.floor(value * 100 / most)).cast("long")


def clean_number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def loss_percent(received: Column, dropped: Column) -> Column:
    return F.when(received + dropped == 0, 0.0).otherwise(F.round(100.0 * dropped / (received + dropped), 2))


def layer(verdict: str = "model_verdict", confidence: str = "confidence") -> Column:
    return F.when(F.col(verdict) == "anomaly", "anomaly").when(F.col(confidence).isNull(), "tracker").otherwise("model")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mean(c: Column | str) -> Column:
    """An aggregate: the mean of a column, summed in whole millionths, so that it doesn't depend on the order of its rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.round(c * 1e6).cast("long")) / F.count(c) / 1e6


def mean_3(c: Column | str) -> Column:
    """As mean, rounded to thousandths."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(F.round(c * 1e6).cast("long")) / F.count(c) / 1000.0) / 1000.0


def is_finite(c: str) -> Column:
    """Neither null nor NaN nor infinite."""
    x = F.col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def has_port(port: int) -> Column:
    """A TCP or UDP packet with this port on either side."""
    return F.coalesce(F.col("proto").isin("TCP", "UDP") & ((F.col("sport") == port) | (F.col("dport") == port)), F.lit(False))


def format_confidence(c: str = "confidence") -> Column:
    """Confidence in a fixed width, marked where it is low."""
    text = F.format_string("conf=%.2f", F.col(c))
    return F.when(F.col(c).isNull(), "conf=  -   ").otherwise(F.concat(text, F.when(is_low_confidence(c), " LOW").otherwise("    ")))


def short_name(c: str, suffix: str = ".pcap") -> Column:
    return F.replace(F.col(c), F.lit(suffix), F.lit(""))


def one_or_mixed(layers: Column) -> Column:
    """The layer that a set of alerts comes from, "mixed" for several."""
    return F.when(F.size(layers) == 1, F.element_at(layers, 1)).otherwise("mixed")
