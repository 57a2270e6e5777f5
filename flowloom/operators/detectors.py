"""Detectors: packets or flows of a window in, rows at or above a threshold out; then those with memory across windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import is_scan_probe, slowloris_triple, stealth_type
from ..workspace import Workspace

WIN = ("capture", "window_id", "window_us")


def fragment_flood(packets: DataFrame) -> DataFrame:
    return packets.where("frag AND ip_version = 4").groupBy(*WIN, "src", "dst").count().where(F.col("count") >= K.FRAGMENT_FLOOD).withColumnRenamed("count", "fragments")


def icmp_flood(packets: DataFrame) -> DataFrame:
    return packets.where("proto = 'ICMP' AND ip_version = 4").groupBy(*WIN, "src", "dst").count().where(F.col("count") >= K.ICMP_FLOOD).withColumnRenamed("count", "packets")


def stealth_scan(packets: DataFrame) -> DataFrame:
    """Sources of malformed flag combinations; dsts and types sorted."""
    x = packets.where("proto = 'TCP'").withColumn("scan_type", stealth_type()).where("scan_type IS NOT NULL")
    out = x.groupBy(*WIN, "src").agg(F.count("*").alias("packets"), F.countDistinct("dport").alias("ports"), F.array_sort(F.collect_set("dst")).alias("dsts"), F.array_sort(F.collect_set("scan_type")).alias("types"))
    return out.where((F.col("packets") >= K.STEALTH_PACKETS) & (F.col("ports") >= K.STEALTH_PORTS))


def ack_scan(flows: DataFrame) -> DataFrame:
    x = flows.where("proto = 'TCP' AND ack_probe").groupBy(*WIN, "src").agg(F.count("*").alias("probes"), F.countDistinct("dport").alias("ports"), F.array_sort(F.collect_set("dst")).alias("dsts"))
    return x.where(F.col("ports") >= K.ACK_SCAN_PORTS)


def syn_flood(flows: DataFrame) -> DataFrame:
    x = flows.where("half_open").groupBy(*WIN, "src", "dst").agg(F.count("*").alias("half_open"), F.countDistinct("dport").alias("ports"))
    return x.where((F.col("half_open") >= K.SYN_FLOOD_HALF_OPEN) & (F.col("ports") <= K.SYN_FLOOD_PORTS))


def held_open(flows: DataFrame) -> DataFrame:
    """Per window and (host, host, server port): the connections that were acknowledged, are short and not closed."""
    x = flows.where(f"proto = 'TCP' AND packets <= {K.SLOWLORIS_PACKETS} AND initiator_ack AND NOT closed").withColumn("t", slowloris_triple())
    return x.groupBy(*WIN, "t").agg(F.collect_set("flow").alias("conns")).select(*WIN, "t.*", "conns")


def slow_connections(flows: DataFrame) -> DataFrame:
    """The older count of short TCP flows a triple, with at least as many as a slowloris needs."""
    x = flows.where(f"proto = 'TCP' AND ip_version = 4 AND packets <= {K.SLOWLORIS_PACKETS}").withColumn("t", slowloris_triple())
    return x.groupBy(*WIN, "t").count().where(F.col("count") >= K.SLOWLORIS_CONNECTIONS).select(*WIN, "t.*", F.col("count").alias("connections"))


# ---------------------------------------------------------------- memory across windows


def episodes(rows: DataFrame, keys: list[str], time: str = "window_us", gap_us: int = K.EPISODE_GAP_US) -> DataFrame:
    """rows with starts (first of its episode: more than gap_us after the key's row before) and episode (its number)."""
    w = Window.partitionBy(*keys).orderBy(time)
    prev = F.lag(time).over(w)
    return rows.withColumn("starts", prev.isNull() | (F.col(time) - prev > gap_us)).withColumn("episode", F.sum(F.col("starts").cast("long")).over(w))


def fragment_episodes(packets: DataFrame) -> DataFrame:
    return episodes(fragment_flood(packets), ["capture", "src", "dst"]).where("starts").drop("starts")


def slowloris(flows: DataFrame) -> DataFrame:
    """Triples whose connections persist: alert where the third such window of an episode comes.

    Persistent are the connections that the triple's last present window had too, however long ago that was.
    """
    key = ["capture", "host_a", "host_b", "port"]
    x = held_open(flows).withColumn("before", F.lag("conns").over(Window.partitionBy(*key).orderBy("window_us")))
    x = x.withColumn("persistent", F.size(F.array_intersect("conns", F.coalesce("before", F.slice("conns", 1, 0))))).withColumn("connections", F.size("conns"))
    hot = x.where((F.col("connections") >= K.SLOWLORIS_CONNECTIONS) & (F.col("persistent") >= K.SLOWLORIS_PERSISTENT)).drop("conns", "before")
    n = F.row_number().over(Window.partitionBy(*key, "episode").orderBy("window_us"))
    return episodes(hot, key).withColumn("n", n).where(F.col("n") == K.SLOWLORIS_WINDOWS).select(*WIN, "host_a", "host_b", "port", "connections", "persistent", "episode")


def scan_edges(probes: DataFrame, keys: list[str], distinct: int, order: str = "flow_seq", history_us: int = K.SCAN_HISTORY_US) -> DataFrame:
    """Checks at which a key's distinct ports of the last history_us reach `distinct` anew (probes: keys, window_us, port, order).

    Every probe is a check in order. What counts at a check: ports of the key's earlier windows within the history, and
    those seen so far in its own window. Probes with a null key are left out; a null port is a check that adds nothing.

    A window's count only grows, so it crosses at most once: at its first probe, as other ports have been remembered since the window
    before, or at its k-th new port. Probes are reduced to the first of each port of a window before they are shuffled. How long a
    port is remembered follows from its own next sight, by (key, port); how many are, from adding these up along the key's windows,
    a row a window. So no task orders the probes of a busy target or holds its ports.
    """
    others = [c for c in probes.columns if c not in {*keys, "window_us", "port", order}]
    spot = [*keys, "window_us"]
    x = probes.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*spot, "port").agg(F.min(F.struct(order, *others)).alias("first"))
    own = Window.partitionBy(*keys, "port").orderBy("window_us")
    since, until = F.col("window_us") - F.lag("window_us").over(own), F.lead("window_us").over(own) - F.col("window_us")
    counts = F.col("port").isNotNull()
    x = x.withColumn("new", counts & F.coalesce(since >= history_us, F.lit(True))).withColumn("last", counts & F.coalesce(until >= history_us, F.lit(True)))
    x = Workspace(probes.sparkSession, "scan").keep(x, "sights")

    windows = x.groupBy(*spot).agg(F.sum(F.col("new").cast("int")).alias("n"), F.min(F.struct("first", "port", "new")).alias("head"))
    gone = x.where("last").groupBy(*keys, (F.col("window_us") + history_us).alias("window_us")).agg(F.count("*").alias("e"))
    line = windows.select(*spot, "n", F.lit(0).cast("long").alias("e"), "head").unionByName(gone, allowMissingColumns=True)
    line = line.groupBy(*spot).agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.first("head", ignorenulls=True).alias("head"))
    along = Window.partitionBy(*keys).orderBy("window_us")
    known = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("e").over(along)
    line = line.withColumn("known", known.cast("int")).where("head IS NOT NULL").withColumn("full", (F.col("known") + F.col("n")).cast("int"))
    line = line.withColumn("before", F.coalesce(F.lag("full").over(along), F.lit(0))).withColumn("at_first", F.expr("known + IF(head.new, 1, 0)"))

    out = [*(c for c in probes.columns if c != "port"), "port", "ports_seen"]
    laid = lambda df: df.select(*spot, f"first.{order}", *(f"first.{c}" for c in others), "port", "ports_seen").select(*out)
    first = line.where((F.col("at_first") >= distinct) & (F.col("before") < distinct)).select(*spot, "head.first", "head.port", F.col("at_first").alias("ports_seen"))
    later = line.where((F.col("at_first") < distinct) & (F.col("full") >= distinct)).select(*spot, (F.lit(distinct) - F.col("known")).alias("_nth"))
    # At most `distinct` rows of a window are ranked; Spark keeps to that before the shuffle.
    ranked = x.where("new").withColumn("_rank", F.row_number().over(Window.partitionBy(*spot).orderBy("first"))).where(F.col("_rank") <= distinct)
    nth = ranked.join(later, spot).where("_rank = _nth").select(*spot, "first", "port", F.lit(distinct).alias("ports_seen"))
    return laid(first).unionByName(laid(nth))


def scan_probes(flows: DataFrame) -> DataFrame:
    return flows.where((F.col("proto") != "ICMP") & is_scan_probe()).select(*WIN, "src", "dst", F.col("dport").alias("port"), "flow_seq")


def slow_scan(flows: DataFrame) -> DataFrame:
    return scan_edges(scan_probes(flows), ["capture", "src", "dst"], K.SLOW_SCAN_DISTINCT)


def distributed_scan(flows: DataFrame) -> DataFrame:
    return scan_edges(scan_probes(flows), ["capture", "dst"], K.DEST_SCAN_DISTINCT)


def profile(packets: DataFrame) -> DataFrame:
    """Connection attempts (SYN without ACK) a source and window: attempts, ports, destinations, and what they look like."""
    hint = F.when(F.col("ports") == 1, K.HINT_ONE_PORT).when(F.col("attempts") / F.col("ports") <= K.SCAN_RATIO, K.HINT_SCAN).otherwise(K.HINT_MIXED)
    return attempts(packets).groupBy("capture", "window_id", "src").agg(F.count("*").alias("attempts"), F.countDistinct("dport").alias("ports"), F.countDistinct("dst").alias("dsts")).where("attempts >= 5").withColumn("hint", hint)


def attempts(packets: DataFrame) -> DataFrame:
    return packets.where(f"ip_version = 4 AND proto = 'TCP' AND (flags & {K.SYN}) <> 0 AND (flags & {K.ACK}) = 0")


def multi_source(packets: DataFrame, least: int = 3) -> DataFrame:
    return attempts(packets).groupBy("capture", "window_id", "dst").agg(F.countDistinct("src").alias("sources"), F.count("*").alias("attempts")).where(F.col("sources") >= least)


def longest_pause(rows: DataFrame, keys: list[str], time: str = "window_us") -> DataFrame:
    """Active windows, span and longest pause of a key, in microseconds."""
    x = rows.withColumn("pause", F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))
    return x.groupBy(*keys).agg(F.count("*").alias("active"), (F.max(time) - F.min(time)).alias("span_us"), F.coalesce(F.max("pause"), F.lit(0)).alias("longest_pause_us"))

