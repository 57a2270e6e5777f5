"""The detectors on Structured Streaming: windowed aggregates under a watermark, and keyed state for scans and the policy.

Batch and stream share expressions and automata; a stream's windows lie on a fixed grid of event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..functions.exprs import is_scan_probe, stealth_type
from ..operators import policy as P

LATE = "10 seconds"


def with_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", LATE)


def pair_floods(packets: DataFrame) -> DataFrame:
    """Fragment and ICMP floods a (source, destination) and window."""
    x = with_time(packets).where("frag OR proto = 'ICMP'")
    n = x.groupBy(F.window("ts", "5 seconds"), "capture", "src", "dst").agg(F.count_if("frag").alias("fragments"), F.count_if(F.col("proto") == "ICMP").alias("icmp"))
    return n.where((F.col("fragments") >= K.FRAGMENT_FLOOD) | (F.col("icmp") >= K.ICMP_FLOOD)).select(F.col("window.start").alias("window_start"), "capture", "src", "dst", "fragments", "icmp")


def stealth(packets: DataFrame) -> DataFrame:
    """Stealth scans a source and window; distinct ports and targets are sets, as a stream has no countDistinct."""
    x = with_time(packets).where("proto = 'TCP'").withColumn("scan_type", stealth_type()).where("scan_type IS NOT NULL")
    n = x.groupBy(F.window("ts", "5 seconds"), "capture", "src").agg(F.count("*").alias("packets"), F.size(F.collect_set("dport")).alias("ports"), F.array_sort(F.collect_set("scan_type")).alias("types"))
    return n.where((F.col("packets") >= K.STEALTH_PACKETS) & (F.col("ports") >= K.STEALTH_PORTS)).select(F.col("window.start").alias("window_start"), "capture", "src", "packets", "ports", "types")


SCAN_OUT = "capture string, src string, dst string, ts_us long, ports_seen long"
SCAN_STATE = "times array<long>, ports array<int>, over boolean"


def _scan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Last time of each port within the history, and whether the pair is over the threshold."""
    if state.hasTimedOut:
        state.remove()
        return
    times, ports, over = state.get if state.exists else ([], [], False)
    seen = dict(zip(list(ports), list(times)))
    rows = pd.concat(list(frames)).sort_values(["ts_us", "pkt_no"])
    out = []
    for t, port in zip(rows["ts_us"], rows["dport"]):
        seen[int(port)] = max(int(t), seen.get(int(port), 0))
        seen = {p: at for p, at in seen.items() if at > t - K.SCAN_HISTORY_US} if len(seen) >= K.SLOW_SCAN_DISTINCT else seen
        now = len(seen) >= K.SLOW_SCAN_DISTINCT
        if now and not over:
            out.append((*key, int(t), len(seen)))
        over = now
    last = int(rows["ts_us"].max())
    seen = {p: at for p, at in seen.items() if at > last - K.SCAN_HISTORY_US}
    state.update((list(seen.values()), list(seen), bool(over)))
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000 + K.SCAN_HISTORY_US // 1000))
    yield pd.DataFrame(out, columns=["capture", "src", "dst", "ts_us", "ports_seen"])


def slow_scans(packets: DataFrame) -> DataFrame:
    """Pairs that reach the slow-scan threshold anew; state holds the ports of the history and goes when it is over."""
    x = with_time(packets).where(is_scan_probe() & F.col("proto").isin("TCP", "UDP") & F.col("dport").isNotNull())
    return x.groupBy("capture", "src", "dst").applyInPandasWithState(_scan, SCAN_OUT, SCAN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


POLICY_OUT = "capture string, source string, destination string, window_us long, kind string, notified boolean, upgrade boolean, suppressed_repeats long"
POLICY_STATE = "families array<string>, times array<long>, shown array<int>, held array<struct<family: string, kind: string, n: long>>"


def _policy(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, carry: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    s = P.new_state()
    if state.exists:
        families, times, shown, held = state.get
        s["time"], s["shown"] = dict(zip(families, times)), dict(zip(families, shown))
        for h in held:
            s["held"].setdefault(h[0], {})[h[1]] = h[2]
    rows = pd.concat(list(frames))
    rows["generic"] = rows["kind"].isin(K.GENERIC)
    rows = rows.sort_values(["window_us", "generic", "stage", "idx"], kind="stable")
    out = []
    for t, kind, *more in zip(rows["window_us"], rows["kind"], *[rows[c] for c in carry]):
        r = P.step(s, kind, int(t))
        out.append((*key, int(t), kind, r["notified"], r["upgrade"], r["suppressed_repeats"], *more))
    families = list(s["time"])
    state.update((families, [s["time"][f] for f in families], [s["shown"][f] for f in families], [(f, k, n) for f, c in s["held"].items() for k, n in c.items()]))
    more = pd.DataFrame(out, columns=["capture", "source", "destination", "window_us", "kind", "notified", "upgrade", "suppressed_repeats", *carry])
    yield more.assign(suppressed_repeats=more["suppressed_repeats"].astype("Int64"), upgrade=more["upgrade"].astype("boolean"))


def policy(alerts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The policy over a stream of alerts (capture, source, destination, window_us, kind, stage, idx); `carry`: further columns to keep."""
    kinds = dict(alerts.dtypes)
    schema = ", ".join([POLICY_OUT, *[f"{c} {kinds[c]}" for c in carry]])
    return alerts.groupBy("capture", "source", "destination").applyInPandasWithState(partial(_policy, carry=carry), schema, POLICY_STATE, "append", GroupStateTimeout.NoTimeout)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """Starts a query that appends alerts to JSON files below path."""
    return alerts.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
