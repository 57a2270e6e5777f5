"""The alert policy: which alerts are shown, which only counted.

State is kept per (capture, source, destination), as families cover one another: when each family was last shown, how
specific that was, and what was held back since. Alerts come in order of window, then specificity, then emission. In batch each
pair is folded in a group of its own; `step` is the automaton of both the batch fold and the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import family, specificity

KEYS = ["capture", "source", "destination"]


def new_state() -> dict:
    return {"time": {}, "shown": {}, "held": {}}


def step(state: dict, kind: str, time_us: int) -> dict:
    """Takes one alert in: notified, and for shown ones upgrade, suppressed_repeats and suppressed_kinds."""
    own, level = K.FAMILY.get(kind, kind), 1 if kind in K.GENERIC else 2
    upgrade = False
    for f in [own, *K.COVERED_BY.get(own, [])]:
        last = state["time"].get(f)
        if last is None or time_us - last >= K.COOLDOWN_US:
            continue
        if level > state["shown"].get(f, 1):
            upgrade = True
            continue
        held = state["held"].setdefault(f, {})
        held[kind] = held.get(kind, 0) + 1
        return {"notified": False, "upgrade": None, "suppressed_repeats": None, "suppressed_kinds": None}
    held = state["held"].pop(own, {})
    state["time"][own], state["shown"][own] = time_us, level
    return {"notified": True, "upgrade": upgrade, "suppressed_repeats": sum(held.values()), "suppressed_kinds": held}


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key and order; a key's state lives from its first row to its last, over batches."""
    key, state = None, new_state()
    for pdf in frames:
        out = []
        for k, kind, t in zip(pdf[KEYS].itertuples(index=False, name=None), pdf["kind"], pdf["window_us"]):
            if k != key:
                key, state = k, new_state()
            out.append(step(state, kind, t))
        more = pd.DataFrame(out, columns=["notified", "upgrade", "suppressed_repeats", "suppressed_kinds"], index=pdf.index)
        yield pdf.assign(notified=more["notified"], upgrade=more["upgrade"].astype(object).where(more["upgrade"].notna(), None), suppressed_repeats=pd.array(more["suppressed_repeats"], dtype="Int64"), suppressed_kinds=more["suppressed_kinds"])


def apply_policy(alerts: DataFrame) -> DataFrame:
    """alerts (capture, window_us, stage, idx, kind, source, destination, ...) with family, specificity, notified, upgrade,
    suppressed_repeats, suppressed_kinds.

    Partitions are hashed by pair and sorted, and folded as a stream of batches: a pair that holds a third of all alerts is one
    long run of rows, never a frame in memory. A pair's order is its only sequential part.
    """
    x = alerts.withColumn("family", family()).withColumn("specificity", specificity())
    x = x.repartition(*KEYS).sortWithinPartitions(*KEYS, "window_us", F.col("specificity").desc(), "stage", "idx")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema) + ", notified boolean, upgrade boolean, suppressed_repeats long, suppressed_kinds map<string, long>"
    return x.mapInPandas(_fold, schema)


def notice(alerts: DataFrame) -> DataFrame:
    """Console lines of shown alerts."""
    from ..functions.exprs import format_counts

    more = F.when(F.col("suppressed_repeats") > 0, F.concat(F.lit(" (+"), F.col("suppressed_repeats").cast("string"), F.lit(K.NOTICE_MORE), format_counts(F.col("suppressed_kinds")), F.lit(")"))).otherwise("")
    up = F.when(F.col("upgrade"), K.NOTICE_UPGRADE).otherwise("")
    return alerts.where("notified").select("window_us", F.concat(F.lit(K.NOTICE_START), "description", F.lit(" "), "source", F.lit(" -> "), "destination", up, more).alias("line"))
