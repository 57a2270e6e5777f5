"""Incidents (sessions of one source and kind) and campaigns (incidents that share hosts at about the same time)."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import incident_gap_us, mean, rank, severity
from ..workspace import Workspace
from .graph import components

INCIDENT = "src string, kind string, severity string, alert_count long, confidence double, first_us long, last_us long, destinations array<string>"


def sessions(alerts: DataFrame, bucket_us: int = 6 * 3600 * K.SECOND_US) -> DataFrame:
    """alerts (src, dst, kind, t_us, confidence, seq) with session, numbered per (src, kind); a pause beyond the kind's gap ends one.

    Pauses are found within time buckets and between the ends of neighbouring ones, so a source with a third of all alerts is ordered
    by as many tasks as it has buckets.
    """
    x = alerts.withColumn("_bucket", F.floor(F.col("t_us") / bucket_us))
    key, inside = ("src", "kind"), Window.partitionBy("src", "kind", "_bucket").orderBy("t_us", "seq")
    before = Window.partitionBy(*key).orderBy("_bucket")  # a row a bucket
    ends = x.groupBy(*key, "_bucket").agg(F.max("t_us").alias("_end")).withColumn("_end", F.lag("_end").over(before))
    met = lambda a, b: (F.col(a).eqNullSafe(F.col(f"_{b}")))
    beside = lambda df: df.withColumnsRenamed({"src": "_src", "kind": "_kind", "_bucket": "_b"})
    on = met("src", "src") & met("kind", "kind") & (F.col("_bucket") == F.col("_b"))
    x = x.join(beside(ends), on).drop("_src", "_kind", "_b")
    x = x.withColumn("_opens", F.coalesce(F.col("t_us") - F.coalesce(F.lag("t_us").over(inside), "_end") > incident_gap_us(F.col("kind")), F.lit(True)).cast("long"))
    opened = x.groupBy(*key, "_bucket").agg(F.sum("_opens").alias("_n")).withColumn("_n", F.sum("_n").over(before) - F.col("_n"))
    x = x.withColumn("session", F.sum("_opens").over(inside)).join(beside(opened), on)
    return x.withColumn("session", F.col("session") + F.col("_n")).drop("_bucket", "_end", "_opens", "_n", "_src", "_kind", "_b")


def incidents(alerts: DataFrame) -> DataFrame:
    """See INCIDENT; destinations in order of first appearance, confidence averaged over alerts that have one."""
    x = sessions(alerts)
    first = x.groupBy("src", "kind", "session", "dst").agg(F.min(F.struct("t_us", "seq")).alias("at"))
    targets = first.groupBy("src", "kind", "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "dst"))), lambda s: s.dst).alias("destinations"))
    main = x.groupBy("src", "kind", "session").agg(F.count("*").alias("alert_count"), mean("confidence").alias("confidence"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    out = main.join(targets, ["src", "kind", "session"]).withColumn("severity", severity(F.col("kind"), F.col("alert_count")))
    return out.select("src", "kind", "severity", "alert_count", "confidence", "first_us", "last_us", "destinations")


def with_epoch(rows: DataFrame, keys: tuple[str, ...] = (), gap_us: int = K.CAMPAIGN_GAP_US, bucket_us: int = 6 * 3600 * K.SECOND_US) -> DataFrame:
    """incidents with epoch: an incident that begins more than gap_us after all before it (of its keys) have ended begins a new one.

    The running maximum is taken within time buckets and over the buckets' maxima, so no window spans the whole table.
    """
    x = rows.withColumn("bucket", F.floor(F.col("first_us") / bucket_us))
    inside = Window.partitionBy(*keys, "bucket").orderBy("first_us", "seq")
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for six hours
    carried = x.groupBy(*keys, "bucket").agg(F.max("last_us").alias("top")).withColumn("carried", F.max("top").over(earlier)).select(*keys, "bucket", "carried")
    x = x.join(carried, [*keys, "bucket"]).withColumn("ended", F.greatest(F.max("last_us").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "carried"))
    x = x.withColumn("opens", F.when(F.col("ended").isNull() | (F.col("first_us") > F.col("ended") + gap_us), F.col("first_us")))
    x = x.withColumn("own", F.max("opens").over(inside))
    last = x.groupBy(*keys, "bucket").agg(F.max("opens").alias("o")).withColumn("before", F.max("o").over(earlier)).select(*keys, "bucket", "before")
    return x.join(last, [*keys, "bucket"]).withColumn("epoch", F.coalesce("own", "before")).drop("bucket", "carried", "ended", "opens", "own", "before")


def with_group(rows: DataFrame) -> DataFrame:
    """incidents with part and epoch, which name groups that can't share a campaign.

    An incident joins a campaign near in time that has its source or one of its targets. So incidents fall into epochs, those
    of an epoch into components of incidents that real hosts link, and these, without the others in between, into epochs again. The
    components are found on the graph of an epoch's hosts, which is small where incidents are many: each incident links its hosts to the
    first of them. Hosts go by a hash; should two share one, two groups are one, which changes no campaign.
    """
    work = Workspace(rows.sparkSession, "campaign-groups")
    real = lambda source, host: F.when(host.isNotNull() & ~host.isin(*K.PLACEHOLDERS), F.xxhash64("epoch", F.lit(source), host))
    hosts = F.array_compact(F.concat(F.array(real(True, F.col("src"))), F.transform(F.coalesce("destinations", F.array().cast("array<string>")), lambda d: real(False, d))))
    x = work.keep(with_epoch(work.keep(rows, "rows")).withColumn("hosts", hosts).withColumn("host", F.array_min("hosts")), "epochs")
    star = x.select(F.col("host").alias("a"), F.explode("hosts").alias("b")).where("a <> b")
    label = components(work, star).withColumnsRenamed({"node": "host", "label": "part"})
    parts = x.drop("epoch", "hosts").join(label, "host", "left").withColumn("part", F.coalesce("part", "host", "seq")).drop("host")
    return with_epoch(work.keep(parts, "parts"), ("part",))


class FirstFit:
    """Incidents of a group, given in order of first_us: each gets the first campaign near in time that has its source or a target.

    Campaigns that ended too long ago for any later incident are forgotten, and hosts know their campaigns, so memory and
    time follow the campaigns that are open and not all there are.
    """

    def __init__(self, gap_us: int = K.CAMPAIGN_GAP_US):
        self.gap, self.made = gap_us, 0
        self.open: dict[int, list] = {}  # number: first, last, hosts
        self.of: dict[tuple, set[int]] = {}  # host: open campaigns
        self.ends: list[tuple[int, int]] = []  # a heap of (last, number), some of them outdated

    def add(self, src: str | None, destinations: list, first: int, last: int) -> int:
        while self.ends and self.ends[0][0] + self.gap < first:
            end, n = heapq.heappop(self.ends)
            if n in self.open and self.open[n][1] == end:
                for h in self.open.pop(n)[2]:
                    self.of[h].discard(n)
                    if not self.of[h]:
                        del self.of[h]
        hosts = {("s", src), *(("d", d) for d in destinations or ())}
        hosts = {h for h in hosts if h[1] is not None and h[1] not in K.PLACEHOLDERS}
        near = [n for h in hosts for n in self.of.get(h, ()) if first <= self.open[n][1] + self.gap and last >= self.open[n][0] - self.gap]
        n = min(near, default=self.made)
        if n == self.made:
            self.made += 1
            self.open[n] = [first, last, set()]
        c = self.open[n]
        c[0], c[1] = min(c[0], first), max(c[1], last)
        for h in hosts - c[2]:
            self.of.setdefault(h, set()).add(n)
        c[2] |= hosts
        heapq.heappush(self.ends, (c[1], n))
        return n


def _fold(batches):
    group, fit = None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("part", "epoch", "src", "destinations", "first_us", "last_us")]
        out = []
        for part, epoch, *row in zip(*cols):
            if (part, epoch) != group:
                group, fit = (part, epoch), FirstFit()
            out.append(fit.add(*row))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "campaign"])


def assigned(rows: DataFrame) -> DataFrame:
    """incidents (INCIDENT and seq, distinct numbers that break ties of first_us) with part, epoch and campaign, which name its campaign.

    First fit depends on order, so it runs through a group row by row, as a stream of batches: a group that holds most incidents is a
    long run of sorted rows and never a frame in memory.
    """
    names = [*(c.split()[0] for c in INCIDENT.split(", ")), "seq", "part", "epoch"]
    x = with_group(rows).select(*names)
    return x.repartition("part", "epoch").sortWithinPartitions("part", "epoch", "first_us", "seq").mapInArrow(_fold, f"{INCIDENT}, seq long, part long, epoch long, campaign long")


def campaigns(rows: DataFrame) -> DataFrame:
    """Campaigns of incidents, see assigned(); sources, kinds and targets in order of first appearance."""
    key = ["part", "epoch", "campaign"]
    x = Workspace(rows.sparkSession, "campaigns").keep(assigned(rows), "assigned")

    def ordered(values, name: str) -> DataFrame:
        """Distinct values, each reduced to its first place before it is gathered."""
        first = x.select(*key, "first_us", "seq", F.posexplode(values).alias("p", "v")).groupBy(*key, "v").agg(F.min(F.struct("first_us", "seq", "p")).alias("at"))
        return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s.v).alias(name))

    out = x.groupBy(*key).agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("alert_count").alias("alert_count"), F.count("*").alias("incidents"), mean("confidence").alias("confidence"), F.max(rank()).alias("rank"))
    for values, name in ((F.array("src"), "sources"), (F.array("kind"), "kinds"), (F.col("destinations"), "destinations")):
        out = out.join(ordered(values, name), key, "left")
    out = out.withColumn("destinations", F.coalesce("destinations", F.array().cast("array<string>")))
    many = F.size(F.filter("sources", lambda s: ~s.isin(*K.PLACEHOLDERS))) >= K.MULTI_SOURCE
    holds = lambda m: F.exists("kinds", lambda k: F.contains(k, F.lit(m)))
    staged = holds("scan") & (holds("brute") | holds("dos"))
    out = out.withColumn("pattern", F.when(many & staged, "multi-source + multi-stage").when(staged, "multi-stage").when(many, "multi-source").otherwise("single"))
    level = F.when(staged | (F.col("rank") == 3), "HIGH").when((F.col("rank") == 2) | many, "MEDIUM").otherwise("LOW")
    return out.withColumn("severity", level).select("first_us", "last_us", "alert_count", "incidents", "confidence", "sources", "kinds", "destinations", "pattern", "severity")


def by_priority(rows: DataFrame) -> DataFrame:
    return rows.orderBy(rank().desc(), F.desc("last_us"))
