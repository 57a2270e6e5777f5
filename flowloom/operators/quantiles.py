"""Exact quantiles of large groups by refining histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Values of a group that a task holds at most; larger groups are refined until what is left around a rank is so few.
HELD, BUCKETS = 4096, 1024
#: Intervals (some 60 bytes each) up to which they are broadcast to the values; beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000


def quantiles(rows: DataFrame, by: list[str], features: list[str], shares: list[float], held: int = HELD, buckets: int = BUCKETS) -> DataFrame:
    """by, feature, share, value: the interpolated quantile of each feature in each group, as `percentile` defines it.

    Null and NaN values don't count; a group without values of a feature has no row for it; null keys make a group.
    A quantile is asked for by rank. Each round counts the values of an interval around the rank in `buckets` equal parts (counted
    before they are shuffled) and goes on with the part that holds the rank, narrowed to its least and greatest value, until that is one value
    or `held` of them. So a group costs a pass for every factor of a thousand of its size, and no task ever holds or sorts it.
    """
    work = Workspace(rows.sparkSession, "quantiles")
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)]))
    values = rows.select(key.alias("k"), each).where("v IS NOT NULL AND NOT isnan(v)")
    whole = values.groupBy("k", "f").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    place = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    asked = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares])))
    spots = work.keep(whole.select("k", "f", "n", F.explode(asked).alias("r"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), "a", "b"), "0")
    round_ = 0
    while (many := spots.where((F.col("m") > held) & (F.col("a") < F.col("b"))).count()):
        wide = (F.col("m") > held) & (F.col("a") < F.col("b"))
        narrow = spots.where(wide)
        met = values.join(F.broadcast(narrow) if many <= BROADCAST_ROWS else narrow, ["k", "f"]).where("v >= a AND v <= b")
        part = F.least(F.floor((F.col("v") / F.lit(2.0) - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2) * buckets), F.lit(buckets - 1))
        counted = met.groupBy("k", "f", "n", "r", "below", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy("k", "f", "r").orderBy("part"))  # at most `buckets` rows
        found = counted.withColumn("upto", F.col("below") + upto).where("r >= upto - c AND r < upto")
        fresh = found.select("k", "f", "n", "r", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("m"), "a", "b")
        round_ += 1
        after = work.keep(spots.where(~wide).unionByName(fresh), str(round_))
        work.drop(str(round_ - 1))
        spots = after
    one = spots.where("a = b").select("k", "f", "n", "r", F.col("a").alias("v"))
    few = spots.where("a < b")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    lists = values.join(few, ["k", "f"]).where("v >= a AND v <= b").groupBy("k", "f", "n", "r", "below").agg(F.array_sort(F.collect_list("v")).alias("all"))
    ranks = one.unionByName(lists.select("k", "f", "n", "r", F.get("all", (F.col("r") - F.col("below")).cast("int")).alias("v")))
    found = ranks.groupBy("k", "f", "n").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))  # two entries a share

    def value(share: float):
        low, high = F.floor(place(share)), F.ceil(place(share))
        at = lambda r: F.element_at("at", r)
        return F.when(low == high, at(low)).otherwise((high - place(share)) * at(low) + (place(share) - low) * at(high))

    out = found.select("k", F.get(F.array(*[F.lit(f) for f in features]), F.col("f")).alias("feature"), F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), value(s).alias("value")) for s in shares])))
    return out.select(*[F.col(f"k.{c}").alias(c) for c in by], "feature", "share", "value")
