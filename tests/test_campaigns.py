"""Groups that campaigns can't leave, first fit as a stream, and sessions by buckets, against plain models."""

import random

import pytest
from pyspark.sql import functions as F
from test_alerts import INC, S, brute_campaigns

from flowloom import constants as K
from flowloom.operators import graph
from flowloom.operators import incidents as I
from flowloom.sources import adapters
from flowloom.workspace import Workspace


def networks(seed, n=400, nets=6):
    r, rows, t = random.Random(seed), [], 0
    for i in range(n):
        t += r.choice([0, 5, 30, 100, 121, 400]) * S
        net = r.randrange(nets)
        src = r.choice([f"s{net}.{r.randrange(3)}", f"s{net}.{r.randrange(3)}", "unknown", "bridge" if i % 97 == 0 else f"s{net}.0"])
        to = r.sample([f"d{net}.{k}" for k in range(4)], r.randint(0, 3)) + r.choice([[], [], ["multiple"]])
        rows.append((i, src, r.choice(["port_scan", "dos", "brute_force"]), "LOW", 1, None, t, t + r.choice([0, 60, 500]) * S, to))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_campaigns_of_many_networks(spark, seed):
    rows = networks(seed)
    df = spark.createDataFrame(rows, INC).repartition(5)
    assert sorted((x.first_us, x.last_us, x.incidents) for x in I.campaigns(df).collect()) == brute_campaigns(rows)
    parts = I.assigned(df)
    groups, epochs = parts.select("part", "epoch").distinct().count(), I.with_epoch(df).select("epoch").distinct().count()
    assert groups > 3 * epochs
    # A real host near in time never stands in two groups.
    hosts = parts.select("part", "epoch", "first_us", "last_us", F.explode("destinations").alias("h")).where(~F.col("h").isin(*K.PLACEHOLDERS))
    a, b = hosts.alias("a"), hosts.alias("b")
    near = a.join(b, "h").where("(a.part, a.epoch) < (b.part, b.epoch)").where(f"a.first_us <= b.last_us + {K.CAMPAIGN_GAP_US} AND b.first_us <= a.last_us + {K.CAMPAIGN_GAP_US}")
    assert near.count() == 0


def test_first_fit_forgets_what_is_over():
    fit, t = I.FirstFit(), 0
    for i in range(3000):
        t += 40 * S
        fit.add(f"host{i}", [f"to{i}", "multiple"], t, t)
    assert fit.made == 3000 and len(fit.open) <= 4 and len(fit.of) <= 8 and len(fit.ends) <= 5
    one = I.FirstFit()
    assert [one.add("a", None, 0, 0), one.add(None, [], 0, 0), one.add("a", ["x"], K.CAMPAIGN_GAP_US, K.CAMPAIGN_GAP_US), one.add("unknown", ["x"], 2 * K.CAMPAIGN_GAP_US, 9 * S), one.add("a", [], 4 * K.CAMPAIGN_GAP_US, 4 * K.CAMPAIGN_GAP_US)] == [0, 1, 0, 0, 2]


def test_sessions_do_not_depend_on_buckets(spark, small):
    rows = adapters.alerts(spark, small).withColumnRenamed("event_id", "seq").withColumn("src", F.expr("IF(seq % 11 = 0, NULL, src)"))
    of = lambda us: sorted(map(tuple, I.sessions(rows, us).select("seq", "session").collect()))
    whole = of(1 << 50)
    assert of(60 * S) == whole and of(3600 * S) == whole and len({x for _, x in whole}) > 5
    assert I.sessions(rows, 60 * S).columns == [*rows.columns, "session"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 301)]
    got = graph.components(Workspace(spark, "graph"), spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted([*((i, 0) for i in range(41)), *((100 + i, 100) for i in range(30)), (300, 300), (301, 300)])


def test_no_incidents_no_campaigns(spark):
    assert I.campaigns(spark.createDataFrame([], INC)).count() == 0
