"""Quantiles, boosted trees, permutation importance and sweeps against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.ml import boosting as B
from flowloom.ml import classify as C
from flowloom.ml.forest import IsolationForest
from flowloom.operators.quantiles import quantiles
from flowloom.plans import analysis as AN


@pytest.mark.parametrize("held,buckets", [(4096, 1024), (5, 4), (1, 2)])
def test_quantiles_are_exact(spark, held, buckets, monkeypatch):
    r = random.Random(held)
    kinds = [lambda: r.random(), lambda: float(r.randint(0, 3)), lambda: r.choice([-1e300, 1e300, 1e-300, 0.0, 5.5]), lambda: 10 ** r.uniform(-200, 200), lambda: 7.0]
    rows = [(k if k < 5 else None, kinds[k % 5](), r.choice([None, float("nan"), r.gauss(0, 1)])) for k in range(6) for _ in range(r.choice([1, 2, 90, 301]))]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    shares = [0.0, 0.5, 0.93, 1.0]
    if buckets == 2:
        from flowloom.operators import quantiles as Q

        monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    got = {(v.g, v.feature, v.share): v.value for v in quantiles(df, ["g"], ["x", "y"], shares, held, buckets).collect()}
    want = {}
    for g in {v[0] for v in rows}:
        for i, f in ((1, "x"), (2, "y")):
            mine = sorted(v[i] for v in rows if v[0] == g and v[i] is not None and v[i] == v[i])
            for s in shares if mine else ():
                at = s * (len(mine) - 1)
                low, high = int(np.floor(at)), int(np.ceil(at))
                want[g, f, s] = mine[low] if low == high else (high - at) * mine[low] + (at - low) * mine[high]
    assert got == want
    assert quantiles(df.where("false"), [], ["x"], [0.5]).count() == 0
    assert [tuple(v) for v in quantiles(df.where("g = 4"), [], ["x"], [0.5], held, buckets).collect()] == [("x", 0.5, 7.0)]


def test_medians_equal_percentile(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "rand(3) * id AS x")
    want = {v.g: v.m for v in df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
    assert {v.g: v["median"] for v in AN.medians(df, "g", ["x"]).collect()} == want


def classes(spark, names, n=240):
    r = random.Random(5)
    rows = []
    for i in range(n):
        k = i % len(names)
        rows.append((names[k], k * 4 + r.gauss(0, 1), r.gauss(0, 1), i))
    return spark.createDataFrame(rows, "label string, x double, y double, flow_seq long")


@pytest.mark.parametrize("names", [["c", "a", "b"], ["no", "yes"], ["alone"]])
def test_boosted_trees(spark, names, tmp_path):
    df = classes(spark, names, 150)
    model = B.Boosted.fit(df, ["x", "y"], rounds=3, depth=2)
    got = model.predict(df.select("label", "y", "x"))
    assert got.where("verdict = label").count() >= 0.9 * 150 and got.where("confidence > 1 OR confidence < 0.33").count() == 0 and got.columns == ["label", "y", "x", "verdict", "confidence"]
    model.save(f"{tmp_path}/m")
    again = B.Boosted.load(f"{tmp_path}/m").predict(df.select("label", "y", "x"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    if len(names) == 2:  # the soft-max of one booster's two margins is its own probability
        b = model.boosters[0]
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        own = b.setProbabilityCol("p").setPredictionCol("q").setRawPredictionCol("m").transform(VectorAssembler(inputCols=["x", "y"], outputCol="_raw").transform(df)).select("flow_seq", vector_to_array("p").alias("p"))
        both = own.join(model.predict(df).select("flow_seq", "confidence"), "flow_seq")
        assert both.where("abs(confidence - greatest(p[0], p[1])) > 1e-9").count() == 0


def test_comparison_of_models(spark):
    x = C.stratified(classes(spark, ["a", "b"], 160), "label", 0.75)
    got = B.compare(x.where("part = 'train'"), x.where("part = 'test'"), ["x", "y"], trees=5, depth=3, rounds=2).collect()
    assert {r.model for r in got} == {"random forest", "gradient boosting", "logistic regression"} and all(r.accuracy > 0.85 and r.macro_recall > 0.85 for r in got)
    assert [r.macro_recall for r in got] == sorted((r.macro_recall for r in got), reverse=True)


def test_permutation_importance(spark):
    df = classes(spark, ["a", "b", "c"])
    at = C.numbered(df.repartition(5)).select("_at", "flow_seq").collect()
    assert sorted(r[0] for r in at) == list(range(240)) and sorted(r[1] for r in at) == list(range(240))
    model = C.fit(df, ["x", "y"], trees=10, depth=4)
    got = {r.feature: r for r in C.permutation_importance(model, df, ["x", "y"], repeats=3).collect()}
    assert 0.5 < got["x"].importance < 0.8 and abs(got["y"].importance) < 0.06 and 0 < got["x"].deviation < 0.1
    assert C.permutation_importance(model, df.where("false"), ["x"]).count() == 0


def test_permuted_forest_scores_as_its_model(spark):
    """Verdicts of every row and feature with another row's value are those of the model itself, without a pass of it a feature."""
    r = random.Random(3)
    rows = [(r.choice("abc"), r.choice([0.0, 1.0, 2.0]), r.gauss(0, 1), r.choice([5.0, float("nan"), float("inf")])) for _ in range(300)]
    rows = [(k if i % 9 else None, x + "abc".index(k), y, z) for i, (k, x, y, z) in enumerate(rows)]
    df, names = spark.createDataFrame(rows, "label string, x double, y double, z double"), ["x", "y", "z"]
    model = C.fit(df, names, trees=7, depth=5)
    seen = []
    was, C.predict = C.predict, lambda m, x: seen.append(1) or was(m, x)
    try:
        got = {v.feature: (v.importance, v.deviation) for v in C.permutation_importance(model, df, names[::-1], repeats=2).collect()}
    finally:
        C.predict = was
    assert len(seen) == 1

    class Plain:  # takes the general way, a pass of the model for every feature
        predict = staticmethod(lambda x: was(model, x))

    want = {v.feature: (v.importance, v.deviation) for v in C.permutation_importance(Plain, df, names[::-1], repeats=2).collect()}
    assert got.keys() == want.keys() == set(names) and all(got[f] == pytest.approx(want[f], abs=1e-12) for f in names)


def test_made_up_rows_fit_a_task_whatever_repeats(spark):
    """Neighbours of a block take little memory; equal rows and a label of few rows don't crowd one group, and all rows are made."""
    import tracemalloc

    v = np.random.default_rng(1).normal(size=(1500, 25))
    tracemalloc.start()
    near = C.neighbours(v, 3)
    assert tracemalloc.get_traced_memory()[1] < 32 << 20
    tracemalloc.stop()
    d = ((v[:40, None] - v[None]) ** 2).sum(axis=2)
    assert (near[:40] == np.argsort(d, axis=1)[:, 1:4]).all()
    rows = [("many", float(i), 0.0) for i in range(900)] + [("same", 7.0, 7.0)] * 300 + [("two", 1.0, 2.0), ("two", 3.0, 6.0)]
    held, apply = [], type(spark.range(1).groupBy("id")).applyInPandas

    def watched(self, f, schema):
        held.append(self._df.groupBy("label", "block").count().agg(F.max("count")).first()[0])
        return apply(self, f, schema)

    kind = type(spark.range(1).groupBy("id"))
    kind.applyInPandas = watched
    try:
        made = C.smote(spark.createDataFrame(rows, "label string, x double, y double").repartition(4), ["x", "y"], block=50)
    finally:
        kind.applyInPandas = apply
    got = {x["label"]: x["count"] for x in made.groupBy("label").count().collect()}
    assert held and held[0] < 100 and got["many"] == 900 and got["two"] in (900, 2) and abs(got["same"] - 900) <= 6
    assert made.where("label = 'two' AND abs(y - 2 * x) > 1e-9").count() == 0 and made.where("label = 'same' AND (x <> 7 OR y <> 7)").count() == 0


def test_leave_one_out_takes_few_jobs_a_fit(spark):
    rows = [(f"c{i % 4}", "a" if i % 2 else "b", float(i % 2) + (i % 5) / 9, float(i % 7)) for i in range(160)]
    df = spark.createDataFrame([*rows, ("c1", None, 0.5, 1.0), (None, "b", 0.1, 2.0)], "capture string, label string, x double, y double").repartition(40)
    spark.sparkContext.setJobGroup("left-out", "leave_one_out")
    got = C.leave_one_out(df, ["x", "y"], trees=3, depth=2)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("left-out")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [x[:3] for x in got] == [(f"c{i}", "ab"[1 - i % 2], 40) for i in range(4)] and all(x[3] > 0.9 for x in got)
    assert 0 < len(jobs) <= 64


def test_sweep_equals_forests_fitted_one_by_one(spark):
    r = random.Random(9)
    rows = spark.createDataFrame([(f"c{i % 3}", r.gauss(i % 3, 1), r.gauss(0, 1)) for i in range(300)], "capture string, x double, y double")
    odd = spark.createDataFrame([("attack", 40.0, 40.0)] * 5 + [("calm", 1.0, 0.0)] * 5, "capture string, x double, y double")
    got = {(v.left_out, v.capture, v.contamination): (v.rows, v.flag_rate) for v in C.sweep(rows, ["x", "y"], (0.01, 0.1), judged=odd).collect()}
    assert len(got) == 2 * (3 + 2)
    for c in ("c0", "c2"):
        for share in (0.01, 0.1):
            alone = IsolationForest.fit(rows.where(F.col("capture") != c), ["x", "y"], share)
            want = rows.where(F.col("capture") == c).agg(100 * F.avg(alone.flags().cast("double"))).first()[0]
            assert got[c, c, share] == (100, pytest.approx(want))
    assert got[None, "attack", 0.01] == (5, 100.0) and got[None, "calm", 0.1] == (5, 0.0)
    assert C.flag_rates(rows, odd.where("capture = 'attack'"), ["x", "y"], (0.01, 0.1)) == [(0.01, 100.0), (0.1, 100.0)]
