"""Gradient-boosted trees for several classes, and a comparison of the kinds of models.

Trees are grown on histograms of at most `BINS` bins a feature (Spark ML); a booster a class tells the class from the others, and the
soft-max of their margins is the confidence.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clean_number
from . import classify as C

ROUNDS, DEPTH, BINS, STEP, SEED = 20, 5, 64, 0.1, 42
#: Boosters that are fitted at a time.
PARALLEL = 4


class Boosted:
    """verdict (ties: the first class) and confidence by a booster a class; labels in alphabetical order."""

    def __init__(self, labels: list[str], boosters: list[GBTClassificationModel], features: list[str]):
        self.labels, self.boosters, self.features = labels, boosters, features

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], label: str = "label", rounds: int = ROUNDS, depth: int = DEPTH, parallel: int = PARALLEL) -> Boosted:
        """Class-balanced weights; cleaned features. A label alone needs no booster. Rows of null label are left out."""
        spark = rows.sparkSession
        x = C.weighted(rows.where(F.col(label).isNotNull()), label).select(label, "weight", *[clean_number(f).alias(f) for f in features])
        x = VectorAssembler(inputCols=features, outputCol="_raw").transform(x).select(label, "weight", "_raw").persist()
        labels = sorted(r[0] for r in x.select(label).distinct().collect())  # a row a class

        def one(name: str) -> GBTClassificationModel:
            y = x.withColumn("_y", (F.col(label) == name).cast("double"))
            return GBTClassifier(featuresCol="_raw", labelCol="_y", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=BINS, stepSize=STEP, seed=SEED, lossType="logistic").fit(y)

        # Of two classes one booster's margin is the other's with its sign turned.
        with ThreadPool(parallel) as pool:
            boosters = pool.map(inheritable_thread_target(spark)(one), labels[1:] if len(labels) == 2 else labels if len(labels) > 2 else [], chunksize=1)
        x.unpersist()
        return cls(labels, boosters, features)

    def predict(self, rows: DataFrame) -> DataFrame:
        x = VectorAssembler(inputCols=self.features, outputCol="_raw").transform(rows.withColumns({f: clean_number(f) for f in self.features}))
        margins = []
        for i, b in enumerate(self.boosters):
            b.setFeaturesCol("_raw").setRawPredictionCol("_margin").setPredictionCol("_p").setProbabilityCol("_q")
            x = b.transform(x).withColumn(f"_m{i}", vector_to_array("_margin")[1]).drop("_margin", "_p", "_q")
            margins.append(F.col(f"_m{i}"))
        if len(self.labels) == 2:
            margins = [-margins[0] / 2, margins[0] / 2]
        # Both margins of a class and of its rest are half its log odds, hence the factor.
        odds = F.array(*[F.exp(2 * (m - F.greatest(*margins) if len(margins) > 1 else F.lit(0.0))) for m in margins]) if margins else F.array(F.lit(1.0))
        x = x.withColumn("_odds", odds)
        best = F.array_position("_odds", F.array_max("_odds")).cast("int")
        x = x.withColumn("verdict", F.element_at(F.array(*[F.lit(n) for n in self.labels]), best)).withColumn("confidence", F.array_max("_odds") / F.aggregate("_odds", F.lit(0.0), lambda a, b: a + b))
        return x.drop("_raw", "_odds", *[f"_m{i}" for i in range(len(self.boosters))])

    def save(self, path: str) -> None:
        for i, b in enumerate(self.boosters):
            b.write().overwrite().save(f"{path}/{i}")
        spark = SparkSession.getActiveSession()
        about = [("label", n) for n in self.labels] + [("feature", f) for f in self.features]
        spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(about)], "kind string, place int, value string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> Boosted:
        about = sorted(SparkSession.getActiveSession().read.json(f"{path}/about").collect(), key=lambda r: r.place)
        labels, features = ([r.value for r in about if r.kind == k] for k in ("label", "feature"))
        n = 0 if len(labels) < 2 else 1 if len(labels) == 2 else len(labels)
        return cls(labels, [GBTClassificationModel.load(f"{path}/{i}") for i in range(n)], features)


def compare(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", balance: bool = True, trees: int = C.TREES, depth: int = C.DEPTH, rounds: int = ROUNDS) -> DataFrame:
    """model, accuracy and macro_recall (the mean over labels) of a forest, boosted trees and logistic regression, the best first.

    With balance the training rows are first evened out by made-up ones. Labels that only the test rows have count as missed.
    """
    spark = train.sparkSession
    rows = (C.smote(train, features, label) if balance else train.select(label, *features)).persist()
    made = {
        "random forest": lambda: C.predict(C.fit(rows, features, label, trees=trees, depth=depth), test),
        "gradient boosting": lambda: Boosted.fit(rows, features, label, rounds=rounds).predict(test),
        "logistic regression": lambda: C.predict(C.fit(rows, features, label, kind="logistic"), test),
    }
    out = []
    for name, run in made.items():
        r = run().withColumn("hit", (F.col("verdict") == F.col(label)).cast("double")).groupBy(label).agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
        r = r.agg(F.sum("hits") / F.sum("n"), F.avg(F.col("hits") / F.col("n"))).first()  # a row a class
        out.append((name, r[0], r[1]))
    rows.unpersist()
    return spark.createDataFrame(out, "model string, accuracy double, macro_recall double").orderBy(F.desc("macro_recall"), "model")
