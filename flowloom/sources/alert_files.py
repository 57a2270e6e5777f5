"""Alert files: JSON lines read tolerantly or strictly, other JSON and CSV documents, and the sinks."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import first_key, parse_seconds


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One column `value`; a path that doesn't exist has no lines."""
    return spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")


def as_object(value: Column) -> Column:
    """A line's top-level fields as a map of texts; null for what isn't a JSON object.

    The parser marks a broken line in a field of its own; arrays, numbers and texts don't begin with a brace.
    """
    return F.when(F.trim(value).startswith("{"), F.from_json(value, "map<string,string>", {"mode": "PERMISSIVE"}))


def _valid(value: Column) -> Column:
    return F.trim(value).startswith("{") & F.trim(value).endswith("}") & F.col("fields").isNotNull()


def normalised(parsed: DataFrame, *keep: str) -> DataFrame:
    """Normalised alerts of parsed lines (value, fields): src, dst, kind (lower case), seconds, confidence."""
    text = lambda keys: F.coalesce(first_key(F.col("fields"), keys), F.lit("unknown"))
    seconds = F.coalesce(parse_seconds(first_key(F.col("fields"), K.TIME_KEYS)), F.lit(0.0))
    confidence = first_key(F.col("fields"), K.CONFIDENCE_KEYS).try_cast("double").alias("confidence")
    return parsed.where(_valid(F.col("value"))).select(*keep, text(K.SOURCE_KEYS).alias("src"), text(K.TARGET_KEYS).alias("dst"), F.lower(text(K.KIND_KEYS)).alias("kind"), seconds.alias("seconds"), confidence)


def tolerant(raw: DataFrame) -> DataFrame:
    """Normalised alerts of lines (value), with their fields. Blank and invalid lines are left out."""
    return normalised(raw.where(F.trim("value") != "").withColumn("fields", as_object(F.col("value"))), "fields")


def skipped(raw: DataFrame) -> DataFrame:
    """Number of lines that tolerant() leaves out other than blank ones."""
    x = raw.where(F.trim("value") != "").withColumn("fields", as_object(F.col("value")))
    return x.agg(F.count_if(~F.coalesce(_valid(F.col("value")), F.lit(False))).alias("skipped"))


def strict(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines of which a broken one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def document(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON document; None where there is none."""
    return spark.read.option("multiLine", True).json(path) if exists(spark, path) else None


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


# The fields of a document of live measurements.
LIVE = (
    "measured_on string, interface string, generator string, note string, capture_path map<string, struct<received: long, dropped: long>>, "
    "detections map<string, struct<detected: boolean, by: string, half_open: long, ports: long>>"
)


def live_results(spark: SparkSession, path: str) -> DataFrame | None:
    """Measurements that were taken on a live interface, one row (see LIVE); None where there are none."""
    return spark.read.schema(LIVE).option("multiLine", True).json(path) if exists(spark, path) else None


def append_alerts(alerts: DataFrame, path: str, fresh: bool = False) -> None:
    """Adds alerts to a log of JSON lines, or begins it anew."""
    alerts.write.mode("overwrite" if fresh else "append").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_session(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def captures(spark: SparkSession, registry: list[tuple[str, str]]) -> DataFrame:
    """(path, label) of the captures that exist; of the others a warning tells."""
    there = [r for r in registry if exists(spark, r[0])]
    for path in sorted({r[0] for r in registry} - {r[0] for r in there}):
        warnings.warn(f"{path} is missing and left out", stacklevel=2)
    return spark.createDataFrame(there, "path string, label string")


# The sample scenarios, (source, target, kind, alerts, seconds between, day, first second of the day).
SAMPLE = (
    ("192.168.1.50", "192.168.1.1", "scan", 4, 30, 0, 0), ("192.168.1.50", "192.168.1.1", "scan", 2, 30, 0, 1200), ("10.0.0.7", "192.168.1.1", "anomaly", 1, 0, 0, 10800),
    ("192.168.1.66", "192.168.1.10", "bruteforce", 6, 10, 1, 0), ("192.168.1.77", "192.168.1.10", "bruteforce", 2, 10, 1, 1800), ("192.168.1.99", "192.168.1.10", "dos", 8, 5, 1, 3600), ("192.168.1.88", "192.168.1.1", "slow_scan", 1, 0, 1, 7200),
    ("10.0.0.11", "192.168.1.20", "scan", 1, 0, 1, 14400), ("10.0.0.12", "192.168.1.20", "scan", 1, 0, 1, 14400), ("10.0.0.13", "192.168.1.20", "scan", 1, 0, 1, 14400), ("192.168.1.40", "192.168.1.20", "scan", 1, 0, 1, 14400),
    ("192.168.1.30", "192.168.1.20", "scan", 3, 20, 1, 18000), ("192.168.1.30", "192.168.1.20", "bruteforce", 3, 10, 1, 18060),
)
SAMPLE_DAY_US = 1_704_067_200_000_000


def sample_alerts(spark: SparkSession) -> DataFrame:
    """34 alerts of 13 scenarios: src, dst, kind, t_us, confidence (null), seq."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SAMPLE)], "i long, src string, dst string, kind string, n int, every long, day long, start long")
    x = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    t = F.lit(SAMPLE_DAY_US) + (F.col("day") * 86400 + F.col("start") + F.col("k") * F.col("every")) * K.SECOND_US
    return x.select("src", "dst", "kind", t.alias("t_us"), F.lit(None).cast("double").alias("confidence"), (F.col("i") * 100 + F.col("k")).alias("seq"))
