"""Tables between a query's steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session of one machine may leave it unset and gets a temporary one; elsewhere that is
    an error, as other executors could not see a local folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_flowloom_folder", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        sc._flowloom_folder = folder
        sc.setCheckpointDir(folder)
    return folder


class Workspace:
    """Tables that one query writes to the shared folder: lineage ends there, so lost executors redo one step only.

    Results read them, so they are removed when the result has been used: by drop(), or sweep() for all of a session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        spark.sparkContext.__dict__.setdefault("_flowloom_paths", []).append(self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table that no later step reads, or all."""
        _remove(self.spark, f"{self.path}/{name}" if name else self.path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Removes all workspaces that this session has made; results that read them are of no use afterwards."""
    paths = spark.sparkContext.__dict__.get("_flowloom_paths", [])
    while paths:
        _remove(spark, paths.pop())
