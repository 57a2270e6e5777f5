"""Training data: flows of whole captures, tables of other shapes brought to one, and what their columns are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import constants as K
from ..functions.exprs import is_finite
from ..operators import flows as FL
from . import pcap


def training_flows(packets: DataFrame) -> DataFrame:
    """A row a flow of the whole capture (no windows), with destination_port; null features are zero."""
    x = FL.flows(packets, scope=("capture",))
    names = ["destination_port", *FL.FEATURES]
    return x.select("capture", "flow_seq", "src", "dst", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def load_captures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """training_flows of capture files, at least one."""
    pcap.register(spark)
    return training_flows(reduce(DataFrame.unionByName, [spark.read.format("pcap").load(p) for p in paths]))


def without_metadata(rows: DataFrame, names: tuple[str, ...] = K.FLOW_METADATA) -> DataFrame:
    """rows without the columns that describe a flow's origin; those that aren't there are no error."""
    return rows.drop(*names)


def aligned(rows: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly these columns in this order: missing ones and nulls are `fill`, others go."""
    have = set(rows.columns)
    return rows.select(*[(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill)) if c in have else F.lit(fill)).alias(c) for c in columns])


def renamed(rows: DataFrame, names: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a public flow table under this package's names (and `keep`), without rows that hold a null, NaN or infinity."""
    x = rows.select(*[F.col(f"`{old}`").cast("double").alias(new) for old, new in names.items()], *keep)
    for new in names.values():
        x = x.where(is_finite(new))
    return x.dropna(subset=list(keep)) if keep else x


def label_column(rows: DataFrame, candidates: tuple[str, ...] = K.LABEL_CANDIDATES) -> str | None:
    """The first candidate present, else the last column that isn't a number, else none."""
    for c in candidates:
        if c in rows.columns:
            return c
    texts = [f.name for f in rows.schema if not isinstance(f.dataType, NumericType)]
    return texts[-1] if texts else None


def feature_columns(rows: DataFrame, label: str | None, about: dict | None = None) -> list[str]:
    """The features that a saved model names, else all number columns but the label."""
    if about and about.get("features"):
        return list(about["features"])
    return [f.name for f in rows.schema if isinstance(f.dataType, NumericType) and f.name != label]


def of_label(registry: DataFrame, label: str = "normal") -> DataFrame:
    """Captures of one label in a registry (path, label)."""
    return registry.where(F.col("label") == label)
