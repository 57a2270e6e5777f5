"""Filter interaction audit over the lattice of filter subsets (operator 13).

What a filter removes depends on the filters applied before it, but only on their set, not on their order. So documents are counted
once by the set of filters they fail, these few counts are added up along the edges (set already applied, next filter) of the
lattice, and each step of each order looks up its edge: five filters have 80 edges and 120 orders of five steps.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

WORDS = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that don't look at other rows: short, repetitive, upper case, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, points = F.size(words), F.char_length(text)
    return {
        "A": n < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * n,
        "C": F.lit(100) * (points - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) > F.lit(3) * points,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """doc_id, part (lang; null: empty) and fails, a bit a filter in the order of `filters`, then one for `copies`.

    A row fails `copies` if a smaller doc_id has the same text; null texts are empty ones, a null doc_id is no smaller and has no
    smaller one, repeated rows of an id don't fail for each other. Texts are compared by their SHA-256. A row is shuffled
    as its digest and bits; a digest's smallest id is aggregated before its shuffle, and only digests that occur twice are joined.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tests = text_filters(F.col("text")) if filters is None else filters
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests.values())), F.lit(0))
    work = Workspace(docs.sparkSession, "interaction")
    rows = work.keep(base.select("doc_id", "part", bits.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(first, "digest", "left").select("doc_id", "part", F.expr(f"own + IF(doc_id > first, {1 << len(tests)}, 0)").alias("fails"))


def edges(n: int) -> list[tuple[int, int, int]]:
    """(set already applied as bits, next filter, number of orders that take the edge) of n filters."""
    out = []
    for s in range(1 << n):
        k = s.bit_count()
        out += [(s, f, factorial(k) * factorial(n - 1 - k)) for f in range(n) if not s >> f & 1]
    return out


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, set already applied, filter) of all orders."""
    out = []
    for order in permutations(range(len(names))):
        s = 0
        for k, f in enumerate(order):
            out.append(("".join(names[i] for i in order), k + 1, s, f))
            s |= 1 << f
    return out


def audit(failed: DataFrame, labels: DataFrame, names: str = "ABCDE") -> DataFrame:
    """A row per part, order of all filters and step: counts of the step's filter after those before it, see COUNTS, and its shapley sum.

    failed: doc_id, part, fails (bit i: fails the filter named names[i]). Each row counts as a document; it is good (toxic) if any label
    of its doc_id says so; null labels and ids say nothing. Parts are those of `failed`, so an empty table gives no row.
    """
    spark = failed.sparkSession
    label = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    masks = failed.select("doc_id", "part", "fails").join(label, "doc_id", "left").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    lattice = ", ".join(f"named_struct('applied', {s}, 'filter', {f}, 'paths', {p}L)" for s, f, p in edges(len(names)))
    each = masks.select("*", F.inline(F.expr(f"array({lattice})"))).withColumn("hit", F.expr("(fails >> filter & 1) = 1")).withColumn("gone", F.expr("(fails & applied) <> 0"))
    total = lambda what, when: F.sum(F.expr(f"IF({when}, {what}, 0L)"))
    summed = each.groupBy("part", "applied", "filter", "paths").agg(
        total("n", "NOT hit AND NOT gone").alias("kept"), total("n", "hit AND NOT gone").alias("removed"), total("n", "hit AND gone").alias("redundant"), total("n", "fails = shiftleft(1, filter)").alias("unique_fails"),
        total("good", "hit AND NOT gone").alias("good_lost"), total("toxic", "hit AND NOT gone").alias("toxic_lost"),
    )
    summed = Workspace(spark, "interaction-edges").keep(summed, "edges")  # 80 rows a part
    shapley = summed.groupBy("part", "filter").agg(F.sum(F.expr("removed * paths")).alias("shapley"))
    path = spark.createDataFrame(steps(names), "filter_order string, step int, applied int, filter int").coalesce(1)  # 600 rows
    return summed.join(shapley, ["part", "filter"]).join(F.broadcast(path), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
