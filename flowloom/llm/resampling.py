"""Importance resampling towards a target distribution over hashed n-grams (operator 12).

Documents are drawn as if from the target's distribution of n-grams, by Gumbel scores over weights log p(target) / p(raw) of hashed
buckets. A feature's bucket and gain depend on its string alone, and strings repeat: each document's features are counted once, the
distinct strings of all documents form a dictionary, each is hashed once, buckets are summed over it, and gains join back to the
documents' counts. Strings that make up a large part of all occurrences, a bounded number of them, are sent to the tasks; all
others are joined by a shuffle in which none can be hot.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, batches, release, table

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
#: Strings with one in this many of all occurrences or more are broadcast, so that is how many there are at most.
HEAD = 65_536
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words whose runs are counted at once; a longer text makes several rows, whose counts add up.
CHUNK = 1 << 16


def _runs(words: list[bytes], longest: int, first: int, stop: int) -> Counter:
    """Runs of 1 to `longest` words that begin at words first to stop - 1."""
    found = Counter(words[first:stop])
    for n in range(2, longest + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(first, min(stop, len(words) - n + 1)))
    return found


def feature_counts(texts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Distinct runs of 1 to `longest` words and their counts in each row of texts (row, doc_id, text), and n_words, n_features.

    Words are those of the text with A-Z lower-cased. A text of over CHUNK words gives several rows, whose first is marked `head`;
    one without words gives one row.
    """

    def work(it):
        for batch in it:
            out: list[tuple] = []
            size = 0
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                words = _WORD.findall((text.as_py() or b"").lower())
                n = sum(max(len(words) - k, 0) for k in range(longest))
                for at in range(0, max(len(words), 1), CHUNK):
                    found = _runs(words, longest, at, min(at + CHUNK, len(words)))
                    out.append((row, doc_id, at == 0, len(words), n, list(found), list(found.values())))
                    size += len(found)
                    if size > CHUNK:
                        yield _rows(out)
                        out, size = [], 0
            yield _rows(out)
            release()

    return texts.select("row", "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, ", ".join(f"{n} {t}" for n, t, _ in COUNTED))


COUNTED = (
    ("row", "long", pa.int64()), ("doc_id", "long", pa.int64()), ("head", "boolean", pa.bool_()), ("n_words", "long", pa.int64()), ("n_features", "long", pa.int64()),
    ("features", "array<string>", pa.list_(pa.binary())), ("counts", "array<int>", pa.list_(pa.int32())),
)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = {n: pa.array([x[i] for x in out], kind) for i, (n, _, kind) in enumerate(COUNTED)}
    return batches(columns | {"features": columns["features"].cast(pa.list_(pa.string()))})


def _each(counted: DataFrame) -> DataFrame:
    return counted.select("row", F.inline(F.arrays_zip(F.col("features").alias("feature"), F.col("counts").alias("n"))))


def dictionary(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, times (in all texts), bucket: each distinct string once."""
    return _each(counted).groupBy("feature").agg(F.sum("n").alias("times")).withColumn("bucket", F.expr(f"crc32(CAST(feature AS binary)) % {buckets}"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln of the target's smoothed share over the raw share), of two dictionaries; at most `buckets` rows.

    A bucket that no raw string falls into isn't listed: no document has it.
    """
    mine = raw.groupBy("bucket").agg(F.sum("times").cast("double").alias("s"))
    theirs = target.groupBy("bucket").agg(F.sum("times").cast("double").alias("t"))
    all_s, all_t = (float(x.agg(F.sum("times")).first()[0] or 0) for x in (raw, target))
    both = mine.join(theirs, "bucket", "left").fillna(0.0, ["t"])
    return both.select("bucket", F.expr(f"floor(1000 * ln((t + 1) * {all_s + buckets!r}D / ((s + 1) * {all_t + buckets!r}D)))").alias("gain"))


def weights(work: Workspace, counted: DataFrame, words: DataFrame, gain: DataFrame, head: int = HEAD) -> DataFrame:
    """row, gain: the sum of gains over each row's features, with repeats; rows without features have none.

    Two joins share the work. Features with one in `head` of all occurrences are at most `head` strings and broadcast; of the others none
    has more than that part of the rows, so their shuffle has no hot key.
    """
    known = work.keep(words.join(F.broadcast(gain), "bucket").select("feature", "times", "gain"), "gains")  # at most BUCKETS rows broadcast
    total = known.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") * head >= total
    top, rest = known.where(often).select("feature", "gain"), known.where(~often).select("feature", "gain")
    found = _each(counted).join(F.broadcast(top), "feature", "left")
    near = found.where("gain IS NOT NULL").groupBy("row").agg(F.sum(F.expr("n * gain")).alias("gain"))
    far = found.where("gain IS NULL").select("row", "feature", "n").join(rest.hint("merge"), "feature").groupBy("row").agg(F.sum(F.expr("n * gain")).alias("gain"))
    return near.union(far).groupBy("row").agg(F.sum("gain").alias("gain"))


def ranked(work: Workspace, scored: DataFrame, draw: int) -> DataFrame:
    """The `draw` rows of highest score, ties to the smaller doc_id (null first), then row, with their rank from 1.

    A histogram of the scores, whole numbers of a narrow range, says where the draw ends; rows above it are dealt by ranges of
    their order, numbered within, and ranges' sizes added up: no task orders more than a range, however many rows tie.
    """
    levels = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    levels = levels.select("score", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc())).alias("upto"))  # a row a whole score
    last = levels.where(F.col("upto") >= draw).agg(F.max("score")).first()[0]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    parts = max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def number(it):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in it:
            n = len(batch)
            yield batches({"row": batch.column(0), "part": pa.array([part] * n, pa.int32()), "at": pa.array(range(at + 1, at + n + 1), pa.int64())})
            at += n

    dealt = scored.where(F.col("score") >= F.lit(last)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = work.keep(dealt.select("row").mapInArrow(number, "row long, part int, at long"), "numbered")
    sizes = dealt.groupBy("part").agg(F.max("at").alias("size")).select("part", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size")).alias("before"))  # a row a range
    return dealt.join(F.broadcast(sizes), "part").select("row", (F.col("before") + F.col("at")).alias("rank")).where(F.col("rank") <= draw)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, head: int = HEAD) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank in the draw, null where it isn't drawn.

    docs: doc_id, text; target: text. The draw is `percent` of the rows with `least_words` words or more. Null texts have no words
    and weight 0. Null ids draw as the text "null"; repeated rows are rows of their own, in the order they were read.
    Other columns are not read; empty tables give no rows, or a target without features.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "resampling")
    counted = work.keep(feature_counts(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), longest), "counts")
    words = work.keep(dictionary(counted, buckets), "dictionary")
    none = F.lit(0).cast("long")
    wanted = work.keep(dictionary(feature_counts(target.select(none.alias("row"), none.alias("doc_id"), "text"), longest), buckets), "target")
    gain = work.keep(gains(words, wanted, buckets), "gain")
    summed = weights(work, counted, words, gain, head)
    one = counted.where("head").select("row", "doc_id", "n_features", "n_words")
    scored = one.join(summed, "row", "left").withColumn("gain", F.coalesce("gain", none))
    scored = scored.withColumn("weight", F.expr("IF(n_features = 0, 0L, (gain - pmod(gain, n_features)) div n_features)"))
    scored = scored.withColumn("h", F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long"))
    scored = work.keep(scored.selectExpr("row", "doc_id", "n_features", "n_words", "weight", "weight + floor(-1000 * ln(-ln((h + 0.5D) / 4294967296D))) AS score"), "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    draw = eligible.count() * percent // 100
    if not draw:
        return scored.selectExpr("doc_id", "n_features", "weight", "score", "CAST(NULL AS long) AS rank")
    return scored.join(ranked(work, eligible, draw), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
