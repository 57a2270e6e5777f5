"""SimHash fingerprints linked by multi-index hashing (operator 3).

Fingerprints (64 bits) fall into two 32-bit segments. Two of them that differ in at most three bits differ in at most one
bit of some segment, so for each segment every fingerprint looks up its segment's Hamming ball of radius one (33 values) in
the table of exact segment values, and matches are verified over all 64 bits. Only distinct fingerprints take part, so
copies cost one row each. A table entry that more than `HOT` fingerprints look up isn't joined: these are dealt to pairs of
hashed blocks of bounded size, and each pair returns a spanning forest of its links, not the links, whose number would grow
with the square of a group of near copies. Components are the same either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Workspace, batches, components, drop_ids, grams, int64, large_rows, mix, passes, release, shuffled, table, texts_of, word_hashes, words_in

#: Fingerprints that look up one segment value beyond which the value's links are found in blocks.
HOT = 4
#: Fingerprints of a block (each task compares two).
BLOCK = 2048
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; zero for a text of no words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + shingle - 1]
        joined = map(b" ".join, zip(*[part[i:] for i in range(shingle)]))
        hashes = np.fromiter((digest(x, 42) for x in joined), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long. Null text has no words; null and repeated doc_ids stay as they are."""

    def work(it):
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield batches({"doc_id": part.column(0), "fp": int64(np.array([fingerprint(x, shingle) for x in texts_of(part.column(1))], np.uint64))})

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text").mapInArrow(work, "doc_id long, fp long")


def _segments(fp: str = "fp") -> list[Column]:
    """Keys of the two segments: the segment's number in bit 32, its value below."""
    return [F.shiftrightunsigned(fp, 32), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (root, other) that join the same values as all pairs within the radius would."""
    rest, out = np.unique(values.view(np.uint64)), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= radius
            if near.any():
                hits = rest[near]
                frontier.extend(hits)
                out.extend((root, x) for x in hits)
                rest = rest[~near]
    return out


def links(work: Workspace, distinct: DataFrame, radius: int = 3, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what differs in `radius` bits or fewer (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of one bit find at most 3 differing bits")
    first, second = _segments()
    exact = distinct.select("fp", F.explode(F.array(first, second)).alias("key"))
    flips = F.sequence(F.lit(0), F.lit(31))
    ball = lambda s: F.concat(F.array(s), F.transform(flips, lambda i: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    probes = distinct.select("fp", F.explode(F.concat(ball(first), ball(second))).alias("key"))
    # What one fingerprint's segment is near to may be as many as a crowd that shares a segment: those that look up count, too.
    items = work.keep(shuffled(probes).join(shuffled(exact.select("key").distinct()), "key"), "items")
    items = work.keep(shuffled(items).join(items.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "met")
    few = items.where(F.col("n") <= hot).select("key", "fp")
    found = shuffled(few.withColumnRenamed("fp", "a")).join(few.withColumnRenamed("fp", "b"), "key").where(F.col("a") < F.col("b"))
    found = found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    crowded = items.where(F.col("n") > hot).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    if not crowded.limit(1).count():
        return found
    dealt = crowded.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def compare(it):
        for batch in it:
            for values in batch.column(0):
                pairs = forest(np.array(values.values, np.int64), radius)
                x = np.array(pairs, np.uint64).reshape(-1, 2)
                yield batches({"a": int64(x[:, 0]), "b": int64(x[:, 1])})

    return found.union(groups.select("fps").mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over linked fingerprints.

    Null text: fingerprint zero, linked like any other. A null doc_id is no candidate for component_id (null if there is no
    other). Repeated rows give a row each. An empty table gives none. Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.keep(fingerprints(docs, shingle), "fps")
    distinct = work.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("root")), "distinct")
    with large_rows(docs.sparkSession, 256):
        found = work.keep(links(work, distinct.select("fp"), radius), "links")
    labels = components(work, found)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("root").alias("component_id"))
    of = named.join(smallest, "label").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similar texts

#: Similar texts: words of a shingle, and bands of smallest hashes of the set of shingles. Two sets of Jaccard similarity j agree
#: in a band of r hashes with j ** r, wherever the edits stand: 32 bands of 5 miss 3 pairs in a million at 0.8, fewer above.
SHINGLE, BANDS, BAND = 5, 32, 5
SKETCH = "doc_id long, id long, keys array<long>"
#: Documents up to which the sets to compare are picked by a broadcast set of ids (16 bytes each).
BROADCAST_PAIRS = 500_000
#: Odd multipliers, one a hash function.
FACTORS = mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Per set of hashes a key a band: sets that agree in the smallest value of each of the band's functions share it."""
    sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
    if not sets:
        return np.zeros((0, BANDS), np.uint64)
    begin = np.cumsum([0, *[len(x) for x in sets[:-1]]])
    h, out = np.concatenate(sets), np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * BAND, band * BAND + BAND):
            key = mix(key + mix(np.minimum.reduceat(h * FACTORS[k], begin)))
        out[:, band] = key
    return out


def _shingled(batch: pa.RecordBatch):
    """Yields (rows, distinct shingles, number that all texts of the same shingles have) of a batch (doc_id, text)."""
    for at, n, data, offsets in passes(batch.column(1)):
        s, e, rows = words_in(data, offsets, SPACE_WORDS)
        h, cut = word_hashes(data, s, e, SPACE_WORDS), np.searchsorted(rows, np.arange(n + 1))
        own = (h[cut[i] : cut[i + 1]] for i in range(n))
        sets = [np.unique(grams(x, min(SHINGLE, max(len(x), 1)))) for x in own]
        ids = np.array([mix(x).sum(dtype=np.uint64) + np.uint64(len(x)) for x in sets], np.uint64)
        yield batch.slice(at, n), sets, int64(ids)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, id (of the set of shingles) and the set's keys, one a band.

    A shingle is five words, or all of them where there are fewer.
    """

    def work(it):
        for batch in it:
            for part, sets, ids in _shingled(batch):
                keys = pa.FixedSizeListArray.from_arrays(int64(band_keys(sets).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                yield batches({"doc_id": part.column(0), "id": ids, "keys": keys})

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text").mapInArrow(work, SKETCH)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, id and the distinct shingles as 32-bit hashes."""

    def work(it):
        for batch in it:
            for part, sets, ids in _shingled(batch):
                yield batches({"doc_id": part.column(0), "id": ids, "shingles": pa.array([x.astype(np.uint32).view(np.int32) for x in sets], pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, id long, shingles array<int>")


def sets_of(work: Workspace, docs: DataFrame, distinct: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of some ids of distinct (id, root), from the rows of docs whose doc_id is the root."""
    needed = work.keep(distinct.select("id", F.col("root").alias("doc_id")).join(ids.distinct(), "id"), "needed")
    few = needed.count() <= BROADCAST_PAIRS
    pick = F.broadcast(needed) if few else needed
    texts = docs.select("doc_id", "text").join(pick.select("doc_id"), "doc_id", "left_semi")
    return work.keep(shingle_sets(texts).join(pick, ["doc_id", "id"], "left_semi").select("id", "shingles"), "sets")


def exact_forest(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that, with equal labels, join the same ids as all pairs of that similarity would. Sets of equal labels aren't compared."""
    group, out, sizes = np.unique(labels, return_inverse=True)[1], [], np.array([len(x) for x in sets])
    begin, codes = np.cumsum([0, *sizes[:-1]]), np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.all() else None
    if codes is None:  # an empty set is like no other
        some = np.flatnonzero(sizes)
        return exact_forest(ids[some], labels[some], [sets[k] for k in some], similarity) if len(some) > 1 else []
    for x in range(len(ids) - 1):
        if (group[x + 1 :] == group[x]).all():
            continue
        mine = np.zeros(int(codes.max()) + 1, np.int32)
        mine[codes[begin[x] : begin[x] + sizes[x]]] = 1
        common = np.add.reduceat(mine[codes[begin[x + 1] :]], begin[x + 1 :] - begin[x + 1])
        like = common >= similarity * (sizes[x] + sizes[x + 1 :] - common)
        for y in (np.flatnonzero(like & (group[x + 1 :] != group[x])) + x + 1).tolist():
            if group[y] != group[x]:
                out.append((int(ids[x]), int(ids[y])))
                group[group == group[y]] = group[x]
    return out


def similar_links(work: Workspace, docs: DataFrame, distinct: DataFrame, similarity: float = 0.8, hot: int = 2, block: int = 512) -> DataFrame:
    """Links (a, b) between ids of distinct (id, root, keys) whose texts (the rows of docs with doc_id = root) are so similar.

    Candidates are ids under one key, and all are decided by their sets of shingles. Under keys of up to `hot` ids each pair is
    compared. Beyond, ids are compared with the key's smallest id first. What these links leave in several components is then
    dealt to pairs of blocks, each of which returns links that join the same ids as all its pairs.
    """
    keys = distinct.select("id", F.explode("keys").alias("key"))
    # Keys that the same ids have count once.
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("root"), F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("too")).where("n > 1")
    groups = groups.groupBy("n", "root", "who", "too").agg(F.min("key").alias("key")).select("key", "n", "root")
    members = work.keep(shuffled(keys).join(shuffled(groups), "key"), "members")
    pairs = members.where((F.col("id") != F.col("root")) & (F.col("n") > (hot if hot > 2 else 0))).select(F.col("root").alias("a"), F.col("id").alias("b"))
    if hot > 2:
        few = members.where(F.col("n") <= hot).select("key", "id")
        pairs = pairs.union(shuffled(few.withColumnRenamed("id", "a")).join(few.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b"))
    near = work.keep(pairs.distinct(), "near")
    sets = sets_of(work, docs, distinct, members.select("id"))
    both = shuffled(near).join(sets.selectExpr("id AS a", "shingles AS x"), "a").join(shuffled(sets.selectExpr("id AS b", "shingles AS y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    found = work.keep(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "found")
    crowded = members.where(F.col("n") > max(hot, 2))
    if not crowded.limit(1).count():
        return found
    labels = components(work, found, "part")
    items = crowded.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    items = work.keep(items, "items")
    blocks = items.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
    dealt = shuffled(items).join(blocks.where("low <> high").select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = shuffled(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).join(shuffled(sets), "id")
    tasks = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("id", "label", "shingles")).alias("items"))

    def compare(it):
        for batch in it:
            for group in batch.column(0):
                values = group.values
                ids, first = np.unique(values.field("id").to_numpy(), return_index=True)
                shingles = values.field("shingles")
                pairs = exact_forest(ids, values.field("label").to_numpy()[first], [shingles[int(k)].values.to_numpy() for k in first], similarity)
                x = np.array(pairs, np.int64).reshape(-1, 2)
                yield batches({"a": pa.array(x[:, 0]), "b": pa.array(x[:, 1])})
        release()

    return found.union(tasks.select("items").mapInArrow(compare, "a long, b long"))


def similar_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links between similar texts (equal ones included).

    Null and empty texts have no words and are equal. Rows of null doc_id are left out. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "simhash-similar")
    docs = docs.where("doc_id IS NOT NULL")
    made = work.keep(sketches(docs), "sketches")
    distinct = work.keep(made.groupBy("id").agg(F.min("doc_id").alias("root"), F.first("keys").alias("keys")), "distinct")
    found = similar_links(work, docs, distinct, similarity)
    with large_rows(docs.sparkSession):
        found = work.keep(found, "links")
    labels = components(work, found)
    named = distinct.select("id", "root").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = named.groupBy("label").agg(F.min("root").alias("component_id"))
    return made.select("doc_id", "id").join(named.join(smallest, "label").select("id", "component_id"), "id").select("doc_id", "component_id")


def copy_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links of either kind: fingerprints that differ in three bits or
    fewer (near_duplicates), and similar texts (similar_groups), which may stand further apart.

    Rows of null doc_id are left out. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "simhash-groups")
    docs = docs.where("doc_id IS NOT NULL")
    near = near_duplicates(docs).selectExpr("doc_id", "component_id AS a")
    both = work.keep(near.join(similar_groups(docs, similarity).withColumnRenamed("component_id", "b"), "doc_id"), "both")
    labels = components(work, both.select("a", "b"))
    named = both.join(labels.withColumnRenamed("node", "b"), "b", "left")
    return named.select("doc_id", F.coalesce("label", "b").alias("component_id"))


def keep_first(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without all but the smallest doc_id of each of their copy_groups.

    Rows of null doc_id can't be told apart and stay. Of rows that repeat a doc_id one stays (the smallest by its text's hash).
    """
    work = Workspace(docs.sparkSession, "simhash-keep")
    found = work.keep(copy_groups(docs, similarity), "found")
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("doc_id <> least").select("doc_id")
    kept = drop_ids(docs, work.keep(gone, "gone"))
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count():
        again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
        first = again.groupBy("doc_id").agg(F.min_by(F.struct(*again.columns), F.xxhash64("text")).alias("row"))
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(first.select("row.*").select(*docs.columns))
    return kept


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
