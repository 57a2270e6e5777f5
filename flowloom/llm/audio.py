"""Chroma fingerprints of audio and their alignment (operator 5).

A recording is 16-bit PCM in WAV of any rate, brought to one rate first. Frames of its spectrum are folded to twelve pitch classes; an integral image over
(frame, pitch class) gives the sums that sixteen filters compare; each comparison is quantised to two bits (Gray code), and
a frame's sixteen make one 32-bit integer. Two recordings align where their equal integers agree on one offset: votes are
counted by offset, and the best offset is verified by the share of differing bits over the overlap.

Recordings with equal fingerprints are one class, searched once. A pair of a query and a class that share an integer is compared
in one way, whichever integer brought them together: the histogram of offsets over all their equal integers gives the offset. An
integer that more than `HOT` classes hold isn't joined: the classes that hold it are dealt to blocks of bounded size and meet the
queries there, so no pair is lost and no result depends on `HOT`.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batches, large_rows, table

RATE, FRAME, HOP = 4000, 1024, 256
LOW_HZ, HIGH_HZ = 60.0, 1800.0
#: Bounds between the four levels of a filter's log ratio.
LEVELS = (-0.35, 0.0, 0.35)
#: Filters (kind, first pitch class, pitch classes, frames): made by rule, halves and thirds along either axis at several sizes.
FILTERS = tuple((i % 4, (i * 5) % 12 - (i * 5) % 12 % 2, (4, 6, 8, 12)[i // 4], (4, 8, 12, 6)[(i * 3) % 4]) for i in range(16))
SPAN = max(f[3] for f in FILTERS)
#: A match overlaps the query by this share of its frames at least, and differs in this share of bits at most.
OVERLAP, ERROR = 0.5, 0.25
HOT, BLOCK = 256, 512
#: Frames, or samples of another rate, that are worked on at once; and equal pairs of frames, which beyond are counted by a transform.
PART, PAIRS = 2048, 1 << 18
QUERY = 50


# ---------------------------------------------------------------- fingerprint


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1 (channels averaged) and the sampling rate; nothing for what isn't 16-bit PCM WAV."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            if f.getsampwidth() != 2:
                return np.zeros(0), RATE
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(float) / 32768
            return x[: len(x) // f.getnchannels() * f.getnchannels()].reshape(-1, f.getnchannels()).mean(axis=1), f.getframerate()
    except (wave.Error, EOFError, struct.error):
        return np.zeros(0), RATE


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_FOLDS: dict[int, np.ndarray] = {}


def _fold(rate: int) -> np.ndarray:
    """Spectrum bin to pitch class, as a matrix."""
    if rate not in _FOLDS:
        hz = np.fft.rfftfreq(FRAME, 1 / rate)
        m = np.zeros((len(hz), 12), np.float32)
        use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
        m[use, np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
        _FOLDS[rate] = m
    return _FOLDS[rate]


def resampled(samples: np.ndarray, rate: int) -> np.ndarray:
    """The samples at RATE, by windowed sinc functions that cut what the lower of both rates can't hold; a part at a time."""
    if rate == RATE or not len(samples) or rate <= 0:
        return samples
    n, band = int(len(samples) * RATE / rate), min(1.0, RATE / rate)
    half = int(np.ceil(16 / band))
    padded, out = np.pad(samples, half + 1), np.empty(n)
    for at in range(0, n, PART):
        t = np.arange(at, min(at + PART, n)) * (rate / RATE)
        first = np.floor(t).astype(np.int64)
        near = np.arange(1 - half, half + 1)
        x = (first[:, None] + near) - t[:, None]
        out[at : at + len(t)] = (padded[first[:, None] + near + half + 1] * np.sinc(band * x) * band * (0.5 + 0.5 * np.cos(np.pi * x / (half + 1)))).sum(axis=1)
    return out


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of pitch-class energy, each of length one (silence stays zero); spectra are held for PART frames at a time."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames, window, fold = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP], np.hanning(FRAME).astype(np.float32), _fold(rate)
    image = np.concatenate([(np.abs(np.fft.rfft(frames[k : k + PART] * window, axis=1)) ** 2).astype(np.float32) @ fold for k in range(0, n, PART)])
    size = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(size > 1e-4, image / np.maximum(size, 1e-4), 0.0)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One unsigned 32-bit integer a frame that SPAN frames follow."""
    image = chroma(resampled(samples, rate), RATE)
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = np.cumsum(np.cumsum(np.hstack([image, image]), axis=0), axis=1)  # pitch classes go round
    at, out = np.arange(n), np.zeros(n, np.uint32)

    def box(t: int, p: int, frames: int, classes: int) -> np.ndarray:
        return total[at + t + frames, p + classes] - total[at + t, p + classes] - total[at + t + frames, p] + total[at + t, p]

    for i, (kind, p, height, width) in enumerate(FILTERS):
        half_w, half_h = width // 2, height // 2
        whole = box(0, p, width, height)
        if kind == 0:  # earlier against later
            a = box(0, p, half_w, height)
        elif kind == 1:  # lower against higher
            a = box(0, p, width, half_h)
        elif kind == 2:  # checkerboard
            a = box(0, p, half_w, half_h) + box(half_w, p + half_h, width - half_w, height - half_h)
        else:  # the middle pitch classes against those around them
            a = box(0, p + height // 4, width, half_h)
        ratio = np.log((1e-2 + a) / (1e-2 + np.maximum(whole - a, 0)))
        level = np.digitize(ratio, LEVELS)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * i)
    return out


def fingerprints(media: DataFrame, audio: str = "audio") -> DataFrame:
    """id and fp (the fingerprint as integers) of media (id, a binary WAV column); empty for null, short or malformed audio."""

    def work(it):
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                fps = [fingerprint(*decode_wav(x or b"")).view(np.int32) for x in part.column(1).to_pylist()]
                yield batches({"id": part.column(0), "fp": pa.array(fps, pa.list_(pa.int32()))})

    return media.select("id", F.col(audio).cast("binary").alias("audio")).mapInArrow(work, "id long, fp array<int>")


# ---------------------------------------------------------------- alignment


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Frames that overlap when a's frame i meets b's frame i + offset, and the share of differing bits there (1 if none do)."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo))


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many frames of a equal those of b at each offset from 1 - len(a) to len(b) - 1.

    Equal integers are found by sorting and counted PAIRS at a time. An integer that stands so often on both sides that its pairs are more
    (a steady tone) is counted by a Fourier transform of where it stands, so memory and time follow the lengths.
    """
    votes, back = np.zeros(len(a) + len(b) - 1, np.int64), len(a) - 1
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = right - left
    values, held = np.unique(a, return_counts=True)
    there = np.searchsorted(b[order], values, "right") - np.searchsorted(b[order], values, "left")
    often = values[held * there > PAIRS]
    if len(often):
        size = 1 << int(np.ceil(np.log2(len(votes) + 1)))
        for v in often:
            both = np.fft.irfft(np.fft.rfft((b == v).astype(float), size) * np.fft.rfft((a == v)[::-1].astype(float), size), size)
            votes += np.rint(both[: len(votes)]).astype(np.int64)
        count[np.isin(a, often)] = 0
    upto = np.cumsum(count)
    at = 0
    while at < len(a):
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        n = count[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        votes += np.bincount(order[np.repeat(left[at:stop], n) + within] - i + back, minlength=len(votes))
        at = stop
    return votes


def offset_of(a: np.ndarray, b: np.ndarray) -> int:
    """Where b's frames less a's agree most often on equal integers; of ties the offset nearest to none, then the smaller."""
    votes = offset_votes(a, b)
    offsets = np.flatnonzero(votes == votes.max()) - (len(a) - 1)
    return int(offsets[np.lexsort((offsets, np.abs(offsets)))[0]])


def aligned(query: int, a: np.ndarray, other: int, b: np.ndarray, error: float) -> list[tuple]:
    """The row of ALIGNED of two fingerprints that share an integer, if they match."""
    offset = offset_of(a, b)
    n, e = bit_error(a, b, offset)
    return [(query, other, offset, n, e)] if n >= OVERLAP * len(a) and e <= error else []


ALIGNED = "query long, class long, offset int, overlap int, error double"


def search(prints: DataFrame, queries: DataFrame, error: float = ERROR) -> DataFrame:
    """Classes of recordings (id, fp) that align with queries (id, fp).

    Rows: query (the smallest id among queries of equal fingerprint), class (the smallest id of the found class), copies
    (recordings of the class), offset (frame of the recording that meets the query's first), overlap (frames), error.
    """
    work = Workspace(prints.sparkSession, "audio")
    classes = work.keep(prints.groupBy("fp").agg(F.min("id").alias("class"), F.count("*").alias("copies")).where(F.size("fp") > 0), "classes")
    asked = work.keep(queries.groupBy("fp").agg(F.min("id").alias("query")).where(F.size("fp") > 0), "asked")
    entries = classes.select("class", F.posexplode("fp").alias("b", "v"))
    probes = asked.select("query", F.posexplode("fp").alias("a", "v"))
    heavy = work.keep(entries.select("class", "v").distinct().groupBy("v").count().where(F.col("count") > HOT).select("v", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    crowded = heavy.limit(1).count() > 0
    cold = (lambda x: x.join(heavy.select("v"), "v", "left_anti")) if crowded else (lambda x: x)
    met = cold(probes.select("query", "v").distinct()).join(entries.select("class", "v").distinct(), "v").select("query", "class").distinct()
    pairs = met.join(asked.selectExpr("query", "fp AS x"), "query").join(classes.selectExpr("class", "fp AS y"), "class")

    def verify(it):
        for batch in it:
            rows = []
            for q, c, x, y in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), batch.column(3)):
                rows += aligned(q, x.values.to_numpy().view(np.uint32), c, y.values.to_numpy().view(np.uint32), error)
            yield _aligned(rows)

    found = pairs.select("query", "class", "x", "y").mapInArrow(verify, ALIGNED)
    if crowded:
        salt = lambda c: F.pmod(F.xxhash64(c), "blocks")
        held = entries.select("class", "v").distinct().join(heavy, "v").withColumn("i", salt("class")).join(classes.select("class", "fp"), "class")
        held = held.groupBy("v", "i").agg(F.collect_list(F.struct("class", "fp")).alias("es"))
        # Queries of a hot integer go to each of its blocks, a block of them at a time.
        q = probes.select("query", "v").distinct().join(heavy, "v").withColumn("j", salt("query")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        q = q.join(asked.select("query", "fp"), "query").groupBy("v", "i", "j").agg(F.collect_list(F.struct("query", "fp")).alias("qs"))

        def compare(it):
            array = lambda x: np.array(x, np.int32).view(np.uint32)
            for batch in it:
                for qs, es in zip(*(c.to_pylist() for c in batch.columns)):
                    es, rows = [(e["class"], array(e["fp"])) for e in es], []
                    for q in qs:
                        x = array(q["fp"])
                        for c, y in es:
                            rows += aligned(q["query"], x, c, y, error)
                    yield _aligned(rows)

        found = found.union(q.join(held, ["v", "i"]).select("qs", "es").mapInArrow(compare, ALIGNED))
        found = found.distinct()  # a pair that several integers bring together gives one row, each time the same
    with large_rows(prints.sparkSession):
        found = work.keep(found, "found")
    return found.join(classes.select("class", "copies"), "class").select("query", "class", "copies", "offset", "overlap", "error")


def _aligned(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    return batches({c.split()[0]: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(ALIGNED.split(", "), kinds))})


# ---------------------------------------------------------------- query

NOTE = 512


def render(vector: list[float] | None) -> bytes:
    """A vector as sound: each component a note of two pitches, chosen by its value; the same vector gives the same bytes."""
    x = np.nan_to_num(np.array([0.0 if v is None else v for v in ([] if vector is None else vector)], float))
    if not len(x):
        return encode_wav(np.zeros(0))
    keys = 45 + np.round(np.clip(x / (np.abs(x).max() + 1e-9), -1, 1) * 17 + 17).astype(int)
    hz = 440.0 * 2 ** ((keys - 69) / 12)
    t, fade = np.arange(NOTE) / RATE, np.minimum(1, np.minimum(np.arange(NOTE), np.arange(NOTE)[::-1]) / 32)
    tone = np.sin(2 * np.pi * hz[:, None] * t) + 0.5 * np.sin(2 * np.pi * 1.5 * hz[:, None] * t)
    return encode_wav((0.5 * tone * fade).ravel())


def rendered(vectors: DataFrame, excerpt: bool = False) -> DataFrame:
    """id and audio of vectors (vec_id, embedding): the media column of a corpus that has none; or its middle half, in 8 bits."""

    def sound(x):
        whole = render(x)
        if not excerpt:
            return whole
        samples, rate = decode_wav(whole)
        return encode_wav(np.round(samples[len(samples) // 4 : len(samples) * 3 // 4] * 127) / 127, rate)

    def work(it):
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield batches({"id": part.column(0), "audio": pa.array([sound(x) for x in part.column(1).to_pylist()], pa.binary())})

    # Few files of small rows become much work: rows are dealt to all tasks first.
    dealt = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(work, "id long, audio binary")


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's fingerprint class, and what aligns with the queries: excerpts of the ids divisible by QUERY.

    Rows of kind "member" have id, class and copies; of kind "match" id (the query), class, copies, offset, overlap, error.
    """
    work, vectors = Workspace(spark, "op5"), table(spark, sf_dir, "embeddings")
    prints = work.keep(fingerprints(rendered(vectors)), "prints")
    queries = work.keep(fingerprints(rendered(vectors.where(F.col("vec_id") % QUERY == 0), excerpt=True)), "queries")
    member = prints.join(prints.groupBy("fp").agg(F.min("id").alias("class"), F.count("*").alias("copies")), "fp")
    member = member.selectExpr("'member' AS kind", "id", "class", "copies", "CAST(NULL AS int) AS offset", "size(fp) AS overlap", "CAST(NULL AS double) AS error")
    return member.union(search(prints, queries).selectExpr("'match' AS kind", "query AS id", "class", "copies", "offset", "overlap", "error"))
