"""Token ids as binary segments with Elias-Fano document boundaries (operator 1)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batches, passes, table, word_hashes

VOCABULARY = "byte_bpe_50k.json"
#: A segment is closed when it holds this many ids (it always holds whole documents).
SEGMENT_IDS = 1 << 21
#: Segment starts (24 bytes each) are broadcast to the reader up to this many; beyond, they are joined by a shuffle.
BROADCAST_SEGMENTS = 500_000
#: Bytes of encoded pieces that a worker keeps, half of them from one task to the next.
CACHE_BYTES = 64 << 20
#: Longer pieces are encoded as they come and not kept.
LONGEST_PIECE = 64
#: Bytes that may follow the space or line end at which a piece begins: no white space, nor the first of one's UTF-8.
_FOLLOWS = np.ones(256, bool)
_FOLLOWS[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_CUTS = np.isin(np.arange(256), [0x0A, 0x20, 0x2C, 0x2E])
#: Two readings of a byte, for two hashes of a piece.
_READINGS = [(None, np.arange(256, dtype=np.uint8)), (None, np.random.default_rng(1).permutation(256).astype(np.uint8))]


class Pieces:
    """Ids of pieces by two 64-bit hashes: open addressing over arrays, all pieces of a call looked up at once."""

    def __init__(self, slots: int = 1 << 12):
        self.key, self.check, self.row = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.hashes, self.start = np.zeros((2, slots // 2), np.uint64), np.zeros(slots // 2 + 1, np.int32)
        self.ids, self.n = np.zeros(slots * 2, "<u4"), 0

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.key, self.check, self.row, self.hashes, self.start, self.ids))

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Each piece's row, -1 where it isn't held."""
        mask = np.uint64(len(self.key) - 1)
        slot = (key & mask).astype(np.int64)
        out = self.row[slot]
        todo = np.flatnonzero((out >= 0) & ((self.key[slot] != key) | (self.check[slot] != check)))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & int(mask)
            out[todo] = row = self.row[slot]
            on = (row >= 0) & ((self.key[slot] != key[todo]) | (self.check[slot] != check[todo]))
            todo, slot = todo[on], slot[on]
        return out

    def _place(self, rows: np.ndarray) -> None:
        key, check = self.hashes[:, rows]
        mask = len(self.key) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = np.flatnonzero(self.row[slot] < 0)
            self.row[slot[free]] = rows[free]  # of several that want a slot the last has it
            won = self.row[slot] == rows
            self.key[slot[won]], self.check[slot[won]] = key[won], check[won]
            on = ~won
            rows, key, check, slot = rows[on], key[on], check[on], (slot[on] + 1) & mask

    def add(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Takes in distinct pieces that aren't held, with their ids one after the other."""
        total, end = self.n + len(key), int(self.start[self.n])
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:end], np.zeros(max(len(self.ids) // 2, len(ids)) + len(ids), "<u4")])
        grow = total > len(self.key) // 2
        if grow:
            slots = 1 << (2 * total).bit_length()
            self.key, self.check, self.row = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
            self.hashes = np.concatenate([self.hashes[:, : self.n], np.zeros((2, slots // 2 - self.n), np.uint64)], axis=1)
            self.start = np.concatenate([self.start[: self.n + 1], np.zeros(slots // 2 - self.n, np.int32)])
        self.hashes[0, self.n : total], self.hashes[1, self.n : total] = key, check
        self.start[self.n + 1 : total + 1] = end + np.cumsum(sizes)
        self.ids[end : end + len(ids)] = ids
        rows = np.arange(0 if grow else self.n, total, dtype=np.int32)
        self.n = total
        self._place(rows)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each row has, and the ids of all, one row after the other."""
        start = self.start[rows].astype(np.int64)
        sizes = self.start[rows + 1] - start
        ends = np.cumsum(sizes)
        return sizes, self.ids[np.repeat(start - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """tokenizers' ids of whole texts, as little-endian unsigned 32-bit bytes.

    The byte-level pattern always begins a token at a space that a non-space follows, at a line end between non-spaces, and at
    a comma or full stop after a letter or digit; what stands before encodes as it does alone. So a text falls into pieces at
    such places (those of its bytes that show it by themselves); each distinct piece is encoded once by the library (many in
    one call, and cut by the bytes that each id stands for) and kept. White space that stands together stays in one piece.

    Pieces are kept in two generations of half the room each: when the younger is full it becomes the older, whose pieces come
    back as they are met again, so frequent pieces stay and rare ones go. rest() lets go of the older one, as tasks do at their end.
    """

    def __init__(self, vocabulary: str = VOCABULARY, room: int = CACHE_BYTES):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.room = Tokenizer.from_file(public_tokenizers.path(vocabulary)), room
        self.young, self.older = Pieces(), None
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = added.get(i, len(token))  # the vocabulary writes each byte as one character

    def rest(self) -> None:
        self.older = None

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts that stand one after the other; each text that isn't empty begins one."""
        at = np.flatnonzero(_CUTS[data])
        own, first, last = data[at], np.zeros(len(data), bool), np.zeros(len(data), bool)
        begin, end = offsets[:-1], offsets[1:]
        some = begin < end
        first[begin[some]], last[end[some] - 1] = True, True
        after = np.where(last[at], 0x20, data[np.minimum(at + 1, len(data) - 1)])
        before = np.where(first[at], 0x20, data[np.maximum(at - 1, 0)])
        follows = _FOLLOWS[after]
        good = (own == 0x20) & follows | (own == 0x0A) & follows & _FOLLOWS[before] & (before < 0x80) | (own > 0x20) & _ALNUM[before] & ((after == 0x20) | (after == 0x0A))
        first[at[good]] = True
        return np.flatnonzero(first)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The pieces' places in another order, how many ids each has then, and the ids of all."""
        follows = _FOLLOWS.tolist()
        joins = [x[0] in b" \n" and len(x) > 1 and follows[x[1]] for x in raw]
        texts = [x.decode() for x in raw]
        joined = "".join([x for x, j in zip(texts, joins) if j])
        if any(t in joined for t in self.added):  # such a token ends what stands before it, so its piece is encoded alone
            joins = [j and not any(t in x for t in self.added) for x, j in zip(texts, joins)]
        places, alone = [i for i, j in enumerate(joins) if j], [i for i, j in enumerate(joins) if not j]
        sizes, ids = [], self._ids(["".join([texts[i] for i in places[k : k + 64]]) for k in range(0, len(places), 64)])
        if places:
            ends = np.cumsum(self.sizes[np.concatenate(ids)])
            sizes.append(np.diff(np.searchsorted(ends, np.cumsum([len(raw[i]) for i in places]), "left") + 1, prepend=0))
        if alone:
            own = self._ids([texts[i] for i in alone])
            sizes.append(np.array([len(x) for x in own]))
            ids += own
        return places + alone, np.concatenate(sizes), np.concatenate(ids)

    def _rows(self, key: np.ndarray, check: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces' rows in the younger generation, which has them all afterwards."""
        rows = self.young.find(key, check)
        new = np.flatnonzero(rows < 0)
        if not len(new):
            return rows
        if self.young.nbytes() > self.room // 2:
            self.young, self.older = Pieces(), self.young
            new = np.arange(len(key))
        kept = new[np.unique(key[new], return_index=True)[1]]
        if self.older is not None:
            held = self.older.find(key[kept], check[kept])
            back = kept[held >= 0]
            self.young.add(key[back], check[back], *self.older.gather(held[held >= 0]))
            kept = kept[held < 0]
        if len(kept):
            raw = data.tobytes()
            order, sizes, ids = self._learn([raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())])
            self.young.add(key[kept[order]], check[kept[order]], sizes, ids)
        rows[new] = self.young.find(key[new], check[new])
        # Pieces of one key and another check, if there ever are any.
        return rows if (rows >= 0).all() else self._rows(key, check, data, starts, ends)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each of the texts that stand one after the other, from offset to offset, as UTF-8."""
        n = len(offsets) - 1
        if not len(data):
            return [b""] * n
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        short = ends - starts <= LONGEST_PIECE
        s, e = starts[short], ends[short]
        rows = self._rows(*(word_hashes(data, s, e, x) for x in _READINGS), data, s, e)
        sizes, ids = self.young.gather(rows)
        if not short.all():
            most = np.flatnonzero(~short)
            long = [x for i in range(0, len(most), 8) for x in self._ids([data[starts[k] : ends[k]].tobytes().decode() for k in most[i : i + 8]])]
            parts, at = [], 0
            cut = np.concatenate([[0], np.cumsum(sizes)])
            for k, x in zip((most - np.arange(len(most))).tolist(), long):
                parts += [ids[cut[at] : cut[k]], x]
                at = k
            ids, all_sizes = np.concatenate([*parts, ids[cut[at] :]]), np.empty(len(starts), np.int64)
            all_sizes[short], all_sizes[~short] = sizes, [len(x) for x in long]
            sizes = all_sizes
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = (upto[np.searchsorted(starts, offsets)] * 4).tolist()
        raw = ids.astype("<u4", copy=False).tobytes()
        return [raw[x:y] for x, y in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x for _, _, data, offsets in passes(pa.array(texts, pa.large_string())) for x in self.ids(data, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this worker process. A task that is done with it calls its rest(): workers outlive their tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence of n integers below a universe in about 2 + log2(universe / n) bits each.

    Each value's low bits are stored as they are; the high bits, in unary, make a bitmap of n ones. The places of every 256th
    one are stored beside it (an eighth of a bit a value), so select reads the stretch of the bitmap from one sample to the next.
    """

    SAMPLE = 256

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits, places = np.zeros((int(values[-1]) >> low_bits) + n + 1 if n else 1, np.uint8), (values >> low_bits) + np.arange(n)
        bits[places] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), places[:: cls.SAMPLE].astype("<u4").tobytes())

    def __len__(self) -> int:
        return len(self.samples)

    def block(self, k: int) -> np.ndarray:
        """The k-th SAMPLE values (fewer at the end), from the stretches of the two bit strings that hold them."""
        first, place = k * self.SAMPLE, int(self.samples[k])
        n = min(self.SAMPLE, self.n - first)
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, (stop + 7) // 8 - place // 8, place // 8), bitorder="little")[place % 8 :]
        high = np.flatnonzero(bits)[:n] + place - np.arange(first, first + n)
        if not self.low_bits:
            return high
        begin, end = first * self.low_bits, (first + n) * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8, (end + 7) // 8 - begin // 8, begin // 8), bitorder="little")[begin % 8 :]
        low = bits[: n * self.low_bits].reshape(n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (high << self.low_bits) | low

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // self.SAMPLE)[i % self.SAMPLE])

    def values(self) -> np.ndarray:
        """All values at once."""
        return np.concatenate([np.zeros(0, np.int64), *(self.block(k) for k in range(len(self)))])


# ---------------------------------------------------------------- files

SEGMENTS = "shard int, segment int, n_docs long, n_ids long, width int, doc_ids array<long>, low_bits int, low binary, high binary, samples binary, ids binary"


def _segment(shard: int, number: int, docs: list, ids: list[bytes]) -> dict[str, pa.Array]:
    raw = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(raw) or raw.max() < 1 << 16 else 4
    bounds = EliasFano.of(np.cumsum([len(x) // 4 for x in ids]))
    return {
        "shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "n_docs": pa.array([len(docs)], pa.int64()),
        "n_ids": pa.array([len(raw)], pa.int64()), "width": pa.array([width], pa.int32()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
        "low_bits": pa.array([bounds.low_bits], pa.int32()), "low": pa.array([bounds.low], pa.binary()), "high": pa.array([bounds.high], pa.binary()), "samples": pa.array([bounds.samples.tobytes()], pa.binary()),
        "ids": pa.array([raw.astype(f"<u{width}").tobytes()], pa.binary()),
    }


def write_ids(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str = VOCABULARY, partitions: int = 0) -> None:
    """Encodes docs (doc_id, text) and writes segments below path, in ascending doc_id order over (shard, segment).

    One range shuffle on (doc_id, hash of the text) orders the rows; repeated doc_ids stay together in no promised order
    but by that hash, and spread over shards where one holds many rows. A segment row holds at most SEGMENT_IDS ids and one
    document: the ids as 16-bit (32-bit where an id needs it) little-endian integers, the document ends as Elias-Fano.
    Null text: only the end id. Null doc_id sorts first. An empty table writes an empty dataset. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(it):
        from pyspark import TaskContext

        shard, number, words, end = TaskContext.get().partitionId(), 0, encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        held_docs, held, size = [], [], 0
        for batch in it:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, n, data, offsets in passes(texts):
                for d, x in zip(doc_ids[at : at + n], words.ids(data, offsets)):
                    x += end
                    if held and size + len(x) // 4 > SEGMENT_IDS:
                        yield batches(_segment(shard, number, held_docs, held))
                        number, held_docs, held, size = number + 1, [], [], 0
                    held_docs.append(d)
                    held.append(x)
                    size += len(x) // 4
        words.rest()
        if held:
            yield batches(_segment(shard, number, held_docs, held))

    rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(encode, SEGMENTS).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a dataset of write_ids: doc_id, start (ids before it), n_tokens, ids (unsigned 32-bit, little-endian)."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids binary", lambda x: pa.array([v.astype("<u4").tobytes() for v in x], pa.binary()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with the ids' crc32 in place of the ids."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda x: pa.array([zlib.crc32(v.astype("<u4").tobytes()) for v in x], pa.int64()))


def _read(spark: SparkSession, path: str, schema: str, last) -> DataFrame:
    from pyspark.sql import Window

    segments = spark.read.schema(SEGMENTS).parquet(path)
    # A row a segment, of two million ids: the running sum is over a table a million times smaller than the ids. It goes
    # by shard first, so that the single ordered window has a row a shard.
    counts = segments.select("shard", "segment", "n_ids")
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    starts = counts.withColumn("inside", inside).join(shards, "shard").select("shard", "segment", (F.col("before") + F.col("inside")).alias("first"))
    name = schema.split(", ")[-1].split()[0]

    def decode(it):
        for batch in it:
            names = [c for c in batch.schema.names if c not in ("ids", "doc_ids")]
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in names}
                ends = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                raw, before, documents = np.frombuffer(batch.column("ids")[i].as_buffer(), f"<u{row['width']}"), 0, batch.column("doc_ids")[i].values
                for k in range(len(ends)):  # the boundaries of SAMPLE documents at a time, never a table of all
                    stop = ends.block(k)
                    begin, before = np.concatenate([[before], stop[:-1]]), int(stop[-1])
                    yield batches({"doc_id": documents.slice(k * ends.SAMPLE, len(stop)), "start": pa.array(begin + row["first"], pa.int64()), "n_tokens": pa.array(stop - begin, pa.int64()), name: last([raw[s:e] for s, e in zip(begin, stop)])})

    if counts.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    return segments.join(starts, ["shard", "segment"]).mapInArrow(decode, schema)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'op1').path}/ids"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
