"""Capture files as a Spark data source: spark.read.format("pcap").load(path), batch and stream, and df.write.format("pcap").

Read: a partition is a file; records come as Arrow batches while the file is read, never the whole file. Classic pcap (both byte
orders, micro- and nanoseconds) and pcapng (enhanced and simple packet blocks, per-interface resolution) over Ethernet
(with VLAN tags), raw IP, Linux cooked capture and loopback. Filters on ts_us and proto are applied while parsing. The option
"frames" adds each packet's bytes and link type. Paths may be URIs of any store that Arrow's file systems know.

Stream: an offset is the size of each file, so a file that grows is read on from there; a packet belongs to the micro-batch
in which its last byte came. A micro-batch reads its files in parallel, on the executors. The driver only skips from packet
to packet through what earlier batches read of the files that grew, to know where a new packet begins. "max_bytes" bounds what a
micro-batch takes. At most `OPEN_FILES` files, the last by name, are watched for growth; older ones are done once they stopped growing.

Write: rows of ts_us, frame (and link, one a file) become a capture file a task, which appear together when all tasks are done.
"""

from __future__ import annotations

import io
import ipaddress
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage

SCHEMA = "capture string, pkt_no long, ts_us long, src string, dst string, sport int, dport int, flags int, payload_len int, proto string, frame_len int, ip_version int, frag boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([pa.field(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
FRAMES = ", frame binary, link int"
BATCH, BUFFER = 8192, 1 << 20
OPEN_FILES = 1000
# Link types and numbers of the formats.
ETHERNET, RAW, LOOPBACK, COOKED = 1, (12, 14, 101), (0, 108), 113
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP"}


@dataclass
class Mark:
    """A place between two packets of a capture: its byte, the packets before it, and what its headers said so far."""

    at: int = 0
    number: int = 0
    order: str = ""
    scale: int = 0  # of classic captures: how many of its time units make a microsecond
    links: list = field(default_factory=list)  # (link type, time units a second) of each interface


def walk(f, mark: Mark, stop: int | None = None, bodies: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
    """(time in microseconds, original length, link type, captured bytes) of the packets from mark on that end at byte `stop` at most.

    Moves mark behind each packet; one that isn't there whole yet is left for later. Without bodies these are skipped and empty.
    """
    f.seek(mark.at)
    if not mark.order:
        head = f.read(24)
        if stop is not None and len(head) > stop:
            head = head[:stop]
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            f.seek(0)
        else:
            found = [o for o in "<>" if len(head) >= 4 and struct.unpack(o + "I", head[:4])[0] in (0xA1B2C3D4, 0xA1B23C4D)]
            if len(head) >= 4 and not found:
                raise ValueError("not a capture file")
            if len(head) < 24:
                return
            mark.order, mark.at = found[0], 24
            mark.scale = 1000 if struct.unpack(mark.order + "I", head[:4])[0] == 0xA1B23C4D else 1
            mark.links = [(struct.unpack(mark.order + "I", head[20:])[0] & 0xFFFF, 0)]
    yield from _classic(f, mark, stop, bodies) if mark.scale else _blocks(f, mark, stop, bodies)


def _body(f, size: int, bodies: bool) -> bytes | None:
    """The next bytes, or None where they aren't all there."""
    if bodies:
        data = f.read(size)
        return data if len(data) == size else None
    if size:
        f.seek(size - 1, io.SEEK_CUR)
        if not f.read(1):
            return None
    return b""


def _classic(f, mark: Mark, stop: int | None, bodies: bool) -> Iterator[tuple[int, int, int, bytes]]:
    link = mark.links[0][0]
    while len(h := f.read(16)) == 16:
        sec, sub, kept, size = struct.unpack(mark.order + "IIII", h)
        end = mark.at + 16 + kept
        if stop is not None and end > stop or (data := _body(f, kept, bodies)) is None:
            return
        mark.at, mark.number = end, mark.number + 1
        yield sec * 1_000_000 + sub // mark.scale, size, link, data


def _blocks(f, mark: Mark, stop: int | None, bodies: bool) -> Iterator[tuple[int, int, int, bytes]]:
    while len(head := f.read(12)) == 12:
        section = head[:4] == b"\x0a\x0d\x0d\x0a"
        order = ("<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">") if section else mark.order
        kind, total = struct.unpack(order + "II", head[:8])
        if total < 12:
            raise ValueError("not a capture file")
        end = mark.at + total
        packet = kind in (3, 6)
        if stop is not None and end > stop or (rest := _body(f, total - 12, bodies or not packet)) is None:
            return
        body, links = (head[8:] + rest)[:-4], mark.links
        mark.at = end
        if section:
            mark.order, mark.links = order, []
        elif kind == 1:
            mark.links = [*links, (struct.unpack(order + "H", body[:2])[0], _resolution(order, body[8:]))]
        elif packet and links:
            mark.number += 1
            if not bodies:
                yield 0, 0, 0, b""
            elif kind == 6:
                at, high, low, kept, size = struct.unpack(order + "IIIII", body[:20])
                link, unit = links[at]
                yield ((high << 32 | low) * 1_000_000) // unit, size, link, body[20 : 20 + kept]
            else:
                size = struct.unpack(order + "I", body[:4])[0]
                yield 0, size, links[0][0], body[4 : 4 + size]


def _resolution(order: str, options: bytes) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == 9 and size:
            x = options[at + 4]
            return 1 << (x & 0x7F) if x & 0x80 else 10**x
        if not code:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def decode(link: int, data: bytes) -> tuple:
    """(src, dst, sport, dport, flags, payload_len, proto, ip_version, frag); nulls for what the frame doesn't have."""
    none = (None,) * 7 + (None, False)
    if link == ETHERNET:
        at, kind = 14, data[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = data[at + 2 : at + 4], at + 4
        if kind not in (b"\x08\x00", b"\x86\xdd"):
            return none
    elif link in RAW:
        at = 0
    elif link in LOOPBACK:
        at = 4
    elif link == COOKED:
        at = 16
    else:
        return none
    ip = data[at:]
    version = ip[0] >> 4 if ip else 0
    if version == 4 and len(ip) >= 20:
        header = (ip[0] & 15) * 4
        total, fragment = struct.unpack(">H", ip[2:4])[0], struct.unpack(">H", ip[6:8])[0]
        src, dst, number, body, size = str(ipaddress.IPv4Address(ip[12:16])), str(ipaddress.IPv4Address(ip[16:20])), ip[9], ip[header:], total - header
        frag, offset = bool(fragment & 0x3FFF), fragment & 0x1FFF
    elif version == 6 and len(ip) >= 40:
        src, dst, number, body, size = str(ipaddress.IPv6Address(ip[8:24])), str(ipaddress.IPv6Address(ip[24:40])), ip[6], ip[40:], struct.unpack(">H", ip[4:6])[0]
        frag, offset = False, 0
    else:
        return none
    name = PROTOCOLS.get(number) if not offset else None
    if name == "TCP" and len(body) >= 14:
        sport, dport = struct.unpack(">HH", body[:4])
        return src, dst, sport, dport, body[13], size - (body[12] >> 4) * 4, name, version, frag
    if name == "UDP" and len(body) >= 4:
        sport, dport = struct.unpack(">HH", body[:4])
        return src, dst, sport, dport, None, None, name, version, frag
    if name == "ICMP" and version == 4:
        return src, dst, 0, 0, None, None, name, version, frag
    return src, dst, None, None, None, None, None, version, frag


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path there, of a URI or a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str) -> dict[str, int]:
    """Sizes of the captures in a folder, or of a file, by name."""
    store, place = _store(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.Directory:
        found = [x for x in store.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.base_name.endswith((".pcap", ".pcapng", ".cap"))]
        return {x.base_name: x.size for x in sorted(found, key=lambda x: x.base_name)}
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return {"": info.size}


def _open(path: str, name: str = ""):
    store, place = _store(path)
    return io.BufferedReader(store.open_input_file(f"{place}/{name}" if name else place), BUFFER)


def batches(path: str, since: int | None = None, protos: set[str] | None = None, name: str = "", mark: Mark | None = None, stop: int | None = None, frames: bool = False) -> Iterator[pa.RecordBatch]:
    """Packets of a capture, or of the file `name` in a folder, from mark on up to byte `stop`."""
    mark, capture = Mark() if mark is None else replace(mark), name or os.path.basename(path)
    kinds = [f.type for f in ARROW] + ([pa.binary(), pa.int32()] if frames else [])
    names = NAMES + (["frame", "link"] if frames else [])
    cols: list[list] = [[] for _ in names]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
    with _open(path, name) as f:
        for ts, size, link, data in walk(f, mark, stop):
            if since is not None and ts < since:
                continue
            src, dst, sport, dport, flags, payload, proto, version, frag = decode(link, data)
            if protos is not None and proto not in protos:
                continue
            row = (capture, mark.number - 1, ts, src, dst, sport, dport, flags, payload, proto, size, version, frag)
            for c, v in zip(cols, (*row, data, link) if frames else row):
                c.append(v)
            if len(cols[0]) == BATCH:
                yield batch()
                cols = [[] for _ in names]
    if cols[0]:
        yield batch()


@dataclass
class Part(InputPartition):
    """Packets of a file from mark on that end at byte `stop` at most."""

    name: str
    mark: Mark
    stop: int | None = None


def _wants_frames(options: dict) -> bool:
    return str(options.get("frames", "false")).lower() == "true"


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.frames, self.since, self.protos = options["path"], _wants_frames(options), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThanOrEqual, GreaterThan)) and f.attribute == ("ts_us",):
                self.since = max(self.since or 0, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, EqualTo) and f.attribute == ("proto",):
                self.protos = {f.value} if self.protos is None else self.protos & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Part(name, Mark()) for name in _files(self.path)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, self.since, self.protos, partition.name, frames=self.frames)


class PcapStream(DataSourceStreamReader):
    """Offsets are {"done": name, "sizes": {name: bytes}}: files up to `done` by name are not looked at again."""

    def __init__(self, options: dict):
        self.path, self.frames = options["path"], _wants_frames(options)
        self.limit = int(options["max_bytes"]) if "max_bytes" in options else None
        self.last: dict | None = None  # the offset before; unknown after a restart, until its last batch is planned again
        self.marks: dict[str, Mark] = {}  # where the driver has skipped to

    def initialOffset(self) -> dict:
        self.last = {"done": "", "sizes": {}}
        return self.last

    def latestOffset(self) -> dict:
        known, done = (self.last or {}).get("sizes", {}), (self.last or {}).get("done", "")
        there = {n: s for n, s in _files(self.path).items() if not done or n > done}
        sizes, room = {}, None if self.limit is None or self.last is None else self.limit
        for name, size in there.items():
            before = known.get(name, 0)
            if room is not None:
                size = min(size, before + room)
                room -= max(size - before, 0)
            if size or before:
                sizes[name] = max(size, before)
        still = sorted(n for n, s in sizes.items() if known.get(n) == s == there[n])
        for name in sorted(sizes)[: max(len(sizes) - OPEN_FILES, 0)]:
            if name not in still:
                break
            done = name
            del sizes[name]
        self.last = {"done": done, "sizes": sizes}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.last is None:
            self.last = end
        out = []
        for name, size in end["sizes"].items():
            before = start["sizes"].get(name, 0)
            if size > before:
                mark = self.marks.setdefault(name, Mark())
                if mark.at > before:  # a batch is planned again
                    mark = self.marks[name] = Mark()
                if before:
                    with _open(self.path, name) as f:
                        for _ in walk(f, mark, before, bodies=False):
                            pass
                out.append(Part(name, replace(mark), size))
        self.marks = {n: m for n, m in self.marks.items() if n in end["sizes"]}
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, name=partition.name, mark=partition.mark, stop=partition.stop, frames=self.frames)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


def _header(link: int) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)


class PcapWriter(DataSourceWriter):
    """A capture file a task, in the order of its rows; files of another name stay until all tasks are done."""

    def __init__(self, path: str, schema, overwrite: bool):
        missing = {"ts_us", "frame"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"a capture needs the columns {sorted(missing)}")
        self.path, self.job, self.linked, self.overwrite = path, uuid.uuid4().hex, "link" in schema.fieldNames(), overwrite

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, place = _store(self.path)
        task = TaskContext.get()
        folder, link = f"{place}/_temporary-{self.job}", None
        store.create_dir(folder, recursive=True)
        temporary = f"{folder}/{task.partitionId():05d}-{task.taskAttemptId()}"
        final = f"{place}/part-{task.partitionId():05d}-{self.job}.pcap"
        with store.open_output_stream(temporary, buffer_size=BUFFER) as f:
            for row in rows:
                own = row["link"] if self.linked and row["link"] is not None else ETHERNET
                if link is None:
                    f.write(_header(link := own))
                if own != link:
                    raise ValueError("a capture file holds frames of one link type; partition the rows by link")
                if row["frame"] is not None and row["ts_us"] is not None:
                    data = bytes(row["frame"])
                    f.write(struct.pack("<IIII", row["ts_us"] // 1_000_000, row["ts_us"] % 1_000_000, len(data), len(data)) + data)
        return Written(temporary, final if link is not None else "")

    def commit(self, messages: list) -> None:
        store, place = _store(self.path)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.endswith(".pcap"):
                    store.delete_file(x.path)
        for m in messages:
            if m is not None and m.final:
                store.move(m.temporary, m.final)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, place = _store(self.path)
        if store.get_file_info(f"{place}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{place}/_temporary-{self.job}")


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA + (FRAMES if _wants_frames(self.options) else "")

    def reader(self, schema) -> PcapReader:
        return PcapReader(self.options)

    def streamReader(self, schema) -> PcapStream:
        return PcapStream(self.options)

    def writer(self, schema, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcapSource)


def write(packets: list[tuple[int, bytes]], path: str) -> None:
    """Ethernet frames (time in microseconds, bytes) as one small capture file."""
    with open(path, "wb") as f:
        f.write(_header(ETHERNET))
        for ts, data in packets:
            f.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(data), len(data)) + data)
