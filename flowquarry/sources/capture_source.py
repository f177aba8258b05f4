"""Packet captures as a data source whose partitions are byte ranges: ``spark.read.format("capture")``.

A pcap file has no marks between records, so a task that begins in the middle finds its first record by a chain of plausible
headers: each says where the next one is, and a chain counts once it has run on for longer than any record, as one that
began inside a packet's data has by then met the true chain or broken off. The search begins far enough before the range, and
a record belongs to the range that its header begins in, so neighbours agree on where one ends and the other begins.

pcapng blocks depend on the interfaces described before them, so such a file is one range, read a block at a time. Files are
opened through pyarrow's file systems: local paths and the stores that it knows by their scheme. For other stores there is
capture.read_captures, where Spark reads the files.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .capture import PACKET_SCHEMA, PCAP_MAGICS, blocks, packet

SPLIT_BYTES = 128 << 20
#: The longest record that is believed, where a file does not limit it further.
LONGEST = 262_144
#: Bytes that are read at a time, and packets that are passed on at a time.
BUFFER, ROWS = 4 << 20, 20_000
HEAD = 24


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path, a folder, or a pattern for files or folders matches; hidden ones are left out."""
    fs, name = _open(path)
    scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
    parts = name.split("/")
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    base = "/".join(parts[:fixed]) or "/"
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(scheme + base, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = []
    for own in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        below = posixpath.relpath(own.path, base).split("/")
        shown = not any(b.startswith(("_", ".")) for b in below)
        if own.type == pafs.FileType.File and shown and len(below) >= len(parts) - fixed and all(fnmatch.fnmatch(b, p) for b, p in zip(below, parts[fixed:])):
            found.append((scheme + own.path, own.size))
    return sorted(found)


class _Bytes:
    """A file's bytes from a place on, read ahead a buffer at a time."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.start, self.data = file, size, at, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes at a place that is not before any asked for; fewer at the end."""
        if at + n > self.start + len(self.data) and self.start + len(self.data) < self.size:
            kept = self.data[at - self.start :] if at < self.start + len(self.data) else b""
            self.file.seek(at + len(kept))
            self.start, self.data = at, kept + self.file.read(max(BUFFER, n - len(kept)))
        return self.data[at - self.start : at - self.start + n]


class Pcap:
    """The layout of a pcap file, from its first bytes."""

    def __init__(self, head: bytes, size: int):
        self.order, self.unit = PCAP_MAGICS[head[:4]]
        snap, link = struct.unpack_from(self.order + "II", head, 16)
        self.link, self.size = link & 0x0FFFFFFF, size
        self.longest = min(snap, LONGEST) if snap else LONGEST
        self.first = struct.unpack_from(self.order + "I", head, HEAD)[0] if len(head) >= HEAD + 4 else 0

    def next_of(self, data: bytes, at: int) -> int | None:
        """Where the record after the one at a place of the data begins; None if no header can stand there."""
        sec, part, size, wire = struct.unpack_from(self.order + "4I", data, at)
        plausible = part < self.unit and 0 < size <= self.longest and size <= wire and wire < 1 << 24 and abs(sec - self.first) < YEARS
        return at + 16 + size if plausible else None

    def begin_at(self, file, low: int) -> int:
        """Where the first record at or after a place begins: the chain that is still whole there is the true one."""
        reach = 2 * (self.longest + 16)
        base = max(HEAD, low - reach)
        file.seek(base)
        data = file.read(low - base + reach)
        end = base + len(data) >= self.size
        for start in [0] if base == HEAD else range(min(reach // 2, len(data))):
            at: int | None = start
            while at is not None and at + 16 <= len(data) and base + at < low:
                at = self.next_of(data, at)
            if at is None:
                continue
            found = at
            # Past the range's beginning it must go on to the end of what was read.
            while at is not None and at + 16 <= len(data):
                at = self.next_of(data, at)
            if at is not None and (at + 16 > len(data) or end):
                return base + found
        return self.size

    def records(self, file, low: int, high: int) -> Iterator[tuple[float, int, bytes, int]]:
        """(time, link type, frame, length on the wire) of the records whose headers begin in the range."""
        at = self.begin_at(file, low) if low > HEAD else HEAD
        held = _Bytes(file, self.size, at)
        while at < high and len(header := held.get(at, 16)) == 16:
            sec, part, size, wire = struct.unpack(self.order + "4I", header)
            frame = held.get(at + 16, size)
            if len(frame) < size:
                return
            yield sec + part / self.unit, self.link, frame, wire
            at += 16 + size


YEARS = 20 * 365 * 86_400


class CaptureReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split: int):
        self.schema, self.path, self.split = schema, path, split

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_of(self.path):
            fs, name = _open(path)
            with fs.open_input_stream(name) as f:
                step = self.split if f.read(4) in PCAP_MAGICS else max(size, 1)
            out += [Range(path, at, min(at + step, size), size) for at in range(0, max(size, 1), step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        names, kinds = self.schema.fieldNames(), [to_arrow_type(f.dataType) for f in self.schema.fields]
        fs, name = _open(partition.path)
        with fs.open_input_file(name) as f:
            head = f.read(HEAD + 4)
            if head[:4] in PCAP_MAGICS:
                frames = Pcap(head, partition.size).records(f, max(partition.begin, HEAD), partition.end) if len(head) >= HEAD else iter(())
            elif head[:4] == b"\x0a\x0d\x0d\x0a":
                held = _Bytes(f, partition.size, 0)
                frames = blocks(held.get)
            else:
                raise ValueError(f"neither pcap nor pcapng: {partition.path}")
            found = []
            for frame in frames:
                if (row := packet(*frame)) is not None:
                    found.append((partition.path, *row))
                if len(found) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


class CaptureDataSource(DataSource):
    """Options: path, and splitBytes, the length of a range."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKET_SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(schema, self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_capture_ranges(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of all captures that the path matches, a task for each range of split_bytes; files may have any length."""
    spark.dataSource.register(CaptureDataSource)
    return spark.read.format("capture").option("splitBytes", split_bytes).load(path)
