"""Media columns: signature sniffing of binary values.

An Aho-Corasick automaton finds every magic number in one pass. A validator for each format then confirms structure
and lengths, which tells real media from chance bytes, gives the type whatever was declared, and shows where media
inside other bytes end, so they can be carved out.

Formats are chains of parts that say how long they are (chunks, pages, blocks, boxes, frames). A part is read once a
value, whatever number of magic numbers lead to it, and end marks are looked up once a value, so sniffing takes time in
proportion to the value's length also where magic numbers repeat.

The automaton works on bytes as Latin-1 characters. Magic numbers are fixed values of the public formats.

Defined cases: a null value counts as empty bytes; bytes without valid media have the type
``application/octet-stream`` and keep it whatever was declared; of media that overlap, the one whose magic number comes
first is carved; FLAC, which does not tell its length, ends where the next valid media begin; a PDF ends at its last
end mark before another one's magic number; equal values give equal results; very long values are held whole, one at a
time; rows with a null id, repeated rows and an empty table are handled like any; other columns are not read, so their
names are free.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 576
RATE = 8000
UNKNOWN = "application/octet-stream"

#: Magic numbers, and how far from the start of the format they stand.
MAGICS: dict[bytes, tuple[str, int]] = {
    b"RIFF": ("riff", 0),
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"fLaC": ("flac", 0),
    b"OggS": ("ogg", 0),
    b"PK\x03\x04": ("zip", 0),
    b"%PDF-": ("pdf", 0),
    b"ftyp": ("mp4", 4),
    b"ID3": ("id3", 0),
    b"\xff\xfb": ("mp3", 0),
    b"\xff\xfa": ("mp3", 0),
    b"\xff\xf3": ("mp3", 0),
    b"\xff\xf2": ("mp3", 0),
    b"BM": ("bmp", 0),
    b"II*\x00": ("tiff", 0),
    b"MM\x00*": ("tiff", 0),
    b"\x1aE\xdf\xa3": ("ebml", 0),
}

#: MPEG audio layer III in kbit/s, for version 1 and for versions 2 and 2.5, and sampling rates by version bits.
MP3_RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Boxes at the top of an MP4 file, sizes of BMP headers, bytes of TIFF values by type.
MP4_BOXES = frozenset((b"ftyp", b"moov", b"mdat", b"moof", b"free", b"skip", b"wide", b"uuid", b"mfra", b"sidx", b"styp", b"pdin", b"meta", b"emsg", b"prft"))
BMP_HEADERS = (12, 40, 52, 56, 64, 108, 124)
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

Found = tuple[str, int, bool]  # type, length, whether the length is only the most it can be

#: In the sums of a chain, the second thing that is counted.
SECOND = 1 << 32


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def wav_samples(data: bytes) -> bytes:
    """The bytes of the data chunk of a valid WAV file."""
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


class Chain:
    """Parts that follow each other: ``step`` gives, for a place, where the part there ends and a number to be summed,
    or None if there is none (or the last one). Each place is read once; a skip pointer a place makes long walks short.
    """

    def __init__(self, step: Callable[[int], tuple[int, int] | None]):
        self.step = step
        self.parts: dict[int, tuple[int, int, int, int, int]] = {}  # place: next, depth, skip, sum to the end, the end

    def _read(self, at: int) -> tuple[int, int, int, int, int]:
        parts, ahead = self.parts, []
        while at not in parts:
            found = self.step(at)
            if found is None:
                parts[at] = (at, 0, at, 0, at)
                break
            ahead.append((at, *found))
            at = found[0]
        for at, after, number in reversed(ahead):
            _, depth, skip, total, end = parts[after]
            _, skip_depth, second, _, _ = parts[skip]
            far = second if depth - skip_depth == skip_depth - parts[second][1] else after
            parts[at] = (after, depth + 1, far, total + number, end)
        return parts[at]

    def end(self, at: int) -> tuple[int, int, int]:
        """The place at which the walk from ``at`` stops, how many parts it passes, and their sum."""
        _, depth, _, total, end = self._read(at)
        return end, depth, total

    def until(self, at: int, least: int) -> tuple[int, int]:
        """The first place of the walk at or beyond ``least`` (its end if there is none), and the sum of the parts up to it."""
        whole = self._read(at)[3]
        while at < least:
            after, depth, skip, _, _ = self.parts[at]
            if not depth:
                break
            at = skip if skip <= least else after
        return at, whole - self.parts[at][3]


class Checksums:
    """CRC-32 of any slice: of long ones from those of the value's beginnings, so its length does not matter."""

    STRIDE = 1 << 16
    POLYNOMIAL = 0xEDB88320

    def __init__(self, data: bytes):
        self.data, self.heads, self.powers = memoryview(data), [0], [1 << 30]

    def _times(self, a: int, b: int) -> int:
        """The product of two polynomials, bit-reversed, modulo the checksum's."""
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ self.POLYNOMIAL if b & 1 else b >> 1
        return out

    def _head(self, end: int) -> int:
        stride = self.STRIDE
        while len(self.heads) <= end // stride:
            at = (len(self.heads) - 1) * stride
            self.heads.append(zlib.crc32(self.data[at : at + stride], self.heads[-1]))
        return zlib.crc32(self.data[end - end % stride : end], self.heads[end // stride])

    def of(self, start: int, end: int) -> int:
        if end - start <= 2 * self.STRIDE:
            return zlib.crc32(self.data[start:end])
        shift, bits, k = 1 << 31, 8 * (end - start), 0  # x to the power of 0, then of bits
        while bits >> k:
            if len(self.powers) == k:
                self.powers.append(self._times(self.powers[-1], self.powers[-1]))
            if bits >> k & 1:
                shift = self._times(self.powers[k], shift)
            k += 1
        return self._head(end) ^ self._times(shift, self._head(start))


class Value:
    """What the validators know of a value: its bytes, its end marks, and the parts read so far."""

    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)
        self.riff_chunks, self.png_chunks = Chain(self._riff_chunk), Chain(self._png_chunk)
        self.gif_blocks, self.gif_runs = Chain(self._gif_block), Chain(self._gif_run)
        self.jpeg_segments, self.flac_blocks, self.ogg_pages = Chain(self.jpeg_segment), Chain(self._flac_block), Chain(self._ogg_page)
        self.mp4_boxes, self.mp3_frames = Chain(self._mp4_box), Chain(self.mp3_frame)
        self.checksums = Checksums(data)

    def _all(self, pattern: bytes) -> list[int]:
        return [m.start() for m in re.finditer(pattern, self.data, re.DOTALL)]

    @cached_property
    def pdf_heads(self) -> list[int]:
        return self._all(rb"%PDF-")

    @cached_property
    def pdf_ends(self) -> list[int]:
        return self._all(rb"%%EOF")

    @cached_property
    def pdf_tables(self) -> list[int]:
        return self._all(rb"startxref")

    @cached_property
    def jpeg_stops(self) -> list[int]:
        """Markers that end entropy-coded data."""
        return self._all(rb"\xff[^\x00\xd0-\xd7\xff]")

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Where an archive begins, by its end record, and where it ends: the first that fits."""
        out: dict[int, int] = {}
        for tail in self._all(rb"PK\x05\x06"):
            if tail + 22 > self.n:
                break
            size, offset, comment = struct.unpack_from("<IIH", self.data, tail + 12)
            start, end = tail - size - offset, tail + 22 + comment
            if start >= 0 and end <= self.n and (not size or self.data[tail - size : tail - size + 4] == b"PK\x01\x02"):
                out.setdefault(start, end)
        return out

    def _riff_chunk(self, at: int) -> tuple[int, int] | None:
        if at + 8 > self.n:
            return None
        name, size = struct.unpack_from("<4sI", self.data, at)
        if at + 8 + size > self.n:
            return None
        return at + 8 + size + (size & 1), {b"fmt ": 1, b"data": SECOND}.get(name, 0)

    def _png_chunk(self, at: int) -> tuple[int, int] | None:
        size = self.png_size(at)
        return None if size is None or self.data[at + 4 : at + 8] == b"IEND" else (at + 12 + size, 0)

    def png_size(self, at: int) -> int | None:
        """Bytes of data of a sound chunk."""
        if at + 12 > self.n:
            return None
        size = struct.unpack_from(">I", self.data, at)[0]
        end = at + 12 + size
        if end > self.n or not self.data[at + 4 : at + 8].isalpha():
            return None
        return size if self.checksums.of(at + 4, end - 4) == struct.unpack_from(">I", self.data, end - 4)[0] else None

    def _gif_run(self, at: int) -> tuple[int, int] | None:
        return (at + 1 + self.data[at], 0) if at < self.n and self.data[at] else None

    def _gif_block(self, at: int) -> tuple[int, int] | None:
        data = self.data
        if at + 2 > self.n:
            return None
        if data[at] == 0x21:
            begin, image = at + 2, 0
        elif data[at] == 0x2C and at + 10 <= self.n:
            begin, image = at + 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0), 1
        else:
            return None
        end = self.gif_runs.end(begin)[0]
        return (end + 1, image) if end < self.n else None

    def jpeg_segment(self, at: int) -> tuple[int, int] | None:
        data = self.data
        if at + 4 > self.n or data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:  # a fill byte
            return at + 1, 0
        if mark in (0x00, 0x01, 0xD8, 0xD9) or 0xD0 <= mark <= 0xD7:
            return None
        size = struct.unpack_from(">H", data, at + 2)[0]
        after = at + 2 + size
        if size < 2 or after > self.n:
            return None
        if mark != 0xDA:
            return after, int(0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC))
        stop = bisect_left(self.jpeg_stops, after)
        return (self.jpeg_stops[stop], SECOND) if stop < len(self.jpeg_stops) else None

    def _flac_block(self, at: int) -> tuple[int, int] | None:
        if at + 4 > self.n or self.data[at] & 0x80:
            return None
        end = at + 4 + int.from_bytes(self.data[at + 1 : at + 4], "big")
        return (end, 0) if end <= self.n else None

    def ogg_end(self, at: int) -> int | None:
        data = self.data
        if data[at : at + 4] != b"OggS" or at + 27 > self.n or data[at + 4] != 0:
            return None
        table = data[at + 27 : at + 27 + data[at + 26]]
        end = at + 27 + data[at + 26] + sum(table)
        return end if len(table) == data[at + 26] and end <= self.n else None

    def _ogg_page(self, at: int) -> tuple[int, int] | None:
        end = self.ogg_end(at)
        return None if end is None or self.data[at + 5] & 4 else (end, 0)

    def _mp4_box(self, at: int) -> tuple[int, int] | None:
        if at + 8 > self.n:
            return None
        size, name = struct.unpack_from(">I4s", self.data, at)
        if size == 1 and at + 16 <= self.n:
            size = struct.unpack_from(">Q", self.data, at + 8)[0]
        elif size == 0:
            size = self.n - at
        if name not in MP4_BOXES or size < 8 or at + size > self.n:
            return None
        return at + size, int(name in (b"moov", b"moof"))

    def mp3_frame(self, at: int) -> tuple[int, int] | None:
        if at + 4 > self.n or self.data[at] != 0xFF:
            return None
        b, c = self.data[at + 1], self.data[at + 2]
        version, rate, hertz = b >> 3 & 3, c >> 4, c >> 2 & 3
        if b >> 5 != 7 or version == 1 or b >> 1 & 3 != 1 or not 0 < rate < 15 or hertz == 3:
            return None
        first = version == 3
        size = (144_000 if first else 72_000) * MP3_RATES[1 if first else 2][rate] // MP3_HERTZ[version][hertz] + (c >> 1 & 1)
        return (at + size, 0) if at + size <= self.n else None


def _riff(v: Value, at: int) -> Found | None:
    if at + 12 > v.n:
        return None
    size, kind = struct.unpack_from("<I4s", v.data, at + 4)
    end = at + 8 + size
    if end > v.n or size < 12 or kind not in (b"WAVE", b"AVI ", b"WEBP"):
        return None
    place, names = v.riff_chunks.until(at + 12, end)
    if place not in (end, end + 1) or kind == b"WAVE" and not (names % SECOND and names // SECOND):
        return None
    return {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}[kind], end - at, False


def _png(v: Value, at: int) -> Found | None:
    if v.data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    last, _, _ = v.png_chunks.end(at + 8)
    size = v.png_size(last) if v.data[last + 4 : last + 8] == b"IEND" else None
    return None if size is None else ("image/png", last + 12 + size - at, False)


def _gif(v: Value, at: int) -> Found | None:
    if at + 13 > v.n:
        return None
    flags = v.data[at + 10]
    last, _, images = v.gif_blocks.end(at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
    return ("image/gif", last + 1 - at, False) if images and v.data[last : last + 1] == b";" else None


def _jpeg(v: Value, at: int) -> Found | None:
    if v.data[at + 3 : at + 4] == b"\xff" or v.jpeg_segment(at + 2) is None:
        return None
    last, _, marks = v.jpeg_segments.end(at + 2)
    if v.data[last : last + 2] != b"\xff\xd9" or not (marks % SECOND and marks // SECOND):
        return None
    return "image/jpeg", last + 2 - at, False


def _flac(v: Value, at: int) -> Found | None:
    if v.data[at + 4 : at + 5] not in (b"\0", b"\x80") or v.data[at + 5 : at + 8] != b"\0\0\x22":
        return None
    last, _, _ = v.flac_blocks.end(at + 4)
    frame = last + 4 + int.from_bytes(v.data[last + 1 : last + 4], "big")
    return ("audio/flac", v.n - at, True) if v.data[last : last + 1] >= b"\x80" and v.data[frame : frame + 2] in (b"\xff\xf8", b"\xff\xf9") else None


def _ogg(v: Value, at: int) -> Found | None:
    if v.ogg_end(at) is None:
        return None
    last, _, _ = v.ogg_pages.end(at)
    end = v.ogg_end(last)
    return None if end is None else ("audio/ogg", end - at, False)


def _zip(v: Value, at: int) -> Found | None:
    end = v.zip_ends.get(at)
    return None if end is None else ("application/zip", end - at, False)


def _pdf(v: Value, at: int) -> Found | None:
    after = bisect_left(v.pdf_heads, at + 1)
    bound = v.pdf_heads[after] if after < len(v.pdf_heads) else v.n
    last = bisect_left(v.pdf_ends, bound) - 1
    if last < 0 or v.pdf_ends[last] < at:
        return None
    table = bisect_left(v.pdf_tables, at)
    if table == len(v.pdf_tables) or v.pdf_tables[table] > v.pdf_ends[last]:
        return None
    return "application/pdf", v.pdf_ends[last] + 5 - at, False


def _mp4(v: Value, at: int) -> Found | None:
    end, _, movies = v.mp4_boxes.end(at)
    if not movies or v.data[end + 4 : end + 8] in MP4_BOXES:  # none, or a box that is cut off
        return None
    brand = v.data[at + 8 : at + 12]
    return {b"qt  ": "video/quicktime", b"M4A ": "audio/mp4"}.get(brand, "video/mp4"), end - at, False


def _mpeg_audio(v: Value, at: int, begin: int, least: int) -> Found | None:
    end, frames, _ = v.mp3_frames.end(begin)
    if frames < least:
        return None
    end += 128 if v.data[end : end + 3] == b"TAG" and end + 128 <= v.n else 0
    return "audio/mpeg", end - at, False


def _mp3(v: Value, at: int) -> Found | None:
    return _mpeg_audio(v, at, at, 3) if v.mp3_frame(at) else None


def _id3(v: Value, at: int) -> Found | None:
    head = v.data[at : at + 10]
    if len(head) < 10 or 0xFF in head[3:5] or head[5] & 0x0F or max(head[6:]) >= 0x80:
        return None
    size = head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]
    return _mpeg_audio(v, at, at + 10 + size + (10 if head[5] & 0x10 else 0), 2)


def _bmp(v: Value, at: int) -> Found | None:
    if at + 30 > v.n:
        return None
    size, spare, offset, head = struct.unpack_from("<IIII", v.data, at + 2)
    planes = struct.unpack_from("<H", v.data, at + (22 if head == 12 else 26))[0]
    if spare or head not in BMP_HEADERS or planes != 1 or not 14 + head <= offset <= size or at + size > v.n:
        return None
    return "image/bmp", size, False


def _tiff(v: Value, at: int) -> Found | None:
    """Ends with the last byte that the entries of its first directory, its strips or tiles among them, refer to."""
    order = "<" if v.data[at : at + 1] == b"I" else ">"
    if at + 8 > v.n:
        return None
    first = struct.unpack_from(order + "I", v.data, at + 4)[0]
    if first < 8 or at + first + 2 > v.n:
        return None
    n = struct.unpack_from(order + "H", v.data, at + first)[0]
    end, before, values = first + 2 + 12 * n + 4, -1, {}
    if not n or at + end > v.n:
        return None
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", v.data, at + first + 2 + 12 * i)
        size = TIFF_SIZES.get(kind, 0) * count
        if tag <= before or not size:
            return None
        before, place = tag, first + 2 + 12 * i + 8
        if size > 4:
            place = struct.unpack_from(order + "I", v.data, at + place)[0]
            end = max(end, place + size)
        values[tag] = (kind, count, place)
        if at + end > v.n:
            return None
    if not {256, 257} <= values.keys():
        return None
    for offsets, counts in ((273, 279), (324, 325)):
        if offsets in values and counts in values and values[offsets][1] == values[counts][1]:
            a, b = (np.frombuffer(v.data, order + ("u2" if k == 3 else "u4"), c, at + p).astype(np.int64) for k, c, p in (values[offsets], values[counts]))
            end = max(end, int((a + b).max()))
    return None if at + end > v.n else ("image/tiff", end, False)


def _number(v: Value, at: int) -> tuple[int, int] | None:
    """An EBML number and its bytes; a length of all ones, which means unknown, is -1."""
    if at >= v.n or not v.data[at]:
        return None
    width = 9 - v.data[at].bit_length()
    if at + width > v.n:
        return None
    number = int.from_bytes(v.data[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if number == (1 << 7 * width) - 1 else number), width


def _ebml(v: Value, at: int) -> Found | None:
    head = _number(v, at + 4)
    if head is None or not 0 < head[0] <= 4096:
        return None
    segment = at + 4 + head[1] + head[0]
    kind = re.search(rb"\x42\x82[\x80-\xff](webm|matroska)", v.data[at + 4 + head[1] : segment])
    size = _number(v, segment + 4)
    if kind is None or size is None or v.data[segment : segment + 4] != b"\x18\x53\x80\x67":
        return None
    name = "video/webm" if kind[1] == b"webm" else "video/x-matroska"
    end = v.n if size[0] < 0 else segment + 4 + size[1] + size[0]
    return None if end > v.n else (name, end - at, size[0] < 0)


VALIDATORS: dict[str, Callable[[Value, int], Found | None]] = {
    "riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "flac": _flac, "ogg": _ogg, "zip": _zip, "pdf": _pdf, "mp4": _mp4, "mp3": _mp3, "id3": _id3, "bmp": _bmp, "tiff": _tiff, "ebml": _ebml,
}


def automaton() -> ahocorasick.Automaton:
    tree = ahocorasick.Automaton()
    for magic, (kind, shift) in MAGICS.items():
        tree.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + shift))
    tree.make_automaton()
    return tree


def sniff(data: bytes, tree: ahocorasick.Automaton) -> tuple[str, int, list[tuple[int, str, int]]]:
    """The type of the whole value, the magic numbers seen, and the media inside it as (offset, type, length).

    The value has a format's type if valid media of that format begin at its first byte; media inside are those
    that begin later, and none overlaps another.
    """
    value, kind, seen, free, inside, unsure = Value(data), UNKNOWN, 0, 0, [], False
    for end, (name, back) in tree.iter(data.decode("latin-1")):
        seen += 1
        at = end - back
        if at < free and at != 0:
            continue
        found = VALIDATORS[name](value, at)
        if found is None:
            continue
        if at == 0:
            kind = found[0] if kind == UNKNOWN else kind
            continue
        if unsure:  # what came before ends here at the latest
            before = inside[-1]
            inside[-1] = (*before[:2], at - before[0])
        inside.append((at, *found[:2]))
        unsure = found[2]
        free = end + 1 if unsure else at + found[1]
    return kind, seen, inside


def correct_types(rows: DataFrame, *, id_col: str, data_col: str, type_col: str | None = None) -> DataFrame:
    """(id, declared_type, media_type, corrected, magics, carved): what each binary value is, and the media carved
    out of it as an array of (at, media_type, data)."""
    declared = F.col(type_col) if type_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton()
        kind = pa.list_(pa.struct([("at", pa.int64()), ("media_type", pa.string()), ("data", pa.binary())]))
        for batch in batches:
            types, magics, carved = [], [], []
            for value in batch.column(2):
                data = value.as_py() or b""
                what, seen, inside = sniff(data, tree)
                types.append(what)
                magics.append(seen)
                carved.append([{"at": at, "media_type": k, "data": data[at : at + n]} for at, k, n in inside])
            fixed = [a != b for a, b in zip(batch.column(1).to_pylist(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(types, pa.string()), pa.array(fixed), pa.array(magics, pa.int64()), pa.array(carved, kind)], ["id", "declared_type", "media_type", "corrected", "magics", "carved"])

    given = rows.select(F.col(id_col).alias("id"), declared.alias("declared_type"), F.col(data_col).alias("data"))
    found = T.StructType().add("at", "long").add("media_type", "string").add("data", "binary")
    schema = given.select("id", "declared_type").schema.add("media_type", "string").add("corrected", "boolean").add("magics", "long").add("carved", T.ArrayType(found))
    return given.mapInArrow(run, schema)


def feature(kind: str, seen: int, inside: list[tuple[int, str, int]], samples: bytes) -> str:
    """Type, magic numbers seen, media carved, and the level and spread of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    total = int(x.sum(dtype=np.int64))
    carved = ",".join(f"{k}@{at}+{n}" for at, k, n in inside)
    return f"{kind};magics={seen};carved={carved};sum={total};hist={','.join(map(str, counts.tolist()))}"


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Stores each text's bytes, padded with 255 to a positive multiple of ``block``, as an 8-bit WAV file; sniffs the
    stored bytes, corrects the declared type, reads the samples back from what the sniffer confirms, and returns
    checks and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, media_type string, carved long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton()
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                stored = wav(data + b"\xff" * (-len(data) % block if data else block))
                declared = UNKNOWN
                kind, seen, inside = sniff(stored, tree)
                if kind != "audio/wav":
                    raise ValueError(f"the stored form was found to be {kind}")
                samples = wav_samples(stored)
                out.append((
                    len(data), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored),
                    hashlib.sha256(stored).hexdigest(), feature(kind, seen, inside, samples), declared, kind, len(inside),
                ))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in zip(*out, strict=True)]], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
