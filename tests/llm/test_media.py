import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import pytest

from flowquarry.llm import media
from flowquarry.llm.queries import op7_media


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op7_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        n = max(1, -(-len(data) // 576)) * 576
        payload = data + b"\xff" * (n - len(data))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        stored = out.getvalue()
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), n, len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_type == "audio/wav"
        magics = sum(stored.startswith(m, i) for m in media.MAGICS for i in range(len(stored)) if stored[i] == m[0])
        hist = ",".join(str(sum(32 * k <= x < 32 * k + 32 for x in payload)) for k in range(8))
        assert r.feature == f"audio/wav;magics={magics};carved=;sum={sum(payload)};hist={hist}"


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def test_types_are_corrected_and_media_carved(spark):
    whole = {"png": png(), "gif": GIF, "wav": media.wav(b"abc"), "zip": archive(), "pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF"}
    kinds = {"png": "image/png", "gif": "image/gif", "wav": "audio/wav", "zip": "application/zip", "pdf": "application/pdf"}
    rows = [(k, v, "image/jpeg") for k, v in whole.items()] + [("mixed", b"noise RIFF PNG " + png() + b"between" + GIF + b"%PDF-", None), ("broken", png()[:-3], "image/png"), ("none", None, None), ("crc", png().replace(b"IDAT", b"IDAU"), "x")]
    got = {r.id: r for r in media.correct_types(spark.createDataFrame(rows, "id string, data binary, kind string"), id_col="id", data_col="data", type_col="kind").collect()}
    for k, kind in kinds.items():
        assert got[k].media_type == kind and got[k].corrected and not got[k].carved
    assert got["mixed"].media_type == media.UNKNOWN
    assert [(c.at, c.media_type, bytes(c.data)) for c in got["mixed"].carved] == [(15, "image/png", png()), (15 + len(png()) + 7, "image/gif", GIF)]
    assert got["broken"].media_type == got["crc"].media_type == got["none"].media_type == media.UNKNOWN


def box(name, data=b""):
    return struct.pack(">I", 8 + len(data)) + name + data


MP4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd")) + box(b"mdat", b"frames")
FRAME = b"\xff\xfb\x90\x00" + bytes(413)
MP3 = b"ID3\x03\0\0\0\0\0\x05tagged"[:15] + FRAME * 4
BMP = b"BM" + struct.pack("<IIIIiiHH", 70, 0, 66, 40, 1, 1, 1, 24) + bytes(40)
TIFF = b"II*\0" + struct.pack("<IH", 8, 4) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in ((256, 1), (257, 1), (273, 62), (279, 9))) + struct.pack("<I", 0) + b"pixelsrow"
WEBM = b"\x1aE\xdf\xa3\x87\x42\x82\x84webm" + b"\x18\x53\x80\x67\x84data"
FLAC = b"fLaC\0\0\0\x22" + bytes(34) + b"\x84\0\0\x03abc" + b"\xff\xf8frames of sound"
OGG = b"OggS\0\x02" + bytes(20) + b"\x01\x03abc" + b"OggS\0\x04" + bytes(20) + b"\x01\x02de"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x03c\xff\xda\0\x03ddata\xff\x00more\xff\xd1x\xff\xd9"


def test_each_format_whole_and_inside():
    tree = media.automaton()
    kinds = {
        "video/mp4": MP4, "audio/mpeg": MP3, "image/bmp": BMP, "image/tiff": TIFF, "video/webm": WEBM, "audio/flac": FLAC, "audio/ogg": OGG, "image/jpeg": JPEG, "image/png": png(), "image/gif": GIF,
        "application/zip": archive(), "audio/wav": media.wav(b"abcd"), "video/quicktime": MP4.replace(b"isom", b"qt  "),
    }
    for kind, data in kinds.items():
        assert media.sniff(data, tree)[0] == kind
        inside = media.sniff(b"before" + data + png(), tree)[2]
        assert [(at, k, n) for at, k, n in inside] == [(6, kind, len(data)), (6 + len(data), "image/png", len(png()))], kind
        if kind not in ("audio/flac", "audio/mpeg"):
            assert media.sniff(data[:-1], tree)[0] == media.UNKNOWN
    assert media.sniff(FRAME * 3, tree)[0] == "audio/mpeg" and media.sniff(FRAME * 2, tree)[0] == media.UNKNOWN


def test_archives_in_archives_and_files_saved_twice():
    tree = media.automaton()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner.zip", archive())
        z.writestr("b.txt", "x")
    assert media.sniff(b"--" + out.getvalue() + b"--", tree)[2] == [(2, "application/zip", len(out.getvalue()))]
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF\nmore\nstartxref\n9\n%%EOF"
    assert media.sniff(b"a" + pdf + b"b" + pdf, tree)[2] == [(1, "application/pdf", len(pdf)), (2 + len(pdf), "application/pdf", len(pdf))]


@pytest.mark.parametrize("part", [*media.MAGICS, b"RIFF\xff\xff\x0f\0WAVEfmt \0\0\0\0", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"GIF89a" + bytes(7) + b"!\xf9\xff", b"PK\x03\x04PK\x05\x06" + bytes(18), b"%PDF-startxref"])
def test_time_follows_the_length(part):
    data = part * (2_000_000 // len(part))
    began = time.process_time()
    media.sniff(data, media.automaton())
    assert time.process_time() - began < 3  # a walk for each magic number would take hours


def test_chains_and_checksums_against_plain_ones():
    rng = random.Random(4)
    steps = {i: (i + rng.choice([1, 2, 5, 40]), rng.randrange(3)) for i in range(3000) if rng.random() < 0.995}
    chain = media.Chain(steps.get)
    for _ in range(400):
        at, least = rng.randrange(3000), rng.randrange(3200)
        place, total, whole, passed = at, 0, 0, 0
        while place in steps and place < least:
            total += steps[place][1]
            place = steps[place][0]
        end = at
        while end in steps:
            whole, passed, end = whole + steps[end][1], passed + 1, steps[end][0]
        assert chain.until(at, least) == (place, total) and chain.end(at) == (end, passed, whole)
    data = rng.randbytes(600_000)
    checks = media.Checksums(data)
    for _ in range(60):
        a, b = sorted((rng.randrange(len(data)), rng.randrange(len(data))))
        assert checks.of(a, b) == zlib.crc32(data[a:b])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = media.text_media(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.payload_bytes for r in rows if r.doc_id in (2, 3)} == {576}
    assert media.text_media(no_docs).count() == 0
    for text in ("RIFF\x04\0\0\0WAVE", png().decode("latin-1")):
        assert media.sniff(media.wav(text.encode()), media.automaton())[0] == "audio/wav"
