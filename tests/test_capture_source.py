"""Captures in byte ranges, against reading them whole."""

import random
import struct

import pytest

from flowquarry.sources import capture, capture_source

from test_capture import ethernet, pcap, pcapng, udp


def traffic(n, seed=1):
    """Packets of all lengths; some carry a capture of their own, whose headers look as good as the true ones."""
    rng, frames = random.Random(seed), []
    inner = pcap([(1000.0 + i, ethernet(*udp("9.9.9.9", "8.8.8.8", 1, 2, b"x" * 10))) for i in range(20)])[24:]
    for i in range(n):
        payload = inner[: rng.randrange(1300)] if rng.random() < 0.2 else rng.randbytes(rng.choice([0, 1, 60, 500, 1400]))
        frames.append((1000.0 + i / 8, ethernet(*udp(f"10.0.{i >> 8 & 255}.{i & 255}", "10.9.9.9", 1000 + i % 500, 53, payload))))
    return frames


def rows(df):
    return sorted((r.file.rsplit("/", 1)[1], r.ts, r.src, r.sport, r.dport, r.payload_size, r.wire_len, bytes(r.payload)) for r in df.collect())


@pytest.mark.parametrize("split", [300, 1000, 4096, 70_000, 1 << 30])
def test_ranges_equal_a_whole_read(spark, tmp_path, split, monkeypatch):
    frames = traffic(400)
    small = lambda data: data[:16] + struct.pack("<I", 2000) + data[20:]
    (tmp_path / "a.pcap").write_bytes(small(pcap(frames)))
    (tmp_path / "b.pcap").write_bytes(pcap(frames[:90], ">", nanos=True)[:-11])  # cut off in its last record
    (tmp_path / "c.pcapng").write_bytes(pcapng(frames[:50]))
    (tmp_path / "empty.pcap").write_bytes(pcap([]))
    (tmp_path / "_hidden").write_bytes(b"no capture")
    want = rows(capture.read_captures(spark, f"file://{tmp_path}/[abe]*.pcap*").unionByName(capture.read_captures(spark, f"file://{tmp_path}/c.pcapng")))
    got = capture_source.read_capture_ranges(spark, f"file://{tmp_path}", split_bytes=split)
    assert rows(got) == want and len(want) == 400 + 89 + 50
    assert got.rdd.getNumPartitions() >= (tmp_path / "a.pcap").stat().st_size // split
    assert rows(spark.read.format("capture").load(f"{tmp_path}/a*")) == [r for r in want if r[0] == "a.pcap"]


def test_every_place_leads_to_the_next_record(tmp_path):
    frames = traffic(60, seed=4)
    data = pcap(frames)
    data = data[:16] + struct.pack("<I", 1600) + data[20:]
    (tmp_path / "x").write_bytes(data)
    starts, at = [], 24
    for _, frame in frames:
        starts.append(at)
        at += 16 + len(frame)
    layout = capture_source.Pcap(data[:28], len(data))
    with open(tmp_path / "x", "rb") as f:
        for low in range(25, len(data), 37):
            assert layout.begin_at(f, low) == next((s for s in starts if s >= low), len(data)), low


def test_buffers_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(capture_source, "BUFFER", 1000)
    frames = traffic(300, seed=2)
    (tmp_path / "x").write_bytes(pcap(frames))
    size = (tmp_path / "x").stat().st_size
    with open(tmp_path / "x", "rb") as f:
        found = [x[2] for x in capture_source.Pcap((tmp_path / "x").read_bytes()[:28], size).records(f, 24, size)]
    assert found == [frame for _, frame in frames]


def test_missing_and_wrong_files(spark, tmp_path):
    with pytest.raises(Exception, match="No such file|FileNotFound|nothing"):
        capture_source.read_capture_ranges(spark, f"file://{tmp_path}/nothing").count()
    (tmp_path / "x").write_bytes(b"this is no capture at all, is it")
    with pytest.raises(Exception, match="neither pcap nor pcapng"):
        capture_source.read_capture_ranges(spark, f"file://{tmp_path}/x").count()
