"""Capture files of all kinds, read by Spark; TLS hellos; given models."""

import hashlib
import ipaddress
import struct

import numpy as np
import pytest

from flowquarry.functions import net
from flowquarry.operators import models
from flowquarry.sources import capture


def udp(src, dst, sport, dport, payload):
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    if a.version == 4:
        head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, 17, 0) + a.packed + b.packed
        return 0x0800, head + body
    return 0x86DD, struct.pack(">IHBB", 0x60000000, len(body), 17, 64) + a.packed + b.packed + body


def ethernet(kind, packet, vlan=False):
    return bytes(12) + (struct.pack(">HH", 0x8100, 7) if vlan else b"") + struct.pack(">H", kind) + packet


def pcap(frames, order="<", nanos=False, link=1):
    unit = 10**9 if nanos else 10**6
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for ts, frame in frames:
        out += struct.pack(order + "IIII", int(ts), round((ts - int(ts)) * unit), len(frame), len(frame)) + frame
    return out


def pcapng(frames):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9))
    for ts, frame in frames:
        ticks = round(ts * 10**9)
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame + bytes(-len(frame) % 4))
    return out


def test_files_of_all_kinds(spark, tmp_path):
    four, six = udp("10.0.0.1", "10.0.0.2", 1000, 53, b"four"), udp("2001:db8::1", "2001:db8::2", 1001, 53, b"six!")
    whole = pcap([(1.5, ethernet(*four)), (2.25, ethernet(*six))])
    files = {
        "a.pcap": whole, "cut.pcap": whole + b"\0\0\0", "big.pcap": pcap([(1.5, ethernet(*four))], ">"), "nanos.pcap": pcap([(1.5, ethernet(*four, vlan=True))], nanos=True), "raw.pcap": pcap([(1.5, six[1])], link=101),
        "b.pcapng": pcapng([(1.5, ethernet(*four)), (2.25, ethernet(*six, vlan=True))]), "none.pcap": pcap([]), "arp.pcap": pcap([(1.0, ethernet(0x0806, bytes(28)))]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = sorted((r.file.rsplit("/", 1)[1], r.ts, r.src, r.dst, r.sport, r.dport, bytes(r.payload)) for r in capture.read_captures(spark, f"file://{tmp_path}/*").collect())
    a, b = (1.5, "10.0.0.1", "10.0.0.2", 1000, 53, b"four"), (2.25, "2001:db8::1", "2001:db8::2", 1001, 53, b"six!")
    assert got == [("a.pcap", *a), ("a.pcap", *b), ("b.pcapng", *a), ("b.pcapng", *b), ("big.pcap", *a), ("cut.pcap", *a), ("cut.pcap", *b), ("nanos.pcap", *a), ("raw.pcap", 1.5, *b[1:])]


def record(part):
    return b"\x16\x03\x01" + struct.pack(">H", len(part)) + part


def message(kind, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def test_hellos_over_records_and_what_is_none():
    extensions = struct.pack(">HHHBH", 0, 9, 7, 0, 4) + b"a.bc" + struct.pack(">HHBHH", 43, 5, 4, 0x0304, 0x0303)
    client = message(1, b"\x03\x03" + bytes(32) + b"\x04sess" + struct.pack(">HHH", 4, 0x1301, 0xC02B) + b"\x01\x00" + struct.pack(">H", len(extensions)) + extensions)
    want = (0x0303, [0x1301, 0xC02B], [0, 43], [], [], [], [], [0x0304, 0x0303], "a.bc")
    for cut in range(1, len(client), 7):
        assert capture.client_hello(record(client[:cut]) + record(client[cut:])) == want
    assert capture.client_hello(record(client)[:-1]) is None and capture.client_hello(b"GET / HTTP/1.1") is None and capture.client_hello(b"") is None
    server = message(2, b"\x03\x03" + bytes(32) + b"\0" + b"\x13\x01\0" + struct.pack(">HHHH", 6, 43, 2, 0x0304))
    certificate = message(11, bytes(40))
    assert capture.server_hello(record(server + certificate)) == (0x0303, 0x1301, [43], 0x0304, None)
    assert capture.server_hello(record(server[:10]) + record(server[10:])) == (0x0303, 0x1301, [43], 0x0304, None)
    old = message(2, b"\x03\x01" + bytes(32) + b"\0" + b"\x00\x2f\0")
    assert capture.server_hello(record(old)) == (0x0301, 0x2F, [], 0x0301, None)
    assert capture.server_hello(record(client)) is None and capture.client_hello(record(server)) is None


def test_community_id_of_ipv6(spark):
    from base64 import b64encode

    from pyspark.sql import functions as F

    def plain(src, dst, sport, dport, proto):
        a, b = (ipaddress.ip_address(x).packed for x in (src, dst))
        if (a, sport) > (b, dport):
            a, b, sport, dport = b, a, dport, sport
        return "1:" + b64encode(hashlib.sha1(b"\0\0" + a + b + bytes([proto, 0]) + struct.pack(">HH", sport, dport)).digest()).decode()

    rows = [
        ("2001:db8::1", "fe80::2:1", 5, 6, 6), ("fe80::2:1", "2001:db8::1", 6, 5, 6), ("::", "::1", 9, 9, 17), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", 2, 1, 6),
        ("2001:DB8:0:0::1", "1::", 1, 2, 132),
    ]
    odd = [("10.0.0.1", "::1", 1, 2, 6), ("1::2::3", "::1", 1, 2, 6), ("12345::", "::1", 1, 2, 6), (None, "::1", 1, 2, 6), ("::1", "::2", 1, 2, 1)]
    df = spark.createDataFrame(rows + odd, "s string, d string, sp int, dp int, p int")
    got = [r[0] for r in df.select(net.community_id(*[F.col(c) for c in ("s", "d", "sp", "dp", "p")])).collect()]
    assert got == [plain(*r) for r in rows] + [None] * len(odd)


def test_a_given_model(spark):
    weights, bias = [[1.0, -2.0, 0.5], [0.0, 3.0, 1.0]], [0.1, 0.2, 0.3]
    rows = [(1, 1.0, 2.0), (2, 0.0, 0.0), (3, None, -1.5), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = {r.id: r.p for r in models.score_onnx(df, models.linear_onnx(weights, bias), ["a", "b"], keep=["id"]).collect()}
    for i, a, b in rows:
        z = np.array([a or 0.0, b or 0.0]) @ np.array(weights) + bias
        p = np.exp(z) / np.exp(z).sum()
        assert got[i] == pytest.approx(p.tolist() if a or b else [1.0, 0.0, 0.0], abs=1e-5)


def test_audit_of_names_in_odd_captures(spark):
    """Answers are learned over all files, the last one counts; nulls, files without packets and without messages have rows."""
    from flowquarry.operators.capture import category_histogram, packet_audit

    packets = spark.createDataFrame(
        [
            ("a", "8.8.8.8", 5000, 443, 17, None, None), ("a", "10.0.0.1", 443, 5000, 17, None, None), ("a", "2001:db8::1", 1, 443, 6, True, "x.dns.google"),
            ("a", "1.2.3.4", 1, 443, 6, True, None), ("a", None, None, None, None, None, None), ("b", "8.8.8.8", 1, 53, 17, False, None), ("d", "10.0.0.2", 1, 80, 6, False, None),
        ],
        "file string, dst string, sport int, dport int, proto int, hello boolean, sni string",
    )
    messages = spark.createDataFrame(
        [("b", 1.0, "old.example", "8.8.8.8"), ("c", 9.0, "GitHub.com", "8.8.8.8"), ("c", 2.0, "DoH.example", None), ("c", 3.0, None, None), ("b", 4.0, "plain.example", "2001:db8::1")],
        "file string, ts double, name string, answer string",
    )
    got = {r.file: r.asDict() for r in packet_audit(packets, messages).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    a = got["a"]
    assert (a["packets"], a["tcp443"], a["quic"], a["hellos"], a["sni"], a["outside"], a["named"], a["doh"]) == (5, 2, 2, 2, 1, 3, 2, 1)
    assert (a["sni_share"], a["quic_share"], a["doh_share"], a["named_share"]) == (0.5, 0.5, 0.0, pytest.approx(2 / 3))
    assert (got["c"]["packets"], got["c"]["queries"], got["c"]["doh"]) == (0, 3, 1) and got["c"]["doh_share"] == pytest.approx(1 / 3)
    assert (got["d"]["outside"], got["d"]["named_share"], got["b"]["named_share"]) == (0, 0.0, 1.0)
    shares = {(r.file, r.category): (r.packets, r.share) for r in category_histogram(packets, messages).collect()}
    third = pytest.approx(1 / 3)
    assert shares == {("a", "Code_Repo_Paste"): (1, third), ("a", "Browse"): (1, third), ("a", "Unknown_External"): (1, third), ("b", "Code_Repo_Paste"): (1, 1.0)}
    assert packet_audit(packets.limit(0), messages.limit(0)).collect() == [] == category_histogram(packets.limit(0), messages.limit(0)).collect()
