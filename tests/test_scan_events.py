"""Scan events with ICMP errors: the worked example, messages from captures, and the flows that brought them about."""

import ipaddress
import struct

import pytest

from flowquarry.operators import scan
from flowquarry.sources import capture

FLOWS = "event_id long, src string, dst string, sport int, dport int, proto int, ts double, bwd_pkts int, syn int, ack int, rst int"
ICMP = "ts double, src string, dst string, icmp_type int, icmp_code int"
SRC = "192.168.220.16"


@pytest.fixture(scope="module")
def example(spark):
    rows = [(SRC, f"203.0.113.{10 + i}", 5000 + i, (1234, 4321)[i], 6, 12.0 + i, 1, 1, 0, 1) for i in range(2)]
    rows += [(SRC, f"203.0.113.{20 + i}", 5002 + i, 80 + i, 6, 14.0 + i, 0, 1, 0, 0) for i in range(4)]
    rows += [(SRC, "192.168.220.55", 5006, 445, 6, 18.0, 1, 1, 1, 0)]
    rows += [(SRC, "192.168.220.100", 5007 + i, p, 6, 19.0 + i, 1, 1, 1, 0) for i, p in enumerate((22, 3389, 8080))]
    flows = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FLOWS)
    hosts, ports = spark.createDataFrame([("192.168.220.100",)], "host string"), spark.createDataFrame([("192.168.220.100", p) for p in (80, 443)], "host string, port int")
    return flows, hosts, ports


def test_worked_example(spark, example):
    flows, hosts, ports = example
    icmp = spark.createDataFrame([(10.0, "192.168.220.100", SRC, 3, 3), (11.0, "192.168.220.101", SRC, 3, 1), (12.0, "a", SRC, 8, 0), (13.0, "a", SRC, 3, 4), (70.0, "a", SRC, 3, 3), (5.0, "a", "10.9.9.9", 3, 3)], ICMP)
    (e,) = scan.network_events(flows, known_hosts=hosts, known_ports=ports, icmp=icmp).collect()
    assert (e.src, e.icmp_error, e.rst, e.rwa, e.neip, e.netcp) == (SRC, 2, 2, 4, 1, 3)
    assert (e.ports, e.hosts, e.top_dst) == (10, 8, "192.168.220.100")
    (without,) = scan.network_events(flows, known_hosts=hosts, known_ports=ports).collect()
    assert without.icmp_error == 0 and without.rwa == 4


def test_targets_of_several_flows(spark):
    rows = [(1, SRC, "8.8.8.8", 1, 80, 6, 1.0, 1, 1, 1, 0), (2, SRC, "8.8.8.8", 2, 80, 6, 2.0, 0, 1, 0, 0), (3, SRC, "8.8.4.4", 3, 81, 6, 3.0, 1, 1, 1, 1), (4, SRC, "8.8.4.4", 4, 82, 6, 3.0, 1, 1, 0, 1), (5, SRC, "8.8.4.4", 5, 82, 6, 4.0, 0, 1, 0, 0)]
    (e,) = scan.network_events(spark.createDataFrame(rows, FLOWS)).collect()
    # One flow of the first target had no answer; the second was established before its reset; the third was reset.
    assert (e.rwa, e.rst, e.ports, e.hosts) == (1, 1, 3, 2)


def ipv4(src, dst, proto, body):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + body


def ethernet(packet):
    return bytes(12) + (b"\x08\x00" if packet[0] >> 4 == 4 else b"\x86\xdd") + packet


def pcap(frames):
    return b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<4I", int(ts), int(ts % 1 * 1e6), len(f), len(f)) + f for ts, f in frames)


def test_messages_of_a_capture_and_their_causes(spark):
    udp = lambda sport, dport: struct.pack(">HHHH", sport, dport, 8, 0)
    probe = lambda sport, dport: ipv4(SRC, "203.0.113.9", 17, udp(sport, dport))
    error = lambda inner, code=3, kind=3: ipv4("203.0.113.9", SRC, 1, bytes([kind, code, 0, 0, 0, 0, 0, 0]) + inner)
    inner6 = struct.pack(">IHBB", 0x60000000, 8, 17, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + udp(7, 9)
    error6 = struct.pack(">IHBB", 0x60000000, 8 + len(inner6), 58, 64) + bytes(15) + b"\x02" + bytes(15) + b"\x01" + bytes([1, 4, 0, 0, 0, 0, 0, 0]) + inner6
    frames = [
        (1.0, probe(4000, 161)), (1.5, error(probe(4000, 161))), (2.0, probe(4000, 162)), (2.25, error(probe(4000, 162)[:28], 13)), (3.0, error(probe(4000, 163))), (4.0, error(b"")), (5.0, ipv4("1.1.1.1", SRC, 1, bytes([8, 0, 0, 0]))),
        (6.0, error6), (30.0, error(probe(4000, 161))),
    ]
    files = spark.createDataFrame([("f", bytearray(pcap([(t, ethernet(p)) for t, p in frames])))], "path string, content binary")
    packets = capture.parse_captures(files).collect()
    assert [(p.ts, p.sport, p.dport) for p in packets] == [(1.0, 4000, 161), (2.0, 4000, 162)]  # what an error quotes is no packet
    told = capture.parse_icmp(files)
    assert [(m.ts, m.icmp_type, m.icmp_code, m.q_src, m.q_sport, m.q_dport) for m in told.orderBy("ts").collect()] == [
        (1.5, 3, 3, SRC, 4000, 161), (2.25, 3, 13, SRC, 4000, 162), (3.0, 3, 3, SRC, 4000, 163), (4.0, 3, 3, None, None, None), (5.0, 8, 0, None, None, None),
        (6.0, 1, 4, "::1", 7, 9), (30.0, 3, 3, SRC, 4000, 161),
    ]
    flows = spark.createDataFrame([(i, SRC, "203.0.113.9", 4000, 161 + i, 17, 1.0 + i, 0, 0, 0, 0) for i in range(2)], FLOWS)
    assert [m.cause for m in scan.icmp_causes(told, flows).orderBy("ts").collect()] == [0, 1, None, None, None, None, None]
    (e,) = scan.network_events(flows, icmp=told).collect()
    assert (e.src, e.icmp_error, e.rwa) == (SRC, 5, 2)


def test_a_sweep_of_all_ports_is_no_array(spark):
    flows = spark.range(0, 60_000).selectExpr("id as event_id", f"'{SRC}' as src", "'8.8.8.8' as dst", "1 as sport", "cast(id % 20000 as int) as dport", "6 as proto", "0.5D as ts", "0 as bwd_pkts", "1 as syn", "0 as ack", "0 as rst")
    events = scan.network_events(flows)
    assert "collect_" not in events._jdf.queryExecution().toString()
    (e,) = events.collect()
    assert (e.ports, e.hosts, e.rwa) == (20_000, 1, 20_000)
