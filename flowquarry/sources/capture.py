"""Packet captures (pcap and pcapng) as tables of packets, and the DNS messages in them."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

PACKET_SCHEMA = "file string, ts double, src string, dst string, proto int, sport int, dport int, flags int, window int, header_size int, payload_size int, l4_len int, wire_len int, payload binary"
ICMP_SCHEMA = "file string, ts double, src string, dst string, proto int, icmp_type int, icmp_code int, q_src string, q_dst string, q_proto int, q_sport int, q_dport int"
DNS_SCHEMA = "ts double, src string, dst string, name string, qtype int, is_response boolean, rcode int, answers int, answer_ips array<string>, bytes int"

#: Link types, with where the network header begins and where its type stands (None: from its version).
LINK_LAYERS = {1: (14, 12), 12: (0, None), 14: (0, None), 101: (0, None), 228: (0, None), 229: (0, None), 113: (16, 14), 276: (20, 0), 0: (4, None)}
#: The types of ICMP and ICMPv6 errors, which quote the packet that they are about.
ERRORS_V4, ERRORS_V6 = (3, 4, 5, 11, 12), (1, 2, 3, 4)
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
#: IPv6 extension headers that are skipped; 44 is the fragment header.
EXTENSIONS = (0, 43, 44, 60)
PCAP_MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}


def frames(data: bytes) -> Iterator[tuple[float, int, bytes, int]]:
    """(time, link type, frame, length on the wire) of a capture; ends quietly where the file is cut off."""
    if data[:4] in PCAP_MAGICS:
        order, unit = PCAP_MAGICS[data[:4]]
        link = struct.unpack_from(order + "I", data, 20)[0] & 0x0FFFFFFF if len(data) >= 24 else None
        at = 24
        while link is not None and at + 16 <= len(data):
            sec, part, size, wire = struct.unpack_from(order + "4I", data, at)
            if at + 16 + size > len(data):
                return
            yield sec + part / unit, link, data[at + 16 : at + 16 + size], wire
            at += 16 + size
    elif data[:4] == b"\x0a\x0d\x0d\x0a":
        yield from blocks(lambda at, n: data[at : at + n])
    else:
        raise ValueError("neither pcap nor pcapng")


def blocks(get: Callable[[int, int], bytes]) -> Iterator[tuple[float, int, bytes, int]]:
    """The same of a pcapng file, of which get(place, n) gives n bytes, fewer at the end; places only grow."""
    at, order, interfaces = 0, "<", []
    while len(head := get(at, 12)) == 12:
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        kind, size = struct.unpack_from(order + "II", head)
        if size < 12 or len(block := get(at, size)) < size:
            return
        body = block[8 : size - 4]
        if kind == 1:
            interfaces.append((struct.unpack_from(order + "H", body)[0], _clock(body[8:], order)))
        elif kind == 6:
            n, high, low, kept, wire = struct.unpack_from(order + "5I", body)
            if n < len(interfaces):
                link, unit = interfaces[n]
                yield ((high << 32) | low) / unit, link, body[20 : 20 + kept], wire
        at += size


def _clock(options: bytes, order: str) -> float:
    """Ticks a second, from an interface's options."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            v = options[at + 4]
            return 2.0 ** (v & 0x7F) if v & 0x80 else 10.0**v
        if not code:
            break
        at += 4 + size + -size % 4
    return 1e6


def _network(link: int, frame: bytes) -> tuple[int, int, tuple[bytes, bytes], int, int, int] | None:
    """(version, protocol, addresses, where its data begin, how many, where the header begins) of a frame's packet over IP."""
    at, kind_at = LINK_LAYERS[link]
    if kind_at is not None:
        kind = int.from_bytes(frame[kind_at : kind_at + 2], "big")
        while link == 1 and kind in VLAN_TAGS:
            kind = int.from_bytes(frame[at + 2 : at + 4], "big")
            at += 4
        version = {0x0800: 4, 0x86DD: 6}.get(kind)
    else:
        version = frame[at] >> 4
    return _header(frame, at, version)


def _header(frame: bytes, at: int, version: int | None) -> tuple[int, int, tuple[bytes, bytes], int, int, int] | None:
    """The same of a header of IP at a place; None for all but first fragments."""
    if version == 4:
        head = (frame[at] & 15) * 4
        total, fragment = struct.unpack_from(">H2xH", frame, at + 2)
        if fragment & 0x1FFF:
            return None
        return 4, frame[at + 9], (frame[at + 12 : at + 16], frame[at + 16 : at + 20]), at + head, total - head, at
    if version == 6:
        body, proto = struct.unpack_from(">HB", frame, at + 4)
        ends, l4 = (frame[at + 8 : at + 24], frame[at + 24 : at + 40]), at + 40
        while proto in EXTENSIONS:
            if proto == 44 and struct.unpack_from(">H", frame, l4 + 2)[0] & 0xFFF8:
                return None
            size = 8 if proto == 44 else 8 * (frame[l4 + 1] + 1)
            proto, l4, body = frame[l4], l4 + size, body - size
        return 6, proto, ends, l4, body, at
    return None


def packet(ts: float, link: int, frame: bytes, wire: int) -> tuple | None:
    """The columns of a packet after its file; None for all but first fragments of TCP and UDP over IP."""
    try:
        found = _network(link, frame)
        if found is None or found[1] not in (6, 17):
            return None
        version, proto, ends, l4, body, at = found
        sport, dport = struct.unpack_from(">HH", frame, l4)
        ip_payload = len(frame) - (at + (40 if version == 6 else (frame[at] & 15) * 4))
        if proto == 6:
            offset, flags, window = struct.unpack_from(">BBH", frame, l4 + 12)
            header = (offset >> 4) * 4 or 20
            length = max(0, body - header)
        else:
            declared = struct.unpack_from(">H", frame, l4 + 4)[0]
            header, flags, window = 8, 0, 0
            length = max(0, (declared or ip_payload) - 8)
        src, dst = (str(ipaddress.ip_address(e)) for e in ends)
    except (KeyError, IndexError, struct.error, ValueError):
        return None
    return ts, src, dst, proto, sport, dport, flags, window, header, max(0, ip_payload), length, wire, frame[l4 + header : l4 + header + length]


def icmp_message(ts: float, link: int, frame: bytes) -> tuple | None:
    """The columns of an ICMP message after its file, with the addresses and ports of the packet that an error quotes."""
    try:
        found = _network(link, frame)
        if found is None or found[1] not in (1, 58):
            return None
        _, proto, ends, l4, _, _ = found
        kind, code = frame[l4], frame[l4 + 1]
        src, dst = (str(ipaddress.ip_address(e)) for e in ends)
    except (KeyError, IndexError, struct.error, ValueError):
        return None
    quoted: tuple = (None,) * 5
    if kind in (ERRORS_V4 if proto == 1 else ERRORS_V6):
        try:
            _, inner, addresses, at, _, _ = _header(frame, l4 + 8, frame[l4 + 8] >> 4)
            ports = struct.unpack_from(">HH", frame, at) if inner in (6, 17) else (None, None)
            quoted = (*(str(ipaddress.ip_address(e)) for e in addresses), inner, *ports)
        except (TypeError, IndexError, struct.error, ValueError):
            pass  # a quotation that is cut short names no packet
    return ts, src, dst, proto, kind, code, *quoted


def parse_icmp(files: DataFrame) -> DataFrame:
    """ICMP messages of captures given as rows (path, content)."""
    names = [c.split()[0] for c in ICMP_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False):
                found = [(path, *row) for ts, link, frame, _ in frames(bytes(content)) if (row := icmp_message(ts, link, frame)) is not None]
                if found:
                    table = pd.DataFrame(found, columns=names)
                    yield table.astype({c: "Int32" for c in ("q_proto", "q_sport", "q_dport")})

    return files.select("path", "content").mapInPandas(run, ICMP_SCHEMA)


def parse_captures(files: DataFrame) -> DataFrame:
    """Packets of captures given as rows (path, content)."""
    names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in batch[["path", "content"]].itertuples(index=False):
                found = []
                for frame in frames(bytes(content)):
                    if (row := packet(*frame)) is not None:
                        found.append((path, *row))
                    if len(found) >= 20_000:
                        yield pd.DataFrame(found, columns=names)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=names)

    return files.select("path", "content").mapInPandas(run, PACKET_SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all captures that the path matches, one task a few files. Spark reads the files, from any store; each
    is held whole by its task, so a capture may have 2 GB at most; capture_source reads longer ones, in ranges."""
    return parse_captures(spark.read.format("binaryFile").load(path))


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A domain name, with pointers followed, and where it ends."""
    labels, end, hops = [], None, 0
    while True:
        n = data[at]
        if n & 0xC0 == 0xC0:
            end = end or at + 2
            at = (n & 0x3F) << 8 | data[at + 1]
            hops += 1
            if hops > 16:
                raise ValueError("names point in a circle")
        elif not n:
            return ".".join(labels), end or at + 1
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n


def dns_message(data: bytes) -> tuple | None:
    """(name, qtype, is_response, rcode, answers, answer addresses), None for what is no message with a question."""
    try:
        flags, questions, answers = struct.unpack_from(">HHH", data, 2)
        if not questions:
            return None
        name, at = _name(data, 12)
        qtype, at = struct.unpack_from(">H", data, at)[0], at + 4
        addresses = []
        for _ in range(answers):
            _, at = _name(data, at)
            kind, size = struct.unpack_from(">H6xH", data, at)
            value = data[at + 10 : at + 10 + size]
            if (kind, size) in ((1, 4), (28, 16)):
                addresses.append(str(ipaddress.ip_address(value)))
            at += 10 + size
    except (IndexError, struct.error, ValueError):
        return None
    return name.lower(), qtype, bool(flags & 0x8000), flags & 15, answers, addresses


def dns_messages(packets: DataFrame) -> DataFrame:
    """DNS messages among packets: UDP and multicast, and TCP with its length in front."""
    names = [c.split()[0] for c in DNS_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ts, src, dst, proto, payload in batch.itertuples(index=False):
                data = bytes(payload)[2:] if proto == 6 else bytes(payload)
                if (m := dns_message(data)) is not None:
                    out.append((ts, src, dst, *m, len(data)))
            if out:
                yield pd.DataFrame(out, columns=names)

    ports = F.col("sport").isin(53, 5353) | F.col("dport").isin(53, 5353)
    return packets.where(ports & (F.length("payload") > 12)).select("ts", "src", "dst", "proto", "payload").mapInPandas(run, DNS_SCHEMA)


HELLO_FIELDS = "version int, ciphers array<int>, extensions array<int>, groups array<int>, formats array<int>, sig_algs array<int>, alpn array<string>, versions array<int>, sni string"
SERVER_FIELDS = "server_version int, cipher int, server_extensions array<int>, negotiated int, server_alpn string"
HELLO_SCHEMA = f"key string, src string, sport int, {HELLO_FIELDS}"
SERVER_SCHEMA = f"key string, src string, sport int, {SERVER_FIELDS}"


def handshake(data: bytes, kind: int) -> bytes | None:
    """The body of the handshake message at the start of a TLS stream, put together from as many records as it takes;
    None if it is of another kind or not whole."""
    message, at = b"", 0
    while at + 5 <= len(data) and data[at] == 22:
        size = struct.unpack_from(">H", data, at + 3)[0]
        message += data[at + 5 : at + 5 + size]
        at += 5 + size
        if message and message[0] != kind:
            return None
        if len(message) >= 4 and len(message) >= 4 + int.from_bytes(message[1:4], "big"):
            return message[4 : 4 + int.from_bytes(message[1:4], "big")]
    return None


def _extensions(body: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(type, data) of the extensions whose length stands at ``at``; none if there is no such length."""
    if at + 2 > len(body):
        return
    end = at + 2 + struct.unpack_from(">H", body, at)[0]
    at += 2
    while at + 4 <= end:
        kind, size = struct.unpack_from(">HH", body, at)
        if at + 4 + size > len(body):
            raise ValueError("an extension is cut off")
        yield kind, body[at + 4 : at + 4 + size]
        at += 4 + size


def _numbers(data: bytes, at: int) -> list[int]:
    return list(struct.unpack_from(f">{(len(data) - at) // 2}H", data, at))


def _strings(data: bytes, at: int) -> list[str]:
    out = []
    while at < len(data):
        out.append(data[at + 1 : at + 1 + data[at]].decode("latin-1"))
        at += 1 + data[at]
    return out


def client_hello(data: bytes) -> tuple | None:
    """HELLO_FIELDS of a TLS ClientHello at the start of a stream, None for anything else."""
    try:
        body = handshake(data, 1)
        if body is None:
            return None
        version = struct.unpack_from(">H", body)[0]
        at = 35 + body[34]
        n = struct.unpack_from(">H", body, at)[0]
        ciphers = _numbers(body[at + 2 : at + 2 + n], 0)
        at += 2 + n
        at += 1 + body[at]
        found = dict.fromkeys((10, 13, 43), [])
        extensions, formats, alpn, sni = [], [], [], None
        for kind, value in _extensions(body, at):
            extensions.append(kind)
            if kind == 0 and len(value) > 5:
                sni = value[5:].decode("latin-1")
            elif kind in (10, 13):
                found[kind] = _numbers(value, 2)
            elif kind == 11:
                formats = list(value[1:])
            elif kind == 16:
                alpn = _strings(value, 2)
            elif kind == 43:
                found[kind] = _numbers(value, 1)
    except (IndexError, struct.error, ValueError):
        return None
    return version, ciphers, extensions, found[10], formats, found[13], alpn, found[43], sni


def server_hello(data: bytes) -> tuple | None:
    """SERVER_FIELDS of a TLS ServerHello at the start of a stream, None for anything else."""
    try:
        body = handshake(data, 2)
        if body is None:
            return None
        version = struct.unpack_from(">H", body)[0]
        at = 35 + body[34]
        cipher = struct.unpack_from(">H", body, at)[0]
        extensions, negotiated, alpn = [], version, None
        for kind, value in _extensions(body, at + 3):
            extensions.append(kind)
            if kind == 43 and len(value) == 2:
                negotiated = struct.unpack(">H", value)[0]
            elif kind == 16:
                alpn = next(iter(_strings(value, 2)), None)
    except (IndexError, struct.error, ValueError):
        return None
    return version, cipher, extensions, negotiated, alpn


def _hellos(packets: DataFrame, first: int, parse: Callable[[bytes], tuple | None], schema: str) -> DataFrame:
    names = T.StructType.fromDDL(schema).fieldNames()
    w = Window.partitionBy("key", "src", "sport").orderBy("ts")
    early = packets.where("length(payload) > 0").withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= first)
    streams = early.groupBy("key", "src", "sport").agg(F.sort_array(F.collect_list(F.struct("__i", F.hex("payload").alias("x")))).alias("p"))
    joined = streams.select("key", "src", "sport", F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), "")).alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, s, p, *h) for k, s, p, d in batch.itertuples(index=False) if (h := parse(bytes(d))) is not None]
            if out:
                yield pd.DataFrame(out, columns=names)

    return joined.mapInPandas(run, schema)


def client_hellos(packets: DataFrame, *, first: int = 8) -> DataFrame:
    """A row for each direction of a flow (column key) whose first payloads begin with a ClientHello."""
    return _hellos(packets, first, client_hello, HELLO_SCHEMA)


def server_hellos(packets: DataFrame, *, first: int = 8) -> DataFrame:
    """A row for each direction of a flow (column key) whose first payloads begin with a ServerHello."""
    return _hellos(packets, first, server_hello, SERVER_SCHEMA)


def tls_sessions(packets: DataFrame, *, first: int = 8) -> DataFrame:
    """Per flow with a ClientHello: both hellos' fields, with ja3 and, where the server's was seen, ja3s."""
    c = client_hellos(packets, first=first)
    s = server_hellos(packets, first=first).drop("src", "sport")
    ja3 = text.ja3(*[F.col(x) for x in ("version", "ciphers", "extensions", "groups", "formats")])
    ja3s = F.when(F.col("cipher").isNotNull(), text.ja3s(F.col("server_version"), F.col("cipher"), F.col("server_extensions")))
    return c.join(s, "key", "left").withColumns({"ja3": ja3, "ja3s": ja3s})
