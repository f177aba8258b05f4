"""Column functions on addresses, ports and protocols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"

#: IP protocol numbers, service ports and DNS record types by their public names.
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMP6", 132: "SCTP"}
SERVICES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 80: "http", 110: "pop3", 139: "smb", 143: "imap",
    443: "ssl", 445: "smb", 993: "ssl", 995: "ssl", 3306: "mysql", 3389: "rdp", 5432: "postgres", 8080: "http",
}
RECORD_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 35: "NAPTR",
    43: "DS", 48: "DNSKEY", 52: "TLSA", 64: "SVCB", 65: "HTTPS", 99: "SPF", 255: "ANY", 257: "CAA",
}
#: UDP source ports of services that answer with more than they are asked.
AMPLIFIERS = {
    17: "QOTD", 19: "CharGen", 53: "DNS", 69: "TFTP", 111: "Portmap", 123: "NTP", 137: "NetBIOS", 161: "SNMP", 389: "CLDAP", 520: "RIP",
    623: "IPMI", 1434: "MSSQL", 1900: "SSDP", 3283: "ARMS", 3702: "WS-Discovery", 5351: "NAT-PMP", 5683: "CoAP", 10001: "Ubiquiti",
    11211: "Memcached", 37810: "DVR",
}


def lookup(table: dict, key: Column) -> Column:
    """The table's value for the key, null if it has none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a long, null for anything else."""
    part = F.split(ip, r"\.")
    octet = lambda i: F.shiftleft(F.get(part, F.lit(i)).try_cast("long"), 24 - 8 * i)
    number = octet(0) + octet(1) + octet(2) + octet(3)
    return F.when(ip.rlike(V4), number)


def _prefix(net: str) -> str:
    """A pattern for the addresses of an IPv4 network, as dotted text."""
    base, _, bits = net.partition("/")
    octets, whole, rest = [int(x) for x in base.split(".")], int(bits) // 8, int(bits) % 8
    out = "".join(rf"{x}\." for x in octets[:whole])
    if rest:
        out += f"(?:{'|'.join(map(str, range(octets[whole], octets[whole] + (1 << 8 - rest))))})" + r"\."
    return out


def _in(ip: Column, *nets: str) -> Column:
    """Whether an IPv4 address is in one of the networks, by their text; null for what is none. Text patterns are
    looked at many times as fast as numbers made of four parts."""
    return F.when(ip.rlike(V4), ip.rlike(f"^(?:{'|'.join(map(_prefix, nets))})"))


def _v6_head(ip: Column) -> Column:
    """The first 16 bits of an IPv6 address, null for anything else."""
    return F.when(ip.contains(":") & ip.rlike(r"^[0-9A-Fa-f:.]+$"), F.coalesce(F.conv(F.nullif(F.split(ip, ":")[0], F.lit("")), 16, 10).cast("int"), F.lit(0)))


def _v6_is(ip: Column, tail: str) -> Column:
    """True for :: (tail "") or ::1 in their shortest or full spellings."""
    return ip.rlike(rf"^(::|(0+:)+:?|(0+:){{7}}0*){tail}$" if tail else r"^(::|(0+:){7}0+)$")


def is_internal(ip: Column) -> Column:
    """RFC 1918, shared and unique local addresses."""
    return F.coalesce(_in(ip, "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10"), F.shiftright(_v6_head(ip), 9) == 0xFC00 >> 9, F.lit(False))


def _multicast(ip: Column) -> Column:
    return F.coalesce(_in(ip, "224.0.0.0/4"), F.shiftright(_v6_head(ip), 8) == 0xFF, F.lit(False))


def _link_local(ip: Column) -> Column:
    return F.coalesce(_in(ip, "169.254.0.0/16"), F.shiftright(_v6_head(ip), 6) == 0xFE80 >> 6, F.lit(False))


def _unspecified(ip: Column) -> Column:
    return (ip == "0.0.0.0") | _v6_is(ip, "")


def _loopback(ip: Column) -> Column:
    return F.coalesce(_in(ip, "127.0.0.0/8"), _v6_is(ip, "0*1"), F.lit(False))


def _known(ip: Column) -> Column:
    return ip.rlike(V4) | _v6_head(ip).isNotNull()


def is_external(ip: Column) -> Column:
    """Routable and not internal."""
    odd = _loopback(ip) | _link_local(ip) | _multicast(ip) | _unspecified(ip) | F.coalesce(_in(ip, "240.0.0.0/4"), F.lit(False))
    return F.coalesce(_known(ip) & ~is_internal(ip) & ~odd, F.lit(False))


def is_skip_dst(ip: Column) -> Column:
    """Never the target of a beacon; also what is no address."""
    return F.coalesce(~_known(ip) | _multicast(ip) | _link_local(ip) | _unspecified(ip) | (ip == "255.255.255.255"), F.lit(True))


def is_group_dst(ip: Column) -> Column:
    """Multicast, limited broadcast or unspecified."""
    return F.coalesce(_multicast(ip) | _unspecified(ip) | (ip == "255.255.255.255"), F.lit(False))


def is_bogon(ip: Column) -> Column:
    """No real source on the internet; also what is no address."""
    h = _v6_head(ip)
    reserved = F.coalesce(_in(ip, "240.0.0.0/4"), (h < 0x2000) | h.between(0x4000, 0xFBFF) | h.between(0xFE00, 0xFE7F), F.lit(False))
    return F.coalesce(~_known(ip) | _unspecified(ip) | _loopback(ip) | _multicast(ip) | reserved, F.lit(True))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, null for anything else. Spellings without colons are taken too."""
    halves = F.split(F.lower(ip), "::")
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    left = groups(F.get(halves, F.lit(0)))
    right = F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    digits = lambda part: F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")
    whole = F.when(F.size(halves) == 1, n == 8).otherwise((F.size(halves) == 2) & (n < 8))
    spelled = F.when(whole, F.concat(digits(left), F.repeat(F.lit("0000"), 8 - n), digits(right)))
    short = F.forall(F.concat(left, right), lambda g: F.length(g) <= 4)
    return F.when(ip.rlike("^[0-9A-Fa-f]{32}$"), F.lower(ip)).when(ip.contains(":") & ip.rlike("^[0-9A-Fa-f:]+$") & ~ip.contains(":::") & short, spelled)


def is_local(ip: Column, local_ips: list[str] | None = None) -> Column:
    """In the given set of local addresses; if none is given, private, loopback or link-local."""
    if local_ips is not None:
        return F.coalesce(ip.isin(local_ips), F.lit(False))
    x = F.when(~ip.rlike(V4), ipv6_hex(ip))
    head = F.conv(F.substring(x, 1, 4), 16, 10).cast("int")
    v4 = _in(ip, "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")
    return F.coalesce(v4, F.lit(False)) | F.coalesce((F.shiftright(head, 9) == 0xFC00 >> 9) | (F.shiftright(head, 6) == 0xFE80 >> 6) | (x == "1".zfill(32)), F.lit(False))


def net_prefix(ip: Column) -> Column:
    """The /24 of an IPv4 address, the /48 of an IPv6 one."""
    return F.when(ip.contains(":"), F.array_join(F.slice(F.split(ip, ":"), 1, 3), ":")).otherwise(F.substring_index(ip, ".", 3))


def proto_name(number: Column) -> Column:
    return F.coalesce(lookup(PROTOCOLS, number.cast("int")), number.cast("string"))


def port_service(port: Column, proto: Column) -> Column:
    return F.coalesce(lookup(SERVICES, port.cast("int")), F.when(proto == 17, "other-udp").otherwise("other"))


def qtype_name(number: Column) -> Column:
    n = number.cast("int")
    return F.when(n.between(65280, 65534), "PRIVATE").otherwise(F.coalesce(lookup(RECORD_TYPES, n), F.concat(F.lit("TYPE"), n.cast("string"))))


def flow_family(proto: Column, sport: Column, syn_only: Column) -> Column:
    """The family of attack that one flow could be part of."""
    amplifier = lookup(AMPLIFIERS, sport.cast("int"))
    return (
        F.when((proto == 6) & syn_only, "SYN flood")
        .when((proto == 17) & amplifier.isNotNull(), F.concat(F.lit("UDP reflection/amplification ("), amplifier, F.lit(")")))
        .when(proto == 17, "UDP flood")
        .when(proto == 6, "TCP flood")
    )


def ip_level_bytes(payload: Column, packets: Column, ip: Column) -> Column:
    """Bytes with an IP header added for each packet: 40 for IPv6, 20 for IPv4."""
    return payload + packets * F.when(ip.contains(":"), 40).otherwise(20)


def conn_state(rst: Column, fin: Column, bwd_pkts: Column, fwd_pkts: Column) -> Column:
    """A simplified connection state."""
    return F.when(rst > 0, "RST").when(fin > 0, "FIN").when(bwd_pkts == 0, "REQ").when((fwd_pkts > 0) & (bwd_pkts > 0), "CON").otherwise("INT")


def community_id(src: Column, dst: Column, sport: Column, dport: Column, proto: Column) -> Column:
    """Community ID version 1 of an IPv4 or IPv6 flow, the same for both directions; null for other flows."""
    h = lambda x, n: F.lpad(F.hex(x.cast("long")), n, "0")
    number = lambda ip: F.coalesce(F.lower(h(ipv4_number(ip), 8)), ipv6_hex(ip))

    def of(ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        turned = (a > b) | ((a == b) & (sport > dport))
        pick = lambda x, y: F.when(turned, y).otherwise(x)
        data = F.concat(F.lit("0000"), pick(a, b), pick(b, a), h(proto, 2), F.lit("00"), pick(h(sport, 4), h(dport, 4)), pick(h(dport, 4), h(sport, 4)))
        ok = (F.length(a) == F.length(b)) & proto.isin(6, 17, 132) & sport.between(0, 65535) & dport.between(0, 65535)
        return F.when(ok, F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(data))))))

    return _let(F.struct(number(src).alias("a"), number(dst).alias("b")), of)
