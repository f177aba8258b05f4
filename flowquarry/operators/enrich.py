"""Enrichment of connections: subnets, service classes, categories, orientation, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net

#: Service ports of each class of asset.
PORT_CLASSES = {
    "Directory": (88, 389, 464, 636, 749, 750, 3268, 3269),
    "FileShare": (137, 138, 139, 445, 2049),
    "RemoteAccess": (22, 23, 1723, 3389, 5900, 5985, 5986),
    "Mail": (25, 110, 143, 465, 587, 993, 995),
    "WebProxy": (80, 443, 3128, 8000, 8080, 8443),
    "Database": (1433, 1434, 1521, 3306, 5432, 27017, 50000),
    "Infra": (53, 67, 68, 111, 123, 135, 161, 162, 514, 546, 547, 5353, 5355),
}
#: Patterns of host names by category; the first that matches counts.
CATEGORIES = [
    ("Recon_API", r"(ip-api\.com|ipify\.org|ifconfig\.me|icanhazip|ipinfo\.io|myexternalip)"),
    ("Code_Repo_Paste", r"(github|githubusercontent|gitlab|bitbucket|pastebin|paste\.ee|gist\.)"),
    ("Messaging_API", r"(telegram|discord|slack\.com|teams\.microsoft|graph\.microsoft|mattermost|intercom\.io|zoom\.us|webex)"),
    (
        "Cloud_Storage",
        r"(drive\.google|docs\.google|dropbox|onedrive|1drv\.ms|s3[.-].*amazonaws|box\.com|mega\.nz|storage\.googleapis|substrate\.office|officeclient\.microsoft|sharepoint|blob\.core\.windows\.net)",
    ),
    ("CI_CD", r"(circleci|travis-ci|jenkins|actions\.github|codecov|docker\.io|ghcr\.io|pypi\.org|registry\.npmjs)"),
    ("Sync", r"(sync\.|clientsync|dropboxusercontent|apple-cloudkit|icloud|events\.data\.microsoft|settings-win\.data\.microsoft|-updater\.|updatecheck|oneclient\.sfx\.ms|edgedl|gvt1\.com)"),
]


def in_subnets(rows: DataFrame, nets: DataFrame, *, ip: str = "ip") -> DataFrame:
    """Rows joined with the subnets (net, bits) that hold their address, and whether it is the directed broadcast.

    The subnet table of a site is small; each of its rows is cut into the fixed prefixes of its own length, so the
    join is an equi-join on (bits, prefix) instead of a range join.
    """
    low = net.ipv4_number(F.col("net"))
    sized = nets.withColumn("__low", low).withColumn("__size", F.expr("shiftleft(1L, 32 - bits)"))
    keyed = sized.withColumn("__key", F.expr("__low div __size"))
    lengths = F.sequence(F.lit(0), F.lit(32))
    probes = rows.withColumn("__ip", net.ipv4_number(F.col(ip))).withColumn("__bits", F.explode(lengths)).withColumn("__probe", F.expr("__ip div shiftleft(1L, 32 - __bits)"))
    joined = probes.join(keyed, (F.col("__bits") == F.col("bits")) & (F.col("__probe") == F.col("__key")))
    return joined.withColumn("is_broadcast", F.col("__ip") == F.col("__low") + F.col("__size") - 1).drop("__low", "__size", "__key", "__ip", "__bits", "__probe")


def asset_class(flows: DataFrame, fanin: DataFrame, *, high: float, very_high: float, src_port: str = "sport", dst_port: str = "dport", peer: str = "dst") -> DataFrame:
    """The class of the service port, the smaller numeric one, or else how server-like the peer is."""
    port = F.least(F.col(src_port).try_cast("int"), F.col(dst_port).try_cast("int"))
    ports = {p: c for c, ps in PORT_CLASSES.items() for p in ps}
    fan = F.coalesce(F.col("fanin"), F.lit(0))
    by_fan = F.when(fan >= very_high, "Infra").when(fan >= high, "Unknown").otherwise("Workstation")
    return flows.join(fanin.select(peer, "fanin"), peer, "left").withColumn("asset_class", F.coalesce(net.lookup(ports, port), by_fan))


def resolve_category(name: Column, ip: Column) -> Column:
    by_name = F.when(name.rlike(f"(?i){CATEGORIES[0][1]}"), CATEGORIES[0][0])
    for category, pattern in CATEGORIES[1:]:
        by_name = by_name.when(name.rlike(f"(?i){pattern}"), category)
    return F.when(F.coalesce(name, F.lit("")) != "", by_name.otherwise("Browse")).when(net.is_local(ip), "Internal").otherwise("Unknown_External")


def orient_client(flows: DataFrame, *, src: str, dst: str, src_port: str, dst_port: str, up: str, down: str) -> DataFrame:
    """client, peer, up, down: the endpoint whose port is anonymous, not a number, is the client; else the source."""
    turned = F.col(src_port).rlike(r"^\d+$") & ~F.col(dst_port).rlike(r"^\d+$")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return flows.withColumns({"client": pick(src, dst), "peer": pick(dst, src), "up": pick(up, down), "down": pick(down, up)})


def to_connections(flows: DataFrame, *, local_ips: list[str] | None = None, src: str = "src", dst: str = "dst", up: str = "fwd_bytes", down: str = "bwd_bytes") -> DataFrame:
    """host, peer, up, down seen from the local side; transit between two outside addresses is dropped."""
    here, there = net.is_local(F.col(src), local_ips), net.is_local(F.col(dst), local_ips)
    pick = lambda a, b: F.when(here, F.col(a)).otherwise(F.col(b))
    return flows.where(here | there).withColumns({"host": pick(src, dst), "peer": pick(dst, src), "up": pick(up, down), "down": pick(down, up)})


def name_connections(conns: DataFrame, server_names: DataFrame, answers: DataFrame, *, order: str = "event_id") -> DataFrame:
    """Connections (uid, peer, ts and others) with name and named_by: the server name of their TLS session, else the
    latest DNS answer for the peer at or before them, else the peer's address.

    server_names has uid, server_name and ``order``, of which the last counts; answers has peer, ts and name.
    """
    last = server_names.where("server_name is not null and server_name <> ''").groupBy("uid").agg(F.max_by("server_name", order).alias("__server"))
    found = asof_names(conns.join(last, "uid", "left"), answers)
    by = F.when(F.col("__server").isNotNull(), "server").when(F.col("name").isNotNull(), "dns").otherwise("address")
    return found.withColumns({"named_by": by, "name": F.coalesce("__server", "name", "peer")}).drop("__server")


def asof_names(conns: DataFrame, answers: DataFrame, *, ip: str = "peer", ts: str = "ts") -> DataFrame:
    """Each connection with the latest name answered for its peer at or before it; an answer of the same time counts.

    Both are put in one window by address, so a busy address costs one sort, not a pair for each answer.
    """
    cols = [c for c in conns.columns if c not in (ip, ts)]
    a = answers.select(F.col(ip), F.col(ts), F.lit(0).alias("__conn"), F.col("name").alias("__name"), F.lit(None).cast(conns.select(F.struct(*cols)).schema[0].dataType).alias("__row"))
    c = conns.select(F.col(ip), F.col(ts), F.lit(1).alias("__conn"), F.lit(None).cast("string").alias("__name"), F.struct(*cols).alias("__row"))
    w = Window.partitionBy(ip).orderBy(ts, "__conn", "__name").rowsBetween(Window.unboundedPreceding, 0)
    named = a.unionByName(c).withColumn("name", F.last("__name", ignorenulls=True).over(w)).where("__conn = 1")
    return named.select(ip, ts, *[F.col(f"__row.{x}").alias(x) for x in cols], "name")


def blocklist_hits(flows: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Rows whose ja4, else ja3, else ja3s is in the blocklist (fingerprint, label): the first that hits counts."""
    out = flows
    for c in ("ja4", "ja3", "ja3s"):
        listed = blocklist.select(F.lower("fingerprint").alias(f"__{c}"), F.col("label").alias(f"__{c}_label"))
        out = out.join(listed, F.lower(F.col(c)) == F.col(f"__{c}"), "left")
    hit = F.coalesce("__ja4_label", "__ja3_label", "__ja3s_label")
    by = F.when(F.col("__ja4_label").isNotNull(), "ja4").when(F.col("__ja3_label").isNotNull(), "ja3").otherwise("ja3s")
    return out.withColumn("blocked_as", hit).withColumn("blocked_by", by).where("blocked_as is not null").drop(*[f"__{c}{s}" for c in ("ja4", "ja3", "ja3s") for s in ("", "_label")])
