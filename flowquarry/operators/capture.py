"""Audits of captures: per-file shares, the local side, load, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from .enrich import resolve_category

#: Parts of the names of resolvers that take queries over HTTPS.
DOH_NAMES = ("cloudflare-dns", "dns.google", "doh", "dns.quad9", "one.one.one.one", "mozilla.cloudflare")


def capture_audit(flows: DataFrame, *, by: str = "file") -> DataFrame:
    """Per file: packets, shares of TLS, of UDP and of unanswered flows, and hosts."""
    share = lambda test: F.avg(test.cast("int"))
    return flows.groupBy(by).agg(
        F.count("*").alias("packets"), share(F.col("dport") == 443).alias("tls_share"), share(F.col("proto") == 17).alias("udp_share"),
        share(F.col("bwd_pkts") == 0).alias("silent_share"), F.count_distinct("src").alias("hosts"),
    )


def _named(packets: DataFrame, messages: DataFrame, by: str) -> DataFrame:
    """(by, n, name): packets to outside addresses, added up by file and address, with the name that the last answer in
    any file gave the address."""
    outside = packets.where(F.col("dst").isNotNull() & ~net.is_local(F.col("dst"))).groupBy(by, "dst").agg(F.count("*").alias("n"))
    names = messages.where("answer is not null").groupBy(F.col("answer").alias("dst")).agg(F.max_by("name", F.struct("ts", "name")).alias("name"))
    return outside.join(names, "dst", "left")


def packet_audit(packets: DataFrame, messages: DataFrame, *, by: str = "file") -> DataFrame:
    """Per file, what a capture can tell of names: from packets (file, dst, sport, dport, proto, hello, sni) and DNS messages
    (file, ts, name, answer), the shares of hellos with a readable server name, of QUIC in encrypted web traffic, of queries
    for resolvers over HTTPS, and of packets to outside addresses that an answer names. A share of nothing is 0.

    Nulls are none of these; a file with messages and no packets has its row too.
    """
    p, c = F.col("proto"), F.col
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    doh = lambda name: F.lower(name).rlike("|".join(n.replace(".", r"\.") for n in DOH_NAMES))
    share = lambda part, whole: F.when(c(whole) > 0, c(part) / c(whole)).otherwise(0.0)
    seen = packets.groupBy(by).agg(
        F.count("*").alias("packets"), count((p == 6) & (c("dport") == 443)).alias("tcp443"), count((p == 17) & ((c("sport") == 443) | (c("dport") == 443))).alias("quic"),
        count(c("hello")).alias("hellos"), F.count("sni").alias("sni"), count(doh(c("sni"))).alias("__doh_sni"),
    )
    asked = messages.groupBy(by).agg(F.count("*").alias("queries"), count(doh(c("name"))).alias("__doh"))
    named = _named(packets, messages, by).groupBy(by).agg(F.sum("n").alias("outside"), F.coalesce(F.sum(F.when(c("name").isNotNull(), c("n"))), F.lit(0)).alias("named"))
    out = seen.join(asked, by, "full").join(named, by, "left").fillna(0).withColumns({"doh": c("__doh") + c("__doh_sni"), "web": c("quic") + c("tcp443")})
    shares = {"sni_share": share("sni", "hellos"), "quic_share": share("quic", "web"), "doh_share": share("doh", "queries"), "named_share": share("named", "outside")}
    return out.withColumns(shares).select(by, "packets", "tcp443", "quic", "hellos", "sni", "queries", "doh", "outside", "named", *shares)


def category_histogram(packets: DataFrame, messages: DataFrame, *, by: str = "file") -> DataFrame:
    """(file, category, packets, share): packets to outside addresses by the category of the name that an answer gave."""
    per = _named(packets, messages, by).groupBy(by, resolve_category(F.col("name"), F.col("dst")).alias("category")).agg(F.sum("n").alias("packets"))
    return per.withColumn("share", F.col("packets") / F.sum("packets").over(Window.partitionBy(by)))  # a row a category


def top_names(messages: DataFrame, *, n: int = 15) -> DataFrame:
    return messages.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def infer_local(packets: DataFrame, *, least_share: float = 0.01) -> DataFrame:
    """One row: the hardware address with enough of all frames that speaks for the fewest source addresses, and those."""
    per = packets.groupBy("mac").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))
    total = per.agg(F.sum("n").alias("all"))  # one row
    chosen = per.crossJoin(F.broadcast(total)).where(F.col("n") >= least_share * F.col("all")).orderBy("sources", "mac").limit(1).drop("all")
    addresses = packets.join(F.broadcast(chosen), "mac", "left_semi").groupBy("mac").agg(F.sort_array(F.collect_set("src")).alias("addresses"))
    return chosen.join(addresses, "mac")


def load_report(packets: DataFrame) -> DataFrame:
    """Per reason: escalations and their share."""
    per = packets.groupBy("reason").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a reason


def visibility_profile(flows: DataFrame) -> DataFrame:
    """One row of what a sensor can see."""
    return flows.agg(
        F.avg((F.col("dport") == 443).cast("int")).alias("tls_share"), F.avg(F.col("named").cast("int")).alias("named_flow_ratio"), F.max("fwd_bytes").alias("snaplen"),
        (F.max((F.col("proto") == 17).cast("int")) == 1).alias("quic_readable"),
    )


def label_windows(windows: DataFrame, labels: DataFrame, *, by: list[str], policy: str = "both") -> DataFrame:
    """attack: whether the window's host is an end of a label (src, dst, and the columns in by); policy picks the ends."""
    ends = {"src": ["src"], "dst": ["dst"], "both": ["src", "dst"]}[policy]
    hosts = labels.select(F.explode(F.array(*ends)).alias("host"), *by).where("host is not null").distinct().withColumn("attack", F.lit(True))
    return windows.join(hosts, ["host", *by], "left").fillna(False, ["attack"])


def align_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """(long table of side, feature and x over the columns whose normalised names both have, names left in a, in b)."""
    plain = lambda df: {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in df.columns}
    names_a, names_b = plain(a), plain(b)
    common = sorted(set(names_a.values()) & set(names_b.values()))
    long = lambda df, names, side: df.select(
        F.lit(side).alias("side"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c, n in names.items() if n in common])),
    )
    return long(a, names_a, 0).unionByName(long(b, names_b, 1)), sorted(set(names_a.values()) - set(common)), sorted(set(names_b.values()) - set(common))
