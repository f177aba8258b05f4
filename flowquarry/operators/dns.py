"""DNS behaviour of hosts and of base domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net, ordered, stats, text

#: Record types that ordinary lookups rarely ask for.
RARE_TYPES = ("TXT", "NULL", "CNAME", "MX", "SRV", "ANY", "PRIVATE")


def with_base(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"base": text.base_domain(F.col("name")), "type": net.qtype_name(F.col("qtype"))})


def nxdomain_rate(messages: DataFrame, *, seconds: float = 300.0, least: int = 10) -> DataFrame:
    """Each message with its client's NXDOMAIN answers in the seconds before, and whether that makes it a suspect."""
    n = F.sum((F.col("rcode") == 3).cast("int")).over(stats.trailing("client", seconds=seconds))
    return messages.withColumn("nxdomain_count", n).withColumn("suspect", F.col("nxdomain_count") >= least)


def nx_confidence(rate: Column, failures: Column) -> Column:
    """Of a burst of failures, by their share of the replies and their number."""
    return F.round(0.6 + 0.25 * F.least(F.lit(1.0), (rate - 0.5) / 0.5) + 0.15 * F.least(F.lit(1.0), failures / 80), 6)


def rtype_confidence(rare_share: Column, names: Column) -> Column:
    """Of queries for rare record types, by their share and the number of names."""
    return F.round(0.6 + 0.25 * F.least(F.lit(1.0), (rare_share - 0.5) / 0.5) + 0.15 * F.least(F.lit(1.0), names / 100), 6)


def fanout_confidence(mean_label: Column, names: Column, *, label: float = 20.0) -> Column:
    """Of many long names under one base domain, by the mean length of their first labels and their number."""
    return F.round(0.6 + 0.2 * F.least(F.lit(1.0), (mean_label - label) / 40) + 0.2 * F.least(F.lit(1.0), names / 200), 6)


def nx_burst(responses: DataFrame, *, seconds: float = 300.0, nx: int = 20, rate: float = 0.5, replies: int = 25, bases: int = 10) -> DataFrame:
    """Responses after which a client's failures are many, frequent, and spread over base domains."""
    failed = F.col("rcode") == 3
    f = ordered.trailing_state(responses, ["client"], seconds=seconds, n="replies", sums={"nx": failed.cast("int")}, kinds={"__bases": F.when(failed, F.col("base"))})
    f = f.withColumns({"nx_bases": F.col("__bases.kinds"), "nx_rate": F.col("nx") / F.col("replies")}).drop("__bases")
    conf = nx_confidence(F.col("nx_rate"), F.col("nx"))
    return f.where((F.col("nx") >= nx) & (F.col("nx_rate") >= rate) & (F.col("replies") >= replies) & (F.col("nx_bases") >= bases)).withColumn("confidence", conf)


def rtype_anomaly(queries: DataFrame, *, seconds: float = 300.0, least: int = 30, names: int = 20, share: float = 0.5) -> DataFrame:
    """Queries after which a client asks one base domain for many names, mostly of rare types."""
    f = ordered.trailing_state(queries, ["client", "base"], seconds=seconds, n="queries", sums={"rare": F.col("type").isin(*RARE_TYPES).cast("int")}, kinds={"__names": F.col("name")})
    f = f.withColumns({"names": F.col("__names.kinds"), "rare_share": F.col("rare") / F.col("queries")}).drop("__names")
    conf = rtype_confidence(F.col("rare_share"), F.col("names"))
    return f.where((F.col("queries") >= least) & (F.col("names") >= names) & (F.col("rare_share") >= share)).withColumn("confidence", conf)


def subdomain_fanout(queries: DataFrame, *, seconds: float = 300.0, names: int = 50, label: float = 20.0) -> DataFrame:
    """Queries after which a client has asked one base domain for many long names."""
    label_length = F.length(F.substring_index("name", ".", 1))
    f = ordered.trailing_state(queries, ["client", "base"], seconds=seconds, n="__n", sums={"__labels": label_length}, kinds={"__names": F.col("name")})
    f = f.withColumns({"names": F.col("__names.kinds"), "mean_label": F.col("__labels") / F.col("__n")}).drop("__names", "__labels", "__n")
    conf = fanout_confidence(F.col("mean_label"), F.col("names"), label=label)
    return f.where((F.col("names") >= names) & (F.col("mean_label") >= label)).withColumn("confidence", conf)


def dns_bytes(queries: DataFrame, responses: DataFrame, *, seconds: int = 300, least: int = 3) -> DataFrame:
    """Bytes each client sent to and got from each base domain in each window: only for enough queries, both positive."""
    start = (F.floor(F.col("ts") / seconds) * seconds).alias("window_start")
    keys = ["client", "base", "window_start"]
    q = queries.select("client", "base", start, F.col("bytes").alias("sent"), F.lit(None).cast("long").alias("got"))
    r = responses.select("client", "base", start, F.lit(None).cast("long").alias("sent"), F.col("bytes").alias("got"))
    out = q.unionByName(r).groupBy(*keys).agg(F.count("sent").alias("n"), F.sum("sent").alias("bytes_out"), F.sum("got").alias("bytes_in"))
    return out.where((F.col("n") >= least) & (F.col("bytes_out") > 0) & (F.col("bytes_in") > 0))


def dns_host_summary(messages: DataFrame, *, types: int = 8) -> DataFrame:
    """Per client: messages, failure rate, and its commonest record types as a map."""
    per = messages.groupBy("client", "type").agg(F.count("*").alias("n"), F.sum((F.col("rcode") == 3).cast("int")).alias("nx"))
    mix = F.transform(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), F.col("type")))), 1, types), lambda x: F.struct(x["type"].alias("key"), (-x["col1"]).alias("value")))
    return per.groupBy("client").agg(F.sum("n").alias("messages"), (F.sum("nx") / F.sum("n")).alias("nx_rate"), F.map_from_entries(mix).alias("types"))
