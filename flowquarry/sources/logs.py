"""Readers of connection logs, flow tables, labels and reference data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLOW_COLUMNS = "time long, duration double, src string, sport string, dst string, dport string, protocol string, packets long, bytes long"


def read_zeek(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of Zeek logs, TSV with a #fields header or JSON lines, plain or gzipped; - and (empty) are null.

    The header is data here, not driver state: each file's #fields line is joined to its rows by file name.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    tsv = lines.where(~F.col("value").startswith("{"))
    heads = tsv.where(F.col("value").startswith("#fields")).groupBy("file").agg(F.max(F.slice(F.split("value", "\t"), 2, 1000)).alias("fields"))
    body = tsv.where(~F.col("value").startswith("#") & (F.col("value") != "")).join(heads, "file")
    cells = F.map_from_arrays(F.slice("fields", 1, F.size("cells")), F.slice("cells", 1, F.size("fields")))
    parsed = body.withColumn("cells", F.split("value", "\t")).withColumn("row", cells)
    blank = lambda c: F.when(~c.isin("-", "(empty)"), c)
    out = parsed.select(*[blank(F.col("row")[c]).alias(c) for c in columns])
    json = lines.where(F.col("value").startswith("{")).select(*[F.get_json_object("value", f"$['{c}']").alias(c) for c in columns])
    return out.unionByName(json)


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Enterprise flow tables of nine columns without a header; rows that do not parse are dropped."""
    return spark.read.schema(FLOW_COLUMNS).option("mode", "DROPMALFORMED").csv(path).where("time is not null and src is not null and dst is not null")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("time long, user string, src string, dst string").option("mode", "DROPMALFORMED").csv(path)
    return raw.where("time is not null").withColumn("user", F.substring_index("user", "@", 1))


def amount(text: Column) -> Column:
    """A number that may end in K, M or G."""
    t = F.upper(F.trim(text))
    unit = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("G"), 1e9).otherwise(1.0)
    return F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double") * unit


def read_labelled_flows(spark: SparkSession, path: str, *, normal: str = "normal") -> DataFrame:
    """NetFlow-style labelled tables: amounts with suffixes, flags such as .AP.SF, dates; victims count as normal."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    flag = lambda c: F.col("Flags").contains(c).cast("int")
    return raw.select(
        F.try_to_timestamp(F.col("Date first seen"), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), F.upper(F.trim("Proto")).alias("protocol"), F.col("Src IP Addr").alias("src"), F.col("Src Pt").try_cast("int").alias("sport"),
        F.col("Dst IP Addr").alias("dst"), F.col("Dst Pt").try_cast("double").cast("int").alias("dport"), amount(F.col("Packets")).alias("packets"), amount(F.col("Bytes")).alias("bytes"),
        *[flag(c).alias(n) for n, c in {"syn": "S", "ack": "A", "rst": "R", "fin": "F", "psh": "P"}.items()], F.when(F.col("class") == "victim", normal).otherwise(F.col("class")).alias("class"), F.col("attackType").alias("attack_type"),
    )


#: Formats of timestamps in feature tables.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "yyyy-MM-dd HH:mm:ss.SSSSSS")


def snake_name(name: str) -> str:
    """A feature's column name: trimmed, lower case, words joined by underscores."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def read_feature_csv(spark: SparkSession, path: str, *, text: tuple[str, ...] = ("src_ip", "dst_ip", "timestamp", "label", "protocol")) -> DataFrame:
    """Flow feature tables: names normalised, numbers that are not finite set to 0, ts and last_seen from start and
    duration in microseconds."""
    raw = spark.read.option("header", "true").csv(path)
    renamed = raw.toDF(*[snake_name(c) for c in raw.columns])

    def finite(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    out = renamed.select(*[F.col(c) if c in text else finite(c).alias(c) for c in renamed.columns])
    start = F.coalesce(*[F.try_to_timestamp(F.col("timestamp"), F.lit(f)) for f in TIME_FORMATS])
    out = out.withColumn("ts", F.unix_micros(start) / 1e6)
    return out.withColumn("last_seen", F.col("ts") + F.col("flow_duration") / 1e6) if "flow_duration" in out.columns else out


def read_flow_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Training tables with the day that their file's name begins with."""
    return spark.read.parquet(path).withColumn("day_tag", F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]+)", 1))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cls string, family string, domain string").csv(path).dropna()


def read_events_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events in JSON lines; lines that hold no object of the schema are skipped."""
    parsed = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return spark.read.text(path).select(F.inline(F.array(parsed))).where("__bad is null").drop("__bad").dropna(how="all")


def read_conns(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Connections in JSON lines, each a list of values in the order of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]
    cells = F.from_json("value", "array<string>")
    return spark.read.text(path).select(cells.alias("v")).where(F.size("v") == len(names)).select(*[F.col("v")[i].try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def load_network_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(subnets, hosts, open ports, degraded): empty tables and degraded where the file is missing or has no hosts."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.schema("internal_subnets array<string>, known_hosts array<string>, known_open_ports map<string,array<int>>").option("multiLine", "true").json(path)
        degraded = raw.where("size(known_hosts) > 0").isEmpty()
    except AnalysisException:
        raw = spark.createDataFrame([], "internal_subnets array<string>, known_hosts array<string>, known_open_ports map<string,array<int>>")
        degraded = True
    nets = raw.select(F.explode("internal_subnets").alias("cidr")).select(F.substring_index("cidr", "/", 1).alias("net"), F.substring_index("cidr", "/", -1).cast("int").alias("bits"))
    hosts = raw.select(F.explode("known_hosts").alias("host"))
    ports = raw.select(F.explode("known_open_ports").alias("host", "ports")).select("host", F.explode("ports").alias("port"))
    return nets, hosts, ports, degraded


def load_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, label) of a list of fingerprints or a map of labels, in lower case; keys that begin with _ are left out."""
    raw = spark.read.option("wholetext", "true").text(path)
    listed = raw.select(F.explode(F.from_json("value", "array<string>")).alias("fingerprint")).withColumn("label", F.lit("listed"))
    mapped = raw.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("fingerprint", "label"))
    both = listed.where("fingerprint is not null").unionByName(mapped).withColumn("fingerprint", F.lower("fingerprint"))
    return both.where(~F.col("fingerprint").startswith("_") & ~F.col("fingerprint").startswith("{"))
