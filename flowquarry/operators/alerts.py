"""Alerts: severity, assembly, validation, suppression, and the reports over them."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net, ordered

#: Default severity, ATT&CK mapping and family letter of each class of threat.
SEVERITIES = {
    "DDoS": "CRITICAL", "C2 Beacon": "HIGH", "DGA": "HIGH", "DNS Tunnel": "HIGH", "VPN Traffic": "MEDIUM", "Encrypted Malware": "CRITICAL", "Port Scan": "MEDIUM",
    "Data Exfiltration": "HIGH",
}
TACTICS = {
    "DDoS": ("Impact", "T1498"),
    "C2 Beacon": ("Command and Control", "T1071"),
    "DGA": ("Command and Control", "T1568"),
    "DNS Tunnel": ("Exfiltration", "T1048"),
    "VPN Traffic": ("Defense Evasion", "T1572"),
    "Encrypted Malware": ("Command and Control", "T1573"),
    "Port Scan": ("Discovery", "T1046"),
    "Data Exfiltration": ("Exfiltration", "T1048"),
}
FAMILIES = {"DDoS": "a", "C2 Beacon": "b", "DGA": "c", "DNS Tunnel": "c", "Encrypted Malware": "d", "Port Scan": "e", "Data Exfiltration": "f"}
RANKS = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CONFIDENCE_KINDS = ("model_probability", "anomaly_score", "rule_score", "weighted_score")
NAME_MODELS = ("dga_cnn_bilstm_v2", "dga_cnn_bilstm", "exfil_vae")


def severity(threat: Column, confidence: Column, model: Column, strong: Column) -> Column:
    """The class's default moved by confidence; name models without strong indicators stay INFO under 0.9."""
    base = F.coalesce(net.lookup(SEVERITIES, threat), F.lit("MEDIUM"))
    by_confidence = F.when(confidence > 0.95, "CRITICAL").when(confidence > 0.85, base).when(confidence > 0.70, F.when(base.isin("CRITICAL", "HIGH"), "MEDIUM").otherwise("LOW")).otherwise("LOW")
    weak = (confidence < 0.90) & threat.isin("DGA", "Data Exfiltration") & model.isin(*NAME_MODELS) & ~strong
    return F.when(weak, "INFO").otherwise(by_confidence)


def rank(sev: Column) -> Column:
    return F.coalesce(net.lookup(RANKS, sev), F.lit(0))


def map_mitre(alerts: DataFrame) -> DataFrame:
    t = F.col("threat_class")
    return alerts.withColumns({
        "tactic": F.coalesce(net.lookup({k: v[0] for k, v in TACTICS.items()}, t), F.lit("Unknown")), "technique": F.coalesce(net.lookup({k: v[1] for k, v in TACTICS.items()}, t), F.lit("T0000")), "family": net.lookup(FAMILIES, t),
    })


def build_alerts(detections: DataFrame, *, decision: tuple[str, ...] = ("id", "threat_class", "confidence", "ts", "last_ts", "src", "dst", "sport", "dport", "proto", "model", "strong")) -> DataFrame:
    """The nested alert of each detection; every column that decides nothing goes into evidence as a JSON value."""
    c = F.col
    have = set(detections.columns)
    col = lambda n, kind="string": c(n) if n in have else F.lit(None).cast(kind)
    conf = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("confidence"))), 4)
    scope = F.when(col("sport").isNotNull() & col("dport").isNotNull(), "flow").when(c("src").isNotNull() & c("dst").isNotNull(), "host_pair").otherwise("source")
    evidence = [n for n in detections.columns if n not in decision]
    pairs = [F.struct(F.lit(n).alias("key"), F.to_json(F.struct(c(n).alias("v"))).alias("value")) for n in evidence]
    kept = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    last = F.coalesce(col("last_ts", "double"), c("ts"))
    rows = map_mitre(detections)
    return rows.select(
        c("id"), c("threat_class"), conf.alias("confidence"), severity(c("threat_class"), conf, col("model"), F.coalesce(col("strong", "boolean"), F.lit(False))).alias("severity"),
        F.struct(
            scope.alias("scope"), c("src").alias("src_ip"), c("dst").alias("dst_ip"), col("sport", "int").alias("src_port"), col("dport", "int").alias("dst_port"),
            net.proto_name(col("proto", "int")).alias("protocol"),
        ).alias("flow_id"),
        F.struct(F.least(c("ts"), last).alias("start"), F.greatest(c("ts"), last).alias("end")).alias("event_window"),
        F.struct("tactic", "technique").alias("mitre"), F.lit("rule_score").alias("confidence_kind"), F.map_filter(kept, lambda _, v: v != "{}").alias("evidence"),
    )


def validate_alerts(alerts: DataFrame) -> DataFrame:
    """problems, an array of what is wrong with each alert, and how many."""
    c = F.col
    tests = [
        (c("id").isNull(), "missing id"),
        (c("threat_class").isNull(), "missing threat_class"),
        (c("confidence").isNull() | ~c("confidence").between(0, 1), "confidence not in [0, 1]"),
        (~F.coalesce(c("confidence_kind").isin(*CONFIDENCE_KINDS), F.lit(False)), "unknown confidence_kind"),
        (c("flow_id.src_ip").isNull(), "flow_id.src_ip missing"),
        (c("evidence").isNull(), "evidence is not an object"),
    ]
    problems = F.array_compact(F.array(*[F.when(bad, text) for bad, text in tests]))
    return alerts.withColumn("problems", problems).withColumn("n_problems", F.size("problems"))


def canonical_json(columns: list[str]) -> Column:
    """An object of the columns with sorted keys and all values as strings (doubles: see fixed()); nulls stay null."""

    def value(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))

    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), value(n)) for n in sorted(columns)]), F.lit("}"))


def fixed(col: Column) -> Column:
    """A double as text with nine decimals, the same in every engine."""
    return F.col(col).cast("decimal(38,9)").cast("string") if isinstance(col, str) else col.cast("decimal(38,9)").cast("string")


def canonical_digest(columns: list[str]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(columns).cast("binary"), 256))


def params_digest(name: str, version: str, params: dict) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.lit(json.dumps({"name": name, "params": params, "version": version}, sort_keys=True, separators=(",", ":"))).cast("binary"), 256))


def to_ppm(confidence: Column) -> Column:
    return F.round(confidence * 1_000_000).cast("long")


def by_role(rows: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """A row for each end of each row: entity and role, without a self-join."""
    ends = F.array(F.struct(F.col(src).alias("entity"), F.lit("src").alias("role")), F.struct(F.col(dst).alias("entity"), F.lit("dst").alias("role")))
    return rows.withColumn("__end", F.explode(ends)).select("*", "__end.entity", "__end.role").drop("__end").where("entity is not null")


def attach_evidence(alerts: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return alerts.join(other, keys, "left")


def cooldown(alerts: DataFrame, keys: list[str], *, seconds: float, inclusive: bool = False, id_col: str = "id") -> DataFrame:
    """Alerts that are let through: a key's first, then the first at least ``seconds`` after the last let through (more
    than that if inclusive), each with how many were held since. What is held of a key is its last time and count."""

    def step(state: dict, ts: float) -> tuple | None:
        last = state["last"]
        if last is not None and (ts - last <= seconds if inclusive else ts - last < seconds):
            state["held"] += 1
            return None
        held = state["held"]
        state.update(last=ts, held=0)
        return (held,)

    return ordered.folded(alerts, keys, ["ts", id_col], needs=["ts"], start=lambda: {"last": None, "held": 0}, step=step, adds={"held": "long"})


def new_services(flows: DataFrame, *, service: str, by: str, ts: str = "ts", seconds: int = 86_400) -> DataFrame:
    """Per day (or other span): how many pairs of ``by`` and service were first seen in it."""
    first = flows.groupBy(service, by).agg(F.min(F.floor(F.col(ts) / seconds)).alias("day"))
    return first.groupBy("day").agg(F.count("*").alias("new_services"))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__i = 1").drop("__i")


def union_detections(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def alert_stats(alerts: DataFrame, *, hours: float, salt: str = "salt") -> DataFrame:
    """Counts by rolled-up class, severity and model, rates for a day, and distinct ends through a salted hash."""
    hashed = lambda c: F.count_distinct(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(c), F.lit(""))).cast("binary"), 256))
    out = alerts.rollup("threat_class", "severity", "model").agg(F.count("*").alias("n"), hashed("src").alias("sources"), hashed("dst").alias("destinations"), F.grouping_id().alias("level"))
    return out.withColumn("per_day", F.col("n") * 24.0 / hours)


def group_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts by class, source and target: first, latest, count, worst severity."""
    g = alerts.withColumn("target", F.coalesce("domain", "dst")).groupBy("threat_class", "src", "target")
    return g.agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("id", F.struct("ts", "id")).alias("latest"), F.count("*").alias("n"),
        F.max(rank(F.col("severity"))).alias("worst"),
    )


def alert_histogram(alerts: DataFrame, *, most_bins: int = 90, least_bins: int = 30, buckets: tuple[int, ...] = (60, 300, 900, 3600, 10800, 21600, 43200, 86400, 604800)) -> DataFrame:
    """Counts by severity in the smallest bucket size that needs at most most_bins, aligned to the latest alert, with
    empty bins, at least least_bins of them."""
    span = alerts.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    fits = F.filter(F.array(*map(F.lit, buckets)), lambda b: F.ceil((F.col("hi") - F.col("lo")) / b) <= most_bins)
    size = F.coalesce(F.get(fits, F.lit(0)), F.lit(buckets[-1]))
    chosen = span.withColumn("size", size).withColumn("last_bin", F.floor(F.col("hi") / F.col("size")).cast("long"))
    chosen = chosen.withColumn("bins", F.greatest(F.lit(least_bins), F.col("last_bin") - F.floor(F.col("lo") / F.col("size")) + 1).cast("int"))
    spine = chosen.select("size", F.explode(F.sequence(F.col("last_bin") - F.col("bins") + 1, F.col("last_bin"))).alias("bin"))
    counted = alerts.crossJoin(F.broadcast(chosen.select("size"))).groupBy(F.floor(F.col("ts") / F.col("size")).cast("long").alias("bin")).pivot("severity", list(RANKS)).count()  # one row beside
    return spine.join(counted, "bin", "left").fillna(0, list(RANKS)).select((F.col("bin") * F.col("size")).alias("start"), "size", *RANKS)


def host_rollup(alerts: DataFrame) -> DataFrame:
    """Per address: alerts as source and as destination, counts by class, worst severity, first and last."""
    per = by_role(alerts).groupBy("entity", "threat_class").agg(
        F.count_if(F.col("role") == "src").alias("as_src"), F.count_if(F.col("role") == "dst").alias("as_dst"), F.max(rank(F.col("severity"))).alias("worst"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    classes = F.map_from_entries(F.sort_array(F.collect_list(F.struct("threat_class", F.col("as_src") + F.col("as_dst")))))
    return per.groupBy("entity").agg(
        F.sum("as_src").alias("as_src"), F.sum("as_dst").alias("as_dst"), F.max("worst").alias("worst"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), classes.alias("classes"),
    )


def alert_graph(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sources and their targets."""
    a = alerts.withColumn("target", F.coalesce("domain", "dst"))
    edges = a.groupBy("src", "target").agg(F.count("*").alias("n"), F.max(rank(F.col("severity"))).alias("worst"))
    nodes = by_role(edges, dst="target").groupBy("entity").agg(F.sum("n").alias("weight"), F.max("worst").alias("worst"))
    kind = F.when(net.is_internal(F.col("entity")), "internal").when(F.col("entity").rlike("[a-z]"), "domain").otherwise("external")
    return nodes.withColumn("kind", kind), edges


def pipeline_metrics(events: DataFrame, *, seconds: int = 10) -> DataFrame:
    """Events in each second and over the seconds up to it, with latency percentiles."""
    per = events.groupBy(F.floor("ts").cast("long").alias("second")).agg(
        F.count("*").alias("n"), F.percentile("latency", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.max("latency").alias("latency_max"),
    )
    per = per.withColumn("block", F.floor(F.col("second") / 86_400))
    w = Window.partitionBy("block").orderBy("second").rangeBetween(-(seconds - 1), 0)
    return per.withColumn("rate", F.sum("n").over(w) / seconds).select("second", "n", "rate", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "latency_max")


def triage(alerts: DataFrame, *, n: int | None = None) -> DataFrame:
    out = alerts.withColumn("priority", rank(F.col("severity")) * 1000 + F.col("confidence")).orderBy(F.desc("priority"), F.desc("ts"), "id")
    return out.limit(n) if n else out


def sort_alerts(alerts: DataFrame, key: str, *, descending: bool = True) -> DataFrame:
    by = {"severity": rank(F.col("severity")), "time": F.col("ts"), "confidence": F.col("confidence"), "class": F.col("threat_class"), "src": F.col("src")}[key]
    return alerts.orderBy(by.desc() if descending else by.asc(), F.desc("ts"), "id")


def normalize_alerts(alerts: DataFrame) -> DataFrame:
    """Adds haystack, the lower-case text that free terms are looked for in."""
    return alerts.withColumn("haystack", F.lower(F.concat_ws(" ", "threat_class", "severity", "src", "dst", "domain", "model", "technique")))


TERM = re.compile(r'(class|sev|src|dst|ip|port|mitre|model|ps)(>=|:)("[^"]*"|\S+)|("[^"]*"|\S+)')


def filter_alerts(alerts: DataFrame, text: str) -> DataFrame:
    """Alerts that meet every term: class: sev: sev>= src: dst: ip: port: mitre: model: ps: or a free word."""
    c = F.col
    out = alerts
    for field, op, value, free in TERM.findall(text):
        v = (value or free).strip('"').lower()
        if not field:
            test = c("haystack").contains(v)
        elif field == "class":
            test = F.lower("threat_class").contains(v)
        elif field == "sev":
            test = rank(c("severity")) >= RANKS.get(v.upper(), 0) if op == ">=" else F.lower("severity").startswith(v)
        elif field == "ip":
            test = c("src").startswith(v) | c("dst").startswith(v)
        elif field in ("src", "dst"):
            test = c(field).startswith(v)
        elif field == "port":
            test = (c("sport").cast("string") == v) | (c("dport").cast("string") == v)
        elif field == "mitre":
            test = F.lower("technique").startswith(v) | F.lower("tactic").contains(v)
        elif field == "model":
            test = F.lower("model").contains(v)
        else:
            test = c("family") == v
        out = out.where(F.coalesce(test, F.lit(False)))
    return out
