"""Port and host scans: windowed indicators of a source, their succession, and sequential tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net, ordered

#: External service ports that a normal client fans out on.
EXEMPT_PORTS = (53, 80, 123, 443, 853, 5353)
LONGEST_SUCCESSION = 2333
#: The ICMP type of an unreachable destination, and its codes that a scan brings about.
UNREACHABLE = 3
UNREACHABLE_CODES = (0, 1, 2, 3, 9, 10, 13)


def window_start(ts: str, seconds: float) -> Column:
    return F.floor(F.col(ts) / seconds) * int(seconds)


def scan_candidates(flows: DataFrame) -> DataFrame:
    """Flows that can be part of a scan: not to group addresses, nor to common services outside."""
    served = F.col("dport").isin(*EXEMPT_PORTS) & net.is_external(F.col("dst"))
    return flows.where(~net.is_group_dst(F.col("dst")) & ~served)


def unreachable(messages: DataFrame) -> DataFrame:
    """The ICMP messages that say that a destination cannot be reached, as a probe of a closed UDP port is told."""
    return messages.where((F.col("icmp_type") == UNREACHABLE) & (F.col("icmp_code").isNull() | F.col("icmp_code").isin(*UNREACHABLE_CODES)))


def icmp_causes(messages: DataFrame, flows: DataFrame, *, within: float = 10.0) -> DataFrame:
    """messages with cause, the event_id of the flow whose packet an ICMP error quotes: the last one with those addresses,
    ports and protocol that began at most ``within`` seconds before the message. Null without a quoted header or such a flow.
    """
    quoted = ["q_src", "q_dst", "q_sport", "q_dport", "q_proto"]
    begun = flows.select(*[F.col(c.removeprefix("q_")).alias(c) for c in quoted], F.col("ts").alias("__began"), F.col("event_id").alias("__cause"))
    # Equal messages have one cause, so a message is known by what it says.
    told = messages.withColumn("__message", F.to_json(F.struct(*messages.columns)))
    # Times are cut into slots, so that a busy pair's flows and messages are shared out.
    slot = lambda ts: F.floor(ts / within).cast("long")
    near = told.where(F.col("q_src").isNotNull()).withColumn("__slot", F.explode(F.array(slot(F.col("ts")) - 1, slot(F.col("ts")))))
    met = near.join(begun.withColumn("__slot", slot(F.col("__began"))), [*quoted, "__slot"]).where((F.col("__began") <= F.col("ts")) & (F.col("ts") - F.col("__began") <= within))
    cause = met.groupBy("__message").agg(F.max_by("__cause", F.struct("__began", "__cause")).alias("cause"))
    return told.join(cause, "__message", "left").drop("__message")


def network_events(
    flows: DataFrame, *, known_hosts: DataFrame | None = None, known_ports: DataFrame | None = None, icmp: DataFrame | None = None, seconds: int = 60, one_way: bool = False
) -> DataFrame:
    """Per source and window: ICMP errors that it was told of (icmp_error), and counts of targets that reset a connection
    that was never there (rst), left a flow without an answer (rwa), are not known hosts (neip) or known hosts' ports that
    are not open (netcp), with distinct ports and addresses and the commonest destination.

    Flows are first made distinct on (source, window, destination, port), and ports on (source, window, port), so every
    indicator is a plain sum or count and a busy source is pre-aggregated. known_hosts has column host, known_ports has
    host and port; without them the last two indicators are 0. A host without listed ports counts as open. icmp has messages
    (ts, dst, icmp_type, icmp_code and, where the packet quotes one, q_src); the one told of is the source of the quoted
    packet, or else the message's destination. one_way reads every flow as unanswered.
    """
    keyed = flows.withColumn("window_start", window_start("ts", seconds))
    answered = F.lit(False) if one_way else (F.col("bwd_pkts") > 0)
    tcp = F.col("proto") == 6
    reset = tcp & (F.col("syn") > 0) & (F.col("rst") > 0) & ~((F.col("ack") > 0) & (F.col("bwd_pkts") > 0))
    targets = keyed.groupBy("src", "window_start", "dst", "dport").agg(
        F.count("*").alias("n"), F.max(reset.cast("int")).alias("rst"), F.min(answered.cast("int")).alias("answered"), F.max((tcp | (F.col("proto") == 17)).cast("int")).alias("ported")
    )
    ports = targets.select("src", "window_start", "dport").distinct().groupBy("src", "window_start").agg(F.count("*").alias("ports"))
    if known_hosts is not None:
        targets = targets.join(known_hosts.select(F.col("host").alias("dst"), F.lit(True).alias("__known")).distinct(), "dst", "left")
    else:
        targets = targets.withColumn("__known", F.lit(None).cast("boolean"))
    if known_ports is not None:
        listed = known_ports.select(F.col("host").alias("dst")).distinct().withColumn("__listed", F.lit(True))
        opened = known_ports.select(F.col("host").alias("dst"), F.col("port").alias("dport"), F.lit(True).alias("__open")).distinct()
        targets = targets.join(listed, "dst", "left").join(opened, ["dst", "dport"], "left")
    else:
        targets = targets.withColumns({"__listed": F.lit(None).cast("boolean"), "__open": F.lit(None).cast("boolean")})
    new_host = F.lit(False) if known_hosts is None else F.col("__known").isNull() & net.is_internal(F.col("dst"))
    there = F.lit(True) if known_hosts is None else F.col("__known").isNotNull()
    closed = F.col("__listed").isNotNull() & F.col("__open").isNull() & (F.col("ported") == 1) & there & net.is_internal(F.col("dst"))
    silent = (F.col("answered") == 0) & (F.col("rst") == 0) & ~net.is_group_dst(F.col("dst"))
    hosts = targets.groupBy("src", "window_start", "dst").agg(
        F.sum("n").alias("n"), F.sum("rst").alias("rst"), F.sum(silent.cast("int")).alias("rwa"), F.max(new_host.cast("int")).alias("neip"), F.sum(closed.cast("int")).alias("netcp")
    )
    events = hosts.groupBy("src", "window_start").agg(
        F.sum("rst").alias("rst"), F.sum("rwa").alias("rwa"), F.sum("neip").alias("neip"), F.sum("netcp").alias("netcp"),
        F.count("*").alias("hosts"), F.max_by("dst", F.struct("n", "dst")).alias("top_dst"),
    ).join(ports, ["src", "window_start"])
    if icmp is None:
        return events.withColumn("icmp_error", F.lit(0).cast("long"))
    told_of = F.coalesce("q_src", "dst") if "q_src" in icmp.columns else F.col("dst")
    errors = unreachable(icmp).groupBy(told_of.alias("src"), window_start("ts", seconds).alias("window_start")).agg(F.count("*").alias("icmp_error"))
    return events.join(errors, ["src", "window_start"], "left").fillna(0, ["icmp_error"])


def suspicion() -> Column:
    """What succession goes by: any indicator."""
    return F.col("icmp_error") + F.col("rst") + F.col("rwa") + F.col("neip") + F.col("netcp")


def indicator_sum() -> Column:
    """What sequential tests go by: ICMP errors, unknown hosts and closed ports. Resets and missing answers are common in
    normal traffic."""
    return F.col("icmp_error") + F.col("neip") + F.col("netcp")


def fanout(flows: DataFrame, *, seconds: int = 60) -> DataFrame:
    return flows.withColumn("window_start", window_start("ts", seconds)).groupBy("src", "window_start").agg(F.count_distinct("dport").alias("ports"))


def sweep(flows: DataFrame, *, seconds: int = 60) -> DataFrame:
    """Per source and window, the port on which most hosts were reached (the lowest of several) and how many."""
    counted = scan_candidates(flows).withColumn("window_start", window_start("ts", seconds)).groupBy("src", "window_start", "dport").agg(F.count_distinct("dst").alias("hosts"))
    return counted.groupBy("src", "window_start").agg(F.max_by("dport", F.struct(F.col("hosts"), -F.col("dport"))).alias("port"), F.max("hosts").alias("hosts"))


def scan_type(flows: DataFrame, *, seconds: int = 60) -> DataFrame:
    n = flows.withColumn("window_start", window_start("ts", seconds)).groupBy("src", "window_start").agg(F.count_distinct("dport").alias("ports"), F.count_distinct("dst").alias("hosts"))
    kind = F.when((F.col("hosts") == 1) & (F.col("ports") > 1), "vertical").when((F.col("hosts") > 1) & (F.col("ports") == 1), "horizontal").when((F.col("hosts") > 1) & (F.col("ports") > 1), "block").otherwise("single")
    return n.withColumn("scan_type", kind)


def scan_decide(events: DataFrame, *, neip: int = 2, netcp: int = 1, rwa: int = 52, fan: int = 100, reach: int = 32) -> DataFrame:
    """Rule form of the decision on the indicators, with the fan-out and sweep backstops."""
    c = F.col
    tree = (c("neip") >= neip) | (c("netcp") >= netcp) | (c("rwa") >= rwa)
    backstop = (c("ports") >= fan) | (c("hosts") >= reach)
    return events.withColumns({"is_scan": tree | backstop, "by": F.when(tree, "indicators").when(backstop, "backstop")})


def succession(events: DataFrame, *, alpha: str = "alpha", most: int = LONGEST_SUCCESSION) -> DataFrame:
    """How many suspicious active windows a source has had in a row, this one included; 0 for a clean one."""
    w = Window.partitionBy("src").orderBy("window_start")
    islands = events.withColumn("__island", F.sum((F.col(alpha) == 0).cast("int")).over(w))
    run = F.sum((F.col(alpha) > 0).cast("int")).over(Window.partitionBy("src", "__island").orderBy("window_start"))
    return islands.withColumn("succession", F.least(run, F.lit(most)).cast("long")).drop("__island")


def sprt(events: DataFrame, *, alpha: str = "alpha", theta0: float = 0.8, theta1: float = 0.2, low: float = 0.001, high: float = 999.0) -> DataFrame:
    """Sequential probability ratio test over a source's windows in order: decision (scanner, normal or pending) and
    ratio after each; a decision sets the ratio back to 1. What is held is a source's ratio."""

    def step(state: list, value: float) -> tuple:
        r = state[0] * ((1 - theta1) / (1 - theta0) if (value or 0) > 0 else theta1 / theta0)
        decision = "scanner" if r >= high else "normal" if r <= low else "pending"
        state[0] = r if decision == "pending" else 1.0
        return r, decision

    rows = events.select("src", F.col("window_start").cast("long").alias("window_start"), alpha)
    return ordered.folded(rows, ["src"], ["window_start"], needs=[alpha], start=lambda: [1.0], step=step, adds={"ratio": "double", "decision": "string"}).drop(alpha)


def suppress_flooding_sources(scans: DataFrame, floods: DataFrame, *, seconds: float = 120.0) -> DataFrame:
    """Scan alerts (src, dst, ts) without a flood decision (dst, ts, sources array) on their destination that names
    their source within the seconds around. Times are cut into slots, so the join is on (dst, src, slot)."""
    slot = lambda ts: F.floor(ts / seconds).cast("long")
    named = floods.select(F.col("dst").alias("__dst"), F.col("ts").alias("__ts"), F.explode("sources").alias("__src")).withColumn(
        "__slot", F.explode(F.array(slot(F.col("__ts")) - 1, slot(F.col("__ts")), slot(F.col("__ts")) + 1)),
    )
    hit = (F.col("dst") == F.col("__dst")) & (F.col("src") == F.col("__src")) & (slot(F.col("ts")) == F.col("__slot")) & (F.abs(F.col("ts") - F.col("__ts")) <= seconds)
    return scans.join(named, hit, "left_anti")


def quick_scan(flows: DataFrame, *, n: int = 3) -> DataFrame:
    """The n sources with the highest triage score, from fan-out tiers and failed connections."""
    per = flows.groupBy("src").agg(
        F.count_distinct("dport").alias("ports"), F.count_distinct("dst").alias("hosts"), F.sum((F.col("bwd_pkts") == 0).cast("int")).alias("failed"),
        F.count("*").alias("flows"),
    )
    tier = lambda c: F.when(F.col(c) >= 100, 3).when(F.col(c) >= 20, 2).when(F.col(c) >= 5, 1).otherwise(0)
    score = tier("ports") + tier("hosts") + F.when(F.col("failed") * 2 > F.col("flows"), 2).otherwise(0)
    return per.withColumn("score", score).orderBy(F.desc("score"), F.desc("flows"), "src").limit(n)
