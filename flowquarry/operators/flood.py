"""Volume floods at a destination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net, ordered, stats


def flow_record(flows: DataFrame) -> DataFrame:
    """pkts (at least 1), bytes, syn_only and handshake of each flow."""
    tcp = F.col("proto") == 6
    return flows.withColumns({
        "pkts": F.greatest(F.lit(1), F.col("fwd_pkts") + F.col("bwd_pkts")),
        "bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        "syn_only": tcp & (F.col("syn") == 1) & (F.col("ack") == 0),
        "handshake": tcp & (F.col("syn") == 1) & (F.col("ack") == 1) & (F.col("bwd_pkts") > 0),
    })


def flood_window(records: DataFrame, *, seconds: float = 10.0, top: int = 5) -> DataFrame:
    """For each flow, the state of its destination over the seconds before it, itself included.

    top_sources are the commonest sources with their flows, those with as many in order of the address. top_sport is the
    commonest source port of the UDP flows (the lowest of several), amplifier_share its share of them, and
    amplifier_service the service that answers from it with more than it is asked, if there is one.

    A destination's time is cut into slices, so a flooded one is shared out among tasks. Counts are kept in linked
    buckets by count as rows come and go, so a row costs the same however many sources there are.
    """
    udp, tcp = F.col("proto") == 17, F.col("proto") == 6
    out = ordered.trailing_state(
        records, ["dst"], seconds=seconds, first="__first",
        sums={
            "n_bytes": F.col("bytes"), "n_pkts": F.col("pkts"), "n_syn": F.col("syn_only").cast("int"), "n_handshake": F.col("handshake").cast("int"), "n_udp": udp.cast("int"), "n_tcp": tcp.cast("int"),
            "n_bogon": net.is_bogon(F.col("src")).cast("int"),
        },
        # Ports in five digits, so that the order of their text is theirs.
        kinds={"__sources": F.col("src"), "__ports": F.col("dport"), "__sports": F.when(udp, F.lpad(F.col("sport").cast("string"), 5, "0"))}, top={"__sources": top, "__sports": 1},
    )
    span = F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(float(seconds)), F.col("ts") - F.col("__first"))))
    out = out.withColumn("span", span).withColumn("sources", F.col("__sources.kinds"))
    bits, sport = F.col("__sources.bits"), F.get("__sports.top", 0)
    return out.withColumns({
        "rate": F.col("n") / F.col("span"),
        "entropy_bits": bits,
        "entropy_norm": F.when(F.col("n") > 1, bits / F.log2(F.col("n").cast("double"))).otherwise(0.0),
        "syn_share": F.col("n_syn") / F.col("n"), "udp_share": F.col("n_udp") / F.col("n"), "tcp_share": F.col("n_tcp") / F.col("n"), "bogon_share": F.col("n_bogon") / F.col("n"),
        "handshake_share": F.when(F.col("n_tcp") > 0, F.col("n_handshake") / F.col("n_tcp")).otherwise(0.0),
        "port_share": F.col("__ports.most") / F.col("n"), "bytes_per_packet": F.col("n_bytes") / F.col("n_pkts"), "unique_share": F.col("sources") / F.col("n"),
        "top_sources": F.transform("__sources.top", lambda x: F.struct(x["value"].alias("src"), x["n"].alias("n"))),
        "top_sport": sport["value"].cast("int"), "amplifier_share": F.when(F.col("n_udp") > 0, sport["n"] / F.col("n_udp")).otherwise(0.0),
    }).withColumn("amplifier_service", net.lookup(net.AMPLIFIERS, F.col("top_sport"))).drop("__sources", "__ports", "__sports", "__first")


def flood_slices(records: DataFrame, *, seconds: int = 10, step: int = 1) -> DataFrame:
    """The same rates on a grid of sliding windows: two levels of sums, so a flooded destination is pre-aggregated."""
    per = records.groupBy("dst", F.window(F.timestamp_micros((F.col("ts") * 1e6).cast("long")), f"{seconds} seconds", f"{step} seconds").alias("w"), "src").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.col("syn_only").cast("int")).alias("syn")
    )
    # The entropy of n flows over sources with c each is log2(n) less the mean of c * log2(c): two sums, no list of counts.
    n = F.col("n").cast("double")
    total = per.groupBy("dst", "w").agg(F.sum("n").alias("n"), F.count("*").alias("sources"), F.sum("bytes").alias("bytes"), F.sum("syn").alias("syn"), F.sum(n * F.log2(n)).alias("__weight"))
    bits = F.greatest(F.lit(0.0), F.log2(n) - F.col("__weight") / n)
    return total.select("dst", F.col("w.start").alias("start"), "n", "sources", "bytes", "syn", bits.alias("entropy_bits"))


def flood_family(windows: DataFrame, *, shape: float = 0.8, port_share: float = 0.5, amplifier_share: float = 0.6, least_flows: int = 20, spoof_sources: int = 100) -> DataFrame:
    """family (null below least_flows; a reflection names its service), spoofed and looks_like_scan, by rules in order."""
    c = F.col
    enough = c("n") >= least_flows
    udp = c("udp_share") >= shape
    amplified = c("amplifier_service").isNotNull() & (c("amplifier_share") >= amplifier_share)
    family = (
        F.when(enough & (c("syn_share") >= shape) & (c("port_share") >= port_share), "SYN flood")
        .when(enough & udp & amplified, F.concat(F.lit("UDP reflection/amplification ("), c("amplifier_service"), F.lit(")")))
        .when(enough & udp, "UDP flood")
        .when(enough & (c("tcp_share") >= shape) & (c("port_share") >= max(port_share, 0.8)), "TCP flood")
    )
    out = windows.withColumn("family", family)
    # Reflectors are not forged sources.
    spoofed = F.coalesce(c("family").isin("SYN flood", "UDP flood", "TCP flood"), F.lit(False)) & (c("sources") >= spoof_sources) & (c("unique_share") >= 0.9) & (c("handshake_share") <= 0.05)
    return out.withColumns({"spoofed": spoofed, "looks_like_scan": enough & c("family").isNull() & (c("sources") <= 3) & (c("port_share") < port_share)})


def evaluations(windows: DataFrame, *, seconds: float = 1.0, growth: int = 50) -> DataFrame:
    """The rows at which a destination is judged: a second after the last such row, or once n doubled and grew enough.

    Rows stream through each task in order; what is held is a destination's last such row.
    """

    def step(state: dict, ts: float, n: int) -> tuple | None:
        if ts - state["last"] >= seconds or (n >= 2 * state["judged"] and n - state["judged"] >= growth):
            state.update(last=ts, judged=n)
            return ()
        return None

    return ordered.folded(windows, ["dst"], ["ts", "event_id"], needs=["ts", "n"], start=lambda: {"last": -1e18, "judged": 0}, step=step, adds={})


def ewma_baseline(windows: DataFrame, *, alpha: float = 0.05, factor: float = 5.0) -> DataFrame:
    """baseline before each row: the moving average of the destination's rates on rows without a family; and over,
    whether the rate is at least factor times it (true before there is one).

    Rows stream through each task in order; what is held is a destination's average.
    """

    def step(state: list, rate: float, family: str | None) -> tuple:
        before = state[0]
        if family is None:
            state[0] = rate if before is None else (1 - alpha) * before + alpha * rate
        return (before,)

    found = ordered.folded(windows, ["dst"], ["ts", "event_id"], needs=["rate", "family"], start=lambda: [None], step=step, adds={"baseline": "double"})
    return found.withColumn("over", F.col("baseline").isNull() | (F.col("rate") >= factor * F.col("baseline")))


def flood_alerts(windows: DataFrame, *, rate: float = 100.0, sources: int = 10, shape: float = 0.8) -> DataFrame:
    """Rows that fire, with their confidence."""
    c = F.col
    share = F.when(c("family") == "SYN flood", c("syn_share")).when(c("family") == "TCP flood", c("port_share")).otherwise(c("udp_share"))
    conf = 0.6 + 0.2 * stats.clamp01(F.log10(F.greatest(F.lit(1.0), c("rate") / rate))) + 0.2 * stats.clamp01((share - shape) / (1 - shape))
    return windows.where(c("family").isNotNull() & (c("rate") >= rate) & (c("sources") >= sources) & c("over")).withColumn("confidence", F.round(conf, 6))
