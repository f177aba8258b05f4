"""Sessions: flows from packets, connections, merged and counted runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered, stats

FLOW_SCHEMA = (
    "key string, flow_no int, first_ts double, last_ts double, src string, dst string, sport int, dport int, proto int, fwd_pkts long, bwd_pkts long, fwd_bytes long, "
    "bwd_bytes long, ended string, stub boolean"
)
FIN, SYN, RST, ACK = 1, 2, 4, 16


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Adds key, the same for both directions of a 5-tuple."""
    a, b = F.concat_ws("|", "src", F.col("sport").cast("string")), F.concat_ws("|", "dst", F.col("dport").cast("string"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return packets.withColumn("key", F.concat_ws("|", lo, hi, F.col("proto").cast("string")))


class FlowTable:
    """One key's open flow, fed with its packets in order of time; what is held is the flow, or when one was closed."""

    def __init__(self, key: str, idle: float, active: float, linger: float, probe: float):
        self.key, self.idle, self.active, self.linger, self.probe = key, idle, active, linger, probe
        self.flow: list | None = None
        self.closed_at: float | None = None
        self.number = 0

    def due(self) -> float | None:
        """The time after which the open flow is over without a packet until then."""
        return self.flow[3] + (self.probe if self._single() else self.idle) if self.flow else None

    def expire(self, now: float) -> list[tuple]:
        """The flow, if it was over before now; a closing that no packet can follow any more is forgotten."""
        if self.closed_at is not None and now - self.closed_at > self.linger:
            self.closed_at = None
        return [self._close("probe" if self._single() else "idle")] if self.flow and now > self.due() else []

    def add(self, ts: float, src: str, dst: str, sport: int, dport: int, proto: int, flags: int, size: int) -> list[tuple]:
        """The flows that this packet ends."""
        bare_syn = bool(flags & SYN) and not flags & ACK
        if self.flow is None and self.closed_at is not None and ts - self.closed_at <= self.linger and not bare_syn:
            return []
        done = self.expire(ts)
        if self.flow is None:
            self.flow, self.closed_at = [self.key, self.number, ts, ts, src, dst, sport, dport, proto, 0, 0, 0, 0], None
            self.number += 1
        flow = self.flow
        back = src != flow[4] or sport != flow[6]
        flow[9 + back] += 1
        flow[11 + back] += size
        flow[3] = ts
        if flags & (FIN | RST):
            done.append(self._close("fin" if flags & FIN else "rst"))
            self.closed_at = ts
        elif ts - flow[2] > self.active:
            done.append(self._close("active"))
        return done

    def end(self) -> list[tuple]:
        return [self._close("end")] if self.flow else []

    def _single(self) -> bool:
        return self.flow[9] + self.flow[10] == 1

    def _close(self, why: str) -> tuple:
        out = (*self.flow, why, self._single())
        self.flow = None
        return out


#: Packets of one time are taken in the order of the other fields, so that every run makes the same flows.
PACKET_ORDER = ["ts", "src", "sport", "flags", "payload_size"]
PACKET = ["key", "ts", "src", "dst", "sport", "dport", "proto", "flags", "payload_size"]


def assemble_flows(packets: DataFrame, *, idle: float = 120.0, active: float = 300.0, linger: float = 10.0, probe: float = 5.0) -> DataFrame:
    """Bidirectional flows from packets (ts, src, dst, sport, dport, proto, flags, payload_size).

    The first packet gives the direction. A flow ends with FIN or RST, on the packet that makes it longer than
    ``active``, or when none comes within ``idle`` after the last; a single packet, such as an unanswered SYN, is over
    after ``probe``. For ``linger`` seconds after FIN or RST, packets other than a bare SYN are absorbed. Flows of a
    single packet are stubs. Packets stream through each task sorted by key and time, so no flow or key is held whole.
    """
    names = [c.split()[0] for c in FLOW_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = None
        for batch in batches:
            out = []
            for k, *packet in batch[PACKET].itertuples(index=False):
                if table is None or k != table.key:
                    if table is not None:
                        out += table.end()
                    table = FlowTable(k, idle, active, linger, probe)
                out += table.add(*packet)
            if out:
                yield pd.DataFrame(out, columns=names)
        if table is not None and (last := table.end()):
            yield pd.DataFrame(last, columns=names)

    keyed = with_flow_key(packets).select(*PACKET)
    return keyed.repartition("key").sortWithinPartitions("key", *PACKET_ORDER).mapInPandas(run, FLOW_SCHEMA)


def idle_sessions(flows: DataFrame, keys: list[str], *, idle: float = 300.0, ts: str = "ts", order: str = "event_id", amount: str = "fwd_bytes") -> DataFrame:
    """Connections: runs of a key's rows no more than idle seconds apart."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    gap = F.col(ts) - F.lag(ts).over(w)
    numbered = flows.withColumn("session", F.sum(F.when(gap > idle, 1).otherwise(0)).over(w))
    return numbered.groupBy(*keys, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.sum(amount).alias("amount"))


def session_starts(flows: DataFrame, keys: list[str], *, gap: float = 60.0, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Rows that come more than gap seconds after the row before."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, order))
    return flows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(ts) - F.col("__before") > gap)).drop("__before")


def count_sessions(flows: DataFrame, keys: list[str], *, n: int = 100, horizon: float = 21_600.0) -> DataFrame:
    """Per key, batches of n rows none of which is older than horizon at the batch's last; a full batch starts anew.

    Rows stream through each task in order; what is held is the open batch, at most n rows.
    """

    def step(state: dict, ts: float, event_id: int, size: int) -> list[tuple]:
        held = state["open"]
        while held and held[0]["ts"] < ts - horizon:
            held.popleft()
        held.append({"ts": ts, "event_id": event_id, "fwd_bytes": size})
        if len(held) < n:
            return []
        done = (state["session"], list(held))
        state["session"] += 1
        held.clear()
        return [done]

    makes = "session bigint, rows array<struct<ts:double,event_id:bigint,fwd_bytes:bigint>>"
    rows = flows.withColumns({"event_id": F.col("event_id").cast("long"), "fwd_bytes": F.col("fwd_bytes").cast("long")})
    out = ordered.gathered(rows, keys, ["ts", "event_id"], needs=["ts", "event_id", "fwd_bytes"], start=lambda: {"open": deque(), "session": 0}, step=step, end=lambda _: [], makes=makes)
    return out.withColumn("session", F.col("session").cast("int")).withColumn("gaps", stats.differences(F.transform("rows", lambda r: r["ts"])))


def merge_checkins(flows: DataFrame, keys: list[str], *, gap: float, amount: str = "fwd_bytes") -> DataFrame:
    """(keys, t, b): starts under gap seconds after their group's first start are one check-in, their amounts summed.

    Rows stream through each task in order; what is held is the open check-in.
    """

    def step(state: list, ts: float, b: float) -> list[tuple]:
        if state and ts - state[0] < gap:
            state[1] += b
            return []
        done = [tuple(state)] if state else []
        state[:] = [ts, b]
        return done

    rows = flows.withColumn("__b", F.col(amount).cast("double"))
    return ordered.gathered(rows, keys, ["ts", "event_id"], needs=["ts", "__b"], start=list, step=step, end=lambda s: [tuple(s)], makes="t double, b double")


def checkin_series(flows: DataFrame, keys: list[str], *, gap: float, amount: str = "fwd_bytes") -> DataFrame:
    """(keys, times, sizes): the check-ins of merge_checkins as arrays, for keys that bound them, such as a window of time."""

    def step(state: dict, ts: float, b: float) -> list[tuple]:
        if state["t"] and ts - state["t"][-1] < gap:
            state["b"][-1] += b
        else:
            state["t"].append(ts)
            state["b"].append(b)
        return []

    rows = flows.withColumn("__b", F.col(amount).cast("double"))
    makes = "times array<double>, sizes array<double>"
    return ordered.gathered(rows, keys, ["ts", "event_id"], needs=["ts", "__b"], start=lambda: {"t": [], "b": []}, step=step, end=lambda s: [(s["t"], s["b"])], makes=makes)


def model_series(checkins: DataFrame, *, n: int = 100) -> DataFrame:
    """The gaps of the last n merged check-ins of each pair and window."""
    last = F.slice("times", -1, 1) if n == 1 else F.when(F.size("times") > n, F.slice("times", -n, n)).otherwise(F.col("times"))
    return checkins.withColumn("series", stats.differences(last))


def strided_windows(flows: DataFrame, keys: list[str], *, n: int = 100, stride: int = 25) -> DataFrame:
    """Every run of n rows of a key that starts at a multiple of stride: first and last time, mean gap."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id")) - 1
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - n + 1) / stride)).cast("int")
    starts = F.sequence(low, F.floor(F.col("i") / stride).cast("int"))
    rows = flows.withColumn("i", i).withColumn("k", F.explode(starts)).withColumn("start", F.col("k") * stride)
    out = rows.groupBy(*keys, "start").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.where(F.col("rows") == n).withColumn("mean_gap", (F.col("last_ts") - F.col("first_ts")) / (n - 1))


def active_idle(flows: DataFrame, keys: list[str], *, gap: float = 5.0) -> DataFrame:
    """Per key, its active stretches and the idle gaps between them: numbers, means and longest."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    step = F.col("ts") - F.lag("ts").over(w)
    islands = flows.withColumn("__gap", step).withColumn("__island", F.sum(F.when(F.col("__gap") > gap, 1).otherwise(0)).over(w))
    spans = islands.groupBy(*keys, "__island").agg((F.max("ts") - F.min("ts")).alias("active"), F.max(F.when(F.col("__gap") > gap, F.col("__gap"))).alias("idle"))
    return spans.groupBy(*keys).agg(
        F.count("*").alias("stretches"), F.avg("active").alias("active_mean"), F.max("active").alias("active_max"), F.avg("idle").alias("idle_mean"),
        F.max("idle").alias("idle_max"),
    )


def splt(packets: DataFrame, keys: list[str], *, n: int = 20) -> DataFrame:
    """The signed sizes (forward positive) and times in milliseconds of a key's first n payload packets."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    ranked = packets.where("size > 0").withColumn("__i", F.row_number().over(w)).withColumn("__t0", F.min("ts").over(Window.partitionBy(*keys))).where(F.col("__i") <= n)
    item = F.struct("__i", F.when(F.col("forward"), F.col("size")).otherwise(-F.col("size")).alias("size"), F.round((F.col("ts") - F.col("__t0")) * 1000, 3).alias("ms"))
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("__s")).select(*keys, F.transform("__s", lambda x: F.struct(x["size"].alias("size"), x["ms"].alias("ms"))).alias("splt"))
