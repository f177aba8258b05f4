"""Streaming forms of the operators whose state is bounded by event time.

Every function takes a streaming DataFrame with a timestamp column ``time`` beside the columns of its batch form.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.sketch import Quantiles
from ..operators.behaviour import LIFECYCLE, next_state
from ..operators.sessions import FLOW_SCHEMA, PACKET, FlowTable, with_flow_key

#: Registers of a sketch of distinct values, as a power of two: about 4 KB, and an error of 1.6 %.
SKETCH_BITS = 12
PACKETS = "ts double, src string, dst string, sport int, dport int, proto int, flags int, payload_size long"


def with_state_limits(sdf: DataFrame, *, delay: str) -> DataFrame:
    """State is dropped once event time is past it by the delay; no other cap is set."""
    return sdf.withWatermark("time", delay)


class FlowProcessor(StatefulProcessor):
    """Flows of one key. State is the packets that the watermark has not reached, the open flow and the time of the last
    closing; timers are set for the waiting packets, for the open flow's end (probe or idle) and for the end of the
    closing's linger, so that each is dropped when it is over. Packets and flows also have a time to live."""

    def __init__(self, limits: dict[str, float], live: int | None):
        self.limits, self.live = limits, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKETS, self.live)
        self.flow = handle.getValueState("flow", "number int, closed_at double, open boolean, " + FLOW_SCHEMA.split(", ended")[0].split("flow_no int, ")[1], self.live)

    def _load(self, key: str) -> FlowTable:
        table = FlowTable(key, **self.limits)
        held = self.flow.get()
        if held is not None:
            table.number, table.closed_at = int(held[0]), held[1]
            if held[2]:
                table.flow = [key, table.number - 1, *held[3:]]
        return table

    def _save(self, table: FlowTable) -> None:
        if table.flow is None and table.closed_at is None:
            self.flow.clear()
            return
        self.flow.update((table.number, table.closed_at, table.flow is not None, *(table.flow[2:] if table.flow else [None] * 11)))
        due = table.due() if table.flow else table.closed_at + table.linger
        self.handle.registerTimer(_milliseconds(due) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            packets = list(frame[PACKET[1:]].itertuples(index=False, name=None))
            if packets:
                self.waiting.appendList([(float(p[0]), p[1], p[2], *map(int, p[3:])) for p in packets])
                first = min([p[0] for p in packets] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(max(_milliseconds(first) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        packets = sorted(self.waiting.get(), key=lambda p: (p[0], p[1], p[3], p[6], p[7]))  # as PACKET_ORDER
        ready = [p for p in packets if p[0] <= mark]
        table, out = self._load(key[0]), []
        for packet in ready:
            out += table.add(*packet)
        out += table.expire(mark)
        if ready:
            rest = packets[len(ready) :]
            self.waiting.put([tuple(p) for p in rest]) if rest else self.waiting.clear()
            if rest:
                self.handle.registerTimer(_milliseconds(rest[0][0]) + 1)
        self._save(table)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FLOW_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def _milliseconds(ts: float) -> int:
    return math.ceil(ts * 1000)


def stream_flows(
    sdf: DataFrame, *, idle: float = 120.0, active: float = 300.0, linger: float = 10.0, probe: float = 5.0, delay: str = "10 seconds", live: int | None = None, buckets: int | None = None
) -> DataFrame:
    """The flows of sessions.assemble_flows, as they end, by canonical 5-tuple.

    A packet waits until the watermark has passed it, so packets that come out of order within the delay make the same
    flows. A flow is out once the watermark is past its end. ``live`` is a time to live of state in milliseconds of the
    clock, for streams whose watermark may stand still. State is kept in RocksDB, which the session must be set to use
    (use_rocksdb). ``buckets`` is for many keys, see _in_buckets; there is no time to live by the clock then.
    """
    keyed = with_flow_key(sdf).select(*PACKET, "time").withWatermark("time", delay)
    limits = {"idle": idle, "active": active, "linger": linger, "probe": probe}

    def step(own: dict, batches: Iterator[pd.DataFrame], mark: float) -> tuple[list, float | None]:
        # of a key: its packets that the watermark has not reached, and what a FlowTable holds
        out, due = [], None
        for batch in batches:
            for key, *packet in zip(*(batch[c].tolist() for c in PACKET), strict=True):
                own.setdefault(key, ([], 0, None, None))[0].append(tuple(packet))
        for key, (waiting, number, closed_at, flow) in list(own.items()):
            table = FlowTable(key, **limits)
            table.number, table.closed_at, table.flow = number, closed_at, flow
            waiting.sort(key=lambda p: (p[0], p[1], p[3], p[6], p[7]))  # as PACKET_ORDER
            ready = bisect_right(waiting, mark, key=lambda p: p[0])
            for packet in waiting[:ready]:
                out += table.add(*packet)
            out += table.expire(mark)
            rest = waiting[ready:]
            if not rest and table.flow is None and table.closed_at is None:
                del own[key]
                continue
            own[key] = rest, table.number, table.closed_at, table.flow
            ends = [rest[0][0]] if rest else []
            ends += [table.due()] if table.flow else [] if table.closed_at is None else [table.closed_at + linger]
            due = min(ends if due is None else [due, *ends])
        return out, due

    if buckets is not None:
        if live is not None:
            raise ValueError("live is for one state a key, without buckets")
        return _in_buckets(keyed, ["key"], buckets, step, FLOW_SCHEMA, GroupStateTimeout.EventTimeTimeout)
    processor = FlowProcessor(limits, live)
    return keyed.groupBy("key").transformWithStateInPandas(processor, FLOW_SCHEMA, "append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State of keyed streams in RocksDB, which keeps it on disk and has timers and a time to live."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _kinds(column: str, exact: bool) -> Column:
    """How many values of a column: exactly, with all of them in state, or from a sketch of fixed size, whose count is exact
    for few values and has a standard error of about 1.04 / sqrt(2 ** SKETCH_BITS) for many."""
    return F.size(F.collect_set(column)).cast("long") if exact else F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(SKETCH_BITS)))


def stream_scan_events(sdf: DataFrame, *, window: str = "60 seconds", delay: str = "2 minutes", exact: bool = False) -> DataFrame:
    """Per source and window: flows, unanswered ones, ports and hosts; each window once, when closed.

    Ports and hosts are counted by sketches, so a window's state is bounded under a sweep of all ports; ``exact`` keeps all.
    """
    w = sdf.withWatermark("time", delay).groupBy(F.window("time", window), "src")
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("bwd_pkts") == 0).alias("unanswered"), _kinds("dport", exact).alias("ports"), _kinds("dst", exact).alias("hosts"))


def stream_flood_windows(sdf: DataFrame, *, window: str = "10 seconds", slide: str = "1 second", delay: str = "5 seconds", exact: bool = False) -> DataFrame:
    """Per destination and sliding window: flows, sources (by a sketch, or ``exact``), bytes and the share of UDP.

    Exact sources are counted in two levels, of which the first has a row of state for each source, so no row grows with
    them; that is for append mode only.
    """
    timed = sdf.withWatermark("time", delay)
    if exact:
        per = timed.groupBy(F.window("time", window, slide), "dst", "src").agg(F.count("*").alias("n"), F.sum("fwd_bytes").alias("bytes"), F.count_if(F.col("proto") == 17).alias("udp"))
        total = per.groupBy("window", "dst").agg(F.sum("n").alias("n"), F.count("src").alias("sources"), F.sum("bytes").alias("bytes"), F.sum("udp").alias("__udp"))
        return total.withColumn("udp_share", F.col("__udp") / F.col("n")).drop("__udp")
    w = timed.groupBy(F.window("time", window, slide), "dst")
    return w.agg(F.count("*").alias("n"), _kinds("src", exact).alias("sources"), F.sum("fwd_bytes").alias("bytes"), F.avg((F.col("proto") == 17).cast("int")).alias("udp_share"))


def stream_behaviour_windows(sdf: DataFrame, *, delay: str = "7 minutes", exact: bool = False) -> DataFrame:
    """Hourly windows, closed the delay after the hour. In append mode each comes once, when closed; in update mode (see
    run_updates) rows of the open hour come as they change."""
    w = sdf.withWatermark("time", delay).groupBy(F.window("time", "1 hour"), "host", "cat")
    return w.agg(F.count("*").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"), _kinds("peer", exact).alias("peers"))


def drop_and_count_late(sdf: DataFrame, *, delay: str = "6 hours") -> DataFrame:
    """Hourly counts; rows more than the delay behind the newest are dropped, and late_rows() of the query counts them."""
    return sdf.withWatermark("time", delay).groupBy(F.window("time", "1 hour"), "host").agg(F.count("*").alias("n"))


def late_rows(query: StreamingQuery) -> int:
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def _in_buckets(sdf: DataFrame, keys: list[str], buckets: int, step: Callable, schema: Any, timeout: str) -> DataFrame:
    """Keyed state in so many buckets of keys by hash, each a group, for streams of many keys with few rows each: a group
    costs far more than a row. step(kept, batches, mark) changes the bucket's dict of keys in place, for its rows and for
    the watermark in seconds, and returns the rows to put out and when, in seconds, it is due without rows (None: never).

    What a task holds is one bucket, so the number goes with the keys that are expected.
    """
    names = [c.split()[0] for c in schema.split(", ")] if isinstance(schema, str) else schema.names

    def run(_: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(bytes(state.get[0])) if state.exists else {}
        now = state.getCurrentWatermarkMs() if timeout == GroupStateTimeout.EventTimeTimeout else 0
        out, due = step(kept, iter(()) if state.hasTimedOut else batches, now / 1000)
        if kept:
            state.update((pickle.dumps(kept, protocol=5),))
            if due is not None:
                state.setTimeoutTimestamp(max(_milliseconds(due) + 1, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    dealt = sdf.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return dealt.groupBy("__bucket").applyInPandasWithState(run, schema, "kept binary", "append", timeout)


def stream_cooldown(
    sdf: DataFrame, keys: list[str], *, seconds: float, delay: str = "10 seconds", close_after: float | None = None, buckets: int | None = None
) -> DataFrame:
    """Alerts let through: a key's first, then the first at least seconds after the last one; with how many were held.

    State goes once the seconds have passed, but for a key with held alerts, which the next one let through tells of.
    With ``close_after``, a row without an id tells of them once so many seconds (at least ``seconds``) have passed since
    the last alert let through, and their state goes too. ``buckets`` is for many keys, see _in_buckets.
    """
    kept = seconds if close_after is None else max(close_after, seconds)
    schema = sdf.select(*keys).schema.add("ts", "double").add("id", "long").add("held", "long")

    def step(own: dict, batches: Iterator[pd.DataFrame], mark: float) -> tuple[list, float | None]:
        out, due = [], None
        rows = (x for batch in batches for x in zip(*(batch[c].tolist() for c in (*keys, "ts", "id")), strict=True))
        for *key, ts, i in sorted(rows, key=lambda x: x[-2:]):
            last, held = own.get(tuple(key), (None, 0))
            if last is not None and ts - last < seconds:
                own[tuple(key)] = last, held + 1
            else:
                out.append((*key, ts, i, held))
                own[tuple(key)] = ts, 0
        for key, (last, held) in list(own.items()):
            if held and close_after is None:
                continue
            end = last + (kept if held else seconds)
            if end <= mark:
                if held:
                    out.append((*key, end, None, held))
                del own[key]
            else:
                due = end if due is None else min(due, end)
        return out, due

    def run(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            if held and close_after is not None:
                yield pd.DataFrame([(*key, last + kept, None, held)], columns=[f.name for f in schema])
            if not held or close_after is not None:
                state.remove()
            return
        out = []
        for ts, i in sorted(x for batch in batches for x in batch[["ts", "id"]].itertuples(index=False, name=None)):
            if last is not None and ts - last < seconds:
                held += 1
            else:
                out.append((*key, ts, int(i), held))
                last, held = ts, 0
        state.update((float(last), int(held)))
        state.setTimeoutTimestamp(max(int((last + (kept if held else seconds)) * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    if buckets is not None:
        return _in_buckets(sdf.withWatermark("time", delay), keys, buckets, step, schema, GroupStateTimeout.EventTimeTimeout)
    return sdf.withWatermark("time", delay).groupBy(*keys).applyInPandasWithState(run, schema, "last double, held long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_calibrate(
    sdf: DataFrame, *, trained: float, device_hours: int = 24, hours_of_day: int = 6, size: int = 8192, exact: bool = False
) -> DataFrame:
    """The threshold of each network once it has enough device-hours over enough hours of day: the 99th percentile of
    the errors until then, at least the trained one; no threshold before.

    State holds a sketch of the errors (sketch.Quantiles), exact up to ``size`` of them, whose rank error and size grow
    with the logarithm of their number; ``exact`` keeps all. Device-hours are kept one by one until the threshold is out.
    """

    def run(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, cells, done = state.get if state.exists else ([], [], False)
        cells = set(cells)
        if done:
            return
        errors = Quantiles(np.iinfo(np.int64).max if exact else size, held)
        for batch in batches:
            errors.add(batch["error"].to_numpy(float))
            cells.update(f"{host}|{int(hour)}" for host, hour in batch[["host", "hour"]].drop_duplicates().itertuples(index=False))
        if len(cells) >= device_hours and len({int(c.rsplit("|", 1)[1]) % 24 for c in cells}) >= hours_of_day:
            own = errors.at(0.99)
            yield pd.DataFrame([(key[0], trained if math.isnan(own) else max(own, trained), len(cells))], columns=["network", "threshold", "device_hours"])
            state.update(([], [], True))
        else:
            state.update((errors.state(), sorted(cells), False))

    return sdf.groupBy("network").applyInPandasWithState(
        run, "network string, threshold double, device_hours int", "errors array<array<double>>, cells array<string>, done boolean", "append", GroupStateTimeout.NoTimeout,
    )


def stream_lifecycle(sdf: DataFrame, *, live: float | None = None, delay: str = "10 minutes", buckets: int | None = None) -> DataFrame:
    """A host's state after each command; what is kept of a host is its state and the time of its last command.

    With ``live``, a host without a command for more than these seconds starts anew, and nothing is kept of it once the
    watermark has passed them; without, hosts are kept for ever. ``buckets`` is for many hosts, see _in_buckets.
    """

    def step(own: dict, batches: Iterator[pd.DataFrame], mark: float) -> tuple[list, float | None]:
        out, due = [], None
        rows = (x for batch in batches for x in zip(*(batch[c].tolist() for c in ("seq", "command", "ready", "at", "host")), strict=True))
        for seq, command, ready, at, host in sorted(rows, key=lambda x: x[0]):
            s, last = own.get(host, (LIFECYCLE[0], None))
            if live is not None and last is not None and at - last > live:
                s = LIFECYCLE[0]
            own[host] = next_state(s, command, ready), at
            out.append((host, seq, own[host][0]))
        if live is not None:
            for host in [h for h, (_, last) in own.items() if last + live < mark]:
                del own[host]
            due = min((last + live for _, last in own.values()), default=None)
        return out, due

    def run(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s, last = state.get if state.exists else (LIFECYCLE[0], None)
        out = []
        for seq, command, ready, at in sorted(x for batch in batches for x in batch[["seq", "command", "ready", "at"]].itertuples(index=False, name=None)):
            if live is not None and last is not None and at - last > live:
                s = LIFECYCLE[0]
            s, last = next_state(s, command, ready), at
            out.append((int(key[0]), int(seq), s))
        state.update((s, float(last)))
        if live is not None:
            state.setTimeoutTimestamp(max(_milliseconds(last + live) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["host", "seq", "state"])

    timed = sdf.withColumn("at", F.unix_micros("time") / 1e6)
    timed = timed.withWatermark("time", delay) if live is not None else timed
    timeout = GroupStateTimeout.EventTimeTimeout if live is not None else GroupStateTimeout.NoTimeout
    if buckets is not None:
        return _in_buckets(timed, ["host"], buckets, step, "host long, seq long, state string", timeout)
    return timed.groupBy("host").applyInPandasWithState(run, "host long, seq long, state string", "state string, last double", "append", timeout)


def rows_held(query: StreamingQuery) -> int:
    """Rows of state after the query's last batch."""
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def once_each(sdf: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Alerts, each id once within the delay."""
    return sdf.withWatermark("time", delay).dropDuplicatesWithinWatermark(["id"])


class AlertMetrics(StreamingQueryListener):
    """Counts of what a sink with metrics let through, by class, and of its batches, as the stream reports them.

    A batch that runs again after a failure is reported again, so a batch counts with its last report.
    """

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for row in self.batches.values():
            for k, v in row.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


def with_metrics(sdf: DataFrame, name: str, classes: list[str], *, column: str = "threat_class") -> DataFrame:
    """sdf observed under a name: rows in all, and of each class."""
    return sdf.observe(name, F.count(F.lit(1)).alias("all"), *[F.count_if(F.col(column) == c).alias(c) for c in classes])


def write_batches(sdf: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Each batch of a stream in a folder of its own, named by the batch, which a batch that runs again replaces: so every
    row is there once, whatever failed between writing and commit. Runs over all that is there now."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sdf.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that came in update mode (see write_batches), the last of each key."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")


def write_alert_stream(sdf: DataFrame, path: str, checkpoint: str, *, delay: str = "1 hour", name: str = "alerts", classes: list[str] | None = None) -> StreamingQuery:
    """Writes alerts under path, each id once within the delay and each batch once; with classes also metrics under the name,
    for an AlertMetrics listener."""
    once = once_each(sdf, delay=delay)
    return write_batches(with_metrics(once, name, classes) if classes else once, path, checkpoint)


def run_available(sdf: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there now and stops."""
    q = sdf.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q
