"""Rows of a key taken in order: folds that hold a small state, trailing windows, and running totals.

Rows are dealt by key, sorted, and streamed through each task as Arrow batches, so no history is ever held whole.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
#: Windows' worth of time that one task takes of a key; a window's rows before it are copied to it.
SLICE_WINDOWS = 8
KINDS = T.StructType().add("kinds", "long").add("most", "long").add("bits", "double")
MIDDLE = T.StructType().add("n", "long").add("median", "double").add("mad", "double")
TOP_KINDS = T.StructType(list(KINDS.fields)).add("top", T.ArrayType(T.StructType().add("value", "string").add("n", "long")))


def folded(df: DataFrame, keys: list[str], order: list[str], *, needs: list[str], start: Callable[[], Any], step: Callable[..., tuple | None], adds: dict[str, str]) -> DataFrame:
    """df with the columns ``adds`` (name to type), which step(state, *needs) returns for each row of a key in order.

    Rows for which step returns None are left out. The state is start() at a key's first row, and step changes it in
    place; it is all that is held.
    """
    names = df.columns
    at_keys, at_needs = [names.index(k) for k in keys], [names.index(c) for c in needs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found, keep = [], []
            own = zip(*(batch.column(i).to_pylist() for i in at_keys), strict=True)
            values = zip(*(batch.column(i).to_pylist() for i in at_needs), strict=True)
            for k, row in zip(own, values, strict=True):
                if k != key:
                    key, state = k, start()
                out = step(state, *row)
                keep.append(out is not None)
                if out is not None:
                    found.append(out)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            cols = list(zip(*found, strict=True)) if found else [()] * len(adds)
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, ARROW[kind]) for c, kind in zip(cols, adds.values(), strict=True)]], [*names, *adds])

    schema = T.StructType(list(df.schema.fields))
    for name, kind in adds.items():
        schema = schema.add(name, kind)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def gathered(
    df: DataFrame, keys: list[str], order: list[str], *, needs: list[str], start: Callable[[], Any], step: Callable[..., list[tuple]], end: Callable[[Any], list[tuple]],
    makes: str,
) -> DataFrame:
    """(keys, makes): rows that step(state, *needs) returns as a list for each row of a key in order, and end(state)
    after its last. The state is start() at a key's first row."""
    names = [*keys, *dict.fromkeys(c for c in needs if c not in keys)]
    at_needs = [names.index(c) for c in needs]
    fields = T.StructType.fromDDL(makes).fields
    schema = T.StructType([df.schema[k] for k in keys] + fields)
    out_names, made = schema.fieldNames(), [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kinds, none = None, None, None, True

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, *made], strict=True)], out_names)

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            found: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for k, row in zip(zip(*columns[: len(keys)], strict=True), zip(*(columns[i] for i in at_needs), strict=True), strict=True):
                if none or k != key:
                    if not none:
                        found += [(*key, *x) for x in end(state)]
                    key, state, none = k, start(), False
                found += [(*k, *x) for x in step(state, *row)]
            if found:
                yield rows(found)
        if not none and (last := [(*key, *x) for x in end(state)]):
            yield rows(last)

    return df.select(*names, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]).repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))]).select(*names).mapInArrow(run, schema)


class _Bucket:
    """The values of one count, linked to the next lower and higher count that has any."""

    __slots__ = ("count", "heap", "higher", "lower", "values")

    def __init__(self, count: int):
        self.count, self.values, self.heap = count, set(), []
        self.lower: _Bucket | None = None
        self.higher: _Bucket | None = None

    def add(self, value: str, ordered: bool) -> None:
        self.values.add(value)
        if ordered:
            heapq.heappush(self.heap, value)
            if len(self.heap) > 2 * len(self.values) + 16:  # most of it has left
                self.heap = sorted(self.values)

    def first(self, k: int) -> list[str]:
        """The k smallest values. Values that left are dropped from the heap when they come up."""
        found: list[str] = []
        while self.heap and len(found) < k:
            value = heapq.heappop(self.heap)
            if value in self.values and (not found or value != found[-1]):
                found.append(value)
        for value in found:
            heapq.heappush(self.heap, value)
        return found


class _Kinds:
    """Counts of a window's values, kept up to date as rows come and go: how many, the commonest and the entropy.

    Values lie in buckets by count, linked in order of counts. A row moves its value to the next bucket, so each change
    takes constant time, and the commonest values are read off the highest buckets; those with one count in order.
    """

    def __init__(self, top: int = 0):
        self.top = top
        self.at: dict[str, _Bucket] = {}
        self.highest: _Bucket | None = None
        self.lowest: _Bucket | None = None
        self.n, self.weight = 0, 0.0

    def change(self, value: str | None, by: int) -> None:
        """One row with the value more or less."""
        if value is None:
            return
        own = self.at.get(value)
        before = own.count if own else 0
        after = before + by
        if after:
            beside = (own.higher if own else self.lowest) if by > 0 else own.lower
            if beside is None or beside.count != after:
                beside = self._insert(after, own, beside) if by > 0 else self._insert(after, beside, own)
            beside.add(value, self.top > 0)
            self.at[value] = beside
        else:
            del self.at[value]
        if own:
            own.values.discard(value)
            if not own.values:
                self._unlink(own)
        self.n += by
        self.weight = self.weight + _weight(after) - _weight(before) if self.n else 0.0

    def _insert(self, count: int, lower: _Bucket | None, higher: _Bucket | None) -> _Bucket:
        new = _Bucket(count)
        new.lower, new.higher = lower, higher
        if lower:
            lower.higher = new
        else:
            self.lowest = new
        if higher:
            higher.lower = new
        else:
            self.highest = new
        return new

    def _unlink(self, old: _Bucket) -> None:
        if old.lower:
            old.lower.higher = old.higher
        else:
            self.lowest = old.higher
        if old.higher:
            old.higher.lower = old.lower
        else:
            self.highest = old.lower

    def commonest(self, k: int) -> list[tuple[str, int]]:
        found: list[tuple[str, int]] = []
        bucket = self.highest
        while bucket and len(found) < k:
            found += [(value, bucket.count) for value in bucket.first(k - len(found))]
            bucket = bucket.lower
        return found

    def state(self) -> dict[str, Any]:
        bits = max(0.0, math.log2(self.n) - self.weight / self.n) if self.n else 0.0
        out = {"kinds": len(self.at), "most": self.highest.count if self.highest else 0, "bits": bits}
        if self.top:
            out["top"] = [{"value": v, "n": n} for v, n in self.commonest(self.top)]
        return out


class _Sorted:
    """A window's numbers in order, in blocks of bounded length, kept up to date as rows come and go."""

    MOST = 512

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.highest: list[float] = []  # the last number of each block
        self.ends: list[int] = []  # how many numbers there are up to the end of each, when they were last looked up
        self.n = 0

    def change(self, value: float | None, by: int) -> None:
        """One row with the number more or less."""
        if value is None:
            return
        self.n += by
        if not self.blocks:
            self.blocks, self.highest = [[value]], [value]
            return
        at = min(bisect_left(self.highest, value), len(self.blocks) - 1)
        block = self.blocks[at]
        if by > 0:
            insort(block, value)
        else:
            del block[bisect_left(block, value)]
        if len(block) > self.MOST:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.highest[at : at + 1] = [block[half - 1], block[-1]]
        elif block:
            self.highest[at] = block[-1]
        else:
            del self.blocks[at], self.highest[at]

    def at(self, place: int) -> float:
        """The number at a place in order; ``ends`` must be up to date."""
        own = bisect_right(self.ends, place)
        return self.blocks[own][place - (self.ends[own - 1] if own else 0)]

    def below(self, value: float) -> int:
        """How many numbers are less."""
        at = bisect_left(self.highest, value)
        return (self.ends[at - 1] if at else 0) + (bisect_left(self.blocks[at], value) if at < len(self.blocks) else 0)

    def distance(self, k: int, middle: float, below: int) -> float:
        """The k-th smallest distance from a number that ``below`` of them are less than: those less give distances in order
        going down, the others going up, and halving finds how many of the k + 1 smallest are of the first kind."""
        lo, hi = max(0, k + 1 - (self.n - below)), min(k + 1, below)
        down, up = (lambda i: middle - self.at(below - 1 - i)), (lambda j: self.at(below + j) - middle)
        while lo < hi:
            i = (lo + hi) // 2
            if down(i) < up(k - i):
                lo = i + 1
            else:
                hi = i
        return max(down(lo - 1) if lo else -math.inf, up(k - lo) if k - lo >= 0 else -math.inf)

    def state(self) -> dict[str, Any]:
        """How many, the median and the median distance from it."""
        n = self.n
        if not n:
            return {"n": 0, "median": None, "mad": None}
        self.ends = list(accumulate(map(len, self.blocks)))
        low, high = (n - 1) // 2, n // 2
        middle = self.at(low) if low == high else (self.at(low) + self.at(high)) / 2
        below = self.below(middle)
        mad = self.distance(low, middle, below) if low == high else (self.distance(low, middle, below) + self.distance(high, middle, below)) / 2
        return {"n": n, "median": middle, "mad": mad}


def _weight(count: int) -> float:
    return count * math.log2(count) if count > 1 else 0.0


def trailing_state(
    df: DataFrame, keys: list[str], *, seconds: float, ts: str = "ts", n: str = "n", first: str | None = None, sums: dict[str, Column] | None = None, kinds: dict[str, Column] | None = None,
    top: dict[str, int] | None = None, medians: dict[str, Column] | None = None, gaps: str | None = None,
) -> DataFrame:
    """df with what the rows of the same keys in the seconds up to each row hold, both edges and ties included.

    n is how many, first the earliest time, sums of whole numbers, and for each of kinds a struct of how many values
    there are, the commonest one's count and the entropy in bits; nulls do not count. Kinds named in top also get the so
    many commonest values with their counts, those with one count in order of the value. For each of medians, and under the name
    ``gaps`` for the times between one row and the next, there is a struct of how many numbers there are, their median and
    the median distance from it. A key's time is cut into slices
    of a few windows, each a task's, so a hot key is shared out; the rows of the window before a slice are copied to it.
    Rows stream through a task once and what is held is the window.
    """
    sums, kinds, top = sums or {}, kinds or {}, top or {}
    tops = [top.get(name, 0) for name in kinds]
    medians = medians or {}
    length = float(seconds) * SLICE_WINDOWS
    at = F.floor(F.col(ts) / length).cast("long")
    late = F.col(ts) >= (at + 1) * length - seconds - (1e-6 + length * 1e-9)
    to = F.array_compact(F.array(F.struct(at.alias("slice"), F.lit(True).alias("own")), F.when(late, F.struct((at + 1).alias("slice"), F.lit(False).alias("own")))))
    names, width = df.columns, len(df.columns)
    own = {f"__s{i}": c.cast("long") for i, c in enumerate(sums.values())} | {f"__k{i}": c.cast("string") for i, c in enumerate(kinds.values())} | {f"__m{i}": c.cast("double") for i, c in enumerate(medians.values())}
    dealt = df.withColumns({**own, "__to": F.explode(to)}).select(*names, *own, F.col("__to.slice").alias("__slice"), F.col("__to.own").alias("__own"))
    at_key = [dealt.columns.index(k) for k in [*keys, "__slice"]]
    at_ts, n_sums, n_kinds, n_medians = names.index(ts), len(sums), len(kinds), len(medians)
    structs = [to_arrow_type(TOP_KINDS if k else KINDS) for k in tops] + [to_arrow_type(MIDDLE)] * (n_medians + bool(gaps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, tied = None, None, 0  # tied: own rows at the time that is now
        window: deque = deque()
        totals, counters = [0] * n_sums, [_Kinds(k) for k in tops] + [_Sorted() for _ in range(n_medians)]
        between = _Sorted()
        waiting: deque[pa.RecordBatch] = deque()
        found: list[tuple] = []

        def settle() -> None:
            nonlocal tied
            if tied:
                found.extend([(len(window), window[0][0], *totals, *[c.state() for c in counters], *([between.state()] if gaps else []))] * tied)
                tied = 0

        def ready() -> Iterator[pa.RecordBatch]:
            while waiting and len(found) >= waiting[0].num_rows:
                batch = waiting.popleft()
                rows, found[:] = found[: batch.num_rows], found[batch.num_rows :]
                if not rows:
                    continue
                cols = list(zip(*rows, strict=True))
                made = [pa.array(cols[0], pa.int64())]
                made += [pa.array(cols[1], pa.float64())] if first else []
                made += [pa.array(c, pa.int64()) for c in cols[2 : 2 + n_sums]] + [pa.array(c, kind) for c, kind in zip(cols[2 + n_sums :], structs, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], out_names)

        for batch in batches:
            mine = batch.column(batch.num_columns - 1)
            waiting.append(batch.filter(mine))
            columns = [batch.column(i).to_pylist() for i in (*at_key, at_ts, *range(width, width + n_sums + n_kinds + n_medians))]
            n_key = len(at_key)
            rows = zip(*columns[n_key:], strict=True)
            for k, row, is_own in zip(zip(*columns[:n_key], strict=True), rows, mine.to_pylist(), strict=True):
                t = row[0]
                if k != key:
                    settle()
                    key, now = k, t
                    window.clear()
                    totals, counters = [0] * n_sums, [_Kinds(k) for k in tops] + [_Sorted() for _ in range(n_medians)]
                    between = _Sorted()
                elif t != now:
                    settle()
                    now = t
                    while window and (window[0][0] is None or window[0][0] < t - seconds):
                        gone = window.popleft()
                        for i in range(n_sums):
                            totals[i] -= gone[1 + i] or 0
                        for i in range(n_kinds + n_medians):
                            counters[i].change(gone[1 + n_sums + i], -1)
                        if gaps and window and gone[0] is not None:
                            between.change(window[0][0] - gone[0], -1)
                if gaps and window and window[-1][0] is not None:
                    between.change(t - window[-1][0], 1)
                window.append(row)
                for i in range(n_sums):
                    totals[i] += row[1 + i] or 0
                for i in range(n_kinds + n_medians):
                    counters[i].change(row[1 + n_sums + i], 1)
                tied += is_own
            yield from ready()
        settle()
        yield from ready()

    schema = T.StructType(list(df.schema.fields)).add(n, "long")
    if first:
        schema = schema.add(first, "double")
    for name in sums:
        schema = schema.add(name, "long")
    for name, k in zip(kinds, tops, strict=True):
        schema = schema.add(name, TOP_KINDS if k else KINDS)
    for name in [*medians, *([gaps] if gaps else [])]:
        schema = schema.add(name, MIDDLE)
    out_names = schema.fieldNames()
    dealt = dealt.repartition(*keys, "__slice").sortWithinPartitions(*keys, "__slice", ts)
    return dealt.mapInArrow(run, schema)


def last_counts(df: DataFrame, by: list[str], order: list[str], *, n: int, same: dict[str, list[str]], of: dict[str, Column] | None = None, slice_rows: int | None = None) -> DataFrame:
    """df with counts over the last n rows of the same ``by`` up to each one: for each of ``same``, of the rows that agree
    with it on those columns, and for each of ``of``, of the rows for which it holds. A null agrees with nothing.

    Rows are numbered in two levels and cut into slices of slice_rows, with the n - 1 rows before a slice copied to it, so
    one key's rows are shared out whatever their times. Counters add and take away a row as the window moves on; what is
    held is n rows.
    """
    of, length = of or {}, slice_rows or max(16 * n, 4096)
    names, width = df.columns, len(df.columns)
    needs = list(dict.fromkeys(c for columns in same.values() for c in columns))
    numbered = running_total(df, F.lit(1), order, by=by, name="__i")
    at = F.floor((F.col("__i") - 1) / length).cast("long")
    late = (F.col("__i") - 1) % length >= length - (n - 1)
    to = F.array_compact(F.array(F.struct(at.alias("slice"), F.lit(True).alias("own")), F.when(late, F.struct((at + 1).alias("slice"), F.lit(False).alias("own")))))
    marks = {f"__f{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(of.values())}
    dealt = numbered.withColumns({**marks, "__to": F.explode(to)}).select(*names, *marks, "__i", F.col("__to.slice").alias("__slice"), F.col("__to.own").alias("__own"))
    at_key, at_needs = [dealt.columns.index(k) for k in [*by, "__slice"]], [names.index(c) for c in needs]
    groups = [[needs.index(c) for c in columns] for columns in same.values()]
    out_names, n_of = [*names, *same, *of], len(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window = None, deque()
        counters: list[dict[tuple, int]] = [{} for _ in groups]
        held = [0] * n_of

        def change(row: tuple, by_: int) -> None:
            values, flags = row
            for counter, value in zip(counters, values, strict=True):
                if value is not None:
                    left = counter.get(value, 0) + by_
                    if left:
                        counter[value] = left
                    else:
                        del counter[value]
            for i, flag in enumerate(flags):
                held[i] += by_ * flag

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in at_key), strict=True)
            columns = [batch.column(i).to_pylist() for i in at_needs]
            flags = list(zip(*(batch.column(width + i).to_pylist() for i in range(n_of)), strict=True)) if n_of else [()] * batch.num_rows
            own = batch.column(batch.num_columns - 1).to_pylist()
            found: list[list[int]] = []
            for k, mine, flag, *row in zip(keys, own, flags, *columns, strict=True):
                if k != key:
                    key = k
                    window.clear()
                    counters[:], held[:] = [{} for _ in groups], [0] * n_of
                values = [tuple(row[i] for i in places) for places in groups]
                values = [None if None in v else v for v in values]
                if len(window) == n:
                    change(window.popleft(), -1)
                window.append((values, flag))
                change(window[-1], 1)
                if mine:
                    found.append([*[0 if v is None else c[v] for c, v in zip(counters, values, strict=True)], *held])
            kept = batch.filter(batch.column(batch.num_columns - 1))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([*kept.columns[:width], *[pa.array(c, pa.int32()) for c in zip(*found, strict=True)]], out_names)

    schema = T.StructType(list(df.schema.fields))
    for name in (*same, *of):
        schema = schema.add(name, "integer")
    return dealt.repartition(*by, "__slice").sortWithinPartitions(*by, "__slice", "__i").mapInArrow(run, schema)


def running_total(df: DataFrame, value: Column, order: list[str], *, by: list[str] | None = None, name: str, buckets: int | None = None, before: list[str] | None = None) -> DataFrame:
    """df with the sum of ``value`` over the rows up to each one in ``order``, within ``by``.

    In two levels: sums of ranges of the first ordering column, which is a number, then a running sum within a range;
    so no task takes all rows of a key, however many it has. With ``before``, ``before_x`` is column x of the row before
    in the same range; ``opens`` and ``closes`` tell the first and the last row of a range.
    """
    by = by or []
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.col(order[0]).cast("double")
    cuts = sorted(set(df.select(lead.alias("x")).approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    rows = df.withColumn("__value", value.cast("long")).withColumn("__bucket", _bucket(cuts, lead).cast("long"))
    sums = rows.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__sum"))
    ahead = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = [f"__by{i}" for i in range(len(by))]
    ahead = ahead.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("__bucket").alias("__at"), "__ahead")
    same = F.col("__bucket") == F.col("__at")
    for b, k in zip(by, keys, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(k))
    in_order = Window.partitionBy(*by, "__bucket").orderBy(*order)
    beside = {"__within": F.sum("__value").over(in_order.rowsBetween(Window.unboundedPreceding, 0))}
    if before is not None:
        beside |= {f"before_{c}": F.lag(c).over(in_order) for c in before}
        beside |= {"opens": F.lag(F.lit(True)).over(in_order).isNull(), "closes": F.lead(F.lit(True)).over(in_order).isNull()}
    return rows.withColumns(beside).join(ahead, same).withColumn(name, F.col("__ahead") + F.col("__within")).select(*df.columns, name, *list(beside)[1:])


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact quantiles of a column of numbers, each interpolated between its two neighbours, by name.

    They are found from running counts by distinct value, so no task holds or sorts all of them; nulls do not count.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = running_total(per, F.col("__n"), ["__v"], name="__upto").join(F.broadcast(per.agg(F.sum("__n").alias("__all"))))  # one row beside
    at = lambda place: F.max(F.when((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place), F.col("__v")))
    ends = {}
    for name, share in shares.items():
        exact = (F.col("__all") - 1) * share
        ends |= {f"{name}_low": at(F.floor(exact)), f"{name}_high": at(F.ceil(exact)), f"{name}_part": F.max(exact - F.floor(exact))}
    found = placed.agg(*[c.alias(n) for n, c in ends.items()])
    return found.select(*[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in shares])


def _bucket(cuts: list[float], lead: Column) -> Column:
    """How many of the cuts are at or below ``lead``, by halving; -1 for null."""

    def at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        m = (lo + hi) // 2
        return F.when(lead >= cuts[m], at(m + 1, hi)).otherwise(at(lo, m))

    return F.when(lead.isNull(), -1).otherwise(at(0, len(cuts)))
