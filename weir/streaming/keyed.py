"""Stateful operators over streams, with state of the rows' own types.

Those of event time keep rows until the watermark has passed them, then treat them in the order of time; so their results are final, and rows that come later than
the watermark are dropped. The others change their results as rows come and emit a changelog. Each operator's state is that of one key; what grows with a key's
rows is a list or a map in the state store, not a value. All take `ttl_millis` where state without end is possible; it goes by the clock, so a query that shall end by itself needs
spark.sql.streaming.noDataMicroBatches.enabled = false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from weir.streaming.changelog import ADDS

MILLIS = "_millis"
_NAN = float("nan")


def _with(schema: T.StructType, *fields: tuple[str, Any]) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), *(T.StructField(n, T.LongType() if k == "bigint" else k) for n, k in fields)])


def _millis(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(MILLIS, F.unix_millis(F.col(time).cast("timestamp_ltz")))


class _Rows:
    """Rows of a key as list state. An element has up to MOST rows by columns, as the store takes much longer for an element than for a value in it."""

    MOST = 1000

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: T.StructType):
        self.state = handle.getListState(name, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema]))

    def _chunks(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(list(c) for c in zip(*rows[i : i + self.MOST], strict=True)) for i in range(0, len(rows), self.MOST)]

    def get(self) -> list[tuple]:
        return [row for chunk in self.state.get() for row in zip(*chunk, strict=True)]

    def add(self, rows: list[tuple]) -> None:
        self.state.appendList(self._chunks(rows))

    def put(self, rows: list[tuple]) -> None:
        if rows:
            self.state.put(self._chunks(rows))
        else:
            self.state.clear()


class _Waiting(StatefulProcessor):
    """Keeps rows until the watermark passes their time, then hands them to `passed` in the order of time, those of one time as they came.

    A key has one timer, at the least time that waits; so its rows are read once for all that a watermark passes.
    """

    def __init__(self, schema: T.StructType):
        self.schema, self.names = schema, schema.fieldNames()
        self.at = self.names.index(MILLIS)
        self.body = [i for i in range(len(self.names)) if i != self.at]
        self.places: list[int] | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = _Rows(handle, "waiting", self.schema)

    def due(self, row: tuple) -> int:
        return row[self.at]

    def own(self, rows: Iterable[Row]) -> list[tuple]:
        """Rows as tuples in the order of the schema."""
        rows = list(rows)
        if self.places is None and rows:
            self.places = [rows[0].__fields__.index(n) for n in self.names]
        return [tuple(row[i] for i in self.places) for row in rows]

    def shown(self, *added: str) -> Callable[[tuple, Iterable], Row]:
        """Makes a row's columns, and those that are added, a row of the result."""
        make, body = Row(*(self.names[i] for i in self.body), *added), self.body
        return lambda row, values=(): make(*[row[i] for i in body], *values)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rest = [r for r in self.own(rows) if self.due(r) is not None and self.due(r) >= mark]
        if not rest:
            return iter(())
        ready, timers = [], list(self.handle.listTimers())
        if timers and min(timers) < mark:
            held = self.waiting.get()
            ready, rest = sorted((r for r in held if self.due(r) < mark), key=self.due), [*(r for r in held if self.due(r) >= mark), *rest]
            self.waiting.put(rest)
        else:
            self.waiting.add(rest)
        first = min(map(self.due, rest))
        if ready or not timers or first < min(timers):
            for at in timers:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(first)
        return self.passed(key, ready) if ready else iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held = self.waiting.get()
        ready = sorted((r for r in held if self.due(r) <= upto), key=self.due)
        if ready:
            rest = [r for r in held if self.due(r) > upto]
            self.waiting.put(rest)
            if rest:
                self.handle.registerTimer(min(map(self.due, rest)))
            yield from self.passed(key, ready)

    def passed(self, key, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, out: T.StructType, mode: str = "Append", time: str = "EventTime") -> DataFrame:
    return df.groupBy(*keys).transformWithState(processor, out, mode, time)


class _Packed(StatefulProcessor):
    """Hands a processor the rows of a key out of packs, which are rows of lists."""

    PREFIX = "_packed_"

    def __init__(self, processor: StatefulProcessor):
        self.processor = processor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.processor.init(handle)

    def rows(self, packs: Iterable[Row]) -> Iterator[Row]:
        make, at = None, []
        for pack in packs:
            if make is None:
                at = [i for i, n in enumerate(pack.__fields__) if n.startswith(self.PREFIX)]
                make = Row(*(pack.__fields__[i][len(self.PREFIX) :] for i in at))
            yield from map(make, *(pack[i] for i in at))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        return self.processor.handleInputRows(key, self.rows(rows), timerValues)

    def close(self) -> None:
        self.processor.close()


def _packed(df: DataFrame, by: list[str], columns: list[str], size: int = 200, held: int = 100_000) -> DataFrame:
    """df's rows in packs of up to `size` that agree in `by`, each column a list, in the order in which they came: Python takes some 50 times longer for a row than for a value of a list.

    A task holds `held` rows or one Arrow batch more.
    """
    prefix = _Packed.PREFIX

    def packs(batches: list):
        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(batches).combine_chunks()
        whole = {c: table[c].chunk(0) for c in table.column_names}
        codes = [whole[c].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in by]
        order = np.lexsort(codes)  # stable
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([np.diff(c[order]) != 0 for c in codes])
        at = np.arange(len(order))
        starts = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % size == 0))
        ends = pa.array(np.append(starts, len(order)), pa.int32())
        keys = [whole[c].take(pa.array(order[starts])) for c in by]
        lists = [pa.ListArray.from_arrays(ends, whole[c].take(pa.array(order))) for c in columns]
        return pa.RecordBatch.from_arrays([*keys, *lists], names=[*by, *(prefix + c for c in columns)])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= held:
                yield packs(waiting)
                waiting, n = [], 0
        if waiting:
            yield packs(waiting)

    out = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in by), *(T.StructField(prefix + c, T.ArrayType(df.schema[c].dataType)) for c in columns)])
    return df.select(*dict.fromkeys([*by, *columns])).mapInArrow(run, out)


# OVER ----------------------------------------------------------------------------------------------------------------


class _Over(_Waiting):
    """Functions over the rows before each row in its key. kept is the rows that a bounded frame may still need; sums hold the unbounded ones."""

    def __init__(self, schema: T.StructType, functions: dict[str, tuple[str, str | None]], frame: tuple[str, int | None], by_arrival: bool):
        super().__init__(schema)
        self.functions, self.frame, self.by_arrival = functions, frame, by_arrival
        self.columns = {name: self.names.index(c) if c else None for name, (_, c) in functions.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        if self.frame[1] is not None:
            self.kept = _Rows(handle, "kept", self.schema)
            return
        kinds = [(f"{n}_{part}", "bigint" if part == "n" else self.schema[self.columns[n]].dataType) for n, (f, c) in self.functions.items() if c for part in self._parts(f)]
        self.sums = handle.getValueState("sums", _with(T.StructType(), ("rows", "bigint"), ("peers", "bigint"), ("rank", "bigint"), ("last_millis", "bigint"), *kinds))

    @staticmethod
    def _parts(f: str) -> tuple[str, ...]:
        return ("n",) if f == "count" else ("n", "sum") if f == "avg" else (f,)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        return self.passed(key, self.own(rows)) if self.by_arrival else super().handleInputRows(key, rows, timerValues)

    def passed(self, key, rows: list[tuple]) -> Iterator[Row]:
        kind, size = self.frame
        shown = self.shown(*self.functions)
        return (shown(row, found) for row, found in (self._unbounded(rows) if size is None else self._bounded(rows, kind, size)))

    def _unbounded(self, rows: list[tuple]) -> Iterator[tuple[tuple, list]]:
        steps, width = [], 4
        for name, (f, c) in self.functions.items():
            if c:
                steps.append((f, self.columns[name], width))
                width += len(self._parts(f))
        acc = list(self.sums.get() or (0, 0, 0, None, *[0 if part == "n" else None for f, _, _ in steps for part in self._parts(f)]))
        at, peers, i = self.at, self.frame[0] == "range" and not self.by_arrival, 0
        while i < len(rows):
            # In a RANGE frame all rows of one time see each other.
            j = i + 1
            while peers and j < len(rows) and rows[j][at] == rows[i][at]:
                j += 1
            ranks = []
            for row in rows[i:j]:
                acc[0] += 1
                if acc[3] is None or row[at] != acc[3]:
                    acc[1], acc[2], acc[3] = acc[1] + 1, acc[0], row[at]
                for f, c, k in steps:
                    v = row[c]
                    if f == "last_value":
                        acc[k] = v
                    elif f == "first_value":
                        if acc[0] == 1:
                            acc[k] = v
                    elif v is None:
                        pass
                    elif f == "count":
                        acc[k] += 1
                    elif f == "min":
                        acc[k] = v if acc[k] is None else min(acc[k], v)
                    elif f == "max":
                        acc[k] = v if acc[k] is None else max(acc[k], v)
                    else:
                        if f == "avg":
                            acc[k] += 1
                            k += 1
                        acc[k] = v if acc[k] is None else acc[k] + v
                ranks.append((acc[0], acc[2], acc[1]))
            for row, own in zip(rows[i:j], ranks, strict=True):
                # Ranks are the row's own; values are those at the end of its peers.
                found, k = [], 4
                for f, c in self.functions.values():
                    if c is None:
                        found.append(acc[0] if f == "count" else own[("row_number", "rank", "dense_rank").index(f)])
                    else:
                        found.append(_mean(acc[k + 1], acc[k]) if f == "avg" else acc[k])
                        k += len(self._parts(f))
                yield row, found
            i = j
        self.sums.update(tuple(acc))

    def _bounded(self, rows: list[tuple], kind: str, size: int) -> Iterator[tuple[tuple, list]]:
        before = self.kept.get()
        every, start, at = [*before, *rows], len(before), self.at
        functions = [(f, self.columns[name]) for name, (f, _) in self.functions.items()]
        columns = {c: [r[c] for r in every] for _, c in functions if c is not None}
        low, end = 0, 0
        for i in range(start, len(every)):
            if kind == "rows":
                low, end = max(0, i - size), i + 1
            else:
                while every[low][at] < every[i][at] - size:
                    low += 1
                end = max(end, i + 1)
                while end < len(every) and every[end][at] == every[i][at]:
                    end += 1
            frames = {c: [v for v in values[low:end] if v is not None] for c, values in columns.items()}
            found = []
            for f, c in functions:
                if c is None:
                    found.append(end - low)
                elif f == "first_value":
                    found.append(columns[c][low])
                elif f == "last_value":
                    found.append(columns[c][end - 1])
                elif f == "count":
                    found.append(len(frames[c]))
                elif not frames[c]:
                    found.append(None)
                else:
                    found.append(min(frames[c]) if f == "min" else max(frames[c]) if f == "max" else sum(frames[c]) if f == "sum" else _mean(sum(frames[c]), len(frames[c])))
            yield every[i], found
        self.kept.put(every[max(0, len(every) - size) :] if kind == "rows" else [r for r in every if r[at] >= every[-1][at] - size])


def _mean(total, n: int):
    if not n:
        return None
    return (abs(total) // n) * (1 if total >= 0 else -1) if isinstance(total, int) else total / n


def over(df: DataFrame, keys: list[str], time: str, functions: dict[str, tuple[str, str | None]], frame: tuple[str, int | None] = ("range", None), by_arrival: bool = False) -> DataFrame:
    """df's rows with a column for each of functions: (function, column) over the rows of the key up to the row.

    frame is ("range", None) and ("rows", None) without a start, ("rows", n) from n rows before, ("range", milliseconds) from so long before. Functions are sum, min, max,
    count, avg, first_value and last_value, and row_number, rank and dense_rank, which have no column. Averages of integers are cut. df needs a watermark on time; by_arrival
    takes rows in the order in which they come, at once.
    """
    if frame[1] is not None and any(f in ("row_number", "rank", "dense_rank") for f, _ in functions.values()):
        raise ValueError("ranks have no frame")
    df = _millis(df, time)
    kinds = {"count": "bigint", "row_number": "bigint", "rank": "bigint", "dense_rank": "bigint"}
    body = T.StructType([f for f in df.schema if f.name != MILLIS])
    out = _with(body, *((n, kinds.get(f) or df.schema[c].dataType) for n, (f, c) in functions.items()))
    return _run(df, keys, _Over(df.schema, functions, frame, by_arrival), out, time="None" if by_arrival else "EventTime")


# Dedup, Top-N, normalisation -----------------------------------------------------------------------------------------


class _First(_Waiting):
    """The first row of a key by time, once the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.done = handle.getValueState("done", "at bigint")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        return iter(()) if self.done.exists() else super().handleInputRows(key, rows, timerValues)

    def passed(self, key, rows: list[tuple]) -> Iterator[Row]:
        if not self.done.exists():
            self.done.update((rows[0][self.at],))
            self.waiting.put([])
            yield self.shown()(rows[0])


def first_by_time(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Insert-only: each key's row of the least time. df needs a watermark on time."""
    body = df.schema
    df = _millis(df, time)
    return _run(df, keys, _First(df.schema), _with(body))


class _Latest(StatefulProcessor):
    """One row of a key, and how it changes. `better` tells whether a row replaces the one that is kept."""

    def __init__(self, schema: T.StructType, better: str, ttl: int | None, before: bool, deletes: bool):
        self.schema, self.names, self.better, self.ttl, self.before, self.deletes = schema, schema.fieldNames(), better, ttl, before, deletes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("row", self.schema, self.ttl)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        at = self.names.index(MILLIS) if MILLIS in self.names else None
        out = lambda kind, r: Row(row_kind=kind, **{n: v for n, v in zip(self.names, r, strict=True) if n != MILLIS})
        for row in rows:
            kind = row.asDict().get("row_kind", "+I")
            new = tuple(row[n] for n in self.names)
            if self.deletes and kind not in ADDS:
                if kind == "-D" and held is not None:
                    yield out("-D", held)
                    held = None
                continue
            if held is None:
                held = new
                yield out("+I", held)
            elif self.better == "first" or held == new and self.deletes or self.better == "time" and new[at] < held[at]:
                continue
            else:
                if self.before:
                    yield out("-U", held)
                held = new
                yield out("+U", held)
        if held is not None:
            self.state.update(held)
        elif self.state.exists():
            self.state.clear()

    def close(self) -> None:
        pass


def _latest(df: DataFrame, keys: list[str], better: str, ttl_millis: int | None, update_before: bool, deletes: bool = False) -> DataFrame:
    body = T.StructType([f for f in df.schema if f.name != "row_kind"])
    out = T.StructType([T.StructField("row_kind", T.StringType()), *(f for f in _with(body) if f.name != MILLIS)])
    return _run(df, keys, _Latest(_with(body), better, ttl_millis, update_before, deletes), out, "Update", "ProcessingTime" if ttl_millis else "None")


def last_by_time(df: DataFrame, keys: list[str], time: str, ttl_millis: int | None = None, update_before: bool = True) -> DataFrame:
    """A changelog of each key's row of the greatest time; of equal times the later one to come."""
    return _latest(_millis(df, time), keys, "time", ttl_millis, update_before)


def by_arrival(df: DataFrame, keys: list[str], keep: str = "first", ttl_millis: int | None = None, update_before: bool = True) -> DataFrame:
    """A changelog of the first, or the last, row of each key to come; that of the first has +I rows only."""
    return _latest(df, keys, keep, ttl_millis, update_before)


def normalized(changes: DataFrame, keys: list[str], ttl_millis: int | None = None, update_before: bool = True) -> DataFrame:
    """A clean changelog of an upsert stream: rows that change nothing give nothing, a deletion has the row that was kept."""
    return _latest(changes, keys, "any", ttl_millis, update_before, deletes=True)


class _WindowTop(_Waiting):
    """The first rows of a window's key by an order, once the watermark has passed the window; no more than those are kept."""

    def __init__(self, schema: T.StructType, order: list[tuple[str, bool]], limit: int, offset: int, rank: str | None):
        super().__init__(schema)
        self.order, self.limit, self.offset, self.rank = [(self.names.index(c), up) for c, up in order], limit, offset, rank

    def _sorted(self, rows: list[tuple]) -> list[tuple]:
        for c, up in reversed(self.order):
            # Nulls are the least values.
            rows = sorted(rows, key=lambda r: (r[c] is not None, r[c] if r[c] is not None else 0), reverse=not up)
        return rows

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        new = [r for r in self.own(rows) if self.due(r) >= mark]
        if new:
            self.waiting.put(self._sorted([*self.waiting.get(), *new])[: self.limit])
            self.handle.registerTimer(self.due(new[0]))
        return iter(())

    def passed(self, key, rows: list[tuple]) -> Iterator[Row]:
        shown = self.shown(*([self.rank] if self.rank else []))
        for i, row in enumerate(self._sorted(rows)[self.offset : self.limit], self.offset + 1):
            yield shown(row, (i,) if self.rank else ())


def window_top(df: DataFrame, keys: list[str], window_end: str, order: list[tuple[str, bool]], limit: int, offset: int = 0, rank: str | None = "rank_num") -> DataFrame:
    """Insert-only: rows offset + 1 to limit of each window and key, by columns of order, (name, ascending); with limit 1 this is the dedup of windows.

    df has a window's end as a column, and a watermark on a time column that comes with it.
    """
    body = df.schema
    df = df.withColumn(MILLIS, F.unix_millis(F.col(window_end).cast("timestamp_ltz")) - 1)
    out = _with(body, *([(rank, "bigint")] if rank else []))
    return _run(df, [window_end, *keys], _WindowTop(df.schema, order, limit, offset, rank), out)


class _Held(_Waiting):
    def passed(self, key, rows: list[tuple]) -> Iterator[Row]:
        return map(self.shown(), rows)


def sorted_by_time(df: DataFrame, time: str, put: Callable[[DataFrame, int], None], checkpoint: str, buckets: int = 64, trigger: dict | None = None, ties: tuple[str, ...] = ()) -> StreamingQuery:
    """Starts a query that hands batches, each sorted by time over ranges, to `put(batch, number)`; a batch's times are all after those of the one before.

    Rows wait by their millisecond, and in it by a hash to `buckets`, until the watermark has passed them, so no task holds all of them, and a batch is sorted as any table is. It is an
    aggregate of Spark's own, so no row goes through Python. Columns of `ties` order the rows of one time; without them that order is open.
    """
    body = df.schema.fieldNames()
    held = df.groupBy(F.window(time, "1 millisecond").alias("_window"), F.pmod(F.xxhash64(*body), F.lit(buckets)).alias("_bucket")).agg(F.collect_list(F.struct(*body)).alias("_rows"))

    def each(batch: DataFrame, number: int) -> None:
        # The ranges are drawn from a pass of their own; the state isn't worked on twice.
        batch = batch.persist()
        try:
            put(batch.orderBy(time, *ties), number)
        finally:
            batch.unpersist()

    return held.select(F.inline("_rows")).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# Joins ---------------------------------------------------------------------------------------------------------------


class _Temporal(_Waiting):
    """Probes and versions of a key in the order of time, versions first; the version that holds is a value."""

    def __init__(self, schema: T.StructType, version: T.StructType, probe: list[str], how: str):
        super().__init__(schema)
        self.version, self.probe, self.how = version, probe, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("version", self.version)

    def passed(self, key, rows: list[tuple]) -> Iterator[Row]:
        before = held = self.now.get()
        side, kind = self.names.index("_side"), self.names.index("_kind")
        versions = [f"version_{f.name}" for f in self.version]
        probe, version = [self.names.index(c) for c in self.probe], [self.names.index(c) for c in versions]
        make, nothing = Row(*self.probe, *versions), [None] * len(versions)
        ends = lambda r: r[kind] in ("-D", "-U")
        for row in sorted(rows, key=lambda r: (r[self.at], r[side], not ends(r))):
            if row[side] == 0:
                held = None if ends(row) else tuple(row[i] for i in version)
            elif held is not None or self.how == "left":
                found = held if held is not None and all(k is not None for k in key) else nothing
                if self.how == "left" or found is held:
                    yield make(*[row[i] for i in probe], *found)
        if held is not None:
            if held != before:
                self.now.update(held)
        elif before is not None:
            self.now.clear()


def temporal_join(probe: DataFrame, versions: DataFrame, key: str, time: str, how: str = "inner", kind: str | None = None) -> DataFrame:
    """Each probe row with the version of its key that holds at its time, once the watermark has passed it. how is inner or left.

    Both streams have the key and time columns by the same names and a watermark on time; the slower one's counts. Of a key's versions only the one that holds stays.
    `kind` names a column of change kinds of the versions; a -D ends its key's version.
    """
    body = [c for c in versions.columns if c not in (key, time, kind)]
    p = probe.withColumns({"_side": F.lit(1), "_kind": F.lit(None).cast("string")})
    v = versions.withColumns({"_side": F.lit(0), "_kind": F.col(kind) if kind else F.lit("+I")}).select(key, time, "_side", "_kind", *(F.col(c).alias(f"version_{c}") for c in body))
    both = _millis(p.unionByName(v, allowMissingColumns=True), time)
    version = T.StructType([T.StructField(c, versions.schema[c].dataType) for c in body])
    out = _with(probe.schema, *((f"version_{c}", versions.schema[c].dataType) for c in body))
    return _run(both, [key], _Temporal(_with(both.schema), version, probe.columns, how), out)


def interval_join(left: DataFrame, right: DataFrame, on: Column, time: tuple[str, str], lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Rows of two streams with lower <= left time - right time <= upper. Both have a watermark on their time, after which unmatched rows come out padded and state goes."""
    a, b = F.col(time[0]), F.col(time[1])
    return left.join(right, on & (a >= b + F.expr(f"INTERVAL {lower}")) & (a <= b + F.expr(f"INTERVAL {upper}")), {"left": "left_outer", "right": "right_outer", "full": "full_outer", "semi": "left_semi"}.get(how, how))


def window_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Rows of two streams in the same window; each has its window as a struct column, l_window and r_window, of F.window over a time with a watermark, and that time no more."""
    return left.join(right, on & (F.col("l_window") == F.col("r_window")), {"left": "left_outer", "right": "right_outer", "full": "full_outer", "semi": "left_semi"}.get(how, how))


class _Join(StatefulProcessor):
    """A join that follows both sides' changes. Each distinct row is state with how often it is there and how many rows of the other side match it."""

    def __init__(self, how: str, sides: tuple[T.StructType, T.StructType], residual: Callable[[dict, dict], bool] | None, ttl: int | None):
        self.how, self.sides, self.residual, self.ttl = how, sides, residual, ttl
        self.names = tuple(s.fieldNames() for s in sides)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = tuple(handle.getMapState(n, s, "rows bigint, matches bigint", self.ttl) for n, s in zip(("left", "right"), self.sides, strict=True))

    def _match(self, left: tuple, right: tuple) -> bool:
        return self.residual is None or bool(self.residual(dict(zip(self.names[0], left, strict=True)), dict(zip(self.names[1], right, strict=True))))

    def _out(self, kind: str, left: tuple | None, right: tuple | None, times: int = 1) -> Iterator[Row]:
        values: list[tuple] = []
        for s in range(1 if self.how in ("semi", "anti") else 2):
            row = (left, right)[s]
            values += zip(self.names[s], row if row is not None else [None] * len(self.names[s]), strict=True)
        for _ in range(times):
            yield Row(row_kind=kind, **dict(values))

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        nothing = any(k is None for k in key)  # a null equals no key
        pads = (self.how in ("left", "full"), self.how in ("right", "full"))
        partial = self.how in ("semi", "anti")
        for row in rows:
            s = 0 if row["side"] == "l" else 1
            own = tuple(row[n] for n in self.names[s])
            adds = row.asDict().get("row_kind", "+I") in ADDS
            kind = "+I" if adds else "-D"
            mine, other = self.held[s], self.held[1 - s]
            n, m = mine.getValue(own) if mine.containsKey(own) else (0, None)
            if not adds and not n:
                continue
            found = [] if nothing else [(tuple(k), tuple(v)) for k, v in other.iterator() if self._match(*((own, tuple(k)) if s == 0 else (tuple(k), own)))]
            matches = sum(v[0] for _, v in found)
            for k, (times, theirs) in found:
                pair = (own, k) if s == 0 else (k, own)
                now = theirs + (1 if adds else -1)
                other.updateValue(k, (times, now))
                lonely = theirs == 0 if adds else now == 0
                if partial:
                    if s == 1 and lonely:
                        # A left row gains its first partner or loses its last.
                        yield from self._out(kind if self.how == "semi" else ("-D" if adds else "+I"), k, None, times)
                    continue
                if not adds:
                    yield from self._out("-D", *pair, times)
                if pads[1 - s] and lonely:
                    yield from self._out("-D" if adds else "+I", *((k, None) if s == 1 else (None, k)), times)
                if adds:
                    yield from self._out("+I", *pair, times)
            if partial:
                if s == 0 and (matches > 0) == (self.how == "semi"):
                    yield from self._out(kind, own, None)
            elif pads[s] and not matches:
                yield from self._out(kind, *((own, None) if s == 0 else (None, own)))
            n += 1 if adds else -1
            if n:
                mine.updateValue(own, (n, matches))
            else:
                mine.removeKey(own)

    def close(self) -> None:
        pass


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Callable[[dict, dict], bool] | None = None, ttl_millis: int | None = None) -> DataFrame:
    """The changelog of a regular join of two streams of rows or of changes: inner, left, right, full, semi or anti.

    Columns of both sides must have names of their own, but for row_kind. A null key matches nothing. residual is a further condition on (left row, right row).
    """
    named = lambda df: T.StructType([T.StructField(f.name, f.dataType) for f in df.schema if f.name != "row_kind"])
    sides = named(left), named(right)
    by = [f"_key{i}" for i in range(len(keys))]
    tagged = []
    for s, df in enumerate((left, right)):
        kind = F.col("row_kind") if "row_kind" in df.columns else F.lit("+I")
        tagged.append(df.withColumns({"row_kind": kind, "side": F.lit("lr"[s]), **{b: F.col(k[s]) for b, k in zip(by, keys, strict=True)}}))
    both = tagged[0].unionByName(tagged[1], allowMissingColumns=True)
    shown = sides[0] if how in ("semi", "anti") else T.StructType([*sides[0], *sides[1]])
    out = T.StructType([T.StructField("row_kind", T.StringType()), *shown])
    return _run(both, by, _Join(how, sides, residual, ttl_millis), out, "Update", "ProcessingTime" if ttl_millis else "None")


# Aggregates ----------------------------------------------------------------------------------------------------------


class _Group(StatefulProcessor):
    """Aggregates of a key that follow insertions and deletions. Sums and counts are values; the values of a minimum, a maximum or a DISTINCT are a map with their counts.

    A batch reads and writes the count of a value once, however many rows have it; up to MOST counts are held in between.
    """

    MOST = 100_000

    def __init__(self, keys: list[str], functions: dict[str, tuple[str, str | None, bool]], kinds: dict[str, T.DataType], before: bool, ttl: int | None):
        self.keys, self.functions, self.kinds, self.before, self.ttl = keys, functions, kinds, before, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", "n bigint", self.ttl)
        self.values = {n: handle.getValueState(f"v_{n}", T.StructType([T.StructField("n", T.LongType()), T.StructField("total", self._sum(n)), T.StructField("best", self.kinds[n])]), self.ttl) for n, (_, c, _) in self.functions.items() if c}
        self.seen = {n: handle.getMapState(f"m_{n}", T.StructType([T.StructField("value", self.kinds[n])]), "n bigint", self.ttl) for n, (f, c, distinct) in self.functions.items() if c and (distinct or f in ("min", "max"))}

    def _sum(self, name: str) -> T.DataType:
        kind = self.kinds[name]
        return T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DoubleType() if isinstance(kind, T.FloatType | T.DoubleType) else T.LongType()

    def _result(self, key, n: int, state: dict[str, list]) -> tuple | None:
        if not n:
            return None
        out = [*key]
        for name, (f, c, _) in self.functions.items():
            if not c:
                out.append(n)
                continue
            count, total, best = state[name]
            out.append(count if f == "count" else best if f in ("min", "max") else None if not count else total if f == "sum" else _mean(total, count))
        return tuple(out)

    def _changed(self, name: str, v: Any, sign: int, counts: dict) -> tuple[int, int]:
        """How often the value was there and is now; counts holds the values that the batch has met, with the stored counts and those of now."""
        known = str(v) if isinstance(v, list | dict) else v
        if (c := counts.get(known)) is None:
            if len(counts) == self.MOST:
                self._store(name, counts)
            stored = self.seen[name].getValue((v,))
            c = counts[known] = [v, stored[0] if stored else 0, stored[0] if stored else 0]
        c[2] += sign
        return c[2] - sign, c[2]

    def _store(self, name: str, counts: dict) -> None:
        for v, stored, now in counts.values():
            if now and now != stored:
                self.seen[name].updateValue((v,), (now,))
            elif stored and not now:
                self.seen[name].removeKey((v,))
        counts.clear()

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        n = (self.rows.get() or (0,))[0]
        state = {name: list(v.get() or (0, None, None)) for name, v in self.values.items()}
        before = self._result(key, n, state)
        stale, counts = set(), {name: {} for name in self.seen}
        fields: list[str] = []
        for row in rows:
            if not fields:
                fields = row.__fields__
                kind = fields.index("row_kind") if "row_kind" in fields else None
                columns = [(name, f, fields.index(c), distinct) for name, (f, c, distinct) in self.functions.items() if c]
            sign = 1 if kind is None or row[kind] in ADDS else -1
            if sign < 0 and not n:
                continue  # a deletion of what was never there
            n += sign
            for name, f, c, distinct in columns:
                if (v := row[c]) is None:
                    continue
                s, step = state[name], sign
                if name in self.seen:
                    if isinstance(v, float):
                        v = _NAN if v != v else v + 0.0  # one NaN, one zero
                    was, now = self._changed(name, v, sign, counts[name])
                    if distinct:
                        step = sign if (now == 0) != (was == 0) else 0
                    if f in ("min", "max"):
                        if sign > 0:
                            s[2] = v if s[2] is None else (min if f == "min" else max)(s[2], v)
                        elif not now and s[2] == v:
                            stale.add(name)
                s[0] += step
                if f in ("sum", "avg") and step:
                    s[1] = (s[1] or 0) + step * v if s[1] is not None else step * v
        for name, met in counts.items():
            self._store(name, met)
        for name in stale:  # the best value went: the next one is looked up once a batch
            left = [k[0] for k in self.seen[name].keys()]
            state[name][2] = (min if self.functions[name][0] == "min" else max)(left) if left else None
        after = self._result(key, n, state)
        if n:
            self.rows.update((n,))
            for name, s in state.items():
                self.values[name].update(tuple(s))
        else:
            for v in (self.rows, *self.values.values(), *self.seen.values()):
                if v.exists():
                    v.clear()
        yield from self._changes(before, after)

    def _changes(self, before: tuple | None, after: tuple | None) -> Iterator[Row]:
        if before == after:
            return
        make = Row("row_kind", *self.keys, *self.functions)
        if before is None:
            yield make("+I", *after)
        elif after is None:
            yield make("-D", *before)
        else:
            if self.before:
                yield make("-U", *before)
            yield make("+U", *after)

    def close(self) -> None:
        pass


#: Types whose values are equal in Python where they are in a GROUP BY.
_SHARED = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType())


class _Groups(_Group):
    """_Group for counts, sums and averages of many keys that share state: `key` is a bucket by a hash, and a bucket's keys are in parts, by columns.

    The store and Arrow take much longer for a key than for a value in it. A batch reads and writes a part that it changes once; a bucket doubles its parts when they have more than KEYS each,
    so a change costs no more where there are more keys.
    """

    KEYS = 500

    def __init__(self, keys: list[str], functions: dict[str, tuple[str, str | None, bool]], kinds: dict[str, T.DataType], before: bool, key_kinds: list[T.DataType], buckets: int):
        super().__init__(keys, functions, kinds, before, None)
        self.key_kinds, self.buckets = key_kinds, buckets
        self.own = [n for n, (_, c, _) in functions.items() if c]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "keys bigint, depth bigint")
        # An entry is a key's hash and rows, then the count and the sum of each function's column, then the key.
        kinds = [T.LongType(), T.LongType(), *(k for n in self.own for k in (T.LongType(), self._sum(n))), *self.key_kinds]
        self.parts = handle.getMapState("parts", "part bigint", T.StructType([T.StructField(f"c{i}", T.ArrayType(k)) for i, k in enumerate(kinds)]))
        self.width = len(kinds) - len(self.keys)

    def _read(self, part: int) -> dict[tuple, list]:
        return {e[self.width :]: list(e[: self.width]) for e in zip(*(self.parts.getValue((part,)) or ()), strict=True)}

    def _write(self, part: int, held: dict[tuple, list], stored: bool) -> None:
        if held:
            self.parts.updateValue((part,), tuple(list(c) for c in zip(*((*e, *k) for k, e in held.items()), strict=True)))
        elif stored:
            self.parts.removeKey((part,))

    def _shown(self, key: tuple, entry: tuple | list) -> tuple | None:
        return self._result(key, entry[1], {n: (entry[i], entry[i + 1], None) for n, i in zip(self.own, range(2, self.width, 2), strict=True)})

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        size, depth = self.size.get() or (0, 0)
        parts: dict[int, dict[tuple, list]] = {}
        stored: dict[int, bool] = {}
        first: dict[tuple, tuple] = {}
        fields: list[str] = []
        nothing = [0, *(v for _ in self.own for v in (0, None))]
        for row in rows:
            if not fields:
                fields = row.__fields__
                kind = fields.index("row_kind") if "row_kind" in fields else None
                hashed, by = fields.index("_hash"), [fields.index(k) for k in self.keys]
                columns = [(self.functions[n][0] != "count", fields.index(self.functions[n][1]), i) for n, i in zip(self.own, range(2, self.width, 2), strict=True)]
            sign = 1 if kind is None or row[kind] in ADDS else -1
            h = row[hashed]
            part = (h // self.buckets) & ((1 << depth) - 1)
            if (held := parts.get(part)) is None:
                held = parts[part] = self._read(part)
                stored[part] = bool(held)
            own = tuple([row[i] for i in by])
            if (entry := held.get(own)) is None:
                if sign < 0:
                    continue  # a deletion of what was never there
                entry = held[own] = [h, *nothing]
            elif sign < 0 and not entry[1]:
                continue
            if own not in first:
                first[own] = tuple(entry)
            entry[1] += sign
            for adds, c, i in columns:
                if (v := row[c]) is not None:
                    if isinstance(v, float):
                        v = v + 0.0
                    entry[i] += sign
                    if adds:
                        entry[i + 1] = sign * v if entry[i + 1] is None else entry[i + 1] + sign * v
        changed = []
        for part, held in parts.items():
            for own in [k for k in held if k in first]:
                was, now = first[own], held[own]
                if bool(was[1]) != bool(now[1]):
                    size += 1 if now[1] else -1
                changed.append((self._shown(own, was), self._shown(own, now)))
                if not now[1]:
                    del held[own]
        if size > self.KEYS << depth:
            for part in range(1 << depth):
                if part not in parts:
                    parts[part] = self._read(part)
                    stored[part] = bool(parts[part])
            while size > self.KEYS << depth:
                depth += 1
            every, parts = parts, {}
            for own, entry in (e for held in every.values() for e in held.items()):
                parts.setdefault((entry[0] // self.buckets) & ((1 << depth) - 1), {})[own] = entry
            for part in every:
                parts.setdefault(part, {})
        for part, held in parts.items():
            self._write(part, held, stored.get(part, False))
        if first:
            self.size.update((size, depth))
        for before, after in changed:
            yield from self._changes(before, after)


def group(df: DataFrame, keys: list[str], functions: dict[str, tuple[str, str | None] | tuple[str, str, bool]], update_before: bool = True, ttl_millis: int | None = None, buckets: int = 512) -> DataFrame:
    """The changelog of GROUP BY over a stream of rows or of changes. functions: result column to (count, sum, avg, min or max; column or None; distinct).

    Sums of integers are 64 bits wide, averages of integers are cut toward zero. A batch changes a key's row once at most. Keys of integers, strings and booleans share state by
    `buckets` of a hash where no function looks at single values and no time to live is set; a bucket's changed keys of one batch are in memory.
    """
    full = {n: (f[0], f[1], len(f) > 2 and f[2]) for n, f in functions.items()}
    df = df.select(*dict.fromkeys([*keys, *(c for _, c, _ in full.values() if c), *(["row_kind"] if "row_kind" in df.columns else [])]))
    kinds = {n: df.schema[c].dataType for n, (_, c, _) in full.items() if c}
    key_kinds = [df.schema[k].dataType for k in keys]
    shares = keys and not ttl_millis and all(k in _SHARED for k in key_kinds) and all(f in ("count", "sum", "avg") and not distinct for f, _, distinct in full.values())
    processor = _Groups(keys, full, kinds, update_before, key_kinds, buckets) if shares else _Group(keys, full, kinds, update_before, ttl_millis)

    def kind(name: str) -> T.DataType:
        f, c, _ = full[name]
        if f == "count":
            return T.LongType()
        if f in ("min", "max"):
            return kinds[name]
        return processor._sum(name)

    out = T.StructType([T.StructField("row_kind", T.StringType()), *(T.StructField(k, df.schema[k].dataType) for k in keys), *(T.StructField(n, kind(n)) for n in full)])
    by, rest = keys, [c for c in df.columns if c not in keys or any(c == x for _, x, _ in full.values())] or keys[:1]
    if shares:
        df = df.withColumn("_hash", F.xxhash64(*keys)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
        by, rest = ["_bucket"], [c for c in df.columns if c != "_bucket"]
    if keys and all(k in _SHARED for k in key_kinds):
        df, processor = _packed(df, by, rest), _Packed(processor)
    return _run(df, by, processor, out, "Update", "ProcessingTime" if ttl_millis else "None")
