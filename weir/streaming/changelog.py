"""Changelogs: rows with row_kind +I, -U, +U or -D, and a processor that keeps them for any view of a key's rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ADDS = ("+I", "+U")


def collapse(changes: DataFrame, kind: str = "row_kind") -> DataFrame:
    """The rows that a changelog leaves, each as often as it was added more than taken away."""
    body = [c for c in changes.columns if c != kind]
    net = changes.groupBy(*body).agg(F.sum(F.when(F.col(kind).isin(*ADDS), 1).otherwise(-1)).alias("_n")).where("_n > 0")
    return net.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")


class View(StatefulProcessor):
    """Keeps a key's input rows as a multiset and emits how `view(rows)` changes with each micro-batch.

    A changed result is -U/+U where one row replaces one, and -D/+I otherwise; an unchanged one gives nothing. Inputs without
    row_kind are all +I. Rows are state of their own types, so its size is the key's rows; windows and limits bound it in `trim`, and `ttl_millis` drops a key's rows so long after their last change.
    It is for views of any kind; keyed.py has processors that don't look at all rows of a key again.
    """

    def __init__(self, view: Callable[[list[dict]], list[dict]], schema: StructType, trim: Callable[[list[dict]], list[dict]] | None = None, ttl_millis: int | None = None):
        self.view, self.trim, self.schema, self.ttl, self.names = view, trim, schema, ttl_millis, schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("rows", self.schema, self.ttl)

    def _of(self, held: list[tuple], apart: bool) -> list[tuple]:
        """The view's rows. Where the key has a null, which equals nothing, a view of several sides sees each side alone."""
        rows = [dict(zip(self.names, r, strict=True)) for r in held]
        parts = [[r for r in rows if r["side"] == s] for s in "lr"] if apart else [rows]
        return [tuple(r.items()) for part in parts for r in self.view(part)]

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        del timerValues
        apart = getattr(self.view, "sides", False) and any(k is None for k in key)
        held = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        before = Counter(self._of(held, apart))
        count = Counter(held)
        new: list[tuple] = []
        for row in rows:
            row = row.asDict()
            own = tuple(row[n] for n in self.names)
            if row.get("row_kind", "+I") in ADDS:
                count[own] += 1
                new.append(own)
            elif count[own] > 0:
                count[own] -= 1
        # Rows stay in the order in which they came; of equal ones the last go.
        left, kept = Counter(), []
        for own in (*held, *new):
            if left[own] < count[own]:
                left[own] += 1
                kept.append(own)
        after = Counter(self._of(kept, apart))
        if self.trim:
            kept = [tuple(r[n] for n in self.names) for r in self.trim([dict(zip(self.names, r, strict=True)) for r in kept])]
        if kept:
            self.state.put(kept)
        elif self.state.exists():
            self.state.clear()
        gone, come = before - after, after - before
        minus, plus = ("-U", "+U") if sum(gone.values()) == sum(come.values()) else ("-D", "+I")
        for kind, changed in ((minus, gone), (plus, come)):
            for r in changed.elements():
                yield Row(row_kind=kind, **dict(r))

    def close(self) -> None:
        pass


def changes(df: DataFrame, keys: list[str], view: Callable[[list[dict]], list[dict]], schema: str, trim: Callable | None = None, ttl_millis: int | None = None) -> DataFrame:
    """The changelog of view(rows of a key) over a stream; schema is that of a result row, without row_kind."""
    out = StructType.fromDDL(f"row_kind string, {schema}")
    held = StructType([f for f in df.schema if f.name != "row_kind"])
    return df.groupBy(*keys).transformWithState(View(view, held, trim, ttl_millis), out, "Update", "ProcessingTime" if ttl_millis else "None")


def group_view(keys: list[str], value: str) -> Callable:
    """COUNT, SUM, MIN, MAX and AVG of `value` by key; the average of integers is cut toward zero."""

    def view(rows: list[dict]) -> list[dict]:
        got = [r[value] for r in rows if r[value] is not None]
        if not rows:
            return []
        total = sum(got) if got else None
        mean = None if not got else total / len(got) if not isinstance(total, int) else abs(total) // len(got) * (1 if total >= 0 else -1)
        return [{k: rows[0][k] for k in keys} | {"n": len(rows), "total": total, "lo": min(got, default=None), "hi": max(got, default=None), "mean": mean}]

    return view


def top_view(order: Callable[[dict], tuple], limit: int, offset: int = 0) -> Callable:
    """ROW_NUMBER between offset + 1 and limit; with limit 1 this is dedup: keep-first or keep-last by the order."""
    return lambda rows: sorted(rows, key=order)[offset:limit]


def join_view(how: str, left: list[str], right: list[str]) -> Callable:
    """A regular join of rows tagged side 'l' or 'r' that share the key: inner, left, right, full, semi or anti. A null key matches nothing."""

    def view(rows: list[dict]) -> list[dict]:
        ls, rs = ([r for r in rows if r["side"] == s] for s in "lr")
        if how in ("semi", "anti"):
            return [{c: r[c] for c in left} for r in ls] if bool(rs) == (how == "semi") else []
        if how in ("left", "full") and not rs:
            rs = [dict.fromkeys(right)]
        if how in ("right", "full") and not ls:
            ls = [dict.fromkeys(left)]
        return [{c: a[c] for c in left} | {c: b[c] for c in right} for a in ls for b in rs]

    view.sides = True
    return view
