"""How often stateful operators go to the state store, counted with a store that is a dictionary."""

import random

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from weir.plans import streams
from weir.streaming import keyed


class Store:
    """One key's state; calls counts what a processor asks for."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def state(self, *_, listed=False):
        store = self

        class State:
            def __init__(self):
                self.rows, self.pairs, self.value = [], {}, None

            def __getattribute__(self, name):
                if name not in ("rows", "pairs", "value", "__dict__", "__class__"):
                    store.calls += 1
                return super().__getattribute__(name)

            def exists(self):
                return bool(self.rows or self.pairs) or self.value is not None

            def appendList(self, rows):
                self.rows = [*self.rows, *rows]

            def put(self, rows):
                self.rows = list(rows)

            def get(self):
                return iter(self.rows) if listed else self.value

            def update(self, value):
                self.value = value

            def clear(self):
                self.rows, self.pairs, self.value = [], {}, None

            def getValue(self, k):
                return self.pairs.get(k)

            def containsKey(self, k):
                return k in self.pairs

            def updateValue(self, k, v):
                self.pairs[k] = v

            def removeKey(self, k):
                self.pairs.pop(k, None)

            def keys(self):
                return iter(list(self.pairs))

        return State()

    getValueState = getMapState = state

    def getListState(self, *_):
        return self.state(listed=True)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))


def fed(processor, store, rows, mark):
    """One batch of a key: its rows, then the timers that a watermark passes."""
    values = TimerValues(0, mark)
    out = list(processor.handleInputRows((1,), iter(rows), values))
    for at in sorted(store.timers):
        if at < mark and at in store.timers:
            out += processor.handleExpiredTimer((1,), values, ExpiredTimerInfo(at))
            store.timers.discard(at)
    return out


SCHEMA = T.StructType([T.StructField("v", T.LongType()), T.StructField("_millis", T.LongType())])


def test_waiting_rows_are_read_once_for_a_watermark():
    store, processor = Store(), keyed._Held(SCHEMA)
    processor.init(store)
    rows = [Row(v=n, _millis=(n * 7919) % 2500) for n in range(2500)]
    assert fed(processor, store, rows, 0) == []
    assert len(store.timers) == 1
    assert [r.v for r in fed(processor, store, [Row(v=-1, _millis=1999)], 1000)] == [r.v for r in sorted(rows, key=lambda r: r._millis)[:1000]]
    assert store.timers == {1000}
    rest = fed(processor, store, [], 5000)
    assert [r.v for r in rest if r.v != -1] == [r.v for r in sorted(rows, key=lambda r: r._millis)[1000:]] and len(rest) == 1501 and not store.timers
    assert store.calls < 20


def test_a_value_is_counted_once_in_a_batch():
    """Many changes of few values: the store is asked for each value once, and deletions still bring back the next best one."""
    store, processor = Store(), keyed._Group(["k"], {"n": ("count", None, False), "top": ("max", "v", False), "kinds": ("count", "v", True)}, {"top": T.LongType(), "kinds": T.LongType()}, True, None)
    processor.init(store)
    rows = [Row(row_kind="+I", k=1, v=n % 5) for n in range(3000)]
    assert [tuple(r) for r in fed(processor, store, rows, 0)] == [("+I", 1, 3000, 4, 5)]
    gone = [Row(row_kind="-D", k=1, v=n % 5) for n in range(3000) if n % 5 > 2]
    assert [tuple(r) for r in fed(processor, store, gone, 0)] == [("-U", 1, 3000, 4, 5), ("+U", 1, 1800, 2, 3)]
    assert store.calls < 100
    left = [Row(row_kind="-D", k=1, v=n % 5) for n in range(3000) if n % 5 <= 2]
    assert [tuple(r) for r in fed(processor, store, left, 0)] == [("-D", 1, 1800, 2, 3)]


def test_counts_are_stored_when_there_are_many(monkeypatch):
    monkeypatch.setattr(keyed._Group, "MOST", 3)
    store, processor = Store(), keyed._Group(["k"], {"kinds": ("count", "v", True)}, {"kinds": T.DoubleType()}, True, None)
    processor.init(store)
    rows = [Row(k=1, v=x) for _ in range(2) for x in (1.0, 2.0, float("nan"), 0.0, -0.0, 3.0, float("nan"))]
    assert [tuple(r) for r in fed(processor, store, rows, 0)] == [("+I", 1, 5)]


def over(functions, frame):
    store, processor = Store(), keyed._Over(SCHEMA, functions, frame, False)
    processor.init(store)
    assert fed(processor, store, [Row(v=n, _millis=n) for n in range(1000)], 0) == []
    return store, fed(processor, store, [], 1000)


def test_running_functions_read_their_rows_once():
    store, got = over({"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "rk": ("rank", None)}, ("range", None))
    assert [tuple(r) for r in got] == [(n, n * (n + 1) // 2, n + 1, 0, n + 1) for n in range(1000)]
    assert store.calls < 20


def test_bounded_frames_read_their_rows_once():
    store, got = over({"n": ("count", "v"), "hi": ("max", "v")}, ("range", 10))
    assert [tuple(r) for r in got] == [(n, min(n, 10) + 1, n) for n in range(1000)]
    assert store.calls < 20


def groups(functions, kinds, key_kinds):
    processor, store = keyed._Groups(["k"], functions, kinds, True, key_kinds, 1), Store()
    processor.init(store)
    return processor, store


def test_keys_share_state():
    """A batch of many keys asks the store for parts, not for keys."""
    processor, store = groups({"n": ("count", None, False)}, {}, [T.LongType()])
    rows = [Row(k=n % 4000, _hash=n % 4000) for n in range(8000)]
    assert {tuple(r) for r in fed(processor, store, rows, 0)} == {("+I", k, 2) for k in range(4000)}
    assert {tuple(r) for r in fed(processor, store, rows[:5], 0)} == {x for k in range(5) for x in (("-U", k, 2), ("+U", k, 3))}
    assert store.calls < 100


def test_shared_state_follows_changes_as_a_key_of_its_own(monkeypatch):
    monkeypatch.setattr(keyed._Groups, "KEYS", 3)
    functions = {"n": ("count", None, False), "m": ("count", "v", False), "s": ("sum", "v", False), "a": ("avg", "v", False)}
    kinds = dict.fromkeys("msa", T.LongType())
    processor, store = groups(functions, kinds, [T.LongType()])
    alone = {}
    chance = random.Random(3)
    for _ in range(30):
        rows = [Row(row_kind=chance.choice(["+I", "-D", "+U", "-U"]), k=(k := chance.choice([None, *range(40)])), v=chance.choice([None, 0, 0, 5]), _hash=hash((k, 1)) * 7919 - 2**50) for _ in range(chance.choice([1, 5, 60]))]
        want = []
        for k in {r.k for r in rows}:
            if k not in alone:
                alone[k] = keyed._Group(["k"], functions, kinds, True, None), Store()
                alone[k][0].init(alone[k][1])
            want += alone[k][0].handleInputRows((k,), iter([r for r in rows if r.k == k]), TimerValues(0, 0))
        assert sorted(map(str, fed(processor, store, rows, 0))) == sorted(map(str, want))


def test_a_relayed_changelog_is_made_in_several_tasks(spark, tmp_path, monkeypatch):
    def task(batches):
        from pyspark import TaskContext

        for b in batches:
            yield b.assign(id=TaskContext.get().taskAttemptId())

    spark.range(80).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).repartition(4).mapInPandas(task, "id long")
    monkeypatch.setattr(streams, "folder", lambda _: str(tmp_path / "relay"))
    streams.relayed(spark, stream)
    files = list((tmp_path / "relay" / "out").glob("*.parquet"))
    assert len(files) == 1 and spark.read.parquet(str(files[0])).distinct().count() == 4


def test_rows_of_a_key_come_in_packs(spark):
    """No row is lost, those of a key stay in order, and there are few packs; also of null, true and false keys."""
    df = spark.range(5000).coalesce(1).selectExpr("nullif(id % 7, 3) AS k", "nullif(id % 3 = 0, id % 5 = 0) AS b", "id AS v", "if(id % 4 = 0, NULL, string(id)) AS s")
    packs = keyed._packed(df, ["k", "b"], ["v", "s", "k"], size=100, held=2000).collect()
    assert len(packs) < 150 and max(len(p._packed_v) for p in packs) == 100
    got, want = {}, {}
    for p in packs:
        got.setdefault((p.k, p.b), []).extend(map(tuple, keyed._Packed(None).rows([p])))
    for r in df.collect():
        want.setdefault((r.k, r.b), []).append((r.v, r.s, r.k))
    assert got == want
