"""What the operators share: words, word caches, and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
JAVA_WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: str.split() splits at these too; a text without any of them can be split by it.
ODD_SPACES = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(text) if ODD_SPACES.search(text) else text.split()


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


#: What a worker keeps from task to task, by module and key.
KEPT: dict[tuple[str, str], object] = {}
#: Only glibc has it.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(module: str, key: str, make: Callable):
    """make(key), made once in a worker and kept until a task of another module begins there."""
    if (module, key) not in KEPT:
        KEPT[module, key] = make(key)
    return KEPT[module, key]


def forget_others(module: str) -> None:
    for k in [k for k in KEPT if k[0] != module]:
        del KEPT[k]


def release() -> None:
    """Gives this process's free memory back to the system; malloc keeps what lies below anything that is in use."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def tidied(module: str, out: Iterator) -> Iterator:
    """The items of out, a task's work. Workers serve one operator after the other: what others keep goes before it, and its own free memory after it."""
    forget_others(module)
    try:
        yield from out
    finally:
        release()


class WordCache(dict):
    """make(word), kept for later; emptied at `limit` words, which bounds a worker's memory."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


HASHES = WordCache(xxhash.xxh3_64_intdigest)


def hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def cuts(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose `ends` are within `size` of each other, one row at least."""
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, "right")))
        yield lo, hi
        lo = hi


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time, and those of a span that is hashed apart.
STRIDE, LONG = 1 << 18, 256
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
SOLID = ~SPACE
LOWER = np.arange(256, dtype=np.uint8) + np.uint8(32) * np.isin(np.arange(256), np.arange(65, 91)).astype(np.uint8)


def lowered(raw: np.ndarray) -> np.ndarray:
    """LOWER[raw], by sums that take less time than the table."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def is_solid(raw: np.ndarray) -> np.ndarray:
    """SOLID[raw], likewise."""
    return (raw != 32) & (raw - np.uint8(9) > 4)


def _powers(base: int) -> np.ndarray:
    out = np.full(STRIDE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: A random number for each byte, zero for spaces; a word's hash is their polynomial in BASE.
BYTES = np.where(SPACE, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN))
BASE = 0x5851F42D4C957F2F
POWER, INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, nulls as empty, and where each begins, with the end of the last."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from its start to the next one's, less the spaces in it."""
    following = np.append(start[1:], len(raw))
    found = np.empty(len(start), np.uint64)
    for lo, hi in cuts(following - start[:1], STRIDE) if len(start) else ():
        # Spaces add nothing, so a span's sum reaches up to the next one. A longer one than a stride is alone here and hashed below.
        own = raw[start[lo] : min(following[hi - 1], start[lo] + STRIDE)]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(BYTES.take(own) * POWER[: len(own)], out=sums[1:])
        first = start[lo:hi] - start[lo]
        found[lo:hi] = (sums[np.minimum(following[lo:hi] - start[lo], len(own))] - sums[first]) * INVERSE[first]
    for i in np.flatnonzero(following - start >= LONG).tolist():  # a long one, or many spaces after a short one
        own = raw[start[i] : following[i]]
        own = own[: int(np.argmax(SPACE[own])) if SPACE[own].any() else len(own)]
        if len(own) >= LONG:
            found[i] = xxhash.xxh3_64_intdigest(own.tobytes())
    return mix(found)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of setCheckpointDir; without either a temporary one where Spark runs in one process, as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weir")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder, which cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/weir-{uuid.uuid4().hex}", []

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        self._delete([t.scratch_path for t in tables])

    def only(self, result: DataFrame) -> DataFrame:
        """The rows of result as a table, when all others are deleted: what an operator returns."""
        out = self.table(result)
        self._delete(self.paths[:-1])
        return out

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, width: int | F.Column = 32, most: int = 16 << 20) -> DataFrame:
    """A broadcast hint where the rows, of `width` bytes each, are shown to take at most `most` bytes; else df as it is, for a shuffled join. df should be a table, as it is read for that."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def temporary(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    end = next(i for i in range(len(taken) + 1) if not taken & {f"_{n}_{i}" for n in names})
    return [f"_{n}_{end}" for n in names]


def per_text(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType, rows: int = 256) -> DataFrame:
    """mapInArrow over df with f's columns; f gets the Arrow batches cut to `rows` rows, so that long texts don't add up.

    Spark fills batches of up to 64 MB for each task, outside of the heap and again in the worker; the session's bound is lowered to BATCH_BYTES.
    """
    if int(df.sparkSession.conf.get(BATCH_CONF).removesuffix("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
    names = schema.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, module = to_arrow_schema(schema), f.__module__

    def made(batches):
        cut = (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        for out in f(cut):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(lambda batches: tidied(module, made(batches)), schema)


class Known:
    """Numbers, from 0 on, of the 64-bit hashes that it has been given, in a table of open addresses that grows by doubling. A hash of 0 counts as 1."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        h = np.maximum(h, np.uint64(1))
        out, mask = np.full(len(h), -1, np.int64), np.uint64(len(self.keys) - 1)
        open_, slot = np.arange(len(h)), h & mask
        while len(open_):
            key = self.keys[slot]
            hit = key == h[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (key != 0)
            open_, slot = open_[more], slot[more] + np.uint64(1) & mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers new, distinct hashes in their order."""
        n = self.n + len(h)
        if 2 * n > len(self.keys):
            held = np.flatnonzero(self.keys)
            keys, values = self.keys[held], self.values[held]
            self.keys, self.values = np.zeros(1 << (2 * n).bit_length(), np.uint64), np.zeros(1 << (2 * n).bit_length(), np.int64)
            self._put(keys, values)
        self._put(np.maximum(h, np.uint64(1)), np.arange(self.n, n))
        self.n = n

    def _put(self, h: np.ndarray, value: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            own = self.keys[slot] == h
            self.values[slot[own]] = value[own]
            h, value, slot = h[~own], value[~own], slot[~own] + np.uint64(1) & mask


def word_spans(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where each word begins, and the number of words before each text, with that of all at the end."""
    raw, bounds = byte_buffer(texts)
    if lower:
        raw = LOWER[raw]
    solid = SOLID[raw]
    begun = solid.copy()
    begun[1:] &= ~solid[:-1]
    held = bounds[:-1][np.diff(bounds) > 0]
    begun[held] = solid[held]
    start = np.flatnonzero(begun)
    return raw, start, np.searchsorted(start, bounds)


def span_bytes(raw: np.ndarray, start: np.ndarray, bounds_at: np.ndarray, which: np.ndarray) -> list[bytes]:
    """The bytes of some of the words; bounds_at is where each text ends, as a word may touch the next text's first."""
    whole = raw.tobytes()
    ends = np.append(start[1:], len(raw))[which]
    limit = bounds_at[np.searchsorted(bounds_at, start[which], "right")]
    return [whole[i:j].split(None, 1)[0] for i, j in zip(start[which].tolist(), np.minimum(ends, limit).tolist(), strict=True)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte of their numbers, so that the bytes that are alike stand together."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)


def unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


#: Rows of a task where their number is known.
TASK_ROWS = 100_000


def gathered(df: DataFrame, keys: list[str], f: Callable[[pa.Table], dict], schema: T.StructType, rows: int | None = None) -> DataFrame:
    """f over the rows of each partition by keys, as one table: for what a key's few rows come to, without a sort or a hash map of Spark's. With the number of `rows`, partitions are put together to tasks of about TASK_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield f(pa.Table.from_batches(got))

    dealt = df.repartition(*keys)
    if rows is not None and (tasks := max(1, -(-rows // TASK_ROWS))) < partitions(df.sparkSession):
        dealt = dealt.coalesce(tasks)
    return per_text(dealt, run, schema, rows=1 << 30)


def unique(df: DataFrame, *names: str, rows: int | None = None) -> DataFrame:
    """The distinct rows of some columns of longs."""

    def one(t: pa.Table) -> dict:
        rows = np.unique(np.stack([t.column(n).to_numpy() for n in names], 1), axis=0) if len(names) > 1 else np.unique(t.column(names[0]).to_numpy())[:, None]
        return {n: np.ascontiguousarray(rows[:, i]) for i, n in enumerate(names)}

    return gathered(df.select(*names), list(names), one, T.StructType([T.StructField(n, T.LongType()) for n in names]), rows)


def connected(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of the long pairs (a, b); component is the least node.

    Each round hangs every node on its least neighbour in the order of a hash, so that paths shrink by a
    constant share whatever their ids; then edges are renamed, and loops and repeats go. Rounds are written to the shared folder, so a lost
    executor costs one round. A task first takes the minima of its own edges, so a node of very many has a row for each task.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    pairs = scratch.table(unique(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "a", "b"))
    hang = T.StructType([T.StructField("old", T.LongType()), T.StructField("new", T.LongType())])

    def least(old: np.ndarray, new: np.ndarray) -> dict:
        order = np.lexsort((new, mix(new.view(np.uint64)), old))
        old, new = old[order], new[order]
        first = np.flatnonzero(np.append(True, old[1:] != old[:-1])) if len(old) else order
        return {"old": old[first], "new": new[first]}

    def own(batches) -> Iterator[dict]:
        for t in batches:
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            yield least(np.concatenate([a, b]), np.concatenate([b, a]))

    def best(t: pa.Table, every: bool) -> dict:
        """Where each node hangs; with `every` also those that hang on no other, by themselves."""
        out = least(t.column("old").to_numpy(), t.column("new").to_numpy())
        x, y = (mix(out[c].view(np.uint64)) for c in ("old", "new"))
        better = y < x  # the mix is a bijection: no two nodes tie
        return {"old": out["old"], "new": np.where(better, out["new"], out["old"])} if every else {c: v[better] for c, v in out.items()}

    maps, first = [], None
    while n := pairs.count():
        first = first or n
        maps.append(scratch.table(gathered(per_text(pairs, own, hang, rows=1 << 30), ["old"], partial(best, every=not maps), hang, n)))
        for c in "ab":
            pairs = pairs.join(small(maps[-1], 16).select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        pairs = scratch.table(unique(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), "a", "b", rows=n))
    # The first map has every node once.
    found = maps[0].select(F.col("old").alias("node"), F.col("new").alias("root")) if maps else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for m in maps[1:]:
        found = found.join(small(m, 16).select(F.col("old").alias("root"), "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    found = scratch.table(found)

    def lowest(root: np.ndarray, component: np.ndarray) -> dict:
        order = np.lexsort((component, root))
        root, component = root[order], component[order]
        first = np.flatnonzero(np.append(True, root[1:] != root[:-1])) if len(root) else order
        return {"root": root[first], "component": component[first]}

    roots = T.StructType([T.StructField("root", T.LongType()), T.StructField("component", T.LongType())])
    part = per_text(found, lambda batches: (lowest(t.column("root").to_numpy(), t.column("node").to_numpy()) for t in batches), roots, rows=1 << 30)
    low = scratch.table(gathered(part, ["root"], lambda t: lowest(t.column("root").to_numpy(), t.column("component").to_numpy()), roots, 2 * (first or 0)))
    return found.join(small(low, 16), "root").select("node", "component")
