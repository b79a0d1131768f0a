"""Documents with 5-word shingle sets of Jaccard similarity 0.8 or more, and their connected components.

The candidate search is exact. Sets fall into bands by size; two similar sets lie in one band or in neighbouring ones, and the
smaller set's band bounds their symmetric difference by h. A hash deals the universe of shingles into m segments. By the
pigeonhole principle at least m - h segments of two similar sets are equal. An empty segment says nothing, so the cost model of a
band sets m so that m - h exceeds the empty segments of nearly all its sets: then one set of a pair suffices, since some equal
segment isn't empty, and each set is indexed by a signature of each of its other segments (one unit of allocation). A set with
more empty segments gets two units for each segment of two shingles or more: its signature and those of its one-deletion
neighbourhood, and where even that falls short of h + 1 units, also its empty segments.

Of sets with a signature in common, those stay together whose sizes and parity bits allow it; what they connect is a candidate
group. A group is verified in blocks of bounded size: blocks with themselves first, then one set of each class, then blocks of different classes whose sizes can
match. A task gets the shingle sets of one pair of blocks. It counts exact
intersections and gives back a spanning forest of the links it finds, so the rows grow with the sets and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import Scratch, connected, gathered, mix, pack, partitions, per_text, small, span_hashes, temporary, unique, unpack, word_spans

#: Words of a shingle, least similarity in hundredths, sets of a block.
WIDTH, LEAST, BLOCK = 5, 80, 256


#: Odd multipliers of a shingle's words by place.
PLACES = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def many_shingles(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles; a shorter text is one shingle, an empty or null one has none."""
    raw, start, ends = word_spans(texts, lower=True)
    h = span_hashes(raw, start)
    full = max(0, len(h) - WIDTH + 1)
    rolled = np.full(full, WIDTH, np.uint64)
    for k in range(WIDTH):
        rolled += h[k : full + k] * PLACES[k]
    rolled = mix(rolled)
    out = []
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = end - begin
        if n >= WIDTH:
            out.append(_distinct(rolled[begin : end - WIDTH + 1]))
        else:
            out.append(mix((h[begin:end] * PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def difference(small_size: int, large_size: int) -> int:
    """The largest symmetric difference of two similar sets: the union is at most 100/180 of the sum of the sizes."""
    return (small_size + large_size) * (100 - LEAST) // (100 + LEAST)


@lru_cache
def bands(up_to: int) -> list[tuple[int, int]]:
    """(least, greatest size) of the bands; each reaches as far as a set may be from its least one."""
    out, low = [], 1
    while low <= up_to:
        out.append((low, high := low * 100 // LEAST))
        low = high + 1
    return out


@lru_cache
def scheme(low: int, high: int) -> tuple[int, int]:
    """(m, h) of a band: the number of segments with the least expected number of signatures.

    A set of the band's size has binomially many empty segments. One more segment costs a signature; a set with more than
    m - h - 1 empty ones costs its deletions, about one for each shingle.
    """
    h = difference(high, high * 100 // LEAST)
    size = (low + high) / 2

    def cost(m: int) -> float:
        empty = (1 - 1 / m) ** size
        spare = m - h - 1
        over = 1 - sum(comb(m, k) * empty**k * (1 - empty) ** (m - k) for k in range(spare + 1)) if m * empty < 50 and m < 1000 else float(m * empty > spare - 3 * (m * empty) ** 0.5)
        return m + max(0.0, over) * size * 2

    best = min(range(h + 1, h + 2 + max(8, h // 2)), key=cost)
    return best, h


def signatures(s: np.ndarray) -> np.ndarray:
    """The index entries of a set, in its own band's scheme and in the next lower one's where a smaller match can lie."""
    n = len(s)
    all_bands = bands(max(n, 1))
    own = len(all_bands) - 1
    out = []
    for k in (own, own - 1):
        if k < 0 or all_bands[k][1] * 100 < LEAST * n:
            continue
        m, h = scheme(*all_bands[k])
        if h == 0:
            continue  # only equal sets are similar, and those are one
        # The upper half of a shingle's hash deals it to a segment, so sorted hashes lie segment by segment.
        mixed = np.sort(mix(s ^ np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
        at = (mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        segment = at[starts]
        base = mix(np.uint64(k << 32) + segment)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mixed, starts)
            out.append(mix(total + base))
            if m - len(segment) > m - h - 1:
                sizes = np.diff(np.append(starts, n))
                of = np.repeat(np.arange(len(starts)), sizes)
                rich = sizes[of] > 1
                out.append(mix(total[of][rich] - mixed[rich] + base[of][rich]))
                if int((sizes > 1).sum() * 2 + (sizes == 1).sum()) < h + 1:
                    empty = np.setdiff1d(np.arange(m), segment.astype(np.int64))
                    out.append(mix(mix(np.uint64(k << 32) + empty.astype(np.uint64))))
    return _distinct(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    """A 63-bit name of a set: equal sets have one name. The empty set is 0."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))], np.uint64))[0] >> np.uint64(1)) | 1


def parities(s: np.ndarray) -> bytes:
    """Whether each of a row of cells gets an odd number of the set's hashes: twice as many cells as shingles, at least 512.

    Differing bits can't outnumber differing shingles. Cells are a power of two, so that a longer row folds to a shorter one.
    """
    cells = 1 << max(9, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s % np.uint64(cells)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("name", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("entries", T.ArrayType(T.LongType()))])


def _sets(docs: DataFrame) -> DataFrame:
    """Per document its set's size and name; bits and entries come with the first document of a task that has the set."""

    def run(batches) -> Iterator[dict]:
        seen: set[int] = set()
        for b in batches:
            sizes, names, bits, entries = [], [], [], []
            for s in many_shingles(b.column("text")):
                name = fingerprint(s)
                new = name not in seen and len(s) > 0
                seen.add(name)
                sizes.append(len(s)), names.append(name)
                bits.append(parities(s) if new else None)
                entries.append(signatures(s).view(np.int64) if new else None)
            yield {"doc_id": b.column("doc_id"), "version": b.column("version"), "n_shingles": sizes, "name": names, "bits": bits, "entries": entries}

    return per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text"), run, SETS)


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Names that share an entry and are paired at once; more of them are compared where their bits are at hand.
FEW = 8


#: Names that share an entry and are compared with each other where their bits are at hand; more of them go to verification as one group.
MANY = 512
#: An entry as it travels: 48 bits of the signature, which part it is in adds to them, and the name. Bytes of entries of a partition.
ENTRY, PART_BYTES = (np.uint32, np.uint16, np.int64), 24 << 20


def _packed(entries: DataFrame, parts: int) -> DataFrame:
    """(part, data): the entries of sets (name, entries) in blocks, by the part that their signature goes to."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches) -> Iterator[dict]:
        held, n = [], 0

        def out() -> Iterator[dict]:
            sig, name = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (sig >> np.uint64(48)).astype(np.uint32) * np.uint32(parts) >> np.uint32(16)
            order = np.argsort(part.astype(np.uint16), kind="stable")
            part, sig, name = part[order], sig[order], name[order]
            new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = [*new[1:].tolist(), len(part)]
            low, high = sig.astype(np.uint32), (sig >> np.uint64(32)).astype(np.uint16)
            for k in range(0, len(new), 128):
                own = slice(k, k + 128)
                yield {"part": part[new[own]].astype(np.int32), "data": [pack(low[i:j], high[i:j], name[i:j]) for i, j in zip(new[own].tolist(), ends[own], strict=True)]}

        for b in batches:
            own = b.column("entries")
            held.append((own.flatten().to_numpy().view(np.uint64), np.repeat(b.column("name").to_numpy(), np.diff(own.offsets.to_numpy()))))
            n += len(held[-1][0])
            if n >= 1_000_000:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    return per_text(entries, run, schema, rows=4096)


def _sharing(entries: DataFrame) -> DataFrame:
    """Names that share an entry of sets (name, entries): all pairs (a, b) of up to FEW, rows (a, group as b, many) of each of up to MANY, and of more a chain of pairs that is marked sure.

    A partition's entries are two plain arrays. A set's copies in one task have sent its entries once. A chain puts its sets into one group, which
    verification compares in full; so a signature that very many sets have costs a row for each.
    """
    schema = T.StructType([*PAIR.fields, T.StructField("kind", T.IntegerType())])
    total = entries.agg(F.sum(F.size("entries"))).first()[0] or 0
    tasks = max(partitions(entries.sparkSession), -(-total * 16 // PART_BYTES))
    parts = min(1 << 14, 16 * tasks)

    def run(batches):
        got = [(part, x) for b in batches for part, x in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True)]
        if not got:
            return
        sigs, names = [], []
        for part, x in got:
            low, high, name = unpack(x, ENTRY)
            # Parts that met in this task stay apart.
            sigs.append(np.uint64(part) << np.uint64(48) | high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64))
            names.append(name)
        sig, name = np.concatenate(sigs), np.concatenate(names)
        del got, sigs, names
        order = np.argsort(sig)
        sig, name = sig[order], name[order]
        same = sig[1:] == sig[:-1]
        shared = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        sig, name = sig[shared], name[shared]
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        if not len(sig):
            return
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])])
        sig, name = sig[new], name[new]
        head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(head, len(sig)))
        of = np.repeat(size, size)
        few, found = of <= FEW, []
        for k in range(1, FEW):
            at = np.flatnonzero((sig[k:] == sig[:-k]) & few[k:])
            found.append(np.stack([name[at], name[at + k]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        some = ~few & (of <= MANY)
        chain = np.flatnonzero((of[1:] > MANY) & (sig[1:] == sig[:-1]))
        for rows, kind in ((pairs, 0), (np.stack([name[some], sig[some].view(np.int64)], 1), 1), (np.stack([name[chain], name[chain + 1]], 1), 2)):
            for i in range(0, len(rows), 100_000):
                part = rows[i : i + 100_000]
                yield {"a": np.ascontiguousarray(part[:, 0]), "b": np.ascontiguousarray(part[:, 1]), "kind": np.full(len(part), kind, np.int32)}

    return per_text(_packed(entries, parts).repartition(tasks, "part"), run, schema, rows=1 << 20)


def _possible(n: np.ndarray, m: np.ndarray, bits: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m with those parities may be similar."""
    differ = np.bitwise_count(bits ^ more).sum(-1, dtype=np.int64)
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * LEAST) & (differ <= (n + m) * (100 - LEAST) // (100 + LEAST))


def _fold(bits: bytes, size: int) -> np.ndarray:
    """A row of parities folded to `size` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _candidates(shared: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all that may be similar: size and parities have left them. known: name, n and bits."""
    pairs = unique(shared.where("kind = 0"), "a", "b")
    pairs = pairs.join(known.select(F.col("name").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("x")), "a")
    pairs = pairs.join(known.select(F.col("name").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y")), "b")

    def check(batches) -> Iterator[dict]:
        for t in batches:
            n, m = t.column("n1").to_numpy(), t.column("n2").to_numpy()
            x, y = t.column("x").to_pylist(), t.column("y").to_pylist()
            size = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)])
            ok = np.zeros(len(n), bool)
            for cells in np.unique(size).tolist():
                at = np.flatnonzero(size == cells)
                ok[at] = _possible(n[at], m[at], np.stack([_fold(x[i], cells) for i in at]), np.stack([_fold(y[i], cells) for i in at]))
            yield {"a": t.column("a").filter(pa.array(ok)), "b": t.column("b").filter(pa.array(ok))}

    few = per_text(pairs, check, PAIR, rows=2048)
    many = shared.where("kind = 1").select(F.col("a").alias("name"), F.col("b").alias("sig")).join(known, "name")

    def forest(key: tuple, t: pa.Table) -> pa.Table:
        """A spanning forest of the possible pairs of a signature's sets; each set meets those that it isn't yet connected with."""
        del key
        name, n, rows = t.column("name").to_numpy(), t.column("n").to_numpy(), t.column("bits").to_pylist()
        cells = min(map(len, rows))
        bits = np.stack([_fold(r, cells) for r in rows])
        label = np.arange(len(name))
        out = []
        for i in range(len(name)):
            others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            for j in others[_possible(n[i], n[others], bits[i], bits[others])].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((name[i], name[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return few.union(many.groupBy("sig").applyInArrow(forest, PAIR)).union(shared.where("kind = 2").select("a", "b"))


def links(names: list[int], sets: list[np.ndarray], left: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs between the sets marked `left` and the others, or among all where none is.

    Intersections of a set with all others are counted at once, over the shingles that two sets or more have.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    token, where = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(where) > 1
    keep = often[where]
    owner, where = owner[keep], where[keep]
    order = np.argsort(where, kind="stable")
    holders = owner[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(token)))])
    by_owner = np.split(where, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    among = not left.any() or left.all()
    for i in range(len(sets)):
        if not len(by_owner[i]) or not (among or left[i]):
            continue
        lo, n = first[by_owner[i]], first[by_owner[i] + 1] - first[by_owner[i]]
        span = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        common = np.bincount(holders[span], minlength=len(sets))
        match = 100 * common >= LEAST * (sizes[i] + sizes - common)
        match &= (np.arange(len(sets)) > i) if among else ~left
        for j in np.flatnonzero(match).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((names[i], names[j]))
    return out


def _units(ranked: DataFrame, pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the pairs of blocks (component, block, block2), where ranked has the blocks' sets (name, component, block, doc_id)."""
    unit = F.xxhash64("component", "block", "block2").alias("unit")
    parts = pairs.select("component", "block", unit, F.lit(True).alias("left"))
    parts = parts.union(pairs.where("block <> block2").select("component", F.col("block2").alias("block"), unit, F.lit(False).alias("left")))
    members = scratch.table(ranked.join(parts, ["component", "block"]).select("unit", "left", "name", "doc_id"))
    # A document's set is made once, from its whole text, then goes to the units that its block is in.
    wanted = scratch.table(unique(members, "doc_id", "name", rows=members.count()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted, 16), "doc_id").select("name", "text")
    schema = T.StructType([T.StructField("name", T.LongType()), T.StructField("set", T.BinaryType())])

    def make(batches) -> Iterator[dict]:
        for b in batches:
            sets = many_shingles(b.column("text"))
            same = [i for i, (s, n) in enumerate(zip(sets, b.column("name").to_pylist(), strict=True)) if fingerprint(s) == n]
            yield {"name": b.column("name").take(pa.array(same, pa.int64())), "set": [sets[i].tobytes() for i in same]}

    full = members.select("unit", "left", "name").join(per_text(texts, make, schema), "name")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        del key
        t = t.group_by(["name", "left"]).aggregate([("set", "min")])
        names = t.column("name").to_pylist()
        found = links(names, [np.frombuffer(x, np.uint64) for x in t.column("set_min").to_pylist()], t.column("left").to_numpy(zero_copy_only=False).astype(bool))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return full.groupBy("unit").applyInArrow(run, PAIR)


def _verified(groups: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect the candidate groups (name, component, n, doc_id) as all links would; doc_id is one document that has the set.

    A group of up to BLOCK sets is one block, compared in full. In a larger one each block is first compared with itself, which finds most links of a group of near copies; then one set of each class that this leaves,
    in blocks again; and at last the blocks of different classes whose sizes allow it, where the sets of a class stand together. Sets of one class are never compared again, so a group
    costs what its classes cost, not the square of its sets.
    """
    def blocks(sets: DataFrame) -> DataFrame:
        """The sets with a block of about BLOCK of their component and slice, by a hash of their names: no task ranks a group."""
        sets = scratch.table(sets)
        per = scratch.table(sets.groupBy("component", "slice").agg(F.count("*").alias("own_slice")))
        ranked = sets.join(small(per, 24), ["component", "slice"])
        return scratch.table(ranked.withColumn("block", F.xxhash64("slice", F.pmod(F.xxhash64("name"), F.ceil(F.col("own_slice") / BLOCK)))).drop("own_slice"))

    def itself(ranked: DataFrame) -> DataFrame:
        some = ranked.groupBy("component", "block").agg(F.count("*").alias("rows")).where("rows > 1").select("component", "block", F.col("block").alias("block2"))
        return scratch.table(_units(ranked, some, docs, scratch))

    sizes = scratch.table(groups.groupBy("component").agg(F.count("*").alias("sets")))
    all_ = scratch.table(groups.join(small(sizes, 16), "component").withColumn("slice", F.lit(0).cast("bigint")))
    found = itself(blocks(all_))
    large = all_.where(F.col("sets") > BLOCK)
    if large.isEmpty():
        return found

    def classed(links: DataFrame) -> DataFrame:
        of = connected(links, scratch).select(F.col("node").alias("name"), F.col("component").alias("class"))
        return scratch.table(large.join(of, "name", "left").withColumn("class", F.coalesce("class", "name")))

    known = classed(found)
    one = known.groupBy("component", "class").agg(F.min("name").alias("name"))
    one = scratch.table(itself(blocks(known.join(one.select("name"), "name"))))
    if not one.isEmpty():
        found = scratch.table(found.union(one))
        known = classed(found)
    many = known.groupBy("component").agg(F.count_distinct("class").alias("classes")).where("classes > 1").select("component")
    rest = known.join(many, "component", "left_semi")
    if rest.isEmpty():
        return found
    # Sets of one class stand together, by size; sets of classes of their own by size too.
    alone = rest.groupBy("component", "class").agg(F.count("*").alias("own"))
    rest = rest.join(alone, ["component", "class"]).withColumn("slice", F.when(F.col("own") >= BLOCK, F.col("class")).otherwise(F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05))).cast("bigint")))
    ranked = blocks(rest)
    each = scratch.table(ranked.groupBy("component", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("class").alias("c1"), F.max("class").alias("c2"), F.count("*").alias("rows")))
    other = each.select("component", *(F.col(c).alias(f"{c}_2") for c in ("block", "least", "most", "c1", "c2")))
    pairs = each.join(other, "component").where((F.col("block") <= F.col("block_2")) & (F.col("most") * 100 >= LEAST * F.col("least_2")) & (F.col("most_2") * 100 >= LEAST * F.col("least")))
    # Two blocks of one class, or one block of it, have nothing to find.
    pairs = pairs.where(~((F.col("c1") == F.col("c2")) & (F.col("c1_2") == F.col("c2_2")) & (F.col("c1") == F.col("c1_2"))))
    pairs = scratch.table(pairs.select("component", "block", F.col("block_2").alias("block2")))
    return found.union(_units(ranked, pairs, docs, scratch))


NAMES = T.StructType([T.StructField("name", T.LongType()), T.StructField("least", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])


def _names(known: DataFrame) -> DataFrame:
    """(name, least, n, bits) of each set that isn't empty: its least doc_id, its size and its parities. A task sends a row for each of its sets in some thousand documents."""

    def one(t: pa.Table | pa.RecordBatch, least: str, size: str) -> dict:
        name, bits = t.column("name").to_numpy(), t.column("bits")
        bits = bits.combine_chunks() if isinstance(bits, pa.ChunkedArray) else bits
        doc_id = t.column(least)
        missing = doc_id.is_null().to_numpy(zero_copy_only=False) if isinstance(doc_id, pa.Array) else doc_id.combine_chunks().is_null().to_numpy(zero_copy_only=False)
        doc_id = doc_id.fill_null(0).to_numpy()
        order = np.lexsort((doc_id, missing, name))
        own = name[order]
        first = order[np.append(True, own[1:] != own[:-1])] if len(own) else order
        held = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))
        with_bits, at = np.unique(name[held], return_index=True)
        where = np.searchsorted(with_bits, name[first])
        there = (where < len(with_bits)) & (with_bits[np.minimum(where, len(with_bits) - 1)] == name[first]) if len(with_bits) else np.zeros(len(first), bool)
        take = pa.array(held[at][np.where(there, where, 0)] if len(with_bits) else np.zeros(len(first), np.int64), mask=~there)
        return {"name": name[first], "least": pa.array(doc_id[first], mask=missing[first]), "n": t.column(size).to_numpy()[first], "bits": bits.take(take)}

    rows = known.where("name <> 0").select("name", "doc_id", "n_shingles", "bits")
    part = per_text(rows, lambda batches: (one(b, "doc_id", "n_shingles") for b in batches), NAMES, rows=1 << 30)
    return gathered(part, ["name"], lambda t: one(t, "least", "n"), NAMES)


def _classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, n_shingles, name) of the rows of docs, and (name, least, class) of the sets: the least doc_id that has it, and the component by one of its names."""
    known = scratch.table(_sets(docs))
    shared = scratch.table(_sharing(known.where("entries is not null").select("name", "entries")))
    members = scratch.table(known.select("doc_id", "version", "n_shingles", "name"))
    names = scratch.table(_names(known))
    scratch.drop(known)
    near = scratch.table(_candidates(shared, names.select("name", "n", "bits")))
    scratch.drop(shared)
    groups = connected(near, scratch).withColumnRenamed("node", "name").join(names.where("least is not null").select("name", "n", F.col("least").alias("doc_id")), "name")
    found = scratch.table(_verified(groups, docs, scratch))
    return members, names.join(connected(found, scratch).withColumnRenamed("node", "name"), "name", "left").select("name", "least", F.coalesce("component", "name").alias("class"))


def components(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles and component_id.

    Equal sets are one node, so copies cost a row each and no pairs. A document without words has no links and its own id. A
    null doc_id stays null, and its component is that of others with an equal set; a set that only null ids have links nothing. Rows that repeat a doc_id with other texts are nodes of
    their own with a common id; each comes back. Very long texts are whole: a set's memory is eight bytes for each word.
    """
    scratch = Scratch(docs.sparkSession)
    members, classes = _classes(docs, scratch)
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    of = classes.join(least, "class").select("name", "component_id")
    return scratch.only(members.join(of, "name", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, with its columns, of each component: that with the least doc_id, of several with it the least by a hash of the text. Rows without words all stay.

    A row without an id goes where its component has one with an id. Of rows that agree in doc_id and text one stays. Extra columns may have any
    names. The texts don't move unless there are more rows to drop than a broadcast may hold, or rows that repeat.
    """
    scratch = Scratch(docs.sparkSession)
    members, classes = _classes(docs, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    rows = scratch.table(members.where("name <> 0").join(classes.select("name", "class"), "name").select("class", order.alias("row")))
    kept = rows.groupBy("class").agg(F.min("row").alias("kept"))
    keys = rows.groupBy("class", "row").agg(F.count("*").alias("many")).join(kept, "class").select("row.doc_id", "row.version", (F.col("row") == F.col("kept")).alias("kept"), "many")
    k_doc, k_version = temporary(docs, "doc_id", "version")
    keys = scratch.only(keys.where("not kept or many > 1").select(F.col("doc_id").alias(k_doc), F.col("version").alias(k_version), "kept"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(k_doc)) & (F.xxhash64(docs["text"]) == F.col(k_version))
    out = docs.join(small(keys, 24), on, "left_anti")
    many = keys.where("kept").drop("kept")
    if many.isEmpty():
        return out
    d, v = temporary(docs, "d", "v")
    again = docs.join(small(many, 24), on, "left_semi").withColumns({d: docs["doc_id"].cast("long"), v: F.xxhash64(docs["text"])}).dropDuplicates([d, v])
    return out.union(again.drop(d, v))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id
"""
