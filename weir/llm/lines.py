"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words. Each set's words are ordered from rare to frequent, by counts over all documents
(any one order gives the same result, a good one fewer pairs); two sets of Jaccard similarity 0.8 or more share a word among
the first few of each. Pairs that do pass three filters: their sizes, what the positions of the shared word leave to share, and
a bitmap of word parities, whose differing bits can't outnumber the words that differ. What is left is verified on the words
themselves. A line goes if an earlier line is similar to it. Lines stand in the order of doc_id, nulls first, and place; of
rows that share a doc_id and have other texts the lines with one number stand in the order of their sets' names.

Equal sets are one, so copies make no pairs. A set is met with a bounded number of the earlier sets of each of its words: those
of its block and the very first ones, and of those that pass the filters it is verified against a few. Sets that have found no similar
one and have not met all earlier ones are open; many of them are met with each other in the same way, and what is then still open is met
with all earlier sets. So a group of near copies costs a few pairs each, and the result is exact. The sets of a word that
is too frequent for one task are dealt to several by their names, and open ones go to each of them.

Entries travel as blocks of plain arrays, a row for each block and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import GOLDEN, Scratch, byte_buffer, cuts, gathered, is_solid, lowered, mix, partitions, pack, per_text, small, span_hashes, temporary, unique, unpack

#: Hundredths of similarity; words that a line needs to take part unless the caller says otherwise; verified partners of a set for each word in one round.
LEAST, LEAST_WORDS, FIRST = 80, 5, 2
#: A set of fewer words is similar to equal ones only, so it needs no partners.
LEAST_SET = 4
#: Where a null doc_id stands in the order.
NO_ID = -(1 << 63)
#: Entries of a word's block, and those of its very first that all meet; pairs that are held at a time.
BLOCK, HEAD, MET = 1024, 64, 1 << 19
#: Classes of an octave of counts; the entries of a word that one task should meet, and bytes of entries of a partition.
OCTAVE, SALT_ROWS, PART_BYTES = 5, 50_000, 24 << 20
#: Open sets that first meet each other; words of open sets that workers may hold to leave out the entries of others.
MANY_OPEN, MOST_WORDS = 100_000, 2_000_000
#: Lines that are sorted at a time, and a key's bits for the word itself, under 8 for its class and 10 for the line.
CHUNK, WORD_BITS = 1024, 46
ONLY_WORD = np.uint64((1 << WORD_BITS) - 1)


def _word_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, where each text begins, with the end of the last, and where each word begins."""
    raw, offsets = byte_buffer(texts)
    raw = lowered(raw)
    held = offsets[:-1][offsets[:-1] < offsets[1:]]
    solid = is_solid(raw)
    begun = solid.copy()
    begun[1:] &= ~solid[:-1]
    begun[held] = solid[held]
    return raw, offsets, np.flatnonzero(begun)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lower-cased words of the texts: their hashes, their lines counted over all texts, and of each line its text and number in it."""
    raw, offsets, start = _word_starts(texts)
    begins, ends = offsets[:-1], offsets[1:]
    held = begins[begins < ends]
    after = np.flatnonzero(raw == 10) + 1
    # A line begins with each text that isn't empty and after each line feed, even where a text ends with one.
    owner = np.concatenate([np.flatnonzero(begins < ends), np.searchsorted(ends, after - 1, "right")])
    at = np.concatenate([held, after])
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    number = np.arange(len(at)) - np.searchsorted(owner, owner)
    # Where a text ends with a line feed its last line has no words, and the next text's first line begins at the same place.
    line = np.searchsorted(at, start, "right") - 1
    if not len(start):
        return np.zeros(0, np.uint64), line, owner, number
    return span_hashes(raw, start), line, owner, number


def bucket_bits(docs: DataFrame) -> int:
    """Buckets for word counts, as a power of two: one for each 64 bytes that Spark expects of docs, from 2^16 to 2^22."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(22, max(16, (size // 64).bit_length()))


def rarity(docs: DataFrame, bits: int | None = None) -> np.ndarray:
    """The class of each bucket of words: a fifth of the binary order of its count over all documents, so in proportion to the words' own counts or above them.

    A task sends the counts of its buckets in slices of 2^16; a class is a byte, so the driver and each worker hold 4 MB at most.
    """
    bits = bits or bucket_bits(docs)
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def count(batches) -> Iterator[dict]:
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            raw, _, start = _word_starts(b.column("text"))
            np.add.at(counts, (span_hashes(raw, start) >> np.uint64(64 - bits)).view(np.int64), 1)
        for i in range(0, len(counts), 1 << 16):
            at = np.flatnonzero(own := counts[i : i + (1 << 16)])
            if len(at):
                yield {"slice": [i >> 16], "data": [pack(at.astype(np.uint16), own[at])]}

    def add(batches) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column("slice").to_pylist(), b.column("data").to_pylist(), strict=True):
                at, n = unpack(data, (np.uint16, np.int64))
                sums.setdefault(i, np.zeros(1 << 16, np.int64))[at] += n
        for i, own in sums.items():
            yield {"slice": [i], "data": [np.minimum(255, np.log2(np.maximum(own, 1)) * OCTAVE).astype(np.uint8).tobytes()]}

    counted = per_text(docs.select("text"), count, schema, rows=64)
    out = np.zeros(1 << bits, np.uint8)
    for r in per_text(counted.repartition(1 << max(0, bits - 16), "slice"), add, schema, rows=64).collect():
        out[r["slice"] << 16 : (r["slice"] + 1) << 16] = np.frombuffer(r["data"], np.uint8)
    return out


def _ordered_sets(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines' distinct keys, each line's in ascending order, and their numbers. A key has room above it for a line's number in its chunk."""
    out, counts = [], []
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(0, len(sizes), CHUNK):
        own = sizes[i : i + CHUNK]
        line = np.repeat(np.arange(len(own), dtype=np.uint64) << np.uint64(54), own)
        part = np.sort(keys[ends[i] : ends[i + len(own)]] | line)
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        part = part[new]
        counts.append(np.bincount((part >> np.uint64(54)).astype(np.int64), minlength=len(own)))
        out.append(part & np.uint64((1 << 54) - 1))
    return np.concatenate(out), np.concatenate(counts)


def _prefix(n: np.ndarray) -> np.ndarray:
    """How many of the words of a set of n words, from the rarest on, have one of each set that is similar to it."""
    return n - (n * LEAST + 99) // 100 + 1


#: Rows of documents have the name of each line's set; rows of sets have what their entries need.
OCCURS = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("name", T.LongType())]))
SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("lines", OCCURS), T.StructField("line", T.IntegerType()), T.StructField("name", T.LongType()),
    T.StructField("n", T.IntegerType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("prefix", T.ArrayType(T.IntegerType())), T.StructField("classes", T.BinaryType()),
])


def _sets(docs: DataFrame, classes: np.ndarray, least_words: int) -> DataFrame:
    """A row for each of docs with its lines of least_words words or more and their sets' names, and a row for each set of LEAST_SET words or more.

    A set's row has its size, bitmap and prefix, less the words that stand once in all documents, and the doc_id and line where the task has met it; a task that meets it again, earlier
    in the order, sends another one. A word's key is its bucket's class over 46 bits of its hash, so that keys ascend from rare to
    frequent; two words of a line are taken for one with a chance of a billionth. Verification is on 64 bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # a byte for each bucket

    def run(batches) -> Iterator[dict]:
        shift = np.uint64(64 - (len(shared.value).bit_length() - 1))
        seen: dict[int, tuple] = {}
        for b in batches:
            found, line, owner, number = _word_hashes(b.column("text"))
            sizes = np.bincount(line, minlength=len(owner))
            part = sizes >= max(1, least_words)
            none = [None] * b.num_rows
            blank = {"line": none, "name": none, "n": none, "low": none, "high": none, "prefix": none, "classes": none}
            if not part.any():
                yield {"doc_id": b.column("doc_id"), "version": b.column("version"), "lines": [[]] * b.num_rows} | blank
                continue
            if least_words > 1:  # else a line that is left out has no words
                found = found[part[line]]
            owner, number, sizes = owner[part], number[part].astype(np.int32), sizes[part]
            starts = np.searchsorted(owner, np.arange(b.num_rows + 1))
            cls = shared.value.take((found >> shift).view(np.int64)).astype(np.uint64)
            keys, n = _ordered_sets(cls << np.uint64(WORD_BITS) | found & ONLY_WORD, sizes)
            first = np.cumsum(n) - n
            mixed = mix(keys & ONLY_WORD)
            name = (mix(np.add.reduceat(mixed, first) * GOLDEN + n.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
            lines = pa.StructArray.from_arrays([pa.array(number), pa.array(name)], ["line", "name"])
            yield {"doc_id": b.column("doc_id"), "version": b.column("version"), "lines": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), lines)} | blank
            doc_id = b.column("doc_id").fill_null(NO_ID).to_numpy()[owner]
            new = np.zeros(len(name), bool)
            for i, x in enumerate(zip(name.tolist(), zip(doc_id.tolist(), number.tolist(), strict=True), (n >= LEAST_SET).tolist(), strict=True)):
                if x[2] and (x[0] not in seen or x[1] < seen[x[0]]):
                    seen[x[0]], new[i] = x[1], True
            length = np.where(new, _prefix(n), 0)
            # Words of class 0, the first of a line's, stand nowhere else.
            kept = (np.arange(len(keys)) - np.repeat(first, n) < np.repeat(length, n)) & (keys > ONLY_WORD)
            length = np.add.reduceat(kept, first, dtype=np.int64)
            if not (at := np.flatnonzero(length)).size:
                continue
            bit = np.uint64(1) << (mixed & np.uint64(63))
            upper = (mixed & np.uint64(64)) > 0
            low, high = (np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), first).view(np.int64)[at] for side in (~upper, upper))
            bounds = np.concatenate([[0], np.cumsum(length[at])])
            prefix = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((mixed[kept] >> np.uint64(33)).astype(np.int32)))
            own = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer((keys[kept] >> np.uint64(WORD_BITS)).astype(np.uint8))])
            none = [None] * len(at)
            yield {"doc_id": doc_id[at], "version": none, "lines": none, "line": number[at], "name": name[at], "n": n[at].astype(np.int32), "low": low, "high": high, "prefix": prefix, "classes": own}

    return per_text(docs, run, SETS, rows=64)


#: An entry's columns in a block: the word with its salt, the set, its size and the word's place, where it occurs first, its bitmap, and whether it is open.
ENTRY = {"token": np.uint64, "name": np.int64, "n": np.int32, "pos": np.int32, "doc_id": np.int64, "line": np.int32, "low": np.uint64, "high": np.uint64, "open": np.uint8}
ENTRY_BYTES = sum(np.dtype(k).itemsize for k in ENTRY.values())
PACKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType())])
PAIR = T.StructType([T.StructField("name", T.LongType()), T.StructField("other", T.LongType())])


def _entries(b: pa.RecordBatch, salted: bool, words: np.ndarray | None) -> dict[str, np.ndarray]:
    """The entries of rows of sets, of `words` where they are given. A frequent word's entries are dealt to salts by the sets' names; open ones go to all of them."""
    prefix = b.column("prefix")
    sizes = np.diff(prefix.offsets.to_numpy())
    row = np.repeat(np.arange(b.num_rows), sizes)
    token = prefix.flatten().to_numpy().view(np.uint32)
    cls = np.frombuffer(b"".join(b.column("classes").to_pylist()), np.uint8)
    # The words that a prefix is short of are its first ones.
    pos = np.arange(len(row)) + np.repeat(_prefix(b.column("n").to_numpy().astype(np.int64)) - np.cumsum(sizes), sizes)
    if words is not None:
        keep = np.flatnonzero(words[np.minimum(np.searchsorted(words, token), len(words) - 1)] == token)
        row, token, cls, pos = row[keep], token[keep], cls[keep], pos[keep]
    token = token.astype(np.uint64) << np.uint64(32)
    e = {c: b.column(c).to_numpy() for c in ("name", "n", "doc_id", "line", "low", "high", "open")}
    if salted and (often := 2.0 ** ((cls + 1.0) / OCTAVE) > SALT_ROWS).any():
        salts = np.where(often, np.ceil(2.0 ** ((cls + 1.0) / OCTAVE) / SALT_ROWS), 1).astype(np.int64)
        every = np.where(e["open"][row] > 0, salts, 1)
        of = np.repeat(np.arange(len(row)), every)
        salt = np.arange(len(of)) - np.repeat(np.cumsum(every) - every, every)
        own = mix(e["name"].view(np.uint64))[row][of] % salts[of].astype(np.uint64)
        # The lowest bits are the salt, from 1 on where there are several.
        token = token[of] | np.where(salts[of] > 1, np.where(every[of] > 1, salt.astype(np.uint64), own) + np.uint64(1), np.uint64(0))
        row, pos = row[of], pos[of]
    out = {c: v[row] for c, v in e.items()} | {"token": token, "pos": pos}
    return {c: out[c].view(k) if out[c].dtype.itemsize == np.dtype(k).itemsize else out[c].astype(k) for c, k in ENTRY.items()}


def _packed(sets: DataFrame, parts: int, salted: bool, words: np.ndarray | None = None) -> DataFrame:
    """(part, data): the entries of the sets in blocks, by the part that their word goes to; where `words` are given, sorted, those of others are left out."""
    shared = None if words is None else sets.sparkSession.sparkContext.broadcast(words)

    def run(batches) -> Iterator[dict]:
        held, n = [], 0

        def out() -> Iterator[dict]:
            e = {c: np.concatenate([x[c] for x in held]) for c in ENTRY}
            part = (mix(e["token"]) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            e = {c: v[order] for c, v in e.items()}
            ends = [*new[1:].tolist(), len(part)]
            for k in range(0, len(new), 128):
                own = slice(k, k + 128)
                yield {"part": part[new[own]].astype(np.int32), "data": [pack(*(e[c][i:j] for c in ENTRY)) for i, j in zip(new[own].tolist(), ends[own], strict=True)]}

        for b in batches:
            held.append(_entries(b, salted, shared and shared.value))
            n += len(held[-1]["token"])
            if n >= 400_000:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    return per_text(sets.select("name", "n", "doc_id", "line", "low", "high", "prefix", "classes", "open"), run, PACKED, rows=8192)


def _met(e: dict[str, np.ndarray], at: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the entries `at` and `earlier`, which may share enough by their sizes and places, the pairs that pass the bitmap."""
    n, m = e["n"][at], e["n"][earlier]
    differ = np.bitwise_count(e["low"][at] ^ e["low"][earlier]).astype(np.int32) + np.bitwise_count(e["high"][at] ^ e["high"][earlier])
    ok = np.flatnonzero((differ <= (n + m) * (100 - LEAST) // (100 + LEAST)) & (e["name"][at] != e["name"][earlier]))
    return at[ok], earlier[ok]


def _spans_met(e: dict[str, np.ndarray], own: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that pass the filters, of each entry of `own` and the `size` ones from `begin` on.

    Sets of n and m words need 0.8 / 1.8 of n + m in common, and from a shared word on, the first one in their order, each must have as many left.
    So `reach` of one, its own part taken off, is compared with the other's part. The sizes' ratio follows from it.
    """
    ends = np.cumsum(size)
    earlier = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
    ok = np.flatnonzero((np.repeat(e["reach"][own], size) >= e["part"].take(earlier)) & (e["reach"].take(earlier) >= np.repeat(e["part"][own], size)))
    return _met(e, own[np.searchsorted(ends, ok, "right")], earlier[ok])


def _by_token(e: dict[str, np.ndarray]) -> np.ndarray:
    """The entries in the order of token, doc_id, line and name, each set's first alone for a token, and tokens with one entry left out.

    Tasks that meet a set each bring its entries, among them those of its first line in the task. So what is left of a set stands
    at its first line of all, for every token, and the sets of a token stand in the order of `firsts`.
    """
    token, doc_id = e["token"], e["doc_id"]
    least = int(doc_id.min())
    if int(token.max()) < 1 << 32 and int(doc_id.max()) - least < 1 << 32:
        key = token << np.uint64(32) | (doc_id - least).astype(np.uint64)
        order = np.argsort(key)
        # The rest of the order is for the few that agree in both.
        key = key[order]
        tie = key[1:] == key[:-1]
        tied = np.flatnonzero(np.append(tie, False) | np.append(False, tie))
        own = order[tied]
        order[tied] = own[np.lexsort((e["name"][own], e["line"][own], key[tied]))]
    else:
        order = np.lexsort((e["name"], e["line"], doc_id, token))
    sorted_ = token[order]
    head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    size = np.diff(np.append(head, len(order)))
    order = order[np.repeat(size > 1, size)]
    own = mix(e["name"][order].view(np.uint64)) ^ mix(token[order])
    at = np.argsort(own)
    own = own[at]
    new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else at
    return order[np.sort(np.minimum.reduceat(at, new))] if len(new) < len(order) else order


def _words_of(sets: DataFrame) -> np.ndarray | None:
    """The sorted words of the sets' prefixes, or nothing where they are more than MOST_WORDS."""
    found = sets.select(F.explode("prefix").alias("token")).distinct().limit(MOST_WORDS + 1).toPandas()["token"].to_numpy(np.int32)
    return np.sort(found.view(np.uint32)) if len(found) <= MOST_WORDS else None


def _pairs(sets: DataFrame, first: int | None, parts: int, only_open: bool = False) -> DataFrame:
    """Candidate pairs (name, other), and (name, null) for a name that hasn't met all earlier sets.

    A set that a similar one precedes needs no more partners: the later sets that are similar to it meet it among theirs, as all
    tokens have one order. With `first`, a set meets the HEAD first entries of its token and the earlier ones of its block, and the first so many that pass the filters come out; else it
    meets all earlier entries, if it is marked open. About MET pairs are held at a time.
    """

    def run(batches) -> Iterator[dict]:
        got = [unpack(x, tuple(ENTRY.values())) for b in batches for x in b.column("data").to_pylist()]
        if not got:
            return
        e = dict(zip(ENTRY, (np.concatenate(x) for x in zip(*got, strict=True)), strict=True))
        del got
        # Salted words are partial; word and salt are one number of 32 bits from here on. Words that share it meet too, which changes no result.
        e["salted"] = e["token"] & np.uint64(0xFFFFFFFF)
        e["token"] = (e["token"] >> np.uint64(32)) ^ (mix(e["salted"]) >> np.uint64(32)) * (e["salted"] > 0)
        order = _by_token(e)
        e = {c: v[order] for c, v in e.items() if c not in ("doc_id", "line")}
        if not len(order):
            return
        long = np.int32 if int(e["n"].max()) < 1 << 23 else np.int64
        n = e["n"].astype(long)
        e["part"], e["reach"] = LEAST * n, (100 + LEAST) * (n - e["pos"].astype(long)) - LEAST * n
        token = e["token"]
        head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        start = np.repeat(head, np.diff(np.append(head, len(token))))
        place = np.arange(len(token)) - start
        if first:
            block = place - place % BLOCK
            front = np.minimum(block, HEAD)
            count = place - block + front
            partial = (block > HEAD) | (e["salted"] > 0)
        else:
            block = front = np.zeros(len(token), np.int64)
            count = np.where(e["open"] > 0, place, 0)
            partial = np.zeros(len(token), bool)
        if partial.any():
            names = np.unique(e["name"][partial])
            yield {"name": names, "other": pa.nulls(len(names), pa.int64())}
        live = np.flatnonzero(count)
        for lo, hi in cuts(np.cumsum(count[live]), MET):
            own = live[lo:hi]
            if len(own) == 1 and count[own[0]] > 4 * MET:  # one entry with very many before it
                for i in range(0, int(count[own[0]]), MET):
                    yield _rows(e, *_spans_met(e, own, start[own] + i, np.minimum(count[own] - i, MET)), first)
                continue
            if front[own].any():
                spans = np.repeat(own, 2), np.stack([start[own], start[own] + block[own]], 1).ravel(), np.stack([front[own], place[own] - block[own]], 1).ravel()
            else:
                spans = own, start[own] + block[own], count[own]
            at, earlier = _spans_met(e, *spans)
            if len(at):
                yield _rows(e, at, earlier, first)

    words = None if first else _words_of(sets.where("open = 1"))
    entries = _packed(sets.where("open = 1") if only_open else sets, 16 * parts, not only_open, words)
    return per_text(entries.repartition(parts, "part"), run, PAIR, rows=1 << 20)


def _rows(e: dict[str, np.ndarray], at: np.ndarray, earlier: np.ndarray, first: int | None) -> dict:
    if not len(at):
        return {"name": [], "other": []}
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    size = np.diff(np.append(new, len(at)))
    keep = np.arange(len(at)) - np.repeat(new, size) < (first or len(at))
    more = at[new[size > (first or len(at))]]
    names = np.concatenate([e["name"][at[keep]], e["name"][more]])
    other = pa.array(np.concatenate([e["name"][earlier[keep]], e["name"][more]]), mask=np.arange(len(names)) >= keep.sum())
    return {"name": names, "other": other}


FIRSTS = T.StructType([T.StructField("name", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("version", T.LongType()), T.StructField("n_lines", T.LongType())])


def _least(name: np.ndarray, doc_id: np.ndarray, line: np.ndarray, version: np.ndarray, n: np.ndarray) -> dict:
    """Of each name its least row and the sum of n."""
    order = np.lexsort((version, line, doc_id, name))
    own = name[order]
    new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else order
    at = order[new]
    return {"name": name[at], "doc_id": doc_id[at], "line": line[at], "version": version[at], "n_lines": np.add.reduceat(n[order], new) if len(new) else n}


def _firsts(table: DataFrame) -> DataFrame:
    """Where each set occurs first, and in how many lines; a task sends one row for each of its sets in some ten thousand documents, so a common one has few rows."""

    def part(batches) -> Iterator[dict]:
        for b in batches:
            lines = b.column("lines")
            flat, sizes = lines.flatten(), np.diff(lines.offsets.to_numpy())
            name, line = flat.field("name").to_numpy(), flat.field("line").to_numpy()
            doc_id, version = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("doc_id", "version"))
            yield _least(name, doc_id, line, version, np.ones(len(name), np.int64))

    rows = table.where("lines is not null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("version", F.lit(0)).alias("version"), "lines")
    return gathered(per_text(rows, part, FIRSTS, rows=1 << 30), ["name"], lambda t: _least(*(t.column(c).to_numpy() for c in FIRSTS.names)), FIRSTS)


#: One number for a row's doc_id and version, which Spark joins by faster than by two; the two are compared besides.
def _row_key(doc_id: Column, version: Column) -> Column:
    return F.xxhash64(doc_id, version)


def _words_of_sets(firsts: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, words): the hashes of all words of each set, from the line where it occurs first."""
    items = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("name", T.LongType())]))
    wanted_type = T.StructType([T.StructField("w_doc", T.LongType()), T.StructField("w_version", T.LongType()), T.StructField("lines", items)])

    def by_row(t: pa.Table) -> dict:
        doc_id, version, line, name = (t.column(c).to_numpy() for c in ("doc_id", "version", "line", "name"))
        order = np.lexsort((line, version, doc_id))
        doc_id, version = doc_id[order], version[order]
        new = np.flatnonzero(np.append(True, (doc_id[1:] != doc_id[:-1]) | (version[1:] != version[:-1])))
        lines = pa.StructArray.from_arrays([pa.array(line[order]), pa.array(name[order])], ["line", "name"])
        return {"w_doc": doc_id[new], "w_version": version[new], "lines": pa.ListArray.from_arrays(pa.array(np.append(new, len(doc_id)), pa.int32()), lines)}

    wanted = scratch.table(gathered(firsts.select("doc_id", "version", "line", "name"), ["doc_id", "version"], by_row, wanted_type))
    doc_id = F.coalesce(docs["doc_id"], F.lit(NO_ID))
    wanted = small(wanted.withColumn("w_key", _row_key(F.col("w_doc"), F.col("w_version"))), 40 + 12 * F.size("lines"))
    texts = docs.join(wanted, (_row_key(doc_id, docs["version"]) == F.col("w_key")) & (doc_id == F.col("w_doc")) & (docs["version"] == F.col("w_version"))).select("text", "lines")
    schema = T.StructType([T.StructField("name", T.LongType()), T.StructField("words", T.BinaryType())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            names, lines = [], []
            for text, own in zip(b.column("text").to_pylist(), b.column("lines").to_pylist(), strict=True):
                split = (text or "").split("\n")
                names += [x["name"] for x in own]
                lines += [split[x["line"]] for x in own]
            found, line, owner, _ = _word_hashes(pa.array(lines, pa.string()))
            ends = np.searchsorted(owner[line], np.arange(len(lines) + 1))
            yield {"name": names, "words": [np.unique(found[i:j]).tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]}

    # Rows that agree in doc_id and text each give their sets.
    return per_text(texts, run, schema).dropDuplicates(["name"])


def _late(near: DataFrame, firsts: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(name): the sets that another of the pairs (name, other) precedes and is similar to, judged on all words. firsts has the pairs' sets and no others."""
    sets = scratch.table(_words_of_sets(firsts, docs, scratch))
    side = lambda key, a, words: (firsts.select(F.col("name").alias(key), F.struct("doc_id", "line").alias(a)), sets.select(F.col("name").alias(key), F.col("words").alias(words)))
    pairs = near
    for key, order, words in (("name", "x", "a"), ("other", "y", "b")):
        first, own = side(key, order, words)
        pairs = pairs.join(small(first, 24), key).join(own, key)

    def check(batches) -> Iterator[dict]:
        for t in batches:
            a, b = (t.column(c).to_pylist() for c in "ab")
            n, m = (np.array([len(x) // 8 for x in side]) for side in (a, b))
            # A word that both sets of a pair have comes twice with the pair's number.
            pair = np.repeat(np.tile(np.arange(len(a)), 2), np.concatenate([n, m]))
            key = mix(np.frombuffer(b"".join(a + b), np.uint64) + (pair.astype(np.uint64) + np.uint64(1)) * GOLDEN)
            order = np.argsort(key)
            twice = key[order[1:]] == key[order[:-1]]
            common = np.bincount(pair[order[1:][twice]], minlength=len(a))
            at = np.flatnonzero(100 * common >= LEAST * (n + m - common))
            name, other = (t.column(c).to_numpy()[at] for c in ("name", "other"))
            earlier = t.column("earlier").to_numpy(zero_copy_only=False)[at]
            yield {"name": np.where(earlier, other, name)}

    earlier = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("name") < F.col("other")))
    out = per_text(pairs.select("name", "other", earlier.alias("earlier"), "a", "b"), check, T.StructType([T.StructField("name", T.LongType())]), rows=1024)
    return unique(out, "name")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, version, removed) for the rows of docs that lose lines: version tells rows with one doc_id by their text.

    Lines are parted by line feeds and counted from 0. Lines of fewer than least_words words stay, and those without words. Null doc_ids come first in
    the order; rows that agree in doc_id and text are one row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keyed = _keyed(docs)
    table = scratch.table(_sets(keyed, rarity(docs), least_words))
    firsts = scratch.table(_firsts(table))
    sets = table.where("prefix is not null").select("name", "doc_id", "line", "n", "low", "high", "prefix", "classes")
    sizes = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(partitions(spark), -(-sizes * ENTRY_BYTES // PART_BYTES))

    def met(which: DataFrame, first: int | None, only_open: bool, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The sets that are late by the pairs of this round, and those that it leaves open."""
        pairs = scratch.table(_pairs(which, first, parts, only_open))
        # A pair comes from several words; one row is enough from here on, and of firsts the rows of the pairs' sets.
        near = scratch.table(unique(pairs.where("other is not null").select(F.least("name", "other").alias("name"), F.greatest("name", "other").alias("other")), "name", "other"))
        few = scratch.table(firsts.join(small(near.select("name").union(near.select("other")), 8), "name", "left_semi"))
        late = scratch.table(_late(near, few, keyed, scratch))
        late = late if known is None else scratch.table(unique(known.union(late), "name"))
        return late, scratch.table(unique(pairs.where("other is null"), "name").join(small(late, 8), "name", "left_anti"))

    late, open_ = met(sets.withColumn("open", F.lit(0).cast("tinyint")), FIRST, False, None)
    for first, only_open in ((FIRST, True), (None, False)):
        if not (n := open_.count()):
            break
        if only_open and n <= MANY_OPEN:
            continue
        marked = sets.join(small(open_, 16).withColumn("open", F.lit(1).cast("tinyint")), "name", "left").withColumn("open", F.coalesce("open", F.lit(0).cast("tinyint")))
        # The first of these rounds only makes fewer sets open: none has met all earlier ones yet.
        late, rest = met(marked, first, only_open, late)
        open_ = scratch.table(open_.join(small(late, 8), "name", "left_anti")) if only_open else rest
    marked = firsts.join(small(late, 8).withColumn("gone", F.lit(True)), "name", "left").where("gone or n_lines > 1")
    marked = scratch.table(marked.select("name", F.col("doc_id").alias("f_doc"), F.col("line").alias("f_line"), F.col("version").alias("f_version"), "n_lines", F.coalesce("gone", F.lit(False)).alias("gone")))
    occurs = table.where("lines is not null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("version", F.lit(0)).alias("version"), F.explode("lines").alias("x")).select("doc_id", "version", "x.line", "x.name")
    lost = _marked_lines(occurs, marked).where("gone or doc_id <> f_doc or line <> f_line or version <> f_version").select("doc_id", "version", "line")

    def by_row(t: pa.Table) -> dict:
        rows = np.unique(np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "version", "line")], 1), axis=0)
        new = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
        own = pa.array(np.ascontiguousarray(rows[new, 0]), mask=rows[new, 0] == NO_ID)
        return {"doc_id": own, "version": np.ascontiguousarray(rows[new, 1]), "removed": pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)), pa.int32()), pa.array(rows[:, 2].astype(np.int32)))}

    return scratch.only(gathered(lost, ["doc_id", "version"], by_row, REMOVED))


REMOVED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])


def _marked_lines(occurs: DataFrame, marked: DataFrame, often: int = 100_000) -> DataFrame:
    """The lines whose sets are marked. A set with more than one in `often` of the marked lines goes by a broadcast, of fewer than `often` rows, so no task of the other join gets a hot one."""
    total = marked.agg(F.sum("n_lines")).first()[0] or 0
    hot = F.col("n_lines") * often > total
    if total <= often:
        return occurs.join(F.broadcast(marked), "name")
    few = F.broadcast(marked.where(hot))
    return occurs.join(few, "name").unionByName(occurs.join(few.select("name"), "name", "left_anti").join(small(marked.where(~hot), 40), "name"))


def _cleaned(text: Column, removed: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i)), "\n")


def _with_removed(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, str]:
    """docs with the name of a further column: the lines that a row loses, null where there are none."""
    g_key, g_doc, g_version, own = temporary(docs, "key", "doc_id", "version", "removed")
    doc_id = lambda c: F.coalesce(c.cast("long"), F.lit(NO_ID))
    gone = gone.select(_row_key(doc_id(F.col("doc_id")), F.col("version")).alias(g_key), doc_id(F.col("doc_id")).alias(g_doc), F.col("version").alias(g_version), F.col("removed").alias(own))
    version = F.xxhash64(docs["text"])
    on = (_row_key(doc_id(docs["doc_id"]), version) == F.col(g_key)) & (doc_id(docs["doc_id"]) == F.col(g_doc)) & (version == F.col(g_version))
    return docs.join(small(gone, 40 + 4 * F.size(own)), on, "left").drop(g_key, g_doc, g_version), own


def deduped(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_removed, removed_lines (joined by commas) and kept_sha256.

    kept_sha256 is of the text less those lines, UTF-8. A null text has no lines and counts as empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined, own = _with_removed(docs, removed_lines(docs, least_words))
    removed, text = F.col(own), F.coalesce("text", F.lit(""))
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))  # a split makes a string of each line
    return joined.select(
        "doc_id", F.when(text != "", feeds + 1).otherwise(0).cast("long").alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(removed.cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
        F.sha2(F.when(removed.isNull(), text).otherwise(_cleaned(text, removed)).cast("binary"), 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs with their columns, less the removed lines; n_chars, where there is one, is counted again.

    Rows that lose all their words go; rows without any, null texts included, stay as they are, and so do rows that repeat. Extra columns may have any names.
    """
    joined, own = _with_removed(docs, removed_lines(docs, least_words))
    removed = F.col(own)
    out = joined.withColumn("text", F.when(removed.isNull(), F.col("text")).otherwise(_cleaned(F.col("text"), removed)))
    out = out.where(removed.isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


#: Of deduped with least_words=1, for tables whose doc_ids don't repeat.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
ln AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d WHERE text <> ''),
st AS MATERIALIZED (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s FROM ln),
u AS MATERIALIZED (SELECT s, len(s) AS n, min((doc_id, i)) AS f, row_number() OVER () AS k FROM st WHERE len(s) > 0 GROUP BY s),
w AS MATERIALIZED (SELECT k, n, f, unnest(s) AS t FROM u),
c AS (SELECT t, count(*) AS c FROM w GROUP BY t),
pre AS MATERIALIZED (SELECT k, n, f, hash(t) AS t FROM (SELECT w.k, w.n, w.f, w.t, row_number() OVER (PARTITION BY w.k ORDER BY c.c, w.t) AS pos FROM w JOIN c ON c.t = w.t) WHERE pos <= n - (n * 80 + 99) // 100 + 1),
p AS (SELECT DISTINCT a.k AS a, b.k AS b FROM pre a JOIN pre b ON a.t = b.t AND a.f < b.f AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
late AS MATERIALIZED (SELECT DISTINCT p.b AS k FROM p JOIN u x ON x.k = p.a JOIN u y ON y.k = p.b WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
gone AS MATERIALIZED (SELECT st.doc_id, st.i FROM st JOIN u ON u.s = st.s LEFT JOIN late ON late.k = u.k WHERE late.k IS NOT NULL OR (st.doc_id, st.i) <> u.f),
g AS (SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS r FROM gone GROUP BY doc_id),
kept AS (SELECT ln.doc_id, string_agg(line, chr(10) ORDER BY ln.i) AS text FROM ln ANTI JOIN gone ON gone.doc_id = ln.doc_id AND gone.i = ln.i GROUP BY ln.doc_id)
SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.r, '') AS removed_lines, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
