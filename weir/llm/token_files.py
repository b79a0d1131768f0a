"""Token-id files: raw ids with a minimal perfect hash from document keys to their places.

A file is a row of a table in the shared folder, so that any store that Spark reads will do. It holds neighbouring documents
of one range, in ascending doc_id order, up to a number of bytes:

    magic "WEIRIDS2" | u32 rows | u32 keys | u32 null rows | u32 bytes of an id | u64 ids of the range before this file
    | u32 levels | u32 bits of each level | u32 leftover keys | level bits, packed | leftover keys u64
    | fingerprint u32 of each slot | first row u32 of each slot | doc_id i64 of each row | u32 ids before each row, and all
    | ids

The hash: on each level the keys that are left go to twice as many positions; a key alone in its place has its bit set and
the others go on. A key's slot is the number of set bits before its own. A lookup touches two levels on average whatever the
number of keys; the fingerprint tells keys that are not in the file. Which file may hold a key is told by the files' first
keys, a few bytes for each file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from weir.llm.common import GOLDEN, LOWER, SPACE, Known, Scratch, byte_buffer, kept, mix, partitions, per_text, span_hashes

MAGIC, HEAD = b"WEIRIDS2", struct.Struct("<8sIIIIQI")
LEVELS = 32


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(level * int(GOLDEN) & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left
        self.base = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.before = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Over distinct u64 keys."""
        levels = []
        while len(keys) and len(levels) < LEVELS:
            at = _place(keys, len(levels), bits := max(8, 2 * len(keys)))
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = _place(keys[open_], k, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.base[k] + self.before[k][at[hit]]
            open_ = open_[~hit]
        if len(self.left) and len(open_):
            i = np.minimum(np.searchsorted(self.left, keys[open_]), len(self.left) - 1)
            hit = self.left[i] == keys[open_]
            out[open_[hit]] = self.base[-1] + i[hit]
        return out


def pack(rows: np.ndarray, nulls: int, sizes: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """A file; the rows' doc_ids ascend after the null ones, whose number is given; sizes are those of the rows' ids."""
    rows = rows.astype("<i8")
    keys, first = np.unique(rows[nulls:].view("<u8"), return_index=True)
    index = PerfectHash.build(keys)
    slot = index.slots(keys)
    prints, at = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slot], at[slot] = _print(keys), first + nulls
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
    head = HEAD.pack(MAGIC, len(rows), len(keys), nulls, ids.itemsize, before, len(index.levels))
    widths = np.array([*(len(x) for x in index.levels), len(index.left)], "<u4")
    bits = b"".join(np.packbits(x).tobytes() for x in index.levels)
    return b"".join([head, widths.tobytes(), bits, index.left.astype("<u8").tobytes(), prints.tobytes(), at.tobytes(), rows.tobytes(), offsets.tobytes(), ids.tobytes()])


class File:
    """A file's documents by key."""

    def __init__(self, raw: bytes):
        magic, n, k, self.nulls, self.width, self.before, levels = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        sizes = take("<u4", levels + 1)
        bits = [np.unpackbits(take("u1", (int(s) + 7) // 8), count=int(s)).astype(bool) for s in sizes[:-1]]
        self.index = PerfectHash(bits, take("<u8", int(sizes[-1])))
        self.prints, self.first, self.rows, self.offsets = take("<u4", k), take("<u4", k), take("<i8", n), take("<u4", n + 1)
        self.ids = take(f"<u{self.width}", int(self.offsets[-1]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each i64 key, or -1."""
        keys = np.ascontiguousarray(keys).view("<u8")
        slot = self.index.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == _print(keys[ok])
        row = np.where(ok, self.first[np.where(ok, slot, 0)].astype(np.int64) if len(self.first) else -1, -1)
        ok[ok] = self.rows[row[ok]].view("<u8") == keys[ok]
        return np.where(ok, row, -1)

    def ids_of(self, row: int) -> np.ndarray:
        return self.ids[self.offsets[row] : self.offsets[row + 1]]


#: What the batch encoder below reproduces; a tokenizer file with other rules is refused.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: What a byte is: 0 space, 1 letter, 2 digit, 3 other; words with one of the last kind go to the library whole.
LETTER, DIGIT, OTHER, ODD = 1, 2, 3, 4
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = OTHER
KIND[SPACE] = 0
for _from, _to, _kind in ((48, 58, DIGIT), (65, 91, LETTER), (97, 123, LETTER), (39, 40, ODD)):
    KIND[_from:_to] = _kind
#: Bytes of a unit that is encoded here, and units that are remembered from one batch to the next.
WIDTH, REMEMBERED = 24, 600_000
NO_RANK = 1 << 30
#: Multipliers of the pair tables' levels.
ODDS = mix(np.arange(1, 65, dtype=np.uint64) * GOLDEN) | np.uint64(1)


class Pairs:
    """Ranks of pairs of ids: tables in which each pair stands alone in its place, and the pairs that don't are in the next one."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.levels, rest = [], np.arange(len(left))
        keys = self._key(left, right)
        while len(rest):
            bits = max(8, int(8 * len(rest)).bit_length())
            at = self._at(keys[rest], len(self.levels), bits)
            alone = np.bincount(at, minlength=1 << bits)[at] == 1
            table, rank = np.full(1 << bits, np.uint64(1 << 63)), np.zeros(1 << bits, np.int32)
            table[at[alone]], rank[at[alone]] = keys[rest[alone]], rest[alone]
            self.levels.append((bits, table, rank))
            rest = rest[~alone]

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (keys * ODDS[level] >> np.uint64(64 - bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        out = np.full(keys.shape, NO_RANK, np.int32)
        for k, (bits, table, rank) in enumerate(self.levels):
            at = self._at(keys, k, bits)
            np.copyto(out, rank[at], where=table[at] == keys)
        return out


class Encoder:
    """Ids of whole texts, as the library gives them without special tokens around.

    White space parts words for good, and in words of ASCII characters without an apostrophe, a run of letters, a digit and a run of other
    characters are units that are encoded by themselves. Each distinct unit is encoded once in a batch: all of them at
    a time, one merge each in a round. Words with other characters are units that the library encodes, and so are texts that
    may hold the string of a special token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model = found["model"]
        if {k: found.get(k) for k in RULES} != RULES or {k: model.get(k) for k in MODEL} != MODEL or any(not x["content"].startswith("<|") or x["normalized"] for x in found["added_tokens"]):
            raise ValueError(f"{path} has other rules than this encoder")
        t = self.tokenizer = Tokenizer.from_file(path)
        size = t.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        end = MODEL["end_of_word_suffix"]
        self.last, self.inner = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for b in np.flatnonzero((KIND > 0) & (KIND < ODD)).tolist():
            (self.last[b],) = t.encode(chr(b), add_special_tokens=False).ids
            self.inner[b] = t.token_to_id(t.id_to_token(int(self.last[b])).removesuffix(end))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocabulary = model["vocab"]
        self.pairs = Pairs(*(np.array([vocabulary[m[i]] for m in merges]) for i in (0, 1)))
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.known = Known()
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _learn(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps the ids of new units; the tables grow by doubling."""
        n, used = self.known.n + len(h), self.used + len(ids)
        for name, need in (("ids", used), ("start", n), ("size", n)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(1 << need.bit_length(), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.ids[self.used : used] = ids
        self.start[self.known.n : n], self.size[self.known.n : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known.add(h)
        self.used = used

    def _by_merges(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and their numbers of units of up to WIDTH bytes, one merge of each at a time: the pair of the least rank, the leftmost of equals."""
        out, sizes = np.zeros((len(start), WIDTH), np.int32), size.astype(np.int64)
        for width in (1, 4, 6, 8, 10, 12, 16, WIDTH):
            rows = np.flatnonzero((size <= width) & (sizes > 0) & (out[:, 0] == 0)) if width == 1 else rows_left[size[rows_left] <= width]
            rows_left = np.flatnonzero(size > width)
            if not len(rows):
                continue
            at = start[rows, None] + np.arange(width)
            inside = np.arange(width) < size[rows, None]
            sym = np.where(inside, self.inner[raw[np.minimum(at, len(raw) - 1)]], -1)
            end = size[rows] - 1
            sym[np.arange(len(rows)), end] = self.last[raw[start[rows] + end]]
            own, live = sizes[rows], np.arange(len(rows))
            done = sym.copy()
            rank = self.pairs.ranks(sym[:, :-1], sym[:, 1:]) if width > 1 else np.zeros((len(rows), 0), np.int32)
            while rank.shape[1] and len(live):
                j = rank.argmin(1)
                least = rank[np.arange(len(live)), j]
                go = least < NO_RANK
                if not go.all():
                    done[live[~go]] = sym[~go]
                    live, sym, rank, j, least = live[go], sym[go], rank[go], j[go], least[go]
                    if not len(live):
                        break
                k = np.arange(len(live))
                # What follows the pair moves one place to the left, and so do the ranks of the pairs after it.
                shift = np.minimum(np.arange(width) + (np.arange(width) > j[:, None]), width - 1)
                sym = np.take_along_axis(sym, shift, 1)
                sym[k, j], sym[:, -1] = self.merged[least], -1
                rank = np.take_along_axis(rank, shift[:, :-1].clip(max=width - 2), 1)
                rank[:, -1] = NO_RANK
                own[live] -= 1
                has = np.flatnonzero(j > 0)
                rank[has, j[has] - 1] = self.pairs.ranks(sym[has, j[has] - 1], sym[has, j[has]])
                has = np.flatnonzero(j < width - 1)
                rank[has, j[has]] = np.where(sym[has, np.minimum(j[has] + 1, width - 1)] >= 0, self.pairs.ranks(sym[has, j[has]], sym[has, np.minimum(j[has] + 1, width - 1)]), NO_RANK)
            if len(live):
                done[live] = sym
            out[rows, :width], sizes[rows] = done, own
        return out[np.arange(WIDTH) < sizes[:, None]], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of each text's; null texts have none."""
        if self.known.n > REMEMBERED:
            self._forget()
        raw, bounds = byte_buffer(texts)
        marks = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))) if len(raw) else np.zeros(0, np.int64)
        apart = np.unique(np.searchsorted(bounds, marks, "right") - 1)
        raw = LOWER[raw]
        for i in apart.tolist():
            raw[bounds[i] : bounds[i + 1]] = 32
        kind = KIND[raw]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8) if len(kind) else kind
        begins = bounds[:-1][np.diff(bounds) > 0]
        before[begins] = 0
        word = (kind > 0) & (before == 0)
        starts = np.flatnonzero(word)
        odd = np.zeros(len(starts) + 1, bool)
        odd[np.searchsorted(starts, np.flatnonzero(kind == ODD), "right") - 1] = (kind == ODD).any()
        start = np.flatnonzero(word | (kind > 0) & ((kind != before) | (kind == DIGIT)))
        of = np.searchsorted(starts, start, "right") - 1
        keep = word[start] | ~odd[of]
        start, of = start[keep], of[keep]
        h = np.maximum(span_hashes(raw, start), np.uint64(1))
        unit = self.known.find(h)
        if (new := np.flatnonzero(unit < 0)).size:
            fresh, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            following = np.append(start[1:], len(raw))
            # A unit ends where the next one starts, or before the spaces between them.
            span = following[first] - start[first]
            bare = np.flatnonzero(KIND[raw[following[first] - 1]] == 0)
            span[bare] = [len(bytes(raw[i:j]).split(None, 1)[0]) for i, j in zip(start[first[bare]].tolist(), following[first[bare]].tolist(), strict=True)]
            text_end = bounds[np.searchsorted(bounds, start[first], "right")]
            span = np.minimum(span, text_end - start[first])
            far = odd[of[first]] | (span > WIDTH)
            near = np.flatnonzero(~far)
            ids, sizes = self._by_merges(raw, start[first[near]], span[near])
            self._learn(fresh[near], ids, sizes)
            if far.any():
                far = np.flatnonzero(far)
                got = [self.tokenizer.encode(raw[i:j].tobytes().decode("utf-8"), add_special_tokens=False).ids for i, j in zip(start[first[far]].tolist(), (start[first[far]] + span[far]).tolist(), strict=True)]
                self._learn(fresh[far], np.array([i for x in got for i in x], self.kind), np.array(list(map(len, got)), np.int64))
            unit[new] = self.known.find(fresh)[inverse]
        sizes = self.size[unit].astype(np.int64)
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.start[unit] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, bounds)]
        counts = np.diff(upto)
        if len(apart):
            parts = np.split(flat, upto[1:-1])
            for i in apart.tolist():
                parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind)
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat, counts


def encoder(path: str) -> Encoder:
    return kept(__name__, path, Encoder)


FILES = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType()), T.StructField("data", T.BinaryType()),
])
#: Bytes of text of a range of doc_ids, about, and bytes of ids of a file.
RANGE_BYTES, FILE_BYTES = 64 << 20, 8 << 20


def write_files(docs: DataFrame, tokenizer: str, end: int = 1, size: int = FILE_BYTES) -> DataFrame:
    """Writes the files of docs (doc_id, text) to the shared folder and returns them as read back, a row for each.

    A shard is a range of doc_ids, nulls first; rows of one doc_id, or without one, are all kept, in the order of a hash of their texts, so that any number of them is dealt to several
    ranges. Each document's ids end with `end`; a null or empty text has only that. A file is closed when its ids take `size` bytes.
    """
    spark = docs.sparkSession

    def run(batches) -> Iterator[dict]:
        from pyspark import TaskContext

        e, shard, file, before, held, bytes_ = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, [], 0

        def out() -> dict:
            nonlocal file, before, held, bytes_
            keys = pa.chunked_array([k for k, _, _ in held])
            nulls = keys.null_count
            rows, sizes, ids = keys.fill_null(0).to_numpy(), np.concatenate([n for _, n, _ in held]), np.concatenate([i for _, _, i in held])
            made = pack(rows, nulls, sizes, ids, before)
            row = {"shard": [shard], "file": [file], "n_docs": [len(rows)], "n_ids": [len(ids)], "first_id": [int(rows[nulls]) if nulls < len(rows) else None], "last_id": [int(rows[-1]) if nulls < len(rows) else None], "data": [made]}
            file, before, held, bytes_ = file + 1, before + len(ids), [], 0
            return row

        for b in batches:
            flat, sizes = e.encode(b.column("text"))
            ends = np.cumsum(sizes + 1) - 1
            ids = np.full(len(flat) + len(sizes), end, e.kind)
            ids[np.delete(np.arange(len(ids)), ends)] = flat
            held.append((b.column("doc_id"), sizes + 1, ids))
            bytes_ += ids.nbytes
            if bytes_ >= size:
                yield out()
        if held:
            yield out()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-total // RANGE_BYTES))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return Scratch(spark).table(per_text(ordered, run, FILES))


DIGESTS = T.StructType([T.StructField(n, k) for n, k in (("shard", T.IntegerType()), ("doc_id", T.LongType()), ("at", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))])


def read_digests(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, got through each file's index.

    The first id of a shard comes from the shards' totals: one row for each range of doc_ids, so the windowed and broadcast
    table has as many rows as the write had partitions. Of rows that share a doc_id the index gives the first, and the others follow it.
    """

    def run(batches) -> Iterator[dict]:
        for b in batches:
            for shard, raw in zip(b.column("shard").to_pylist(), b.column("data").to_pylist(), strict=True):
                k = File(raw)
                row = np.arange(len(k.rows))
                own = k.rows[k.nulls :]
                found = k.find(own)
                since = np.arange(len(own)) - np.searchsorted(own, own)
                row[k.nulls :] = found + since
                sizes = (k.offsets[row + 1] - k.offsets[row]).astype(np.int64)
                ids = pa.array(k.rows, mask=np.arange(len(k.rows)) < k.nulls)
                yield {"shard": [shard] * len(row), "doc_id": ids, "at": k.before + k.offsets[row].astype(np.int64), "n_tokens": sizes, "ids_crc32": [zlib.crc32(k.ids_of(r).astype("<u4").tobytes()) for r in row.tolist()]}

    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    digests = per_text(files.select("shard", "data"), run, DIGESTS, rows=1)
    return digests.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the keys (doc_id) that the files hold, of rows with one doc_id the first.

    The files' last keys, sorted, tell the one file that may hold a key: 24 bytes for each file of some megabytes, in each worker.
    Keys then join their file by its number, and the file's hash gives their places.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])
    spark = files.sparkSession
    known = files.where("last_id is not null").select("shard", "file", "last_id").toPandas().sort_values(["shard", "file"])
    shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("last_id", "shard", "file")))
    routed = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("doc_id", T.LongType())])

    def route(batches) -> Iterator[dict]:
        last, shard, file = shared.value
        for b in batches:
            own = b.column("doc_id").drop_null().to_numpy()
            at = np.searchsorted(last, own)
            own, at = own[at < len(last)], at[at < len(last)]
            yield {"shard": shard[at].astype(np.int32), "file": file[at].astype(np.int32), "doc_id": own}

    wanted = per_text(keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), route, routed, rows=1 << 16)
    # Keys are distinct, so a file's are as many as its documents at most.
    wanted = wanted.groupBy("shard", "file").agg(F.collect_list("doc_id").alias("wanted")).join(files.select("shard", "file", "data"), ["shard", "file"])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            for own, raw in zip(b.column("wanted").to_pylist(), b.column("data").to_pylist(), strict=True):
                k = File(raw)
                rows = k.find(np.array(own, "<i8")).tolist()
                found = [(key, k.ids_of(r).astype(np.int64)) for key, r in zip(own, rows, strict=True) if r >= 0]
                yield {"doc_id": [key for key, _ in found], "ids": [ids for _, ids in found]}

    return per_text(wanted.select("wanted", "data"), run, schema, rows=1)
