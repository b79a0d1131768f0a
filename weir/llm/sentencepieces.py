"""SentencePiece encoding and decoding by a prefix table.

For each prefix of a unit exactly one token can be the last of its encoding. An automaton gives the vocabulary tokens that
end there; the one that fits is the one whose pair with the last token of what is before it would be left as it is by the
merges. The ids are then read backwards from the end of the table. A unit is a run of spaces with the text up to the next
one: no piece holds a space after another character, so no merge crosses units, and each distinct unit is encoded once.
Runs of two or more spaces, whose pieces have tied scores, are merged step by step instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import WordCache, kept, per_text
from pyspark.sql import types as T

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PrefixTable:
    """encode(text) and decode(ids) as the sentencepiece library does for a BPE model with byte fallback."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.unknown, self.pieces = sp.unk_id(), [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.byte = {i: int(self.pieces[i][3:-1], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {v: k for k, v in self.byte.items()}
        self.size, self.name = [len(p) for p in self.pieces], [str(i) for i in range(n)]
        #: What a token decodes to by itself; bytes do together.
        self.shown = [None if i in self.byte else " ⁇ " if i == self.unknown else "" if i in self.control else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.id = {self.pieces[i]: i for i in range(n) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece with a space inside: its units can't be told apart")
        #: A token's rank in the merge order; single characters are there from the start.
        order = sorted((p for p in self.id if len(p) > 1), key=lambda p: (-self.score[self.id[p]], self.id[p]))
        self.rank = {self.id[p]: k for k, p in enumerate(order)} | {i: -1 for p, i in self.id.items() if len(p) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.matches = ahocorasick.Automaton()
        for p, i in self.id.items():
            own = self.merged(p)
            if len(own) == 2 or own != [i]:
                continue  # never the outcome of merges
            self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        self.fits: dict[int, bool] = {}
        self.units = WordCache(self._unit, 250_000)

    def merged(self, text: str) -> list[int]:
        """The ids by merging, best score first and leftmost among equals; unknown characters stay apart."""
        own = [self.id.get(c, -ord(c) - 1) for c in text]
        text_of = list(text)
        after, before = [*range(1, len(own)), -1], [-1, *range(len(own) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and (to := self.id.get(text_of[i] + text_of[j])) is not None:
                heapq.heappush(queue, (-self.score[to], i, to, text_of[i] + text_of[j]))

        for i in range(len(own) - 1):
            offer(i)
        while queue:
            _, i, to, joined = heapq.heappop(queue)
            j = after[i] if text_of[i] else -1
            if j < 0 or text_of[i] + text_of[j] != joined:
                continue
            if len(joined) == len(text):
                self.halves[to] = (own[i], own[j])
            own[i], text_of[i], text_of[j] = to, joined, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [x for x, t in zip(own, text_of, strict=True) if t]

    def _pair(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a and b next to each other as they are.

        Undoes the merges of both from the latest on; the two that then touch must not have a merge that comes before the
        undone one. Of equal ranks the left one is made first, so a pair made of the right one's rank would be too late.
        """
        rank, id_of, pieces = self.rank, self.id, self.pieces
        before = (len(rank), 0)  # a merge across the seam must not come earlier than this
        while True:
            over = id_of.get(pieces[a] + pieces[b])
            if over is not None and (rank[over], 0) < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = (ra, 0), self.halves[a][1]
            else:
                before, b = (rb, 1), self.halves[b][0]

    def _unit(self, unit: str) -> tuple[str, int, str]:
        ids = self.unit_ids(unit)
        name = self.name
        return ",".join([name[i] for i in ids]), len(ids), self._joined(ids)

    def unit_ids(self, unit: str) -> list[int]:
        if unit.startswith(SPACE * 2):
            found = self.merged(unit)
        else:
            found = self._by_table(unit)
        if not found or min(found) >= 0:
            return found
        out: list[int] = []
        for i in found:
            out.extend([i] if i >= 0 else (self.byte_id[x] for x in chr(-i - 1).encode("utf-8")) if self.byte_id else [self.unknown])
        return out

    def _by_table(self, unit: str) -> list[int]:
        last: list[int | None] = [None] * (len(unit) + 1)
        fits, known, n = self.fits, self.id, len(self.pieces)
        if len(fits) > 500_000:
            fits.clear()
        for end, (size, token) in self.matches.iter(unit):
            end += 1
            if last[end] is not None:
                continue
            if start := end - size:
                prior = last[start]
                if prior is None:  # an unknown character, or a start that no match has filled yet
                    if unit[start - 1] in known:
                        continue
                else:
                    try:
                        if not fits[prior * n + token]:
                            continue
                    except KeyError:
                        ok = fits[prior * n + token] = self._pair(prior, token)
                        if not ok:
                            continue
            last[end] = token
        out, at = [], len(unit)
        while at:
            token = last[at]
            if token is None:
                if unit[at - 1] in self.id:
                    raise AssertionError(f"no last token at {at} of {unit!r}")
                out.append(-ord(unit[at - 1]) - 1)
                at -= 1
            else:
                out.append(token)
                at -= self.size[token]
        return out[::-1]

    def encode_units(self, text: str | None) -> list[tuple[str, int, str]]:
        """(ids as text, their number, decoded text) of each unit; the first unit begins with the space put before any text."""
        if not text:
            return []
        units = self.units
        return [units[u] for u in UNIT.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.encode_units(text) for i in ids.split(",")]

    def _joined(self, ids: list[int]) -> str:
        shown = self.shown
        try:
            return "".join([shown[i] for i in ids])
        except TypeError:  # a byte
            pass
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text; the space that was put before it goes."""
        out = self._joined(ids)
        first = next((i for i in ids if i not in self.control), None)
        return out[1:] if first is not None and first not in self.byte and first != self.unknown and out.startswith(" ") else out


def _utf8(raw: bytes) -> str:
    """Each byte that doesn't begin a valid character becomes U+FFFD by itself."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _read(path: str) -> PrefixTable:
    with open(path, "rb") as f:
        return PrefixTable(f.read())


def table(path: str) -> PrefixTable:
    """The table of a model file, kept in a worker."""
    return kept(__name__, path, _read)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """One row for each row of docs (doc_id, text): the number of ids, and digests of the ids and of the decoded text.

    A null or empty text has no ids and decodes to "". Null doc_ids stay null; repeated rows and other columns don't matter.
    model is the path of a model file that every machine has.
    """

    def run(batches) -> Iterator[dict]:
        t = table(model)
        for b in batches:
            out: dict = {"doc_id": b.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in b.column("text").to_pylist():
                found = t.encode_units(text)
                out["n_tokens"].append(sum(x[1] for x in found))
                out["ids_sha256"].append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
                decoded = "".join([x[2] for x in found])
                out["decoded_sha256"].append(hashlib.sha256((decoded[1:] if decoded.startswith(" ") else decoded).encode()).hexdigest())
            yield out

    return per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches) -> Iterator[dict]:
        t = table(model)
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "ids": [t.encode(x) for x in b.column("text").to_pylist()]}

    return per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for each row of (doc_id, ids); null ids decode to ""."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches) -> Iterator[dict]:
        t = table(model)
        for b in batches:
            yield {"doc_id": b.column("doc_id"), "text": [t.decode(x or []) for x in b.column("ids").to_pylist()]}

    return per_text(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, schema)
