"""What the line dedup may spare: entries of words that stand once, tables for bytes, pairs that sizes and places rule out."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_line_order import removed
from weir.llm import common, lines


def test_words_that_stand_once_have_no_entries(spark):
    """Only the words that another line may share are sent on, at the places that they have in the whole set."""
    shared = [f"s{i}" for i in range(9)]
    own = [" ".join(shared + [f"own{k}"]) for k in range(3)]  # 9 of 11 words in common
    alone = [" ".join(f"alone{k}x{i}" for i in range(10)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(own + alone)), "doc_id long, text string").coalesce(1)
    sets = lines._sets(lines._keyed(docs), lines.rarity(docs), 1).where("prefix is not null").withColumn("open", F.lit(0).cast("tinyint"))
    assert sets.agg(F.sum(F.size("prefix"))).first()[0] == 6  # the prefixes of the three are of 3 words, one of them its own
    packed = [common.unpack(r.data, tuple(lines.ENTRY.values())) for r in lines._packed(sets, 4, True).collect()]
    assert sorted(np.concatenate([dict(zip(lines.ENTRY, x, strict=True))["pos"] for x in packed]).tolist()) == [1, 1, 1, 2, 2, 2]
    assert {r.doc_id: r.removed for r in lines.removed_lines(docs, 1).collect()} == {1: [0], 2: [0]}


def test_bytes():
    raw = np.arange(256, dtype=np.uint8)
    assert (common.lowered(raw) == common.LOWER).all() and (common.is_solid(raw) == common.SOLID).all()


@pytest.mark.parametrize("least", [80, 55])
def test_sizes_and_places(monkeypatch, least):
    """The pairs that pass are those of the three conditions on sizes, places and bits, taken one by one."""
    monkeypatch.setattr(lines, "LEAST", least)
    rng = np.random.default_rng(least)
    k = 300
    n = rng.integers(4, 40, k)
    e = {"n": n.astype(np.int32), "pos": (rng.random(k) * (n - (n * least + 99) // 100 + 1)).astype(np.int32), "name": rng.integers(0, 250, k)}
    e |= {c: rng.integers(0, 1 << 62, k).astype(np.uint64) & rng.integers(0, 1 << 62, k).astype(np.uint64) & np.uint64(0x1111) for c in ("low", "high")}
    e["part"], e["reach"] = least * e["n"], (100 + least) * (e["n"] - e["pos"]) - least * e["n"]
    want = set()
    for a in range(k):
        for b in range(a):
            both = int(n[a] + n[b])
            differ = sum(int(e[c][a] ^ e[c][b]).bit_count() for c in ("low", "high"))
            need = -(-least * both // (100 + least))
            if min(n[a] - e["pos"][a], n[b] - e["pos"][b]) >= need and min(n[a], n[b]) * 100 >= max(n[a], n[b]) * least and differ <= both * (100 - least) // (100 + least) and e["name"][a] != e["name"][b]:
                want.add((a, b))
    own = np.arange(1, k)
    half = own // 2  # each entry's earlier ones as two spans
    got = lines._spans_met(e, np.repeat(own, 2), np.stack([own * 0, half], 1).ravel(), np.stack([half, own - half], 1).ravel())
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want and len(got[0]) == len(want) > 100
    assert (np.diff(got[0]) >= 0).all()


def test_line_counts(spark):
    texts = [None, "", "\n", "a", "a\n", "\na\n\nb", "é\n\r\n日本\n", " \x85\x0b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_lines for r in lines.deduped(docs, 1).collect()} == {k: len(t.split("\n")) if t else 0 for k, t in enumerate(texts)}


def test_entries_with_very_many_before_them(spark, monkeypatch):
    """An entry that meets more than four times what is held at a time meets them in several steps."""
    for name, value in {"BLOCK": 8, "HEAD": 3, "FIRST": 1, "MET": 4, "MANY_OPEN": 3}.items():
        monkeypatch.setattr(lines, name, value)
    # Two lines are similar where they lack a word in common; the last ones that are similar to none have most others before them.
    words = [f"w{i}" for i in range(14)]
    found = [" ".join(w for w in words if w not in lack) for lack in combinations(words, 2)]
    rows = [(int(k), found[i]) for k, i in enumerate(np.random.default_rng(3).permutation(len(found)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert {r.doc_id: r.removed for r in lines.removed_lines(docs, 1).collect()} == removed(rows)
