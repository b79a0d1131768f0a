"""The line dedup on chains of near copies, whose sets have more partners than the first pass takes, against brute force."""

import numpy as np
import pytest

from weir.llm import lines


def chain(rng, n, tag):
    """n lines of 20 words, each with two words fewer or other ones than some earlier line."""
    out = [[f"{tag}{i}" for i in range(20)]]
    while len(out) < n:
        own = list(out[rng.integers(max(0, len(out) - 12), len(out))])
        for _ in range(rng.integers(1, 3)):
            own[rng.integers(len(own))] = f"{tag}{rng.integers(60)}"
        out.append(own)
    return [" ".join(out[i]) for i in rng.permutation(n)]


def removed(rows):
    sets, out = [], {}
    for k, text in rows:
        for i, line in enumerate(text.split("\n")):
            s = frozenset(line.split())
            if any(100 * len(s & x) >= 80 * len(s | x) for x in sets):
                out.setdefault(k, []).append(i)
            sets.append(s)
    return out


@pytest.mark.parametrize("spread", [1, 60])
def test_chains(spark, spread):
    rng = np.random.default_rng(spread)
    found = [x for t in "abcd" for x in chain(rng, 240, t)]
    rows = [(k, "\n".join(found[k::spread])) for k in range(spread)]
    # Out of the order of doc_id, and later documents repeat lines of earlier ones, so that a task meets a set's first line last.
    rows += [(1000 + k, "\n".join(found[i] for i in rng.permutation(len(found))[:40])) for k in range(20)]
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").coalesce(2)
    assert {r.doc_id: r.removed for r in lines.removed_lines(docs, 1).collect()} == removed(rows)


def test_entries_by_first_line():
    """By token, doc_id, line and name, each set once for a token; a token with one entry has no pairs."""
    e = {"token": [5, 5, 5, 5, 5, 1], "doc_id": [7, 7, 7, 7, 7, 9], "line": [0, 4, 3, 2, 0, 0], "name": [2, 2, 3, 2, 1, 1]}
    types = {"token": np.uint64, "line": np.int32}
    for far in (0, 1 << 40):
        own = {c: np.array([*v, {"token": 3, "doc_id": far}.get(c, 0)], types.get(c, np.int64)) for c, v in e.items()}
        assert lines._by_token(own).tolist() == [4, 0, 2]


@pytest.mark.parametrize("seed", range(20))
def test_row_orders(spark, seed):
    """The counterexample of a set whose only earlier partner is late, and rows that share an id, in any order of rows."""
    words = [f"w{i}" for i in range(1, 21)]
    other = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))
    rows = [(100, " ".join(words)), (5, " ".join(words)), (3, other(0, 1)), *((10 + k, other(2 + 2 * k, 3 + 2 * k)) for k in range(5)), (50, other(18, 19))]
    rows += [(1, "\n".join(" ".join(words[5 + i : 9 + i]) for i in range(11)))]
    want = removed(sorted(rows))
    rng = np.random.default_rng(seed)
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").coalesce(1 + seed % 3)
    assert {r.doc_id: r.removed for r in lines.removed_lines(docs, 1).collect()} == want


@pytest.mark.parametrize("most_words", [10, 100_000])
def test_hot_words_are_dealt(spark, monkeypatch, most_words):
    """With small blocks and salts the rounds over open sets give the same."""
    monkeypatch.setattr(lines, "MOST_WORDS", most_words)
    rng = np.random.default_rng(9)
    for name, value in {"BLOCK": 8, "HEAD": 3, "SALT_ROWS": 16, "FIRST": 2, "MET": 50, "MANY_OPEN": 3}.items():
        monkeypatch.setattr(lines, name, value)
    found = [x for t in "ab" for x in chain(rng, 150, t)]
    rows = [(k, "\n".join(found[k::30])) for k in range(30)]
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string").coalesce(2)
    assert {r.doc_id: r.removed for r in lines.removed_lines(docs, 1).collect()} == removed(rows)
