"""Lines of one to four words in the line dedup, as the query and the pipeline run it, against brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from weir.llm import lines, queries

TEXTS = [
    "les\none two three four\nOne\n\n  \none two three four five", "les\none TWO three four five six", "one two three\nfour four\nfour", "a b c d e\nb c d e\na b c",
    "c b a\na b c d\nx y z u", "les\nles", "x y z u v w\nx y z u v\n" + "les " * 6, "x y z q\n\x0b\nONE",
]


def removed(rows):
    out, sets = defaultdict(list), []
    for k, text in rows:
        for i, line in enumerate(text.split("\n")):
            s = frozenset(line.lower().split())
            if s:
                if any(100 * len(s & x) >= 80 * len(s | x) for x in sets):
                    out[k].append(i)
                sets.append(s)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).cache()


def test_short_lines_of_the_query(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "load", lambda *_: docs)
    want = removed(enumerate(TEXTS))
    got = queries.op8_line_dedup(spark, "").collect()
    assert Counter((r.doc_id, r.removed_lines) for r in got) == Counter((i, ",".join(map(str, want[i]))) for i in range(len(TEXTS)))


def test_short_lines_of_the_pipeline(spark, docs):
    want = removed(enumerate(TEXTS))
    kept = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i]) for i, t in enumerate(TEXTS)}
    got = corpus_pipeline.dedup_lines(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in got} == {i: t for i, t in kept.items() if t.split()}


def test_least_words_of_the_library(docs):
    got = {r.doc_id: r.removed for r in lines.removed_lines(docs, 5).collect()}
    assert not any(len(TEXTS[i].split("\n")[j].split()) < 5 for i, own in got.items() for j in own)
