"""The pipeline's stages against plain loops, each on what the one before has kept."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from weir.llm import mixing, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def removed(rows):
    """Rows less their lines, where each line is held against all earlier ones, gone or not."""
    sets, out = [], {}
    for k, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            s = frozenset(WORD.findall(line.translate(LOWER)))
            if not s or not any(similar(s, x) for x in sets):
                kept.append(line)
            if s:
                sets.append(s)
        if kept == text.split("\n") or WORD.search("\n".join(kept)):
            out[k] = "\n".join(kept)
    return out


def one_of_each(rows):
    sets = {}
    for k, text in rows:
        own = WORD.findall(text.translate(LOWER))
        sets[k] = frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else None
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if similar(sets[a], sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k for k in sets if find(k) == k}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "mixing", "sentencepiece"]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(i)))))
        docs = kept[-1][1]
    texts = lambda df: [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]

    before, after = kept[0]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.classify(before, model).where("predicted = 1").collect()}
    assert {k for k, _ in texts(after)} == want and 0 < len(want) < before.count()

    before, after = kept[1]
    assert dict(texts(after)) == removed(texts(before))
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0

    before, after = kept[2]
    assert sorted(k for k, _ in texts(after)) == sorted(one_of_each(texts(before)))
    assert dict(texts(after)).items() <= dict(texts(before)).items()

    before, after = kept[3]
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mixed(before).collect()}
    want = Counter({k: int(t / s + 0.5) for k, (t, s) in taken.items() if s})
    assert Counter(k for k, _ in texts(after)) == +want
    assert dict(texts(after)).items() <= dict(texts(before)).items()

    before, after = kept[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for k, text in texts(before):
        ids = sp.encode(text)
        want[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
