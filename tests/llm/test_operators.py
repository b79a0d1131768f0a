"""The operators against brute force or libraries, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weir.llm import jaccard, lines, mixing, nearest, quality, rules, secrets, sentencepieces, token_files, toxicity
from weir.llm.common import connected, lower_ascii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Größe,", "été.", "日本", "🙂", "don't", "12", "é"]
    base = [" ".join(rng.choice(vocabulary, n)) for n in (4, 5, 9, 14, 30, 60, 60, 120, 300, 3000)]
    out = list(base)
    for t in base:
        own = t.split(" ")
        for share in (0.005, 0.02, 0.03, 0.1):
            out.append(" ".join(str(rng.choice(vocabulary)) if rng.random() < share else w for w in own))
    return [*out, *out[:5], "", " \n\t ", "one", "Shared line of six plain words\nother " + base[4], "shared LINE of six plain words\n" + base[5], "x" * 50_000]


@pytest.fixture(scope="module")
def rows():
    found = texts()
    out = [(i * 3, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, len(t), i) for i, t in enumerate(found)]
    return [*out, out[4], (None, "a null id", "en", "s1", 9, 1), (999, None, "en", "s1", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def test_jaccard_components(docs, rows, empty):
    known = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {k: k for k, _ in known}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((k, len(s), find(k)) for k, s in known)
    got = jaccard.components(docs).collect()
    assert sorted(tuple(r)[:3] for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows)
    assert jaccard.components(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(k) for k, _ in known})


def test_jaccard_links_of_random_sets():
    rng = np.random.default_rng(5)
    for n in (5, 8, 16, 40, 90, 400):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, rng.integers(0, n // 6 + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if common < len(a) + len(b) - common and 100 * common >= 80 * (len(a) + len(b) - common):
                assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))


def test_connected(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(map(tuple, connected(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_sentencepiece(docs, rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for r in rows:
        ids = sp.encode(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, sentencepieces.encode_decode(docs, PIECES).collect())) == want
    assert sentencepieces.encode_decode(empty, PIECES).count() == 0
    back = sentencepieces.decode_ids(sentencepieces.encode_ids(docs, PIECES), PIECES)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)


def test_sentencepiece_odd_strings():
    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.table(PIECES)
    rng = np.random.default_rng(1)
    letters = [*" ab\t\n▁eéthß日🙂\x00.,!inger", " ", " ", "  "]
    for _ in range(3000):
        s = "".join(rng.choice(letters, rng.integers(0, 20)))
        assert own.encode(s) == sp.encode(s)
        assert own.decode(sp.encode(s)) == sp.decode(sp.encode(s))


def test_token_files(docs, rows, empty, spark):
    t, at, want = Tokenizer.from_file(WORDS), 0, Counter()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    blocks = token_files.write_files(docs, WORDS, size=4096)
    got = Counter(map(tuple, token_files.read_digests(blocks).collect()))
    assert got.keys() - want.keys() == want.keys() - got.keys() == set()
    found = {r.doc_id: r.ids for r in token_files.lookup(blocks, spark.createDataFrame([(12,), (27,), (10_001,)], "doc_id long")).collect()}
    assert found == {k: [*t.encode(next(r[1] for r in rows if r[0] == k), add_special_tokens=False).ids, 1] for k in (12, 27)}
    assert token_files.read_digests(token_files.write_files(empty, WORDS)).count() == 0


def test_token_files_odd_strings():
    own, rng = token_files.Encoder(WORDS), random.Random(1)
    letters = [*"abzERtsdmlv\'\'\'..,!12 \t\n\x0b\x1c\x7f\x00éßÅ日🙂\u0301\xa0\u3000ΣİK<|>/_-", "'s", "'ll", "<|endoftext|>", "the", "ing", "A" * 30]
    for _ in range(30):
        found = [None, "", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(100)), "x" * 300_000]
        ids, sizes = own.encode(pa.array(["cut", *found])[1:])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [own.tokenizer.encode(x or "", add_special_tokens=False).ids for x in found]


def test_token_files_of_one_id(spark):
    """Rows that share an id, or have none, are dealt to several ranges, and all come back."""
    rows = [(None if i % 3 else 7, f"word {i} " * (i % 9)) for i in range(600)] + [(k, f"own {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = token_files.write_files(docs, WORDS, size=2048)
    assert files.select("shard").distinct().count() > 4
    t = Tokenizer.from_file(WORDS)
    want = Counter((k, zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes())) for k, x in rows)
    got = token_files.read_digests(files).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(len(order))]
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in got), key=lambda k: (k is not None, k))
    assert {r.doc_id for r in token_files.lookup(files, spark.range(100).withColumnRenamed("id", "doc_id")).collect()} == set(range(40))
    plan = token_files.lookup(files, spark.range(100).withColumnRenamed("id", "doc_id"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_token_files_refuse_other_rules(tmp_path):
    (tmp_path / "t.json").write_text(open(WORDS, encoding="utf-8").read().replace('"Lowercase"', '"NFD"'), encoding="utf-8")
    with pytest.raises(ValueError, match="other rules"):
        token_files.Encoder(str(tmp_path / "t.json"))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64))
    slots = token_files.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_secrets(spark, docs, rows, empty):
    odd = ["token = 'abcdefghijkl1' x", "token=secret: abcdefghijklmnop", "AKIA" + "A" * 14 + " AKIAB", "0" * 15 + "g" + "f" * 16, "paſſword: abcdefghijklmnop", None, "", "https://u:hunter22@h/"]
    got = secrets.secrets_of(spark.createDataFrame([(i, x) for i, x in enumerate(odd)] + [(0, odd[0])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got) == [(0, 1, 0, 0), (0, 1, 0, 0), (1, 0, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, 0, 0, 0), (5, 0, 0, 0), (6, 0, 0, 0), (7, 0, 0, 0)]
    assert {r.spans for r in got if r.doc_id == 7} == {"urlpass:0:19"}
    assert secrets.secrets_of(empty).count() == 0
    versions = spark.createDataFrame([("a@1", odd[0]), ("b@1", odd[0]), ("a@2", odd[2])], "version string, text string")
    _, first = secrets.update_ledger(versions.limit(2))
    _, second = secrets.update_ledger(versions, first)
    assert first.count() == 1 and second.count() == 2


def test_rules(docs, rows, empty):
    got = rules.judged(docs).collect()
    want = Counter()
    for r in rows:
        text = r[1] or ""
        own = WORD.findall(text)
        windows = list(zip(own, own[1:], own[2:]))
        count = Counter(windows)
        covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
        split = [x for x in text.split("\n") if WORD.search(x)]
        want[r[0], len(own), sum(map(len, own)), sum(c in rules.SYMBOLS for c in text), len(split) - len(set(split)), len(covered), len(own) < 50 or 100 * len(covered) > 50 * len(own)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.judged(empty).count() == 0


def test_lines(docs, rows, empty):
    first, sets, gone = {}, [], set()
    for r in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate(r[1].split("\n")):
            s = frozenset(WORD.findall(line.lower()))
            if len(WORD.findall(line)) >= 5:
                if s in first or any(100 * len(s & x) >= 80 * len(s | x) for x in sets):
                    gone.add((r[0], r[1], i))
                if s not in first:
                    first[s] = 1
                    sets.append(s)
    removed = defaultdict(list)
    for k, t, i in sorted(gone, key=lambda x: (x[0] or 0, x[2])):
        removed[k, t].append(i)
    want = Counter((r[0], ",".join(map(str, removed[r[0], r[1]]))) for r in rows)
    assert Counter((r.doc_id, r.removed_lines) for r in lines.deduped(docs).collect()) == want
    assert lines.deduped(empty).count() == 0
    assert lines.without_repeats(docs).columns == docs.columns


def test_word_hashes():
    rng = random.Random(1)
    texts = [None, "", "a", "a\n", "\n", "\n\nb", " a", "q" * 300 + " " * 300 + "z " * 3 + "\n" + "q" * 300 + " q" * 2]
    texts += ["".join(rng.choice("ab \n\tçÉAZ\x0b\x1c　x") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rng.shuffle(texts)
    found, line, owner, number = lines._word_hashes(pa.array([None, *texts])[1:])
    want = [(k, i, w) for k, t in enumerate(texts) if t for i, x in enumerate(lower_ascii(t).split("\n")) for w in WORD.findall(x)]
    assert list(zip(owner[line].tolist(), number[line].tolist(), strict=True)) == [w[:2] for w in want]
    pairs = {(w[2], h) for w, h in zip(want, found.tolist(), strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert len(lines._word_hashes(pa.array(["", None, " "]))[0]) == 0


def test_mixing(docs, rows, empty):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    for s in size:
        assert taken[s] == int(target[s]) and target[s] <= 3 * size[s] + 1e-6
    order = mixing.training_order(mixing.mixed(docs)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and 0 <= order[0].position and order[-1].position <= 1
    assert mixing.mixed(empty).count() == 0
    assert mixing.copies(docs).columns == docs.columns


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[7] = x[11] = x[20]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [1.0] * 15 + [float("nan")]), (1003, [1.0] * 15 + [None]), (None, [1.0] * 16), (40, x[40].tolist())]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>")
    indexed = nearest.index(vectors)
    got = defaultdict(list)
    for r in nearest.nearest(indexed, indexed.where("vec_id % 20 = 0").select("vec_id", "vector"), 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y, hits = x.astype(float), 0
    for q in range(0, 400, 20):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        found = [v for _, v, _ in sorted(got[q])]
        hits += len(set(found) & set(np.lexsort((np.arange(400), -s))[:20].tolist()))
        assert len(found) == 20
        for _, v, score in got[q]:
            assert abs(score - s[v]) < 1e-9
    assert len(got) == 20 and hits >= 0.97 * 400


@pytest.mark.parametrize("name", ["op5_quality_classifier", "op7_toxicity"])
def test_classifiers_held_out(spark, name):
    import __spark_entry__

    sf = "/root/testdata/sf0.01"
    label = "quality" if "quality" in name else "toxic"
    got = __spark_entry__.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in got) >= 0.9 * len(got)


def test_classifiers_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, quality.train(docs, none)).count() == docs.count()
    assert toxicity.classify(docs, toxicity.train(docs, none)).count() == docs.count()
    assert toxicity.classify(empty, toxicity.train(empty, none)).count() == 0


def test_segments():
    rng = np.random.default_rng(6)
    for _ in range(200):
        scores = rng.integers(-4, 5, 12).astype(float).tolist()
        best = max((sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13)), default=0)
        assert max((s for _, _, s in toxicity.segments(scores)), default=0.0) == max(0.0, best)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).count() > 0
