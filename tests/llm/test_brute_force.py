"""Scores, verdicts and findings against plain loops, on small tables with nulls, empty texts, repeated rows and extra columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weir.llm import common, jaccard, lines, mixing, nearest, quality, rules, secrets, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n", "one", "one one one two", "Größe, été été don't 日本🙂", "x" * 5000, "a b\nc " * 40, "token = 'abcdefghijkl1' x", "password=hunter2hunter2 AKIA" + "A" * 14 + " " + "f" * 16 + "g" + "0" * 20, "api_key: " + "Z" * 12 + "\nTOKEN:short secret=\"abc/def+ghi=jkl\""]


def test_quality_scores():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.standard_normal(quality.BUCKETS).astype(np.float32), 0.25)

    def plain(text):
        own = WORD.findall((text or "").encode())
        if not own:
            return 1 / (1 + math.exp(-0.25))
        h = [common.span_hashes(np.frombuffer(w, np.uint8), np.zeros(1, np.int64)) for w in own]
        total, n = 0.0, 0
        for w, x in zip(own, h, strict=True):
            flat, size = quality.word_features([w], x)
            marked = f"<{w.decode()}>"
            assert size[0] == 1 + sum(max(0, len(marked) - k + 1) for k in (3, 4))
            total, n = total + float(model.parts[flat].astype(float).sum()), n + len(flat)
        for a, b in zip(h, h[1:], strict=False):
            total += float(model.parts[quality.AGAIN if a == b else quality._bucket(a * common.GOLDEN + common.mix(b))[0]])
        return 1 / (1 + math.exp(-min(40, max(-40, 0.25 + total / (n + len(own) - 1)))))

    score = model.scorer()
    assert np.allclose(score(pa.array(TEXTS)), [plain(t) for t in TEXTS], atol=1e-6)
    assert np.allclose(score(pa.array(["cut", *TEXTS])[1:]), score(pa.array(TEXTS)), atol=0)


def test_quality_learns_pairs():
    """The classes have the same words; only which follow each other tells them."""
    rng = np.random.default_rng(1)
    pairs = [("red", "fish"), ("blue", "stone"), ("old", "tree"), ("new", "road")]
    good = [" ".join(w for k in rng.integers(0, 4, 20) for w in pairs[k]) for _ in range(120)]
    bad = [" ".join(w for k in rng.integers(0, 4, 20) for w in (pairs[k][0], pairs[(k + 1) % 4][1])) for _ in range(120)]
    score = quality.fit(good[:80] + bad[:80], [1] * 80 + [0] * 80).scorer()
    assert (score(pa.array(good[80:])) > 0.5).mean() > 0.9 and (score(pa.array(bad[80:])) < 0.5).mean() > 0.9


def test_toxicity_scores():
    model = toxicity.Model({"=été": 2.5, "tok": 3.0, "=one": 1.0, "~xxxx": 0.5}, 1.3, 0.01, 1.1, -4.0)

    def plain(text):
        own = [w.decode().lower() for w in WORD.findall((text or "").encode())]
        each = [max((model.scores[t] for t in toxicity.terms(w) if t in model.scores), default=-toxicity.LOSS) for w in own]
        found = toxicity.segments(each)
        total = sum(max(0.0, 1.3 * s - math.log(max(0.01 * len(own), 1e-12))) for _, _, s in found)
        return 1 / (1 + math.exp(-(-4.0 + 1.1 * min(30.0, total / math.log(10))))), found

    for (score, found), text in zip(model.scorer()(pa.array(TEXTS)), TEXTS, strict=True):
        want, segments = plain(text)
        assert abs(score - want) < 1e-9
        assert [x[:2] for x in found] == [x[:2] for x in segments]


def test_toxic_segments_all_count():
    model = toxicity.Model({"=bad": 3.0}, 1.0, 0.001, 1.0, -10.0)
    scores = [x[0] for x in model.scorer()(pa.array([" ".join((["bad"] + ["fine"] * 20) * n) for n in (5, 8)]))]
    assert scores[1] > scores[0]


def test_terms_reach_inside_long_runs():
    assert "=toxic" in toxicity.terms("a/very-toxic.word")
    assert "~toxi" in toxicity.terms("x" * 60 + "toxic" + "y" * 60)


def findings(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16),
    ):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(out)


def test_secret_digests(spark):
    rng = np.random.default_rng(2)
    texts = TEXTS + [" ".join(rng.choice(["token", "=", ":", "'", "secret", "AKIA", "ABCDEFGHIJKLMNOPQR", "deadbeefdeadbeef", "api_key=", "abcdefghijklmnop", "é", "\n"], 40)) for _ in range(60)]
    texts += ["".join(rng.choice([*"token=:'\" AKI09afAF_\n", "secret", "AKIA"], 300)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    for r in secrets.secrets_of(docs).collect():
        own = findings(texts[r.doc_id] or "")
        assert Counter(k for *_, k in own) == Counter({"assign": r.n_assign, "access": r.n_access, "hex": r.n_hex})
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in own).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [f"{k}:{a}:{b}" for a, _, b, k in own]


def test_ledger_scans_what_is_new(spark, tmp_path, monkeypatch):
    versions = lambda rows: spark.createDataFrame(rows, "version string, text string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    first = [("a@1", TEXTS[8]), ("b@1", TEXTS[8]), ("c@1", TEXTS[9]), ("d@1", None), ("d@2", "")]
    assert ledger.update(versions(first))[1] == 3
    assert ledger.update(versions(first))[1] == 0
    assert ledger.update(versions([*first, ("a@2", "new text token=abcdefghijklmnop")]))[1] == 1
    monkeypatch.setattr(secrets, "RULE_VERSION", "next")
    assert ledger.update(versions(first))[1] == 3
    assert ledger.read().count() == 7


def test_rule_verdicts(spark):
    """kept, from quartiles that small sketches hold exactly."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        own = [f"{'w' * int(rng.integers(1, 9))}{rng.integers(0, 500)}" for _ in range(int(rng.integers(40, 120)))]
        if i % 9 == 0:
            own = ["#$%" + w for w in own]
        rows.append((i, " ".join(own) + ("\nsame line\nsame line" * int(rng.integers(0, 3))), ["en", "de", None][i % 3], f"s{i % 4}", "clash"))
    rows += [(900, None, None, "s1", ""), (901, "", "en", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, symbols string")
    got = {r.doc_id: r for r in rules.judged(docs).collect()}

    def measured(r):
        n = max(1, r.n_words)
        text = next(t for k, t, *_ in rows if k == r.doc_id) or ""
        full = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return {"symbols": r.n_symbols / max(1, r.word_chars), "word_length": r.word_chars / n, "dup_lines": r.n_dup_lines / max(1, len(full)), "repeats": r.n_repeat_words / n}

    values = {k: measured(r) for k, r in got.items()}
    group = {k: (lang, source) for k, _, lang, source, _ in rows}
    some = [k for k in got if got[k].n_words]

    def quartiles(keys, name):
        v = sorted(values[k][name] for k in keys)
        return [v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.5, 0.75)]

    drawn = lambda own, n, to: [(n * a + rules.EVIDENCE * b) / (n + rules.EVIDENCE) for a, b in zip(own, to, strict=True)]
    for k, r in got.items():
        kept = not r.base_failed
        for name in values[k]:
            mine, lang = ([x for x in some if group[x] == group[k]], [x for x in some if group[x][0] == group[k][0]])
            if not mine:
                kept = False
                continue
            low, mid, high = drawn(quartiles(mine, name), len(mine), drawn(quartiles(lang, name), len(lang), quartiles(some, name)))
            kept &= mid - rules.SPREAD * (mid - low) - rules.SLACK[name] <= values[k][name] <= mid + rules.SPREAD * (high - mid) + rules.SLACK[name]
        assert r.kept == kept, (k, values[k])


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, g_doc int, g_version int, removed int, k_id int, k_many int, m_id int, times int, name int, version int, position int, _doc_id_0 int"


def test_stages_take_any_columns(spark):
    """Pipeline stages over rows with nulls, repeats, and columns named as the operators name theirs."""
    texts = ["one two three four five six seven\nshared line of some words here"] * 2 + ["other words stand here for once\nshared line of some words here", None, "", "x " * 3000]
    rows = [(i if i != 3 else None, t, "en", "s", len(t or ""), *range(10, 20), 7) for i, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((1, "a second text of this very id, which is different", *rows[1][2:]))
    docs = spark.createDataFrame(rows, CLASHES)
    for got in (lines.without_repeats(docs, 1), jaccard.one_of_each(docs), mixing.copies(docs), quality.accepted(docs, quality.Model(np.zeros(quality.BUCKETS, np.float32), 1.0))):
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(r.times == rows[0][11] and r.removed == rows[0][7] for r in found)
    one = jaccard.one_of_each(docs).collect()
    # The copy and the repeated row go; the two texts of one id both stay, as do rows without words.
    assert Counter((r.doc_id, (r.text or "")[:8]) for r in one) == Counter([(0, "one two "), (1, "a second"), (2, "other wo"), (None, ""), (4, ""), (5, "x x x x ")])


def test_nearest_of_mixed_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8 if i % 3 else 5).tolist(), i, "c") for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    indexed = nearest.index(vectors)
    got = nearest.nearest(indexed, indexed.where("vec_id % 20 = 0").select("vec_id", "vector"), 5).collect()
    for q in range(0, 120, 20):
        own = np.array(rows[q][1])
        want = sorted(((-float(np.dot(own, r[1])), r[0]) for r in rows if r[0] != q and len(r[1]) == len(own)))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [k for _, k in want]
    assert nearest.nearest(nearest.index(vectors.limit(0)), indexed.select("vec_id", "vector").limit(0), 5).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a b c d", "a b c d e", "A b c d e f", None])
def test_shingles(text):
    own = (text or "").lower().split()
    assert len(jaccard.many_shingles(pa.array([text, "z"]))[0]) == (0 if not own else max(1, len(own) - 4))
