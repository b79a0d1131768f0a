"""Quality rules with adaptive thresholds, in DataFrame functions only.

Counts come from array functions inside each row, so no text or word moves between machines. Every group of language and
source has a mergeable quantile sketch of each measure; its fences lie a multiple of the spread between its median and
quartile away from the median. A group's quartiles are drawn to those of its language's merged sketch, and these to the corpus's, the
more the fewer documents there are. A join by group then filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import SPACES, Scratch, small

#: Fixed values of the base rules.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 50, 50
#: Multiples of the half spread that a document may lie off the median; what each measure may always differ by, as for groups without spread; documents that the wider group's quartiles weigh as.
SPREAD, EVIDENCE = 8.0, 100
SLACK = {"symbols": 0.02, "word_length": 1.0, "dup_lines": 0.2, "repeats": 0.1}
#: Items of a sketch's level; a group of no more documents is held exactly.
SKETCH_K = 1024


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: as the only element of an array that is mapped."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Each window has a 64-bit hash. Sorted by hash and place, equal hashes are neighbours, and the places of those that have an equal
    neighbour tell the words: a place covers three, less what the one before has covered. So a text of n words takes n log n steps.
    """

    def of_hashes(h: Column) -> Column:
        def of_places(q: Column) -> Column:
            at = lambda k: F.get(h, F.get(q, k))
            twice = F.filter(q, lambda x, k: F.coalesce(F.get(h, x) == at(k - 1), F.lit(False)) | F.coalesce(F.get(h, x) == at(k + 1), F.lit(False)))
            return _let(F.sort_array(twice), lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(s, k - 1), x - 3))), F.lit(0).cast("long"), lambda a, x: a + x))

        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(F.transform(keyed, lambda x: x["i"]), of_places)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(words, lambda w: _let(F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size(w) - 2), of_hashes)))


def measured(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and source with the counts. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), word_array(text).alias("w"), lines.alias("lines"))
    return base.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "word_length": F.col("word_chars") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def fences(counts: DataFrame) -> DataFrame:
    """(lang, source) with the least and greatest value of each measure, from sketches over all documents that have words.

    A group's quartiles are the mean of its own and those of its language, weighed by its documents and EVIDENCE; a language's are so drawn to the
    corpus's. So each document tells, at any number, and a group of very many goes by its own.
    """
    names = list(measures())
    sketches = counts.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias(k) for k, v in measures().items()))
    sketches = Scratch(counts.sparkSession).table(sketches)
    at = (0.25, 0.5, 0.75)

    def quartiles(df: DataFrame, end: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{c}{end}") for c in ("lang", "source") if c in df.columns), F.col("n").alias(f"n{end}"), *(F.array(*(F.kll_sketch_get_quantile_double(F.col(k), F.lit(r)) for r in at)).alias(f"{k}{end}") for k in names))

    merged = lambda *by: sketches.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(k).alias(k) for k in names))
    drawn = lambda own, n, to: F.zip_with(own, to, lambda a, b: (n * a + EVIDENCE * b) / (n + EVIDENCE))
    # One row for each language, and one for all; both are merged from the groups' sketches.
    by_lang = quartiles(merged("lang"), "_l").join(F.broadcast(quartiles(merged(), "_all")))
    by_lang = by_lang.select("lang_l", *(drawn(F.col(f"{k}_l"), F.col("n_l"), F.col(f"{k}_all")).alias(f"{k}_l") for k in names))
    df = quartiles(sketches, "_g").join(by_lang, F.col("lang_g").eqNullSafe(F.col("lang_l")))
    df = df.select("lang_g", "source_g", *(drawn(F.col(f"{k}_g"), F.col("n_g"), F.col(f"{k}_l")).alias(k) for k in names))
    out = []
    for k in names:
        low, mid, high = (F.get(F.col(k), F.lit(i)) for i in range(3))
        out += [(mid - SPREAD * (mid - low) - SLACK[k]).alias(f"{k}_least"), (mid + SPREAD * (high - mid) + SLACK[k]).alias(f"{k}_most")]
    return df.select(F.col("lang_g").alias("g_lang"), F.col("source_g").alias("g_source"), *out)


def judged(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, lang, source, text): the counts, base_failed and kept.

    Rows that repeat a doc_id are judged each by itself. A null lang or source is a group of its own; a document without words
    fails the base rules. Fences see every document; a group's size doesn't matter to any one task, as sketches are merged
    from partial ones.
    """
    counts = Scratch(docs.sparkSession).table(measured(docs))
    limits = fences(counts)
    joined = counts.join(small(limits), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = reduce(lambda a, b: a & b, (v.between(F.col(f"{k}_least"), F.col(f"{k}_most")) for k, v in measures().items()))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(False))).alias("kept"))


#: With quartiles over all rows, as sketches of up to SKETCH_K rows have them; for tables whose doc_ids don't repeat.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, hash(ws[i], ws[i + 1], ws[i + 2]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(3) t(k)) GROUP BY doc_id),
b AS MATERIALIZED (SELECT d.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
v AS MATERIALIZED (SELECT doc_id, lang, source, n_words, unnest(['symbols', 'word_length', 'dup_lines', 'repeats']) AS m, unnest([0.02, 1.0, 0.2, 0.1]::DOUBLE[]) AS slack,
    unnest([n_symbols / greatest(word_chars, 1), word_chars / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1)]) AS x FROM b),
f AS MATERIALIZED (SELECT * FROM v WHERE n_words > 0),
qa AS (SELECT m, list(x ORDER BY x) AS l, count(*) AS n FROM f GROUP BY m),
ql AS (SELECT lang, m, list(x ORDER BY x) AS l, count(*) AS n FROM f GROUP BY lang, m),
qg AS (SELECT lang, source, m, list(x ORDER BY x) AS l, count(*) AS n FROM f GROUP BY lang, source, m),
q AS (SELECT g.lang, g.source, g.m, r, (g.n * g.l[greatest(1, ceil(r * g.n))::INT] + 100 * (l.n * l.l[greatest(1, ceil(r * l.n))::INT] + 100 * a.l[greatest(1, ceil(r * a.n))::INT]) / (l.n + 100)) / (g.n + 100) AS x
    FROM qg g JOIN ql l ON l.lang IS NOT DISTINCT FROM g.lang AND l.m = g.m JOIN qa a ON a.m = g.m, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(r)),
e AS (SELECT lang, source, m, max(x) FILTER (WHERE r = 0.25) AS lo, max(x) FILTER (WHERE r = 0.5) AS mid, max(x) FILTER (WHERE r = 0.75) AS hi FROM q GROUP BY lang, source, m),
k AS (SELECT v.doc_id, bool_and(coalesce(v.x BETWEEN mid - 8 * (mid - lo) - slack AND mid + 8 * (hi - mid) + slack, false)) AS within FROM v LEFT JOIN e ON e.lang IS NOT DISTINCT FROM v.lang AND e.source IS NOT DISTINCT FROM v.source AND e.m = v.m GROUP BY v.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND within AS kept FROM b JOIN k ON k.doc_id = b.doc_id
"""
