"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

A source's weight falls or rises over training; its integral over the whole time is the source's target. The documents of a
source, in the order of a digest of their ids, make up its supply of words, repeated up to three times. A document's place in
the supply, put through the inverse of the source's integrated schedule, is its training position, and all documents are
sorted by position over ranges. Places come from two levels of sums, so no task holds a source: sums of 4096 buckets of each
source, and sums inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import Scratch, small, temporary
from weir.llm.rules import word_array

#: Weights of the sources in code point order, repeating; how often a source may be taken; hexadecimal digits of a bucket.
WEIGHTS, MOST, DIGITS = (1, 2, 3), 3, 3
#: How far each weight tilts over time: a source begins at (1 + tilt) and ends at (1 - tilt) times its mean rate.
TILTS = (0.5, 0.0, -0.5)


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (index % len(values)).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, tilt) for each source of sizes (source, size).

    Sources fill up in the order of their limit over their weight. With all earlier ones at their limits, the rest share what
    is left by weight; the first source whose share is under its limit sets the level for itself and all later ones. One row a
    source takes part in the two windows.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    index = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.select("source", "source_size", index.alias("index")).withColumn("weight", _pick(WEIGHTS, F.col("index")).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "index")
    before, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    by = by.withColumn("level", left / F.sum("weight").over(later))
    full = MOST * F.col("source_size") <= F.col("level") * F.col("weight")
    by = by.withColumn("open", F.when(~full, F.col("level")))
    level = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(level.isNull(), (MOST * F.col("source_size")).cast("double")).otherwise(level * F.col("weight"))
    return by.select("source", "source_size", target.alias("target"), _pick(TILTS, F.col("index")).alias("tilt"))


def position(share: Column, tilt: Column) -> Column:
    """The time t in [0, 1] by which a source has given `share` of its target: t + tilt (t - t^2) = share."""
    root = ((1 + tilt) - F.sqrt(F.greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, F.lit(0.0)))) / (2 * tilt)
    return F.when(tilt == 0, share).otherwise(root)


def mixed(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, size, source_size, target, taken, and the columns source, tilt, place.

    place is the number of words of the source before the document. A null text has size 0 and nothing is taken of it. The
    last document of a source's last round is taken in part, so that a source's taken words are its target rounded down.
    Documents with one doc_id follow each other by size. Nothing is random.
    """
    size = F.size(word_array(F.coalesce("text", F.lit("")))).cast("long")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    sizes = sizes.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("key", 1, DIGITS))
    sizes = Scratch(docs.sparkSession).table(sizes)
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), ahead.alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("in_bucket", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & F.col("bucket").eqNullSafe(F.col("b_bucket")))
    wanted = small(targets(sizes).withColumnRenamed("source", "t_source"))
    placed = placed.join(wanted, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("place", F.col("ahead") + F.col("in_bucket"))
    goal = F.floor("target")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), goal - (e * F.col("source_size") + F.col("place")))) for e in range(MOST)), F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "tilt", "place")


def training_order(mix: DataFrame) -> DataFrame:
    """A row for each time that a document is taken: doc_id, round, words and position, sorted by position over ranges."""
    left = F.floor("target") - (F.col("round") * F.col("source_size") + F.col("place"))
    rows = mix.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("words", F.least(F.col("size"), left).cast("long")).where("words > 0")
    middle = (F.col("round") * F.col("source_size") + F.col("place") + F.col("words") / 2) / F.col("target")
    return rows.select("doc_id", "round", "words", position(middle, F.col("tilt")).alias("position")).orderBy("position", "doc_id", "round")


def sorted_mix(mix: DataFrame) -> DataFrame:
    """The documents by the position at which each is first taken; those that aren't taken follow, spread by their place."""
    first = position(F.least(F.lit(1.0), (F.col("place") + F.least("size", "taken") / 2) / F.greatest(F.col("target"), F.lit(1.0))), F.col("tilt"))
    spare = 1 + F.col("place") / F.greatest(F.col("source_size"), F.lit(1))
    return mix.withColumn("position", F.round(F.when(F.col("taken") > 0, first).otherwise(spare), 9)).orderBy("position", "doc_id")


def copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix takes it to the nearest whole number, in the order of training; rows that it doesn't take go.

    Rows are sorted by position over ranges, so that the written parts follow each other in training. Of rows with one doc_id, each is repeated
    as often as the mean of them is taken, from the place of the first. Null texts, and those without words, go. Extra columns may have any names.
    """
    head = F.min(F.struct("place", "size", "source_size", "target", "tilt")).alias("m")
    taken = mixed(docs).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), head).where("t > 0")
    id_, place, round_ = temporary(docs, "id", "place", "round")
    taken = taken.select(F.col("doc_id").alias(id_), F.floor(F.col("t") / F.col("s") + 0.5).cast("int").alias("times"), "m").where("times > 0").select(id_, F.struct("times", "m.*").alias(place))
    taken = Scratch(docs.sparkSession).table(taken)
    rows = docs.join(small(taken, 56), docs["doc_id"].cast("long").eqNullSafe(F.col(id_)))
    rows = rows.withColumn(round_, F.explode(F.sequence(F.lit(0), F.col(f"{place}.times") - 1)))
    middle = (F.col(round_) * F.col(f"{place}.source_size") + F.col(f"{place}.place") + F.col(f"{place}.size") / 2) / F.greatest(F.col(f"{place}.target"), F.lit(1.0))
    rows = rows.withColumn(place, position(F.least(F.lit(1.0), middle), F.col(f"{place}.tilt")))
    return rows.orderBy(place, id_, round_).select(*(docs[c] for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, (i % 3 + 1)::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY source_size / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, CASE WHEN 3 * source_size > level * weight THEN row_number() OVER (ORDER BY source_size / weight, i) END AS k FROM l),
t AS (SELECT source, source_size, CASE i % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE -0.5::DOUBLE END AS tilt, CASE WHEN k IS NULL THEN (3 * source_size)::DOUBLE ELSE (SELECT arg_min(level, k) FROM o) * weight END AS target FROM o),
p AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS place FROM d),
m AS (SELECT p.doc_id, p.size, t.source_size, t.target,
    (greatest(0, least(p.size, floor(t.target)::BIGINT - p.place)) + greatest(0, least(p.size, floor(t.target)::BIGINT - t.source_size - p.place))
    + greatest(0, least(p.size, floor(t.target)::BIGINT - 2 * t.source_size - p.place)))::BIGINT AS taken, p.place, t.tilt
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
h AS (SELECT *, least(1.0::DOUBLE, (place + least(size, taken) / 2) / greatest(target, 1.0::DOUBLE)) AS share FROM m)
SELECT doc_id, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN share
    ELSE ((1 + tilt) - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, 0::DOUBLE))) / (2 * tilt) END ELSE 1 + place / greatest(source_size, 1) END, 9) AS position
FROM h
"""
