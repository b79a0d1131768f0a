"""Batches that Python workers get are bounded by bytes, as memory outside of the heap counts as well."""

from pyspark.sql import types as T

from weir.llm.common import BATCH_BYTES, per_text


def test_batches_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield {"n": [b.get_total_buffer_size()]}

    # One slice would be a whole batch: the buffers of slices are those of their batch.
    texts = spark.range(0, 20_000, 1, 1).selectExpr("repeat('x', 1000) AS text")
    got = per_text(texts, sizes, T.StructType([T.StructField("n", T.LongType())]), rows=1 << 20).collect()
    assert max(r.n for r in got) < 2 * BATCH_BYTES + (1 << 16)
