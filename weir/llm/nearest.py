"""Nearest neighbours by randomly rotated one-bit codes.

The index holds for each vector the signs of its rotated direction, packed, its length, and the inner product of the
direction with its code. A query's inner product with the code, over that scalar, is an unbiased estimate of the one with the
vector; its error is bounded by the scalar and the dimension. In a block of vectors the k-th best exact score of those with the best estimates is
a threshold, and every vector whose upper bound reaches it is reranked with the original vectors in double precision. Nothing is fitted
but a random rotation from a fixed seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import Scratch, per_text

#: Multiple of the error's scale that the bounds allow for; vectors and queries of a block, at most about.
BOUND, BLOCK, QUERY_BLOCK = 2.2, 8192, 4096


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20_240_501 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and code products of the rows of x, none of them zero."""
    top = np.abs(x).max(1, keepdims=True)
    length = np.sqrt(((x / top) ** 2).sum(1)) * top[:, 0]
    turned = (x / length[:, None]) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, product: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the best k of the block for each query, best first, ties to the smaller id; `own` ids are left out."""
    dim = x.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dim).T / np.sqrt(dim)).astype(np.float32)
    scale = (length / product).astype(np.float32)
    error = (length * np.sqrt(np.maximum(0.0, 1 - product**2)) / product * (BOUND / np.sqrt(max(1, dim - 1)))).astype(np.float32)
    reach = np.sqrt((queries**2).sum(1))
    out = []
    for i in range(0, len(queries), 256):
        guess = (turned[i : i + 256] @ signs.T) * scale
        for j, row in enumerate(guess, i):
            near = np.flatnonzero(ids != own[j])
            if len(near) > 2 * k:
                # The k-th best exact score of the likeliest vectors is a lower bound of the k-th best of all.
                row[ids == own[j]] = -np.inf
                likely = np.argpartition(row, len(row) - 2 * k)[len(row) - 2 * k :]
                likely = likely[ids[likely] != own[j]]
                edge = np.sort(x[likely] @ queries[j])[-k]
                near = np.flatnonzero(row + error * reach[j] >= edge - 1e-6 * (abs(edge) + reach[j]))
                near = np.union1d(near, likely)
            score = x[near] @ queries[j]
            if len(near) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                near = near[score >= edge - 1e-9 * (abs(edge) + reach[j])]
            exact = (x[near] * queries[j]).sum(1)
            best = np.lexsort((ids[near], -exact))[:k]
            out.append((ids[near][best], exact[best]))
    return out


def usable(vector: Column) -> Column:
    """Neither null nor zero nor empty, and all components finite."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True)) & F.exists(vector, lambda v: v != 0)


INDEX = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("code", T.BinaryType()),
    T.StructField("length", T.DoubleType()), T.StructField("product", T.DoubleType()),
])


def index(vectors: DataFrame) -> DataFrame:
    """The index of vectors (vec_id, embedding), every usable row; rows that repeat a vec_id count as one, the least of them. Null ids take no part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))

    def run(batches):
        for b in batches:
            vectors = b.column("vector").to_pylist()
            for dim in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                codes, length, product = encode(np.array([vectors[i] for i in at]))
                yield {"vec_id": b.column("vec_id").take(pa.array(at)), "vector": b.column("vector").take(pa.array(at)), "code": [c.tobytes() for c in codes], "length": length, "product": product}

    return Scratch(vectors.sparkSession).table(per_text(rows, run, INDEX, rows=4096))


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def nearest(indexed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of the index to each of queries (vec_id, vector), by inner product.

    Vectors go to blocks by a hash of their ids, each block once for every block of queries and the other way round; a task
    holds one block of each. Vectors of another dimension than the query's are no candidates. Queries without candidates have
    no rows.
    """
    n, m = indexed.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    dim = F.size("vector").alias("dim")
    block = lambda by, of: F.pmod(F.xxhash64(F.col("vec_id")), F.lit(of)).cast("int").alias(by)
    every = lambda by, of: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(by)
    left = queries.select("vec_id", "vector", dim, block("qb", query_blocks), every("vb", blocks))
    right = indexed.select("vec_id", "vector", "code", "length", "product", dim, block("vb", blocks), every("qb", query_blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return schema.empty_table()
        own, ids = q.column("vec_id").to_numpy(), v.column("vec_id").to_numpy()
        codes = np.frombuffer(b"".join(v.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        found = search(matrix(q), own, matrix(v), ids, codes, v.column("length").to_numpy(), v.column("product").to_numpy(), k)
        return pa.table([np.repeat(own, [len(a) for a, _ in found]), np.concatenate([a for a, _ in found]), np.concatenate([s for _, s in found])], schema=schema)

    keys = ("dim", "qb", "vb")
    got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
