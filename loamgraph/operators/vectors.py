"""Exact vector search in blocks, and the signals drawn from its distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass; a block of them is broadcast, so its size is bounded by BLOCK times the dimensions.
BLOCK = 4096
#: Passes over all vectors; more queries than this many blocks hold are for an approximate index, and raise an error here.
MOST_PASSES = 256


def _matrix(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold finite vectors of `dims` numbers (None: of the most frequent length above 0), and the vectors."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if dims is None:
        dims = int(np.bincount(n[n > 0]).argmax()) if (n > 0).any() else 0
    rows = np.flatnonzero((n == dims) & (n > 0))
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.empty((0, max(dims, 1)))
    finite = np.isfinite(x).all(axis=1)
    return rows[finite], x[finite]


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None = 10, max_distance: float | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k vectors nearest to each query by Euclidean distance, itself excluded.

    vectors and queries: (id, embedding). Every partition keeps its k best per query (or all within `max_distance`, if k is
    None), which are merged; ties go by id, distances are compared to nine decimals. Nulls, other lengths than the block's
    and non-finite values are no vectors. The queries are taken in blocks of BLOCK against all vectors,
    so the cost is linear in both; beyond MOST_PASSES blocks it raises an error.
    """
    kind = dict(vectors.dtypes)["id"]
    schema = f"query_id {kind}, id {kind}, distance double"
    passes = []
    ordered = queries.select("id", "embedding")
    blocks = max(1, -(-ordered.count() // BLOCK))
    if blocks > MOST_PASSES:
        raise ValueError(f"exact search of more than {MOST_PASSES * BLOCK} queries would read all vectors {blocks} times")
    for b in range(blocks):
        block = ordered.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        rows, q = _matrix(block["embedding"].combine_chunks() if isinstance(block["embedding"], pa.ChunkedArray) else block["embedding"])
        ids = block["id"].to_numpy()[rows]
        narrow = q.astype(np.float32)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, narrow if (narrow == q).all() else q))  # half the size where nothing is lost

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            q = q.astype(np.float64)
            for batch in batches:
                rows, x = _matrix(batch["embedding"], q.shape[1])
                if not len(rows) or not len(ids):
                    continue
                own = batch["id"].to_numpy(zero_copy_only=False)[rows]
                square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
                square[ids[:, None] == own[None, :]] = np.inf
                near = square <= (np.inf if max_distance is None else max_distance * max_distance + 1e-6)
                if k is not None and k < x.shape[0]:
                    edge = np.partition(square, k - 1, axis=1)[:, k - 1 : k]
                    near &= square <= edge + 1e-6
                i, j = np.nonzero(near & np.isfinite(square))
                distance = np.sqrt(((q[i] - x[j]) ** 2).sum(1))
                keep = np.ones(len(i), bool) if max_distance is None else distance <= max_distance
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][keep]), pa.array(own[j][keep]), pa.array(np.round(distance[keep], 9))], ["query_id", "id", "distance"])

        passes.append(vectors.select("id", "embedding").mapInArrow(scan, schema))
    if not passes:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    found = reduce(DataFrame.unionByName, passes).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return found if k is None else found.where(F.col("rank") <= k)


def l2_to_cosine(distance: Column) -> Column:
    """Cosine of two unit vectors at a Euclidean distance."""
    return 1 - distance * distance / 2


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, 0 where one has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot, na, nb = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))), total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))), total(F.transform(b, lambda x: x.cast("double") * x.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (F.sqrt(na) * F.sqrt(nb))).otherwise(0.0)


def strength(lists: DataFrame) -> DataFrame:
    """(query_id, strength): mean cosine, clamped to [0, 1], of the three nearest of (query_id, distance, rank)."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), l2_to_cosine(F.col("distance"))))
    return lists.where("rank <= 3").groupBy("query_id").agg(F.avg(near).alias("strength"))


def gradient(lists: DataFrame) -> DataFrame:
    """(query_id, gradient): mean of 1 - d / largest d over the five nearest; 1 where all distances are 0."""
    top = lists.where("rank <= 5").groupBy("query_id").agg(F.max("distance").alias("far"), F.avg("distance").alias("mean"))
    return top.select("query_id", F.when(F.col("far") <= 0, 1.0).otherwise(1 - F.col("mean") / F.col("far")).alias("gradient"))


def missing_vectors(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids (id) without a vector (id, embedding)."""
    return ids.join(vectors.where(F.size("embedding") > 0).select("id").distinct(), "id", "left_anti")


def mean_pool(rows: DataFrame, key: str) -> DataFrame:
    """(key, position, value): mean of each key's unmasked vectors, scaled to length 1. rows: (key, embedding, mask)."""
    flat = rows.where("mask").select(key, F.posexplode("embedding").alias("position", "x"))
    mean = flat.groupBy(key, "position").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return mean.join(norm, key).select(key, "position", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("value"))


def mock_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for a model: the bits of a 64-bit hash of the text (the first of its SHA-256) as floats."""
    h = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.getbit(h, F.pmod(i, F.lit(64))).cast("float"))


def embed_once(texts: DataFrame, embed) -> DataFrame:
    """(…, embedding): every distinct text, by content hash, is embedded once. texts: (id, text); embed: Column -> Column."""
    hashed = texts.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    once = hashed.groupBy("hash").agg(F.first(F.coalesce("text", F.lit(""))).alias("one")).select("hash", embed(F.col("one")).alias("embedding"))
    return hashed.join(once, "hash").drop("hash")
