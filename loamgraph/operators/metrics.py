"""Quality of retrieval against expected answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(results: DataFrame, expected: DataFrame, k: int = 5, floor: float = 0.05, packed: DataFrame | None = None) -> DataFrame:
    """One row per query: p_at_k, mrr, recall, negative_ok, and pack_recall if `packed` (query_id, id) is given.

    results: (query_id, id, rank, relevance, direct); expected: (query_id, id), id null for a query that expects nothing.
    Precision and reciprocal rank count direct results, recall all, pack recall what the pack holds; a query without
    expectations is ok if no direct result reaches the floor.
    """
    wanted = expected.where("id is not null").distinct()
    n = expected.groupBy("query_id").agg(F.countDistinct("id").alias("n"))
    hits = results.join(wanted, ["query_id", "id"], "left_semi")
    h = hits.groupBy("query_id").agg(
        F.countDistinct(F.when(F.col("direct") & (F.col("rank") <= k), F.col("id"))).alias("at_k"), F.min(F.when(F.col("direct"), F.col("rank"))).alias("first"), F.countDistinct("id").alias("found")
    )
    top = results.where(F.col("direct") & (F.col("relevance") >= floor)).groupBy("query_id").agg(F.count("*").alias("above"))
    rows = n.join(h, "query_id", "left").join(top, "query_id", "left")
    positive = F.col("n") > 0
    share = lambda c: F.when(positive, F.coalesce(c, F.lit(0)) / F.col("n")).otherwise(1.0)
    more = []
    if packed is not None:
        held = packed.join(wanted, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.countDistinct("id").alias("packed"))
        rows, more = rows.join(held, "query_id", "left"), [share("packed").alias("pack_recall")]
    return rows.select(
        "query_id",
        F.when(positive, F.coalesce("at_k", F.lit(0)) / k).alias("p_at_k"),
        F.when(positive, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        share("found").alias("recall"),
        F.when(~positive, F.coalesce("above", F.lit(0)) == 0).alias("negative_ok"),
        *more,
    )


def summary(rows: DataFrame) -> DataFrame:
    """Means over the queries, and the bounds of the mean reciprocal rank (interval())."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("p_at_k", "mrr", "recall", "pack_recall") if c in rows.columns]
    counts = {r.mrr: r.n for r in rows.where("mrr is not null").groupBy("mrr").agg(F.count("*").alias("n")).collect()}  # one row per rank
    low, high = interval(counts) or (None, None)
    bounds = [F.lit(v).cast("double").alias(c) for c, v in (("mrr_low", low), ("mrr_high", high))]
    return rows.agg(F.count("*").alias("n"), *means, F.round(F.avg(F.col("negative_ok").cast("double")), 6).alias("negative_ok")).select("*", *bounds)


def interval(counts: dict[float, int], rounds: int = 2000, seed: int = 0) -> tuple[float, float] | None:
    """Bounds of the middle 95 % of resampled means of values that occur `counts` times; None for fewer than two. Resampling
    draws how often each distinct value comes, so its cost does not grow with their number."""
    n = sum(counts.values())
    if n < 2:
        return None
    values = sorted(counts)
    drawn = np.random.default_rng(seed).multinomial(n, np.array([counts[v] for v in values]) / n, rounds)
    return tuple(round(float(x), 3) for x in np.quantile(drawn @ np.array(values) / n, (0.025, 0.975)))
