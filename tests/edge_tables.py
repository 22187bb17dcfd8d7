"""Variants of the small tables: empty ones, and ones with clashing extra columns, rows of nulls and repeated rows."""

import os

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
CLASHING = ["key", "at", "n", "rank", "cid", "term", "terms", "best", "e", "w", "words", "kind", "part", "u", "v", "bucket", "end", "length", "limits", "field", "doc", "value", "x", "y", "hot", "score", "fill", "pack", "window", "tokens"]


def names():
    return sorted(f.split(".")[0] for f in os.listdir(SMALL))


def empty(spark, folder, tables):
    for t in tables:
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/{t}.parquet")


def cluttered(spark, folder, tables):
    """Extra columns, one row of nulls, every third row twice. None of this may change a result over distinct rows."""
    for t in tables:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        wide = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in df.columns])
        again = wide.where(F.pmod(F.xxhash64(*df.columns[:1]), F.lit(3)) == 0) if t not in ("documents", "eval_items", "pack_budgets") else wide.limit(0)
        nulls = wide.limit(1).select(*[F.lit(None).cast(k).alias(c) for c, k in wide.dtypes])
        wide.unionByName(again).unionByName(nulls).repartition(2).write.parquet(f"{folder}/{t}.parquet")


def rows(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())
