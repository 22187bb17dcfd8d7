"""What the engine writes: merged edge tables and JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "target_id", "edge_type"]


def upserted(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges after an upsert: a new edge of a known key changes its weight only; of several new ones the last by created_at."""
    last = new.groupBy(*KEY).agg(F.max(F.struct("created_at", "weight")).alias("n"))
    both = edges.join(last, KEY, "full_outer")
    return both.select(*KEY, F.coalesce("n.weight", "weight").alias("weight"), F.coalesce("created_at", "n.created_at").alias("created_at"))


def inserted(edges: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """edges and those new ones whose key is unknown and whose ends are among ids (id)."""
    known = ids.select("id").distinct()
    first = new.groupBy(*KEY).agg(F.min(F.struct("created_at", "weight")).alias("n")).select(*KEY, "n.weight", "n.created_at")
    fit = first.join(known, F.col("source_id") == known["id"], "left_semi").join(known, F.col("target_id") == known["id"], "left_semi")
    return edges.select(*KEY, "weight", "created_at").unionByName(fit.join(edges, KEY, "left_anti"))


def as_json(rows: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """(key, body): each key's rows as one JSON text `{"name": [...]}`, in order. The rows of a key are a bounded answer."""
    fields = [c for c in rows.columns if c != key]
    place = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    listed = place.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("row")))).alias("l"))
    return listed.select(key, F.to_json(F.struct(F.transform("l", lambda x: x["row"]).alias(name))).alias("body"))
