"""References to records that do not exist, are deleted, or came only later.

Parents and references are range-partitioned by the same key in one exchange. In each range the parents form a sorted
array; the references come in batches and are probed by binary search. References are reduced to one row per (table,
field, day, id) before they move, so a key that holds a third of all references costs a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import norm_key
from loamgraph.functions.times import utc_day, utc_micros
from loamgraph.operators.records import latest_records

FOUND = "ref_table string, ref_field string, ref_day string, entity_id string, reason string"
NEVER = 2**62


def parent_states(entities: DataFrame) -> DataFrame:
    """(entity_id, deleted, created_us) per record; ids trimmed and lower-cased, the newest version wins."""
    rows = entities.withColumn("id", norm_key(F.col("id")))
    newest = latest_records(rows, ["status", "created_at"])
    return newest.select(
        F.col("id").alias("entity_id"),
        F.coalesce(F.lower(F.trim("status")) == "pruned", F.lit(False)).alias("deleted"),
        F.coalesce(utc_micros(F.col("created_at")), F.lit(-NEVER)).alias("created_us"),
    )


def references(tables: list[tuple[str, DataFrame, list[str], str]]) -> DataFrame:
    """Distinct references of (name, table, id fields, time field): ref_table, ref_field, ref_day, entity_id and the
    earliest usable time of the day. Null and blank ids are no references; unusable times fall under day `unknown`."""
    parts = []
    for name, df, fields, time in tables:
        at = utc_micros(F.col(time))
        pairs = F.array(*[F.struct(F.lit(f).alias("ref_field"), norm_key(F.col(f)).alias("entity_id")) for f in fields])
        rows = df.select(at.alias("at"), F.explode(pairs).alias("r"))
        parts.append(rows.select(F.lit(name).alias("ref_table"), "r.ref_field", F.coalesce(utc_day(F.col("at")), F.lit("unknown")).alias("ref_day"), "r.entity_id", "at"))
    rows = reduce(DataFrame.unionByName, parts).where("entity_id is not null")
    return rows.groupBy("ref_table", "ref_field", "ref_day", "entity_id").agg(F.min("at").alias("at"))


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range: first its parents in order, then its references."""
    keys, deleted, created = [], [], []
    parents = None
    for b in batches:
        own = b[b["ref_table"].isna()]
        if len(own):
            keys.append(own["entity_id"].to_numpy(object))
            deleted.append(own["deleted"].to_numpy(bool))
            created.append(own["at"].to_numpy(np.int64))
        refs = b[b["ref_table"].notna()]
        if not len(refs):
            continue
        if parents is None:
            parents = np.concatenate(keys) if keys else np.empty(0, object)
            gone = np.concatenate(deleted) if keys else np.empty(0, bool)
            born = np.concatenate(created) if keys else np.empty(0, np.int64)
        ids = refs["entity_id"].to_numpy(object)
        reason = np.full(len(refs), "missing", object)
        if len(parents):
            place = np.minimum(np.searchsorted(parents, ids), len(parents) - 1)
            hit = parents[place] == ids
            late = born[place] > refs["at"].fillna(NEVER).to_numpy(np.int64)
            reason[hit] = np.where(gone[place], "deleted", np.where(late, "later", ""))[hit]
        keep = reason != ""
        yield refs.loc[keep, ["ref_table", "ref_field", "ref_day", "entity_id"]].assign(reason=reason[keep])


def orphan_references(parents: DataFrame, refs: DataFrame) -> DataFrame:
    """References that miss, as (ref_table, ref_field, ref_day, entity_id, reason).

    Reason: `missing` (no such parent), else `deleted`, else `later` (the parent's creation lies after the reference's
    time, both usable). Empty parents make every reference missing; no references give no rows. Keys are compared by
    Unicode code points in Spark and Python alike, the array of a range is sorted by the engine's own order.
    """
    none = F.lit(None)
    both = parents.select(
        none.cast("string").alias("ref_table"), none.cast("string").alias("ref_field"), none.cast("string").alias("ref_day"), "entity_id", F.col("created_us").alias("at"), "deleted"
    ).unionByName(refs.select("ref_table", "ref_field", "ref_day", "entity_id", "at", F.lit(False).alias("deleted")))
    ranged = both.repartitionByRange("entity_id").sortWithinPartitions(F.col("ref_table").isNotNull(), "entity_id")
    return ranged.mapInPandas(_probe, FOUND)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, day and reason."""
    return found.groupBy("ref_table", "ref_field", "ref_day", "reason").agg(F.count("*").alias("n_ids"))
