"""References whose targets changed, vanished or were never verified; what follows from it for the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.filters import volatility_class

KNOWLEDGE = ["observation", "rule", "knowledge"]
ORPHANED = "code_orphaned"


def parse_verified(entries: Column) -> Column:
    """Map id -> hash of an array of `id=hash`; entries without `=` are left out, the last of an id wins."""
    listed = F.filter(F.coalesce(entries, F.array().cast("array<string>")), lambda e: e.contains("="))
    pairs = F.transform(listed, lambda e: F.struct(F.substring_index(e, "=", 1).alias("k"), F.regexp_extract(e, r"(?s)\A[^=]*=(.*)\z", 1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def serialised_verified(verified: Column) -> Column:
    return F.array_sort(F.transform(F.map_entries(verified), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def baselines(references: DataFrame, versions: DataFrame) -> DataFrame:
    """references (id, ref_id, at) with the target's hash as it was then: of its versions (ref_id, at, hash) the latest not
    after the reference, null if there is none. The join multiplies a reference by its target's versions only."""
    v = versions.select("ref_id", F.col("at").alias("then"), "hash")
    rows = references.join(v, "ref_id").where("then <= at").groupBy("id", "ref_id").agg(F.max(F.struct("then", "hash")).alias("b"))
    return references.join(rows.select("id", "ref_id", F.col("b.hash").alias("verified_hash")), ["id", "ref_id"], "left")


def drift(references: DataFrame, records: DataFrame) -> DataFrame:
    """(id, ref_id, verified_hash, current_hash, cause) of the references (id, ref_id, verified_hash) of living, active or
    stale knowledge that drifted.

    `missing`: no target, or one that is not active and no knowledge; `unverified`: no baseline; `changed`: another hash.
    """
    kind = volatility_class(F.col("type"), F.col("volatility"), F.col("category"))
    living = records.where(F.col("type").isin(KNOWLEDGE) & F.col("status").isin("active", "stale") & (kind == "living")).select("id")
    states = records.select(F.col("id").alias("ref_id"), F.col("status").alias("ref_status"), F.col("type").alias("ref_type"), F.col("content_hash").alias("current_hash"))
    rows = references.join(living, "id", "left_semi").join(states, "ref_id", "left")
    gone = (F.coalesce("ref_status", F.lit("missing")) != "active") & ~F.coalesce(F.col("ref_type").isin(KNOWLEDGE), F.lit(False))
    cause = F.when(gone, "missing").when(F.col("verified_hash").isNull(), "unverified").when(~F.col("verified_hash").eqNullSafe(F.col("current_hash")), "changed")
    return rows.select("id", "ref_id", "verified_hash", "current_hash", cause.alias("cause")).where("cause is not null")


def drift_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("n_drift"))


def drifted_on(rows: DataFrame) -> DataFrame:
    """(ref_id, n_records): how many records drifted because of each target."""
    return rows.groupBy("ref_id").agg(F.countDistinct("id").alias("n_records"))


def dead_references(references: DataFrame, records: DataFrame) -> DataFrame:
    """References (id, ref_id) whose target is absent, or not active and no knowledge."""
    alive = records.where((F.col("status") == "active") | F.col("type").isin(KNOWLEDGE)).select(F.col("id").alias("ref_id"))
    return references.select("id", "ref_id").distinct().join(alive, "ref_id", "left_anti")


def repairs(declared: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """Declared references (id, ref_id) to existing targets that have no edge yet."""
    have = edges.where("edge_type = 'references'").select(F.col("source_id").alias("id"), F.col("target_id").alias("ref_id"))
    return declared.select("id", "ref_id").distinct().join(have, ["id", "ref_id"], "left_anti").join(records.select(F.col("id").alias("ref_id")), "ref_id", "left_semi")


def declared_references(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ref_id): what records declare, and the reference edges of those that declare nothing."""
    fallback = edges.where("edge_type = 'references'").select(F.col("source_id").alias("id"), F.col("target_id").alias("ref_id"))
    return declared.select("id", "ref_id").distinct().unionByName(fallback.join(declared.select("id").distinct(), "id", "left_anti").distinct())


def backfill(references: DataFrame, records: DataFrame) -> DataFrame:
    """(id, ref_id, hash) to add as baselines: references without one whose target is active and has a hash."""
    live = records.where("status = 'active' and content_hash is not null").select(F.col("id").alias("ref_id"), F.col("content_hash").alias("hash"))
    return references.where("verified_hash is null").join(live, "ref_id").select("id", "ref_id", "hash")


def healed(records: DataFrame, references: DataFrame) -> DataFrame:
    """Ids of stale knowledge with a file and the orphan mark that may live again: dated records always, others if no
    reference is dead."""
    kind = volatility_class(F.col("type"), F.col("volatility"), F.col("category"))
    marked = records.where(F.col("type").isin(KNOWLEDGE) & (F.col("status") == "stale") & F.col("file_path").isNotNull() & (F.col("stale_reason") == ORPHANED)).select("id", kind.alias("kind"))
    dead = dead_references(references, records).select("id").distinct()
    return marked.where("kind = 'record'").select("id").unionByName(marked.where("kind = 'living'").select("id").join(dead, "id", "left_anti"))


def newly_stale(records: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of active, living knowledge with a file that refers to a changed target (ref_id)."""
    kind = volatility_class(F.col("type"), F.col("volatility"), F.col("category"))
    refs = edges.where("edge_type in ('references', 'auto_references')").select(F.col("source_id").alias("id"), F.col("target_id").alias("ref_id"))
    hit = refs.join(changed.select("ref_id").distinct(), "ref_id", "left_semi").select("id").distinct()
    return records.where(F.col("type").isin(KNOWLEDGE) & (F.col("status") == "active") & F.col("file_path").isNotNull() & (kind == "living")).join(hit, "id", "left_semi").select("id")


def reanchored(records: DataFrame) -> DataFrame:
    """(old_id, new_id): stale code whose hash one active record has, or, among several, one of the same type and qualified
    name."""
    code = records.where("space = 'code' and content_hash is not null")
    stale = code.where("status = 'stale'").select(F.col("id").alias("old_id"), "content_hash", F.col("type").alias("old_type"), F.col("qualified_name").alias("old_name"))
    live = code.where("status = 'active'").select(F.col("id").alias("new_id"), "content_hash", "type", "qualified_name")
    by_hash = live.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("new_id").alias("only_id"))
    by_name = live.groupBy("content_hash", F.col("type").alias("old_type"), F.col("qualified_name").alias("old_name")).agg(F.count("*").alias("m"), F.min("new_id").alias("named_id"))
    rows = stale.join(by_hash, "content_hash").join(by_name, ["content_hash", "old_type", "old_name"], "left")
    return rows.select("old_id", F.when(F.col("n") == 1, F.col("only_id")).when(F.col("m") == 1, F.col("named_id")).alias("new_id")).where("new_id is not null")


def verification(records: DataFrame, references: DataFrame, allow_dead: bool = False) -> DataFrame:
    """(id, n_references, n_stamped, n_dead, reactivated) of a verification of every knowledge record with a file.

    Stamps are the references to targets with a hash (none for dated records); stale records live again if they are dated or
    no reference is dead, or if dead ones are allowed."""
    kind = volatility_class(F.col("type"), F.col("volatility"), F.col("category"))
    base = records.where(F.col("type").isin(KNOWLEDGE) & F.col("file_path").isNotNull()).select("id", "status", kind.alias("kind"))
    refs = references.select("id", "ref_id").distinct()
    hashed = records.where("content_hash is not null").select(F.col("id").alias("ref_id"), F.lit(1).alias("hashed"))
    counts = refs.join(hashed, "ref_id", "left").groupBy("id").agg(F.count("*").alias("n_references"), F.count("hashed").alias("n_hashed"))
    dead = dead_references(references, records).groupBy("id").agg(F.count("*").alias("n_dead"))
    rows = base.join(counts, "id", "left").join(dead, "id", "left").fillna(0, ["n_references", "n_hashed", "n_dead"])
    stamped = F.when(F.col("kind") == "record", 0).otherwise(F.col("n_hashed")).cast("bigint")
    alive = (F.col("status") == "stale") & ((F.col("kind") == "record") | (F.col("n_dead") == 0) | F.lit(allow_dead))
    return rows.select("id", "n_references", stamped.alias("n_stamped"), "n_dead", alive.alias("reactivated"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) between two snapshots (id, hash, status): created, reactivated, skipped, updated or removed."""
    a, b = old.select("id", F.col("hash").alias("old_hash"), F.col("status").alias("old_status"), F.lit(1).alias("was")), new.select("id", F.col("hash").alias("new_hash"), F.lit(1).alias("is"))
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").when(F.col("old_status") == "stale", "reactivated").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "skipped").otherwise("updated")
    return both.select("id", change.alias("change"))


def removed_in_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of the old snapshot (id, file_path) whose file is in the new one while they are not."""
    return old.join(new.select("file_path").where("file_path is not null").distinct(), "file_path", "left_semi").join(new.select("id").distinct(), "id", "left_anti").select("id")
