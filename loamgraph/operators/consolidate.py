"""Duplicates, contradictions, merges and promotions among records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.operators import vectors
from loamgraph.operators.filters import RECORD_CATEGORIES

EXACT, FUZZY, DUPLICATE, CONTRADICTION, LENGTH_RATIO, PROMOTION = 1.0, 0.95, 0.85, 0.70, 5.0, 3
# Units with their kind and factor (seconds, bytes); words that do not tell a slot; marks of a negation; legal
# changes of status.
UNITS = {
    "second": ("time", 1.0), "sec": ("time", 1.0), "m": ("time", 0.001), "millisecond": ("time", 0.001), "minute": ("time", 60.0), "min": ("time", 60.0), "hour": ("time", 3600.0), "day": ("time", 86400.0),
    "month": ("time", 2_592_000.0), "year": ("time", 31_536_000.0), "byte": ("size", 1.0), "kb": ("size", 1024.0), "mb": ("size", 1_048_576.0), "gb": ("size", 1_073_741_824.0), "%": ("%", 1.0), "percent": ("%", 1.0),
}
WORDS, EPSILON = re.compile("[a-z]+"), 2.0**-52
QUANTITY = re.compile(
    r"(?:^|[^A-Za-z0-9.])(\d+(?:\.\d+)?)\s*(seconds?|secs?|minutes?|mins?|hours?|days?|months?|years?|ms|milliseconds?|kb|mb|gb|bytes?|%|percent|hops?|tokens?|chars?|queries|files?|tasks?|terms?|docs?|seeds?)?",
    re.ASCII,
)
SLOT_STOP = frozenset(
    "the a an is are to of in on by for with and or that this it its as be can will must should not no only each every all any at from after before when if then than so such".split()
)
NEGATIONS = [" not ", " never ", " wrong", " incorrect", " actually", "no "]
TRANSITIONS = {"active": ["stale", "rejected", "superseded"], "stale": ["active", "rejected", "superseded"], "rejected": ["pruned"], "superseded": ["pruned"], "pruned": []}
SLOT_CHARS, SLOT_SIMILARITY, TEXT_SIMILARITY = 45, 0.65, 0.4


def normalised_title(title: Column) -> Column:
    """Lower-case words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def title_matches(records: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(id, match_id, similarity): for every titled record the smallest other id of its type with the same title (1.0), else
    with the same normalised title (0.95), at `threshold` or more. One row per record, however many share a title."""
    rows = records.where("title is not null").select("id", "type", F.lower("title").alias("exact"), normalised_title(F.col("title")).alias("fuzzy"))
    pick = lambda c, score: _other(rows.where(F.col(c) != ""), c, f"{c}_id") if score >= threshold else None
    a, b = pick("exact", EXACT), pick("fuzzy", FUZZY)
    out = rows.select("id")
    for part in (a, b):
        out = out.join(part, "id", "left") if part is not None else out
    if a is None:
        return out.limit(0).select("id", F.lit(None).cast("string").alias("match_id"), F.lit(0.0).alias("similarity"))
    match = F.coalesce("exact_id", "fuzzy_id") if b is not None else F.col("exact_id")
    return out.select("id", match.alias("match_id"), F.when(F.col("exact_id").isNotNull(), EXACT).otherwise(FUZZY).alias("similarity")).where("match_id is not null")


def _other(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The smallest id besides its own of those that share (type, key); two ids per group are enough to know it."""
    first = rows.groupBy("type", key).agg(F.min("id").alias("first"))
    second = rows.join(first, ["type", key]).where("id <> first").groupBy("type", key).agg(F.min("id").alias("second"))
    pair = first.join(second, ["type", key])
    return rows.join(pair, ["type", key]).select("id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias(name))


def near_pairs(vecs: DataFrame, queries: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """(query_id, id, similarity) of unit vectors at `threshold` or more, of the k nearest if k is given."""
    found = vectors.nearest(vecs, queries, k, max_distance=(2 * (1 - threshold)) ** 0.5 + 1e-9)
    return found.select("query_id", "id", F.round(vectors.l2_to_cosine(F.col("distance")), 9).alias("similarity")).where(F.col("similarity") >= threshold)


def with_unit(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has a finite length above 0, scaled to length 1; rows with nulls inside are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b[column]
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(n)), n)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            norm = np.sqrt(np.bincount(owner, x * x, len(n)))
            row = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            good = np.isin(owner, row)
            kept = pa.array((x[good] / norm[owner[good]]).astype(np.float32))
            scaled = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[row])), pa.int32()), kept)
            yield pa.RecordBatch.from_arrays([scaled if c == column else b[c].take(pa.array(row)) for c in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {'array<float>' if c == column else k}" for c, k in rows.dtypes))


def duplicates(records: DataFrame, near: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(id, match_id, similarity, kind): the title match where there is one, else the nearest vector of the same type."""
    titles = title_matches(records, threshold).withColumn("kind", F.lit("title"))
    kinds = records.select("id", "type")
    best = near.join(kinds.select(F.col("id").alias("query_id"), "type"), "query_id").join(kinds, ["id", "type"])
    best = best.groupBy("query_id").agg(F.max(F.struct("similarity", F.col("id").alias("match_id"))).alias("b"))
    embedded = best.select(F.col("query_id").alias("id"), "b.match_id", "b.similarity", F.lit("embedding").alias("kind"))
    return titles.unionByName(embedded.join(titles.select("id"), "id", "left_anti"))


def merge_candidates(near: DataFrame, records: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """(survivor_id, superseded_id, similarity): near pairs of active observations, the older (ties: smaller id) survives."""
    live = records.where("type = 'observation' and status = 'active'").select("id", F.coalesce("created_us", F.lit(2**60)).alias("at"))
    pairs = near.where(F.col("similarity") >= threshold).join(live.select(F.col("id").alias("query_id"), F.col("at").alias("x")), "query_id").join(live.withColumnRenamed("at", "y"), "id")
    first = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("query_id") < F.col("id")))
    rows = pairs.select(F.when(first, F.col("query_id")).otherwise(F.col("id")).alias("survivor_id"), F.when(first, F.col("id")).otherwise(F.col("query_id")).alias("superseded_id"), "similarity")
    return rows.groupBy("survivor_id", "superseded_id").agg(F.max("similarity").alias("similarity"))


def merged_records(records: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, status, superseded_by): the records after the merges; a record superseded by several goes to the smallest."""
    into = merges.groupBy(F.col("superseded_id").alias("id")).agg(F.min("survivor_id").alias("superseded_by"))
    rows = records.select("id", "status").join(into, "id", "left")
    return rows.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


def promotions(edges: DataFrame, records: DataFrame, least: int = PROMOTION) -> DataFrame:
    """(id, n_supports): active observations with `least` supports or more that nothing else is derived from."""
    seen = edges.where("edge_type = 'derived_from' and source_id <> target_id").select(F.col("target_id").alias("id")).distinct()
    counts = edges.where("edge_type = 'supports'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_supports")).where(F.col("n_supports") >= least)
    live = records.where("type = 'observation' and status = 'active'").select("id")
    return counts.join(live, "id", "left_semi").join(seen, "id", "left_anti")


def category_typos(records: DataFrame) -> DataFrame:
    """(id, category, resembles): knowledge whose category is at most two edits from a dated category, or, used twice at most,
    from one that is used three times or more. The categories are grouped first; pairs are made of them, not of records."""
    rows = records.where("type = 'knowledge' and category is not null and status not in ('rejected', 'pruned', 'superseded')").select("id", "category", F.lower("category").alias("lower"))
    counts = rows.groupBy("lower").agg(F.count("*").alias("n"))
    dated = F.array(*map(F.lit, sorted(RECORD_CATEGORIES)))
    record_like = F.filter(dated, lambda c: F.levenshtein(F.col("lower"), c) <= 2)
    odd = counts.where(~F.col("lower").isin(RECORD_CATEGORIES)).withColumn("first", F.try_element_at(record_like, F.lit(1)))
    span = lambda c: F.explode(F.sequence(F.greatest(F.length(c) - 2, F.lit(0)), F.length(c) + 2))
    rare = odd.where("first is null and n <= 2").select("lower", span("lower").alias("size"))
    common = counts.where("n >= 3").select(F.col("lower").alias("other"), F.length("lower").alias("size"))
    near = rare.join(common, "size").where((F.col("lower") != F.col("other")) & (F.levenshtein("lower", "other") <= 2)).groupBy("lower").agg(F.min("other").alias("second"))
    flagged = odd.join(near, "lower", "left").select("lower", F.coalesce("first", "second").alias("resembles")).where("resembles is not null")
    return rows.join(flagged, "lower").select("id", "category", "resembles")


def illegal_transitions(versions: DataFrame) -> DataFrame:
    """(id, old_status, new_status, n) of changes between a record's successive versions (id, status, at) that the lattice of
    statuses does not allow. A record's versions are few; they are ordered by time, then status."""
    order = Window.partitionBy("id").orderBy("at", "status")
    steps = versions.withColumn("old_status", F.lag("status").over(order)).where("old_status is not null and old_status <> status")
    legal = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    bad = steps.where(~F.concat_ws(">", "old_status", "status").isin(legal))
    return bad.groupBy("id", "old_status", F.col("status").alias("new_status")).agg(F.count("*").alias("n"))


def has_negation(text: Column) -> Column:
    hits = [F.lower(text).contains(n) for n in NEGATIONS]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def mock_nli(premise: Column, hypothesis: Column) -> Column:
    """A deterministic stand-in for a model: struct(contradiction, entailment, neutral)."""
    probabilities = lambda c, e, n: F.struct(F.lit(c).alias("contradiction"), F.lit(e).alias("entailment"), F.lit(n).alias("neutral"))
    return F.when(F.lower(premise) == F.lower(hypothesis), probabilities(0.01, 0.98, 0.01)).when(has_negation(premise) != has_negation(hypothesis), probabilities(0.95, 0.02, 0.03)).otherwise(probabilities(0.05, 0.10, 0.85))


QUANTITIES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("near", T.ArrayType(T.StringType()))]))


@F.pandas_udf(QUANTITIES)
def quantities(texts: pd.Series) -> pd.Series:
    """The numbers of a text, each as (kind, value, near): kind and value by the table of units, `near` the words that end or
    begin less than SLOT_CHARS characters away. Null gives an empty list."""
    out = []
    for text in texts.fillna(""):
        spans = [(m.group(), *m.span()) for m in WORDS.finditer(text.lower())]
        ends, starts = np.array([e for _, _, e in spans], np.int64), np.array([b for _, b, _ in spans], np.int64)
        telling = np.array([len(w) > 2 and w not in SLOT_STOP for w, *_ in spans], bool)
        row = []
        for q in QUANTITY.finditer(text):
            kind, factor = UNITS.get((q[2] or "").lower().removesuffix("s"), ((q[2] or "").lower().removesuffix("s"), 1.0))
            left = (ends <= q.start(1)) & (ends > q.start(1) - SLOT_CHARS)
            right = (starts >= q.end()) & (starts < q.end() + SLOT_CHARS)
            row.append({"kind": kind, "value": float(q[1]) * factor, "near": sorted({spans[i][0] for i in np.flatnonzero((left | right) & telling)})})
        out.append(row)
    return pd.Series(out, dtype=object)


def _alike(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def telling_words(text: Column) -> Column:
    every = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))
    return F.filter(every, lambda w: (F.length(w) > 2) & ~w.isin(sorted(SLOT_STOP)))


def with_numeric_gate(pairs: DataFrame) -> DataFrame:
    """pairs (…, a_text, b_text) with `gate`: `contradiction` if the texts put different quantities into one slot, `equivalent`
    if they put equal ones, null if their numbers cannot be compared.

    Quantities of one kind are joined; two of them share a slot if the words near them are similar. A differing slot wins over
    an equal one. Without a common slot, texts of similar words are compared by their quantities of time, size and percent.
    """
    rows = pairs.withColumn("_a", quantities("a_text")).withColumn("_b", quantities("b_text"))
    met = lambda x, y: F.struct((F.abs(x["value"] - y["value"]) > EPSILON).alias("differs"), x["kind"].isin("time", "size", "%").alias("typed"), (_alike(x["near"], y["near"]) >= SLOT_SIMILARITY).alias("slot"))
    joined = F.flatten(F.transform("_a", lambda x: F.transform(F.filter("_b", lambda y: x["kind"] == y["kind"]), lambda y: met(x, y))))
    rows = rows.withColumn("_met", joined)
    some = lambda test: F.exists("_met", test)
    close = _alike(telling_words(F.col("a_text")), telling_words(F.col("b_text"))) >= TEXT_SIMILARITY
    gate = (
        F.when(some(lambda p: p["slot"] & p["differs"]), "contradiction")
        .when(some(lambda p: p["slot"]), "equivalent")
        .when(some(lambda p: p["typed"]) & close, F.when(some(lambda p: p["typed"] & p["differs"]), "contradiction").otherwise("equivalent"))
    )
    return rows.withColumn("gate", gate).drop("_a", "_b", "_met")


def contradictions(pairs: DataFrame) -> DataFrame:
    """pairs (a_id, b_id, a_text, b_text, cosine) with a verdict: `same` texts, `length` (ratio beyond 5), `far` (cosine below
    0.85, where known), the numeric gate's decision, else `contradiction` or `none` by the model. Cheap tests come first."""
    x, y = F.octet_length("a_text"), F.octet_length("b_text")
    ratio = F.greatest(x, y) / F.least(x, y)
    cheap = F.when(F.lower("a_text") == F.lower("b_text"), "same").when((x > 0) & (y > 0) & (ratio > LENGTH_RATIO), "length").when(F.col("cosine") < DUPLICATE, "far")
    rows = pairs.withColumn("verdict", cheap)
    decided = rows.where("verdict is not null")
    model = F.greatest(mock_nli(F.col("a_text"), F.col("b_text"))["contradiction"], mock_nli(F.col("b_text"), F.col("a_text"))["contradiction"])
    left = with_numeric_gate(rows.where("verdict is null"))
    left = left.withColumn("verdict", F.coalesce("gate", F.when(model >= CONTRADICTION, "contradiction").otherwise("none"))).drop("gate")
    return decided.unionByName(left)
