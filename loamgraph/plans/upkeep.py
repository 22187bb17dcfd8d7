"""Consolidation, drift and context packs as queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import norm_key
from loamgraph.functions.times import utc_micros
from loamgraph.operators import consolidate, context, drift, fusion, graph, vectors
from loamgraph.plans import model as m
from loamgraph.plans import retrieval as r
from loamgraph.plans.relational import _VOL_SQL
from loamgraph.sources.tables import table

query = m.Catalog()
DEDUP_NEIGHBOURS = 20
NEAR = 0.4  # no two of the 64-dimensional vectors reach the usual 0.85

# Consolidation.
_TITLE = "trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
query("con1_title_matches", m.sql("rec", f""", t as (select id, type, lower(title) as e, {_TITLE} as f from rec where title is not null)
select a.id, coalesce((select min(id) from t b where b.type = a.type and b.e = a.e and b.id <> a.id and a.e <> ''), (select min(id) from t b where b.type = a.type and b.f = a.f and b.f <> '' and b.id <> a.id)) as match_id,
case when (select min(id) from t b where b.type = a.type and b.e = a.e and b.id <> a.id and a.e <> '') is not null then 1.0 else 0.95 end::double as similarity from t a where match_id is not null"""))(lambda s, d: consolidate.title_matches(m.records(s, d)))
query("con12_near_duplicates", f"with {r._KNN} select query_id, id, round(1 - distance * distance / 2, 6) as similarity from pairs where round(1 - distance * distance / 2, 9) >= {NEAR}")(
    lambda s, d: consolidate.near_pairs(r.space(s, d), r.space(s, d).where("id % 20 = 0"), NEAR).withColumn("similarity", F.round("similarity", 6))
)
def observation_vectors(s, d):
    """Unit vectors of active observations, one per record."""
    live = m.records(s, d).where("type = 'observation' and status = 'active'").select("id")
    rows = table(s, d, "knowledge_embeddings").where("size(embedding) = 768").select(norm_key(F.col("entity_id")).alias("id"), "embedding").join(live, "id", "left_semi")
    return consolidate.with_unit(rows).groupBy("id").agg(F.first("embedding").alias("embedding"))


def near_observations(s, d):
    """All pairs at the threshold, as the SQL has them; the reference looks at 10 neighbours each."""
    from loamgraph.session import durable

    vecs = durable(observation_vectors(s, d))
    return consolidate.near_pairs(vecs, vecs, consolidate.DUPLICATE)


_OBS = """, obs as (select lower(trim(entity_id)) as id, any_value(embedding::double[]) as v from knowledge_embeddings where len(embedding) = 768 and not list_contains(list_transform(embedding, lambda x: isnan(x) or x is null), true) and list_sum(list_transform(embedding, lambda x: x * x)) > 0
  and lower(trim(entity_id)) in (select id from rec where type = 'observation' and status = 'active') group by 1),
near as (select a.id as query_id, b.id, list_cosine_similarity(a.v, b.v) as similarity from obs a join obs b on a.id <> b.id where list_cosine_similarity(a.v, b.v) >= 0.85),
old as (select id, coalesce(created_us, 1152921504606846976) as c from rec),
merges as (select distinct case when x.c < y.c or (x.c = y.c and query_id < near.id) then query_id else near.id end as survivor_id, case when x.c < y.c or (x.c = y.c and query_id < near.id) then near.id else query_id end as superseded_id from near join old x on x.id = query_id join old y on y.id = near.id)"""
query("con9_merge_candidates", m.sql("rec", _OBS + " select survivor_id, superseded_id from merges"))(lambda s, d: consolidate.merge_candidates(near_observations(s, d), m.records(s, d)).select("survivor_id", "superseded_id"))
query("con10_merged_records", m.sql("rec", _OBS + " select rec.id, case when sb.by is not null then 'superseded' else status end as status, sb.by as superseded_by from rec left join (select superseded_id, min(survivor_id) as by from merges group by 1) sb on sb.superseded_id = rec.id"))(
    lambda s, d: consolidate.merged_records(m.records(s, d), consolidate.merge_candidates(near_observations(s, d), m.records(s, d)))
)
_TYPED = """, owned as (select 'code_embeddings' as space, lower(trim(entity_id)) as id, embedding from code_embeddings union all select 'knowledge_embeddings', lower(trim(entity_id)), embedding from knowledge_embeddings),
vecs as (select owned.space, type, id, any_value(embedding::double[]) as v from owned join rec using (id) where status = 'active' and type is not null and len(embedding) = 768
  and not list_contains(list_transform(embedding, lambda x: isnan(x) or x is null), true) and list_sum(list_transform(embedding, lambda x: x * x)) > 0 group by all),
sims as (select a.space, a.type, a.id as query_id, b.id, list_cosine_similarity(a.v, b.v) as similarity from vecs a join vecs b on a.space = b.space and a.type = b.type and a.id <> b.id where list_cosine_similarity(a.v, b.v) >= 0.85),
few as (select * from sims qualify row_number() over (partition by space, query_id order by similarity desc, id) <= 20)"""
query("con2_embedding_duplicates", m.sql("rec", _TYPED + " select distinct query_id, id, type from few"))(lambda s, d: near_by_type(s, d, DEDUP_NEIGHBOURS).select("query_id", "id", "type"))
_CON3 = f"""{_TYPED}, t as (select id, type, lower(title) as e, {_TITLE} as f from rec where title is not null and status = 'active'),
exact as (select a.id, min(b.id) as match_id from t a join t b on b.type = a.type and b.e = a.e and b.id <> a.id and a.e <> '' group by 1), fuzzy as (select a.id, min(b.id) as match_id from t a join t b on b.type = a.type and b.f = a.f and b.f <> '' and b.id <> a.id group by 1),
titled as (select id, coalesce(exact.match_id, fuzzy.match_id) as match_id, case when exact.match_id is not null then 1.0 else 0.95 end as similarity from fuzzy full join exact using (id)),
best as (select query_id as id, max(struct_pack(s := round(similarity, 9), i := id)) as b from few group by 1)
select id, match_id, similarity::double as similarity, 'title' as kind from titled union all select id, b.i, round(b.s, 4), 'embedding' from best where id not in (select id from titled)"""
query("con3_duplicates", m.sql("rec", _CON3))(lambda s, d: consolidate.duplicates(m.records(s, d).where("status = 'active'"), near_by_type(s, d, DEDUP_NEIGHBOURS).drop("type")).withColumn("similarity", F.round("similarity", 4)))
query("con4_rejected_matches", m.sql("rec", f""", t as (select id, {_TITLE} as f, status, type from rec where title is not null) select a.id, min(b.id) as rejected_id, (select coalesce(stale_reason, category, 'rejected') from rec where rec.id = min(b.id)) as reason from t a join t b on b.f = a.f and b.type = a.type and b.status = 'rejected' and a.status = 'active' and a.f <> '' group by a.id"""))(lambda s, d: _rejected(s, d))


def _rejected(s, d):
    """Active records whose normalised title a rejected record of their type bears, with what that record says of itself: why it
    went stale, else its category."""
    rows = m.records(s, d).where("title is not null").select("id", "type", "status", consolidate.normalised_title(F.col("title")).alias("f")).where("f <> ''")
    bad = rows.where("status = 'rejected'").groupBy("type", "f").agg(F.min("id").alias("rejected_id"))
    why = m.records(s, d).select(F.col("id").alias("rejected_id"), F.coalesce("stale_reason", "category", F.lit("rejected")).alias("reason"))
    return rows.where("status = 'active'").join(bad, ["type", "f"]).join(why, "rejected_id").select("id", "rejected_id", "reason")


def active_vectors(s, d):
    """(space, type, id, embedding): unit vectors of active records, one per record and space."""
    live = m.records(s, d).where("status = 'active' and type is not null").select("id", "type")
    space = lambda t: table(s, d, t).where("size(embedding) = 768").select(F.lit(t).alias("space"), norm_key(F.col("entity_id")).alias("id"), "embedding")
    rows = space("code_embeddings").unionByName(space("knowledge_embeddings")).join(live, "id")
    return consolidate.with_unit(rows).groupBy("space", "type", "id").agg(F.first("embedding").alias("embedding"))


def near_by_type(s, d, k=None):
    """(query_id, id, similarity, type) of active records of one type and space: exact, the k nearest or all at the threshold."""
    from loamgraph.session import durable

    vecs = durable(active_vectors(s, d))
    parts = [vecs.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("similarity"), "type")]
    for space, kind in sorted(tuple(r) for r in vecs.select("space", "type").distinct().collect()):
        own = vecs.where((F.col("space") == space) & (F.col("type") == kind)).select("id", "embedding")
        parts.append(consolidate.near_pairs(own, own, consolidate.DUPLICATE, k).withColumn("type", F.lit(kind)))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("query_id", "id", "type").agg(F.max("similarity").alias("similarity"))


def type_candidates(s, d):
    """(a_id, b_id, type, cosine): all pairs, the smaller id first, of active records of one type at the cosine threshold."""
    near = near_by_type(s, d).where("query_id < id")
    return near.select(F.col("query_id").alias("a_id"), F.col("id").alias("b_id"), "type", F.col("similarity").alias("cosine"))


def with_texts(s, d, pairs):
    rec = m.records(s, d).select("id", "content")
    return pairs.join(rec.select(F.col("id").alias("a_id"), F.col("content").alias("a_text")), "a_id").join(rec.select(F.col("id").alias("b_id"), F.col("content").alias("b_text")), "b_id")


def contradiction_pairs(s, d):
    """Records that an edge says to contradict or support each other, with their texts; no cosine is known here."""
    e = m.edges(s, d).where("edge_type in ('contradicts', 'supports')").select(F.col("source_id").alias("a_id"), F.col("target_id").alias("b_id")).distinct()
    return with_texts(s, d, e).withColumn("cosine", F.lit(None).cast("double"))


def candidate_pairs(s, d):
    """The candidates by type with their texts and cosines, and the pairs of edges that are not among them."""
    from loamgraph.session import durable

    near = durable(type_candidates(s, d).select("a_id", "b_id", "cosine"))
    known = near.select(F.col("a_id").alias("x"), F.col("b_id").alias("y"))
    linked = contradiction_pairs(s, d)
    new = linked.join(known, (F.least("a_id", "b_id") == F.col("x")) & (F.greatest("a_id", "b_id") == F.col("y")), "left_anti")
    return with_texts(s, d, near).unionByName(new)


query("con6_candidates", m.sql("rec", _TYPED + " select distinct query_id as a_id, id as b_id, type from sims where query_id < id"))(lambda s, d: type_candidates(s, d).select("a_id", "b_id", "type"))
query("con7_contradictions", None)(lambda s, d: consolidate.contradictions(candidate_pairs(s, d)).select("a_id", "b_id", "verdict"))
query("con8_numeric_gate", None)(lambda s, d: consolidate.with_numeric_gate(candidate_pairs(s, d)).select("a_id", "b_id", F.col("gate").alias("decision")))
_FOUND = """, near as (select distinct query_id as a_id, id as b_id from sims where query_id < id), said as (select distinct source_id as a_id, target_id as b_id from edge where edge_type in ('contradicts', 'supports')),
cand as (select * from near union all select * from said where (least(a_id, b_id), greatest(a_id, b_id)) not in (select a_id, b_id from near))
select a_id, b_id from cand join rec x on x.id = a_id join rec y on y.id = b_id where lower(x.content) = lower(y.content)"""
query("con5_found_duplicates", m.sql("edge", _TYPED + _FOUND))(
    lambda s, d: candidate_pairs(s, d).where(F.greatest(*[consolidate.mock_nli(F.col(a), F.col(b))["entailment"] for a, b in (("a_text", "b_text"), ("b_text", "a_text"))]) >= 0.55).select("a_id", "b_id")
)
_NEG = " or ".join(f"contains(lower({{0}}), '{n}')" for n in consolidate.NEGATIONS)
query("con6_candidates_by_type", m.sql("edge", "select r.type, count(*) as n from edge join rec r on r.id = source_id join rec t on t.id = target_id where edge_type in ('contradicts', 'supports') and r.type = t.type and r.status = 'active' and t.status = 'active' group by 1"))(lambda s, d: _same_type(s, d))


def _same_type(s, d):
    live = m.records(s, d).where("status = 'active'").select("id", "type")
    e = m.edges(s, d).where("edge_type in ('contradicts', 'supports')").select("source_id", "target_id")
    rows = e.join(live.select(F.col("id").alias("source_id"), "type"), "source_id").join(live.select(F.col("id").alias("target_id"), "type"), ["target_id", "type"])
    return m.edges(s, d).where("edge_type in ('contradicts', 'supports')").select("source_id", "target_id", "edge_type").join(rows.distinct(), ["source_id", "target_id"]).groupBy("type").agg(F.count("*").alias("n"))


query("con15_mock_nli", m.sql("edge", f", p as (select distinct source_id as a_id, target_id as b_id from edge where edge_type in ('contradicts', 'supports')) select a_id, b_id, case when lower(a.content) = lower(b.content) then 0.01 when ({_NEG.format('a.content')}) <> ({_NEG.format('b.content')}) then 0.95 else 0.05 end::double as contradiction from p join rec a on a.id = a_id join rec b on b.id = b_id"))(
    lambda s, d: contradiction_pairs(s, d).select("a_id", "b_id", consolidate.mock_nli(F.col("a_text"), F.col("b_text"))["contradiction"].alias("contradiction"))
)
query("con5_confirmed_duplicates", m.sql("edge", "select distinct source_id as a_id, target_id as b_id from edge join rec a on a.id = source_id join rec b on b.id = target_id where edge_type in ('contradicts', 'supports') and lower(a.content) = lower(b.content)"))(
    lambda s, d: contradiction_pairs(s, d).where(consolidate.mock_nli(F.col("a_text"), F.col("b_text"))["entailment"] >= 0.55).select("a_id", "b_id")
)
query("con11_promotions", m.sql("edge", "select target_id as id, count(*) as n_supports from edge where edge_type = 'supports' and target_id in (select id from rec where type = 'observation' and status = 'active') and target_id not in (select target_id from edge where edge_type = 'derived_from' and source_id <> target_id) group by 1"))(
    lambda s, d: consolidate.promotions(m.edges(s, d), m.records(s, d), 1)
)
query("con13_category_typos", m.sql("rec", """, k as (select id, category, lower(category) as c from rec where type = 'knowledge' and category is not null and status not in ('rejected', 'pruned', 'superseded')), n as (select c, count(*) as n from k group by c),
rc as (select unnest(['benchmark', 'decision', 'decisions', 'incident', 'replay']) as r), f as (select c, coalesce((select min(r) from rc where levenshtein(c, r) <= 2), case when n <= 2 then (select min(o.c) from n o where o.n >= 3 and o.c <> n.c and levenshtein(o.c, n.c) <= 2) end) as resembles from n where c not in (select r from rc))
select id, category, resembles from k join f using (c) where resembles is not null"""))(lambda s, d: consolidate.category_typos(m.records(s, d)))


def versions(s, d):
    return table(s, d, "entities").select(norm_key(F.col("id")).alias("id"), norm_key(F.col("status")).alias("status"), utc_micros(F.col("updated_at")).alias("at"), "content_hash").where("id is not null and at is not null").distinct()


_VER = f"ver as (select distinct lower(trim(id)) as id, lower(trim(status)) as status, {m.us('updated_at')} as t, content_hash from entities where trim(id) <> '')"
query("con14_illegal_transitions", f"""with {_VER}, o as (select id, status, lag(status) over (partition by id order by t, status) as old_status from (select distinct id, status, t from ver))
select id, old_status, status as new_status, count(*) as n from o where old_status is not null and old_status <> status and old_status || '>' || status not in ({", ".join(f"'{a}>{b}'" for a, bs in consolidate.TRANSITIONS.items() for b in bs)}) group by all""")(
    lambda s, d: consolidate.illegal_transitions(versions(s, d).select("id", "status", "at").distinct())
)


# Drift. A reference's baseline is its target's hash as of the reference's time.
def declared(s, d):
    return m.all_edges(s, d).where("edge_type = 'references'").select(F.col("source_id").alias("id"), F.col("target_id").alias("ref_id"), F.col("created_us").alias("at"))


def verified(s, d):
    then = versions(s, d).where("content_hash is not null").select(F.col("id").alias("ref_id"), "at", F.col("content_hash").alias("hash"))
    return drift.baselines(declared(s, d), then)


_DRIFT = f""", {_VER}, refs as (select source_id as id, target_id as ref_id, e.c as t from edge0 where edge_type = 'references'),
base as (select refs.id, refs.ref_id, (select max(struct_pack(t := v.t, h := v.content_hash)) from ver v where v.id = refs.ref_id and v.t <= refs.t and v.content_hash is not null).h as verified_hash from refs),
living as (select id from rec where type in ('observation', 'rule', 'knowledge') and status in ('active', 'stale') and {_VOL_SQL} = 'living'),
drifted as (select b.id, b.ref_id, verified_hash, t.content_hash as current_hash, case when coalesce(t.status, 'missing') <> 'active' and coalesce(t.type not in ('observation', 'rule', 'knowledge'), true) then 'missing' when verified_hash is null then 'unverified' when verified_hash is distinct from t.content_hash then 'changed' end as cause
  from base b left join rec t on t.id = b.ref_id where b.id in (select id from living)),
dead as (select distinct id, ref_id from refs where ref_id not in (select id from rec where status = 'active' or type in ('observation', 'rule', 'knowledge')))"""
query("drf1_drift", m.sql("edge", _DRIFT + " select id, ref_id, verified_hash, current_hash, cause from drifted where cause is not null"))(lambda s, d: drift.drift(verified(s, d), m.records(s, d)))
query("agg8_drift_counts", m.sql("edge", _DRIFT + " select id, count(*) as n_drift from drifted where cause is not null group by id"))(lambda s, d: drift.drift_counts(drift.drift(verified(s, d), m.records(s, d))))
query("agg8_drifted_on", m.sql("edge", _DRIFT + " select ref_id, count(distinct id) as n_records from drifted where cause is not null group by ref_id"))(lambda s, d: drift.drifted_on(drift.drift(verified(s, d), m.records(s, d))))
query("joi4_drift_with_titles", m.sql("edge", _DRIFT + " select distinct d.id, coalesce(title, '') as title from drifted d left join rec using (id) where cause is not null"))(
    lambda s, d: drift.drift(verified(s, d), m.records(s, d)).select("id").distinct().join(m.records(s, d).select("id", "title"), "id", "left").select("id", F.coalesce("title", F.lit("")).alias("title"))
)
query("drf2_verified_maps", m.sql("edge", _DRIFT + " select id, string_agg(ref_id || '=' || verified_hash, ' ' order by ref_id) as entries from base where verified_hash is not null group by id"))(lambda s, d: _round_trip(s, d))


def _round_trip(s, d):
    """Baselines as arrays of `id=hash`, parsed and serialised again."""
    rows = verified(s, d).where("verified_hash is not null").groupBy("id").agg(F.collect_list(F.concat_ws("=", "ref_id", "verified_hash")).alias("entries"))
    return rows.select("id", F.array_join(drift.serialised_verified(drift.parse_verified(F.col("entries"))), " ").alias("entries"))


query("drf3_declared_references", m.sql("edge", """, decl as (select distinct source_id as id, target_id as ref_id from edge0 where edge_type = 'supports')
select id, ref_id from decl union all select distinct source_id, target_id from edge where edge_type = 'references' and source_id not in (select id from decl)"""))(
    lambda s, d: drift.declared_references(m.all_edges(s, d).where("edge_type = 'supports'").select(F.col("source_id").alias("id"), F.col("target_id").alias("ref_id")), m.edges(s, d))
)
query("drf4_edge_repairs", m.sql("edge", """, decl as (select distinct source_id as id, target_id as ref_id from edge0 where edge_type = 'supports') select id, ref_id from decl where ref_id in (select id from rec) and (id, ref_id) not in (select source_id, target_id from edge where edge_type = 'references')"""))(
    lambda s, d: drift.repairs(m.all_edges(s, d).where("edge_type = 'supports'").select(F.col("source_id").alias("id"), F.col("target_id").alias("ref_id")), m.edges(s, d), m.records(s, d))
)
query("drf5_backfill", m.sql("edge", _DRIFT + " select base.id, ref_id, content_hash as hash from base join rec on rec.id = ref_id where verified_hash is null and status = 'active' and content_hash is not null"))(lambda s, d: drift.backfill(verified(s, d), m.records(s, d)))
query("drf6_healed", m.sql("edge", _DRIFT + f" select id from rec where type in ('observation', 'rule', 'knowledge') and status = 'stale' and file_path is not null and ({_VOL_SQL} = 'record' or id not in (select id from dead))"))(
    lambda s, d: drift.healed(m.records(s, d).withColumn("stale_reason", F.lit(drift.ORPHANED)), declared(s, d))
)
query("drf7_newly_stale", m.sql("edge", _DRIFT + f" select id from rec where type in ('observation', 'rule', 'knowledge') and status = 'active' and file_path is not null and {_VOL_SQL} = 'living' and id in (select source_id from edge where edge_type in ('references', 'auto_references') and target_id in (select id from rec where status <> 'active'))"))(
    lambda s, d: drift.newly_stale(m.records(s, d), m.edges(s, d), m.records(s, d).where("status <> 'active'").select(F.col("id").alias("ref_id")))
)
query("drf8_reanchored", m.sql("rec", """, code as (select * from rec where space = 'code' and content_hash is not null), x as (select s.id as old_id, (select count(*) from code a where a.status = 'active' and a.content_hash = s.content_hash) as n, (select min(id) from code a where a.status = 'active' and a.content_hash = s.content_hash) as o,
(select count(*) from code a where a.status = 'active' and a.content_hash = s.content_hash and a.type = s.type and a.qualified_name = s.qualified_name) as k, (select min(id) from code a where a.status = 'active' and a.content_hash = s.content_hash and a.type = s.type and a.qualified_name = s.qualified_name) as p from code s where s.status = 'stale')
select old_id, case when n = 1 then o when k = 1 then p end as new_id from x where n = 1 or k = 1"""))(lambda s, d: drift.reanchored(m.records(s, d)))
query("drf9_verification", m.sql("edge", _DRIFT + f""", rr as (select distinct id, ref_id from refs), cnt as (select rr.id, count(*) as n, count(t.content_hash) as h from rr left join rec t on t.id = rr.ref_id group by rr.id), dd as (select id, count(*) as n from dead group by id)
select rec.id, coalesce(cnt.n, 0) as n_references, case when {_VOL_SQL} = 'record' then 0 else coalesce(h, 0) end as n_stamped, coalesce(dd.n, 0) as n_dead, status = 'stale' and ({_VOL_SQL} = 'record' or coalesce(dd.n, 0) = 0) as reactivated from rec left join cnt using (id) left join dd using (id) where type in ('observation', 'rule', 'knowledge') and file_path is not null"""))(
    lambda s, d: drift.verification(m.records(s, d), declared(s, d))
)


def snapshots(s, d):
    """The newest version of every record in the last export, and in those before it."""
    rows = table(s, d, "entities").select(norm_key(F.col("id")).alias("id"), "export_file", "file_path", "content_hash", norm_key(F.col("status")).alias("status"), utc_micros(F.col("updated_at")).alias("at")).where("id is not null")
    tagged = rows.withColumn("new", F.col("export_file") == rows.agg(F.max("export_file")).scalar())
    newest = tagged.groupBy("new", "id").agg(F.max(F.struct("at", F.coalesce("content_hash", F.lit("")).alias("hash"), "status", F.coalesce("file_path", F.lit("")).alias("file_path"))).alias("v")).select("new", "id", "v.hash", "v.status", F.expr("nullif(v.file_path, '')").alias("file_path"))
    return newest.where("not new"), newest.where("new")


_SNAP = f"""with sn as (select lower(trim(id)) as id, export_file = (select max(export_file) from entities) as new, max(struct_pack(a := {m.us('updated_at')}, h := coalesce(content_hash, ''), s := lower(trim(status)), f := coalesce(file_path, ''))) as v from entities where trim(id) <> '' group by all),
o as (select id, v.h as h, v.s as s, nullif(v.f, '') as f from sn where not new), n as (select id, v.h as h, nullif(v.f, '') as f from sn where new)"""
query("drf10_sync_changes", f"{_SNAP} select coalesce(o.id, n.id) as id, case when o.id is null then 'created' when n.id is null then 'removed' when o.s = 'stale' then 'reactivated' when o.h = n.h then 'skipped' else 'updated' end as change from o full join n on o.id = n.id")(lambda s, d: drift.snapshot_changes(*snapshots(s, d)))
query("src7_sync_counts", f"{_SNAP} select case when o.id is null then 'created' when n.id is null then 'removed' when o.s = 'stale' then 'reactivated' when o.h = n.h then 'skipped' else 'updated' end as change, count(*) as n from o full join n on o.id = n.id group by 1")(lambda s, d: drift.snapshot_changes(*snapshots(s, d)).groupBy("change").agg(F.count("*").alias("n")))
query("drf11_removed_in_files", f"{_SNAP} select id from o where f in (select f from n where f is not null) and id not in (select id from n)")(lambda s, d: drift.removed_in_files(*snapshots(s, d)))
query("fil11_verify_selection", m.sql("edge", _DRIFT + f" select id, case when id in (select id from drifted where cause is not null) then 'drifted' when status = 'stale' then 'stale' else 'all' end as selection from rec where file_path is not null and type in ('observation', 'rule', 'knowledge') and status in ('active', 'stale') and {_VOL_SQL} = 'living'"))(lambda s, d: _selection(s, d))


def _selection(s, d):
    from loamgraph.operators.filters import volatility_class

    rec = m.records(s, d)
    living = rec.where("file_path is not null and status in ('active', 'stale')").where(F.col("type").isin(m.KNOWLEDGE_TYPES) & (volatility_class(F.col("type"), F.col("volatility"), F.col("category")) == "living"))
    rows = living.join(drift.drift_counts(drift.drift(verified(s, d), rec)), "id", "left")
    return rows.select("id", F.when(F.col("n_drift").isNotNull(), "drifted").when(F.col("status") == "stale", "stale").otherwise("all").alias("selection"))


# Context packs over the merged result lists.
def sections(s, d):
    kinds = r.docs(s, d).select(F.col("doc_id").alias("id"), F.when(F.col("channel") == "code", "function").otherwise("knowledge").alias("source"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return r.merged(s, d).join(kinds, "id").select("query_id", "source", "id", "title", "content", F.col("score").alias("relevance"))


_SEC = f"""{r._MERGE}, sec as (select query_id, case when d.channel = 'code' then 'function' else 'knowledge' end as source, id, coalesce(d.title, '') as title, coalesce(d.text, '') as content, score as relevance from merged join docs d on d.doc_id = id),
pri as (select *, row_number() over (partition by query_id order by relevance desc, case source when 'knowledge' then 2 else 3 end, id) as rank, length(title) // 4 + length(content) // 4 as cost from sec)"""
BUDGET = 1000
query("ctx1_section_tokens", f"with {_SEC} select query_id, id, cost as tokens from pri")(lambda s, d: sections(s, d).select("query_id", "id", context.section_tokens(F.col("title"), F.col("content")).alias("tokens")))
query("ctx2_priority", f"with {_SEC} select query_id, id, rank from pri")(lambda s, d: context.priority(sections(s, d)).select("query_id", "id", "rank"))
query("ctx3_deduplicated", None)(lambda s, d: context.deduplicated(context.priority(sections(s, d))))
query("ctx3_overlapping", f"""with {_SEC}, ln as (select distinct query_id, id, trim(unnest(string_split(content, chr(10)))) as line from sec), l3 as (select * from ln where octet_length(encode(line)) > 3), n as (select query_id, id, count(*) as n from l3 group by all),
c as (select a.query_id, a.id, b.id as other_id, count(*) as c from l3 a join l3 b on a.query_id = b.query_id and a.line = b.line and a.id < b.id group by all)
select c.query_id, c.id, other_id, round(c / (x.n + y.n - c), 6) as overlap from c join n x on x.query_id = c.query_id and x.id = c.id join n y on y.query_id = c.query_id and y.id = other_id where c / (x.n + y.n - c) >= 0.5""")(
    lambda s, d: context.overlapping(sections(s, d)).withColumn("overlap", F.round("overlap", 6))
)
query("ctx4_fitted", f"""with {_SEC}, b as (select *, coalesce(sum(cost) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from pri),
f as (select *, case when before + cost <= {BUDGET} or cost = 0 then 'kept' when before < {BUDGET} then 'truncated' else 'dropped' end as fate, greatest({BUDGET} - before - length(title) // 4, 0) as room from b)
select query_id, id, rank, fate, length(case when fate <> 'truncated' then content when room = 0 then '' when length(content) <= room * 4 then content else substring(content, 1, cast(greatest(room * 4 - 3, 0) as integer)) || '...' end) as chars from f""")(
    lambda s, d: context.fitted(context.priority(sections(s, d)), BUDGET).select("query_id", "id", "rank", "fate", F.length("content").cast("bigint").alias("chars"))
)
_EX = "case when len(ls) <= {n} then content else array_to_string(ls[1:{n}], chr(10)) || chr(10) || '... (' || (len(ls) - {n}) || ' more lines)' end"
_LS = "case when content = '' then [] else string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') end as ls"
query("ctx5_tail_compressed", f"with {_SEC}, e as (select *, {_LS} from pri) select query_id, id, case when rank <= 5 then content when source = 'function' then {_EX.format(n=4)} else {_EX.format(n=8)} end as content from e")(
    lambda s, d: context.tail_compressed(context.priority(sections(s, d)).withColumn("rank", F.col("rank") + 15)).select("query_id", "id", "content")
)
query("ctx7_excerpts", f"with e as (select doc_id, text as content, {_LS} from documents where text is not null) select doc_id, {_EX.format(n=3)} as excerpt from e")(
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", context.excerpt(F.col("text"), F.lit(3)).alias("excerpt"))
)
query("ctx8_truncated", "select doc_id, case when length(text) <= 200 then text else substring(text, 1, 197) || '...' end as head from documents where text is not null")(
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", context.truncated(F.col("text"), F.lit(50)).alias("head"))
)
query("ctx9_summaries", f"with {_SEC}, e as (select *, {_LS} from pri) select query_id, id, case when source = 'function' then {_EX.format(n=10)} else content end as content from e")(lambda s, d: context.summarised(sections(s, d)).select("query_id", "id", "content"))
query("ctx10_baseline_rules", r._COLD.replace("select id, round(", "select id, round(").rstrip() + " where type = 'rule' and status = 'active' order by 2 desc, id limit 5")(
    lambda s, d: r.cold_scores(s, d).where("type = 'rule' and status = 'active'").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(5)
)


def cold_sections(s, d):
    """Sections of a pack without a query: the five best rules and an index of active knowledge by category."""
    scored = r.cold_scores(s, d).where("status = 'active'").withColumn("score", F.round("score", 6))
    best = scored.where("type = 'rule'").withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).where("n <= 5")
    index = scored.where("type = 'knowledge'").groupBy(F.coalesce("category", F.lit("other")).alias("title")).agg(F.count("*").alias("n"))
    return best.select(F.lit("rule").alias("source"), "id", F.coalesce("title", F.lit("")).alias("title"), "score").unionByName(index.select(F.lit("knowledge_index").alias("source"), F.col("title").alias("id"), "title", F.col("n").cast("double").alias("score")))


_COLD_ALL = r._COLD.replace("select id, round(", ", sc as (select id, type, status, title, category, round(", 1) + ")"
query("ctx11_cold_start_sections", _COLD_ALL.replace("\n, sc as", ",\nsc as") + """ select 'rule' as source, id, coalesce(title, '') as title, score from (select * from sc where type = 'rule' and status = 'active' order by score desc, id limit 5)
union all select 'knowledge_index', coalesce(category, 'other'), coalesce(category, 'other'), count(*)::double from sc where type = 'knowledge' and status = 'active' group by coalesce(category, 'other')""")(cold_sections)


def pointers(s, d):
    from loamgraph.session import durable

    kept = durable(context.fitted(context.priority(sections(s, d)), BUDGET).select("query_id", "source", "id", "title", "relevance", "cost", "fate"))  # read twice
    room = kept.where("fate <> 'dropped'").groupBy("query_id").agg(F.greatest(F.lit(BUDGET + 60) - F.least(F.sum("cost"), F.lit(BUDGET)), F.lit(0)).alias("available"))
    return context.pointer_index(kept.where("fate = 'dropped'"), room).select("query_id", "id", "rank")


query("ctx12_pointer_index", f"""with {_SEC}, b as (select *, coalesce(sum(cost) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from pri),
f as (select *, case when before + cost <= {BUDGET} or cost = 0 then 'kept' when before < {BUDGET} then 'truncated' else 'dropped' end as fate from b),
room as (select query_id, greatest({BUDGET + 60} - least(sum(cost), {BUDGET}), 0) as available from f where fate <> 'dropped' group by 1),
o as (select *, row_number() over (partition by query_id order by relevance desc, id) as n from f where fate = 'dropped'),
u as (select *, sum(length('- [' || source || '] ' || title || ' — id ' || id) // 4 + 1) over (partition by query_id order by n) as used from o where n <= 25)
select query_id, id, n as rank from u join room using (query_id) where used <= available - 3""")(pointers)
query("ctx13_packs", None)(lambda s, d: context.packs(sections(s, d), BUDGET * 2))

QUERIES, SQL = query.queries, query.sql
