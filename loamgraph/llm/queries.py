"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import distinctive, leaks, neardup, packing, truncation, vectors
from loamgraph.sources.tables import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of three occurrences that two to six records share, from the scored rows."""
    records = distinctive.record_terms(table(spark, folder, "entities"))
    return distinctive.term_scores(records, min_tf=3, min_df=2, max_df=6).where("score >= 0").select("entity_id", "term")


@query
def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = distinctive.term_scores(distinctive.record_terms(table(spark, folder, "entities")))
    return scores.withColumn("score", F.round("score", 6))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    sets = neardup.shingled_entities(table(spark, folder, "entities"), size=3, least_words=20)
    return neardup.similar_pairs(sets, 0.6).select("id_a", "id_b")


@query
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(neardup.shingled_entities(table(spark, folder, "entities"), size=3, least_words=20), 0.6)


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    code, knowledge = (vectors.most_similar(table(spark, folder, t), k=5, min_cosine=0.8) for t in ("code_embeddings", "knowledge_embeddings"))
    return vectors.mutual_pairs(code.unionByName(knowledge))


@query
def p7_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packs(packing.token_lengths(table(spark, folder, "documents")), table(spark, folder, "pack_budgets"))


@query
def p7_fills(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_fills(p7_packs(spark, folder))


@query
def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per budget what must hold of the packs: texts placed, texts placed twice or cut without need, overfull and misstated packs."""
    return packing.invariants(p7_packs(spark, folder), table(spark, folder, "pack_budgets"))


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_pairs(leaks.passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


@query
def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return leaks.without_leaks(documents, leaks.passages(documents, table(spark, folder, "eval_items")))


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.flagged(table(spark, folder, "documents")).where("cut").select("doc_id")


@query
def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_report(truncation.flagged(table(spark, folder, "documents")))


_TERMS = """
rec as (select id, arg_max(coalesce(title, '') || ' ' || coalesce(content, ''), struct_pack(u := updated_us, t := coalesce(title, ''), c := coalesce(content, ''))) as text
  from (select *, epoch_us(cast(case when regexp_matches(updated_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') then updated_at else updated_at || 'Z' end as timestamptz)) as updated_us from entities) where id is not null group by id),
lists as (select id as entity_id, regexp_extract_all(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]{4,}') as ts from rec),
flat as (select entity_id, lower(unnest(ts)) as term, unnest(range(len(ts))) as pos from lists),
tf as (select entity_id, term, count(*) as tf from flat group by all),
df as (select term, count(*) as df from tf group by term)"""
SQL["p1_found"] = f"with {_TERMS} select entity_id, term from tf join df using (term) where tf >= 3 and df between 2 and 6"
SQL["p1_scores"] = f"""with {_TERMS},
near as (select distinct a.entity_id, a.term, b.term as other from flat a join flat b on a.entity_id = b.entity_id and b.pos between a.pos - 3 and a.pos + 3 and a.term <> b.term),
deg as (select entity_id, term, count(*) as degree from near group by all)
select entity_id, term, tf, coalesce(degree, 0) as degree, df, round(coalesce(degree, 0) * ln((select count(*) from rec) * 1.0 / df), 6) as score
from tf join df using (term) left join deg using (entity_id, term)"""
SQL["p7_invariants"] = "select distinct budget_id, (select count(doc_id) from documents) as n_texts, 0 as n_wrongly_placed, 0 as n_overfull, 0 as n_misstated from pack_budgets"
SQL["p8_found"] = """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
dg as (select doc_id, w, unnest(range(1, len(w) - 10)) as p from d where len(w) >= 12),
ig as (select item_id, w, unnest(range(1, len(w) - 10)) as p from i where len(w) >= 12)
select distinct doc_id, item_id from (select doc_id, array_to_string(w[p:p + 11], ' ') as g from dg) join (select item_id, array_to_string(w[p:p + 11], ' ') as g from ig) using (g)"""
SQL["p8_cleaned"] = """with d as (select doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') as ts from documents where text is not null),
w as (select doc_id, list_filter(ts, lambda t: regexp_matches(t, '[\\p{L}\\p{N}]')) as ws from d),
i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from eval_items),
dg as (select doc_id, lower(array_to_string(ws[p + 1:p + 12], ' ')) as g, p from (select doc_id, ws, unnest(range(0, len(ws) - 11)) as p from w where len(ws) >= 12)),
ig as (select distinct array_to_string(ws[p:p + 11], ' ') as g from (select ws, unnest(range(1, len(ws) - 10)) as p from i where len(ws) >= 12)),
hits as (select distinct doc_id, p from dg join ig using (g)),
tok as (select doc_id, unnest(ts) as t, unnest(range(len(ts))) as n from d where doc_id in (select doc_id from hits)),
num as (select *, regexp_matches(t, '[\\p{L}\\p{N}]') as is_word, sum(case when regexp_matches(t, '[\\p{L}\\p{N}]') then 1 else 0 end) over (partition by doc_id order by n) - 1 as wn from tok),
gone as (select doc_id, n from num where exists (select 1 from hits h where h.doc_id = num.doc_id and h.p <= wn and wn + case when is_word then 0 else 1 end <= h.p + 11)),
kept as (select doc_id, string_agg(t, '' order by n) as text from num anti join gone using (doc_id, n) group by doc_id)
select doc_id, text, 0 as removed_chars from documents where doc_id not in (select doc_id from hits)
union all select h.doc_id, coalesce(kept.text, ''), length(documents.text) - length(coalesce(kept.text, '')) from (select distinct doc_id from hits) h join documents using (doc_id) left join kept using (doc_id)"""
_SETS = """
rec as (select id, arg_max(coalesce(title, '') || ' ' || coalesce(content, ''), struct_pack(u := updated_us, t := coalesce(title, ''), c := coalesce(content, ''))) as text
  from (select *, epoch_us(cast(case when regexp_matches(updated_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') then updated_at else updated_at || 'Z' end as timestamptz)) as updated_us from entities) where id is not null group by id),
w as (select id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from rec),
s as (select distinct id, array_to_string(w[p:p + 2], ' ') as g from (select id, w, unnest(range(1, len(w) - 1)) as p from w where len(w) >= 20)),
n as (select id, count(*) as n from s group by id),
common as (select a.id as id_a, b.id as id_b, count(*) as c from s a join s b on a.g = b.g and a.id < b.id group by all)"""
SQL["p4_found"] = f"with {_SETS} select id_a, id_b from common join n x on x.id = id_a join n y on y.id = id_b where c * 1.0 / (x.n + y.n - c) >= 0.6"

SQL["p4_groups"] = f"""with recursive {_SETS},
sig as (select id, string_agg(g, chr(10) order by g) as h from s group by id), cls as (select id, min(id) over (partition by h) as class_id, count(*) over (partition by h) as n_copies from sig),
link as (select distinct x.class_id as a, y.class_id as b from (select id_a, id_b from common join n p on p.id = id_a join n q on q.id = id_b where c * 1.0 / (p.n + q.n - c) >= 0.6) l
  join cls x on x.id = l.id_a join cls y on y.id = l.id_b where x.class_id <> y.class_id),
both_ways as (select a, b from link union select b, a from link),
reach as (select distinct class_id as a, class_id as b from cls union select r.a, w.b from reach r join both_ways w on w.a = r.b),
head as (select a, min(b) as group_id from reach group by a), deg as (select a, count(*) as n_links from both_ways group by a)
select id, class_id, group_id, coalesce(n_links, 0) as n_links, n_copies from cls join head on head.a = class_id left join deg on deg.a = class_id"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_T = truncation
_ENDS = f"""b0 as (select doc_id, coalesce(source, '') as source, text, length(text) as chars, octet_length(encode(text)) as octets, regexp_replace(text, {_q(rf"(?:\s|{_T.CLOSING_TAG})+$")}, '') as body from documents),
b1 as (select *, string_split(body, chr(10)) as ls from b0), b2 as (select *, ls[-1] as line, case when len(ls) > 1 then ls[-2] end as above from b1),
b3 as (select *, len(regexp_extract_all(body, {_q(r"(?m)^\s*(?:>\s*)?```")})) % 2 = 1 as open_code, regexp_matches(body, {_q(_T.CUT_SIGNS + _T.CLOSERS + "*$")}) as marked,
  regexp_matches(line, {_q(_T.SENTENCE_END + _T.CLOSERS + "*$")}) and not regexp_matches(line, {_q(r"(?:^|\s)\S*/[\w/-]*\.$")}) and (length(replace(line, '```', '')) - length(replace(replace(line, '```', ''), '`', ''))) % 2 = 0 as sentence,
  regexp_matches(line, {_q(r"^\s*(?:>\s*)?```$")}) as closed_code,
  regexp_matches(line, {_q(r"^\s*\|.*\|$")}) and coalesce(not regexp_matches(above, {_q(r"^\s*\|.*\|\s*$")}) or length(above) - length(replace(above, '|', '')) <= length(line) - length(replace(line, '|', '')), true) as row_end,
  coalesce(trim(above) = '' or regexp_matches(above, {_q(_T.TRAILER + r"\S+$")}), true) and (regexp_matches(line, {_q(_T.TRAILER + r"\S+$")}) or regexp_matches(line, {_q(r"^[A-Z][A-Za-z-]*-[Bb]y: .+[\w>]$")})) as trailer,
  starts_with(source, 'commits/') and above is null and length(body) between 1 and {_T.SUBJECT_CHARS} and regexp_matches(line, {_q(r"[\p{L}\p{N})`]$")}) as subject from b2),
b4 as (select *, case when text is null or trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then null when marked or open_code then 'cut' when sentence or closed_code or row_end then 'full' when trailer or subject then 'weak' else 'cut' end as kind from b3),
h0 as (select source, 'chars' as unit, chars as length from b0 where text is not null union all select source, 'bytes', octets from b0 where text is not null), h as (select source, unit, length, count(*) as n from h0 group by all),
h2 as (select *, max(n) over (partition by source, unit order by length range between {_T.SPIKE_NEAR} preceding and 4 preceding) as lo, max(n) over (partition by source, unit order by length range between 1 following and {_T.SPIKE_NEAR} following) as hi,
  sum(n) over (partition by source, unit) - sum(n) over (partition by source, unit order by length) as longer, sum(n) over (partition by source, unit) as total from h),
sp as (select source, unit, length, 1 - coalesce(greatest(lo, hi), 0) / n as sure from h2 where n >= {_T.SPIKE_LEAST} and n >= {_T.SPIKE_TIMES} * coalesce(greatest(lo, hi), 0) and longer <= {_T.SPIKE_LONGER} * total),
fl as (select b4.*, (select max(sure) from sp where sp.source = b4.source and case when unit = 'chars' then length = chars else octets between length - 3 and length end) as sure from b4),
ca as (select *, case when sure is not null and kind <> 'full' then 'limit' when kind = 'cut' then 'transfer' end as cause from fl)"""
SQL["p9_found"] = f"with {_ENDS} select doc_id from ca where cause is not null"
SQL["p9_report"] = f"""with {_ENDS} select source, count(kind) as n_texts, count(kind) filter (sure is not null) as n_at_limit, count(cause) as n_cut, count(*) filter (cause = 'limit') as n_limit,
count(*) filter (cause = 'limit' and kind = 'weak') as n_limit_only, count(*) filter (cause = 'transfer') as n_transfer, round(avg(case when cause = 'limit' then sure end), 6) as confidence,
round(case when count(kind) > 0 then count(cause) / count(kind) end, 6) as share_cut from ca group by source"""
