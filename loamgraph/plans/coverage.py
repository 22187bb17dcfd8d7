"""The remaining operators of the inventory as queries with their SQL."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import norm_key
from loamgraph.operators import consolidate, context, drift, fusion, mining, vectors
from loamgraph.plans import model as m
from loamgraph.plans import pipeline, upkeep
from loamgraph.plans import relational as rel
from loamgraph.plans import retrieval as r
from loamgraph.sources import code, markdown
from loamgraph.sources.tables import table

query = m.Catalog()

# Sources.
_EXT = "regexp_extract(file_path, '[.]([^./]*)$', 1) in ('rs', 'py', 'go', 'js', 'mjs', 'cjs', 'jsx', 'ts', 'tsx', 'sh', 'bash')"
query("src1_scanned_paths", m.sql("rec", f"select distinct file_path from rec where {_EXT} and not regexp_matches(file_path, '^tools/') and (not regexp_matches(file_path, '(^|/)docs/') or ends_with(file_path, '.py'))"))(
    lambda s, d: m.records(s, d).select("file_path").distinct().where(code.is_wanted(F.col("file_path"), ignore=["docs/"], deny=["tools/**"], allow=["*.py"]))
)
query("src3_capped_contents", m.sql("rec", "select id, octet_length(encode(content)) as n_bytes from rec where octet_length(encode(content)) <= 600"))(
    lambda s, d: m.records(s, d).select("id", F.octet_length("content").cast("bigint").alias("n_bytes")).where("n_bytes <= 600")
)
query("src4_markdown_files", m.sql("rec", "select type || '/' || id || '.md' as path, true as is_record from rec where space = 'knowledge' and title is not null"))(
    lambda s, d: markdown.read_records(pipeline.as_markdown(s, d)).select("path", F.col("error").isNull().alias("is_record"))
)


def validated(s, d) -> DataFrame:
    """Every knowledge row of the table as a file with its status as it was written: what is malformed says so."""
    rows = table(s, d, "entities").where("type in ('observation', 'rule', 'knowledge') and title is not null").select("id", "title", "type", "status").distinct()

    def write(batches):
        for b in batches:
            head = {"created_at": "2025-01-01T00:00:00Z", "updated_at": "2025-01-01T00:00:00Z"}
            yield pd.DataFrame([(x.id, f"---\n{markdown.serialise({'id': x.id, 'title': x.title, 'type': x.type, 'status': x.status} | head)}---\n") for x in b.itertuples()], columns=["path", "text"])

    return markdown.read_records(rows.mapInPandas(write, "path string, text string")).groupBy(F.col("error").isNull().alias("valid")).agg(F.count("*").alias("n"))


query("src6_validated_files", "select status in ('active', 'stale', 'rejected', 'superseded', 'pruned') as valid, count(*) as n from (select distinct id, title, type, status from entities where type in ('observation', 'rule', 'knowledge') and title is not null) group by 1")(validated)


def deleted(s, d) -> DataFrame:
    """Active knowledge whose path no row of the last export bears."""
    old, new = upkeep.snapshots(s, d)
    return old.where("status = 'active' and file_path is not null").join(new.select("file_path").distinct(), "file_path", "left_anti").select("id", "file_path")


query("src8_deleted_files", f"{upkeep._SNAP} select id, f as file_path from o where s = 'active' and f is not null and f not in (select f from n where f is not null)")(deleted)


def changed(s, d) -> DataFrame:
    """Files by the smallest hash of their records, before and in the last export."""
    snap = lambda df: df.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.min("hash").alias("hash"))
    old, new = upkeep.snapshots(s, d)
    return code.changed_files(snap(old), snap(new))


query("src9_changed_files", f"{upkeep._SNAP}, a as (select f as path, min(h) as h from o where f is not null group by 1), b as (select f as path, min(h) as h from n where f is not null group by 1) select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' else 'modified' end as change from a full join b on a.path = b.path where a.h is distinct from b.h")(changed)
COMMITS = 20_000  # a log is walked so far back
query("src10_commit_window", f"select o_orderkey as commit_id, count(l_partkey) as n_hunks from (select * from orders where o_orderstatus <> 'P' order by o_orderdate desc, o_orderkey limit {COMMITS}) left join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey group by 1")(
    lambda s, d: table(s, d, "orders").where("o_orderstatus <> 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(COMMITS).select(F.col("o_orderkey").alias("commit_id")).join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), "l_partkey").distinct(), "commit_id", "left").groupBy("commit_id").agg(F.count("l_partkey").alias("n_hunks"))
)

# Joins and aggregates.
query("joi2_cochange_with_files", m.sql("cochange", f"{rel._IDF} select term, entity_id, round(score, 6) as score, (select min(l_partkey) from lineitem where l_suppkey = entity_id) as file_id from idf"))(
    lambda s, d: rel.cochange_idf(m.cochange(s, d)).select("term", "entity_id", "score").join(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.min("l_partkey").alias("file_id")), "entity_id", "left")
)
query("joi5_delivered_if_exists", m.sql("rec ev", "select id, entity_id from ev where entity_id in (select id from rec)"))(
    lambda s, d: m.events(s, d).where("entity_id is not null").join(m.records(s, d).select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("id", "entity_id")
)
query("joi6_deliveries_without_hit", m.sql("delivery", "select delivery_id, kind from delivery where kind = 'pack' and delivery_id not in (select delivery_id from used where outcome = 'hit')"))(
    lambda s, d: m.deliveries(s, d).where("kind = 'pack'").join(m.usage(s, d).where("outcome = 'hit'").select("delivery_id").distinct(), "delivery_id", "left_anti").select("delivery_id", "kind")
)
query("joi9_vectors_within", f"with {r._KNN} select query_id, id from pairs where distance <= 1.2")(lambda s, d: vectors.nearest(r.space(s, d), r.space(s, d).where("id % 20 = 0"), None, 1.2).select("query_id", "id"))
query("joi11_saves_after_prompts", m.sql("rec ev", rel._SEG + " select anchor_id, path from after where n <= 25 and anchor_kind = 'prompt_submit'"))(
    lambda s, d: mining.saves_after(m.saves(s, d), m.saves(s, d).where("kind = 'prompt_submit'"))
)
query("joi12_fixes_by_tool", m.sql("ev", rel._CALLS + ", fx as (select e.id, e.tool, min(f.id) as fix_id from calls e join calls f on f.workspace = e.workspace and f.tool = e.tool and not f.failed and f.n between e.n + 1 and e.n + 20 where e.failed and e.tool <> '' group by all) select tool, count(*) as n_fixed from fx group by tool"))(
    lambda s, d: mining.error_fixes(m.saves(s, d)).groupBy("tool").agg(F.count("*").alias("n_fixed"))
)
query("agg6_recurring_use", m.sql("delivery", "select entity_id, count(*) as hits from used where outcome = 'hit' group by 1 having count(*) >= 12"))(lambda s, d: mining.recurring_use(m.usage(s, d), 12))
query("agg7_hot_indexed_files", m.sql("rec ev", f"select * from ({rel._HOT}) where path in (select file_path from rec where file_path is not null)"))(lambda s, d: mining.hot_files(m.saves(s, d), m.records(s, d)))

# Fusion, drift, context.
query("rnk5_pool_share", f"with {r._SIG} select query_id, round(share, 6) as share from pool")(lambda s, d: r.signals(s, d, r.ready(s, d)).select("query_id", F.round(fusion.pool_share(F.col("code_hits"), F.col("knowledge_hits")), 6).alias("share")))
query("rnk6_calibrated", f"with {r._SIG} select query_id, round(1 / (1 + exp(-(cs - 0.32) / 0.04)), 6) as code_presence, round(1 / (1 + exp(-(ks - 0.64) / 0.03)), 6) as knowledge_presence from sig")(
    lambda s, d: r.signals(s, d, r.ready(s, d)).select("query_id", *[F.round(fusion.logistic(F.col(f"{c}_strength"), *fusion.CALIBRATION[c]), 6).alias(f"{c}_presence") for c in ("code", "knowledge")])
)


def maintenance(s, d) -> DataFrame:
    """(step, name, n): the passes after indexing in their order, with the number of rows each would write."""
    rec, e, declared = m.records(s, d), m.durable_edges(s, d), upkeep.declared(s, d)
    checked = upkeep.verified(s, d)
    steps = {
        "declared": declared.select("id", "ref_id").distinct(),
        "reanchored": drift.reanchored(rec),
        "stale": drift.newly_stale(rec, e, rec.where("status <> 'active'").select(F.col("id").alias("ref_id"))),
        "repaired": drift.repairs(declared, e, rec),
        "backfilled": drift.backfill(checked, rec),
        "drift": drift.drift(checked, rec),
        "healed": drift.healed(rec, declared),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n") for i, (name, df) in enumerate(steps.items(), 1)])


query("drf12_maintenance", m.sql("edge", upkeep._DRIFT + f""", code as (select * from rec where space = 'code' and content_hash is not null),
re as (select s.id, (select count(*) from code a where a.status = 'active' and a.content_hash = s.content_hash) as n, (select count(*) from code a where a.status = 'active' and a.content_hash = s.content_hash and a.type = s.type and a.qualified_name = s.qualified_name) as k from code s where s.status = 'stale')
select 1 as step, 'declared' as name, (select count(*) from (select distinct id, ref_id from refs)) as n union all select 2, 'reanchored', (select count(*) from re where n = 1 or k = 1)
union all select 3, 'stale', (select count(*) from rec where type in ('observation', 'rule', 'knowledge') and status = 'active' and file_path is not null and {rel._VOL_SQL} = 'living' and id in (select source_id from edge where edge_type in ('references', 'auto_references') and target_id in (select id from rec where status <> 'active')))
union all select 4, 'repaired', (select count(*) from (select distinct id, ref_id from refs) where ref_id in (select id from rec) and (id, ref_id) not in (select source_id, target_id from edge where edge_type = 'references'))
union all select 5, 'backfilled', (select count(*) from base join rec on rec.id = ref_id where verified_hash is null and status = 'active' and content_hash is not null)
union all select 6, 'drift', (select count(*) from drifted where cause is not null)
union all select 7, 'healed', (select count(*) from rec where type in ('observation', 'rule', 'knowledge') and status = 'stale' and file_path is not null and stale_reason = 'code_orphaned' and ({rel._VOL_SQL} = 'record' or id not in (select id from dead)))"""))(maintenance)


def relaxed(s, d) -> DataFrame:
    """(query_id, id, chars): each question's sections summarised and grown again into a budget of 2,000 tokens."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        full = {x["id"]: x["content"] for x in rows if x["source"] in context.SUMMARY_LINES}
        short = [x | {"content": context._excerpt(x["content"], context.SUMMARY_LINES[x["source"]]) if x["source"] in context.SUMMARY_LINES else x["content"]} for x in rows]
        return pd.DataFrame([(x["query_id"], x["id"], len(x["content"])) for x in context.relaxed(short, full, 2000)], columns=["query_id", "id", "chars"])

    rows = context.priority(upkeep.sections(s, d)).select("query_id", "id", "source", "title", "content", "rank")
    return rows.groupBy("query_id").applyInPandas(run, "query_id bigint, id bigint, chars bigint")


query("ctx6_relaxed")(relaxed)
query("con2_nearest_observation", None)(lambda s, d: upkeep.near_observations(s, d).groupBy("query_id").agg(F.max(F.struct("similarity", "id")).alias("b")).select("query_id", "b.id", F.round("b.similarity", 6).alias("similarity")))
query("con1_title_groups", m.sql("rec", f"select {upkeep._TITLE} as title, type, count(*) as n from rec where title is not null group by all having count(*) > 1"))(
    lambda s, d: m.records(s, d).where("title is not null").groupBy(consolidate.normalised_title(F.col("title")).alias("title"), "type").agg(F.count("*").alias("n")).where("n > 1")
)
query("gra3_edge_ids", "select lower(trim(source_id)) as id, count(*) as n from edges where trim(source_id) <> '' group by 1")(lambda s, d: table(s, d, "edges").select(norm_key(F.col("source_id")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n")))

QUERIES, SQL = query.queries, query.sql
