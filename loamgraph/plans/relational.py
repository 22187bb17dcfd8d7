"""Filters, joins, aggregates and telemetry signals as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.functions import code
from loamgraph.functions.text import norm_key
from loamgraph.functions.times import utc_micros
from loamgraph.operators import filters, joining, mining
from loamgraph.plans import model as m
from loamgraph.sources.tables import table

query = m.Catalog()
#: A fixed "now" for operators that look back: 2025-05-01.
AS_OF_US = 1_746_057_600_000_000
SESSION_SINCE = "2001-07-15"


def _round(c, n=6):
    return F.round(c, n)


_BRIEF = "id, type, status, updated_us"
query("fil1_entity_filter", m.sql("rec edge", f"select {_BRIEF} from rec where type = 'knowledge' and status = 'active' and id in (select source_id from edge where edge_type = 'references') order by updated_us desc nulls last, id limit 20"))(
    lambda s, d: filters.entity_filter(m.records(s, d), "knowledge", "active", ids=m.edges(s, d).where("edge_type = 'references'").select(F.col("source_id").alias("id"))).select("id", "type", "status", "updated_us")
)
query("fil2_by_type_status", m.sql("rec", f"select {_BRIEF} from rec where type = 'function' and status = 'stale'"))(
    lambda s, d: filters.entity_filter(m.records(s, d), "function", "stale", limit=None).select("id", "type", "status", "updated_us")
)
query("fil3_rules_by_confidence", m.sql("rec", "select id, coalesce(confidence, 1.0) as claimed from rec where type = 'rule' and status = 'active'"))(lambda s, d: filters.by_confidence(m.records(s, d)).select("id", "claimed"))
query("fil4_knowledge_by_tag", m.sql("rec", "select id, category from rec where type = 'knowledge' and category = 'decision' and list_has_any(tags, ['release', 'cache'])"))(
    lambda s, d: filters.with_category_or_tag(m.records(s, d), "decision", ["release", "cache"]).select("id", "category")
)
_TEST_SQL = """case regexp_extract(file_path, '[.]([^./]*)$', 1)
 when 'rs' then starts_with(file_path, 'tests/') or contains(file_path, '/tests/') or file_path = 'tests.rs' or ends_with(file_path, '/tests.rs') or ends_with(file_path, '_tests.rs')
 when 'go' then ends_with(file_path, '_test.go')
 when 'py' then starts_with(file_path, 'tests/') or contains(file_path, '/tests/') or regexp_matches(file_path, '(^|/)test_[^/]+[.]py$') or regexp_matches(file_path, '[^/]_test[.]py$')
 when 'sh' then regexp_matches(file_path, '(^|/)test_[^/]+[.]sh$') or regexp_matches(file_path, '[^/]_test[.]sh$')
 when 'bash' then regexp_matches(file_path, '(^|/)test_[^/]+[.]bash$') or regexp_matches(file_path, '[^/]_test[.]bash$')
 else case when regexp_matches(file_path, '[.](js|mjs|cjs|jsx|ts|tsx)$') then contains(file_path, '/__tests__/') or regexp_matches(file_path, '[^/][.](test|spec)[.][a-z]+$') else false end end"""
query("fil5_test_paths", m.sql("rec", f"select id, file_path, coalesce({_TEST_SQL}, false) as is_test from rec where file_path is not null"))(
    lambda s, d: m.records(s, d).where("file_path is not null").select("id", "file_path", code.is_test_file(F.col("file_path")).alias("is_test"))
)
query("fil6_all_statuses", m.sql("rec", "select status, count(*) as n from rec group by status"))(lambda s, d: filters.entity_filter(m.records(s, d), status="all", limit=None).groupBy("status").agg(F.count("*").alias("n")))
query("fil7_records_of_file", m.sql("rec", "select id, file_path from rec where ends_with(file_path, '.tsx')"))(lambda s, d: filters.records_of_file(m.records(s, d), ".tsx").select("id", "file_path"))
query("fil8_status_of_targets", m.sql("edge", "select distinct target_id as id from edge where target_id in (select id from rec where status = 'active')"))(
    lambda s, d: m.edges(s, d).select(F.col("target_id").alias("id")).distinct().join(m.records(s, d).where("status = 'active'"), "id", "left_semi")
)
_VOL_SQL = "case when volatility in ('record', 'living') then volatility when type = 'observation' or (type = 'knowledge' and category in ('decision', 'decisions', 'benchmark', 'replay', 'incident')) then 'record' else 'living' end"
query("fil9_volatility", m.sql("rec", f"select type, {_VOL_SQL} as volatility_class, count(*) as n from rec where space = 'knowledge' group by all"))(
    lambda s, d: m.records(s, d).where("space = 'knowledge'").groupBy("type", filters.volatility_class(F.col("type"), F.col("volatility"), F.col("category")).alias("volatility_class")).agg(F.count("*").alias("n"))
)
query("fil10_prune_candidates", m.sql("rec", f"select id, status from rec where type = 'observation' and status in ('rejected', 'superseded') and file_path is not null and updated_us <= {AS_OF_US} - 30 * 86400000000"))(
    lambda s, d: filters.prune_candidates(m.records(s, d), AS_OF_US, 30).select("id", "status")
)
_SECRET_SQL = ["case when regexp_matches(t, '" + p.replace("'", "''") + f"') then '{k}' end" for k, p in filters.SECRETS]
query("fil12_secret_scan", m.sql("rec", f"select id, coalesce({', '.join(_SECRET_SQL)}) as kind from (select id, coalesce(title, '') || chr(10) || content as t from rec)"))(
    lambda s, d: m.records(s, d).select("id", filters.first_secret(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content"))).alias("kind"))
)
query("fil12_secrets_in_documents", f"select doc_id, coalesce({', '.join(_SECRET_SQL)}) as kind from (select doc_id, text as t from documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", filters.first_secret(F.col("text")).alias("kind"))
)
_REDACTED = "text"
for _kind, _pattern in filters.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '[redacted: {_kind}]', 'g')"
query("fil13_redacted", f"select doc_id, {_REDACTED} as text from documents")(lambda s, d: table(s, d, "documents").select("doc_id", filters.redact(F.col("text")).alias("text")))
_PIPE = r"(^|[^|])[|]\s*(sh|bash|zsh|dash|fish|ksh|csh|pwsh|powershell|python|python3|perl|ruby|node)([^\p{L}\p{N}_]|$)"
query("fil14_rule_lint", m.sql("rec", f"select id, concat_ws(',', case when contains(content, 'http://') or contains(content, 'https://') then 'URL' end, case when regexp_matches(content, '{_PIPE}') then 'pipe-to-shell' end) as markers from rec where type = 'rule'"))(
    lambda s, d: m.records(s, d).where("type = 'rule'").select("id", filters.rule_markers(F.col("content")).alias("markers"))
)
query("fil15_field_limits", m.sql("rec", "select id, concat_ws(',', case when length(title) > 200 then 'title' end, case when octet_length(encode(content)) > 262144 then 'content' end, case when len(tags) > 32 then 'tags' end) as broken from rec"))(
    lambda s, d: m.records(s, d).select("id", filters.field_limits(F.col("title"), F.col("content"), F.col("tags")).alias("broken"))
)
query("src2_languages", m.sql("rec", "select id, case regexp_extract(file_path, '[.]([^./]*)$', 1) when 'rs' then 'rust' when 'py' then 'python' when 'go' then 'go' when 'js' then 'javascript' when 'mjs' then 'javascript' when 'cjs' then 'javascript' when 'jsx' then 'javascript' when 'ts' then 'typescript' when 'tsx' then 'tsx' when 'sh' then 'bash' when 'bash' then 'bash' end as lang from rec where file_path is not null"))(
    lambda s, d: m.records(s, d).where("file_path is not null").select("id", code.language(F.col("file_path")).alias("lang"))
)
query("src11_last_provenance", m.sql("rec", "select file_path, arg_max(id, struct_pack(u := updated_us, i := id)) as last_id, max(updated_us) as last_us from rec where file_path is not null and updated_us is not null group by file_path"))(
    lambda s, d: m.records(s, d).where("file_path is not null and updated_us is not null").groupBy("file_path").agg(F.max_by("id", F.struct("updated_us", "id")).alias("last_id"), F.max("updated_us").alias("last_us"))
)
query("src12_batch_get", m.sql("rec edge", "select id, title from rec where id in (select target_id from edge where edge_type = 'supports')"))(
    lambda s, d: m.records(s, d).join(m.edges(s, d).where("edge_type = 'supports'").select(F.col("target_id").alias("id")).distinct(), "id", "left_semi").select("id", "title")
)
_ORD = "(select entity_id as id, min(id) as ordinal from ev where entity_id is not null and kind = 'prompt_submit' group by entity_id)"
query("src13_ordered_batch", m.sql("rec ev", f"select id, title, row_number() over (order by ordinal, id) as position from {_ORD} join rec using (id)"))(lambda s, d: _ordered(s, d))


def _ordered(s, d):
    """Records in the order in which prompts named them first. Positions come from a running sum over ranges."""
    from loamgraph.operators.ordered import running_sum

    first = m.events(s, d).where("entity_id is not null and kind = 'prompt_submit'").groupBy(F.col("entity_id").alias("id")).agg(F.min("id").alias("ordinal"))
    rows = m.records(s, d).join(first, "id").withColumn("all", F.lit(0)).withColumn("place", F.struct("ordinal", "id"))
    return running_sum(rows.select("id", "title", "all", "place"), "all", "place", F.lit(1), "position").select("id", "title", "position")


# Sinks as the rows they would write.
query("snk1_upserted_edges", m.sql("rec edge", "select source_id, target_id, edge_type, weight from edge0, lateral (select e.w as weight)"))(lambda s, d: m.all_edges(s, d).select("source_id", "target_id", "edge_type", "weight"))
query("snk2_edges_with_ends", m.sql("edge", "select source_id, target_id, edge_type, weight from edge"))(lambda s, d: m.edges(s, d).select("source_id", "target_id", "edge_type", "weight"))
query("snk3_tombstones", m.sql("rec", "select id, case when status = 'pruned' then null else title end as title, case when status = 'pruned' then '' else content end as content from rec"))(
    lambda s, d: m.records(s, d).select("id", F.when(F.col("status") != "pruned", F.col("title")).alias("title"), F.when(F.col("status") == "pruned", "").otherwise(F.col("content")).alias("content"))
)

# Joins.
query("joi3_reference_states", m.sql("edge", "select source_id, target_id, coalesce(r.status, 'missing') as target_status from (select distinct source_id, target_id from edge0 where edge_type = 'references') left join rec r on r.id = target_id"))(
    lambda s, d: m.all_edges(s, d).where("edge_type = 'references'").select("source_id", "target_id").distinct().join(m.records(s, d).select(F.col("id").alias("target_id"), "status"), "target_id", "left").select("source_id", "target_id", F.coalesce("status", F.lit("missing")).alias("target_status"))
)
query("joi7_file_siblings", m.sql("edge", """, c as (select source_id as file, target_id as member from edge where edge_type = 'contains'), a as (select member as anchor, file from c union select file, file from c)
select distinct a.anchor, c.member as sibling from a join c using (file)"""))(lambda s, d: joining.siblings(m.edges(s, d)))
_SPANS = "select file_path, id, line_start, line_end from rec where type in ('function', 'class') and line_start is not null and line_end is not null and file_path is not null"


def _hunks(s, d):
    """Hunks of the newest versions against the functions and classes: every record's own lines, moved by ten, as a hunk."""
    spans = m.records(s, d).where("type in ('function', 'class') and line_start is not null and line_end is not null and file_path is not null").select("file_path", "id", "line_start", "line_end")
    hunks = spans.select("file_path", F.col("id").alias("hunk_id"), (F.col("line_start") + 10).alias("hunk_start"), (F.col("line_start") + 40).alias("hunk_end"))
    return joining.interval_overlap(hunks, spans, "file_path", ("hunk_start", "hunk_end"), ("line_start", "line_end")).select("hunk_id", "id")


query("joi8_hunk_overlap", m.sql("rec", f", sp as ({_SPANS}) select h.id as hunk_id, s.id from sp h join sp s on s.file_path = h.file_path and s.line_start <= s.line_end and s.line_start <= h.line_start + 40 and s.line_end >= h.line_start + 10"))(_hunks)


def _mentions(s, d):
    live = m.records(s, d).where("status = 'active'")
    texts = live.where("space = 'knowledge'").select(F.col("id").alias("source_id"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content")).alias("text"))
    named = live.where("space = 'code' and title <> ''")
    unique = named.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("target_id")).where("n = 1")
    paths = live.where("type = 'file' and file_path <> ''").groupBy("file_path").agg(F.max("id").alias("target_id"))
    patterns = unique.select(F.col("title").alias("pattern"), "target_id", F.lit(False).alias("is_path")).unionByName(paths.select(F.col("file_path").alias("pattern"), "target_id", F.lit(True).alias("is_path")))
    return joining.mentions(texts, patterns)


query("joi10_mentions", None)(_mentions)
query("joi13_resolved_names", m.sql("rec", """, names as (select title as name, count(*) as n, min(id) as tid from rec where space = 'code' and title is not null group by title having count(*) = 1),
raw as (select id, qualified_name as raw_name from rec where qualified_name is not null)
select raw.id, raw_name, coalesce(a.tid, b.tid) as target_id from raw left join names a on a.name = raw_name left join names b on b.name = string_split(raw_name, '::')[-1]"""))(
    lambda s, d: joining.resolve_names(m.records(s, d).where("qualified_name is not null").select("id", F.col("qualified_name").alias("raw_name")), m.records(s, d).where("space = 'code'").select(F.col("title").alias("name"), "id")).select("id", "raw_name", "target_id")
)

# Aggregates.
query("agg1_by_type", m.sql("rec", "select type, count(*) as n from rec group by type"))(lambda s, d: m.records(s, d).groupBy("type").agg(F.count("*").alias("n")))
query("agg2_counts", m.sql("rec", "select status, space, count(*) as n from rec group by all"))(lambda s, d: m.records(s, d).groupBy("status", "space").agg(F.count("*").alias("n")))
_CUR = "('references', 'supports', 'contradicts', 'superseded_by', 'derived_from', 'promoted_from')"
query("agg3_curated_in_degree", m.sql("edge", f"select target_id as id, count(*) as in_degree from edge where edge_type in {_CUR} group by 1"))(
    lambda s, d: m.edges(s, d).where(F.col("edge_type").isin(m.CURATED)).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))
)
_hits = lambda kind: F.sum(F.when(F.col("outcome") == kind, 1).otherwise(0))
query("agg4_hit_rate_by_tier", m.sql("delivery", "select tier, count(*) filter (outcome = 'hit') as hits, count(*) filter (outcome = 'miss') as misses, round(count(*) filter (outcome = 'hit') / nullif(count(*) filter (outcome <> 'pending'), 0), 6) as hit_rate from used group by tier"))(
    lambda s, d: m.usage(s, d).groupBy("tier").agg(_hits("hit").alias("hits"), _hits("miss").alias("misses")).withColumn("hit_rate", _round(F.col("hits") / F.expr("nullif(hits + misses, 0)")))
)
query("agg4_hit_rate_by_type", m.sql("delivery", "select p_brand as entity_type, count(*) filter (outcome = 'hit') as hits, count(*) filter (outcome = 'miss') as misses from used join part on p_partkey = entity_id group by p_brand"))(
    lambda s, d: m.usage(s, d).join(table(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("entity_type")), "entity_id").groupBy("entity_type").agg(_hits("hit").alias("hits"), _hits("miss").alias("misses"))
)
query("agg5_usage_summary", m.sql("delivery", "select kind, count(*) filter (outcome = 'hit') as hits, count(*) filter (outcome = 'miss') as misses, count(*) filter (outcome = 'pending') as pending, count(distinct entity_id) filter (outcome = 'hit') as hit_entities from used join delivery using (delivery_id) group by kind"))(
    lambda s, d: m.usage(s, d).join(m.deliveries(s, d), "delivery_id").groupBy("kind").agg(_hits("hit").alias("hits"), _hits("miss").alias("misses"), _hits("pending").alias("pending"), F.countDistinct(F.when(F.col("outcome") == "hit", F.col("entity_id"))).alias("hit_entities"))
)
query("agg9_key_files", m.sql("edge", f"""select id, n from (select rec.id, file_path, n from (select source_id, count(*) as n from edge where edge_type = 'contains' group by 1) join rec on rec.id = source_id where status = 'active' order by n desc, rec.id limit 50)
where not coalesce({_TEST_SQL}, false) order by n desc, id limit 15"""))(lambda s, d: key_files(s, d))


def key_files(s, d):
    """The active files that contain most: of the first 50 those that are no tests, 15 at most."""
    n = m.edges(s, d).where("edge_type = 'contains'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    top = n.join(m.records(s, d).where("status = 'active'").select("id", "file_path"), "id").orderBy(F.desc("n"), "id").limit(50)
    return top.where(~code.is_test_file(F.col("file_path"))).orderBy(F.desc("n"), "id").limit(15).select("id", "n")


_IDF = """, tf as (select term, count(distinct commit_id) as df from cochange group by term), idf as (select term, entity_id, sum(1.0 / df) as score, count(*) as cnt from cochange join tf using (term) group by all)"""
query("agg11_cochange_idf", m.sql("cochange", _IDF + " select term, entity_id, round(score, 6) as score, cnt from idf"))(lambda s, d: cochange_idf(m.cochange(s, d)))


def cochange_idf(rows, before=None):
    """(term, entity_id, score, cnt): entities by the inverse document frequency of every term they changed under, summed over
    their changes [before a time]. A question of several terms adds up its terms' rows."""
    past = rows if before is None else rows.where(F.col("commit_ts") < F.lit(before).cast("timestamp_ntz"))
    df = past.groupBy("term").agg(F.countDistinct("commit_id").alias("df"))
    counted = past.groupBy("term", "entity_id").agg(F.count("*").alias("cnt"))
    return counted.join(df, "term").select("term", "entity_id", _round(F.col("cnt") / F.col("df")).alias("score"), "cnt")


query("agg12_access_counters", f"select lower(trim(entity_id)) as entity_id, sum(coalesce(access_count, 0))::bigint as access_count, max({m.us('last_accessed')}) as last_us from (select distinct * from entity_access) where trim(entity_id) <> '' group by 1")(lambda s, d: access_counts(s, d))


def access_counts(s, d):
    """Accesses per entity: repeated rows count once, spellings of an id are one, null counts are 0."""
    rows = table(s, d, "entity_access").distinct().select(norm_key(F.col("entity_id")).alias("entity_id"), F.coalesce("access_count", F.lit(0)).alias("access_count"), utc_micros(F.col("last_accessed")).alias("last_us"))
    return rows.where("entity_id is not null").groupBy("entity_id").agg(F.sum("access_count").alias("access_count"), F.max("last_us").alias("last_us"))


query("agg13_status_report", m.sql("rec edge ev", "select (select count(*) from rec) as n_records, (select count(*) from rec where status = 'active') as n_active, (select count(*) from rec where status = 'stale') as n_stale, (select count(*) from edge) as n_edges, (select count(*) from ev) as n_events"))(lambda s, d: _status(s, d))


def _status(s, d):
    flag = lambda v: F.sum(F.when(F.col("status") == v, 1).otherwise(0))
    a = m.records(s, d).agg(F.count("*").alias("n_records"), flag("active").alias("n_active"), flag("stale").alias("n_stale"))
    return a.select("*", m.edges(s, d).agg(F.count("*")).scalar().alias("n_edges"), m.events(s, d).agg(F.count("*")).scalar().alias("n_events"))


query("agg14_corpus_stats", m.sql("edge", "select 'type' as facet, type as value, count(*) as n from rec group by all union all select 'status', status, count(*) from rec group by all union all select 'edge', edge_type, count(*) from edge group by all union all select 'language', coalesce(language, '?'), count(*) from rec where space = 'code' group by all"))(lambda s, d: _stats(s, d))


def _stats(s, d):
    rec, part = m.records(s, d), lambda df, facet, c: df.select(F.lit(facet).alias("facet"), c.alias("value"))
    rows = part(rec, "type", F.col("type")).unionByName(part(rec, "status", F.col("status"))).unionByName(part(m.edges(s, d), "edge", F.col("edge_type")))
    rows = rows.unionByName(part(rec.where("space = 'code'"), "language", F.coalesce("language", F.lit("?"))))
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


# Telemetry.
_SEG = """, seg as (select *, sum(case when kind in ('prompt_submit', 'session_start', 'session_end') then 1 else 0 end) over (partition by workspace order by id) as segment from ev where workspace is not null),
after as (select a.id as anchor_id, a.kind as anchor_kind, s.id, s.path, row_number() over (partition by a.id order by s.id) as n from seg a join seg s on s.workspace = a.workspace and s.segment = a.segment and s.id > a.id and s.kind = 'file_save' and s.path is not null
  where (a.kind = 'search_performed' and coalesce(a.returned, 0) <= 0 and a.query <> '') or a.kind = 'prompt_submit'),
files as (select distinct anchor_id, anchor_kind, path, path in (select file_path from rec where file_path is not null) as known from after where n <= 25)"""
query("min1_search_misses", m.sql("rec ev", _SEG + " select anchor_id as event_id, (select query from ev where ev.id = anchor_id) as query, count(*) as n_files from files where anchor_kind = 'search_performed' and known group by anchor_id"))(
    lambda s, d: mining.search_misses(m.saves(s, d), m.records(s, d))
)
_CHARTED = """, charted as (select distinct p.id from seg p join seg g on g.workspace = p.workspace and g.segment = p.segment and g.kind = 'search_performed' and g.entity_id is not null
  join seg u on u.workspace = g.workspace and u.segment = g.segment and u.entity_id = g.entity_id and u.id > g.id and (u.kind = 'file_save' or (u.kind = 'pre_tool_use' and g.id % 2 = 1)) where p.kind = 'prompt_submit'),
uncharted as (select anchor_id as event_id, count(*) as n_files, count(*) filter (known) as n_indexed from files where anchor_kind = 'prompt_submit' and anchor_id not in (select id from charted) group by anchor_id having count(*) filter (known) > 0)"""
query("min2_uncharted_edits", m.sql("rec ev", _SEG + _CHARTED + " select * from uncharted"))(lambda s, d: mining.uncharted_edits(m.saves(s, d), m.records(s, d), _steps(s, d)))
query("min3_recurring_use", m.sql("delivery", "select entity_id, count(*) as hits from used where outcome = 'hit' group by 1 having count(*) >= 2"))(lambda s, d: mining.recurring_use(m.usage(s, d)))
_HOT = "select path, count(*) as saves, count(distinct us // 86400000000) as days from ev where kind = 'file_save' and path <> '' group by path having count(*) >= 3 and count(distinct us // 86400000000) >= 2"
query("min4_hot_files", m.sql("ev", _HOT))(lambda s, d: mining.hot_files(m.saves(s, d)))
_FAILED = "case when contains(r, 'Exit code:') and regexp_extract(string_split(r, 'Exit code:')[-1], '^\\s*([+-]?[0-9]+)(\\s|$)', 1) <> '' then cast(regexp_extract(string_split(r, 'Exit code:')[-1], '^\\s*([+-]?[0-9]+)(\\s|$)', 1) as bigint) <> 0 else regexp_matches(lower(substring(r, 1, 200)), 'error|failed|panic|traceback|exception') end"
_CALLS = f", calls as (select workspace, id, coalesce(tool, '') as tool, {_FAILED} as failed, row_number() over (partition by workspace order by id) as n from (select *, coalesce(result, '') as r from ev where kind = 'post_tool_use' and workspace is not null))"
query("min5_error_fixes", m.sql("ev", _CALLS + " select e.id as error_id, e.tool, min(f.id) as fix_id from calls e join calls f on f.workspace = e.workspace and f.tool = e.tool and not f.failed and f.n between e.n + 1 and e.n + 20 where e.failed and e.tool <> '' group by all"))(
    lambda s, d: mining.error_fixes(m.saves(s, d))
)
query("min6_failed_calls", m.sql("ev", _CALLS + " select tool, count(*) as n_calls, count(*) filter (failed) as n_failed from calls group by tool"))(
    lambda s, d: m.saves(s, d).where("kind = 'post_tool_use' and workspace is not null").groupBy(F.coalesce("tool", F.lit("")).alias("tool")).agg(F.count("*").alias("n_calls"), F.sum(mining.looks_failed(F.coalesce("result", F.lit(""))).cast("int")).alias("n_failed"))
)
_MIN7 = f"""{_SEG}{_CHARTED}{_CALLS}, all_signals as (select 1 as position, 'uncharted_edit' as signal, 'uncharted_edit:' || event_id as fingerprint from uncharted
union select 2, 'search_miss', 'search_miss:' || anchor_id from files where anchor_kind = 'search_performed' and known union select 3, 'recurring_use', 'recurring_use:' || entity_id from used where outcome = 'hit' group by entity_id having count(*) >= 2
union select 4, 'hot_file', 'hot_file:' || path from ({_HOT}) where path in (select file_path from rec where file_path is not null)
union select 5, 'error_fix', 'error_fix:' || e.tool from calls e join calls f on f.workspace = e.workspace and f.tool = e.tool and not f.failed and f.n between e.n + 1 and e.n + 20 where e.failed and e.tool <> '')
select * from all_signals order by position, fingerprint limit 500"""
query("min7_suggestions", m.sql("rec ev delivery", _MIN7))(lambda s, d: mining.suggestions(m.saves(s, d), m.records(s, d), m.usage(s, d), _steps(s, d)))


def _fresh(s, d):
    log = m.with_doc(m.events(s, d)).where("kind = 'write_nudge_shown'")
    marks = F.try_variant_get("doc", "$.fingerprints", "array<string>")
    shown = log.select(F.explode(marks).alias("fingerprint"), "us")
    pool = shown.select("fingerprint").distinct()
    return mining.fresh(pool, shown, AS_OF_US, 24 * 14)


query("min8_fresh_fingerprints", m.sql("ev", f""", shown as (select unnest(json_extract_string(doc, '$.fingerprints[*]')) as fingerprint, us from ev1 where kind = 'write_nudge_shown' and json_type(doc, '$.fingerprints') = 'ARRAY')
select distinct fingerprint from shown where fingerprint not in (select fingerprint from shown where us > {AS_OF_US} - 14 * 24 * 3600000000)"""))(_fresh)


def _steps(s, d):
    """Deliveries and uses as steps: a search delivers its event's entity, saves touch theirs, prompts end a stretch."""
    log = m.saves(s, d).where("workspace is not null")
    step = F.when(F.col("kind") == "search_performed", "deliver").when(F.col("kind") == "file_save", "touch").when(F.col("kind") == "pre_tool_use", "pull").when(F.col("kind").isin(mining.BOUNDARIES), "boundary")
    return log.withColumn("step", step).where("step = 'boundary' or (step is not null and entity_id is not null)").select(F.col("workspace").alias("key"), F.col("id").alias("at"), "step", F.col("id").alias("delivery_id"), "entity_id", F.when(F.col("id") % 2 == 0, "full").otherwise("pointer").alias("tier"))


query("min9_outcomes", m.sql("ev", """, st as (select workspace as key, id, entity_id, case when kind = 'search_performed' then 'deliver' when kind = 'file_save' then 'touch' when kind = 'pre_tool_use' then 'pull' when kind in ('prompt_submit', 'session_start', 'session_end') then 'boundary' end as step,
  case when id % 2 = 0 then 'full' else 'pointer' end as tier from ev where workspace is not null),
num as (select *, sum(case when step = 'boundary' then 1 else 0 end) over (partition by key order by id) as stretch from st where step = 'boundary' or (step is not null and entity_id is not null)),
ends as (select key, max(stretch) as last from num group by key)
select g.key, g.id as delivery_id, g.entity_id, g.tier, case when exists (select 1 from num u where u.key = g.key and u.stretch = g.stretch and u.entity_id = g.entity_id and u.id > g.id and (u.step = 'touch' or (u.step = 'pull' and g.tier = 'pointer'))) then 'hit' when g.stretch < last then 'miss' else 'pending' end as outcome
from num g join ends using (key) where g.step = 'deliver'"""))(lambda s, d: mining.outcomes(_steps(s, d)))
query("min10_mentioned_titles", m.sql("rec ev", """, texts as (select id, result from ev where kind = 'post_tool_use' and result <> ''), pats as (select id, id as p from rec union select id, title from rec where octet_length(encode(title)) >= 8 union select id, file_path from rec where type = 'file' and file_path <> '')
select distinct texts.id as event_id, pats.id as target_id from texts join pats on contains(result, p)"""))(lambda s, d: touched(s, d))


def touched(s, d):
    """(event_id, target_id): every record whose title (8 bytes or more), id or path, if it is a file, a tool's result holds."""
    rec = m.records(s, d)
    texts = m.saves(s, d).where("kind = 'post_tool_use' and result <> ''").select("id", F.col("result").alias("text"))
    by = lambda c, rows: rows.select(F.col(c).alias("pattern"), F.col("id").alias("target_id"))
    named = by("id", rec).unionByName(by("title", rec.where(F.octet_length("title") >= 8))).unionByName(by("file_path", rec.where("type = 'file' and file_path <> ''"))).distinct()
    return joining.containing(texts, named).join(named, "pattern").select(F.col("id").alias("event_id"), "target_id").distinct()


query("min11_never_delivered", m.sql("delivery", f"select p_partkey as entity_id from part where p_partkey not in (select entity_id from used join delivery using (delivery_id) where created_at >= timestamp '{SESSION_SINCE}')"))(
    lambda s, d: mining.never_delivered(table(s, d, "part").select(F.col("p_partkey").alias("entity_id")), m.usage(s, d), m.deliveries(s, d), F.lit(SESSION_SINCE).cast("timestamp_ntz"))
)
query("min11_session_cutoff", m.sql("ev", "select id, us from ev where kind = 'session_start' order by id desc limit 1 offset 9"))(lambda s, d: mining.nth_last(m.events(s, d), "session_start", 10))
query("drf13_expired_events", m.sql("ev", f"select id from ev where us < {AS_OF_US} - 30 * 86400000000"))(lambda s, d: mining.expired(m.events(s, d), AS_OF_US, 30).select("id"))
query("drf13_expired_deliveries", m.sql("delivery", "select delivery_id, count(entity_id) as n_usage from delivery left join used using (delivery_id) where created_at < timestamp '1998-01-01' - interval 30 day group by 1"))(
    lambda s, d: m.deliveries(s, d).where("created_at < timestamp_ntz'1998-01-01' - interval 30 days").join(m.usage(s, d), "delivery_id", "left").groupBy("delivery_id").agg(F.count("entity_id").alias("n_usage"))
)
TOMBSTONES = 10  # kept of the small tables here; 1,000 by default
query("drf13_surplus_tombstones", m.sql("rec", f"select id from rec where status = 'pruned' qualify row_number() over (order by coalesce(updated_us, -4611686018427387904) desc, id desc) > {TOMBSTONES}"))(
    lambda s, d: mining.surplus_tombstones(m.records(s, d), TOMBSTONES)
)

QUERIES, SQL = query.queries, query.sql
