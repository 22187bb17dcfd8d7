"""The tables as the operators see them: records, edges, events, deliveries; each with its SQL twin in PRELUDE.

Entities, edges and events come from the project's own tables. Deliveries and their usage, co-changes and hunks have no
table of their own; they are read from orders, line items and parts as the blueprint maps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import norm_key
from loamgraph.functions.times import utc_micros
from loamgraph.operators.records import latest_records
from loamgraph.operators.schema_drift import json_type
from loamgraph.session import durable
from loamgraph.sources.tables import table

CODE_TYPES = ["function", "class", "file", "module"]
KNOWLEDGE_TYPES = ["observation", "rule", "knowledge"]
CURATED = ["references", "supports", "contradicts", "superseded_by", "derived_from", "promoted_from"]
RECORD_FIELDS = [
    "type", "title", "content", "file_path", "status", "content_hash", "created_us", "updated_us", "search_terms", "properties",
]


def _scalar(doc: str, field: str, kind: str, sql: str):
    value = F.try_variant_get(doc, f"$.{field}", "variant")
    return F.when(json_type(value) == kind, F.try_variant_get(doc, f"$.{field}", sql))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Newest version of every entity, with the properties the operators use as typed columns."""
    rows = table(spark, folder, "entities")
    clean = rows.select(
        norm_key(F.col("id")).alias("id"), "type", "title", F.coalesce("content", F.lit("")).alias("content"), "file_path",
        F.coalesce(norm_key(F.col("status")), F.lit("active")).alias("status"), "content_hash", utc_micros(F.col("created_at")).alias("created_us"),
        utc_micros(F.col("updated_at")).alias("updated_us"), F.coalesce("search_terms", F.lit("")).alias("search_terms"), "properties", "updated_at",
    )
    newest = latest_records(clean, RECORD_FIELDS)
    doc = F.try_parse_json("properties")
    typed = newest.withColumn("doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)).withColumn("space", F.when(F.col("type").isin(CODE_TYPES), "code").otherwise("knowledge"))
    text, number = (lambda f: _scalar("doc", f, "string", "string").alias(f)), (lambda f: _scalar("doc", f, "number", "double").alias(f))
    tags = F.when(json_type(F.try_variant_get("doc", "$.tags", "variant")) == "array", F.try_variant_get("doc", "$.tags", "array<string>"))
    return typed.select(
        "id", *[c for c in RECORD_FIELDS if c != "properties"], "space", text("category"), text("language"), text("qualified_name"), text("volatility"), text("stale_reason"),
        number("confidence"), number("line_start"), number("line_end"), tags.alias("tags"),
    )


def all_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (source_id, target_id, edge_type): the newest one; null weights are 1."""
    rows = table(spark, folder, "edges").select(
        norm_key(F.col("source_id")).alias("source_id"), norm_key(F.col("target_id")).alias("target_id"), "edge_type", F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.coalesce(utc_micros(F.col("created_at")), F.lit(0)).alias("created_us"),
    )
    rows = rows.where("source_id is not null and target_id is not null and edge_type is not null")
    newest = rows.groupBy("source_id", "target_id", "edge_type").agg(F.max(F.struct("created_us", "weight")).alias("e"))
    return newest.select("source_id", "target_id", "edge_type", "e.weight", "e.created_us")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges both of whose ends are records."""
    ids = table(spark, folder, "entities").select(norm_key(F.col("id")).alias("id")).where("id is not null").distinct()
    found = all_edges(spark, folder)
    return found.join(ids, F.col("source_id") == ids["id"], "left_semi").join(ids, F.col("target_id") == ids["id"], "left_semi")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events (id, kind, entity_id, workspace, us, payload): each id once, its earliest row; unusable times are null."""
    rows = table(spark, folder, "event_log").select(
        F.col("id").cast("bigint").alias("id"), F.coalesce(utc_micros(F.col("created_at")), F.lit(2**60)).alias("us"),
        F.regexp_replace(F.lower(F.trim("event_type")), "-", "_").alias("kind"), norm_key(F.col("entity_id")).alias("entity_id"), norm_key(F.col("workspace")).alias("workspace"), "payload",
    )
    named = F.struct("us", *[F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "entity_id", "workspace", "payload")])
    once = rows.where("id is not null").groupBy("id").agg(F.min(named).alias("e"))
    null_if = lambda c, v: F.when(F.col(f"e.{c}") != v, F.col(f"e.{c}")).alias(c)
    return once.select("id", null_if("kind", ""), null_if("entity_id", ""), null_if("workspace", ""), null_if("us", 2**60), F.col("e.payload").alias("payload"))


def payload_text(field: str):
    """A payload field as text if it is a JSON string."""
    return _scalar("doc", field, "string", "string")


def with_doc(log: DataFrame) -> DataFrame:
    doc = F.try_parse_json("payload")
    return log.withColumn("doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc))


def saves(spark: SparkSession, folder: str) -> DataFrame:
    """Events with what the telemetry operators read: path, query, returned, tool, result."""
    log = with_doc(events(spark, folder))
    return log.select(
        "id", "kind", "entity_id", "workspace", "us",
        F.coalesce(payload_text("file_path_rel"), payload_text("file_path")).alias("path"), payload_text("query").alias("query"), _scalar("doc", "returned", "number", "double").cast("bigint").alias("returned"),
        F.coalesce(payload_text("tool_name"), payload_text("toolName")).alias("tool"), payload_text("tool_result").alias("result"), payload_text("prompt").alias("prompt"),
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """(delivery_id, kind, created_at) from orders."""
    kind = F.when(F.col("o_orderpriority").startswith("1"), "pack").when(F.col("o_orderpriority").startswith("2"), "search").when(F.col("o_orderpriority").startswith("3"), "pull").otherwise("scoped")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("delivery_id"), kind.alias("kind"), F.col("o_orderdate").alias("created_at"))


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """(delivery_id, entity_id, outcome, tier): one row per pair, of the smallest line number."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_returnflag", "l_linestatus")).alias("l"))
    outcome = F.when(F.col("l.l_returnflag") == "A", "hit").when(F.col("l.l_returnflag") == "R", "miss").otherwise("pending")
    return rows.select(F.col("l_orderkey").alias("delivery_id"), F.col("l_partkey").alias("entity_id"), outcome.alias("outcome"), F.when(F.col("l.l_linestatus") == "F", "full").otherwise("pointer").alias("tier"))


def cochange(spark: SparkSession, folder: str) -> DataFrame:
    """(term, entity_id, commit_id, commit_ts): words of part names, suppliers, orders."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    parts = table(spark, folder, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("commit_ts"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("term", F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("commit_id"), "commit_ts").distinct()


_USABLE = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$'"


def us(col: str) -> str:
    """SQL for the microseconds of a usable time text."""
    zoned = f"case when regexp_matches({col}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') then {col} else {col} || 'Z' end"
    return f"case when regexp_matches({col}, {_USABLE}) then epoch_us(try_cast({zoned} as timestamptz)) end"


def _js(doc: str, field: str) -> str:
    return f"case when json_type({doc}, '$.{field}') = 'VARCHAR' then json_extract_string({doc}, '$.{field}') end"


def _num(doc: str, field: str) -> str:
    return f"case when json_type({doc}, '$.{field}') in ('DOUBLE', 'BIGINT', 'UBIGINT') then cast(json_extract_string({doc}, '$.{field}') as double) end"


_OBJ = "case when json_valid({0}) then case when json_type({0}) = 'OBJECT' then {0} end end"
REC = f"""rec0 as (select nullif(lower(trim(id)), '') as id, arg_max(struct_pack(type := type, title := title, content := coalesce(content, ''), file_path := file_path,
  status := coalesce(nullif(lower(trim(status)), ''), 'active'), content_hash := content_hash, created_us := {us("created_at")}, updated_us := {us("updated_at")}, search_terms := coalesce(search_terms, ''),
  doc := {_OBJ.format("properties")}), {us("updated_at")}) as r from entities where lower(trim(id)) <> '' group by 1),
rec as (select id, r.type as type, r.title as title, r.content as content, r.file_path as file_path, r.status as status, r.content_hash as content_hash, r.created_us as created_us, r.updated_us as updated_us,
  r.search_terms as search_terms, case when r.type in ('function', 'class', 'file', 'module') then 'code' else 'knowledge' end as space,
  {_js("r.doc", "category")} as category, {_js("r.doc", "language")} as language, {_js("r.doc", "qualified_name")} as qualified_name, {_js("r.doc", "volatility")} as volatility, {_js("r.doc", "stale_reason")} as stale_reason,
  {_num("r.doc", "confidence")} as confidence, {_num("r.doc", "line_start")} as line_start, {_num("r.doc", "line_end")} as line_end,
  case when json_type(r.doc, '$.tags') = 'ARRAY' then json_extract_string(r.doc, '$.tags[*]') end as tags from rec0)"""
EDGE = f"""edge0 as (select lower(trim(source_id)) as source_id, lower(trim(target_id)) as target_id, edge_type, max(struct_pack(c := coalesce({us("created_at")}, 0), w := coalesce(weight, 1.0))) as e
  from edges where trim(source_id) <> '' and trim(target_id) <> '' and edge_type is not null group by 1, 2, 3),
edge as (select source_id, target_id, edge_type, e.w as weight, e.c as created_us from edge0 where source_id in (select id from rec) and target_id in (select id from rec))"""
EV = f"""ev0 as (select id, min(struct_pack(us := coalesce({us("created_at")}, 1152921504606846976), kind := coalesce(replace(lower(trim(event_type)), '-', '_'), ''), entity_id := coalesce(lower(trim(entity_id)), ''),
  workspace := coalesce(lower(trim(workspace)), ''), payload := coalesce(payload, ''))) as e from event_log where id is not null group by id),
ev1 as (select id, nullif(e.kind, '') as kind, nullif(e.entity_id, '') as entity_id, nullif(e.workspace, '') as workspace, nullif(e.us, 1152921504606846976) as us, {_OBJ.format("e.payload")} as doc from ev0),
ev as (select id, kind, entity_id, workspace, us, coalesce({_js("doc", "file_path_rel")}, {_js("doc", "file_path")}) as path, {_js("doc", "query")} as query, cast({_num("doc", "returned")} as bigint) as returned,
  coalesce({_js("doc", "tool_name")}, {_js("doc", "toolName")}) as tool, {_js("doc", "tool_result")} as result, {_js("doc", "prompt")} as prompt from ev1)"""
DELIVERY = """delivery as (select o_orderkey as delivery_id, case when o_orderpriority like '1%' then 'pack' when o_orderpriority like '2%' then 'search' when o_orderpriority like '3%' then 'pull' else 'scoped' end as kind, o_orderdate as created_at from orders),
usage0 as (select l_orderkey, l_partkey, min(struct_pack(a := l_linenumber, b := l_returnflag, c := l_linestatus)) as l from lineitem group by all),
used as (select l_orderkey as delivery_id, l_partkey as entity_id, case l.b when 'A' then 'hit' when 'R' then 'miss' else 'pending' end as outcome, case l.c when 'F' then 'full' else 'pointer' end as tier from usage0)"""
COCHANGE = """cochange as (select distinct term, l_suppkey as entity_id, l_orderkey as commit_id, o_orderdate as commit_ts
  from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem) join (select p_partkey, unnest(string_split(lower(p_name), ' ')) as term from part) on l_partkey = p_partkey join orders on l_orderkey = o_orderkey)"""
PARTS = {"rec": REC, "edge": EDGE, "ev": EV, "delivery": DELIVERY, "cochange": COCHANGE}


def sql(parts: str, body: str) -> str:
    """A query over the named views: `sql("rec edge", "select ...")`; a body that begins with `,` adds views."""
    wanted = parts.split()
    if "edge" in wanted and "rec" not in wanted:
        wanted.insert(0, "rec")
    return "with recursive " + ",\n".join(PARTS[p] for p in wanted) + (body if body.startswith(",") else "\n" + body)


class Catalog:
    """Queries and their SQL, registered by name."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(f):
            self.queries[name] = f
            if oracle is not None:
                self.sql[name] = oracle
            return f

        return add


def durable_edges(spark: SparkSession, folder: str) -> DataFrame:
    """`edges`, written once to the shared folder: traversals read it at every hop."""
    return durable(edges(spark, folder))
