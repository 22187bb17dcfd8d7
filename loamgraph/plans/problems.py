"""Queries of the general data problems: sessions (p2), drifting schemas (p3), orphan references (p5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import orphans, schema_drift
from loamgraph.operators import sessions as timers
from loamgraph.session import durable
from loamgraph.sources.tables import table
from loamgraph.streaming.sessions import drained

QUERIES, SQL = {}, {}

USABLE_SQL = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$'"


def micros_sql(col: str) -> str:
    zoned = f"case when regexp_matches({col}, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') then {col} else {col} || 'Z' end"
    return f"case when regexp_matches({col}, {USABLE_SQL}) then epoch_us(try_cast({zoned} as timestamptz)) end"


def day_sql(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d')"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = timers.sessions(timers.keyed_events(table(spark, folder, "event_log")))
    return found.select(F.col("key").alias("workspace"), "first_id", "last_id")


def p2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return timers.session_report(timers.sessions(timers.keyed_events(table(spark, folder, "event_log"))))


def p2_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same sessions from the stream operator with event-time timers, run until every timer has expired."""
    events = timers.keyed_events(table(spark, folder, "event_log"))
    found = drained(events.select("key", F.timestamp_micros("at").alias("at"), "id"))
    return found.select(F.col("key").alias("workspace"), "first_id", "last_id", "n_events")


def _objects(spark: SparkSession, folder: str, *keys: Column) -> DataFrame:
    log, entities = table(spark, folder, "event_log"), table(spark, folder, "entities")
    events = schema_drift.json_objects(log, "event_log", F.regexp_replace(F.lower("event_type"), "-", "_"), "payload", "export_file", *keys)
    return events.unionByName(schema_drift.json_objects(entities, "entities", F.col("type"), "properties", "export_file", *keys))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.schema_changes(_objects(spark, folder))


def p3_field_types(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.typed_values(_objects(spark, folder))


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every object of both tables: row_number numbers a table's rows as they are read, since ids are repeated or null."""
    objects = _objects(spark, folder)
    stats = durable(schema_drift.path_statistics(schema_drift.path_values(objects)))
    names = schema_drift.column_names(stats, schema_drift.schema_changes(objects))
    rows = _objects(spark, folder, F.col("id").cast("string").alias("id"), F.monotonically_increasing_id().alias("row_number"))
    return schema_drift.typed_table(rows, stats, names, "id", "row_number")


def p3_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table per column: rows by the field they came under, in how many files, and failed casts."""
    rows = p3_table(spark, folder).where("field is not null")
    return rows.groupBy("record_table", "kind", "column", "column_type", "field").agg(
        F.count("*").alias("n_rows"), F.countDistinct("export_file").alias("n_files"), F.count_if("failed_cast").alias("n_failed_casts")
    )


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    refs = orphans.references(
        [
            ("edges", table(spark, folder, "edges"), ["source_id", "target_id"], "created_at"),
            ("event_log", table(spark, folder, "event_log"), ["entity_id"], "created_at"),
            ("entity_access", table(spark, folder, "entity_access"), ["entity_id"], "last_accessed"),
        ]
    )
    return orphans.orphan_references(orphans.parent_states(table(spark, folder, "entities")), refs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, folder))


QUERIES |= {f.__name__: f for f in (p2_found, p2_sessions, p2_stream, p3_found, p3_field_types, p3_table, p3_columns, p5_found, p5_report)}

_EVENTS = f"""
ev as (select id, lower(trim(workspace)) as ws, {micros_sql("created_at")} as us, replace(lower(trim(coalesce(event_type, ''))), '-', '_') as kind from event_log),
once as (select id, min(struct_pack(a := us, b := ws, c := kind)) as e from ev where ws <> '' and us is not null and id is not null group by id),
flat as (select id, e.a as us, e.b as ws, e.c as kind from once),
marked as (select *, case when us - lag(us) over w > 1800000000 or lag(us) over w is null then 1 else 0 end as opens from flat window w as (partition by ws order by us, id)),
numbered as (select *, sum(opens) over (partition by ws order by us, id rows unbounded preceding) as s from marked)"""
SQL["p2_found"] = f"with {_EVENTS} select ws as workspace, arg_min(id, struct_pack(a := us, b := id)) as first_id, arg_max(id, struct_pack(a := us, b := id)) as last_id from numbered group by ws, s"
SQL["p2_stream"] = f"with {_EVENTS} select ws as workspace, arg_min(id, struct_pack(a := us, b := id)) as first_id, arg_max(id, struct_pack(a := us, b := id)) as last_id, count(*) as n_events from numbered group by ws, s"
SQL["p2_sessions"] = f"""with {_EVENTS},
per as (select ws, s, kind, count(*) as n from numbered group by all),
types as (select ws, s, string_agg(kind || '=' || n, ';' order by kind) as type_counts from per group by all),
whole as (select ws, s, arg_min(id, struct_pack(a := us, b := id)) as first_id, arg_max(id, struct_pack(a := us, b := id)) as last_id, min(us) as a, max(us) as b, count(*) as n_events from numbered group by all)
select ws as workspace, first_id, last_id, strftime(make_timestamp(a), '%Y-%m-%d %H:%M:%S.%f') as started_at, strftime(make_timestamp(b), '%Y-%m-%d %H:%M:%S.%f') as ended_at, strftime(make_timestamp(b + 1800000000), '%Y-%m-%d %H:%M:%S.%f') as expired_at,
round((b - a) / 1e6, 6) as duration_s, n_events, type_counts from whole join types using (ws, s)"""

_OBJECTS = """
src as (select 'event_log' as record_table, replace(lower(event_type), '-', '_') as kind, export_file, payload as j from event_log union all select 'entities', type, export_file, properties from entities),
obj as (select record_table, kind, export_file, j from src where kind is not null and export_file is not null and json_valid(j) and json_type(case when json_valid(j) then j end) = 'OBJECT'),
pv as (select record_table, kind, export_file, e.key as field, e.value as v, case e.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as t
  from obj, json_each(obj.j) e),
ct as (select record_table, kind, field, arg_max(t, struct_pack(n := n, t := t)) as column_type from (select record_table, kind, field, t, count(*) as n from pv where t is not null group by all) group by all)"""
SQL["p3_field_types"] = f"""with {_OBJECTS} select record_table, kind, export_file, field, column_type, count(*) as n_rows, count(*) filter (case column_type when 'string' then false
when 'number' then t <> 'number' and try_cast(json_extract_string(v, '$') as double) is null when 'boolean' then t <> 'boolean' and t <> 'number' and try_cast(json_extract_string(v, '$') as boolean) is null
else t <> column_type end) as n_failed_casts from pv join ct using (record_table, kind, field) where t is not null group by all"""
_ORPHANS = f"""
rec as (select lower(trim(id)) as id, arg_max(struct_pack(st := lower(trim(status)), cr := {micros_sql("created_at")}), struct_pack(a := {micros_sql("updated_at")}, s := coalesce(status, ''), c := coalesce(created_at, ''))) as r from entities where lower(trim(id)) <> '' group by 1),
refs as (
  select 'edges' as ref_table, 'source_id' as ref_field, lower(trim(source_id)) as entity_id, {micros_sql("created_at")} as us from edges
  union all select 'edges', 'target_id', lower(trim(target_id)), {micros_sql("created_at")} from edges
  union all select 'event_log', 'entity_id', lower(trim(entity_id)), {micros_sql("created_at")} from event_log
  union all select 'entity_access', 'entity_id', lower(trim(entity_id)), {micros_sql("last_accessed")} from entity_access),
orphan as (
  select distinct ref_table, ref_field, coalesce({day_sql("us")}, 'unknown') as ref_day, entity_id,
    case when rec.id is null then 'missing' when r.st = 'pruned' then 'deleted' when r.cr > us then 'later' end as reason
  from refs left join rec on rec.id = entity_id where entity_id <> '')"""
SQL["p5_found"] = f"with {_ORPHANS} select * from orphan where reason is not null"
SQL["p5_report"] = f"with {_ORPHANS} select ref_table, ref_field, ref_day, reason, count(*) as n_ids from orphan where reason is not null group by all"
