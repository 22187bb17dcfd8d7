"""Sessions, drifting schemas and orphan references against brute force on sf0.001 and on small fixtures."""

import json
from collections import defaultdict
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loamgraph.operators import orphans, schema_drift
from loamgraph.operators import sessions as timers
from loamgraph.plans import problems

DATA = "/root/testdata/sf0.001"
OBJECTS = "record_table string, kind string, export_file string, text string"


def kind_of(v):
    return {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


def brute_changes(rows):
    """rows: (table, kind, file, text)."""
    held, values, files = defaultdict(lambda: defaultdict(set)), defaultdict(set), defaultdict(set)
    for t, k, f, text in rows:
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            continue
        if not isinstance(doc, dict) or k is None or f is None:
            continue
        files[t, k].add(f)
        for name, v in doc.items():
            if v is not None:
                held[t, k, f][name].add(kind_of(v))
                values[t, k, f, name].add(json.dumps(v) if not isinstance(v, str) else v)
    out = set()
    for (t, k), names in files.items():
        names = sorted(names)
        for old, new in zip(names, names[1:]):
            a, b = held[t, k, old], held[t, k, new]
            gone, came = set(a) - set(b), set(b) - set(a)
            pairs = []
            for g in gone:
                for c in came:
                    if a[g] == b[c] and len(a[g]) == 1 and a[g] <= {"string", "number", "boolean"}:
                        x = values[t, k, new, c]
                        share = len(x & values[t, k, old, g]) / len(x)
                        if share >= 0.5:
                            pairs.append((-share, g, c))
            for _, g, c in sorted(pairs):
                if g in gone and c in came:
                    gone.remove(g)
                    came.remove(c)
                    out.add((t, k, new, c, g, "renamed"))
            out |= {(t, k, new, g, "", "removed") for g in gone} | {(t, k, new, c, "", "added") for c in came}
            out |= {(t, k, new, x, "", "retyped") for x in set(a) & set(b) if a[x] != b[x]}
    return out


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_schema_changes_match_brute_force(spark, folder):
    rows = [("event_log", r["event_type"] and r["event_type"].lower().replace("-", "_"), r["export_file"], r["payload"]) for r in pq.read_table(f"{folder}/event_log.parquet").to_pylist()]
    rows += [("entities", r["type"], r["export_file"], r["properties"]) for r in pq.read_table(f"{folder}/entities.parquet").to_pylist()]
    found = [tuple(r) for r in problems.p3_found(spark, folder).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_changes(rows)


def objects(spark, rows):
    df = spark.createDataFrame(rows, OBJECTS)
    return schema_drift.json_objects(df, "t", F.col("kind"), "text", "export_file")


def test_schema_changes_edge_cases(spark):
    rows = [("t", "k", "f1", t) for t in ('{"a": "x", "n": 1, "o": {"p": 1}}', '{"a": "y", "n": null}', "[1]", "null", None, "", '{"cut": "')]
    rows += [("t", "k", "f2", t) for t in ('{"b": "x", "n": "1", "o": [1]}', '{"b": "y"}')]
    rows += [("t", "k", "f3", "{}"), ("t", None, "f1", '{"z": 1}'), ("t", "single", "f1", '{"z": 1}')]
    found = {tuple(r)[1:] for r in schema_drift.schema_changes(objects(spark, rows)).collect()}
    assert found == {
        ("k", "f2", "b", "a", "renamed"),
        ("k", "f2", "n", "", "retyped"),
        ("k", "f2", "o", "", "retyped"),
        ("k", "f3", "b", "", "removed"),
        ("k", "f3", "n", "", "removed"),
        ("k", "f3", "o", "", "removed"),
    }
    assert schema_drift.schema_changes(objects(spark, [])).count() == 0


def test_renamed_fields_share_their_last_name(spark):
    rows = [("t", "k", "f1", '{"a": "x", "n": 1}'), ("t", "k", "f2", '{"b": "x", "n": "2"}'), ("t", "k", "f3", '{"c": "x", "a": 5, "n": "many"}'), ("t", "k2", "f1", '{"a": "x"}')]
    df = objects(spark, rows)
    stats = schema_drift.path_statistics(schema_drift.path_values(df))
    names = schema_drift.column_names(stats, schema_drift.schema_changes(df))
    assert {(r.kind, r.export_file, r.field): r.column for r in names.collect() if r.field != "n"} == {("k", "f1", "a"): "c", ("k", "f2", "b"): "c", ("k", "f3", "c"): "c", ("k", "f3", "a"): "a", ("k2", "f1", "a"): "a"}
    out = schema_drift.typed_table(df, stats, names).where("kind = 'k'").collect()
    assert sorted((r.column, r.field, r.string_value, r.number_value, r.failed_cast) for r in out if r.column in "ac") == [("a", "a", None, 5.0, False), ("c", "a", "x", None, False), ("c", "b", "x", None, False), ("c", "c", "x", None, False)]


def test_renamings_of_fields_named_by_data(spark):
    """Thousands of fields come and go in one step; only those that share values meet."""
    n = 1500
    rows = [("t", "k", "f1", json.dumps({f"u{i}": f"value {i}" for i in range(n)})), ("t", "k", "f2", json.dumps({f"v{i}": f"value {i}" if i % 2 else "else" for i in range(n)}))]
    out = schema_drift.schema_changes(objects(spark, rows)).collect()
    assert {(r.old_field, r.field) for r in out if r.change == "renamed"} == {(f"u{i}", f"v{i}") for i in range(1, n, 2)} and len(out) == n // 2 + n


def test_typed_table_holds_every_object_of_every_kind(spark):
    folder = "/root/testdata/sf0.001"
    want, types = [], defaultdict(lambda: defaultdict(int))
    for name, kind, text in (("event_log", "event_type", "payload"), ("entities", "type", "properties")):
        for r in pq.read_table(f"{folder}/{name}.parquet").to_pylist():
            try:
                doc = json.loads(r[text])
            except (TypeError, ValueError):
                continue
            k = r[kind].lower().replace("-", "_") if name == "event_log" and r[kind] else r[kind]
            if isinstance(doc, dict) and k is not None:
                want += [(name, k, r["export_file"], str(r["id"]), f) for f in doc or [None]]
                for f, v in doc.items():
                    if v is not None:
                        types[name, k, f][kind_of(v)] += 1
    out = problems.QUERIES["p3_table"](spark, folder).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(((r.record_table, r.kind, r.export_file, r.id, r.field) for r in out), key=key) == sorted(want, key=key)
    assert len({(r.record_table, r.row_number, r.field) for r in out}) == len(out)
    columns = defaultdict(set)
    for r in out:
        columns[r.record_table, r.kind, r.column].add(r.field)
    for r in out:
        held = types.get((r.record_table, r.kind, r.field))
        if columns[r.record_table, r.kind, r.column] == {r.field} and r.field not in {f for k, fs in columns.items() for f in fs if k[:2] == (r.record_table, r.kind) and k[2] != r.field}:
            assert r.column_type == (max(held, key=lambda t: (held[t], t)) if held else None)
        filled = [c for c in ("string", "number", "boolean", "json") if r[f"{c}_value"] is not None]
        assert filled in ([], ["json" if r.column_type in ("array", "object") else r.column_type]) and r.failed_cast == (r.raw_value is not None) and not (filled and r.failed_cast)


def test_typed_table_values_and_failed_casts(spark):
    rows = [("t", "k", "f1", '{"n": 1, "s": "a", "o": {"x": [1]}}'), ("t", "k", "f1", '{"n": "2.5", "s": {"y": 1}}'), ("t", "k", "f2", '{"n": 3, "s": "b", "o": 7}'), ("t", "k", "f2", '{"n": "many", "s": null, "o": {}}'), ("t", "k", "f2", '{"n": 4}'), ("t", "k2", "f2", "{}")]
    df = objects(spark, rows)
    stats = schema_drift.path_statistics(schema_drift.path_values(df))
    out = schema_drift.typed_table(df, stats, schema_drift.column_names(stats, schema_drift.schema_changes(df))).collect()
    got = sorted((r.kind, str(r.field), r.export_file, str(next((v for v in (r.string_value, r.number_value, r.json_value) if v is not None), None)), str(r.raw_value)) for r in out)
    assert got == sorted([
        ("k", "n", "f1", "1.0", "None"), ("k", "n", "f1", "2.5", "None"), ("k", "n", "f2", "3.0", "None"), ("k", "n", "f2", "4.0", "None"), ("k", "n", "f2", "None", '"many"'), ("k", "s", "f1", "a", "None"),
        ("k", "s", "f1", '{"y":1}', "None"), ("k", "s", "f2", "b", "None"), ("k", "s", "f2", "None", "None"), ("k", "o", "f1", '{"x":[1]}', "None"), ("k", "o", "f2", "None", "7"), ("k", "o", "f2", "{}", "None"), ("k2", "None", "f2", "None", "None"),
    ])


def brute_sessions(events, gap):
    by = defaultdict(list)
    for key, at, i, _ in events:
        by[key].append((at, i))
    out = set()
    for key, rows in by.items():
        rows.sort()
        start = 0
        for j in range(1, len(rows) + 1):
            if j == len(rows) or rows[j][0] - rows[j - 1][0] > gap:
                out.add((key, rows[start][0], rows[j - 1][0], rows[start][1], rows[j - 1][1], j - start))
                start = j
    return out


def test_sessions_of_a_hot_key_over_many_ranges(spark):
    import random

    rnd = random.Random(5)
    events, at = [], 0
    for i in range(3000):
        at += rnd.choice([0, 1, 10, 29, 30, 31, 200]) if i < 2000 else 1
        events.append(("hot" if i % 3 else f"k{i % 7}", at, i, rnd.choice(["a", "b", None])))
    df = spark.createDataFrame(events, "key string, at bigint, id bigint, kind string").repartition(5)
    out = timers.sessions(df, 30).collect()
    assert {(r.key, r.start_us, r.end_us, r.first_id, r.last_id, r.n_events) for r in out} == brute_sessions(events, 30)
    assert all(sum(r.types.values()) == r.n_events for r in out)
    assert sum(r.types.get("", 0) for r in out) == sum(e[3] is None for e in events)


def test_timers_do_not_depend_on_batches():
    import numpy as np
    import pyarrow as pa

    at = np.array([0, 5, 40, 41, 100, 0, 31, 61])
    key = pa.array(["a"] * 5 + ["b"] * 3)
    kinds = pa.array(["x", "y", "x", "x", None, "x", "y", "y"])
    for size in (1, 2, 3, 8):
        t, out = timers.SessionTimers(30), []
        for i in range(0, 8, size):
            out.append(t.update(key.slice(i, size), at[i : i + size], np.arange(8)[i : i + size], kinds.slice(i, size)))
        out.append(t.flush())
        rows = [tuple(r.values())[:7] for b in out if b is not None for r in b.to_pylist()]
        assert [r[:6] for r in rows] == [("a", 0, 5, 0, 1, 2), ("a", 40, 41, 2, 3, 2), ("a", 100, 100, 4, 4, 1), ("b", 0, 0, 5, 5, 1), ("b", 31, 61, 6, 7, 2)]
        assert [sorted(r[6]) for r in rows] == [[("x", 1), ("y", 1)], [("x", 2)], [("", 1)], [("x", 1)], [("y", 2)]]


def test_stream_drains_to_the_batch_operators_sessions(spark):
    from loamgraph.streaming.sessions import drained

    events = [(k, a, i) for i, (k, a) in enumerate([("a", 0), ("a", 1800), ("a", 3601), ("b", 50), ("b", 50), ("a", 9000), ("c", 0)])]
    df = spark.createDataFrame(events, "key string, s bigint, id bigint")
    got = {(r.key, r.first_id, r.last_id, r.n_events) for r in drained(df.select("key", F.timestamp_seconds("s").alias("at"), "id")).collect()}
    batch = timers.sessions(df.select("key", (F.col("s") * 1_000_000).alias("at"), "id", F.lit("x").alias("kind"))).collect()
    assert got == {(r.key, r.first_id, r.last_id, r.n_events) for r in batch} == {("a", 0, 1, 2), ("a", 2, 2, 1), ("a", 5, 5, 1), ("b", 3, 4, 2), ("c", 6, 6, 1)}


def test_no_private_folder_off_local_masters(spark):
    from loamgraph.session import shared_folder

    class Named:
        def __init__(self, **k):
            self.__dict__ |= k

    none = Named(isDefined=lambda: False)
    context = Named(master="spark://host:7077", _jsc=Named(sc=lambda: Named(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        shared_folder(Named(sparkContext=context, conf=Named(get=lambda *_: None)))


LOG = "id bigint, event_type string, created_at string, workspace string, workspaceX string"


def test_keyed_events_dedupe_and_drop(spark):
    rows = [
        (1, "File-Save", "2025-03-01T00:00:00Z", " Alpha ", "x"),
        (1, "file_save", "2025-03-01 00:00:00", "alpha", None),
        (2, None, "2025-03-01T01:00:00+01:00", "ALPHA", None),
        (3, "stop", "2025-13-40T99:00:00Z", "alpha", None),
        (4, "stop", "2025-03-01", "alpha", None),
        (5, "stop", "2025-03-01T00:00:00Z", "  ", None),
        (None, "stop", "2025-03-01T00:00:00Z", "alpha", None),
    ]
    out = timers.keyed_events(spark.createDataFrame(rows, LOG)).collect()
    base = int(datetime(2025, 3, 1, tzinfo=timezone.utc).timestamp()) * 10**6
    assert sorted(tuple(r) for r in out) == [("alpha", base, 1, "file_save"), ("alpha", base, 2, "")]
    assert timers.sessions(timers.keyed_events(spark.createDataFrame([], LOG))).count() == 0


def test_orphans_small(spark):
    entities = spark.createDataFrame(
        [
            ("A", "active", "2025-03-02T00:00:00Z", "2025-03-05T00:00:00Z"),
            (" a ", "PRUNED ", "2025-03-02T00:00:00Z", "2025-03-04T00:00:00Z"),
            ("b", "Pruned", "2025-03-02T00:00:00Z", "2025-03-04T00:00:00Z"),
            ("c", None, "never", "2025-03-04T00:00:00Z"),
            (None, None, None, None),
        ],
        "id string, status string, created_at string, updated_at string",
    )
    edges = spark.createDataFrame(
        [("a", "B", "2025-03-01T23:00:00-02:00"), ("A", "zz", None), ("a", " ", "2025-03-01T00:00:00Z"), ("c", "b", "2025-03-01"), ("C ", None, "2025-03-01T00:00:00Z")],
        "source_id string, target_id string, created_at string",
    )
    refs = orphans.references([("edges", edges, ["source_id", "target_id"], "created_at")])
    found = {tuple(r)[1:] for r in orphans.orphan_references(orphans.parent_states(entities), refs).collect()}
    assert found == {
        ("source_id", "2025-03-01", "a", "later"),
        ("target_id", "2025-03-02", "b", "deleted"),
        ("target_id", "unknown", "zz", "missing"),
        ("target_id", "unknown", "b", "deleted"),
    }
    none = orphans.orphan_references(orphans.parent_states(entities.limit(0)), refs)
    assert {r.reason for r in none.collect()} == {"missing"}
    assert orphans.orphan_references(orphans.parent_states(entities), refs.limit(0)).count() == 0
