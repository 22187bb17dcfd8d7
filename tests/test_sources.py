"""Markdown records, source trees and streams."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.operators import mining
from loamgraph.sources import code, markdown
from loamgraph.streaming import outcomes, sessions

UUID = "11111111-1111-4111-8111-111111111111"
GOOD = f"---\nid: {UUID}\ntitle: \"A: title\"\ntype: rule\nstatus: stale\ncreated_at: 2026-01-01T00:00:00Z\nupdated_at: 2026-01-02T00:00:00+02:00\nreferences: [\"{UUID}\"]\nconfidence: 0.9\ntags: [\"a,b\", 'c']\n# note\n\npinned: true\n---\n\nBody\n---\nmore"


def test_record():
    r = markdown.record(GOOD)
    assert (r["id"], r["title"], r["type"], r["status"], r["refs"], r["body"]) == (UUID, "A: title", "rule", "stale", [UUID], "Body\n---\nmore")
    assert r["properties"] == {"confidence": "0.9", "tags": '["a,b", "c"]', "pinned": "true"}
    assert markdown.record(GOOD.replace("\n", "\r\n"))["id"] == UUID


@pytest.mark.parametrize(
    "bad",
    ["", "no frontmatter", "---\nid: x", GOOD.replace(UUID, "nope"), GOOD.replace("type: rule", "type: thing"), GOOD.replace("status: stale", "status: odd"), GOOD.replace("created_at: 2026-01-01T00:00:00Z\n", ""), GOOD.replace("2026-01-01T00:00:00Z", "2026-01-01"), GOOD.replace("pinned: true", "pinned"), GOOD.replace("pinned: true", "volatility: odd")],
)
def test_malformed(bad):
    with pytest.raises(markdown.Malformed):
        markdown.record(bad)


@pytest.mark.parametrize(("text", "want"), [("", ""), ("~", ""), ("null", ""), ("[]", []), ("[a, 'b']", ["a", "b"]), ("true", True), ("07", 7), ("1.0", 1.0), ("1e3", 1000.0), ('"12"', "12"), ("a b", "a b"), ("'x", "'x")])
def test_value(text, want):
    got = markdown.value(text)
    assert got == want and type(got) is type(want)


line = st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zl", "Zp")), max_size=20)
scalar = st.one_of(line, st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.lists(line, max_size=4))


@given(st.dictionaries(st.from_regex(r"[a-z_]{1,8}", fullmatch=True), scalar, max_size=5))
def test_frontmatter_round_trip(fields):
    assert markdown.parse(markdown.serialise(fields)) == fields


def test_read_and_sync(spark, tmp_path):
    other = GOOD.replace(UUID, UUID.replace("1", "2", 1))
    for name, text in {"a/one.md": GOOD, "b/two.md": GOOD, "c.md": other, "bad.md": "x", "skip.txt": GOOD}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = markdown.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", f"^.*{tmp_path}/", ""))
    schema = "id string, path string, content_hash string, status string"
    same = files.where("path = 'c.md'").first().content_hash
    old = spark.createDataFrame([(UUID.replace("1", "2", 1), "c.md", same, "active"), ("gone", "x.md", "h", "active"), ("kept", "bad.md", "h", "active")], schema)
    changes, errors = markdown.sync(old, files)
    assert sorted((r.path, r.change) for r in changes.collect()) == [("a/one.md", "created"), ("c.md", "skipped"), ("x.md", "stale")]
    assert sorted(r.path for r in errors.collect()) == ["b/two.md", "bad.md"]


def test_source_tree(spark, tmp_path):
    for name, text in {"src/a.py": "def f():\n    class C:\n        pass\n", "src/bad.py": "def", "gen/b.py": "x = 1", "gen/keep.py": "def g(): pass", "big.py": "#" * 3000, "note.md": "x", "deny/c.py": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = code.read_tree(spark, str(tmp_path), ignore=["gen/"], deny=["deny/**"], allow=["keep.py"], most=2000)
    assert sorted(r.path for r in files.collect()) == ["gen/keep.py", "src/a.py", "src/bad.py"]
    found = sorted((r.path, r.kind, r.qualified_name, r.line_start, r.line_end) for r in code.python_entities(files).where("error is null").collect())
    assert found == [("gen/keep.py", "function", "gen::keep::g", 1, 1), ("src/a.py", "class", "src::a::f::C", 2, 3), ("src/a.py", "function", "src::a::f", 1, 3)]
    assert code.python_entities(files).where("error is not null").count() == 1


def test_changed_files(spark):
    snap = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    out = code.changed_files(snap([("a", "1"), ("b", "1"), ("c", None)]), snap([("a", "1"), ("b", "2"), ("c", None), ("d", "1")]))
    assert sorted((r.path, r.change) for r in out.collect()) == [("b", "modified"), ("d", "added")]


def drive(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_sessions(spark, tmp_path):
    rows = [[("a", "2025-01-01 00:00:00", 1), ("a", "2025-01-01 00:20:00", 2)], [("a", "2025-01-01 00:10:00", 3), ("a", "2025-01-01 00:20:00", 2)], [("a", "2025-01-01 02:00:00", 4), ("b", "2025-01-01 02:00:00", 5)], [("b", "2025-01-01 09:00:00", 6)], [("b", "2025-01-01 18:00:00", 7)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "key string, at string, id bigint").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    source = spark.readStream.schema("key string, at timestamp, id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    got = sorted((r.key, r.first_id, r.last_id, r.n_events) for r in drive(spark, sessions.stream_sessions(source), "stream_sessions"))
    assert got == [("a", 1, 2, 3), ("a", 4, 4, 1), ("b", 5, 5, 1), ("b", 6, 6, 1)]


def test_stream_outcomes_agree_with_batch(spark, tmp_path):
    rows = [("w", 1, "deliver", 1, "a", "full"), ("w", 2, "deliver", 1, "b", "full"), ("w", 3, "deliver", 1, "c", "pointer"), ("w", 4, "touch", 0, "a", None), ("w", 6, "pull", 0, "c", None), ("w", 7, "boundary", 0, None, None), ("w", 8, "touch", 0, "b", None), ("w", 9, "deliver", 2, "b", "full")]
    schema = "key string, at int, step string, delivery_id bigint, entity_id string, tier string"
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    got = {(r.delivery_id, r.entity_id, r.outcome) for r in drive(spark, outcomes.stream_outcomes(source), "stream_outcomes")}
    batch = {(r.delivery_id, r.entity_id, r.outcome) for r in mining.outcomes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {x for x in batch if x[2] != "pending"}


def test_stream_saves(spark, tmp_path):
    rows = [("f", "2025-01-01 01:00:00"), ("f", "2025-01-01 02:00:00"), (None, "2025-01-01 02:00:00"), ("g", "2025-01-03 02:00:00")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "path string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    source = spark.readStream.schema("path string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    assert [(r.path, r.saves) for r in drive(spark, sessions.stream_saves(source), "stream_saves")] == [("f", 2)]
