"""Duplicates and contradictions among records that no edge links."""

import math
import os

import numpy as np
import pytest
from edge_tables import SMALL
from parity import compare, connect

from loamgraph.plans import upkeep

TIME = "2025-03-01T00:00:00Z"
IDLE = "Sessions expire after {} days of idle time."
#: id: type, status, content, group of close vectors
RECORDS = {
    "a1": ("rule", "active", IDLE.format(30), 0),
    "a2": ("rule", "active", IDLE.format(90), 0),
    "a3": ("rule", "pruned", IDLE.format(60), 0),
    "a4": ("knowledge", "active", IDLE.format(45), 0),
    "b1": ("observation", "active", "The cache is cleared nightly.", 1),
    "b2": ("observation", "active", "The cache is cleared nightly.", 1),
    "c1": ("function", "active", "fn open()", 2),
    "c2": ("function", "active", "fn open2()", 2),
}


def tables(spark, out, records):
    own = {"entities", "edges", "code_embeddings", "knowledge_embeddings"}
    for f in os.listdir(SMALL):
        if f.split(".")[0] not in own:
            os.symlink(f"{SMALL}/{f}", f"{out}/{f}")
    rng = np.random.default_rng(1)
    bases = rng.standard_normal((4, 768))
    unit = lambda x: x / np.linalg.norm(x)
    vector = lambda g: (math.sqrt(0.9) * unit(bases[g]) + math.sqrt(0.1) * unit(rng.standard_normal(768))).tolist()
    schema = {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in own}
    entities = [{"id": i, "type": t, "title": f"title of {i}", "content": c, "status": s, "created_at": TIME, "updated_at": TIME, "export_file": "f1"} for i, (t, s, c, _) in records.items()]
    code = [{"entity_id": i, "embedding": vector(g)} for i, (t, _, _, g) in records.items() if t == "function"]
    knowledge = [{"entity_id": i, "embedding": vector(g)} for i, (t, _, _, g) in records.items() if t != "function"]
    for t, rows in {"entities": entities, "edges": [], "code_embeddings": code, "knowledge_embeddings": knowledge}.items():
        columns = schema[t].columns
        spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema[t].schema).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables(spark, str(tmp_path_factory.mktemp("upkeep")), RECORDS)


def found(spark, folder, name):
    return sorted(tuple(r) for r in upkeep.QUERIES[name](spark, folder).collect())


def test_contradictions_without_edges(spark, folder):
    assert found(spark, folder, "con7_contradictions") == [("a1", "a2", "contradiction"), ("b1", "b2", "same"), ("c1", "c2", "none")]
    assert found(spark, folder, "con8_numeric_gate")[0] == ("a1", "a2", "contradiction")
    assert [r[:3] for r in found(spark, folder, "con6_candidates")] == [("a1", "a2", "rule"), ("b1", "b2", "observation"), ("c1", "c2", "function")]
    assert found(spark, folder, "con5_found_duplicates") == [("b1", "b2")]


def test_duplicates_of_every_type_by_vector(spark, folder):
    got = [(a, b, kind) for a, b, _, kind in found(spark, folder, "con3_duplicates")]
    assert got == [(a, b, "embedding") for p, q in (("a1", "a2"), ("b1", "b2"), ("c1", "c2")) for a, b in ((p, q), (q, p))]


def test_merges_of_a_large_topic(spark, tmp_path):
    out = tables(spark, str(tmp_path), {f"o{i:02}": ("observation", "active", f"note {i}", 3) for i in range(30)} | {"c1": RECORDS["c1"]})
    con = connect(out)
    assert compare(spark, con, out, "con9_merge_candidates") == (30 * 29 // 2, "")
    assert compare(spark, con, out, "con10_merged_records") == (31, "")
