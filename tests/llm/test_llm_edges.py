"""The llm queries on empty and on cluttered tables, and on very long texts."""

import pytest
from edge_tables import SMALL, cluttered, empty, rows
from pyspark.sql import functions as F

from loamgraph.llm import distinctive, leaks, neardup, packing, queries, truncation

TABLES = ["entities", "documents", "eval_items", "pack_budgets", "code_embeddings", "knowledge_embeddings"]


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    empty(spark, folder, TABLES)
    return folder


@pytest.fixture(scope="module")
def clutter(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("clutter"))
    cluttered(spark, folder, TABLES)
    return folder


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, none, name):
    assert queries.QUERIES[name](spark, none).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_scores", "p4_found", "p6_found", "p8_found", "p9_found", "p7_fills"])
def test_clutter_changes_nothing(spark, clutter, name):
    got, want = rows(queries.QUERIES[name](spark, clutter)), rows(queries.QUERIES[name](spark, SMALL))
    assert got == want


def test_very_long_texts(spark):
    long = "lorem ipsum dolor sit amet " * 60_000
    texts = spark.createDataFrame([("a", long + "one."), ("b", long + "two"), ("c", "x" * 1_500_000)], "id string, text string")
    assert {(r.id_a, r.id_b) for r in neardup.similar_pairs(neardup.shingled(texts, 3), 0.6).collect()} == {("a", "b")}
    terms = texts.select(F.col("id").alias("entity_id"), distinctive.terms(F.col("text")).alias("terms"))
    assert {r.entity_id for r in distinctive.term_scores(terms).where("term = 'lorem' and tf = 60000").collect()} == {"a", "b"}
    docs = texts.select(F.xxhash64("id").alias("doc_id"), F.lit("s").alias("source"), "text")
    assert truncation.flagged(docs).where("cut").count() == 2
    items = spark.createDataFrame([(1, "s", "lorem ipsum dolor sit amet " * 4)], "item_id bigint, suite string, text string")
    assert leaks.leaked_pairs(leaks.passages(docs, items)).count() == 2
    assert packing.token_lengths(docs.where("text not like 'xxx%'")).where("tokens > 250000").count() == 2
