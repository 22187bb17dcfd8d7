"""Whole pipelines: search, its evaluation, its JSON answer; records as Markdown and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators import joining, metrics
from loamgraph.plans import model as m
from loamgraph.plans import search
from loamgraph.session import durable
from loamgraph.sources import markdown, sinks

query = m.Catalog()
PACK_TOKENS = 8192


query("rnk14_search")(search.search)


def answers(s, d) -> DataFrame:
    """(query_id, results): each question's results as JSON, with titles."""
    c = search.corpus(s, d)  # whose records all results are
    return sinks.as_json(search.search(s, d, c).join(c.records.select("id", "title"), "id"), "query_id", "results", ["rank"])


query("snk4_json_answers")(answers)


def expected_answers(c: search.Corpus) -> DataFrame:
    """(query_id, id) of the records that bear a question's whole title in their content or as their title; id is null for a
    question without any."""
    asked = c.questions.select("query_id", F.col("text").alias("pattern")).where("trim(pattern) <> ''")
    patterns = asked.select("pattern").distinct()
    same = c.records.select("id", F.col("title").alias("pattern")).join(patterns, "pattern", "left_semi").select("id", "pattern")
    bearing = same.unionByName(joining.containing(c.records.select("id", F.col("content").alias("text")), patterns))
    expected = asked.join(bearing, "pattern").where("query_id <> id").select("query_id", "id").distinct()
    return c.questions.select("query_id").join(expected, "query_id", "left")


def packed(c: search.Corpus, results: DataFrame, budget: int = PACK_TOKENS) -> DataFrame:
    """(query_id, id) of the results that fit, best first, into a pack of `budget` tokens (four characters each)."""
    sized = results.join(c.records.select("id", F.floor((F.length("title") + F.length("content")) / 4).alias("tokens")), "id")
    upto = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("upto", upto).where(F.col("upto") <= budget).select("query_id", "id")


def evaluated(s, d) -> DataFrame:
    """Search held against expected_answers(): means over the questions, recall of a pack, and the bounds of the mean reciprocal
    rank."""
    c = search.corpus(s, d)
    expected, results = durable(expected_answers(c)), durable(search.search(s, d, c).withColumn("direct", F.col("channel") == "direct"))
    return metrics.summary(durable(metrics.scores(results, expected, packed=packed(c, results))))


query("agg15_retrieval_metrics")(evaluated)


def as_markdown(s, d) -> DataFrame:
    """(path, text): every knowledge record as a Markdown file."""
    rec = m.records(s, d).where("space = 'knowledge' and title is not null")
    shape = rec.select("id", "title", "type", "status", "created_us", "updated_us", "category", "confidence", "content")

    def write(batches):
        for b in batches:
            out = []
            for x in b.itertuples():
                stamp = lambda us: pd.Timestamp(us if us == us and us is not None else 0, unit="us").isoformat() + "Z"
                fields = {"id": x.id, "title": x.title, "type": x.type, "status": x.status, "created_at": stamp(x.created_us), "updated_at": stamp(x.updated_us), "references": []}
                fields |= {"category": x.category} if x.category else {}
                fields |= {"confidence": float(x.confidence)} if x.confidence == x.confidence and x.confidence is not None else {}
                out.append((f"{x.type}/{x.id}.md", f"---\n{markdown.serialise(fields)}---\n\n{x.content}"))
            yield pd.DataFrame(out, columns=["path", "text"])

    return shape.mapInPandas(write, "path string, text string")


query("src5_markdown_round_trip", m.sql("rec", "select id, title, type, status, content as body, cast(null as varchar) as error from rec where space = 'knowledge' and title is not null"))(
    lambda s, d: markdown.read_records(as_markdown(s, d)).select("id", "title", "type", "status", "body", "error")
)
QUERIES, SQL = query.queries, query.sql
