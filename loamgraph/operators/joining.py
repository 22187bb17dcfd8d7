"""Joins beyond plain equality: intervals, boundaries, successors, names, mentions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.code import is_identifier_shaped
from loamgraph.operators.ordered import running_sum, running_sums
from loamgraph.session import durable

BIN = 64


def interval_overlap(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: int = BIN) -> DataFrame:
    """Pairs of rows of one key whose closed intervals [a0, a1] and [b0, b1] share a point.

    Both sides are spread over bins of `width`, so that a key with many rows is many join keys; a pair is kept in the first
    bin both touch. Rows with null bounds, or whose end lies before their start, overlap nothing.
    """
    spread = lambda df, lo, hi: df.where(F.col(lo) <= F.col(hi)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    x, y = spread(left, *a), spread(right, *b)
    pairs = x.join(y, [key, "bin"]).where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    return pairs.where(F.col("bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)).drop("bin")


def siblings(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(anchor, sibling): members of a file reach all members through it, a file reaches its members; of the `wanted` anchors
    (anchor) only, where they are given."""
    contains = edges.where("edge_type = 'contains'").select(F.col("source_id").alias("file"), F.col("target_id").alias("member"))
    anchors = contains.select(F.col("member").alias("anchor"), "file").unionByName(contains.select(F.col("file").alias("anchor"), "file")).distinct()
    anchors = anchors if wanted is None else anchors.join(wanted, "anchor", "left_semi")
    return anchors.join(contains, "file").select("anchor", F.col("member").alias("sibling")).distinct()


def between_boundaries(log: DataFrame, anchors: DataFrame, wanted: DataFrame, boundary, key: str, most: int = 25) -> DataFrame:
    """(anchor id, wanted row): the first `most` rows of `wanted`, by id, after an anchor and before the next boundary event of
    the same key.

    log, anchors and wanted have (key, id), the latter two of rows of log; `boundary` is a condition on log. The wanted rows
    of a key are numbered through, so an anchor meets its next `most` numbers in its segment, the count of boundaries
    before a row, and nothing else.
    """
    marked = log.select(key, "id", boundary.alias("_bound")).join(wanted.select(key, "id").distinct().withColumn("_wanted", F.lit(1)), [key, "id"], "left")
    marks = running_sums(marked, key, "id", {"segment": F.col("_bound").cast("int"), "number": F.col("_wanted")}).select(key, "id", "segment", "number")
    a = anchors.join(marks, [key, "id"]).withColumnRenamed("id", "anchor_id")
    found = wanted.join(marks, [key, "id"])
    # Numbers grow with segments, so those behind an anchor up to the last of its segment are in it.
    a = a.join(found.groupBy(key, "segment").agg(F.max("number").alias("last")), [key, "segment"]).where(F.col("last") > F.col("number"))
    a = a.withColumn("number", F.explode(F.sequence(F.col("number") + 1, F.least(F.col("number") + most, "last")))).drop("last")
    return a.join(found, [key, "number", "segment"]).drop("segment", "number")


def first_successor(calls: DataFrame, order_key: str, window: int = 20) -> DataFrame:
    """(error_id, fix_id, tool): for each failed call, the first clean call of its tool among the next `window` calls of the
    same `order_key`, calls of all tools counted. calls: (order_key, id, tool, failed)."""
    numbered = running_sum(calls, order_key, "id", F.lit(1), "n")
    bad = numbered.where("failed and tool <> ''").select(order_key, "tool", F.col("id").alias("error_id"), F.col("n").alias("at"))
    good = numbered.where("not failed").select(order_key, "tool", F.col("id").alias("fix_id"), "n")
    spread = bad.withColumn("block", F.explode(F.array(F.floor(F.col("at") / window), F.floor(F.col("at") / window) + 1)))
    pairs = spread.join(good.withColumn("block", F.floor(F.col("n") / window)), [order_key, "tool", "block"]).where(F.col("n").between(F.col("at") + 1, F.col("at") + window))
    return pairs.groupBy("error_id", "tool").agg(F.min("fix_id").alias("fix_id"))


def resolve_names(raw: DataFrame, names: DataFrame) -> DataFrame:
    """(…, target_id): the id a raw name stands for: by its whole spelling if unique, else by its last `::` segment if that
    is unique; ambiguous and unknown names resolve to null. names: (name, id)."""
    unique = names.where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("target_id")).where("n = 1").drop("n")
    last = F.element_at(F.split("raw_name", "::"), -1)
    first = raw.join(unique.select(F.col("name").alias("raw_name"), F.col("target_id").alias("by_name")), "raw_name", "left")
    second = first.withColumn("name", last).join(unique, "name", "left")
    return second.withColumn("target_id", F.coalesce("by_name", "target_id")).drop("name", "by_name")


#: Patterns of one automaton, which is broadcast (about 100 bytes a pattern and what it holds of text); more go in blocks.
PATTERNS = 500_000
_BUILT: dict[str, object] = {}


def _blocks(patterns: DataFrame, texts: DataFrame, scan, schema: str, alone=None) -> DataFrame:
    """The union of scan(automaton, texts' batch) over blocks of the distinct rows (pattern, …). The driver holds one block at
    a time; a worker builds each block's automaton once. An automaton's values are whole rows. `alone`, a pair of a function
    and its schema, is applied to what scan() gives if there is one block only."""
    listed = durable(patterns)
    blocks = max(1, -(-listed.count() // PATTERNS))
    after, schema = alone if alone and blocks == 1 else (lambda x: x, schema)
    parts = []
    for b in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).collect()
        shared = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches: Iterator[pd.DataFrame], shared=shared, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            automaton = _automaton(name, shared)
            for batch in batches if len(automaton) else ():
                yield after(scan(automaton, batch))

        parts.append(texts.mapInPandas(run, schema))
    return reduce(DataFrame.unionByName, parts)


def _automaton(name: str, shared):
    """The automaton of a broadcast block, built once per worker."""
    if name not in _BUILT:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for row in shared.value:
            automaton.add_word(row[0], row)
        if len(automaton):
            automaton.make_automaton()
        if len(_BUILT) > 1:
            _BUILT.clear()
        _BUILT[name] = automaton
    return _BUILT[name]


def mentions(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(source_id, target_id): code that a text mentions. texts: (source_id, text); patterns: (pattern, target_id, is_path).

    Leftmost-longest, non-overlapping matches of all patterns. A path counts anywhere, an identifier-shaped name between word
    boundaries, a bare word only in a code-like place too (after an odd number of backticks, before `(`, after `::` or `.`).
    Of equal patterns a path counts, then the largest target. Blocks of patterns give the longest match at every place of a
    text, which are reconciled per text; one block does so at once.
    """
    listed = patterns.where("pattern <> ''").withColumn("identifier", is_identifier_shaped(F.col("pattern")))
    rows = listed.groupBy("pattern").agg(F.max(F.struct("is_path", "target_id", "identifier")).alias("p")).select("pattern", "p.target_id", "p.is_path", "p.identifier")
    columns = ["source_id", "start", "end", "target_id", "counts"]

    def scan(automaton, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for source, text in zip(batch["source_id"], batch["text"]):
            longest = {}
            for last, (pattern, target, path, identifier) in automaton.iter(text):
                start = last + 1 - len(pattern)
                if longest.get(start, (0,))[0] < last + 1:
                    longest[start] = (last + 1, target, path, identifier)
            for start, (end, target, path, identifier) in longest.items():
                counts = path or _bounded(text, start, end) and (identifier or _code_like(text, start, end))
                out.append((source, start, end, target, bool(counts)))
        return pd.DataFrame(out, columns=columns)

    def kept(matches: pd.DataFrame) -> pd.DataFrame:
        """Of one or more texts: from left to right the longest match at the first place that is free."""
        out, now, taken = [], None, 0
        for source, start, end, target, counts in matches.sort_values(["source_id", "start", "end"], ascending=[True, True, False]).itertuples(index=False, name=None):
            taken = taken if source == now else 0
            now = source
            if start >= taken:
                taken = end
                if counts:
                    out.append((source, target))
        return pd.DataFrame(out, columns=["source_id", "target_id"])

    schema = "source_id string, target_id string"
    asked = texts.where("text is not null and source_id is not null").select("source_id", "text")
    found = _blocks(rows, asked, scan, "source_id string, start int, end int, target_id string, counts boolean", (kept, schema))
    return (found.groupBy("source_id").applyInPandas(kept, schema) if "start" in found.columns else found).distinct()


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern): texts (id, text) that hold a pattern anywhere, exactly as written; overlapping ones all count."""

    def scan(automaton, batch: pd.DataFrame) -> pd.DataFrame:
        out = [(i, p) for i, text in zip(batch["id"], batch["text"]) for p in {p for _, (p,) in automaton.iter(text)}]
        return pd.DataFrame(out, columns=["id", "pattern"])

    kind = dict(texts.dtypes)["id"]
    rows = patterns.where("pattern <> ''").select("pattern").distinct()
    return _blocks(rows, texts.where("id is not null and text is not null").select("id", "text"), scan, f"id {kind}, pattern string").distinct()


def _bounded(text: str, start: int, end: int) -> bool:
    part = lambda c: c.isascii() and (c.isalnum() or c == "_")
    return not (start > 0 and part(text[start - 1])) and not (end < len(text) and part(text[end]))


def _code_like(text: str, start: int, end: int) -> bool:
    return text[end : end + 1] == "(" or text[max(0, start - 2) : start] == "::" or text[start - 1 : start] == "." or text.count("`", 0, start) % 2 == 1
