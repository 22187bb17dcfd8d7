"""Context packs: ordered sections within a token budget.

Sections: (query_id, source, id, title, content, relevance[, rank]). A query's sections are few (its result list); sums run
within a query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGETS = {"cold_start": 4096, "task": 8192, "escalation": 8192}
TAIL_RANK, DUPLICATE_LINES, INDEX_ENTRIES, INDEX_TITLE = 20, 0.5, 25, "Also relevant"
# Order of the kinds of sections; lines kept in summaries, in the tail and when there is room.
PRIORITY = {"identity": 0, "rule": 1, "knowledge": 2, "function": 3, "class": 3, "file": 3, "module": 3, "observation": 4}
SUMMARY_LINES = {"module": 1, "file": 15, "function": 10, "class": 10}
TAIL_LINES = {"module": 1, "file": 8, "function": 4, "class": 4, "knowledge": 8, "observation": 8, "rule": 8}
RELAXED_LINES = {"module": 3, "file": 30, "function": 40, "class": 40}


def tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down; 0 for null."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)


def section_tokens(title: Column, content: Column) -> Column:
    return tokens(title) + tokens(content)


def _of(table: dict, source: Column, default: Column | int | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    value = F.create_map(*pairs)[source]
    return value if default is None else F.coalesce(value, F.lit(default))


def priority(sections: DataFrame, mode: str = "task") -> DataFrame:
    """Sections with their rank: by relevance, then kind, then id; in cold_start by kind first."""
    kind = _of(PRIORITY, F.col("source"), 5)
    keys = [kind, F.desc("relevance")] if mode == "cold_start" else [F.desc("relevance"), kind]
    return sections.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys, "id")))


def lines(text: Column) -> Column:
    """Lines of a text without their ends; an end at the very end opens no line; empty for null and empty texts."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def excerpt(text: Column, most: Column) -> Column:
    """The first `most` lines and a note of how many more there are; the whole text if it has no more."""
    all_lines = lines(text)
    cut = F.concat(F.array_join(F.slice(all_lines, F.lit(1), most), "\n"), F.lit("\n... ("), (F.size(all_lines) - most).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(all_lines) <= most, text).otherwise(cut)


def truncated(text: Column, budget: Column) -> Column:
    """The text within `budget` tokens, with `...` if cut; empty for a budget of 0."""
    most = budget * 4
    head = F.concat(F.substring(text, F.lit(1), F.greatest(most - 3, F.lit(0)).cast("int")), F.lit("..."))
    return F.when(budget == 0, "").when(F.length(text) <= most, text).otherwise(head)


def summarised(sections: DataFrame) -> DataFrame:
    """Code sections cut to their first lines by kind; others whole."""
    most = _of(SUMMARY_LINES, F.col("source"))
    return sections.withColumn("content", F.when(most.isNotNull(), excerpt(F.col("content"), F.coalesce(most, F.lit(1)))).otherwise(F.col("content")))


def tail_compressed(sections: DataFrame) -> DataFrame:
    """Ranked sections beyond TAIL_RANK cut to few lines by kind."""
    most = _of(TAIL_LINES, F.col("source"))
    return sections.withColumn("content", F.when((F.col("rank") > TAIL_RANK) & most.isNotNull(), excerpt(F.col("content"), F.coalesce(most, F.lit(1)))).otherwise(F.col("content")))


def fitted(sections: DataFrame, budget: int) -> DataFrame:
    """Ranked sections with fate `kept`, `truncated` or `dropped` and the content that remains.

    In order of rank a section is kept while the budget holds; the first that does not fit is cut to what is left; later
    ones are dropped unless they cost nothing.
    """
    cost = section_tokens(F.col("title"), F.col("content"))
    before = F.coalesce(F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sections.withColumn("cost", cost).withColumn("before", before)
    fate = F.when((F.col("before") + F.col("cost") <= budget) | (F.col("cost") == 0), "kept").when(F.col("before") < budget, "truncated").otherwise("dropped")
    room = F.greatest(budget - F.col("before") - tokens(F.col("title")), F.lit(0))
    return rows.withColumn("fate", fate).withColumn("content", F.when(F.col("fate") == "truncated", truncated(F.col("content"), room)).otherwise(F.col("content"))).drop("before")


def pointer_index(overflow: DataFrame, room: DataFrame) -> DataFrame:
    """(query_id, id, line, rank): pointers to sections left out, best first, at most INDEX_ENTRIES, as long as they fit into
    what is left (query_id, available) after the index's title."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    line = F.concat(F.lit("- ["), F.col("source"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" — id "), F.col("id").cast("string"))
    rows = overflow.withColumn("line", line).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= INDEX_ENTRIES)
    used = F.sum(tokens(F.col("line")) + 1).over(Window.partitionBy("query_id").orderBy("rank"))
    kept = rows.withColumn("used", used).join(room, "query_id").where(F.col("used") <= F.col("available") - len(INDEX_TITLE) // 4)
    return kept.select("query_id", "id", "line", "rank")


def line_set(text: Column) -> Column:
    """Distinct trimmed lines of more than three bytes."""
    return F.array_distinct(F.filter(F.transform(lines(text), F.trim), lambda x: F.octet_length(x) > 3))


def overlapping(sections: DataFrame) -> DataFrame:
    """(query_id, id, other_id, overlap): pairs of a query's sections whose line sets have a Jaccard similarity of
    DUPLICATE_LINES or more; found through the lines they share."""
    sets = sections.select("query_id", "id", line_set(F.col("content")).alias("ls"))
    flat = sets.select("query_id", "id", F.size("ls").alias("n"), F.explode("ls").alias("line"))
    other = flat.select("query_id", F.col("id").alias("other_id"), F.col("n").alias("m"), "line")
    shared = flat.join(other, ["query_id", "line"]).where("id < other_id").groupBy("query_id", "id", "other_id", "n", "m").agg(F.count("*").alias("c"))
    return shared.select("query_id", "id", "other_id", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("overlap")).where(F.col("overlap") >= DUPLICATE_LINES)


# Sequential steps over one query's sections.


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else []


def _set(text: str) -> frozenset:
    return frozenset(x.strip() for x in _lines(text) if len(x.strip().encode()) > 3)


def _excerpt(text: str, most: int) -> str:
    ls = _lines(text)
    return text if len(ls) <= most else "\n".join(ls[:most]) + f"\n... ({len(ls) - most} more lines)"


def _cut(text: str, budget: int) -> str:
    return "" if budget == 0 else text if len(text) <= budget * 4 else text[: max(budget * 4 - 3, 0)] + "..."


def _cost(s: dict) -> int:
    return len(s["title"]) // 4 + len(s["content"]) // 4


def without_overlap(sections: list[dict]) -> tuple[list[dict], list[dict]]:
    """(kept, duplicates): a section whose lines overlap an earlier kept one's by half or more is a duplicate."""
    kept, sets, twice = [], [], []
    for s in sections:
        own = _set(s["content"])
        if own and any(len(own & x) / len(own | x) >= DUPLICATE_LINES for x in sets if x):
            twice.append(s)
        else:
            kept.append(s)
            sets.append(own)
    return kept, twice


def relaxed(sections: list[dict], full: dict, budget: int) -> list[dict]:
    """Code sections grown again into what is left: in a first pass up to their relaxed lines, in a second one whole."""
    used, out = sum(map(_cost, sections)), [dict(s) for s in sections]
    for whole in (False, True):
        for s in out:
            if used >= budget:
                return out
            if s["id"] not in full:
                continue
            own = len(s["content"]) // 4
            text = full[s["id"]] if whole else _excerpt(full[s["id"]], RELAXED_LINES.get(s["source"], 40))
            text = _cut(text, budget - used + own) if len(text) // 4 > budget - used + own else text
            if len(text.encode()) > len(s["content"].encode()):
                used += len(text) // 4 - own
                s["content"] = text
    return out


def assembled(sections: list[dict], budget: int, mode: str = "task", baseline: list[dict] = ()) -> tuple[list[dict], list[str]]:
    """The pack (sections in order, an index of pointers last) and the ids that were left out of it.

    Sections carry their whole content; code is summarised first. Baseline sections are never cut.
    """
    key = (lambda s: (PRIORITY.get(s["source"], 5), -s["relevance"], s["id"])) if mode == "cold_start" else (lambda s: (-s["relevance"], PRIORITY.get(s["source"], 5), s["id"]))
    full = {s["id"]: s["content"] for s in sections if s["source"] in SUMMARY_LINES}
    short = [s | {"content": _excerpt(s["content"], SUMMARY_LINES[s["source"]]) if s["source"] in SUMMARY_LINES else s["content"]} for s in sections]
    kept, left = without_overlap(sorted([*({**b, "baseline": True} for b in baseline), *short], key=key))
    base, rest = [s for s in kept if s.get("baseline")], [s for s in kept if not s.get("baseline")]
    room = max(budget - sum(map(_cost, base)), 0)
    rest = [s | {"content": _excerpt(s["content"], TAIL_LINES[s["source"]])} if i >= TAIL_RANK and s["source"] in TAIL_LINES else s for i, s in enumerate(rest)]
    used, fit = 0, []
    for s in rest:
        if used + _cost(s) <= room:
            used += _cost(s)
            fit.append(s)
        elif used < room:
            fit.append(s | {"content": _cut(s["content"], max(room - used - len(s["title"]) // 4, 0))})
            used = room
        else:
            left.append(s)
    pack = [*base, *fit]
    if full:
        pack, again = without_overlap(relaxed(pack, full, budget))
        for s in again:
            s = s | {"content": _excerpt(s["content"], 4)}
            (left if len(without_overlap([*pack, s])[1]) else pack).append(s)
    room, index, pointed = max(budget - sum(map(_cost, pack)) - len(INDEX_TITLE) // 4, 0), [], []
    for s in sorted(left, key=lambda s: (-s["relevance"], s["id"]))[:INDEX_ENTRIES]:
        line = f"- [{s['source']}] {s['title']} — id {s['id']}"
        if len(line) // 4 + 1 > room:
            break
        room -= len(line) // 4 + 1
        index.append(line)
        pointed.append(s["id"])
    if index:
        pack.append({"source": "overflow_index", "id": "index", "title": INDEX_TITLE, "content": "\n".join(index), "relevance": 0.0})
    return pack, [s["id"] for s in left]


def packs(sections: DataFrame, budget: int = BUDGETS["task"], mode: str = "task") -> DataFrame:
    """(query_id, position, source, id, title, content, tokens) of every query's assembled pack."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(title=pdf["title"].fillna(""), content=pdf["content"].fillna(""), id=pdf["id"].astype(str)).to_dict("records")
        pack, _ = assembled(rows, budget, mode)
        return pd.DataFrame(
            [(pdf["query_id"].iloc[0], i, s["source"], s["id"], s["title"], s["content"], _cost(s)) for i, s in enumerate(pack, 1)], columns=["query_id", "position", "source", "id", "title", "content", "tokens"]
        )

    kind = dict(sections.dtypes)["query_id"]
    schema = f"query_id {kind}, position int, source string, id string, title string, content string, tokens bigint"
    return sections.select("query_id", "source", "id", "title", "content", "relevance").groupBy("query_id").applyInPandas(run, schema)


def deduplicated(sections: DataFrame) -> DataFrame:
    """(query_id, id, duplicate) of ranked sections: whether an earlier kept section holds half of its lines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").assign(content=pdf["content"].fillna("")).to_dict("records")
        twice = {s["id"] for s in without_overlap(rows)[1]}
        return pd.DataFrame([(s["query_id"], s["id"], s["id"] in twice) for s in rows], columns=["query_id", "id", "duplicate"])

    kinds = dict(sections.dtypes)
    return sections.select("query_id", "id", "content", "rank").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, duplicate boolean")
