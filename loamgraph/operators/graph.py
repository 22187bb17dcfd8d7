"""Bounded traversals of the record graph. A hop is one join; each hop's result is written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import durable

# Edge types written by people, and those that make code depend on code.
CURATED = ["references", "supports", "contradicts", "superseded_by", "derived_from", "promoted_from"]
DEPENDENCY = ["calls", "imports", "extends"]
SCORE_FLOOR, HOP_DECAY, EXPANSION_DECAY = 0.2, 0.5, 0.3
#: Of so many expansions one may be by co-change.
COCHANGE_PART = 4


def edge_weight(kind: Column) -> Column:
    """Quality of an edge type: curated 1, auto_references 0.7, all else 0.5."""
    return F.when(kind.isin(CURATED), 1.0).when(kind == "auto_references", 0.7).otherwise(0.5)


def both_ways(edges: DataFrame) -> DataFrame:
    """(here, there, edge_type, source_id, target_id): every edge from both of its ends."""
    out = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "edge_type", "source_id", "target_id")
    back = edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "edge_type", "source_id", "target_id")
    return out.unionByName(back)


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, depth) of all nodes within `hops` undirected hops of each seed (seed), itself excluded."""
    links = both_ways(edges).select("here", "there").distinct()
    visited = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier = visited
    for depth in range(1, hops + 1):
        step = frontier.join(links, F.col("node") == F.col("here")).select("seed", F.col("there").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = durable(step.join(visited, ["seed", "node"], "left_anti"))
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (source_id, target_id, edge_type) with an end among nodes (id)."""
    by = lambda c: edges.join(nodes.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    return by("source_id").select("source_id", "target_id", "edge_type").unionByName(by("target_id").select("source_id", "target_id", "edge_type")).distinct()


def referenced(edges: DataFrame, kind: str = "references") -> DataFrame:
    """(source_id, target_ids): the sorted targets of every record, joined by blanks; a record's targets are its own few."""
    return edges.where(F.col("edge_type") == kind).groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), " ").alias("target_ids"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, n_types): distinct neighbours of every node by direction, and its edge types."""
    a = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("out"), F.lit(None).cast("string").alias("in"), "edge_type")
    b = edges.select(F.col("target_id").alias("id"), F.lit(None).cast("string").alias("out"), F.col("source_id").alias("in"), "edge_type")
    return a.unionByName(b).groupBy("id").agg(F.countDistinct("out").alias("n_out"), F.countDistinct("in").alias("n_in"), F.countDistinct("edge_type").alias("n_types"))


def callers(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(id, caller_id, weight, rank): direct callers of every record, heaviest first, ties by id."""
    calls = edges.where("edge_type = 'calls'").join(records.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("weight"), "source_id"))
    return calls.select(F.col("target_id").alias("id"), F.col("source_id").alias("caller_id"), "weight", rank.alias("rank"))


def impact(seeds: DataFrame, edges: DataFrame, depth: int = 2, limit: int | None = None) -> DataFrame:
    """(seed, id, depth, via): what depends on each seed over incoming dependency edges, at its least depth, with the first of
    the edge types that reach it there. `limit` keeps the smallest ids of a seed, whatever their depth."""
    into = edges.where(F.col("edge_type").isin(DEPENDENCY)).select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "edge_type")
    visited = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit("").alias("via"))
    frontier = visited
    for level in range(1, min(depth, 4) + 1):
        step = frontier.join(into, F.col("id") == F.col("here")).groupBy("seed", F.col("there")).agg(F.min("edge_type").alias("via"))
        frontier = durable(step.select("seed", F.col("there").alias("id"), F.lit(level).alias("depth"), "via").join(visited, ["seed", "id"], "left_anti"))
        visited = visited.unionByName(frontier)
    found = visited.where("depth > 0")
    if limit is None:
        return found
    return found.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).where(F.col("n") <= limit).drop("n")


def referring_knowledge(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(id, knowledge_id): active knowledge that refers to each record, by hand or by mention."""
    refs = edges.where(F.col("edge_type").isin("references", "auto_references"))
    live = records.where("space = 'knowledge' and status = 'active'").select(F.col("id").alias("source_id"))
    return refs.join(live, "source_id", "left_semi").select(F.col("target_id").alias("id"), F.col("source_id").alias("knowledge_id")).distinct()


def governing_rules(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(id, rule_id, rank): active rules that refer to each record, latest first, ties by id."""
    rules = records.where("type = 'rule' and status = 'active'").select(F.col("id").alias("source_id"), "updated_us")
    pairs = edges.where("edge_type = 'references'").join(rules, "source_id")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.col("updated_us").desc_nulls_last(), "source_id"))
    return pairs.select(F.col("target_id").alias("id"), F.col("source_id").alias("rule_id"), rank.alias("rank"))


def orphans(edges: DataFrame, records: DataFrame, kinds: list[str], is_test: Column) -> DataFrame:
    """Active records of the kinds, outside of test paths, into which no dependency edge leads."""
    used = edges.where(F.col("edge_type").isin(DEPENDENCY)).select(F.col("target_id").alias("id")).distinct()
    return records.where(F.col("type").isin(kinds) & (F.col("status") == "active")).where(~is_test).join(used, "id", "left_anti")


def expand(seeds: DataFrame, edges: DataFrame, hops: int, kinds: list[str] | None = None, per_seed: bool = False, by: tuple[str, ...] = (), trail: bool = True, floor: float | None = None) -> DataFrame:
    """(by…, seed, node, depth, path, types): traversal from all seeds (by…, seed) of a group at once, each node claimed once
    per group, or, `per_seed`, once for every seed. path: ids from the seed on (left out without `trail`), types: the edge types
    between them.

    Where several edges lead from the frontier to a node, the heaviest type claims it, then the smallest source, target and
    type. Both directions are followed.

    With a `floor`, seeds have a score `own`, which comes out too, and nodes of the last hop may be left out if their
    expansion_score() does not reach it: an edge type too light to reach it from any node of its group can neither give such a
    path nor take a node from a heavier type.
    """
    used = edges if kinds is None else edges.where(F.col("edge_type").isin(kinds))
    links = both_ways(used).withColumn("w", edge_weight(F.col("edge_type")))
    scope = [*by, "seed", "node"] if per_seed else [*by, "node"]
    own = [] if floor is None else ["own"]
    found = seeds.select(*by, "seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.array("seed").alias("path"), F.array().cast("array<string>").alias("types"), *own).distinct()
    found = found if trail else found.drop("path")
    carried = [*(["path", "types"] if trail else ["types"]), *own]  # an edge and its claim name one row of the frontier, so they decide nothing
    frontier = found
    for depth in range(1, hops + 1):
        ends, leads = frontier.drop("depth"), F.col("node") == F.col("here")
        if floor is not None and depth == hops:
            group = [*by, "seed"] if per_seed else [*by]
            best = ends.groupBy(*group).agg(F.max(expansion_score(F.col("own"), F.lit(depth), F.col("types"))).alias("best"))
            ends, leads = ends.join(best, group) if group else ends.crossJoin(best), leads & (F.col("best") * F.col("w") >= floor - 1e-9)
        step = ends.join(links, leads).drop("node", "best").withColumnRenamed("there", "node")
        new = step.join(found.select(*scope), scope, "left_anti")
        # The smallest claim, not a sorted window: claims of a contested node are combined before they are shuffled.
        claim = F.min(F.struct((-F.col("w")).alias("less"), "source_id", "target_id", "edge_type", F.col("seed").alias("of"), *carried)).alias("c")
        taken = new.groupBy(*scope).agg(claim).select(*by, F.col("c.of").alias("seed"), "node", *[f"c.{x}" for x in carried], "c.edge_type")
        longer = [*[F.array_append(x, F.col(end)).alias(x) for x, end in (("path", "node"), ("types", "edge_type")) if x in carried], *own]
        frontier = taken.select(*by, "seed", "node", F.lit(depth).alias("depth"), *longer)
        frontier = durable(frontier) if depth < hops else frontier
        found = found.unionByName(frontier)
    return found.where("depth > 0")


def path_weight(types: Column) -> Column:
    return F.aggregate(F.transform(types, edge_weight), F.lit(1.0), lambda a, w: a * w)


def graph_first(seeds: DataFrame, edges: DataFrame, exclude: DataFrame | None = None, hops: int = 2, decay: float = HOP_DECAY, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, node, score, direct): nodes reached from weighted seeds (by…, seed, weight, direct) over curated edges, scored by
    the sum of weight * decay ** hops * edge weights over the seeds that reach them; scores below SCORE_FLOOR and excluded ids
    (by…, id) are left out. A seed's paths do not depend on its group and are made once."""
    paths = expand(seeds.select("seed").distinct(), edges, hops, CURATED, per_seed=True, trail=False).join(seeds, "seed")
    part = F.col("weight") * F.pow(F.lit(decay), F.col("depth")) * path_weight(F.col("types"))
    rows = paths.groupBy(*by, "node").agg(F.round(F.sum(part), 9).alias("score"), F.max("direct").alias("direct")).where(F.col("score") >= SCORE_FLOOR)
    return rows if exclude is None else rows.join(exclude.select(*by, F.col("id").alias("node")).distinct(), [*by, "node"], "left_anti")


def seed_weights(lists: list[DataFrame], most: int = 20, keep: int = 60) -> DataFrame:
    """(query_id, seed, weight, direct): the best 1 / (1 + place / most) of the lists (query_id, id, rank from 1, direct);
    `most` of each list, `keep` per query."""
    rows = reduce(DataFrame.unionByName, [x.where(F.col("rank") <= most).select("query_id", "id", (1 / (1 + (F.col("rank") - 1) / F.lit(float(most)))).alias("weight"), "direct") for x in lists])
    best = rows.groupBy("query_id", F.col("id").alias("seed")).agg(F.max("weight").alias("weight"), F.max("direct").alias("direct"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "seed"))
    return best.withColumn("n", rank).where(F.col("n") <= keep).drop("n")


def title_overlap(title: Column, terms: Column) -> Column:
    """How many tokens of a title are among the query's."""
    from loamgraph.operators.lexical import tokenize

    return word_overlap(tokenize(title), terms)


def word_overlap(words: Column, terms: Column) -> Column:
    """title_overlap() of a title's tokens, for titles that many rows bear."""
    return F.size(F.filter(words, lambda t: F.array_contains(terms, t)))


def sibling_score(seed: Column, overlap: Column) -> Column:
    return seed * (0.15 + 0.15 * F.least(overlap, F.lit(4)))


def cochange_score(idf: Column, overlap: Column, count: Column) -> Column:
    return 0.07 + 0.08 * idf / (idf + 3.0) + 0.05 * F.least(overlap, F.lit(3)) + 0.005 * F.least(count, F.lit(8))


def expansion_score(seed: Column, depth: Column, types: Column) -> Column:
    return seed * F.pow(F.lit(EXPANSION_DECAY), depth) * path_weight(types)


def capped(expansions: DataFrame, limit: int) -> DataFrame:
    """Expansions (query_id, id, score, channel) up to `limit` per query, best first; co-change ones at most a quarter of it
    besides."""
    quota = F.when(F.col("channel") == "co-change", limit // COCHANGE_PART).otherwise(limit)
    kind = F.col("channel") == "co-change"
    rank = F.row_number().over(Window.partitionBy("query_id", kind).orderBy(F.desc("score"), "id"))
    return expansions.withColumn("n", rank).where(F.col("n") <= quota).drop("n")


def described(paths: DataFrame, titles: DataFrame, edges: DataFrame) -> DataFrame:
    """paths (key, path) with a text: titles (ids where there are none) joined by the edge types between them, an arrow where
    no edge leads that way."""
    steps = paths.select("key", F.posexplode("path").alias("at", "id"), "path").withColumn("next", F.expr("try_element_at(path, at + 2)"))
    named = steps.join(titles.select("id", "title"), "id", "left")
    kinds = edges.groupBy(F.col("source_id").alias("id"), F.col("target_id").alias("next")).agg(F.min("edge_type").alias("kind"))
    joined = named.join(kinds, ["id", "next"], "left")
    text = F.concat_ws(" → ", F.coalesce("title", "id"), F.when(F.col("next").isNotNull(), F.regexp_replace(F.coalesce("kind", F.lit("→")), "_", " ")))
    parts = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))).alias("parts"))
    return parts.select("key", F.array_join(F.transform("parts", lambda p: p["text"]), " → ").alias("description"))


def contains_edges(records: DataFrame) -> DataFrame:
    """(source_id, target_id) from each file to the functions and classes of its path; a path's file is its smallest id."""
    files = records.where("type = 'file' and file_path is not null").groupBy("file_path").agg(F.min("id").alias("source_id"))
    members = records.where("type in ('function', 'class') and file_path is not null").select("file_path", F.col("id").alias("target_id"))
    return members.join(files, "file_path").select("source_id", "target_id")
