"""The whole search over records: direct results of both channels, then everything that leads on from them.

Questions are the titles (and vectors) of the active records whose id's last four hexadecimal digits make a number divisible by
20; they are asked of all active records. Vectors, edges and lists are written once and read by every step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions import code
from loamgraph.operators import consolidate, drift, fusion, graph, joining, lexical, mining, vectors
from loamgraph.plans import model as m
from loamgraph.plans import upkeep
from loamgraph.session import durable, released, together
from loamgraph.sources.tables import table

LIMIT = 10
FIELDS = {"title": 5.0, "content": 1.0, "search_terms": 0.5}
# Decays of what leads on from the direct results, the least cosine of a direct seed, the bounds of a weak one.
PRF_DECAY, DEEP_DECAY, WEAK_DECAY, DIRECT_COSINE, WEAK_BOUNDS = 0.3, 0.25, 0.3, 0.7, (0.5, 1.0)
FEEDBACK, HEAD, STRENGTH, GRADIENT = 5, 10, 3, 5
#: Ids of active records that are sent to every task; more are joined by shuffle.
BROADCAST_IDS = 200_000


@dataclass
class Corpus:
    """What a search reads, written to the shared folder once. tokens: the records' index tokens by field, joined by blanks."""

    records: DataFrame
    edges: DataFrame
    vectors: DataFrame
    questions: DataFrame
    drifted: DataFrame
    curated: DataFrame
    changes: DataFrame
    tokens: DataFrame


def corpus(spark: SparkSession, folder: str) -> Corpus:
    every = durable(m.records(spark, folder))
    released(spark)
    live = every.where("status = 'active' and title is not null").select("id", "title", "content", "search_terms", "type", "file_path", F.col("space").alias("channel"))
    owned = lambda t: table(spark, folder, t).select(F.lower(F.trim("entity_id")).alias("id"), "embedding").where("size(embedding) = 768")
    # Scaled where they are read, so that join and aggregate share one shuffle of the vectors.
    rows = consolidate.with_unit(owned("code_embeddings").unionByName(owned("knowledge_embeddings"))).join(live.select("id", "channel"), "id")
    unit = rows.groupBy("id").agg(F.first("channel").alias("channel"), F.min("embedding").alias("embedding"))
    asked = live.where(F.pmod(F.conv(F.substring("id", -4, 4), 16, 10).cast("int"), F.lit(20)) == 0)
    questions = asked.select(F.col("id").alias("query_id"), F.col("title").alias("text"), lexical.index_tokens(F.col("title")).alias("terms"))
    drifted = drift.drift_counts(drift.drift(upkeep.verified(spark, folder), every))
    tokens = lambda: durable(live.select(F.col("id").alias("doc_id"), *[F.array_join(lexical.index_tokens(F.col(f)), " ").alias(f) for f in FIELDS]))
    edges, unit, drifted, changes, tokens = together(spark, lambda: m.durable_edges(spark, folder), lambda: durable(unit), lambda: durable(drifted), lambda: durable(changes_of(spark, folder, live)), tokens)
    curated = edges.where(F.col("edge_type").isin(graph.CURATED)).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))
    return Corpus(live, edges, unit, questions, drifted, curated, changes, tokens)


def changes_of(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    """(term, id, n, df): how often files were saved between a prompt and the workspace's next boundary, under the content terms of
    the prompt, and how many prompts of the term had such files. A file's record is the smallest id of its path."""
    log = m.saves(spark, folder).where(F.col("kind").isin(*mining.BOUNDARIES, "file_save") & F.col("workspace").isNotNull())
    log = durable(log.select("id", "kind", "workspace", "path", "prompt"))
    files = records.where("type = 'file' and file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("id"))
    prompts = log.where("kind = 'prompt_submit' and workspace is not null and prompt is not null")
    saved = mining.saves_after(log, prompts).distinct().join(files, "path")
    terms = prompts.select(F.col("id").alias("anchor_id"), F.explode(F.array_distinct(lexical.content_terms(F.col("prompt")))).alias("term"))
    rows = durable(saved.join(terms, "anchor_id").select("term", "id", "anchor_id"))
    often = rows.groupBy("term").agg(F.count_distinct("anchor_id").alias("df"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("n")).join(often, "term")


def _numbered(df: DataFrame, by: tuple[str, ...], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def lists(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Lexical and vector lists: (query_id, id, channel, rank[, distance]), three times the limit of each."""
    kinds = c.records.select("id", "channel")
    words = lambda: durable(lexical.bm25(c.tokens, c.questions, FIELDS, 3 * LIMIT, lexical.split_tokens).select("query_id", F.col("doc_id").alias("id"), "rank").join(kinds, "id"))
    asked = c.vectors.join(c.questions.select(F.col("query_id").alias("id")), "id", "left_semi")
    near = lambda k: durable(vectors.nearest(c.vectors.where(F.col("channel") == k), asked.where(F.col("channel") == k), 3 * LIMIT).join(kinds, "id"))
    fts, *parts = together(c.records.sparkSession, words, lambda: near("code"), lambda: near("knowledge"))
    return fts, reduce(DataFrame.unionByName, parts)


def signals(c: Corpus, fts: DataFrame, knn: DataFrame) -> DataFrame:
    """Hits, strength and gradient per question and channel, in one row."""
    near = _numbered(knn, ("query_id", "channel"), ["rank", "id"]).groupBy("query_id").pivot("channel", ["code", "knowledge"])
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), vectors.l2_to_cosine(F.col("distance"))))
    of = lambda n, value: F.when(F.col("rank") <= n, value)
    top = F.max(of(GRADIENT, F.col("distance")))
    gradient = F.when(top <= 0, 1.0).otherwise(1 - F.avg(of(GRADIENT, F.col("distance"))) / top)
    near = near.agg(F.avg(of(STRENGTH, cosine)).alias("strength"), gradient.alias("gradient"))
    hits = fts.where(F.col("rank") <= LIMIT).groupBy("query_id").agg(*[F.count_if(F.col("channel") == k).alias(f"{k}_hits") for k in ("code", "knowledge")])
    return c.questions.select("query_id").join(hits, "query_id", "left").fillna(0, ["code_hits", "knowledge_hits"]).join(near, "query_id", "left")


def covered(c: Corpus, fts: DataFrame) -> DataFrame:
    """Coverage of each question by its first documents."""
    head = fts.where(F.col("rank") <= HEAD).join(c.records.select("id", F.lower(F.concat_ws(" ", "title", "content")).alias("t")), "id")
    head = head.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), " ").alias("text"))
    terms = c.questions.select(F.explode(lexical.content_terms(F.col("text"))).alias("term")).distinct()
    return lexical.answer_coverage(c.questions.select("query_id", "text"), head, lexical.document_frequency(c.tokens, FIELDS, terms, lexical.split_tokens), c.records.agg(F.count("*").alias("n")))


def direct_results(c: Corpus, fts: DataFrame, knn: DataFrame) -> DataFrame:
    """(query_id, id, channel, score, rank): fused by rank, normalised, weighed by channel, demoted by drift, lifted by curated
    in-degree, diversified, with slots and quotas; none where the answers do not cover the question."""
    weights, gate = together(
        c.records.sparkSession,
        lambda: durable(fusion.detect_shares(signals(c, fts, knn)).select("query_id", "code_weight", "knowledge_weight")),
        lambda: durable(covered(c, fts)),
    )
    by = ("query_id", "channel")
    one = lambda df, weight: _numbered(df.where(F.col("rank") <= LIMIT), by, ["rank", "id"]).select(*by, "id", "rank", F.lit(weight).alias("weight"))
    fused = fusion.normalised(fusion.reciprocal_rank(one(fts, 0.4).unionByName(one(knn, 0.6)), list(by)), list(by))
    rows = fusion.merge_channels(fused, weights)
    rows = fusion.provenance_prior(fusion.drift_demotion(rows, c.drifted), c.curated)
    rows = durable(_numbered(rows, ("query_id",), [F.desc("score"), "id"]))
    rows = fusion.diversified(rows.join(weights, "query_id").join(c.vectors.select("id", "embedding"), "id", "left"))
    rows = fusion.with_quotas(fusion.with_slots(rows, LIMIT), LIMIT).where(F.col("rank") <= LIMIT)
    return fusion.silence_gate(rows, gate).select("query_id", "id", "channel", "score", "rank")


def expansions(c: Corpus, fts: DataFrame, knn: DataFrame, direct: DataFrame) -> DataFrame:
    """(query_id, id, score, place, channel) of all that leads on; the smaller `place` wins an id. Every kind is a plan of its own
    and written: the driver's time and memory for one plan of all grow faster than its length.

    Of the files that changed under a question's terms, which grow with questions times files, only those come out that
    graph.capped() may keep: the best ones that neither the direct results nor a smaller place hold. Larger places are without
    any of them, best or not."""
    spark = direct.sparkSession
    top = direct.where("rank = 1").select("query_id", F.col("score").alias("top"))
    part = lambda df, score, place, channel: df.select("query_id", "id", score.alias("score"), F.lit(place).alias("place"), F.lit(channel).alias("channel")).where(F.col("score") >= fusion.MIN_RELEVANCE)
    scores = direct.select("query_id", F.col("id").alias("seed"), F.col("score").alias("own"))
    terms, words = together(
        spark,
        lambda: durable(c.questions.select("query_id", lexical.tokenize(F.col("text")).alias("asked"))),
        lambda: durable(c.records.select("id", "type", "file_path", lexical.tokenize(F.col("title")).alias("words"))),
    )
    # Only the graph leads to records that are not active.
    live = words.select("id")
    live = F.broadcast(live) if live.count() <= BROADCAST_IDS else live

    def reached() -> DataFrame:
        """Records reached from the best of both lists over curated edges, strong and weak."""
        cosine = vectors.l2_to_cosine(F.col("distance"))
        seeds = durable(graph.seed_weights([fts.select("query_id", "id", "rank", F.lit(True).alias("direct")), knn.select("query_id", "id", "rank", (cosine >= DIRECT_COSINE).alias("direct"))]).join(top.select("query_id"), "query_id", "left_semi"))
        rows = durable(graph.graph_first(seeds, c.edges, by=("query_id",)).withColumnRenamed("node", "id").join(top, "query_id").join(live, "id", "left_semi"))
        strong = part(rows.where("direct"), F.col("top") * F.least("score", F.lit(WEAK_BOUNDS[1])), 1, "graph-first")
        weak = part(rows.where("not direct"), F.col("top") * WEAK_DECAY * F.least(F.greatest("score", F.lit(WEAK_BOUNDS[0])), F.lit(WEAK_BOUNDS[1])), 5, "weak")
        return strong.unionByName(weak)

    def led() -> DataFrame:
        """Paths from the direct results over all edges."""
        paths = graph.expand(scores, c.edges, 2, by=("query_id",), trail=False, floor=fusion.MIN_RELEVANCE)
        rows = part(paths.withColumnRenamed("node", "id"), graph.expansion_score(F.col("own"), F.col("depth"), F.col("types")), 2, "path")
        return durable(rows.join(live, "id", "left_semi"))

    def sibling() -> DataFrame:
        """Classes in the files of direct results."""
        members = words.where("type = 'class'").where(~F.coalesce(code.is_test_file(F.col("file_path")), F.lit(False)))
        beside = direct.select("query_id", F.col("id").alias("anchor"), "score").join(joining.siblings(c.edges, direct.select(F.col("id").alias("anchor")).distinct()), "anchor").where("anchor <> sibling")
        beside = beside.join(members.select(F.col("id").alias("sibling"), "words"), "sibling").join(terms, "query_id")
        return durable(part(beside.withColumnRenamed("sibling", "id").withColumnRenamed("score", "own"), graph.sibling_score(F.col("own"), graph.word_overlap(F.col("words"), F.col("asked"))), 3, "sibling"))

    def widened() -> DataFrame:
        """What the question finds when widened by the terms of its first documents."""
        feedback = fts.where(F.col("rank") <= FEEDBACK).join(c.records.select("id", "title", "content"), "id").withColumnRenamed("id", "doc_id")
        new = lexical.expansion_terms(feedback, c.questions).groupBy("query_id").agg(F.collect_list("term").alias("more"))
        wider = durable(c.questions.join(new, "query_id").join(top.select("query_id"), "query_id", "left_semi").select("query_id", F.concat("terms", "more").alias("terms")))
        novel = lexical.bm25(c.tokens, wider, FIELDS, LIMIT, lexical.split_tokens).select("query_id", F.col("doc_id").alias("id")).join(fts.select("query_id", "id"), ["query_id", "id"], "left_anti")
        return durable(part(novel.join(top, "query_id"), F.col("top") * PRF_DECAY, 6, "feedback"))

    def deep() -> DataFrame:
        """Deep ranks that both lists hold."""
        both = fusion.corroborated(fts.select("query_id", "id", "rank").unionByName(knn.select("query_id", "id", "rank")).where(F.col("rank") > LIMIT))
        return durable(part(both.join(top, "query_id"), F.col("top") * DEEP_DECAY, 7, "deep"))

    graphed, siblings, feedback, ranks = together(spark, reached, sibling, widened, deep)
    released(spark)
    paths = led()  # the largest, so the shuffle files of the others are gone by then
    released(spark)
    early = reduce(DataFrame.unionByName, [graphed.where("place = 1"), paths, siblings])
    late = reduce(DataFrame.unionByName, [graphed.where("place > 1"), feedback, ranks])
    asked = durable(terms.join(top.select("query_id"), "query_id", "left_semi").select("query_id", "asked", F.array_distinct(F.filter("asked", lexical.is_content_term)).alias("terms")))
    files = c.changes.select("id").distinct()
    held = early.select("query_id", "id").unionByName(direct.select("query_id", "id")).join(files, "id", "left_semi")

    def changed() -> DataFrame:
        """The best files that changed under the question's terms."""
        best = mining.best_changed(c.changes, words.select("id", "words"), asked, held, LIMIT // graph.COCHANGE_PART)
        return durable(part(best, F.col("score"), 4, "co-change"))

    def unchanged() -> DataFrame:
        """Larger places without files that changed under the question's terms."""
        wanted = asked.select("query_id", F.explode("terms").alias("term"))
        pairs = late.select("query_id", "id").join(files, "id", "left_semi").join(wanted, "query_id").join(c.changes.select("term", "id"), ["term", "id"], "left_semi")
        return durable(late.join(pairs.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti"))

    return reduce(DataFrame.unionByName, [early, *together(spark, changed, unchanged)])


def search(spark: SparkSession, folder: str, c: Corpus | None = None) -> DataFrame:
    """(query_id, id, channel, rank, relevance): direct results, then up to LIMIT that lead on from them, of which a quarter at
    most by co-change. An id stands once: direct results first, then the best score of its first channel."""
    c = c or corpus(spark, folder)
    released(spark)
    fts, knn = lists(c)
    released(spark)
    direct = durable(direct_results(c, fts, knn))
    released(spark)
    more = expansions(c, fts, knn, direct).where(F.col("query_id") != F.col("id"))
    claimed = more.groupBy("query_id", "id").agg(F.min(F.struct("place", (-F.round("score", 9)).alias("less"), "channel")).alias("c")).select("query_id", "id", (-F.col("c.less")).alias("score"), "c.channel")
    claimed = claimed.join(direct.select("query_id", "id").hint("shuffle_hash"), ["query_id", "id"], "left_anti")  # by the keys of the claims
    kept = _numbered(graph.capped(claimed, LIMIT), ("query_id",), [F.desc("score"), "id"]).where(F.col("rank") <= LIMIT)
    out = direct.select("query_id", "id", F.lit("direct").alias("channel"), "rank", F.round("score", 6).alias("relevance"))
    return out.unionByName(kept.select("query_id", "id", "channel", (F.col("rank") + LIMIT).alias("rank"), F.round("score", 6).alias("relevance")))
