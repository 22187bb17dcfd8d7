"""The whole search over records, and its evaluation."""

from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from edge_tables import SMALL
from pyspark.sql import functions as F

from loamgraph.operators import graph, joining, lexical, metrics, mining
from loamgraph.plans import pipeline, search


@pytest.fixture(scope="module")
def small(spark):
    c = search.corpus(spark, SMALL)
    return c, search.search(spark, SMALL, c).collect()


def test_search_gives_every_id_once_within_its_caps(small):
    c, rows = small
    asked = {r.query_id for r in c.questions.collect()}
    assert rows and {r.query_id for r in rows} <= asked
    assert max(Counter((r.query_id, r.id) for r in rows).values()) == 1 and all(r.relevance >= 0.05 for r in rows if r.channel != "direct")
    by = defaultdict(list)
    for r in rows:
        by[r.query_id].append(r)
    for found in by.values():
        direct = sorted(r.rank for r in found if r.channel == "direct")
        assert direct == list(range(1, len(direct) + 1)) and len(direct) <= search.LIMIT
        more = [r for r in found if r.channel != "direct"]
        assert sorted(r.rank for r in more) == list(range(search.LIMIT + 1, search.LIMIT + 1 + len(more))) and len(more) <= search.LIMIT
        assert sum(r.channel == "co-change" for r in more) <= search.LIMIT // 4


def test_what_leads_on_follows_edges(small):
    c, rows = small
    links = {frozenset((e.source_id, e.target_id)) for e in c.edges.collect()}
    near = defaultdict(set)
    for a, b in (tuple(x) for x in links if len(x) == 2):
        near[a].add(b)
        near[b].add(a)
    direct = defaultdict(set)
    for r in rows:
        if r.channel == "direct":
            direct[r.query_id].add(r.id)
    for r in rows:
        if r.channel == "path":
            assert any(r.id in near[x] or near[x] & near[r.id] for x in direct[r.query_id])


def test_curated_in_degree_lifts(spark, small):
    c, _ = small
    want = Counter(e.target_id for e in c.edges.collect() if e.edge_type in graph.CURATED)
    assert {r.id: r.in_degree for r in c.curated.collect()} == want


def test_expand_by_group_claims_per_group(spark):
    edges = spark.createDataFrame([("a", "b", "references", 1.0), ("b", "c", "calls", 1.0), ("x", "b", "calls", 1.0)], "source_id string, target_id string, edge_type string, weight double")
    seeds = spark.createDataFrame([(1, "a"), (1, "x"), (2, "x")], "q int, seed string")
    out = {(r.q, r.node): (r.seed, r.depth) for r in graph.expand(seeds, edges, 2, by=("q",)).collect()}
    assert out == {(1, "b"): ("a", 1), (1, "c"): ("a", 2), (2, "b"): ("x", 1), (2, "a"): ("x", 2), (2, "c"): ("x", 2)}


def test_expand_with_a_floor_leaves_out_what_stays_below_it(spark):
    edges = [("a", "m", "references"), ("a", "n", "calls"), ("m", "x", "calls"), ("n", "x", "supports"), ("m", "y", "references"), ("n", "z", "contains"), ("b", "n", "references"), ("m", "v", "auto_references"), ("n", "v", "calls")]
    edges = spark.createDataFrame([(*e, 1.0) for e in edges], "source_id string, target_id string, edge_type string, weight double")
    seeds = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.3), (2, "a", 1.2), (3, "b", 0.2), (4, "a", 0.6)], "q int, seed string, own double")
    score = F.round(graph.expansion_score(F.col("own"), F.col("depth"), F.col("types")), 9)
    kept = lambda df: {(r.q, r.node): (r.seed, r.depth, r.s) for r in df.withColumn("s", score).where("s >= 0.05").collect()}
    every = graph.expand(seeds, edges, 2, by=("q",), trail=False).join(seeds, ["q", "seed"])
    some = graph.expand(seeds, edges, 2, by=("q",), trail=False, floor=0.05)
    assert kept(some) == kept(every) and any(d == 2 for _, d, _ in kept(some).values()) and some.count() < every.count()


def test_expansions_hold_the_best_changed_files_only(small):
    """Questions times files would be rows otherwise; the results are those of all of them."""
    c, _ = small
    spark = c.records.sparkSession
    terms = sorted({t for r in c.questions.select(lexical.content_terms(F.col("text")).alias("terms")).collect() for t in r.terms})
    files = sorted(r.id for r in c.records.select("id").collect())
    planted = [(t, f, 1 + (i + j) % 3, 5) for i, t in enumerate(terms) for j, f in enumerate(files) if (i + j) % 4 == 0]
    c = replace(c, changes=spark.createDataFrame(planted, "term string, id string, n bigint, df bigint"))
    fts, knn = search.lists(c)
    direct = search.durable(search.direct_results(c, fts, knn))
    more = search.expansions(c, fts, knn, direct).collect()
    of = Counter(r.query_id for r in more if r.channel == "co-change")
    assert of and max(of.values()) <= search.LIMIT // 4
    held = {(r.query_id, r.id) for r in direct.collect()} | {(r.query_id, r.id) for r in more if r.place < 4}
    asked = {r.query_id: r for r in c.questions.select("query_id", lexical.tokenize(F.col("text")).alias("asked"), lexical.content_terms(F.col("text")).alias("terms")).collect()}
    words = {r.id: r.words for r in c.records.select("id", lexical.tokenize(F.col("title")).alias("words")).collect()}
    by = defaultdict(list)
    for r in c.changes.collect():
        by[r.term].append(r)
    wanted, late = set(), {(r.query_id, r.id) for r in more if r.place > 4}
    for q in {r.query_id for r in direct.collect()}:
        idf, n = Counter(), Counter()
        for t in set(asked[q].terms):
            for r in by[t]:
                idf[r.id] += r.n / r.df
                n[r.id] += r.n
        assert not late & {(q, i) for i in n}
        score = {i: round(0.07 + 0.08 * x / (x + 3) + 0.05 * min(3, sum(w in asked[q].asked for w in words[i])) + 0.005 * min(8, n[i]), 9) for i, x in idf.items() if i != q and (q, i) not in held}
        wanted |= {(q, i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:2]}
    assert {(r.query_id, r.id, round(r.score, 9)) for r in more if r.channel == "co-change"} == wanted


def test_best_changed_files_over_batches_with_ties(spark):
    changes = spark.createDataFrame([(t, f"f{i:02}", 1 + i % 3, 4) for i in range(30) for t in ("cache", "fix") if (i + len(t)) % 4], "term string, id string, n bigint, df bigint")
    files = spark.createDataFrame([(f"f{i:02}", ["cache", "cache"] if i % 5 == 0 else ["other"]) for i in range(40)], "id string, words array<string>")
    asked = spark.createDataFrame([("q1", ["fix", "cache"], ["cache"]), ("q2", ["fix", "cache"], ["cache"]), ("q3", ["fix"], ["fix"]), ("f05", ["fix", "cache"], ["fix", "cache"]), ("q4", ["none"], []), ("q5", ["none"], ["none"])], "query_id string, asked array<string>, terms array<string>")
    taken = {("q2", "f05"), ("q2", "f20"), ("q3", "f02"), ("q5", "f01")}
    want = set()
    rows = [tuple(r) for r in changes.collect()]
    for q, words, terms in asked.collect():
        score = {}
        for i in {r[1] for r in rows if r[0] in terms} - {x for y, x in taken if y == q} - {q}:
            own = [r for r in rows if r[1] == i and r[0] in terms]
            idf, n, overlap = sum(r[2] / r[3] for r in own), sum(r[2] for r in own), 2 * (int(i[1:]) % 5 == 0 and "cache" in words)
            score[i] = 0.07 + 0.08 * idf / (idf + 3) + 0.05 * min(overlap, 3) + 0.005 * min(n, 8)
        want |= {(q, i, round(score[i], 9)) for i in sorted(score, key=lambda i: (-round(score[i], 9), i))[:3]}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = mining.best_changed(changes, files, asked, spark.createDataFrame(sorted(taken), "query_id string, id string"), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {(r.query_id, r.id, round(r.score, 9)) for r in out} == want and len(want) == 12
    assert mining.best_changed(changes, files, asked.limit(0), spark.createDataFrame(sorted(taken), "query_id string, id string"), 3).count() == 0


def test_expected_answers_bear_the_title_in_their_content_too(spark, small):
    c, _ = small
    records, asked = c.records.collect(), c.questions.collect()
    want = {(q.query_id, x.id) for q in asked if q.text.strip(" ") for x in records if x.id != q.query_id and (x.title == q.text or q.text in (x.content or ""))}
    got = [(r.query_id, r.id) for r in pipeline.expected_answers(c).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(q.query_id, None) for q in asked if q.query_id not in {q for q, _ in want}}
    texts = spark.createDataFrame([(1, "say Fix the cache. now"), (2, "fix the cache"), (3, None), (4, "the cache")], "id bigint, text string")
    patterns = spark.createDataFrame([("Fix the cache",), ("the cache",), ("",)], "pattern string")
    assert sorted(tuple(r) for r in joining.containing(texts, patterns).collect()) == [(1, "Fix the cache"), (1, "the cache"), (2, "the cache"), (4, "the cache")]


def test_metrics_with_packs_and_bounds(spark):
    results = spark.createDataFrame([("q", "a", 1, 0.9, True), ("q", "b", 2, 0.5, True), ("q", "c", 11, 0.1, False)], "query_id string, id string, rank int, relevance double, direct boolean")
    expected = spark.createDataFrame([("q", "b"), ("q", "c"), ("n", None)], "query_id string, id string")
    packed = spark.createDataFrame([("q", "b"), ("q", "a")], "query_id string, id string")
    rows = {r.query_id: r for r in metrics.scores(results, expected, packed=packed).collect()}
    assert (rows["q"].mrr, rows["q"].recall, rows["q"].pack_recall, rows["n"].negative_ok) == (0.5, 1.0, 0.5, True)
    assert metrics.interval({1.0: 1}) is None and metrics.interval({0.0: 50, 1.0: 50})[0] < 0.5 < metrics.interval({0.0: 50, 1.0: 50})[1]


def test_search_writes_every_kind_of_expansion(spark, small):
    """One plan of all expansions has hundreds of exchanges, for which a driver's time and memory do not do."""
    plan = search.search(spark, SMALL, small[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 30
