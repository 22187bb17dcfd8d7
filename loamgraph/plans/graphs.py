"""Traversals as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.functions import code
from loamgraph.operators import graph, joining
from loamgraph.plans import model as m
from loamgraph.plans import retrieval as r
from loamgraph.plans.relational import _IDF, _TEST_SQL, cochange_idf
from loamgraph.sources.tables import table

query = m.Catalog()
_CUR = "('references', 'supports', 'contradicts', 'superseded_by', 'derived_from', 'promoted_from')"


def graph_edges(s, d):
    return m.durable_edges(s, d)


def rules(s, d):
    return m.records(s, d).where("type = 'rule' and status = 'active'").select(F.col("id").alias("seed"))


_RULES = "seeds as (select id as seed from rec where type = 'rule' and status = 'active')"
_BOTH = "both_ways as (select source_id as here, target_id as there, edge_type, source_id, target_id from edge union all select target_id, source_id, edge_type, source_id, target_id from edge)"
query("gra1_reach", m.sql("edge", f", {_RULES}, {_BOTH}, walk as (select seed, seed as node, 0 as depth from seeds union select seed, there, depth + 1 from walk join both_ways on here = node where depth < 2) select seed, node, min(depth) as depth from walk group by all having min(depth) > 0 and seed <> node"))(
    lambda s, d: graph.reach(rules(s, d), graph_edges(s, d), 2)
)
query("gra2_edges_touching", m.sql("edge", f", {_RULES} select distinct source_id, target_id, edge_type from edge where source_id in (select seed from seeds) or target_id in (select seed from seeds)"))(
    lambda s, d: graph.touching(graph_edges(s, d), rules(s, d).withColumnRenamed("seed", "id"))
)
query("gra3_references", m.sql("edge", "select source_id, string_agg(distinct target_id, ' ' order by target_id) as target_ids from edge where edge_type = 'references' group by 1"))(lambda s, d: graph.referenced(graph_edges(s, d)))
query("gra4_neighbours", m.sql("edge", "select id, count(distinct o) as n_out, count(distinct i) as n_in, count(distinct edge_type) as n_types from (select source_id as id, target_id as o, null as i, edge_type from edge union all select target_id, null, source_id, edge_type from edge) group by id"))(
    lambda s, d: graph.neighbours(graph_edges(s, d))
)
query("gra5_callers", m.sql("edge", "select target_id as id, source_id as caller_id, weight, row_number() over (partition by target_id order by weight desc, source_id) as rank from edge where edge_type = 'calls'"))(lambda s, d: graph.callers(graph_edges(s, d), m.records(s, d)))


def classes(s, d):
    return m.records(s, d).where("type = 'class'").select(F.col("id").alias("seed"))


_IMPACT = """, walk as (select id as seed, id, 0 as depth, '' as via from rec where type = 'class' union select w.seed, e.source_id, w.depth + 1, e.edge_type from walk w join edge e on e.target_id = w.id and e.edge_type in ('calls', 'imports', 'extends') where w.depth < 3),
least as (select seed, id, min(depth) as depth from walk group by all), impact as (select seed, id, depth, min(via) as via from walk join least using (seed, id, depth) where depth > 0 and seed <> id group by all)"""
query("gra6_impact_set", m.sql("edge", _IMPACT + " select seed, id, depth, via from impact"))(lambda s, d: graph.impact(classes(s, d), graph_edges(s, d), 3))
query("gra6_impact_limited", m.sql("edge", _IMPACT + " select seed, id, depth, via from impact qualify row_number() over (partition by seed order by id) <= 5"))(lambda s, d: graph.impact(classes(s, d), graph_edges(s, d), 3, 5))
query("gra7_referring_knowledge", m.sql("edge", "select distinct target_id as id, source_id as knowledge_id from edge where edge_type in ('references', 'auto_references') and source_id in (select id from rec where space = 'knowledge' and status = 'active')"))(
    lambda s, d: graph.referring_knowledge(graph_edges(s, d), m.records(s, d))
)
query("gra8_governing_rules", m.sql("edge", "select target_id as id, source_id as rule_id, row_number() over (partition by target_id order by updated_us desc nulls last, source_id) as rank from edge join rec on rec.id = source_id where edge_type = 'references' and type = 'rule' and status = 'active'"))(
    lambda s, d: graph.governing_rules(graph_edges(s, d), m.records(s, d))
)
_LIKE = " or ".join(f"file_path like '{p}'" for p in code.TEST_PATHS)
query("gra9_orphans", m.sql("edge", f"select id, file_path from rec where type in ('function', 'class') and status = 'active' and (file_path is null or not ({_LIKE})) and id not in (select target_id from edge where edge_type in ('calls', 'imports', 'extends'))"))(
    lambda s, d: graph.orphans(graph_edges(s, d), m.records(s, d), ["function", "class"], code.looks_like_test_path(F.col("file_path"))).select("id", "file_path")
)
_WEIGHT = f"case when edge_type in {_CUR} then 1.0 when edge_type = 'auto_references' then 0.7 else 0.5 end::double"
_CLAIM = f""", {_RULES}, {_BOTH},
f0 as (select seed, seed as node, 0 as depth, seed as path, 1.0::double as w from seeds),
c1 as (select f.seed, there as node, 1 as depth, path || '>' || there as path, f.w * ({_WEIGHT}) as w, row_number() over (partition by there order by {_WEIGHT} desc, source_id, target_id, edge_type, f.seed) as n from f0 f join both_ways on here = f.node where there not in (select node from f0)),
f1 as (select seed, node, depth, path, w from c1 where n = 1),
c2 as (select f.seed, there as node, 2 as depth, path || '>' || there as path, f.w * ({_WEIGHT}) as w, row_number() over (partition by there order by {_WEIGHT} desc, source_id, target_id, edge_type, f.seed) as n from f1 f join both_ways on here = f.node where there not in (select node from f0 union all select node from f1)),
claimed as (select * from f1 union all select seed, node, depth, path, w from c2 where n = 1)"""
query("gra10_expanded_paths", m.sql("edge", _CLAIM + " select seed, node, depth, path from claimed"))(lambda s, d: graph.expand(rules(s, d), graph_edges(s, d), 2).select("seed", "node", "depth", F.array_join("path", ">").alias("path")))
_PER = f"""{_RULES}, both_ways as (select source_id as here, target_id as there, edge_type, source_id, target_id from edge where edge_type in {_CUR} union all select target_id, source_id, edge_type, source_id, target_id from edge where edge_type in {_CUR}),
w1 as (select distinct seed, there as node, 1 as depth from seeds join both_ways on here = seed where there <> seed),
w2 as (select distinct seed, there as node, 2 as depth from w1 join both_ways on here = node where there <> seed and (seed, there) not in (select seed, node from w1)),
walked as (select * from w1 union all select * from w2)"""


def weighted_seeds(s, d):
    """Rules as seeds: weight falls with their place among the rules, latest first; every other one counts as direct."""
    from loamgraph.operators.ordered import running_sum

    place = running_sum(m.records(s, d).where("type = 'rule' and status = 'active'").select(F.lit(0).alias("all"), F.col("id").alias("seed")), "all", "seed", F.lit(1), "place")
    return place.select("seed", (1 / (1 + (F.col("place") - 1) / 20.0)).alias("weight"), (F.col("place") % 2 == 1).alias("direct"))


query("gra11_graph_first", m.sql("edge", f", {_PER}, sw as (select seed, 1 / (1 + (row_number() over (order by seed) - 1) / 20.0) as weight, row_number() over (order by seed) % 2 = 1 as direct from seeds) select node, round(sum(weight * pow(0.5, depth)), 6) as score, bool_or(direct) as direct from walked join sw using (seed) group by node having round(sum(weight * pow(0.5, depth)), 9) >= 0.2"))(
    lambda s, d: graph.graph_first(weighted_seeds(s, d), graph_edges(s, d)).withColumn("score", F.round("score", 6))
)
query("gra12_seed_weights", f"with {r._FTS}, {r._KNN}, l as (select query_id, doc_id as id, rank, true as direct from fts where rank <= 10 union all select query_id, id, rank, 1 - distance * distance / 2 >= 0.4 from knn where rank <= 10), b as (select query_id, id as seed, max(1 / (1 + (rank - 1) / 20.0)) as weight, bool_or(direct) as direct from l group by all) select query_id, seed, round(weight, 6) as weight, direct from b qualify row_number() over (partition by query_id order by b.weight desc, seed) <= 60")(
    lambda s, d: graph.seed_weights(
        [r.fts(s, d, 10).select("query_id", F.col("doc_id").alias("id"), "rank", F.lit(True).alias("direct")), r.knn(s, d, 10).select("query_id", "id", "rank", (1 - F.col("distance") * F.col("distance") / 2 >= 0.4).alias("direct"))]
    ).withColumn("weight", F.round("weight", 6))
)


def sibling_expansions(s, d):
    """Classes in the files of each active function, scored as if the function had relevance 1 and its title were the query."""
    from loamgraph.operators.lexical import tokenize

    rec = m.records(s, d).select("id", "type", "title", "status", "file_path")
    anchors = rec.where("type = 'function' and status = 'active'").select(F.col("id").alias("anchor"), tokenize(F.col("title")).alias("terms"))
    members = rec.where("type = 'class'").where(~code.is_test_file(F.col("file_path"))).select(F.col("id").alias("sibling"), F.col("title").alias("sibling_title"))
    rows = joining.siblings(graph_edges(s, d)).join(anchors, "anchor").join(members, "sibling").where("anchor <> sibling")
    score = graph.sibling_score(F.lit(1.0), graph.title_overlap(F.col("sibling_title"), F.col("terms")))
    return rows.select("anchor", "sibling", score.alias("score")).groupBy("sibling").agg(F.max(F.struct("score", "anchor")).alias("best")).select("sibling", "best.anchor", F.round("best.score", 6).alias("score"))


query("gra13_sibling_expansion", m.sql("edge", f""", c as (select source_id as file, target_id as member from edge where edge_type = 'contains'), a as (select member as anchor, file from c union select file, file from c), sib as (select distinct a.anchor, c.member as sibling from a join c using (file)),
x as (select anchor, sibling, {r._CAMEL.format("f.title")} as terms, {r._CAMEL.format("k.title")} as own from sib join rec f on f.id = anchor and f.type = 'function' and f.status = 'active' join rec k on k.id = sibling and k.type = 'class' and not coalesce({_TEST_SQL.replace("file_path", "k.file_path")}, false) where anchor <> sibling),
y as (select anchor, sibling, 0.15 + 0.15 * least(len(list_filter(own, lambda t: list_contains(terms, t))), 4) as score from x)
select sibling, (max(struct_pack(s := score, a := anchor))).a as anchor, round(max(score), 6)::double as score from y group by sibling"""))(sibling_expansions)


def cochange_expansions(s, d):
    """(term, entity_id, score): what changed under every term, as expansions of the term asked alone."""
    titles = table(s, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("title"))
    rows = cochange_idf(m.cochange(s, d)).join(titles, "entity_id", "left")
    overlap = F.coalesce(graph.title_overlap(F.col("title"), F.array("term")), F.lit(0))
    return rows.select("term", "entity_id", F.round(graph.cochange_score(F.col("score"), overlap, F.col("cnt")), 6).alias("score"))


query("gra14_cochange_expansion", m.sql("cochange", f"""{_IDF}, named as (select s_suppkey as entity_id, {r._CAMEL.format("s_name")} as own from supplier)
select term, entity_id, round(0.07 + 0.08 * round(score, 6) / (round(score, 6) + 3.0) + 0.05 * least(coalesce(len(list_filter(own, lambda t: t = term)), 0), 3) + 0.005 * least(cnt, 8), 6) as score from idf left join named using (entity_id)"""))(cochange_expansions)


def capped_expansions(s, d):
    paths = graph.expand(rules(s, d), graph_edges(s, d), 2)
    rows = paths.select(F.col("seed").alias("query_id"), F.col("node").alias("id"), F.round(graph.expansion_score(F.lit(1.0), F.col("depth"), F.col("types")), 9).alias("score"), F.when(F.try_element_at("types", F.lit(-1)) == "auto_references", "co-change").otherwise("graph").alias("channel"))
    return graph.capped(rows.where("score >= 0.05"), 4)


query("gra15_capped_expansion", None)(capped_expansions)
query("gra15_expansion_scores", m.sql("edge", _CLAIM + " select seed, node, round(pow(0.3, depth) * w, 6) as score from claimed where round(pow(0.3, depth) * w, 9) >= 0.05"))(
    lambda s, d: graph.expand(rules(s, d), graph_edges(s, d), 2).select("seed", "node", F.round(graph.expansion_score(F.lit(1.0), F.col("depth"), F.col("types")), 9).alias("score")).where("score >= 0.05").withColumn("score", F.round("score", 6))
)
query("gra16_path_descriptions", m.sql("edge", _CLAIM + """, kinds as (select source_id, target_id, min(edge_type) as kind from edge group by all), parts as (select path, unnest(string_split(path, '>')) as id, unnest(range(1, depth + 2)) as pos, string_split(path, '>') as ids from claimed)
select path, string_agg(coalesce(title, p.id) || case when ids[pos + 1] is null then '' else ' → ' || replace(coalesce(kind, '→'), '_', ' ') end, ' → ' order by pos) as description from parts p left join rec on rec.id = p.id left join kinds on source_id = p.id and target_id = ids[pos + 1] group by path"""))(
    lambda s, d: _descriptions(s, d)
)


def _descriptions(s, d):
    from loamgraph.session import durable

    e = graph_edges(s, d)
    paths = durable(graph.expand(rules(s, d), e, 2).select(F.array_join("path", ">").alias("key"), "path"))
    return graph.described(paths, m.records(s, d), e).select(F.col("key").alias("path"), "description")


query("gra17_contains_edges", m.sql("rec", "select f.source_id, m.id as target_id from rec m join (select file_path, min(id) as source_id from rec where type = 'file' and file_path is not null group by 1) f using (file_path) where m.type in ('function', 'class')"))(
    lambda s, d: graph.contains_edges(m.records(s, d))
)


def call_edges(s, d):
    """(source_id, target_id): functions whose text calls a name that one code record alone bears."""
    rec = m.records(s, d).where("space = 'code' and status = 'active'")
    called = rec.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("raw_name"))
    found = joining.resolve_names(called, rec.select(F.col("title").alias("name"), "id")).where("target_id is not null and target_id <> id")
    return found.select(F.col("id").alias("source_id"), "target_id").distinct()


query("gra17_call_edges", m.sql("rec", """, code as (select id, title, content from rec where space = 'code' and status = 'active'), names as (select title as name, min(id) as target_id from code where title is not null group by title having count(*) = 1),
called as (select id, unnest(list_distinct(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1))) as name from code)
select distinct id as source_id, target_id from called join names using (name) where id <> target_id"""))(call_edges)


def corpus_components(s, d):
    """Connected components of the graph by size."""
    from loamgraph.operators.components import components

    parts = components(m.edges(s, d).select(F.col("source_id").alias("u"), F.col("target_id").alias("v")))
    return parts.groupBy("component").agg(F.count("*").alias("n_nodes"))


query("gra1_components", None)(corpus_components)
query("joi13_vector_owners", m.sql("rec", "select entity_id, coalesce(type, 'missing') as type from (select distinct lower(trim(entity_id)) as entity_id from code_embeddings where entity_id is not null) left join rec on id = entity_id"))(
    lambda s, d: table(s, d, "code_embeddings").where("entity_id is not null").select(F.lower(F.trim("entity_id")).alias("entity_id")).distinct().join(m.records(s, d).select(F.col("id").alias("entity_id"), "type"), "entity_id", "left").select("entity_id", F.coalesce("type", F.lit("missing")).alias("type"))
)

QUERIES, SQL = query.queries, query.sql
