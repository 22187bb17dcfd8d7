"""Lexical search, vector search and rank fusion as queries with their SQL.

Queries are the titles (and vectors) of every document whose id is divisible by 20, asked of all documents (and vectors).
A document's channel is code or knowledge by the sort of its source; its vector is the one with its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.operators import fusion, lexical, vectors
from loamgraph.plans import model as m
from loamgraph.sources.tables import table

query = m.Catalog()
LIMIT = 10
WEIGHTS = {"title": 5.0, "text": 1.0}


def docs(s, d):
    channel = F.when(F.substring_index("source", "/", 1).isin("commits", "tool-output", "doc-comments"), "code").otherwise("knowledge")
    return table(s, d, "documents").select("doc_id", "title", "text", channel.alias("channel"))


def questions(s, d):
    rows = table(s, d, "documents").where("doc_id % 20 = 0 and title is not null")
    return rows.select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"), lexical.index_tokens(F.col("title")).alias("terms"))


def space(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def ready(s, d):
    """The lexical and the vector lists and the direct lists of both, written once: pipelines read them many times."""
    from loamgraph.session import durable

    made = durable(fts(s, d)), durable(knn(s, d))
    return *made, durable(lists(s, d, made))


def fts(s, d, k=3 * LIMIT, lists=None):
    """The k best documents of every question; from lists made before, where given."""
    if lists is not None:
        return lists[0].where(F.col("rank") <= k)
    return lexical.bm25(docs(s, d), questions(s, d).select("query_id", "terms"), WEIGHTS, k)


def knn(s, d, k=3 * LIMIT, lists=None):
    if lists is not None:
        return lists[1].where(F.col("rank") <= k)
    vecs = space(s, d)
    return vectors.nearest(vecs, vecs.where("id % 20 = 0"), k)


_TOK = "list_filter(string_split_regex(translate(lower(coalesce({0}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_DOCS = f"""docs as (select doc_id, title, text, case when string_split(source, '/')[1] in ('commits', 'tool-output', 'doc-comments') then 'code' else 'knowledge' end as channel from documents),
q as (select doc_id as query_id, title as text, {_TOK.format("title")} as terms from documents where doc_id % 20 = 0 and title is not null),
qt as (select distinct query_id, unnest(terms) as term from q)"""
_FTS = f"""{_DOCS},
tt as (select doc_id, {_TOK.format("title")} as a, {_TOK.format("text")} as b from documents),
dl as (select doc_id, len(a) + len(b) as length from tt),
flat as (select doc_id, 5.0 as w, unnest(a) as term from tt union all select doc_id, 1.0, unnest(b) from tt),
post as (select doc_id, term, sum(w) as f from flat where term in (select term from qt) group by all),
idf as (select term, greatest(ln(((select count(*) from dl) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf from post group by term),
sc as (select query_id, doc_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / (select avg(length) from dl)))), 9) as score from post join idf using (term) join dl using (doc_id) join qt using (term) group by all),
fts as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc)"""
_KNN = """pairs as (select a.vec_id as query_id, b.vec_id as id, b.label, round(list_distance(a.embedding::double[], b.embedding::double[]), 9) as distance from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
knn as (select *, row_number() over (partition by query_id order by distance, id) as rank from pairs)"""

query("fts1_bm25_topk", f"with {_FTS} select query_id, doc_id, round(score, 6) as score, rank from fts where rank <= {LIMIT}")(lambda s, d: fts(s, d, LIMIT).withColumn("score", F.round("score", 6)))
query("fts1_bm25_stemmed", None)(
    lambda s, d: lexical.bm25(docs(s, d), questions(s, d).select("query_id", lexical.stemmed(F.col("terms")).alias("terms")), WEIGHTS, LIMIT, lexical.stemmed_tokens)
)
query("joi1_hits_with_records", f"with {_FTS} select query_id, doc_id, channel, title from fts join docs using (doc_id) where rank <= 3")(lambda s, d: fts(s, d, 3).join(docs(s, d), "doc_id").select("query_id", "doc_id", "channel", "title"))
query("agg10_document_frequency", f"with {_FTS} select qt.term, count(post.doc_id) as df from (select distinct term from qt) qt left join post using (term) group by qt.term")(
    lambda s, d: lexical.document_frequency(docs(s, d), {"title": 1.0, "text": 1.0}, questions(s, d).select(F.explode("terms").alias("term")))
)
_APART = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu}{2})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '([0-9])([^0-9 ])', '\1 \2', 'g'), '([^0-9 ])([0-9])', '\1 \2', 'g')"
_FTS2 = f"""select id, array_to_string(flatten(list_transform(list_filter(list_transform(regexp_extract_all(coalesce(title, ''), '[\\p{{L}}\\p{{N}}]+'), lambda w: string_split({_APART}, ' ')), lambda p: len(p) > 1),
lambda p: p || list_filter(list_transform(range(1, len(p)), lambda i: case when regexp_matches(p[i], '^\\p{{L}}+$') and regexp_matches(p[i + 1], '^[0-9]+$') then p[i] || p[i + 1] end), lambda x: x is not null))), ' ') as terms from rec"""
query("fts2_search_terms", m.sql("rec", _FTS2))(lambda s, d: m.records(s, d).select("id", lexical.search_terms(F.col("title")).alias("terms")))
_CAMEL = "list_filter(list_transform(string_split_regex(regexp_replace(coalesce({0}, ''), '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda x: octet_length(encode(x)) >= 2)"
query("fts3_tokens", m.sql("rec", f"select id, array_to_string({_CAMEL.format('title')}, ' ') as terms from rec"))(lambda s, d: m.records(s, d).select("id", F.array_join(lexical.tokenize(F.col("title")), " ").alias("terms")))
_STOP = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)
_CONTENT = f"octet_length(encode(x)) >= 4 and not regexp_matches(x, '^[0-9]+$') and x not in ({_STOP})"
query("fts4_content_terms", m.sql("rec", f"select id, len(list_filter({_CAMEL.format('content')}, lambda x: {_CONTENT})) as n_terms from rec"))(
    lambda s, d: m.records(s, d).select("id", F.size(lexical.content_terms(F.col("content"))).cast("bigint").alias("n_terms"))
)


def feedback(s, d, n=5, made=None):
    return fts(s, d, n, made).join(docs(s, d), "doc_id").select("query_id", "doc_id", "title", F.col("text").alias("content"))


_PRF = f"""{_FTS}, fb as (select query_id, doc_id, title, text from fts join docs using (doc_id) where rank <= 5),
ft as (select query_id, doc_id, 3.0 as w, unnest({_CAMEL.format("title")}) as x from fb union all select query_id, doc_id, 1.0, unnest({_CAMEL.format("text")}) from fb),
prf0 as (select query_id, x as term, sum(w)::double as score from ft where {_CONTENT} group by all having count(distinct doc_id) >= 2),
own as (select distinct query_id, unnest({_CAMEL.format("text")}) as term from q),
prf as (select *, row_number() over (partition by query_id order by score desc, term) as rank from prf0 anti join own using (query_id, term))"""
query("fts5_feedback_terms", f"with {_PRF} select query_id, term, score, rank from prf where rank <= 8")(lambda s, d: lexical.expansion_terms(feedback(s, d), questions(s, d)))
query("fts6_expanded_queries", f"with {_PRF} select query_id, text || ' ' || string_agg(term, ' ' order by rank) as expanded from prf join q using (query_id) where rank <= 8 group by query_id, text")(lambda s, d: _expanded(s, d))


def _expanded(s, d):
    terms = lexical.expansion_terms(feedback(s, d), questions(s, d)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return questions(s, d).join(terms, "query_id").select("query_id", F.concat_ws(" ", "text", F.array_join(F.transform("t", lambda x: x["term"]), " ")).alias("expanded"))


def coverage(s, d, made=None):
    """Coverage of each question by the texts of its ten best documents, best first."""
    head = fts(s, d, 10, made).join(docs(s, d), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("t")))).alias("ts"))
    head = head.select("query_id", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("text"))
    asked = questions(s, d)
    terms = asked.select(F.explode(lexical.content_terms(F.col("text"))).alias("term"))
    return lexical.answer_coverage(asked.select("query_id", "text"), head, lexical.document_frequency(docs(s, d), {"title": 1.0, "text": 1.0}, terms), docs(s, d).agg(F.count("*").alias("n")))


_COV = f"""{_FTS}, head as (select query_id, string_agg(lower(coalesce(title, '') || ' ' || coalesce(text, '')), ' ' order by rank) as t from fts join docs using (doc_id) where rank <= 10 group by query_id),
ct as (select query_id, unnest(list_filter({_CAMEL.format("text")}, lambda x: {_CONTENT})) as term from q),
cdf as (select term, count(distinct doc_id) as df from flat where term in (select term from ct) group by term),
cw as (select ct.query_id, ct.term, coalesce(df, 0) as df, ln((select count(*) from documents) * 1.0 / greatest(coalesce(df, 0), 1)) as w, head.t from ct left join cdf using (term) left join head using (query_id)),
cov as (select q.query_id, case when coalesce(sum(w), 0) > 0 then coalesce(sum(w) filter (df > 0 and contains(t, term)), 0) / sum(w) else 1.0 end as coverage from q left join cw using (query_id) group by 1)"""
query("fts7_answer_coverage", f"with {_COV} select query_id, round(coverage, 6) as coverage from cov")(lambda s, d: coverage(s, d).withColumn("coverage", F.round("coverage", 6)))

query("vec1_knn_topk", f"with {_KNN} select query_id, id, round(distance, 6) as distance, rank from knn where rank <= {LIMIT}")(lambda s, d: knn(s, d, LIMIT).withColumn("distance", F.round("distance", 6)))
query("vec2_knn_of_type", f"with {_KNN} select query_id, id, round(distance, 6) as distance, row_number() over (partition by query_id order by distance, id) as rank from pairs where label = 3 qualify rank <= 5")(
    lambda s, d: vectors.nearest(space(s, d).where("label = 3"), space(s, d).where("id % 20 = 0"), 5).withColumn("distance", F.round("distance", 6))
)
query("vec3_knn_filtered", f"with {_KNN} select query_id, id, round(distance, 6) as distance, row_number() over (partition by query_id order by distance, id) as rank from pairs where label < 5 and id % 3 <> 0 qualify rank <= 5")(
    lambda s, d: vectors.nearest(space(s, d).where("label < 5 and id % 3 <> 0"), space(s, d).where("id % 20 = 0"), 5).withColumn("distance", F.round("distance", 6))
)
query("vec4_knn_cosine", f"with {_KNN} select query_id, id, round(1 - distance * distance / 2, 6) as cosine from knn where rank <= 5")(lambda s, d: knn(s, d, 5).select("query_id", "id", F.round(vectors.l2_to_cosine(F.col("distance")), 6).alias("cosine")))
query("vec5_cosine", "select a.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")(
    lambda s, d: space(s, d).select("id", "embedding").join(space(s, d).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other")), "id").select("id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
)
query("vec6_channel_strength", f"with {_KNN} select query_id, round(avg(greatest(0, least(1, 1 - distance * distance / 2))), 6) as strength from knn where rank <= 3 group by 1")(lambda s, d: vectors.strength(knn(s, d, 5)).withColumn("strength", F.round("strength", 6)))
query("vec7_gradient", f"with {_KNN} select query_id, round(case when max(distance) <= 0 then 1.0 else 1 - avg(distance) / max(distance) end, 6) as gradient from knn where rank <= 5 group by 1")(
    lambda s, d: vectors.gradient(knn(s, d, 5)).withColumn("gradient", F.round("gradient", 6))
)
query("vec8_missing_vectors", m.sql("rec", "select id from rec where space = 'code' and status = 'active' and id not in (select entity_id from code_embeddings where entity_id is not null and len(embedding) > 0)"))(
    lambda s, d: vectors.missing_vectors(m.records(s, d).where("space = 'code' and status = 'active'").select("id"), table(s, d, "code_embeddings").select(F.col("entity_id").alias("id"), "embedding"))
)
query("vec9_mean_pool", """with f as (select label, unnest(embedding)::double as x, unnest(range(64)) as position from embeddings where vec_id % 2 = 0), a as (select label, position, avg(x) as x from f group by all), n as (select label, sqrt(sum(x * x)) as norm from a group by label)
select label, position, round(x / norm, 6) as value from a join n using (label)""")(
    lambda s, d: vectors.mean_pool(space(s, d).withColumn("mask", F.col("id") % 2 == 0), "label").withColumn("value", F.round("value", 6))
)
_BITS = "select {0}, array_to_string(list_transform(range(64), lambda i: (h >> i::ubigint) & 1::ubigint), '') as bits from (select doc_id, ('0x' || substr(sha256(coalesce(text, '')), 1, 16))::ubigint as h from documents)"
_bits = lambda v: F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), "").alias("bits")
query("vec10_mock_embeddings", _BITS.format("doc_id"))(lambda s, d: docs(s, d).select("doc_id", _bits(vectors.mock_embedding(F.coalesce("text", F.lit(""))))))
query("vec11_embedded_once", _BITS.format("doc_id as id"))(lambda s, d: vectors.embed_once(docs(s, d).select(F.col("doc_id").alias("id"), "text"), vectors.mock_embedding).select("id", _bits("embedding")))


def lists(s, d, made=None):
    """The direct lists of every question: (query_id, channel, list, id, rank, weight), ranks within list and channel."""
    if made is not None and len(made) > 2:
        return made[2]
    by = lambda df, name, weight: df.where(F.col("rank") <= LIMIT).select("query_id", "channel", F.lit(name).alias("list"), "id", F.row_number().over(_by("query_id", "channel")).alias("rank"), F.lit(weight).alias("weight"))
    kinds = docs(s, d).select(F.col("doc_id").alias("id"), "channel")
    a = fts(s, d, LIMIT, made).withColumnRenamed("doc_id", "id").join(kinds, "id")
    b = knn(s, d, LIMIT, made).join(kinds, "id")
    return by(a, "fts", 0.4).unionByName(by(b, "knn", 0.6))


def _by(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("rank", "id")


_LISTS = f"""{_FTS}, {_KNN},
l0 as (select query_id, doc_id as id, 'fts' as list, rank, 0.4 as weight from fts where rank <= {LIMIT} union all select query_id, id, 'knn', rank, 0.6 from knn where rank <= {LIMIT}),
lists as (select query_id, channel, list, id, weight, row_number() over (partition by query_id, channel, list order by l0.rank, id) as rank from l0 join docs on doc_id = id)"""
_RRF = f"""{_LISTS}, r0 as (select query_id, channel, id, round(sum(weight / (60 + rank)), 12) as score from lists group by all),
rrf as (select *, row_number() over (partition by query_id, channel order by score desc, id) as rank from r0)"""
query("rnk1_hybrid_rrf", f"with {_RRF} select query_id, channel, id, round(score, 6) as score, rank from rrf")(
    lambda s, d: fusion.reciprocal_rank(lists(s, d), ["query_id", "channel"]).withColumn("score", F.round("score", 6))
)


def fused(s, d, made=None):
    return fusion.normalised(fusion.reciprocal_rank(lists(s, d, made), ["query_id", "channel"]), ["query_id", "channel"])


_NORM = f"{_RRF}, norm as (select query_id, channel, id, score / max(score) over (partition by query_id, channel) as score from rrf)"
query("rnk2_normalised", f"with {_NORM} select query_id, channel, id, round(score, 6) as score from norm")(lambda s, d: fused(s, d).select("query_id", "channel", "id", F.round("score", 6).alias("score")))


def signals(s, d, made=None):
    """Per question: hits, strength and gradient of both channels."""
    kinds = docs(s, d).select(F.col("doc_id").alias("id"), "channel")
    near = knn(s, d, 3 * LIMIT, made).join(kinds, "id").withColumn("rank", F.row_number().over(_by("query_id", "channel")))
    hits = lists(s, d, made).where("list = 'fts'").groupBy("query_id").agg(*[F.sum(F.when(F.col("channel") == c, 1).otherwise(0)).alias(f"{c}_hits") for c in ("code", "knowledge")])
    out = questions(s, d).select("query_id").join(hits, "query_id", "left").fillna(0, ["code_hits", "knowledge_hits"])
    for c in ("code", "knowledge"):
        own = near.where(F.col("channel") == c)
        out = out.join(vectors.strength(own).withColumnRenamed("strength", f"{c}_strength"), "query_id", "left").join(vectors.gradient(own).withColumnRenamed("gradient", f"{c}_gradient"), "query_id", "left")
    return out


_SIG = f"""{_NORM}, near0 as (select query_id, channel, id, distance, row_number() over (partition by query_id, channel order by knn.rank, id) as rank from knn join docs on doc_id = id where knn.rank <= {3 * LIMIT}),
st as (select query_id, channel, avg(greatest(0, least(1, 1 - distance * distance / 2))) filter (rank <= 3) as strength, case when max(distance) filter (rank <= 5) <= 0 then 1.0 else 1 - avg(distance) filter (rank <= 5) / max(distance) filter (rank <= 5) end as gradient from near0 group by all),
sig as (select q.query_id, (select count(*) from lists l where l.query_id = q.query_id and list = 'fts' and channel = 'code') as ch, (select count(*) from lists l where l.query_id = q.query_id and list = 'fts' and channel = 'knowledge') as kh,
  c.strength as cs, k.strength as ks, c.gradient as cg, k.gradient as kg from q left join st c on c.query_id = q.query_id and c.channel = 'code' left join st k on k.query_id = q.query_id and k.channel = 'knowledge'),
pool as (select *, case when ch + kh = 0 then 0.5 else sqrt(ch) / (sqrt(ch) + sqrt(kh)) end as share, coalesce(cg, 0) as g, coalesce(kg, 0) as h from sig),
mix as (select *, case when g <= 0 and h <= 0 then share when ch = 0 and kh = 0 then g else 0.5 * g + 0.5 * share end as c, case when g <= 0 and h <= 0 then 1 - share when ch = 0 and kh = 0 then h else 0.5 * h + 0.5 * (1 - share) end as k from pool),
det as (select *, case when c <= 0 and k <= 0 then 0.5 when c <= 0 then 0.2 when k <= 0 then 0.8 when c / (c + k) < 0.2 then 0.2 when k / (c + k) < 0.2 then 0.8 else c / (c + k) end as cw from mix)"""
_W = "round(code_weight, 6) as code_weight, round(knowledge_weight, 6) as knowledge_weight"
for _name, _sql in {
    "detect": "select query_id, cw as code_weight, 1 - cw as knowledge_weight from det",
    "fixed": "select query_id, 0.5::double as code_weight, 0.5::double as knowledge_weight from det",
    "strength": "select query_id, coalesce(cs, case when ch > 0 then share * 0.5 else 0 end) as code_weight, coalesce(ks, case when kh > 0 then (1 - share) * 0.5 else 0 end) as knowledge_weight from det",
    "gradient": "select query_id, coalesce(cg, case when ch > 0 then share * 0.5 else 0 end) as code_weight, coalesce(kg, case when kh > 0 then (1 - share) * 0.5 else 0 end) as knowledge_weight from det",
    "calibrated": "select query_id, cw * coalesce(1 / (1 + exp(-(cs - 0.32) / 0.04)), 1) as code_weight, (1 - cw) * coalesce(1 / (1 + exp(-(ks - 0.64) / 0.03)), 1) as knowledge_weight from det",
}.items():
    query(f"rnk4_weights_{_name}", f"with {_SIG} select query_id, {_W} from ({_sql})")(
        lambda s, d, _name=_name: fusion.channel_weights(signals(s, d), _name).select("query_id", F.round("code_weight", 6).alias("code_weight"), F.round("knowledge_weight", 6).alias("knowledge_weight"))
    )


def shares(s, d, made):
    return fusion.detect_shares(signals(s, d, made)).select("query_id", "code_weight", "knowledge_weight")


def merged(s, d, made=None, weights=None):
    made = made or ready(s, d)
    return fusion.merge_channels(fused(s, d, made), shares(s, d, made) if weights is None else weights)


_MERGE = f"""{_SIG}, mg as (select query_id, channel, id, round(score * case when channel = 'code' then cw else 1 - cw end, 12) as score from norm join det using (query_id)),
merged as (select *, row_number() over (partition by query_id order by score desc, id) as rank from mg where score >= 0.05)"""
query("rnk3_merged_channels", f"with {_MERGE} select query_id, channel, id, round(score, 6) as score, rank from merged")(lambda s, d: merged(s, d).withColumn("score", F.round("score", 6)))


def drifted(s, d):
    """References that drifted per document: here, the number of its exact copies beyond the first."""
    same = docs(s, d).where("text <> ''").groupBy("text").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    return same.where("n > 1").select("id", (F.col("n") - 1).alias("n_drift"))


_DRIFT = "dr as (select min(doc_id) as id, count(*) - 1 as n_drift from documents where text <> '' group by text having count(*) > 1)"
query("rnk7_drift_demotion", f"with {_MERGE}, {_DRIFT} select query_id, id, round(score * pow(0.7, coalesce(n_drift, 0)), 6) as score from merged left join dr using (id)")(
    lambda s, d: fusion.drift_demotion(merged(s, d), drifted(s, d)).select("query_id", "id", F.round("score", 6).alias("score"))
)
def weighted(s, d):
    from loamgraph.session import durable

    made = ready(s, d)
    weights = durable(shares(s, d, made))
    return merged(s, d, made, weights).join(weights, "query_id")


_SHARED = f"""{_MERGE}, sh as (select merged.*, cw, 1 - cw as kw, case when channel = 'code' then cw else 1 - cw end as share, count(*) over (partition by query_id) as n,
  min(rank) over (partition by query_id, channel) as first from merged join det using (query_id))"""
_SLOTS = f"""{_SHARED}, sl as (select *, max(case when share >= 0.2 and first > least(5, n) and (n > 1 or share > 0.5) then first end) over (partition by query_id) as came, least(5, n) as w from sh)
select query_id, id, channel, case when rank = came then w when rank between w and came - 1 then rank + 1 else rank end as rank from sl"""


def _quota(source: str, channel: str, weight: str) -> str:
    lack = f"case when {weight} >= 0.2 and n > {LIMIT} then greatest(floor({weight} * {LIMIT}) - count(*) filter (channel = '{channel}' and rank <= {LIMIT}) over (partition by query_id), 0) else 0 end"
    behind = f"channel = '{channel}' and rank > {LIMIT}"
    return f"""{channel}0 as (select *, {lack} as lack, case when {behind} then row_number() over (partition by query_id, {behind} order by rank) end as b from {source}),
{channel}1 as (select *, coalesce(b <= lack, false) as up from {channel}0), {channel}2 as (select *, case when up then 1 when rank <= {LIMIT} - count(*) filter (up) over (partition by query_id) then 0 else 2 end as grp from {channel}1),
{channel}3 as (select query_id, channel, id, cw, kw, n, row_number() over (partition by query_id order by grp, rank) as rank from {channel}2)"""


query("rnk9_mmr", None)(lambda s, d: fusion.diversified(weighted(s, d).join(space(s, d).select("id", "embedding"), "id", "left")))
query("rnk10_diversity_slots", f"with {_SLOTS}")(lambda s, d: fusion.with_slots(weighted(s, d), LIMIT).select("query_id", "id", "channel", "rank"))
query("rnk11_window_quota", f"with {_SHARED}, {_quota('sh', 'code', 'cw')}, {_quota('code3', 'knowledge', 'kw')} select query_id, id, channel, rank from knowledge3")(
    lambda s, d: fusion.with_quotas(weighted(s, d), LIMIT).select("query_id", "id", "channel", "rank")
)
query("rnk12_silence_gate", f"with {_MERGE}, {_COV.split(_FTS + ', ')[1]} select query_id, id, rank from merged where query_id in (select query_id from cov where coverage >= 0.45)")(
    lambda s, d: silenced(s, d).select("query_id", "id", "rank")
)


def silenced(s, d):
    """Merged lists of the questions that their first documents cover; both read the same lists."""
    made = ready(s, d)
    return fusion.silence_gate(merged(s, d, made), coverage(s, d, made))


_COLD = m.sql("rec", f""", acc as (select lower(trim(entity_id)) as id, sum(coalesce(access_count, 0)) as n from (select distinct * from entity_access) where trim(entity_id) <> '' group by 1)
select id, round(0.3 * coalesce(confidence, case when type = 'rule' then 0.8 else 0.5 end) + 0.1 * ln(coalesce(n, 0) + 1.0) + 0.2 * coalesce(pow(2.0, -((1746057600000000 - created_us) / 86400000000.0) / 14.0), 0), 6) as score from rec left join acc using (id)""")
query("rnk13_cold_start_score", _COLD)(lambda s, d: cold_scores(s, d).select("id", F.round("score", 6).alias("score")))


def cold_scores(s, d):
    from loamgraph.plans.relational import AS_OF_US, access_counts

    rows = m.records(s, d).join(access_counts(s, d).select(F.col("entity_id").alias("id"), "access_count"), "id", "left")
    return rows.withColumn("score", fusion.cold_start_score(F.col("confidence"), F.col("type"), F.col("access_count"), F.col("created_us"), AS_OF_US))


_PRIOR = m.sql("edge", _COLD[_COLD.index(", acc as"):_COLD.index("select id, round(")] + f""", cold as (select id, 0.3 * coalesce(confidence, case when type = 'rule' then 0.8 else 0.5 end) + 0.1 * ln(coalesce(n, 0) + 1.0)
  + 0.2 * coalesce(pow(2.0, -((1746057600000000 - created_us) / 86400000000.0) / 14.0), 0) as score from rec left join acc using (id)),
deg as (select target_id as id, count(*) as k from edge where edge_type in ('{"', '".join(m.CURATED)}') group by 1) select id, round(score * (1 + 0.3 * ln(1.0 + coalesce(k, 0))), 6) as score from cold left join deg using (id)""")
query("rnk8_provenance_prior", _PRIOR)(lambda s, d: fusion.provenance_prior(cold_scores(s, d), curated_degree(s, d)).select("id", F.round("score", 6).alias("score")))


def curated_degree(s, d):
    """(id, in_degree): edges written by people that lead to a record."""
    return m.edges(s, d).where(F.col("edge_type").isin(m.CURATED)).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))


query("rnk15_bands", f"with {_FTS} select query_id, doc_id, case when rank <= {LIMIT} then 'direct' else 'deep' end as band from fts where rank <= {3 * LIMIT}")(lambda s, d: fusion.bands(fts(s, d), LIMIT).select("query_id", "doc_id", "band"))
query("gra18_corroborated", f"with {_FTS}, {_KNN}, deep as (select query_id, doc_id as id from fts where rank between {LIMIT + 1} and {3 * LIMIT} union all select query_id, id from knn where rank between {LIMIT + 1} and {3 * LIMIT}) select query_id, id from deep group by all having count(*) >= 2")(
    lambda s, d: fusion.corroborated(fts(s, d).select("query_id", F.col("doc_id").alias("id"), "rank").unionByName(knn(s, d).select("query_id", "id", "rank")).where(F.col("rank") > LIMIT))
)

QUERIES, SQL = query.queries, query.sql
