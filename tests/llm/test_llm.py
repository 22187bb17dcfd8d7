"""The training-data operators against brute force, on sf0.001 / sf0.01 and on small fixtures."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from parity import canonical, connect
from pyspark.sql import functions as F

from loamgraph.llm import distinctive, leaks, neardup, packing, queries, truncation, vectors

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    con = connect(SMALL)
    df = queries.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name in queries.SQL:
        res = con.execute(queries.SQL[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns) and canonical(rows, df.columns) == canonical(res.fetchall(), names)


# p1


def test_terms(spark):
    rows = {"splitPackageDecoder HTTPServer re_use éclair": ["split", "package", "decoder", "httpserver", "clair"], "": [], None: [], "abc de": []}
    out = {r.t: r.x for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", distinctive.terms(F.col("t")).alias("x")).collect()}
    assert out == rows


def brute_scores(lists, window=distinctive.WINDOW):
    df = Counter(t for ts in lists.values() for t in set(ts))
    out = {}
    for i, ts in lists.items():
        near = defaultdict(set)
        for a in range(len(ts)):
            for b in range(a + 1, min(a + window, len(ts))):
                if ts[a] != ts[b]:
                    near[ts[a]].add(ts[b])
                    near[ts[b]].add(ts[a])
        for t, n in Counter(ts).items():
            out[i, t] = (n, len(near[t]), df[t], len(near[t]) * math.log(len(lists) / df[t]))
    return out


def test_scores_with_hot_terms_and_long_records(spark, monkeypatch):
    monkeypatch.setattr(distinctive, "FREQUENT_LEAST", 5)
    rng = np.random.default_rng(2)
    lists = {f"r{i}": ["hot"] * (i % 3) + [f"w{x}" for x in rng.zipf(1.3, 20) % 50] for i in range(60)}
    lists |= {"empty": [], "long": [f"w{i % 70}" for i in range(5000)], "same": ["one"] * 10}
    df = spark.createDataFrame(list(lists.items()), "entity_id string, terms array<string>")
    got = {(r.entity_id, r.term): (r.tf, r.degree, r.df, r.score) for r in distinctive.term_scores(df).collect()}
    want = brute_scores(lists)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    some = {(r.entity_id, r.term) for r in distinctive.term_scores(df, min_tf=2, min_df=2, max_df=4).collect()}
    assert some == {k for k, v in want.items() if v[0] >= 2 and 2 <= v[2] <= 4}
    assert distinctive.term_scores(df.limit(0)).count() == 0
    few = {(r.entity_id, r.term): (r.tf, r.degree, r.df, r.score) for r in distinctive.term_scores(df, min_tf=2, min_df=2, max_df=4).collect()}
    assert all(v == pytest.approx(want[k]) for k, v in few.items())  # rows that are left out take no part of the graphs away


# p4

WORD = re.compile(r"[^\W_]+")


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").lower())
        out[i] = frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset()
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def texts_with_copies():
    rng = np.random.default_rng(7)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 40)) for _ in range(30)]
    texts = {f"b{i}": t for i, t in enumerate(base)}
    for i, t in enumerate(base[:12]):
        w = t.split()
        for j in range(3):
            v = list(w)
            v[rng.integers(0, 40)] = "edited"
            texts[f"e{i}-{j}"] = " ".join(v)
    texts |= {f"hot{i}": base[0] for i in range(20)} | {"null": None, "empty": "", "short": "two words"}
    return texts


@pytest.mark.parametrize("bucket", [256, 2])
def test_similar_pairs_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    texts = texts_with_copies()
    df = neardup.shingled(spark.createDataFrame(list(texts.items()), "id string, text string"), 3)
    sets = sets_of(texts, 3)
    ids = sorted(texts)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(sets[a], sets[b]) >= 0.6}
    got = [(r.id_a, r.id_b) for r in neardup.similar_pairs(df, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rows = {r.id: r for r in neardup.groups(df, 0.6).collect()}
    assert rows.keys() == {i for i in ids if sets[i]}
    assert all(rows[a].group_id == rows[b].group_id for a, b in want) and rows["hot1"].n_copies == 21
    assert len({r.group_id for r in rows.values()}) == 30
    assert neardup.similar_pairs(df.limit(0), 0.6).count() == 0 == neardup.groups(df.limit(0), 0.6).count()


def test_one_common_band_is_enough_in_large_buckets(spark, monkeypatch):
    sets = [(bytes([i]) * 16, [*range(100), 1000 + i]) for i in range(40)]
    df = spark.createDataFrame(sets, "cid binary, shingles array<bigint>")
    found = lambda: {(bytes(r.a), bytes(r.b)) for r in neardup.similar_classes(df, 0.6, 1, 1).collect()}
    small = found()
    monkeypatch.setattr(neardup, "BUCKET", 3)
    assert len(small) > 500 and found() == small


def test_meetings_are_all_pairs_of_all_buckets():
    """Whatever the batches cut: small buckets give pairs, large ones their rows once each."""
    rng = np.random.default_rng(8)
    rows = sorted({(int(k), int(s)) for k, s in zip(rng.choice(12, 400, p=[0.4, 0.2, *[0.04] * 10]), rng.integers(0, 150, 400))})
    rows = [r for r in rows for _ in range(1 + r[1] % 2)]
    for cut in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[a : a + cut]], "short": [s for _, s in rows[a : a + cut]]}) for a in range(0, len(rows), cut)]
        out = [tuple(r.values()) for b in neardup._meetings(20)(iter(batches)) for r in b.to_pylist()]
        of = {k: sorted({s for q, s in rows if q == k}) for k, _ in rows}
        assert sorted((k, a) for a, b, k in out if b is None) == [(k, s) for k in sorted(of) if len(of[k]) > 20 for s in of[k]]
        assert {(a, b) for a, b, k in out if b is not None} == {(x, y) for v in of.values() if len(v) <= 20 for i, x in enumerate(v) for y in v[i + 1 :]}


def test_signatures_estimate_probability_jaccard():
    """Equal components of weighted sets are as frequent as their probability Jaccard similarity says."""
    rng = np.random.default_rng(0)
    m, n = 4096, 60
    ids = rng.integers(-(2**62), 2**62, n)
    for _ in range(4):
        u, v = rng.exponential(1, n) * (rng.random(n) < 0.8), rng.exponential(1, n) * (rng.random(n) < 0.8)
        exact = sum(1 / sum(max(u[j] / u[i], v[j] / v[i]) for j in range(n)) for i in range(n) if u[i] and v[i])
        owner = np.concatenate([np.zeros((u > 0).sum(), int), np.ones((v > 0).sum(), int)])
        s = neardup.signatures(owner, np.concatenate([ids[u > 0], ids[v > 0]]), np.concatenate([u[u > 0], v[v > 0]]), 2, m)
        assert abs((s[0] == s[1]).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / m) + 1e-3


def test_signature_does_not_depend_on_company_or_order():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, 50), rng.integers(-(2**62), 2**62, 3)
    alone = neardup.signatures(np.zeros(50, int), a, np.ones(50), 1, 128)
    order = rng.permutation(50)
    both = neardup.signatures(np.concatenate([np.zeros(50, int), np.ones(3, int)]), np.concatenate([a[order], b]), np.ones(53), 2, 128)
    assert (alone[0] == both[0]).all() and set(both[1]) <= set(b)


# p6


def brute_neighbours(rows, k, least):
    unit = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 768 and np.isfinite(v).all() and any(v):
            unit.setdefault(i, np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)))
    ids = sorted(unit)
    x = np.stack([unit[i] for i in ids]) if ids else np.empty((0, 768))
    s = np.round(x @ x.T, 9)
    out = set()
    for a in range(len(ids)):
        best = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out |= {(ids[a], b) for d, b in best if -d >= least}
    return out


@pytest.mark.parametrize("name", ["code_embeddings", "knowledge_embeddings"])
def test_recall_on_whole_table(spark, name):
    rows = [(r["entity_id"], r["embedding"]) for r in pq.read_table(f"{DATA}/{name}.parquet").to_pylist()]
    want = brute_neighbours([(i, None if v is None or any(x is None for x in v) else v) for i, v in rows], 5, 0.8)
    got = {(r.entity_id, r.neighbour_id) for r in vectors.most_similar(spark.read.parquet(f"{DATA}/{name}.parquet")).collect()}
    assert not got - want and len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("bucket", [1_000_000, 3])
def test_copies_ties_bad_rows_and_split_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(vectors, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((8, 768))
    rows = [(f"v{c}-{j}", (centre[c] + 0.25 * rng.standard_normal(768)).astype(np.float32).tolist()) for c in range(8) for j in range(5)]
    rows += [(f"copy{j:02}", rows[0][1]) for j in range(12)] + [("double", [2 * x for x in rows[0][1]])]
    rows += [("null", None), ("empty", []), ("zero", [0.0] * 768), ("nan", [float("nan")] * 768), ("short", [1.0]), (None, rows[0][1]), ("copy01", rows[0][1])]
    df = spark.createDataFrame(rows, "entity_id string, embedding array<float>").repartition(3)
    want = brute_neighbours(rows, 5, 0.8)
    got = {(r.entity_id, r.neighbour_id) for r in vectors.most_similar(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want
    assert {(a, b) for a, b in want if "copy" in a} == {(a, b) for a, b in got if "copy" in a}
    assert vectors.most_similar(df.limit(0)).count() == 0


def test_copies_of_different_batches_take_one_place(spark):
    """Repeated rows that no batch holds together do not push the other neighbours out of a bucket."""
    rng = np.random.default_rng(5)
    base, noise = rng.standard_normal(768), rng.standard_normal((6, 768))
    x = math.sqrt(0.92) * base / np.linalg.norm(base) + math.sqrt(0.08) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = [(f"r{i}", [float(v) for v in x[i].astype(np.float32)]) for i in range(6)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows * 12, 12), "entity_id string, embedding array<float>")  # one of each per task
    got = {(r.entity_id, r.neighbour_id) for r in vectors.most_similar(df).collect()}
    assert got == brute_neighbours(rows, 5, 0.8) and len(got) == 30


@pytest.mark.parametrize("fine", [4, 8, 12])
def test_recall_with_many_functions(spark, fine):
    """The settings of large collections, forced on a whole table: all rows are asked, recall stays."""
    path = "/root/testdata/sf0.1/code_embeddings.parquet"
    rows = [(r["entity_id"], r["embedding"]) for r in pq.read_table(path).to_pylist()]
    want = brute_neighbours([(i, None if v is None or any(x is None for x in v) else v) for i, v in rows], 5, 0.8)
    got = {(r.entity_id, r.neighbour_id) for r in vectors.most_similar(spark.read.parquet(path), how=vectors.of_functions(4, fine)).collect()}
    assert not got - want and len(got & want) >= 0.95 * len(want)


def compared_share(how, n=4000):
    """Share of all ordered pairs of random unit vectors that lie in cells asked."""
    x = np.random.default_rng(1).standard_normal((n, 768)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys, fine = vectors.buckets(x, how), vectors.fine_values(x, how)
    pairs = 0
    for t in range(how.tables):
        rows = vectors.Sketches(np.concatenate([np.zeros((n, vectors.SKETCH_BITS // 8), np.uint8), fine[:, t]], 1), how)
        cells = rows.cells(0, n, how.fine_probes)
        for p in range(keys.shape[2]):
            asks = (keys[:, t, p, None].astype(np.uint64) ^ (cells.astype(np.uint64) * np.uint64(3))).ravel()
            own = keys[:, t, 0].astype(np.uint64) ^ (cells[:, 0].astype(np.uint64) * np.uint64(3))
            key, count = np.unique(own, return_counts=True)
            at = np.minimum(np.searchsorted(key, asks), len(key) - 1)
            pairs += int(count[at][key[at] == asks].sum())
    return pairs / n / n


def test_compared_share_falls_with_the_number_of_vectors():
    shares = [compared_share(vectors.of_functions(4, f)) for f in (0, 4, 8)]
    assert shares[0] < 0.4 and shares[1] < 0.3 * shares[0] and shares[2] < 0.3 * shares[1]
    sizes = [vectors.settings(10**e) for e in range(3, 10)]
    assert all(a.coarse + a.fine <= b.coarse + b.fine for a, b in zip(sizes, sizes[1:])) and sizes[-1].coarse + sizes[-1].fine >= 13
    assert all(h.tables * (1 + h.coarse_probes) == 16 for h in sizes[:5])


def test_dense_group_loses_no_nearest(spark):
    """Hundreds of vectors within the radius of each other: what the sketches leave out is not among the nearest."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(768)
    rows = [(f"d{j:03}", [float(v) for v in (centre + 0.35 * rng.standard_normal(768)).astype(np.float32)]) for j in range(400)]
    df = spark.createDataFrame(rows, "entity_id string, embedding array<float>").repartition(3)
    want = brute_neighbours(rows, 5, 0.8)
    for how in (None, vectors.of_functions(4, 3)):
        got = {(r.entity_id, r.neighbour_id) for r in vectors.most_similar(df, how=how).collect()}
        assert len(got & want) >= 0.97 * len(want)


def test_probe_sets_come_in_order_of_score():
    for k, n in ((4, 20), (6, 40)):
        sets = vectors.probe_sets(k, n)
        assert len(sets) == len(set(sets)) == n and sets[0] == (0,)
        assert all(2 * k - 1 - j not in s for s in sets for j in s)


def test_pack_is_lossless():
    x = np.array([[0.5, -0.25], [1e-9, 3.1], [1e6, 0.0]], np.float32)
    assert (vectors.unpack(pa.array(vectors.pack(x), pa.binary()), 2) == x).all() and [len(b) for b in vectors.pack(x)] == [4, 8, 8]


# p7


def test_closest_subset_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted({int(x) for x in rng.integers(1, 40, 6)}, reverse=True)
        counts = {v: int(rng.integers(0, 4)) for v in lengths}
        room = int(rng.integers(0, 120))
        sums = {0}
        for v, n in counts.items():
            sums = {s + v * k for s in sums for k in range(n + 1)}
        taken = packing.closest_subset(lengths, counts, room)
        assert all(k <= counts[v] for v, k in taken.items()) and sum(v * k for v, k in taken.items()) == max(s for s in sums if s <= room)


def test_packs_small(spark):
    lengths = [(1, 250), (2, 0), (3, 60), (4, 40), (5, 40), (6, 99), (7, 1), (8, 100), (9, 300)] + [(i, 50) for i in range(10, 110)]
    budgets = spark.createDataFrame([(1, "a", 100), (2, "b", 1000), (2, "b", 1000), (3, "c", 0), (None, "d", 5)], "budget_id int, pack_mode string, capacity_tokens int")
    out = packing.packs(spark.createDataFrame(lengths, "doc_id bigint, tokens bigint"), budgets).collect()
    for b, capacity in ((1, 100), (2, 1000)):
        rows = [r for r in out if r.budget_id == b]
        assert Counter() == Counter({d: n for d, n in lengths}) - Counter(d for r in rows for d in [r.doc_id] * r.tokens)
        fill = defaultdict(int)
        for r in rows:
            if r.tokens:
                fill[r.pack_id] += r.tokens
        assert all(fill[r.pack_id] == r.fill <= capacity for r in rows if r.tokens) and [r.pack_id for r in rows if not r.tokens] == [None]
        assert len(fill) == math.ceil(sum(n for _, n in lengths) / capacity)
        assert all(r.tokens == capacity for r in rows if r.doc_id == 9 and b == 1)
        assert all(sum(r.doc_id == d for r in rows) == max(1, -(-n // capacity)) for d, n in lengths)
    none = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.packs(none, budgets).count() == 0 and packing.packs(none, budgets.limit(0)).count() == 0


def test_unused_space_on_documents(spark):
    fills = queries.p7_fills(spark, DATA).groupBy("budget_id", "capacity").agg(F.count("*").alias("n"), F.sum("fill").alias("t")).collect()
    assert len(fills) == 4 and all(r.n <= math.ceil(r.t / r.capacity) * 1.01 for r in fills)


def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "ab " * 50_000), (None, "x")], "doc_id bigint, text string")
    out = {r.doc_id: r.tokens for r in packing.token_lengths(df).collect()}
    assert out[1] == 2 and out[2] == out[3] == 0 and out[4] > 1 and out[5] >= 50_000 and len(out) == 5


# p8


def test_leaks_small(spark, monkeypatch):
    item = " ".join(f"Word{i}" for i in range(20))
    items = spark.createDataFrame([(1, "s", item), (2, "s", "too short"), (3, "s", None), (4, "s", "x y " * 10), (5, "s", "other start " + " ".join(f"word{i}" for i in range(12)))], "item_id bigint, suite string, text string")
    body = ", ".join(f"WORD{i}!" for i in range(3, 16))
    docs = spark.createDataFrame(
        [(1, f"Before this. {body} After that."), (2, " ".join(f"word{i}" for i in range(11))), (3, None), (4, ""), (5, "lorem ipsum " * 10_000 + item), (6, "y x " * 7), (None, item), (7, "word0 " + item)], "doc_id bigint, text string"
    )
    want = {(1, 1), (5, 1), (5, 5), (6, 4), (7, 1), (7, 5)}
    same = []
    for bound in (leaks.BROADCAST_WORDS, 0):
        monkeypatch.setattr(leaks, "BROADCAST_WORDS", bound)
        hits = leaks.passages(docs.unionByName(docs.where("doc_id = 1")), items)
        same.append(sorted(map(tuple, hits.collect())))
        assert {(r.doc_id, r.item_id) for r in leaks.leaked_pairs(hits).collect()} == want
    assert same[0] == same[1] and len(same[0]) == len(set(same[0]))
    clean = {r.doc_id: r.text for r in leaks.without_leaks(docs, hits).collect()}
    assert clean[1] == "Before this. ! After that." and clean[2] == " ".join(f"word{i}" for i in range(11)) and clean[3] is None and clean[7] == "word0 "
    assert {r.doc_id for r in leaks.without_leaks(docs, hits, "documents").collect()} == {2, 3, 4, None}
    assert leaks.passages(docs.limit(0), items).count() == 0 == leaks.passages(docs, items.limit(0)).count()


def test_clean_text_with_longer_lower_case():
    text = "İİ " + " ".join(f"w{i}" for i in range(12)) + " end"
    first = len(leaks._words("İİ"))
    assert leaks._cut(text, [first], 12) == "İİ  end"


# p9

ENDS = {
    "A full sentence.": "full", "Is it? ": "full", '"Quoted."': "full", "(In brackets!)": "full", "**Bold.**": "full", "Text.\n</note>": "full", "Text.\n\n```\ncode()\n```": "full", "| a | b |\n|---|---|\n| 1 | 2 |": "full",
    "Text.\n\nStatus: done": "weak", "Text.\n\nRefs: a-1\nChange-Id: b-2": "weak", "Text that stops": "cut", "Text that sto…": "cut", "Text that...": "cut", "Text.\n\n```\ncode.": "cut", "In src/some/file.": "cut", "In src/some/file.rs.": "full",
    "Use `name.": "cut", "stop\n</note>": "cut", 'Why resolve_bran"': "cut", "cut here [cut]": "cut", "ends b�": "cut", "| a | b |\n|---|": "cut", "Question: is it so?\nAnswer: Because": "cut", "# Title": "cut", "   ": None, "": None, None: None,
}


def test_ends(spark):
    out = {r.t: r.e for r in truncation.with_ends(spark.createDataFrame([(t, t, "notes/x") for t in ENDS], "t string, text string, source string")).withColumnRenamed("end", "e").collect()}
    assert out == ENDS
    commits = {"Fix the thing": "weak", "x" * 73: "cut", "Fix the…": "cut", "two\nlines": "cut"}
    out = {r.t: r.e for r in truncation.with_ends(spark.createDataFrame([(t, t, "commits/x") for t in commits], "t string, text string, source string")).withColumnRenamed("end", "e").collect()}
    assert out == commits


def test_spikes_and_causes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "lim", "y" * 100) for i in range(20)] + [(100 + i, "lim", "z" * int(n) + ".") for i, n in enumerate(rng.permutation(90))]
    rows += [(300, "lim", "é" * 30), (301, None, "stops"), (302, "free", "stops"), (303, "free", None), (304, "free", "Done."), (305, "lim", "x" * 86 + "\n\nStatus: cut")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = {r.doc_id: (r.cut, r.cause) for r in truncation.flagged(df).collect()}
    assert all(out[i] == (True, "limit") for i in range(20)) and not any(out[100 + i][0] for i in range(90))
    assert out[300] == out[301] == out[302] == (True, "transfer") and out[303] == out[304] == (False, None) and out[305] == (True, "limit")
    report = {r.source: (r.n_texts, r.n_cut, r.n_limit, r.share_cut) for r in truncation.truncation_report(truncation.flagged(df)).collect()}
    assert report["free"] == (2, 1, 0, 0.5) and report["lim"][1:3] == (22, 21)
    sure = {r.doc_id: r.confidence for r in truncation.flagged(df).collect()}
    assert 0.7 < sure[0] <= 1 and sure[0] == sure[305] and sure[300] is None
    only = {r.source: (r.n_limit_only, r.n_at_limit) for r in truncation.truncation_report(truncation.flagged(df)).collect()}
    assert only["lim"][0] == 1 and only["lim"][1] >= 21 and only["free"] == (0, 0)  # 305 is found by the histogram alone
    apart = df.withColumn("source", F.concat(F.lit("own"), F.col("doc_id").cast("string")))  # the same texts without a histogram
    assert {r.doc_id for r in truncation.flagged(apart).where("cut").collect()} == {i for i, v in out.items() if v[0]} - {305}
    assert truncation.flagged(df.limit(0)).count() == 0
