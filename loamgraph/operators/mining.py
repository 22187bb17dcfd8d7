"""Signals mined from telemetry: missed searches, uncovered edits, recurring use, hot files, errors and their fixes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.joining import between_boundaries, first_successor
from loamgraph.operators.ordered import running_sum

# Events that end a stretch of work; words that tell an error.
BOUNDARIES = ["prompt_submit", "session_start", "session_end"]
ERROR_WORDS = ["error", "failed", "panic", "traceback", "exception"]
FIX_WINDOW, HOT_SAVES, HOT_DAYS, RECURRING_HITS, SUGGESTIONS = 20, 3, 2, 2, 500


def looks_failed(result: Column) -> Column:
    """Whether a tool's result tells a failure: the last `Exit code: N` decides, else words in the first 200 characters."""
    tail = F.substring_index(result, "Exit code:", -1)
    code = F.when(result.contains("Exit code:"), F.regexp_extract(tail, r"\A\s*([+-]?\d+)(?:\s|\z)", 1))
    words = F.lower(F.substring(result, 1, 200)).rlike("|".join(ERROR_WORDS))
    return F.coalesce(F.when(code != "", code.cast("bigint") != 0).otherwise(words), F.lit(False))


def saves_after(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, path) of the files saved after an anchor event and before the workspace's next boundary."""
    stretch = log.where("workspace is not null").select("workspace", "id", "kind")
    wanted = log.where("kind = 'file_save' and path is not null").select("workspace", "id", "path")
    return between_boundaries(stretch, anchors.select("workspace", "id"), wanted, F.col("kind").isin(BOUNDARIES), "workspace").select("anchor_id", "path")


def best_changed(changes: DataFrame, files: DataFrame, questions: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score): the `most` best files of each question by graph.cochange_score(), ties by id; neither itself nor
    the files that are `taken` (query_id, id).

    changes: (term, id, n, df), one row per term and file; files: (id, words); questions: (query_id, asked, terms), the tokens,
    and those of them, distinct, that are sought among the changes. Files are rows with all their terms and the questions that
    may not have them; a task scores a batch of files under every question, so their pairs are never rows.
    """
    spark = changes.sparkSession
    listed = questions.select("query_id", "asked", "terms").toArrow().combine_chunks()
    kind, key = dict(changes.dtypes)["id"], dict(questions.dtypes)["query_id"]
    if not listed.num_rows:
        return spark.createDataFrame([], f"query_id {key}, id {kind}, score double")
    flat = {c: listed[c].combine_chunks() for c in ("asked", "terms")}
    vocabulary = pc.unique(pa.concat_arrays([x.flatten() for x in flat.values()]))
    same = defaultdict(list)  # questions of the same tokens are scored once
    lists = lambda x: np.split(pc.index_in(x.flatten(), vocabulary).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))[:-1])
    for q, (a, t) in enumerate(zip(lists(flat["asked"]), lists(flat["terms"]))):
        same[tuple(np.unique(a)), tuple(t)].append(q)
    packed = [(np.cumsum([0, *map(len, x)]), np.concatenate([np.array(v, np.int64) for v in x])) for x in zip(*[(a, t, q) for (a, t), q in same.items()])]
    shared = spark.sparkContext.broadcast((len(vocabulary), packed))
    numbered = spark.createDataFrame(pa.table({"query_id": listed["query_id"], "number": pa.array(np.arange(listed.num_rows), pa.int32())}))
    known = spark.createDataFrame(pa.table({"term": vocabulary, "t": pa.array(np.arange(len(vocabulary)), pa.int32())}))
    rows = changes.join(known, "term").groupBy("id").agg(*[F.collect_list(F.col(c).cast(k)).alias(c) for c, k in (("t", "int"), ("n", "bigint"), ("df", "bigint"))])
    names = files.join(rows.select("id"), "id", "left_semi").select("id", F.explode("words").alias("term")).join(known, "term").groupBy("id").agg(F.collect_list("t").alias("words"))
    none = taken.select("query_id", "id").unionByName(questions.select("query_id", F.col("query_id").cast(kind).alias("id"))).distinct()
    none = none.join(numbered, "query_id").groupBy("id").agg(F.collect_list("number").alias("taken"))
    rows = rows.join(names, "id", "left").join(none, "id", "left").select("id", "t", "n", "df", "words", "taken")
    best = rows.mapInArrow(_changed(shared, most), f"number int, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc(F.round("score", 9)), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).join(numbered, "number").select("query_id", "id", "score")


def _changed(shared, most: int):
    """Scores batches of files (id, t, n, df, words, taken) under the questions' sets of terms."""

    def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and values of lists; nulls are empty."""
        return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def sorted_by(keys: np.ndarray, n: int, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        return np.searchsorted(keys[order], np.arange(n + 1)), *[v[order] for v in values]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, packed = shared.value
        n_questions = len(packed[2][1])
        for b in batches:
            b = b.take(pc.sort_indices(b["id"]))
            file, t = lines(b["t"])
            n, df = (lines(b[c])[1] for c in ("n", "df"))
            at, file, n, part = sorted_by(t, n_terms, file, n, n / df)
            word_at, word_file = sorted_by(*(lambda f, w: (w, n_terms, f))(*lines(b["words"])))
            taken_at, taken = sorted_by(*(lambda f, q: (q, n_questions, f))(*lines(b["taken"])))
            out = []
            for s in range(len(packed[0][0]) - 1):
                asked, terms, questions = (values[starts[s] : starts[s + 1]] for starts, values in packed)
                idf, count, overlap = np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows)
                for x in terms:
                    here = slice(at[x], at[x + 1])
                    idf[file[here]] += part[here]
                    count[file[here]] += n[here]
                found = np.flatnonzero(count)
                if not len(found):
                    continue
                for x in asked:
                    np.add.at(overlap, word_file[word_at[x] : word_at[x + 1]], 1)
                i = idf[found]
                score = 0.07 + 0.08 * i / (i + 3.0) + 0.05 * np.minimum(overlap[found], 3) + 0.005 * np.minimum(count[found], 8)
                value = np.round(score, 9)
                held = [taken[taken_at[q] : taken_at[q + 1]] for q in questions]
                enough = most + max(map(len, held))
                if len(found) > enough:
                    good = value >= np.partition(value, len(value) - enough)[len(value) - enough]
                    found, score, value = found[good], score[good], value[good]
                first = np.argsort(-value, kind="stable")  # files are sorted by id
                for q, h in zip(questions, held):
                    own = first[~np.isin(found[first], h)][:most] if len(h) else first[:most]
                    out.append((np.full(len(own), q), found[own], score[own]))
            if out:
                q, place, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), b["id"].take(pa.array(place)), pa.array(score)], ["number", "id", "score"])

    return scan


def indexed_paths(records: DataFrame) -> DataFrame:
    return records.where("file_path is not null").select(F.col("file_path").alias("path")).distinct()


def search_misses(log: DataFrame, records: DataFrame) -> DataFrame:
    """Searches without a result that were followed by saves of indexed files: event_id, query, n_files."""
    empty = log.where("kind = 'search_performed' and coalesce(returned, 0) <= 0 and query <> ''")
    files = saves_after(log, empty).join(indexed_paths(records), "path", "left_semi")
    n = files.groupBy("anchor_id").agg(F.countDistinct("path").alias("n_files"))
    return empty.join(n, F.col("id") == F.col("anchor_id")).select(F.col("id").alias("event_id"), "query", "n_files")


def uncharted_edits(log: DataFrame, records: DataFrame, steps: DataFrame) -> DataFrame:
    """Prompts whose pack gave no hit and whose workspace then saved indexed files before its next boundary: event_id, n_files,
    n_indexed.

    A prompt is itself a boundary; the stretch behind it is its own. Its pack is what was delivered in it (steps, see
    outcomes()): if one of the deliveries was hit, the prompt does not count.
    """
    packs = log.where("kind = 'prompt_submit' and workspace is not null")
    given = steps.where("step in ('touch', 'pull', 'deliver', 'boundary')")
    numbered = running_sum(given, "key", "at", (F.col("step") == "boundary").cast("int"), "stretch")
    hits = outcomes(steps).where("outcome = 'hit'").select("key", F.col("delivery_id").alias("at")).distinct()
    hit = numbered.where("step = 'deliver'").join(hits, ["key", "at"], "left_semi").select("key", "stretch").distinct()
    charted = numbered.where("step = 'boundary'").join(hit, ["key", "stretch"], "left_semi").select(F.col("at").alias("id"))
    files = saves_after(log, packs.join(charted, "id", "left_anti")).distinct()
    indexed = files.join(indexed_paths(records), "path", "left_semi").groupBy("anchor_id").agg(F.count("*").alias("n_indexed"))
    every = files.groupBy("anchor_id").agg(F.count("*").alias("n_files"))
    return indexed.join(every, "anchor_id").select(F.col("anchor_id").alias("event_id"), "n_files", "n_indexed")


def recurring_use(usage: DataFrame, least: int = RECURRING_HITS) -> DataFrame:
    """Entities hit in `least` deliveries or more."""
    return usage.where("outcome = 'hit'").groupBy("entity_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)


def hot_files(log: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Files saved HOT_SAVES times or more on HOT_DAYS days or more, of the index if records are given."""
    day = F.floor(F.col("us") / 86_400_000_000)
    rows = log.where("kind = 'file_save' and path <> ''").groupBy("path").agg(F.count("*").alias("saves"), F.countDistinct(day).alias("days"))
    hot = rows.where((F.col("saves") >= HOT_SAVES) & (F.col("days") >= HOT_DAYS))
    return hot if records is None else hot.join(indexed_paths(records), "path", "left_semi")


def error_fixes(log: DataFrame, window: int = FIX_WINDOW) -> DataFrame:
    """Failed tool calls and the first clean call of the same tool among the workspace's next `window` calls."""
    calls = log.where("kind = 'post_tool_use' and workspace is not null").select("workspace", "id", F.coalesce("tool", F.lit("")).alias("tool"), looks_failed(F.coalesce("result", F.lit(""))).alias("failed"))
    return first_successor(calls, "workspace", window)


def suggestions(log: DataFrame, records: DataFrame, usage: DataFrame, steps: DataFrame, most: int = SUGGESTIONS) -> DataFrame:
    """The first `most` of all signals in their fixed order with a stable fingerprint `signal:anchor`: position, signal,
    fingerprint. The anchor of an error's fix is the tool, and what is saved again under one fingerprint counts once."""
    row = lambda df, n, signal, anchor: df.select(F.lit(n).alias("position"), F.lit(signal).alias("signal"), F.concat(F.lit(f"{signal}:"), anchor.cast("string")).alias("fingerprint"))
    parts = [
        row(uncharted_edits(log, records, steps), 1, "uncharted_edit", F.col("event_id")),
        row(search_misses(log, records), 2, "search_miss", F.col("event_id")),
        row(recurring_use(usage), 3, "recurring_use", F.col("entity_id")),
        row(hot_files(log, records), 4, "hot_file", F.col("path")),
        row(error_fixes(log), 5, "error_fix", F.col("tool")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("position", "fingerprint").limit(most)


def fresh(candidates: DataFrame, shown: DataFrame, as_of_us: int, hours: int = 24) -> DataFrame:
    """Candidates whose fingerprint was not shown within `hours` before `as_of_us`. shown: (fingerprint, us)."""
    recent = shown.where(F.col("us") > as_of_us - hours * 3_600_000_000).select("fingerprint").distinct()
    return candidates.join(recent, "fingerprint", "left_anti")


def outcomes(steps: DataFrame) -> DataFrame:
    """Outcome of every delivered entity: steps (key, at, step, delivery_id, entity_id, tier) with step deliver, touch, pull
    or boundary, ordered by `at`, which is unique within a key.

    A delivery is open until the key's next boundary. Within it a touch makes the entity's row a hit, a pull does so for
    pointer rows; at the boundary what is pending is a miss; without a boundary it stays pending.
    """
    numbered = running_sum(steps, "key", "at", (F.col("step") == "boundary").cast("int"), "stretch")
    closed = numbered.groupBy("key").agg(F.max("stretch").alias("last"))
    given = numbered.where("step = 'deliver'").select("key", "stretch", "delivery_id", "entity_id", "tier", F.col("at").alias("given_at"))
    given = given.groupBy("key", "stretch", "delivery_id", "entity_id").agg(F.min(F.struct("given_at", "tier")).alias("g")).select("key", "stretch", "delivery_id", "entity_id", "g.given_at", "g.tier")
    used = numbered.where("step in ('touch', 'pull')").groupBy("key", "stretch", "entity_id", "step").agg(F.max("at").alias("used_at"))
    hits = given.join(used, ["key", "stretch", "entity_id"]).where("used_at > given_at and (step = 'touch' or tier = 'pointer')").select("key", "delivery_id", "entity_id", F.lit(True).alias("hit")).distinct()
    rows = given.join(hits, ["key", "delivery_id", "entity_id"], "left").join(closed, "key")
    outcome = F.when(F.col("hit"), "hit").when(F.col("stretch") < F.col("last"), "miss").otherwise("pending")
    return rows.select("key", "delivery_id", "entity_id", "tier", outcome.alias("outcome"))


def never_delivered(ids: DataFrame, usage: DataFrame, deliveries: DataFrame | None = None, since=None) -> DataFrame:
    """Ids (entity_id) that no delivery [since a time] held."""
    seen = usage
    if since is not None:
        seen = seen.join(deliveries.where(F.col("created_at") >= since), "delivery_id", "left_semi")
    return ids.join(seen.select("entity_id").distinct(), "entity_id", "left_anti")


def nth_last(log: DataFrame, kind: str, n: int) -> DataFrame:
    """The n-th last event of a kind, by id: (id, us); no row if there are fewer."""
    top = log.where(F.col("kind") == kind).orderBy(F.desc("id")).limit(n)
    return top.select("id", "us", F.row_number().over(Window.orderBy(F.desc("id"))).alias("n")).where(F.col("n") == n).drop("n")


def surplus_tombstones(records: DataFrame, keep: int = 1000) -> DataFrame:
    """Pruned records beyond the `keep` newest (ties: larger ids stay): (id). The newest are found as a top list."""
    gone = records.where("status = 'pruned'").select("id", F.coalesce("updated_us", F.lit(-(2**62))).alias("us"))
    newest = gone.orderBy(F.desc("us"), F.desc("id")).limit(keep)
    return gone.join(newest.select("id"), "id", "left_anti").select("id")


def expired(log: DataFrame, as_of_us: int, days: int = 30) -> DataFrame:
    """Events older than the retention."""
    return log.where(F.col("us") < as_of_us - days * 86_400_000_000)
