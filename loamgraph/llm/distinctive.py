"""How characteristic a term is of a record: graph-of-words weights.

Each record's terms form a graph whose edges join terms at most `window - 1` positions apart. A term's weight is its number
of distinct neighbours (not its frequency) times its rarity in the collection, ln(records / records with the term).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import record_text
from loamgraph.operators.records import latest_records
from loamgraph.session import durable

WINDOW = 4
#: A term is frequent beyond this share of the records (and this many records). There are at most 1 / FREQUENT times the
#: mean number of distinct terms per record of them, so they are broadcast; the others are joined by shuffle, unskewed.
FREQUENT, FREQUENT_LEAST = 0.01, 1000
ARROW = pa.schema([("entity_id", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("degree", pa.int64())])


def terms(text: Column) -> Column:
    """Terms in order: longest runs of ASCII letters, split between a lower-case and an upper-case letter, lower-cased, of
    four letters or more. Null and empty texts have none."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[a-z])(?=[A-Z])", " ")
    return F.transform(F.regexp_extract_all(apart, F.lit("([A-Za-z]{4,})"), F.lit(1)), F.lower)


def record_terms(entities: DataFrame) -> DataFrame:
    """(entity_id, terms) of every record."""
    newest = latest_records(entities, ["title", "content"])
    return newest.select(F.col("id").alias("entity_id"), terms(record_text(F.col("title"), F.col("content"))).alias("terms"))


def word_graph(record: np.ndarray, term: np.ndarray, width: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records, terms, frequencies and degrees of the distinct (record, term) cells of term sequences in order.

    `record` ascends; `term` holds codes below `width`.
    """
    place = record * width + term
    cell, of, tf = np.unique(place, return_inverse=True, return_counts=True)
    edges = []
    for step in range(1, window):
        near = np.flatnonzero((record[:-step] == record[step:]) & (term[:-step] != term[step:]))
        x, y = of[near], of[near + step]  # cells, which ascend with record and term
        edges.append(np.minimum(x, y) * len(cell) + np.maximum(x, y))
    pairs = np.unique(np.concatenate(edges)) if edges else np.empty(0, np.int64)  # an edge counts once, for both of its ends
    degree = np.bincount(pairs // max(len(cell), 1), minlength=len(cell)) + np.bincount(pairs % max(len(cell), 1), minlength=len(cell))
    return cell // width, cell % width, tf, degree


def _graphs(window: int, min_tf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["terms"]
            lengths = lists.value_lengths().fill_null(0).to_numpy()
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            width = len(coded.dictionary)
            owner, code = np.repeat(np.arange(len(lengths)), lengths), coded.indices.to_numpy().astype(np.int64)
            record, term, tf, degree = word_graph(owner, code, width, window)
            keep = tf >= min_tf
            yield pa.RecordBatch.from_arrays(
                [b["entity_id"].take(pa.array(record[keep])).cast(pa.string()), coded.dictionary.take(pa.array(term[keep])).cast(pa.string()), pa.array(tf[keep]), pa.array(degree[keep])], schema=ARROW
            )

    return run


def term_scores(records: DataFrame, window: int = WINDOW, min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """(entity_id, term, tf, degree, df, score) of every term of every record of (entity_id, terms).

    score = degree * ln(N / df); a term that all records share, or that has no neighbour, scores 0. Ids must be unique.
    Records without terms give no rows. Every record's graph is built. `min_tf`, `min_df` and `max_df`
    (None: no bound) leave out rows of the result, they change neither counts nor degrees.
    """
    records = durable(records)
    n = records.count()
    counts = records.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    wanted = counts.where(F.col("df") >= min_df)
    if max_df is not None:
        wanted = wanted.where(F.col("df") <= max_df)
    bound = max(FREQUENT_LEAST, int(n * FREQUENT))
    rows = records.where(F.size("terms") > 0).mapInArrow(_graphs(window, min_tf), "entity_id string, term string, tf bigint, degree bigint")
    common = F.broadcast(counts.where(F.col("df") > bound))
    if max_df is not None and max_df <= bound:
        scored = rows.join(common, "term", "left_anti").join(wanted, "term")
    else:
        tagged = rows.join(common, "term", "left")
        rare = tagged.where("df is null").drop("df").join(wanted.where(F.col("df") <= bound), "term")
        often = tagged.where(F.col("df") >= min_df)
        scored = rare.unionByName(often if max_df is None else often.where(F.col("df") <= max_df))
    return scored.select("entity_id", "term", "tf", "degree", "df", (F.col("degree") * F.log(F.lit(float(max(n, 1))) / F.col("df"))).alias("score"))
