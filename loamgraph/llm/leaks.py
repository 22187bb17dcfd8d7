"""Evaluation texts inside training texts.

The n-grams of all evaluation items form a hash set that is broadcast; its size is checked first. The token windows of
every document are looked up in it, and hits are verified word by word. Beyond the bound the windows of both sides are hashed
to 128 bits by the same tokeniser and joined by shuffle, salted by document; the hits are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.functions.text import words
from loamgraph.session import durable

SPAN = 12
#: Words of all evaluation items together up to which their n-grams are broadcast (about 100 bytes a word).
BROADCAST_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Parts over which the documents' windows of one n-gram are spread where they are joined by shuffle.
SALTS = 32
KEYS = ("loamgraph-window", "window-loamgraph")  # two independent hashes of a word; 16 bytes each
HITS = "doc_id bigint, item_id bigint, first_word int"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (finaliser constants are fixed values)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(codes: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all windows of `span` codes."""
    coded, n = _mix(codes), len(codes) - span + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(span):
        out = out * FACTOR + coded[k : k + n] if n > 0 else out
    return out


class GramSet:
    """All windows of the evaluation items: sorted hashes, where each occurs, and the items' words as codes."""

    def __init__(self, items: list[tuple[int, list[str]]], span: int = SPAN):
        self.span = span
        self.vocabulary = pd.Index(pd.unique(np.array([w for _, ws in items for w in ws] or [""], object)))
        codes, item, at, start = [], [], [], 0
        hashes = []
        for i, ws in items:
            own = self.vocabulary.get_indexer(np.array(ws, object)) if ws else np.empty(0, np.int64)
            codes.append(own)
            h = _grams(own, span)
            hashes.append(h)
            item.append(np.full(len(h), i, np.int64))
            at.append(np.arange(len(h)) + start)
            start += len(own)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        self.codes, hashes, item, at = join(codes, np.int64), join(hashes, np.uint64), join(item, np.int64), join(at, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]

    def scan(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item, first word) of every window of the texts that is a window of an item."""
        lengths = np.array([len(x) for x in lists], np.int64)
        flat = np.array([w for x in lists for w in x], object)
        none = np.empty(0, np.int64)
        if len(flat) < self.span or not len(self.hashes):
            return none, none, none
        codes = self.vocabulary.get_indexer(flat)
        owner = np.repeat(np.arange(len(lists)), lengths)
        n = len(codes) - self.span + 1
        known = np.concatenate([[0], np.cumsum(codes >= 0)])
        whole = (known[self.span :] - known[: n] == self.span) & (owner[self.span - 1 :] == owner[:n])
        start = np.flatnonzero(whole)
        if not len(start):
            return none, none, none
        window = start[:, None] + np.arange(self.span)
        coded = _mix(codes[window].ravel()).reshape(window.shape)
        h = np.zeros(len(start), np.uint64)
        for k in range(self.span):
            h = h * FACTOR + coded[:, k]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = high - low
        hit = np.repeat(np.arange(len(start)), count)
        place = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        same = np.ones(len(hit), bool)
        for k in range(self.span):  # verification: the same words, not only the same hash
            same &= codes[start[hit] + k] == self.codes[self.at[place] + k]
        hit, place = hit[same], place[same]
        first = np.concatenate([[0], np.cumsum(lengths)])
        return owner[start[hit]], self.item[place], start[hit] - first[owner[start[hit]]]


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def passages(documents: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct (doc_id, item_id, first_word): every window of `span` words of a document that an item has too.

    Null, blank and shorter texts have no windows; items shorter than `span` words cannot leak. Long texts are scanned
    whole. Repeated rows count once.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    if items.agg(F.coalesce(F.sum(F.size(words(F.col("text")))), F.lit(0))).first()[0] > BROADCAST_WORDS:
        return _passages_by_shuffle(documents, items, span)
    grams = documents.sparkSession.sparkContext.broadcast(GramSet([(r.item_id, _words(r.text)) for r in items.collect()], span))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                text, item, first = grams.value.scan([_words(t) for t in part["text"]])
                if len(text):
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[text], "item_id": item, "first_word": first.astype(np.int32)})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, HITS).distinct()


def _windows(texts: DataFrame, span: int) -> DataFrame:
    """(id, first_word, g, h) of every window of texts (id, text): two hashes of 64 bits each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                lists = [_words(t) for t in part["text"]]
                lengths = np.array([len(x) for x in lists], np.int64)
                if lengths.sum() < span:
                    continue
                code, known = pd.factorize(np.array([w for x in lists for w in x], object))
                owner = np.repeat(np.arange(len(lists)), lengths)
                n = len(code) - span + 1
                start = np.flatnonzero(owner[span - 1 :] == owner[:n])
                both = [_grams(pd.util.hash_array(known, hash_key=k)[code], span)[start].view(np.int64) for k in KEYS]
                first = start - (np.cumsum(lengths) - lengths)[owner[start]]
                yield pd.DataFrame({"id": part["id"].to_numpy()[owner[start]], "first_word": first.astype(np.int32), "g": both[0], "h": both[1]})

    return texts.mapInPandas(run, "id bigint, first_word int, g bigint, h bigint")


def _passages_by_shuffle(documents: DataFrame, items: DataFrame, span: int) -> DataFrame:
    docs = _windows(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text"), span).select(F.col("id").alias("doc_id"), "first_word", "g", "h")
    grams = _windows(items.select(F.col("item_id").alias("id"), "text"), span).select(F.col("id").alias("item_id"), "g", "h").distinct()
    grams = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return docs.join(grams, ["g", "h", "salt"]).select("doc_id", "item_id", "first_word").distinct()


def leaked_pairs(hits: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id)."""
    return hits.select("doc_id", "item_id").distinct()


def _cut(text: str, firsts: list[int], span: int) -> str:
    """The text without the words of its hits and what lies between them."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer: map positions back
        back = [i for i, c in enumerate(text) for _ in c.lower()]
    else:
        back = range(len(text))
    at = [m.span() for m in WORD.finditer(lowered)]
    drop = sorted((back[at[f][0]], back[at[f + span - 1][1] - 1] + 1) for f in firsts)
    out, end = [], 0
    for a, b in drop:
        out.append(text[end:a] if a > end else "")
        end = max(end, b)
    return "".join([*out, text[end:]])


def without_leaks(documents: DataFrame, hits: DataFrame, mode: str = "spans", span: int = SPAN) -> DataFrame:
    """(doc_id, text, removed_chars): documents without leaked spans, or without leaked documents (`mode` "documents").

    Only documents with hits are cleaned, the others pass as they are.
    """
    if mode == "documents":
        kept = documents.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
        return kept.select("doc_id", "text", F.lit(0).cast("bigint").alias("removed_chars"))
    if mode != "spans":
        raise ValueError(f"mode is spans or documents, not {mode}")
    firsts = durable(hits.groupBy("doc_id").agg(F.collect_set("first_word").alias("firsts")))

    @F.pandas_udf(T.StringType())
    def clean(text: pd.Series, firsts: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, list(f), span) for t, f in zip(text, firsts)], dtype=object)

    rows = documents.select("doc_id", "text")
    cleaned = rows.join(firsts, "doc_id").withColumn("clean", clean("text", "firsts"))
    cleaned = cleaned.select("doc_id", F.col("clean").alias("text"), (F.length("text") - F.length("clean")).cast("bigint").alias("removed_chars"))
    return cleaned.unionByName(rows.join(firsts, "doc_id", "left_anti").select("doc_id", "text", F.lit(0).cast("bigint").alias("removed_chars")))
