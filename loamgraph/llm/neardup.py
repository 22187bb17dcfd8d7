"""Near-duplicate records: ProbMinHash signatures, banding, verification.

A signature component of two weighted sets is equal with a probability of their probability Jaccard similarity; with unit
weights this is the Jaccard similarity. Every element has a Poisson process of arrivals, each of which falls on one
component; an element is given up once its next arrival comes later than the latest of the record's components, so that
a record costs about m ln m arrivals, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import record_text, words
from loamgraph.operators.components import components
from loamgraph.operators.records import latest_records
from loamgraph.session import durable

SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 1
BANDS, ROWS = 56, 4  # a pair of similarity 0.6 is missed with a probability of 4e-4, one of 0.8 with 1e-13
#: Buckets up to this size are paired where they are read; larger ones are cut into blocks of about this size, which are joined.
BUCKET = 256


def windows(word: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 64-bit hash) of the distinct runs of `size` words of each owner, sorted. `owner` ascends; words are hashes."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ word[k : k + n].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    whole = owner[size - 1 :] == owner[:n]
    owner, h = owner[:n][whole], h[whole].view(np.int64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[fresh], h[fresh]


def _shingling(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b["w"].value_lengths().to_numpy(zero_copy_only=False)
            word = b["w"].flatten().to_numpy(zero_copy_only=False)
            owner, h = windows(word, np.repeat(np.arange(len(b)), lengths), size)
            row, start = np.unique(owner, return_index=True)
            ends = np.append(start, len(h))
            cid = [blake2b(h[lo:hi].tobytes(), digest_size=16).digest() for lo, hi in zip(ends[:-1], ends[1:])]
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h))
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(row)).cast(pa.string()), pa.array(cid, pa.binary()), sets], ["id", "cid", "shingles"])

    return run


def shingled(texts: DataFrame, size: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, cid, shingles) of every text (id, text) of at least `least_words` words and one run of `size` words.

    `shingles` are the sorted distinct 64-bit hashes of all runs, `cid` is a hash of 128 bits that names the set.
    """
    listed = texts.select(F.col("id").cast("string").alias("id"), words(F.col("text")).alias("w")).where(F.size("w") >= F.lit(max(least_words, size)))
    hashed = listed.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    return hashed.mapInArrow(_shingling(size), "id string, cid binary, shingles array<bigint>")


def shingled_entities(entities: DataFrame, size: int, least_words: int) -> DataFrame:
    """(id, cid, shingles) of every record of at least `least_words` words."""
    newest = latest_records(entities, ["title", "content"])
    return shingled(newest.select("id", record_text(F.col("title"), F.col("content")).alias("text")), size, least_words)


def _uniform(element: np.ndarray, step: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent random words of an element's arrival number `step` (mixing constants are fixed values)."""
    x = element.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * step + stream + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, x


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, records: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (records, m) of weighted sets: rows `owner`, 64-bit `element`, positive `weight`.

    A component holds the element whose arrival reached it first; a record without elements holds zeros.
    """
    best = np.full(records * m, np.inf)
    holder = np.zeros(records * m, np.int64)
    at = np.zeros(len(element))
    latest = np.full(records, np.inf)
    step = 0
    while len(element):
        uniform, _ = _uniform(element, step, 0)
        _, word = _uniform(element, step, 1)
        at = at - np.log1p(-uniform) / weight
        alive = at < latest[owner]
        owner, element, weight, at, word = owner[alive], element[alive], weight[alive], at[alive], word[alive]
        if not len(element):
            break
        cell = owner * m + (word % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, cell, at)
        won = best[cell] == at
        holder[cell[won]] = element[won]
        if step % 4 == 3:
            latest = best.reshape(records, m).max(axis=1)
        step += 1
    return holder.reshape(records, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per record and band; the band's number enters it."""
    part = signature.reshape(len(signature), bands, rows).view(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), part.shape[:2]).copy()
    for r in range(rows):
        key = (key ^ part[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _banding(bands: int, rows: int):
    """(key, cid) per band of every set; sets that a batch holds twice are hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                b = b.take(pa.array(np.unique(np.array(b["cid"].to_pylist(), object), return_index=True)[1]))
                lengths = b["shingles"].value_lengths().to_numpy(zero_copy_only=False)
                element = b["shingles"].flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(b)), lengths)
                keys = band_keys(signatures(owner, element, np.ones(len(element)), len(b), bands * rows), bands, rows)
                short = np.array([int.from_bytes(c[:8], "big", signed=True) for c in b["cid"].to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(short, bands))], ["key", "short"])

    return run


def _meetings(bucket: int):
    """Pairs of the rows (key, short) of sorted buckets, as (a, b, key), a < b, key null. The rows of a bucket of more than
    `bucket` come out as they are, (short, null, key), once each. A bucket is held up to that size only."""

    def pairs(key: np.ndarray, short: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets of up to `bucket` distinct rows each."""
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        found = []
        for step in range(1, int(size.max(initial=1))):  # rows `step` apart in a bucket
            i = np.flatnonzero(key[step:] == key[:-step])
            found.append(np.stack([short[i], short[i + step]], 1))
        if found:
            pair = np.unique(np.concatenate(found), axis=0)
            left, right = (np.ascontiguousarray(pair[:, c]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.nulls(len(pair), pa.int64())], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = np.empty((0, 2), np.int64), None  # the rows of the last bucket so far; a bucket known to be too large
        for b in batches:
            rows = np.concatenate([held, np.stack([b["key"].to_numpy(), b["short"].to_numpy()], 1)])
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows
            if not len(rows):
                continue
            key = rows[:, 0]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            large = size > bucket
            if hot is not None and key[0] == hot:
                large[0] = True
            of = np.repeat(large, size)
            last = np.zeros(len(key), bool)
            last[start[-1] :] = not large[-1]
            out = rows[of]
            if len(held) and hot is not None and key[0] == hot:
                out = out[1:]  # the row that was kept to skip its repeats
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 1])), pa.nulls(len(out), pa.int64()), pa.array(np.ascontiguousarray(out[:, 0]))], ["a", "b", "key"])
            small = rows[~of & ~last]
            if len(small):
                yield from pairs(small[:, 0], small[:, 1])
            hot = key[-1] if large[-1] else None
            held = rows[-1:] if large[-1] else rows[last]
        if hot is None and len(held):
            yield from pairs(held[:, 0], held[:, 1])

    return run


def _pairs_in_blocks(rows: DataFrame, key: str, item: str, bucket: int) -> DataFrame:
    """(a, b), a < b, of all pairs of items of one key, in blocks of about `bucket` items: each pair of blocks is one join key."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / bucket)
    own = rows.join(sizes, key).select(F.col(item).alias("item"), F.col(key).alias("key"), blocks.alias("blocks"), F.pmod(F.xxhash64(item), blocks).alias("own"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    spread = spread.select("item", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    on = ["key", "low", "high"]
    a, b = spread.select(*on, F.col("item").alias("a"), F.col("own").alias("p")), spread.select(*on, F.col("item").alias("b"), F.col("own").alias("q"))
    return a.join(b, on).where("a < b and (low = high or p <> q)").select("a", "b")


def similar_classes(sets: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity) of different classes, a < b, whose sets have a Jaccard similarity of `similarity` or more.

    sets: (cid, shingles), equal sets repeated or not. Band rows and candidates name a class by 64 bits of its name; should
    two classes share them, both are compared.
    """
    keyed = sets.mapInArrow(_banding(bands, rows), "key bigint, short bigint")
    met = durable(keyed.repartition("key").sortWithinPartitions("key", "short").mapInArrow(_meetings(BUCKET), "a bigint, b bigint, key bigint"))
    pairs = met.where("b is not null").select("a", "b").unionByName(_pairs_in_blocks(met.where("b is null"), "key", "a", BUCKET)).distinct()
    pairs = durable(pairs)
    short = F.conv(F.hex(F.substring("cid", 1, 8)), 16, -10).cast("bigint")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("short")).distinct()
    named = sets.withColumn("short", short).join(asked, "short", "left_semi")
    classes = named.groupBy("cid", "short").agg(F.first("shingles").alias("shingles"))
    left, right = classes.select(F.col("cid").alias("p"), F.col("short").alias("a"), F.col("shingles").alias("x")), classes.select(F.col("cid").alias("q"), F.col("short").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    least, most = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    common = F.size(F.array_intersect("x", "y"))
    jaccard = common / (F.size("x") + F.size("y") - common)
    close = both.where(least >= F.lit(similarity - 1e-9) * most).select("p", "q", jaccard.alias("similarity")).where(F.col("similarity") >= similarity)
    return close.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def similar_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of all records whose sets reach the similarity, equal sets included."""
    sets = durable(sets)
    members = sets.select("id", "cid")
    links = durable(similar_classes(sets, similarity))
    a, b = members.select(F.col("id").alias("p"), F.col("cid").alias("a")), members.select(F.col("id").alias("q"), F.col("cid").alias("b"))
    between = links.join(a, "a").join(b, "b").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "similarity")
    equal = _pairs_in_blocks(members, "cid", "id", BUCKET).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(equal)


def groups(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per record with a set: id, class_id (smallest id of the records with an equal set), group_id (smallest id of the
    linked classes' component), n_links (classes linked to the record's class), n_copies (records of its class). Records
    whose text has too few words have no set and no row."""
    sets = durable(sets)
    members = sets.select("id", "cid")
    links = durable(similar_classes(sets, similarity).select("a", "b"))
    named = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("cid"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("cid").agg(F.count("*").alias("n_copies"), F.min("id").alias("class_id"))
    facts = durable(copies.join(named, "cid", "left").join(degree, "cid", "left"))
    heads = facts.where("component is not null").groupBy("component").agg(F.min("class_id").alias("head"))
    facts = facts.join(heads, "component", "left")
    return members.join(facts, "cid").select("id", "class_id", F.coalesce("head", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies")
