"""The k most similar vectors of every vector: multi-probe p-stable hashing in two levels.

A vector is hashed into L tables by functions floor((a.x + b) / w). The first functions of a table, the coarse ones, name its
bucket: in every table a vector is stored in its own bucket and asks, besides it, those that are reached by the most promising
perturbations of its hash values (those that cross the nearest borders; the order of the sets is estimated as by Lv et al.).
The other functions, the fine ones, cut a bucket into cells where it is read: a vector asks its own cell and those that its
most promising fine perturbations reach. So the rows that are shuffled per vector stay few while the share of all pairs that
is compared falls as the number of vectors grows (see `settings`). Within a cell sign sketches of SKETCH_BITS bits sort out
what is too far; what is left is compared exactly. Copies of a vector are one class, which is hashed once; buckets beyond
BUCKET_ROWS stored rows are split, and what asks them asks every part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import durable

SKETCH_BITS, SKETCH_SIGMAS = 896, 4.0
SHARED, COARSE, WIDTH, CELL_ROWS = 0.387, 4, 1.5, 2048
FIRST_WORDS = 4  # 64-bit words of a sketch that are compared first
BUCKET_ROWS = 1_000_000
BLOCK = 512
#: Probes of asking rows that are looked up at once; pairs of a cell from which they are compared block by block.
CHUNK, DENSE = 1 << 20, 4096
#: Candidate pairs up to which they are broadcast to the vectors (about 10 MB); beyond, the vectors are shuffled.
BROADCAST_PAIRS = 200_000
SEED = 20_240_229


class Settings(NamedTuple):
    """Functions and probes: `coarse` functions of width `w` name a bucket in each of `tables` tables, `fine` ones a cell in it."""

    coarse: int
    w: float
    tables: int
    coarse_probes: int
    fine: int
    fine_probes: int


def settings(n: int) -> Settings:
    """Settings for n vectors.

    Two unrelated unit vectors share a hash value of width 1.5 with a probability of SHARED, so a function divides a cell's
    mean size by 2.6. The functions are as many as bring a cell to CELL_ROWS; of them the coarse ones (4 at least) as many as
    keep a bucket below BUCKET_ROWS. F fine functions get about 2 ** (0.75 F) probes and many of them another table: that
    holds the recall (README: figures per setting), while the share of all pairs that is compared falls as
    n ** -0.45: 0.32 without fine functions, about 0.06 with 4, 0.012 with 8 and 0.003 with 12.
    """
    functions = lambda rows: max(0, math.ceil(math.log(max(n, 1) / rows) / -math.log(SHARED)))
    coarse = max(COARSE, functions(BUCKET_ROWS))
    return of_functions(coarse, max(0, functions(CELL_ROWS) - coarse))


def of_functions(coarse: int, fine: int) -> Settings:
    """The settings of so many functions."""
    return Settings(coarse, WIDTH, 4 + (fine > 8) + (coarse > 6), 2 ** (coarse // 2) - 1, fine, round(2 ** (0.75 * fine)) - 1)


@lru_cache(8)
def _functions(dims: int, count: int, w: float, level: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, level))
    return rng.standard_normal((dims, count)).astype(np.float32), rng.uniform(0, w, count).astype(np.float32)


@lru_cache(2)
def _hyperplanes(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((dims, SKETCH_BITS)).astype(np.float32)


@lru_cache(16)
def probe_sets(k: int, probes: int) -> list[tuple[int, ...]]:
    """The first `probes` perturbation sets in the order of their expected scores. Position j stands for the j-th nearest of
    the 2k borders; a set may not hold both borders of one function, which lie at positions j and 2k - 1 - j."""
    m = 2 * k
    near = [(j * (j + 1)) / (4.0 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    score = near + [1 - (m + 1 - j) / (k + 1) + (m + 1 - j) * (m + 2 - j) / (4.0 * (k + 1) * (k + 2)) for j in range(k + 1, m + 1)]
    heap, out = [(score[0], (0,))], []
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if all(m - 1 - j not in chosen for j in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*chosen, last + 1)))
    return out


@lru_cache(16)
def _borders(k: int, probes: int) -> np.ndarray:
    """(2k, 1 + probes): whether a perturbation set holds the border of a position; the first set is empty."""
    sets = [(), *(probe_sets(k, probes) if k and probes else [])]
    out = np.zeros((2 * k, len(sets)), np.int8)
    for i, chosen in enumerate(sets):
        out[list(chosen), i] = 1
    return out


def probe_keys(own: np.ndarray, x: np.ndarray, probes: int, table: int = 0) -> np.ndarray:
    """Keys (vector, 1 + probes) of hash values `own` and their places `x` between the borders: the own one first."""
    n, k = own.shape
    borders = _borders(k, probes)
    position = np.argsort(np.argsort(np.concatenate([x, 1 - x], axis=1), axis=1), axis=1)
    key = np.full((n, borders.shape[1]), (0x9E3779B97F4A7C15 * (table + 1)) & (2**64 - 1), np.uint64)
    for f in range(k):
        code = own[:, f, None] + borders[position[:, k + f]] - borders[position[:, f]]
        key = (key ^ code.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def buckets(unit: np.ndarray, how: Settings) -> np.ndarray:
    """Keys (vector, table, 1 + probes) of the buckets: the own one first, then the perturbed ones."""
    a, b = _functions(unit.shape[1], how.coarse * how.tables, how.w, 0)
    f = ((unit @ a + b) / how.w).reshape(len(unit), how.tables, how.coarse)
    own = np.floor(f)
    return np.stack([probe_keys(own[:, t].astype(np.int64), (f - own)[:, t], how.coarse_probes, t) for t in range(how.tables)], 1)


def fine_values(unit: np.ndarray, how: Settings) -> np.ndarray:
    """Fine hash values and places between the borders, a byte each: (vector, table, 2 * fine)."""
    a, b = _functions(unit.shape[1], how.fine * how.tables, how.w, 1)
    f = ((unit @ a + b) / how.w).reshape(len(unit), how.tables, how.fine)
    own = np.floor(f)
    return np.concatenate([own.astype(np.int8).view(np.uint8), ((f - own) * 256).astype(np.uint8)], 2)


def _vectors(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, unit vectors, class ids and vectors as stored of what is a vector: `dims` finite numbers, not all zero."""
    lists = b["embedding"]
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.flatnonzero(lengths == dims)
    if not len(row):
        return row, np.empty((0, dims), np.float32), np.empty(0, np.int64), np.empty((0, dims), np.float32)
    x = lists.take(pa.array(row)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    good = np.isfinite(norm) & (norm > 0)
    row, x = row[good], x[good]
    unit = (x / norm[good, None]).astype(np.float32) + np.float32(0)
    canonical = np.ascontiguousarray(np.round(unit, 6) + np.float32(0))
    ids = np.array([int.from_bytes(blake2b(v.data, digest_size=8).digest(), "little", signed=True) for v in canonical], np.int64)
    return row, unit, ids, x


def _each(embeddings: DataFrame, dims: int, make, schema: str) -> DataFrame:
    """make(entity ids, unit vectors, class ids, vectors) -> batches, per Arrow batch of `embeddings` (entity_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, *found = _vectors(b, dims)
            if len(row):
                yield from make(b["entity_id"].take(pa.array(row)), *found)

    rows = embeddings.where(F.col("entity_id").isNotNull() & (F.size("embedding") == dims)).select("entity_id", "embedding")
    return rows.mapInArrow(run, schema)


def _members(embeddings: DataFrame, dims: int) -> DataFrame:
    """(cid, entity_id), each entity once: repeated rows count once, of different vectors under one id the smallest class."""

    def make(entity, unit, ids, raw):
        yield pa.RecordBatch.from_pydict({"entity_id": entity.cast(pa.string()), "cid": ids})

    return _each(embeddings, dims, make, "entity_id string, cid bigint").groupBy("entity_id").agg(F.min("cid").alias("cid"))


def _own_buckets(embeddings: DataFrame, dims: int, how: Settings) -> DataFrame:
    own = how._replace(coarse_probes=0)

    def make(entity, unit, ids, raw):
        _, first = np.unique(ids, return_index=True)
        keys, n = np.unique(buckets(unit[first], own), return_counts=True)
        yield pa.RecordBatch.from_pydict({"bucket": keys, "n": n.astype(np.int64)})

    return _each(embeddings, dims, make, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _rows(embeddings: DataFrame, dims: int, how: Settings) -> DataFrame:
    """(bucket, asks, cid, sketch): stored rows (asks false) and probes; the fine values follow the sketch's bits."""

    def make(entity, unit, ids, raw):
        _, first = np.unique(ids, return_index=True)  # copies within a batch are hashed once
        unit, ids = unit[first], ids[first]
        keys = buckets(unit, how)
        n, tables, per = keys.shape
        bits = np.packbits(unit @ _hyperplanes(dims) > 0, axis=1)
        whole = np.concatenate([np.repeat(bits[:, None], tables, 1), fine_values(unit, how)], 2).reshape(n * tables, -1)
        kind = pa.binary(whole.shape[1])
        sketch = pa.Array.from_buffers(kind, len(whole), [None, pa.py_buffer(np.ascontiguousarray(whole))]).cast(pa.binary())
        asks = np.tile(np.arange(per) > 0, n * tables)
        owner, row = np.repeat(ids, per * tables), np.repeat(np.arange(n * tables), per)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(asks), pa.array(owner), sketch.take(pa.array(row))], ["bucket", "asks", "cid", "sketch"])

    return _each(embeddings, dims, make, "bucket bigint, asks boolean, cid bigint, sketch binary")


def _radius(min_cosine: float | None) -> int:
    if min_cosine is None:
        return SKETCH_BITS
    p = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    return int(SKETCH_BITS * p + SKETCH_SIGMAS * math.sqrt(SKETCH_BITS * p * (1 - p)))


class Sketches:
    """Sketches and fine values of rows of one bucket."""

    def __init__(self, data: np.ndarray, how: Settings):
        """data: (rows, bytes)."""
        self.bits = np.ascontiguousarray(data[:, : SKETCH_BITS // 8]).view(np.uint64)
        fine = data[:, SKETCH_BITS // 8 :]
        self.own, self.place, self.how = fine[:, : how.fine].view(np.int8).astype(np.int64), fine[:, how.fine :], how

    def cells(self, a: int, b: int, probes: int) -> np.ndarray:
        return probe_keys(self.own[a:b], (self.place[a:b] + np.float32(0.5)) / np.float32(256), probes)


def _within(x: np.ndarray, y: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of all sketches up to `limit` apart."""
    found, p, bits = [], limit / SKETCH_BITS, 64 * FIRST_WORDS
    first = min(bits, int(bits * p + SKETCH_SIGMAS * math.sqrt(bits * p * (1 - p))))
    for a in range(0, len(x), BLOCK):
        for s in range(0, len(y), 8 * BLOCK):
            u, v = x[a : a + BLOCK], y[s : s + 8 * BLOCK]
            h = np.zeros((len(u), len(v)), np.uint16)
            for word in range(FIRST_WORDS):
                h += np.bitwise_count(u[:, word, None] ^ v[None, :, word])
            i, j = np.nonzero(h <= first)
            d = h[i, j] + np.bitwise_count(u[i, FIRST_WORDS:] ^ v[j, FIRST_WORDS:]).sum(1, dtype=np.uint16)
            keep = d <= limit
            found.append((i[keep] + a, j[keep] + s, d[keep].astype(np.int64)))
    return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _one_by_one(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for pairs of rows that are named."""
    found = []
    for a in range(0, len(i), 1 << 18):
        p, q = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
        d = np.bitwise_count(x[p] ^ y[q]).sum(1, dtype=np.int64)
        keep = d <= limit
        found.append((p[keep], q[keep], d[keep]))
    return tuple(np.concatenate(part) for part in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, place) of all places of ranges."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _may_be_nearest(i: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which found rows may be among the k nearest of the row that asks: those up to its k-th smallest distance (the row itself
    may be among them) and SKETCH_SIGMAS standard deviations of a difference of two distances."""
    order = np.lexsort((d, i))
    _, start, n = np.unique(i[order], return_index=True, return_counts=True)
    kth = d[order][start + np.minimum(k, n - 1)]
    margin = SKETCH_SIGMAS * np.sqrt(2 * SKETCH_BITS * np.clip(kth / SKETCH_BITS, 1 / SKETCH_BITS, 0.5) * 0.9)
    keep = np.empty(len(i), bool)
    keep[order] = d[order] <= np.repeat(kth + margin, n)
    return keep


class Bucket:
    """The stored rows of a bucket, which rows ask for what is near them."""

    def __init__(self, ids: np.ndarray, rows: Sketches, k: int, limit: int):
        self.ids, self.rows, self.k, self.limit, self.how = ids, rows, k, limit, rows.how
        if self.how.fine:
            key = rows.cells(0, len(ids), 0)[:, 0]
            self.order = np.argsort(key, kind="stable")
            self.cell, self.start, self.size = np.unique(key[self.order], return_index=True, return_counts=True)

    def near(self, asking: Sketches, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(asking row, stored id) of the rows a to b."""
        if not self.how.fine:
            i, j, d = _within(asking.bits[a:b], self.rows.bits, self.limit)
        else:
            i, j, d = self._by_cells(asking, a, b)
        keep = _may_be_nearest(i, d, self.k) if len(i) else np.empty(0, bool)
        return i[keep] + a, self.ids[j[keep]]

    def _by_cells(self, asking: Sketches, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = asking.cells(a, b, self.how.fine_probes)
        place = np.minimum(np.searchsorted(self.cell, keys), len(self.cell) - 1)
        i, _ = hit = np.nonzero(self.cell[place] == keys)
        cell = place[hit]
        by_cell = np.argsort(cell, kind="stable")
        i, cell = i[by_cell], cell[by_cell]
        each, start, asks = np.unique(cell, return_index=True, return_counts=True)
        x, y, found = asking.bits[a:b], self.rows.bits, []
        dense = asks * self.size[each] >= DENSE
        for c, s, n in zip(each[dense], start[dense], asks[dense]):
            stored = self.order[self.start[c] : self.start[c] + self.size[c]]
            p, q, d = _within(x[i[s : s + n]], y[stored], self.limit)
            found.append((i[s : s + n][p], stored[q], d))
        few = np.repeat(~dense, asks)
        owner, at = _spread(self.start[cell[few]], self.size[cell[few]])
        found.append(_one_by_one(x, y, i[few][owner], self.order[at], self.limit))
        return tuple(np.concatenate(part) for part in zip(*found))


def _search(k: int, min_cosine: float | None, how: Settings):
    """Candidate pairs of sorted bucket rows: the stored rows of a bucket come first, then its probes in batches. Repeats of
    a class, which lie side by side, are skipped: each class takes one place among the k nearest."""
    limit = _radius(min_cosine)
    width = SKETCH_BITS // 8 + 2 * how.fine

    def data(b: pa.RecordBatch) -> np.ndarray:
        sketch = b["sketch"].cast(pa.binary(width))
        return np.frombuffer(sketch.buffers()[1], np.uint8)[sketch.offset * width : (sketch.offset + len(sketch)) * width].reshape(-1, width)

    def asked(bucket: Bucket, ids: np.ndarray, rows: Sketches) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK // (1 + how.fine_probes))
        for a in range(0, len(ids), step):
            i, v = bucket.near(rows, a, min(a + step, len(ids)))
            u = ids[i]
            differ = u != v
            if differ.any():
                pair = np.unique(np.stack([np.minimum(u, v)[differ], np.maximum(u, v)[differ]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, bucket, last = None, [], [], None, None

        def closed() -> Iterator[pa.RecordBatch]:
            """The stored rows are complete: they ask each other."""
            nonlocal bucket
            if bucket is None and ids:
                own, rows = np.concatenate(ids), Sketches(np.concatenate(parts), how)
                bucket = Bucket(own, rows, k, limit)
                yield from asked(bucket, own, rows)

        for b in batches:
            if not len(b):
                continue
            key = np.stack([b[c].cast(pa.int64()).to_numpy() for c in ("bucket", "part", "asks", "cid")], 1)
            fresh = np.concatenate([[last is None or (key[0] != last).any()], (key[1:] != key[:-1]).any(axis=1)])
            last = key[-1]
            key, rows = key[fresh], data(b.filter(pa.array(fresh)))
            cuts = np.flatnonzero((key[1:, :3] != key[:-1, :3]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts] if len(key) else [], [*cuts, len(key)]):
                if at != (key[lo, 0], key[lo, 1]):
                    yield from closed()
                    at, ids, parts, bucket = (key[lo, 0], key[lo, 1]), [], [], None
                if not key[lo, 2]:
                    ids.append(key[lo:hi, 3])
                    parts.append(rows[lo:hi])
                elif ids:
                    yield from closed()
                    yield from asked(bucket, key[lo:hi, 3], Sketches(rows[lo:hi], how))
        yield from closed()

    return run


def candidates(embeddings: DataFrame, k: int, min_cosine: float | None, dims: int, how: Settings | None = None) -> DataFrame:
    """Distinct candidate pairs (u, v) of class ids, u < v."""
    how = how or settings(embeddings.count())
    rows = _rows(embeddings, dims, how)
    large = _own_buckets(embeddings, dims, how).where(F.col("n") > BUCKET_ROWS)
    large = durable(large.select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts")))
    tagged = rows.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod("cid", F.col("parts")).cast("int")))
    split = tagged.select("bucket", F.explode(part).alias("part"), "asks", "cid", "sketch")
    # Stored rows of other parts of a split bucket are asked by its stored rows too.
    more = tagged.where("not asks and parts > 1").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "cid", "sketch", "parts")
    more = more.where(F.col("part") != F.pmod("cid", F.col("parts"))).drop("parts")
    placed = split.unionByName(more) if large.count() else split
    sorted_rows = placed.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "asks", "cid")
    return sorted_rows.mapInArrow(_search(k, min_cosine, how), "u bigint, v bigint").distinct()


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of float32 as bytes without loss: in half precision where that holds them exactly."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(axis=1)
    return [half[i].tobytes() if e else x[i].tobytes() for i, e in enumerate(exact)]


def unpack(packed: pa.Array, dims: int) -> np.ndarray:
    """The rows that `pack` packed, as a matrix of float32."""
    lengths = np.array(packed.to_pandas().map(len), np.int64) if len(packed) else np.empty(0, np.int64)
    out = np.empty((len(packed), dims), np.float32)
    for kind in (np.float16, np.float32):
        row = np.flatnonzero(lengths == np.dtype(kind).itemsize * dims)
        out[row] = np.frombuffer(b"".join(packed.take(pa.array(row)).to_pylist()), kind).reshape(-1, dims)
    return out


def _cosines(pairs: DataFrame, embeddings: DataFrame, dims: int) -> DataFrame:
    """(u, v, cosine) of pairs of classes, from their vectors, in double precision."""

    def make(entity, unit, ids, raw):
        _, first = np.unique(ids, return_index=True)
        yield pa.RecordBatch.from_pydict({"cid": ids[first], "vector": pa.array(pack(raw[first]), pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by pair, the first side first; a side may come repeatedly."""
        left = None  # the last row of the batch before
        for b in batches:
            for at in range(0, len(b), 2 * BLOCK):
                part = b.slice(at, 2 * BLOCK)
                table = pa.Table.from_batches([part] if left is None else [left, part]).combine_chunks()
                if not len(table):
                    continue
                key = np.stack([table[c].to_numpy() for c in ("u", "v", "cid")], 1)
                whole = table.to_batches()[0]
                left = whole.slice(len(whole) - 1)
                meets = (key[1:, :2] == key[:-1, :2]).all(axis=1) & (key[:-1, 2] == key[:-1, 0]) & (key[1:, 2] == key[1:, 1])
                second = np.flatnonzero(meets) + 1
                if len(second):
                    x, y = (unpack(whole["vector"].take(pa.array(i)), dims).astype(np.float64) for i in (second - 1, second))
                    dot, a, c = (np.einsum("ij,ij->i", p, q) for p, q in ((x, y), (x, x), (y, y)))
                    yield pa.RecordBatch.from_arrays([pa.array(key[second, 0]), pa.array(key[second, 1]), pa.array(dot / np.sqrt(a * c))], ["u", "v", "cosine"])

    vectors = _each(embeddings, dims, make, "cid bigint, vector binary")
    pairs = durable(pairs)
    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("cid"))
    sides = vectors.join(F.broadcast(ends) if pairs.count() <= BROADCAST_PAIRS else ends, "cid").select("u", "v", "cid", "vector")
    sorted_rows = sides.repartition("u", "v").sortWithinPartitions("u", "v", F.col("cid") != F.col("u"))
    return sorted_rows.mapInArrow(compare, "u bigint, v bigint, cosine double")


def _first_ids(members: DataFrame, n: int) -> DataFrame:
    """The n smallest ids of each class: first within salts, so that a class of a third of all rows is no single task."""
    salt = F.pmod(F.xxhash64("entity_id"), F.lit(64))
    first = lambda df, *keys: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("entity_id"))).where(F.col("n") <= n).drop("n")
    return first(first(members.withColumn("salt", salt), "cid", "salt"), "cid").select("cid", "entity_id")


def most_similar(embeddings: DataFrame, k: int = 5, min_cosine: float | None = 0.8, dims: int = 768, how: Settings | None = None) -> DataFrame:
    """(entity_id, neighbour_id, cosine, rank) of the k most similar vectors of every vector of (entity_id, embedding).

    Arrays that are not `dims` finite numbers, or all zero, are no vectors; rows without an id are left out; repeated rows
    count once. Ties are broken by id. `min_cosine` restricts the neighbours (None: no bound). Vectors that differ only in
    length, or beyond the sixth decimal of their unit vectors, are one class and have cosine 1. An empty table gives an
    empty result. The loss (neighbours not found) is measured against brute force in the tests: recall is 0.95 or more for
    cosines of 0.8 or more, at every number of functions. `how` (None: by the number of rows) sets functions and probes.
    """
    members = _members(embeddings, dims)
    close = _cosines(candidates(embeddings, k, min_cosine, dims, how), embeddings, dims)
    if min_cosine is not None:
        close = close.where(F.col("cosine") >= min_cosine)
    heads = _first_ids(members, k + 1)
    close = durable(close)  # the pairs that stay: at most a few per vector
    sides = F.explode(F.array(F.struct(F.col("u").alias("cid"), F.col("v").alias("other")), F.struct(F.col("v").alias("cid"), F.col("u").alias("other"))))
    both = close.select("cosine", sides.alias("s")).select("s.cid", "s.other", "cosine")
    theirs = both.join(heads.select(F.col("cid").alias("other"), F.col("entity_id").alias("neighbour_id")), "other").select("cid", "neighbour_id", "cosine")
    own = heads.select("cid", F.col("entity_id").alias("neighbour_id"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("cid").orderBy(F.desc("cosine"), "neighbour_id")
    offered = theirs.unionByName(own).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    pairs = members.join(offered, "cid").where(F.col("entity_id") != F.col("neighbour_id"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("n"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("entity_id", "neighbour_id", "cosine", "rank")


def mutual_pairs(found: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b), the smaller first, of which one is among the other's most similar."""
    return found.select(F.least("entity_id", "neighbour_id").alias("id_a"), F.greatest("entity_id", "neighbour_id").alias("id_b")).distinct()
