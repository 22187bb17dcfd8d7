"""Filling packs of fixed capacity with texts measured in tokens: minimum bin slack.

Texts are dealt into windows of bounded size by a hash. In a window every pack begins with the longest text left and is
filled by the multiset of remaining lengths that comes closest to the capacity: a subset sum over the lengths by bitsets,
whose steps are followed back to the count of each length. A multiset found is used as often as the counts allow. Packs
that stay too empty are opened again and packed together with those of other windows.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import durable

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
WINDOW = 10_000
#: Packs with more than this share of unused space are opened again, in ROUNDS further rounds.
SLACK, ROUNDS = 0.01, 2
MOST_BUDGETS = 1000
PACKED = "budget_id int, capacity bigint, window bigint, doc_id bigint, piece bigint, tokens bigint, pack bigint, fill bigint"


@lru_cache(2)
def _encoding(folder: str, name: str):
    if folder not in sys.path:
        sys.path.append(folder)
    import tiktoken

    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})


def _pattern() -> str:
    """The splitting pattern that belongs to the public byte-level vocabularies. Without it no count is right: an import error
    is not caught."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_lengths(documents: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document; null and empty texts have 0 tokens, long texts are encoded whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(folder, name)
        for b in batches:
            n = [0 if t is None else len(encoding.encode_ordinary(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array(n, np.int64)})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, tokens bigint")


def closest_subset(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take for a sum as close to `room` as it can be, without exceeding it.

    Bit s of `reach` is set if s is a sum; lengths enter longest first, in chunks of 1, 2, 4, ... pieces.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        chunk = 1
        while left:
            chunk = min(chunk, left)
            steps.append((reach, length, chunk))
            reach |= (reach << (length * chunk)) & mask
            left -= chunk
            chunk *= 2
        if reach >> room & 1:
            break
    rest, taken = reach.bit_length() - 1, {}
    for before, length, chunk in reversed(steps):
        if not before >> rest & 1:
            rest -= length * chunk
            taken[length] = taken.get(length, 0) + chunk
    return taken


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(pack of each item, fill of each pack) for lengths between 1 and `capacity`."""
    order = np.argsort(-lengths, kind="stable")
    values, start, n = np.unique(-lengths[order], return_index=True, return_counts=True)
    values = (-values).tolist()  # descending
    counts, at = dict(zip(values, n.tolist())), dict(zip(values, start.tolist()))
    pack, fills = np.empty(len(lengths), np.int64), []
    while values:
        first = values[0]
        counts[first] -= 1
        taken = closest_subset(values, counts, capacity - first)
        counts[first] += 1
        taken[first] = taken.get(first, 0) + 1
        times = min(counts[v] // k for v, k in taken.items())
        total = sum(v * k for v, k in taken.items())
        for _ in range(times):
            for v, k in taken.items():
                pack[order[at[v] : at[v] + k]] = len(fills)
                at[v] += k
            fills.append(total)
        for v, k in taken.items():
            counts[v] -= k * times
        if any(counts[v] == 0 for v in taken):
            values = [v for v in values if counts[v]]
    return pack, np.array(fills, np.int64)


def _pack_window(items: pd.DataFrame) -> pd.DataFrame:
    items = items.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    pack, fills = pack_lengths(items["tokens"].to_numpy(), int(items["capacity"].iloc[0]))
    return items.assign(pack=pack, fill=fills[pack])[["budget_id", "capacity", "window", "doc_id", "piece", "tokens", "pack", "fill"]]


def _pack(items: DataFrame, sizes: DataFrame, salt: int) -> DataFrame:
    """Packs items (budget_id, capacity, doc_id, piece, tokens) in windows; sizes: (budget_id, n) items per budget."""
    windows = F.ceil(F.col("n") / WINDOW)
    placed = items.join(F.broadcast(sizes), "budget_id").withColumn("window", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), windows)).drop("n")
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # A number of partitions is named, as the work lies in the packing and small partitions must not be merged.
    return placed.repartition(tasks, "budget_id", "window").groupBy("budget_id", "window").applyInPandas(_pack_window, PACKED)


def packs(lengths: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, doc_id, piece, tokens, pack_id, fill): every text's pack at every capacity.

    lengths: (doc_id, tokens), ids unique; budgets: (budget_id, capacity_tokens), few, capacities above 0. A text longer
    than the capacity is split: its first pieces fill packs of their own, the rest is an item like others. A text without
    tokens needs no space: one row without a pack. `fill` is the number of tokens in the pack.
    """
    few = budgets.where("budget_id is not null and capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().limit(MOST_BUDGETS + 1).collect()
    if len(few) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    pairs = [F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in sorted(map(tuple, few))]
    each = F.explode(F.array(*pairs) if pairs else F.array().cast("array<struct<budget_id:int,capacity:bigint>>"))
    both = durable(lengths).select("doc_id", "tokens", each.alias("b")).select("doc_id", "tokens", "b.*").withColumn("whole", F.floor(F.col("tokens") / F.col("capacity")))
    none = F.lit(None)
    empty = both.where("tokens = 0").select("budget_id", "capacity", "doc_id", F.lit(0).cast("bigint").alias("piece"), "tokens", none.cast("string").alias("pack_id"), none.cast("bigint").alias("fill"))
    full = both.where("whole > 0").select("budget_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"))
    full = full.select("budget_id", "capacity", "doc_id", "piece", F.col("capacity").alias("tokens"), F.concat_ws("-", F.lit("whole"), "budget_id", "doc_id", "piece").alias("pack_id"), F.col("capacity").alias("fill"))
    items = both.where(F.col("tokens") % F.col("capacity") > 0).select("budget_id", "capacity", "doc_id", F.col("whole").alias("piece"), (F.col("tokens") % F.col("capacity")).alias("tokens"))
    out = empty.unionByName(full)
    for turn in range(ROUNDS + 1):
        sizes = items.groupBy("budget_id").agg(F.count("*").alias("n"))
        packed = durable(_pack(items, sizes, turn))
        loose = F.col("fill") < F.col("capacity") * (1 - SLACK)
        done = packed if turn == ROUNDS else packed.where(~loose)
        name = F.concat_ws("-", F.lit(f"round{turn}"), "budget_id", "window", "pack")
        out = out.unionByName(done.select("budget_id", "capacity", "doc_id", "piece", "tokens", name.alias("pack_id"), "fill"))
        items = packed.where(loose).select("budget_id", "capacity", "doc_id", "piece", "tokens")
    return out


def pack_fills(packed: DataFrame) -> DataFrame:
    """(budget_id, capacity, pack_id, n_items, fill, unused) of every pack."""
    rows = packed.where("pack_id is not null")
    return rows.groupBy("budget_id", "capacity", "pack_id").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("fill")).withColumn("unused", F.col("capacity") - F.col("fill"))


def invariants(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: n_texts placed; n_wrongly_placed texts with a piece placed twice, or in pieces though they fit; n_overfull
    packs beyond the capacity; n_misstated packs whose fill is not the sum of their tokens. All but the first should be 0."""
    per_text = packed.groupBy("budget_id", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"), F.sum("tokens").alias("t"), F.max("capacity").alias("c"))
    wrong = (F.col("n") != F.col("pieces")) | (F.col("n") != F.greatest(F.ceil(F.col("t") / F.col("c")), F.lit(1)))
    texts = per_text.groupBy("budget_id").agg(F.count("*").alias("n_texts"), F.count_if(wrong).alias("n_wrongly_placed"))
    per_pack = packed.where("pack_id is not null").groupBy("budget_id", "pack_id").agg(F.sum("tokens").alias("t"), F.max("fill").alias("f"), F.min("fill").alias("g"), F.max("capacity").alias("c"))
    fills = per_pack.groupBy("budget_id").agg(F.count_if(F.col("t") > F.col("c")).alias("n_overfull"), F.count_if((F.col("t") != F.col("f")) | (F.col("f") != F.col("g"))).alias("n_misstated"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = budgets.select("budget_id").distinct().join(texts, "budget_id", "left").join(fills, "budget_id", "left")
    return rows.select("budget_id", *[zero(c) for c in ("n_texts", "n_wrongly_placed", "n_overfull", "n_misstated")])
