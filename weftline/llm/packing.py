"""Problem 8: filling containers of fixed capacity, certified by lower bounds.

Items go to partitions by a hash. Each partition packs its items by best-fit decreasing and gets a lower bound of its
containers from dual-feasible functions (the capacity bound, the two-threshold family of large items, and the
rounding family). A partition whose count equals its bound is certified and final. In the others the full containers
stay and the rest of their items is exchanged: they meet the items of other open partitions in a new, smaller set of
partitions and are packed again, until all are certified, one partition is left, or a round brings nothing.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpoint

CAPACITY = 2048
#: Items of one partition; narrow rows, so that a task holds some tens of MB at most.
ITEMS_PER_PARTITION = 50_000
#: Containers at least this full stay where they are when a partition exchanges the rest.
FULL = 0.999
MOST_ROUNDS = 12


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of whole items needs, by dual-feasible functions."""
    if not len(sizes):
        return 0
    sizes = sizes.astype(np.int64)
    best = -(-int(sizes.sum()) // capacity)
    ordered = np.sort(sizes)
    sums = np.concatenate([[0], np.cumsum(ordered)])
    half = int(np.searchsorted(ordered, capacity / 2, side="right"))  # items above half lie from here on
    for low in np.unique(ordered[: max(half, 1)]):
        if low > capacity / 2:
            break
        # u(x): 1 above capacity - low, x / capacity between, 0 below low
        big = int(np.searchsorted(ordered, capacity - low, side="right"))
        small = int(np.searchsorted(ordered, low, side="left"))
        best = max(best, len(ordered) - big + -(-int(sums[big] - sums[small]) // capacity))
    for k in range(1, 21):
        # f_k(x) = x / C if (k + 1) x / C is whole, else floor((k + 1) x / C) / k; summed over k * C for exact integers
        scaled = (k + 1) * ordered
        whole = scaled % capacity == 0
        total = int((np.where(whole, k * ordered, (scaled // capacity) * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; items are at most ``capacity``."""
    out = np.empty(len(sizes), np.int64)
    room: dict[int, list[int]] = {}
    open_rooms: list[int] = []  # sorted sizes of rooms at hand
    bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(open_rooms, size)
        if at < len(open_rooms):
            space = open_rooms[at]
            held = room[space]
            number = held.pop()
            if not held:
                del room[space], open_rooms[at]
        else:
            number, space = bins, capacity
            bins += 1
        left = space - size
        if left:
            if left not in room:
                room[left] = []
                insort(open_rooms, left)
            room[left].append(number)
        out[i] = number
    return out


def split_items(counted: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """Items key, chunk, size: one per document, or the chunks of a document that alone exceeds the capacity.

    All but the last chunk of such a document fill a container each. Documents without tokens give no item.
    """
    n = F.col(tokens).cast("long")
    pieces = F.sequence(F.lit(0), (F.ceil(n / F.lit(capacity)) - 1).cast("int"))
    rows = counted.filter(F.col(key).isNotNull() & (n > 0)).select(F.col(key).alias("key"), n.alias("_n"), F.explode(pieces).alias("chunk"))
    return rows.select("key", "chunk", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("chunk").cast("long") * capacity).alias("size"))


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = ITEMS_PER_PARTITION, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Columns key, chunk, size, container, certified of items (key, chunk, size).

    Rounds go on while partitions exchange items to a gain; what is left uncertified after them is within the gap that
    ``fill_report`` shows against the bound of all tokens. The place of a chunk in its document is its number times
    the capacity, in tokens (``with_offsets``).

    Items without size take no part, larger ones than the capacity are an error of the caller (see ``split_items``).
    Repeated items are items of their own. An empty table gives no row. The result repeats for the same items in any
    layout: partitions come from hashes and each sorts its items.
    """
    kind = items.schema["key"].dataType.simpleString()
    schema = f"key {kind}, chunk int, size long, container string, certified boolean, stays boolean"

    def round_of(number: int):
        def fill(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["size", "key", "chunk"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            sizes = frame["size"].to_numpy()
            if len(sizes) and sizes[0] > capacity:
                raise ValueError(f"an item of {sizes[0]} exceeds the capacity {capacity}")
            bins = best_fit_decreasing(sizes, capacity)
            loads = np.bincount(bins, sizes)
            certified = len(loads) == lower_bound(sizes, capacity)
            label = f"{number}-{frame['_part'].iloc[0]}-"
            return pd.DataFrame(
                {
                    "key": frame["key"],
                    "chunk": frame["chunk"].astype(np.int32),
                    "size": sizes,
                    "container": [label + str(b) for b in bins],
                    "certified": certified,
                    "stays": certified | (loads[bins] >= FULL * capacity),
                }
            )

        return fill

    # narrow rows, read by the count and the first round; their texts are tokenized once
    rest = checkpoint(items.filter("size > 0").select("key", F.col("chunk").cast("int").alias("chunk"), F.col("size").cast("long").alias("size")))
    done = None
    before = None
    for number in range(most_rounds):
        count = rest.count() if before is None else before
        if not count and done is not None:
            break
        parts = max(1, math.ceil(count / per_partition))
        split = rest.withColumn("_part", F.pmod(F.xxhash64("key", "chunk", F.lit(number)), F.lit(parts)))
        packed = checkpoint(split.groupBy("_part").applyInPandas(round_of(number), schema))
        if number + 1 == most_rounds or parts == 1:
            done = packed if done is None else done.unionByName(packed)
            rest = None
            break
        left = packed.filter("NOT stays").agg(F.count("*")).first()[0]
        settled = packed.filter("stays")
        if left and before is not None and left >= before:  # nothing gained
            done = done.unionByName(packed)
            rest = None
            break
        done = settled if done is None else done.unionByName(settled)
        rest, before = packed.filter("NOT stays").select("key", "chunk", "size"), left
        if not left:
            break
    return done.drop("stays")


def with_offsets(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``packed`` with start and end of each chunk in tokens of its document, from which the document can be put together."""
    start = F.col("chunk").cast("long") * capacity
    return packed.withColumns({"start_token": start, "end_token": start + F.col("size")})


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the capacity bound of all tokens and the share of used space."""
    loads = packed.groupBy("container").agg(F.sum("size").alias("load"), F.count("*").alias("items"), F.bool_and("certified").alias("certified"))
    total = F.sum("load")
    return loads.agg(
        F.sum("items").alias("items"),
        F.count("*").alias("containers"),
        F.sum(F.col("certified").cast("long")).alias("certified_containers"),
        total.alias("tokens"),
        F.ceil(total / F.lit(capacity)).alias("capacity_bound"),
        (total / (F.count("*") * capacity)).alias("used_share"),
        F.max("load").alias("largest_load"),
    )
