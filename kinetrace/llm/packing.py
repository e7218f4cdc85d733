"""Filling containers of fixed capacity with items of varying length.

First-fit decreasing, run independently in random groups of items, with a tournament
tree over the containers of a group: the first container with enough room is found in
log steps.  Groups hold about ``GROUP`` items whatever the input, so no task grows with
it, and each wastes less than one container's share.  An item above the capacity fills
containers of its own and only its rest is packed.

Null and empty texts have size 0 and get a container like any other; repeated rows are
items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PATTERN, VOCABULARY, encoder_of, portions, shipped

CAPACITY, GROUP, SEED = 2048, 8192, 20_011


class Tournament:
    """Room left in each container; every inner node holds the most room below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put an item into the first container with room for it."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        at, room[i] = i - self.leaves, room[i] - size
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; sizes must not exceed the capacity."""
    tree, out = Tournament(max(1, len(sizes)), capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.place(sizes[i])
    return out


def sized_texts(docs: DataFrame, groups: int, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens, grp): token count of every row and its random group.

    The group follows from the partition and the row's number in it, so that no key makes a
    large group, and a task that runs again gives the same.
    """
    kind = docs.schema[key].dataType.simpleString()
    words = shipped(docs, vocabulary)

    def work(batches):
        from pyspark import TaskContext

        coder, at = encoder_of(words.value, pattern), 0
        part = np.uint64(TaskContext.get().partitionId() + 1) * np.uint64(0x9E3779B97F4A7C15 & (1 << 63) - 1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                _, offsets = coder.encode(texts[a:b])
                with np.errstate(over="ignore"):
                    x = np.arange(at, at + b - a, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(SEED)
                    for _ in range(2):
                        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    x ^= x >> np.uint64(32)
                at += b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array((x % np.uint64(groups)).astype(np.int64))], [key, "n_tokens", "grp"])

    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, n_tokens long, grp long")


def pack(items: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, n_tokens, container) from (key, n_tokens, grp)."""
    kind = items.schema[key].dataType.simpleString()

    def work(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("n_tokens", "descending"), (key, "ascending")])
        table = table.take(order)
        sizes, grp = table.column("n_tokens").to_numpy(), table.column("grp")[0].as_py()
        full, rest = np.divmod(sizes, capacity)
        own = np.where(full > 0, full, 0)
        keep = (rest > 0) | (full == 0)  # rows whose rest is packed
        row = np.r_[np.repeat(np.arange(len(sizes)), own), np.flatnonzero(keep)]
        first = np.cumsum(own) - own
        piece = np.r_[np.arange(own.sum()) - np.repeat(first, own), full[keep]]
        size = np.r_[np.full(own.sum(), capacity), rest[keep]]
        packed = np.array(first_fit_decreasing(rest[keep].tolist(), capacity), np.int64) + own.sum()
        container = np.r_[np.arange(own.sum()), packed] + (grp << 32)
        return pa.table({key: table.column(key).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "n_tokens": pa.array(size, pa.int64()), "container": pa.array(container, pa.int64())})

    return items.groupBy("grp").applyInArrow(work, f"`{key}` {kind}, piece int, n_tokens long, container long")


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The container of every text, or of every piece of one above the capacity."""
    return pack(sized_texts(docs, max(1, -(-docs.count() // group)), key, text), key, capacity)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_items, n_tokens, unused) of every container."""
    per = packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return per.withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
