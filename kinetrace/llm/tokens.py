"""Encoding with a public byte-level BPE vocabulary, and sizes of texts in its tokens.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens themselves; the others are merged with a heap over linked bytes, lowest rank
first and leftmost among equals, so that a pre-token of n bytes takes O(n log n).
Strings that look like special tokens are ordinary text.  Null and empty texts encode to
an empty list, blank ones as they are.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET = 4  #: keys per bucket of the hash, on average
LOAD, TRIES = 0.92, 16  #: share of slots taken before the holes are closed, displacements tried at a time
STEP = 1 << 22  #: characters encoded at a time
MOST = 1 << 26  #: bytes a vocabulary file may have


class PerfectHash:
    """Hash and displace: n keys take the slots 0..n-1, one each; strangers are told by their bytes."""

    def __init__(self, ids: dict[bytes, int]):
        self.n = len(ids)
        self.buckets = max(1, self.n // BUCKET)
        keys = list(ids)
        h = self._hashes(keys)
        bucket = (h >> np.uint64(40)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order].astype(np.int64)) != 0, True])
        groups = sorted(((cuts[i + 1] - cuts[i], order[cuts[i] : cuts[i + 1]]) for i in range(len(cuts) - 1)), key=lambda g: -g[0])
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slots = max(1, int(self.n / LOAD))
        slot = np.zeros(self.n, np.int64)
        free = np.ones(self.slots, bool)
        for size, members in groups:
            own, d, hit = h[members], 0, None
            while hit is None:
                tries = np.arange(d, d + TRIES, dtype=np.uint64)
                at = self._slots(own[None, :], tries[:, None])
                good = free[at].all(axis=1)
                for k in np.flatnonzero(good).tolist():
                    if size == 1 or len(set(at[k].tolist())) == size:
                        hit = k
                        break
                d += TRIES
            free[at[hit]] = False
            self.shift[int(bucket[members[0]])] = tries[hit]
            slot[members] = at[hit]
        # slots beyond n move into the holes below it: as many slots as keys
        self.moved = np.arange(self.slots)
        beyond = np.sort(slot[slot >= self.n])
        self.moved[beyond] = np.flatnonzero(free[: self.n])[: len(beyond)]
        self.moved[self.n :][free[self.n :]] = 0  # only strangers come here
        self.key: list[bytes] = [b""] * self.n
        self.id = np.zeros(self.n, np.int32)
        for k, at in zip(keys, self.moved[slot].tolist()):
            self.key[at], self.id[at] = k, ids[k]

    @staticmethod
    def _hashes(keys) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64, len(keys))

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            return (x % np.uint64(self.slots)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Id of each key, -1 of strangers."""
        if not keys:
            return np.empty(0, np.int32)
        h = self._hashes(keys)
        slots = self.moved[self._slots(h, self.shift[((h >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)])]
        mine = self.key
        known = np.fromiter((mine[s] == k for s, k in zip(slots.tolist(), keys)), bool, len(keys))
        return np.where(known, self.id[slots], -1)


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.words = regex.compile(pattern)
        self.hash = PerfectHash(self.ranks)
        self.merged = lru_cache(1 << 16)(self._merge)

    def _merge(self, word: bytes) -> list[int]:
        """Byte pair merges of one pre-token."""
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of the two was merged since
            alive[j], after[i] = 0, end
            if end < n:
                before[end] = i
                if (r := ranks.get(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text in them."""
        index: dict[str, int] = {}
        words, counts = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                own = self.words.findall(text)
                words += [index.setdefault(w, len(index)) for w in own]
                counts[i + 1] = len(own)
        keys = [w.encode("utf-8") for w in index]
        ids = self.hash.find(keys)
        lengths, start = np.ones(len(keys), np.int64), np.arange(len(keys))
        more: list[int] = []
        for k in np.flatnonzero(ids < 0).tolist():
            part = self.merged(keys[k]) if len(keys[k]) < 256 else self._merge(keys[k])
            lengths[k], start[k] = len(part), len(keys) + len(more)
            more += part
        pool = np.concatenate([ids, np.array(more, np.int32)])
        w = np.array(words, np.int64)
        n = lengths[w]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(start[w] - (ends - n), n) + np.arange(total)
        return pool[at], np.r_[0, ends][np.cumsum(counts)]


@lru_cache(4)
def encoder_of(vocabulary: bytes, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(vocabulary, pattern)


def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        return encoder_of(f.read(), pattern)


def shipped(df: DataFrame, path: str):
    """The vocabulary file, read on the driver and sent to every executor: a megabyte or two,
    whatever the corpus."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > MOST:
        raise ValueError(f"a vocabulary of more than {MOST} bytes is not sent to every executor")
    return df.sparkSession.sparkContext.broadcast(content)


def portions(texts: list[str | None]):
    """Stretches (from, to) of the batch of about STEP characters each."""
    at, seen = 0, 0
    for i, x in enumerate(texts):
        seen += len(x) if x else 0
        if seen >= STEP:
            yield at, i + 1
            at, seen = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids): token ids of every text, one row per row of ``docs``; no shuffle."""

    words = shipped(docs, vocabulary)

    def work(batches):
        coder = encoder_of(words.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                ids, offsets = coder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, ids array<int>")


def decode_ids(ids: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of each list of ids; empty for an empty one, null for a null one."""
    words = shipped(ids, vocabulary)

    def work(batches):
        by_id = {v: k for k, v in encoder_of(words.value, PATTERN).ranks.items()}
        for batch in batches:
            out = [None if x is None else b"".join(map(by_id.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(key, "ids").mapInArrow(work, f"`{key}` {kind}, text string")


def token_counts(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens) of encoded texts."""
    return ids.select(key, F.size("ids").alias("n_tokens"))
