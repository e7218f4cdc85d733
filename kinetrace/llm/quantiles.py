"""Percentiles of very large numeric columns by mergeable dyadic digests.

A value is rounded to ``LEVELS`` bits of its ordered float32 pattern (relative error
2^-12), a leaf of a binary tree over that universe.  A digest counts values in nodes of
the tree; where a node, its sibling and their parent together hold at most n/k values,
the three become the parent.  Digests of parts add node by node.  Whatever the order and
shape of the merges, no rank is off by more than LEVELS/k of n (1 % by default), and while
n < k a digest is exact on the rounded values.

Digests of one key are written as blocks of dimensions.  A partition hands on what it holds
whenever that reaches ``FLUSH`` nodes; the digests of the partitions are then added in a tree
of ``FAN`` children each, as many levels as the number of partitions asks for, and inside a
task batch by batch: no task holds more than a few blocks, or adds more than ``FAN`` partitions
of a key.

A digest row packs its nodes as the steps between them and its counts, both with equal bytes
together (all lowest ones first), which the shuffle compresses well.

Null, NaN and infinite values do not count; a key and dimension without finite values
gives no row.  Every row counts, second deliveries too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 20
ERROR = 0.01
K = int(LEVELS / ERROR)
BLOCK = 32  #: dimensions in one row of a digest table
FAN = 64  #: digests of a key that a task adds
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
_DROP = 32 - LEVELS
_NODE = LEVELS + 1  #: bits of a node number: the root is 1, leaves start at 2^LEVELS
FLUSH = 1 << 19  #: nodes a partition holds
_MOST = 1 << 18  #: nodes gathered before they are added up
_STEP = 1 << 17  #: values turned into nodes at a time
_NODE_BYTES, _COUNT_BYTES = 4, 6


def leaf(x: np.ndarray) -> np.ndarray:
    """Leaf of each finite value, in the order of the values."""
    with np.errstate(over="ignore"):
        f = np.clip(x.astype(np.float64), -3.4028e38, 3.4028e38).astype(np.float32) + np.float32(0)  # no -0
    u = f.view(np.uint32).astype(np.int64)
    size = np.minimum(((u & 0x7FFFFFFF) + (1 << (_DROP - 1))) >> _DROP, (0x7F7FFFFF) >> _DROP)
    half = 1 << (LEVELS - 1)
    return np.where(u >> 31, half - size, half + size)


def value(at: np.ndarray) -> np.ndarray:
    half = 1 << (LEVELS - 1)
    size = (np.abs(at - half) << _DROP).astype(np.uint32).view(np.float32)
    return np.where(at < half, -size, size).astype(np.float64)


def add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal nodes; sorted."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def compress(keys: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Fold light siblings into their parents, from the leaves up."""
    if not len(keys):
        return keys, counts
    dims, at = np.unique(keys >> _NODE, return_inverse=True)
    n = np.bincount(at, counts, len(dims)).astype(np.int64)
    if (n < k).all():
        return keys, counts
    mask = (1 << _NODE) - 1
    done_k, done_c = [], []
    for level in range(LEVELS, 0, -1):
        here = ((keys & mask) >> level) == 1
        own_k, own_c = keys[here], counts[here]
        keys, counts = keys[~here], counts[~here]
        if not len(own_k):
            continue
        dim = own_k & ~mask
        parents, group = np.unique(dim | ((own_k & mask) >> 1), return_inverse=True)
        total = np.bincount(group, own_c, len(parents)).astype(np.int64)
        slot = np.minimum(np.searchsorted(keys, parents), max(0, len(keys) - 1))
        above = np.where(keys[slot] == parents, counts[slot], 0) if len(keys) else 0
        most = n[np.searchsorted(dims, parents >> _NODE)] // k
        fold = total + above <= most
        stay = ~fold[group]
        done_k.append(own_k[stay])
        done_c.append(own_c[stay])
        if fold.any():
            keys, counts = add(np.r_[keys, parents[fold]], np.r_[counts, total[fold]])
    return add(np.concatenate([*done_k, keys]), np.concatenate([*done_c, counts]))


def percentiles(keys: np.ndarray, counts: np.ndarray, percents=PERCENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dimensions, their counts, and a column of values per percent: the least value with
    that share of the values at or below it."""
    mask = (1 << _NODE) - 1
    dim, node = keys >> _NODE, keys & mask
    up = LEVELS - (np.frexp(node.astype(np.float64))[1] - 1)
    top = ((node + 1) << up) - 1 - (1 << LEVELS)
    order = np.lexsort((up, top, dim))
    dim, top, run = dim[order], top[order], np.cumsum(counts[order])
    last = np.flatnonzero(np.r_[dim[1:] != dim[:-1], True]) if len(dim) else np.empty(0, np.int64)
    base = np.r_[0, run[last][:-1]] if len(last) else run
    n = run[last] - base
    want = np.maximum(1, np.ceil(np.outer(n, np.array(percents) / 100) - 1e-9)).astype(np.int64) + base[:, None]
    return dim[last], n, value(top[np.searchsorted(run, want)])


class _Parts:
    """Nodes gathered from many parts, of many keys: a key's dimensions follow the one's before."""

    def __init__(self):
        self.k, self.c, self.size, self.most = [], [], 0, _MOST

    def put(self, keys, counts):
        self.k.append(keys)
        self.c.append(counts)
        self.size += len(keys)
        if self.size > self.most:
            keys, counts = self.get()
            self.__init__()
            self.k, self.c, self.size, self.most = [keys], [counts], len(keys), len(keys) + _MOST

    def get(self):
        if not self.k:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return compress(*add(np.concatenate(self.k), np.concatenate(self.c)))


def _places(cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the lowest byte of each number of packed rows lies, and how far its next one is."""
    n = np.diff(cuts)
    each = np.repeat(n, n)
    return np.arange(cuts[-1]) + np.repeat((width - 1) * cuts[:-1], n), each


def _binary(numbers: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
    """Rows of numbers, those from cut to cut in one, ``width`` bytes each, equal bytes together."""
    at, step = _places(cuts, width)
    out = np.empty(int(cuts[-1]) * width, np.uint8)
    raw = numbers.astype("<i8").view(np.uint8).reshape(-1, 8)
    for b in range(width):
        out[at] = raw[:, b]
        at += step
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(out)])


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed rows one after the other, and the cuts between rows."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if off[-1] == off[0]:
        return np.empty(0, np.int64), np.zeros(len(off), np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    cuts = (off - off[0]) // width
    at, step = _places(cuts, width)
    out = np.zeros((int(cuts[-1]), 8), np.uint8)
    for b in range(width):
        out[:, b] = raw[at]
        at += step
    return out.view("<i8")[:, 0], cuts


def _packed(keys: np.ndarray, counts: np.ndarray):
    """(block numbers, nodes, counts) of sorted nodes, a row per block, some megabytes at a time."""
    block = (keys >> _NODE) // BLOCK
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, np.int64)
    steps = np.diff(keys, prepend=0)
    first = cuts[:-1]
    steps[first] = keys[first] - ((block[first] * BLOCK) << _NODE)
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _MOST, "right")) - 1)
        a, b = cuts[at], cuts[to]
        some = cuts[at : to + 1] - a
        yield block[cuts[at:to]], _binary(steps[a:b], some, _NODE_BYTES), _binary(counts[a:b], some, _COUNT_BYTES)
        at = to


def _portions(batch: pa.RecordBatch):
    """Slices of a digest batch of about ``_STEP`` nodes."""
    column = batch.column("nodes")
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(off, off[at] + _NODE_BYTES * _STEP, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _nodes(batch: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of a digest batch, the rows' dimensions numbered by their group."""
    steps, cuts = _numbers(batch.column("nodes"), _NODE_BYTES)
    counts, _ = _numbers(batch.column("counts"), _COUNT_BYTES)
    n = np.diff(cuts)
    keys = np.cumsum(steps)
    before = np.r_[0, keys][cuts[:-1]]  # the steps of a row start anew
    return keys + np.repeat(((group.astype(np.int64) * BLOCK) << _NODE) - before, n), counts


def _schema(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by) + "block int, nodes binary, counts binary"


def partials(df: DataFrame, column: str, width: int, by: list[str]) -> tuple[DataFrame, int]:
    """Digests (``by``, block, nodes, counts, part) that single partitions make of the
    dimensions of an array column, and how many partitions there are.

    A flat array of several records counts each record.  Arrays that are no whole records
    are left out.
    """
    per = -(-width // BLOCK)

    def part(batches):
        from pyspark import TaskContext

        index: dict[tuple, int] = {}
        parts, kinds, pid = _Parts(), [], TaskContext.get().partitionId()

        def flush():
            names = list(index)
            for block, nodes, counts in _packed(*parts.get()):
                own = [names[k] for k in (block // per).tolist()]
                head = [pa.array([k[i] for k in own], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(block % per, pa.int32()), nodes, counts, pa.array([pid] * len(own), pa.int32())], [*by, "block", "nodes", "counts", "part"])
            index.clear()
            parts.__init__()

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            data = batch.column(column)
            off, ok, v = data.offsets.to_numpy(), data.is_valid().to_numpy(zero_copy_only=False), data.values.to_numpy(zero_copy_only=False)
            n = np.diff(off)
            rows = np.flatnonzero(ok & (n > 0) & (n % width == 0))
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            reach = np.cumsum(n[rows])
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _STEP, "right")))
                some = rows[at:to]
                own = np.array([index.setdefault(keys[i], len(index)) for i in some.tolist()], np.int64)
                first = np.repeat(own * (per * BLOCK), n[some] // width)  # of each record
                flat = v[off[some[0]] : off[some[0] + 1]] if len(some) == 1 else np.concatenate([v[off[i] : off[i + 1]] for i in some.tolist()])
                for a in range(0, len(first), max(1, _STEP // width)):  # a long array, too, in steps
                    dims = first[a : a + max(1, _STEP // width)]
                    x = flat[a * width : (a + len(dims)) * width]
                    finite = np.isfinite(x)
                    node = ((dims[:, None] + np.arange(width)).ravel()[finite] << _NODE) | (leaf(x[finite]) + (1 << LEVELS))
                    node.sort()
                    cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]) if len(node) else np.zeros(1, np.int64)
                    parts.put(node[cut[:-1]], np.diff(cut).astype(np.int32))
                at = to
                if parts.size > FLUSH:
                    yield from flush()
        yield from flush()

    source = df.select(*by, column)
    return source.mapInArrow(part, _schema(df, by) + ", part int"), source.rdd.getNumPartitions()


def digests(df: DataFrame, column: str, width: int, by: list[str]) -> DataFrame:
    """Mergeable digests (``by``, block, nodes, counts) of the dimensions of an array column."""
    return tree(*partials(df, column, width, by), by)


def tree(raw: DataFrame, parts: int, by: list[str], percents=None) -> DataFrame:
    """Digests of ``parts`` partitions, numbered by ``part``, added into one of each key; with
    ``percents``, read at once."""
    while parts > FAN:
        raw, parts = merged(raw, by, F.expr(f"part div {FAN}")), -(-parts // FAN)
    return merged(raw, by, percents=percents)


def merged(digest: DataFrame, by: list[str], part=None, percents=None) -> DataFrame:
    """Digests of equal keys (and ``part``) added into one: keys in order, many small ones at
    a time, a large one batch by batch.  With ``percents``, what ``read`` makes of them."""
    keys, kept = [*by, "block"], ""
    if part is not None:
        digest = digest.withColumn("part", part.cast("int"))
        keys.append("part")
        kept = ", part int"

    def combine(batches):
        parts, held = _Parts(), []  # held: the keys gathered, in order

        def done(kinds, last_stays):
            nonlocal parts, held
            k, c = parts.get()
            rest, keep = (k[:0], c[:0]), []
            if last_stays:
                cut = int(np.searchsorted(k, ((len(held) - 1) * BLOCK) << _NODE))
                rest, keep = (k[cut:] - (((len(held) - 1) * BLOCK) << _NODE), c[cut:]), held[-1:]
                k, c = k[:cut], c[:cut]
            if percents:
                yield _answers(k, c, percents, lambda row: [pa.array([held[g][i] for g in row.tolist()], kind) for i, kind in enumerate(kinds)], np.array([h[len(by)] for h in held], np.int64), by)
            for group, nodes, counts in _packed(k, c) if not percents else ():
                own = [held[g] for g in group.tolist()]
                head = [pa.array([o[i] for o in own], kind) for i, kind in enumerate(kinds)]
                tail = [pa.array([o[-1] for o in own], pa.int32())] if kept else []
                yield pa.RecordBatch.from_arrays([*head, pa.array([o[len(by)] for o in own], pa.int32()), nodes, counts, *tail], [*by, "block", "nodes", "counts", *(["part"] if kept else [])])
            parts, held = _Parts(), keep
            parts.put(*rest)

        kinds = []
        for batch in (part for whole in batches for part in _portions(whole)):
            kinds = [batch.schema.field(c).type for c in by]
            group = np.empty(len(batch), np.int64)
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in keys))):
                if not held or key != held[-1]:
                    held.append(key)
                group[i] = len(held) - 1
            parts.put(*_nodes(batch, group))
            if len(held) > 1 and parts.size > _MOST:
                yield from done(kinds, True)
        if held:
            yield from done(kinds, False)

    schema = _schema(digest, by) + kept if not percents else _answer_schema(digest, by, percents)
    return digest.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "nodes", "counts").mapInArrow(combine, schema)


def _answer_schema(digest: DataFrame, by: list[str], percents) -> str:
    return _schema(digest, by).split("block int")[0] + "dim int, n long, " + ", ".join(f"p{p:02d} double" for p in percents)


def _answers(keys, counts, percents, head, block: np.ndarray, by: list[str]) -> pa.RecordBatch:
    """Percentiles of nodes whose dimensions are numbered by row; ``head`` makes the keys of rows."""
    dims, n, values = percentiles(keys, counts, percents)
    row = dims // BLOCK
    return pa.RecordBatch.from_arrays([*head(row), pa.array(block[row] * BLOCK + dims % BLOCK, pa.int32()), pa.array(n), *(pa.array(v) for v in values.T)], [*by, "dim", "n", *(f"p{p:02d}" for p in percents)])


def read(digest: DataFrame, by: list[str], percents=PERCENTS) -> DataFrame:
    """(``by``, dim, n, p..): the percentiles of merged digests."""

    def work(batches):
        for batch in batches:
            for some in _portions(batch):
                yield _answers(*_nodes(some, np.arange(len(some))), percents, lambda row: some.select(by).take(pa.array(row)).columns, some.column("block").to_numpy(), by)

    return digest.select(*by, "block", "nodes", "counts").mapInArrow(work, _answer_schema(digest, by, percents))


def rank_errors(values: DataFrame, answers: DataFrame, by: list[str], percents=PERCENTS, most: int = 1 << 17) -> DataFrame:
    """(``by``, dim, n, worst): largest distance, as a share of ``n``, of the ranks of each
    answer from the wanted one, counted over all finite values (``by``, dim, x).

    An answer stands for the values that round to it (2^-12 of it).  Answers of up to
    ``most`` keys are sent to every task, more are joined by a shuffle; null keys are keys.
    """
    names = [f"p{p:02d}" for p in percents]
    keys = [*by, "dim"]
    side = answers.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", *names)
    if answers.limit(most + 1).count() <= most:
        side = F.broadcast(side)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = values.join(side, same)
    tol = {p: F.abs(p) * 2.0**-12 + 1e-37 for p in names}
    counts = [F.count_if(c).alias(n) for p in names for n, c in ((f"_u_{p}", F.col("x") < F.col(p) - tol[p]), (f"_m_{p}", F.col("x") <= F.col(p) + tol[p]))]
    per = both.groupBy(*keys).agg(F.count("*").alias("_total"), F.first("n").alias("n"), *counts)
    off = []
    for p, name in zip(percents, names):
        want = F.greatest(F.lit(1), F.ceil(F.col("_total") * (p / 100) - 1e-9))
        off.append(F.greatest(want - F.col(f"_m_{name}"), F.col(f"_u_{name}") + 1 - want, F.lit(0)))
    return per.select(*keys, F.col("_total").alias("n"), F.when(F.col("n") == F.col("_total"), F.greatest(*off) / F.col("_total")).otherwise(1.0).alias("worst"))


def column_percentiles(df: DataFrame, column: str, width: int, by: list[str], percents=PERCENTS) -> DataFrame:
    """Percentiles of every dimension of an array column, per key."""
    return tree(*partials(df, column, width, by), by, percents)
