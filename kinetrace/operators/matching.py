"""Joins: intervals, nearest vectors, retrieval, lookups and positional pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512  #: vectors of a block in retrieval
CODES = 1 << 22  #: most numbers a codebook may have that is sent to every task


def first_event(events: Column, t: Column, start: str = "start_time", end: str = "end_time") -> Column:
    """Number of the first listed event with start <= t < end; null if none.

    Works on the array itself: no row per pair of time and event.
    """
    hit = F.filter(F.transform(events, lambda e, i: F.struct(i.alias("i"), (e[start] <= t).alias("a"), (t < e[end]).alias("b"))), lambda e: e["a"] & e["b"])
    return F.get(hit, F.lit(0))["i"]


def last_line(lines: DataFrame, key: str, line: str, value: str) -> DataFrame:
    """The value of the last line of each key; combined before the shuffle."""
    return lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(line, value))[value].alias(value))


def overlapping(points: DataFrame, x: str, spans: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points joined to the spans with low <= x < high, without a common key.

    Axis cells of ``width`` make it an equi-join; a span is in every cell it touches.
    """
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    left = points.withColumn("_cell", F.floor(F.col(x) / width))
    right = spans.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(cells))
    return left.join(right, "_cell").where((F.col(low) <= F.col(x)) & (F.col(x) < F.col(high))).drop("_cell")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys match, and how many are on one side only."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only")
    )


def codebook(vectors: DataFrame, code: str, vector: str, width: int, most: int = CODES) -> tuple[list, np.ndarray]:
    """A codebook as (codes, matrix), refused above ``most`` numbers: it goes to every task."""
    rows = vectors.select(code, vector).orderBy(code).limit(most // width + 1).collect()
    if len(rows) * width > most:
        raise ValueError(f"a codebook of more than {most // width} codes is not sent to every task")
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(len(rows), width)


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``width`` finite numbers, and the matrix of all rows, zeros where not."""
    off, ok = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    v = column.values.to_numpy(zero_copy_only=False)
    good = ok & (np.diff(off) == width)
    x = np.zeros((len(column), width))
    rows = np.flatnonzero(good)
    if len(rows):
        x[rows] = v[off[rows][:, None] + np.arange(width)]
    fine = np.isfinite(x).all(axis=1)
    x[~fine] = 0.0
    return good & fine, x


def nearest_code(x: np.ndarray, book: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Nearest row of ``book`` of each row of ``x`` and its squared distance, rounded to 9 places.

    The expanded square is one matrix product; what it leaves too close to call is computed
    again as a difference, so ties go to the lowest code as if all had been.
    """
    found, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    own = (book**2).sum(axis=1)
    for a in range(0, len(x), step):
        part = x[a : a + step]
        square = (part**2).sum(axis=1)
        d = own[None] - 2 * (part @ book.T)
        least = d.min(axis=1)
        close = d <= (least + 2e-9 + 1e-12 * (square + own.max(initial=0.0)))[:, None]
        k = d.argmin(axis=1)
        exact = np.round(((part - book[k]) ** 2).sum(axis=1), 9)
        for i in np.flatnonzero(close.sum(axis=1) > 1):
            some = np.flatnonzero(close[i])
            e = np.round(((part[i] - book[some]) ** 2).sum(axis=1), 9)
            k[i], exact[i] = some[e.argmin()], e.min()
        found[a : a + step], dist[a : a + step] = k, exact
    return found, dist


def quantized(df: DataFrame, key: str, vector: str, books: list[tuple[list, np.ndarray]], residual: bool = True) -> DataFrame:
    """(key, layer, code, dist): nearest code of each layer by squared distance.

    With ``residual`` each layer quantizes what the ones before left over, else the vector
    itself.  Ties take the lowest code; distances are compared after rounding to 9 places.
    Null, ragged and non-finite vectors give null codes.
    """
    kind = df.schema[key].dataType.simpleString()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(books)
    width = books[0][1].shape[1]

    def work(batches):
        for batch in batches:
            keys = batch.column(0)
            good, x = vectors_of(batch.column(1), width)
            left = x.copy()
            for layer, (codes, book) in enumerate(shared.value):
                found, dist = nearest_code(left if residual else x, book)
                if residual:
                    left -= book[found]
                names = np.array(codes, np.int64)[found]
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(x), layer, np.int32)), pa.array(names, mask=~good), pa.array(dist, mask=~good)], [key, "layer", "code", "dist"])

    return df.select(key, vector).mapInArrow(work, f"`{key}` {kind}, layer int, code long, dist double")


def split_quantized(df: DataFrame, key: str, vector: str, semantic: tuple[list, np.ndarray], residual: list[tuple[list, np.ndarray]]) -> DataFrame:
    """(key, layer, code, dist) of two branches that both quantize the whole vector: layer 0
    is the semantic one, the residual layers follow it."""
    head = quantized(df, key, vector, [semantic])
    return head.unionByName(quantized(df, key, vector, residual).withColumn("layer", F.col("layer") + 1))


def dequantized(codes: DataFrame, key: str, book: DataFrame, prefix: int | None = None) -> DataFrame:
    """(key, dim, x): sums of the code vectors of the first ``prefix`` layers; null codes add zero.

    ``book`` has (layer, code, dim, c).
    """
    chosen = codes if prefix is None else codes.where(F.col("layer") < prefix)
    return chosen.join(book, ["layer", "code"]).groupBy(key, "dim").agg(F.sum("c").alias("x"))


def blocks(df: DataFrame, key: str, columns: list[str], parts: int) -> DataFrame:
    """Rows packed into ``parts`` random blocks of (ids, flat vectors)."""
    b = F.pmod(F.xxhash64(key), F.lit(parts)).alias("block")
    packed = df.select(b, F.struct(key, *columns).alias("r")).groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r"))

    def field(c):
        return F.transform("r", lambda e: e[c])

    return packed.select(field(key).alias("ids"), *(F.flatten(field(c)).alias(c) for c in columns))


def retrieval(df: DataFrame, key: str, teacher: str, student: str, every: int = 20) -> DataFrame:
    """(key, target, rank): rows whose key is divisible by ``every`` against all rows.

    The target is the row nearest by the teacher's cosine, the rank the number of other rows
    the student puts strictly before it.  Query blocks meet data blocks of ``BLOCK`` vectors
    in NumPy; scores are rounded to 9 places first, ties go to the lower key.  All-zero
    and null vectors are missing and left out.
    """
    from ..functions.vectors import all_zero

    good = df.where(F.col(key).isNotNull() & F.col(teacher).isNotNull() & F.col(student).isNotNull()).where(~all_zero(F.col(teacher)) & ~all_zero(F.col(student)))
    n = good.count()
    data = blocks(good, key, [teacher, student], max(1, -(-n // BLOCK)))
    asked = blocks(good.where(F.pmod(F.col(key), F.lit(every)) == 0), key, [teacher, student], max(1, -(-n // (BLOCK * every))))
    q = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("ids", teacher, student)))

    def unit(batch, name, i):
        ids = batch.column("q_ids" if name.startswith("q_") else "ids")[i].values.to_numpy(zero_copy_only=False)
        v = batch.column(name)[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        return ids, v / np.linalg.norm(v, axis=1, keepdims=True)

    def nearest(batches):
        for batch in batches:
            for i in range(len(batch)):
                a, x = unit(batch, f"q_{teacher}", i)
                b, y = unit(batch, teacher, i)
                s = np.round(x @ y.T, 9)
                s[a[:, None] == b[None]] = -2
                k = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b[k]), pa.array(s[np.arange(len(a)), k])], ["q", "target", "score"])

    best = q.crossJoin(data.select("ids", teacher)).mapInArrow(nearest, "q long, target long, score double").where("score > -2")
    best = best.groupBy("q").agg(F.max_by("target", F.struct("score", -F.col("target"))).alias("target"))
    aim = best.join(good.select(F.col(key).alias("target"), F.col(student).alias("aim")), "target").join(good.select(F.col(key).alias("q"), F.col(student).alias("own")), "q")
    aims = blocks(aim.withColumnRenamed("q", "id"), "id", ["own", "aim"], max(1, -(-n // (BLOCK * every)))).select(F.col("ids").alias("q_ids"), F.col("own").alias("q_own"), F.col("aim").alias("q_aim"))

    def count(batches):
        for batch in batches:
            for i in range(len(batch)):
                a, x = unit(batch, "q_own", i)
                _, z = unit(batch, "q_aim", i)
                b, y = unit(batch, student, i)
                s = np.round(x @ y.T, 9)
                s[a[:, None] == b[None]] = -2
                own = np.round((x * z).sum(axis=1), 9)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array((s > own[:, None]).sum(axis=1))], ["q", "before"])

    ranks = aims.crossJoin(data.select("ids", student)).mapInArrow(count, "q long, before long").groupBy("q").agg(F.sum("before").alias("rank"))
    return best.join(ranks, "q").select(F.col("q").alias(key), "target", "rank")
