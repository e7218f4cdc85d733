"""Cutting oversized clips into pieces at natural boundaries, with an overlap.

Lexical cohesion: the records before and after a gap are compared block against block;
a valley of their similarity marks a boundary, and its depth how clear a one.  With motion
at hand the blocks are of motion; without, of the events the records lie in.  From each
piece's start the deepest valley among the bounds of the clip's events within the size
window becomes the cut, else the deepest among its planned starts, else the deepest of all
records in the window; the limit itself only where nothing tells the records apart.  The
next piece starts ``overlap`` records before the cut.

An item without a length, or of at most the limit, gives no piece.  Null, empty,
disordered, overlapping and outlying events and starts are taken for what they mark inside
the clip.  Repeated rows of umr_release are cut each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 499
LIMIT, OVERLAP = 300, 30
SIDE = 24  #: records of a block on either side of a gap
GRID = 8  #: gaps at which events are compared, besides the bounds
FPS = 30.0  #: where no rate is known
FLAT = 1e-9  #: valleys no deeper than this are none

PIECES = "table_name string, item_id string, row_key long, piece int, start int, stop int, cut string"


def depth_of(similarity: np.ndarray, reach: int) -> np.ndarray:
    """Depth of each point below the highest ones within ``reach`` on its two sides."""
    if not len(similarity):
        return similarity
    wide = np.pad(similarity, reach, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(wide, reach + 1)
    n = len(similarity)
    return view[:n].max(axis=1) + view[reach : reach + n].max(axis=1) - 2 * similarity


def motion_depth(x: np.ndarray) -> np.ndarray:
    """Valley depth at the gap before each record, of blocks of motion."""
    x = np.where(np.isfinite(x), x, 0).astype(np.float64).clip(-10, 10)
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)
    run = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
    gap = np.arange(len(x))
    before, after = run[gap] - run[np.maximum(gap - SIDE, 0)], run[np.minimum(gap + SIDE, len(x))] - run[gap]
    norm = np.sqrt((before**2).sum(axis=1) * (after**2).sum(axis=1))
    return depth_of(np.where(norm > 0, (before * after).sum(axis=1) / np.maximum(norm, 1e-12), 1.0), 2 * SIDE)


def event_similarity(gaps: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Similarity of the blocks around sorted gaps, by the events their records lie in."""

    def inside(a, b):
        n = np.clip(np.minimum(b[:, None], last) - np.maximum(a[:, None], first), 0, None).astype(np.float64)
        return np.hstack([n, np.clip(SIDE - n.sum(axis=1, keepdims=True), 0, None)])

    before, after = inside(gaps - SIDE, gaps), inside(gaps, gaps + SIDE)
    norm = np.sqrt((before**2).sum(axis=1) * (after**2).sum(axis=1))
    return (before * after).sum(axis=1) / np.maximum(norm, 1e-12)


def cut(n: int, bounds: dict[int, float], starts: dict[int, float], limit: int = LIMIT, overlap: int = OVERLAP, depth: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """(start, stop, what it was cut at) of the pieces of ``n`` records; positions map to depths,
    ``depth`` is that of the gap before each record, where known."""
    kinds = [(name, np.array(sorted(p), np.int64), p) for name, p in (("event", bounds), ("start", starts))]
    out, at = [], 0
    while n - at > limit:
        found = None
        for name, sorted_at, deep in kinds:
            a, b = np.searchsorted(sorted_at, [at + overlap + 1, at + limit + 1])
            if b > a:  # of equally deep ones the last
                found = max((deep[p], p) for p in sorted_at[a:b].tolist())[1], name
                break
        if found is None and depth is not None:
            low = at + overlap + 1
            window = depth[low : at + limit + 1]  # there is a record at the limit, as more than that are left
            if window.max() > FLAT:
                found = low + len(window) - 1 - int(window[::-1].argmax()), "valley"
        stop, name = found or (at + limit, "limit")
        out.append((at, stop, name))
        at = stop - overlap
    out.append((at, n, "end"))
    return out


def pieces_of(n: int, starts, fps: float | None, events, depth, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    rate = fps if fps and np.isfinite(fps) and fps > 0 else FPS
    spans = []
    for e in events or ():
        if e and e["start_time"] is not None and e["end_time"] is not None and np.isfinite([e["start_time"], e["end_time"]]).all():
            a, b = (int(np.clip(np.rint(np.float64(e[k]) * rate), -1, n + 1)) for k in ("start_time", "end_time"))
            spans.append((a, b))
    marks = np.array(sorted({p for s in spans for p in s if 0 < p < n}), np.int64)
    grid = np.array(sorted({s for s in starts or () if s is not None and 0 < s < n}), np.int64)
    if depth is not None and len(depth) == n:
        depth = np.asarray(depth)
        return cut(n, dict(zip(marks.tolist(), depth[marks].tolist())), dict(zip(grid.tolist(), depth[grid].tolist())), limit, overlap, depth)
    gaps = np.unique(np.r_[marks, grid, np.arange(GRID, n, GRID)]).astype(np.int64)
    real = np.array([s for s in spans if s[1] > s[0]], np.int64).reshape(-1, 2)
    # in stretches of gaps, so that a long clip with many events needs little memory
    if len(real):
        parts = np.array_split(gaps, max(1, len(gaps) * len(real) // 2_000_000 + 1))
        similar = np.concatenate([event_similarity(g, real[:, 0], real[:, 1]) for g in parts])
        deep = dict(zip(gaps.tolist(), depth_of(similar, 2 * SIDE // GRID).tolist()))
    else:
        deep = dict.fromkeys(gaps.tolist(), 0.0)
    return cut(n, {int(m): deep[int(m)] for m in marks}, {int(g): deep[int(g)] for g in grid}, limit, overlap)


def newest_plans(plans: DataFrame) -> DataFrame:
    """(clip_id, num_frames, starts) of each clip's newest row without error."""
    good = plans.where("error is null and clip_id is not null")
    best = good.groupBy("clip_id").agg(F.max(F.struct("planned_at", "num_frames", "starts")).alias("b"))
    return best.select("clip_id", "b.num_frames", "b.starts")


def pieces(umr: DataFrame, plans: DataFrame, events: DataFrame, recordings: DataFrame, sources: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every clip of both tables longer than ``limit``.

    Wide motion is reduced to one depth per record where it is read; only oversized items
    meet their events, plans and rates.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    own = F.when(F.col("features").isNotNull(), F.floor(F.size("features") / WIDTH)).otherwise(F.col("num_records")).cast("int")
    long_umr = umr.where("rec_id is not null").withColumn("n", own).where(F.col("n") > limit).select("rec_id", F.col("row_id").alias("row_key"), "n", "fps", "features")

    def deepen(batches):
        for batch in batches:
            column = batch.column("features")
            off, ok, v = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), column.values.to_numpy(zero_copy_only=False)
            for i in range(len(batch)):
                fits = ok[i] and off[i + 1] > off[i] and (off[i + 1] - off[i]) % WIDTH == 0
                depth = motion_depth(v[off[i] : off[i + 1]].reshape(-1, WIDTH)) if fits else None
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("rec_id", "row_key", "n", "fps")), pa.array([depth], pa.list_(pa.float64()))], ["rec_id", "row_key", "n", "fps", "depth"])

    newest = newest_plans(plans)
    from_umr = (
        long_umr.mapInArrow(deepen, "rec_id string, row_key long, n int, fps double, depth array<double>")
        .join(newest.select(F.col("clip_id").alias("rec_id"), "starts"), "rec_id", "left")
        .select(F.lit("umr_release").alias("table_name"), F.col("rec_id").alias("item_id"), "row_key", "n", "fps", "starts", "depth")
    )
    from_plans = newest.where(F.col("num_frames") > limit).select(
        F.lit("clip_plans").alias("table_name"), F.col("clip_id").alias("item_id"), F.lit(None).cast("long").alias("row_key"), F.col("num_frames").alias("n"), F.lit(None).cast("double").alias("fps"), "starts", F.lit(None).cast("array<double>").alias("depth")
    )
    tracks = events.where("rec_id is not null").groupBy("rec_id").agg(F.max_by("events", "line_no").alias("events")).withColumnRenamed("rec_id", "item_id")
    rate = F.when(F.col("fps") > 0, F.col("fps"))
    rates = (
        recordings.where("rec_id is not null")
        .groupBy(F.col("rec_id").alias("item_id"))
        .agg(F.max(rate).alias("rec_fps"), F.max("source").alias("source"))
        .join(sources.groupBy("source").agg(F.max("nominal_fps").alias("nominal_fps")), "source", "left")
        .select("item_id", F.coalesce("rec_fps", "nominal_fps").alias("rec_fps"))
    )
    items = from_umr.unionByName(from_plans).join(tracks, "item_id", "left").join(rates, "item_id", "left")
    items = items.select("table_name", "item_id", "row_key", "n", F.coalesce(rate, "rec_fps").alias("fps"), "starts", "events", "depth")

    def work(batches):
        for batch in batches:
            rows = []
            depths = batch.column("depth")
            for i, r in enumerate(batch.drop_columns("depth").to_pylist()):
                r["depth"] = depths[i].values.to_numpy(zero_copy_only=False) if depths[i].is_valid else None
                for k, (a, b, what) in enumerate(pieces_of(r["n"], r["starts"], r["fps"], r["events"], r["depth"], limit, overlap)):
                    rows.append({"table_name": r["table_name"], "item_id": r["item_id"], "row_key": r["row_key"], "piece": k, "start": a, "stop": b, "cut": what})
            if rows:
                i32, s = pa.int32(), pa.string()
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("table_name", s), ("item_id", s), ("row_key", pa.int64()), ("piece", i32), ("start", i32), ("stop", i32), ("cut", s)]))

    return items.mapInArrow(work, PIECES)


def sound(cut_up: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(table_name, item_id, row_key, length, sound): do an item's pieces cover it from 0 on,
    none above the limit, each with ``overlap`` records of the one before?

    A piece is held against the next by its number: no order, no window.
    """
    key = ["table_name", "item_id", "row_key", "piece"]
    before = cut_up.select(*key[:3], (F.col("piece") + 1).alias("piece"), F.col("stop").alias("before"))
    on = F.expr(" and ".join(f"a.{k} <=> b.{k}" for k in key))
    both = cut_up.alias("a").join(before.alias("b"), on, "left").select(*(f"a.{k}" for k in key), "start", "stop", "before")
    fits = (F.col("stop") > F.col("start")) & (F.col("stop") - F.col("start") <= limit) & F.when(F.col("piece") == 0, F.col("start") == 0).otherwise(F.coalesce((F.col("start") == F.col("before") - overlap) & (F.col("stop") > F.col("before")), F.lit(False)))
    return both.groupBy(*key[:3]).agg(F.max("stop").alias("length"), F.bool_and(fits).alias("sound"))
