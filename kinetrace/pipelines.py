"""Whole jobs: recordings to clips, clips to windows, statistics, token targets, evaluation.

Each takes and returns tables; parameters are checked before any plan is built.  A bad
clip becomes a row with an ``error``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import BODY22, RECORD_WIDTH, slices
from .kernels import motion
from .operators import metrics, stats
from .operators.matching import first_event
from .plans import windows
from .shared import materialize as keep
from .sources import files

CLIP = "rec_id string, num_records int, fps double, features array<float>, init_root_pos array<float>, init_root_rot6d array<float>, init_joints76_rot6d array<float>, joints77_pos array<float>, error string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def rows_of(batch: pa.RecordBatch):
    """The rows as dicts, arrays as NumPy views."""
    for i in range(len(batch)):
        yield {name: (v.values.to_numpy(zero_copy_only=False) if pa.types.is_list(v.type) and v.is_valid else v.as_py()) for name, v in ((n, batch.column(k)[i]) for k, n in enumerate(batch.schema.names))}


def convert(recordings: DataFrame, target: float = motion.FPS) -> DataFrame:
    """Feature clips of recordings (rec_id, fps, joints array of T*231, poses array of T*231)."""
    if not target > 0:
        raise ValueError("the rate must be positive")

    def one(r: dict) -> dict:
        x, v = (np.array(r[c], np.float64).reshape(-1, 77, 3) for c in ("joints", "poses"))
        if not (np.isfinite(x).all() and np.isfinite(v).all()):
            raise ValueError("non-finite values")
        c = motion.encode(x, v, r["fps"] if r["fps"] and r["fps"] > 0 else 30.0, target)
        flat = {"features": c.features, "init_root_pos": c.root_pos, "init_root_rot6d": c.root_rot6d, "init_joints76_rot6d": c.joints_rot6d, "joints77_pos": c.joints}
        return {"num_records": len(c.features), "fps": target, "error": None} | {k: a.astype(np.float32).ravel() for k, a in flat.items()}

    def work(batches):
        for batch in batches:
            for r in rows_of(batch):
                try:
                    row = one(r)
                except Exception as e:  # any bad recording is a row
                    row = {"error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([{"rec_id": r["rec_id"]} | row], schema=_arrow(CLIP))

    return recordings.select("rec_id", "fps", "joints", "poses").mapInArrow(work, CLIP)


def decode(clips: DataFrame) -> DataFrame:
    """(rec_id, poses, transl, foot_contacts) of feature clips, flat; clips that do not fit give an error."""
    schema = "rec_id string, poses array<double>, transl array<double>, foot_contacts array<double>, error string"

    def work(batches):
        for batch in batches:
            for r in rows_of(batch):
                try:
                    m, place, down = motion.decode(np.array(r["features"], np.float64).reshape(-1, RECORD_WIDTH), r["init_root_pos"], r["init_root_rot6d"], r["init_joints76_rot6d"])
                    row = {"poses": motion.axis_angles(m).ravel(), "transl": place.ravel(), "foot_contacts": down.ravel(), "error": None}
                except Exception as e:
                    row = {"error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([{"rec_id": r["rec_id"]} | row], schema=_arrow(schema))

    return clips.select("rec_id", "features", "init_root_pos", "init_root_rot6d", "init_joints76_rot6d").mapInArrow(work, schema)


def materialize(release: DataFrame, datasets: list[str] | None = None, ids: DataFrame | None = None, least: int = 2, done: DataFrame | None = None) -> DataFrame:
    """Release rows of some datasets and ids that are long enough and not yet done."""
    rows = release
    if datasets:
        rows = rows.where(F.expr("try_variant_get(try_parse_json(provenance_json), '$.dataset', 'string')").isin(datasets))
    if ids is not None:
        rows = rows.join(ids.select("rec_id").distinct(), "rec_id", "left_semi")
    if done is not None:
        rows = rows.join(done.select("rec_id").distinct(), "rec_id", "left_anti")
    n = F.size("features") / RECORD_WIDTH
    return rows.where(F.col("features").isNotNull() & (n == F.floor(n)) & (n >= least))


def export(release: DataFrame, folder: str, least: int = 2) -> DataFrame:
    """Write the clips of a release as files, with their captions and a manifest beside them.

    Clips go to ``<folder>/<rec_id>/clip.npz`` on a path all executors see, captions as JSON
    lines to ``<folder>/captions``, the ids of all written clips in order to
    ``<folder>/manifest``.  Returns (rec_id, path, error); of rows with one id the first counts.
    """
    rows = materialize(release, least=least).where("rec_id is not null")
    first = rows.groupBy("rec_id").agg(F.min("row_id").alias("row_id"))
    rows = rows.join(first, ["rec_id", "row_id"], "left_semi")
    spark = release.sparkSession
    done = keep(files.write_npz(rows, "rec_id", folder))
    written = done.where("error is null").select("rec_id")
    texts = rows.select("rec_id", F.coalesce("text", F.lit("")).alias("text")).join(written, "rec_id", "left_semi")
    texts.select(F.to_json(F.struct("rec_id", "text")).alias("value")).write.mode("overwrite").text(f"file://{folder}/captions")
    written.orderBy("rec_id").select(F.col("rec_id").alias("value")).coalesce(1).write.mode("overwrite").text(f"file://{folder}/manifest")
    return spark.read.schema(done.schema).parquet(done.inputFiles()[0].rsplit("/", 1)[0]) if done.inputFiles() else done


def write_metrics(per_clip: DataFrame, histograms: DataFrame, folder: str) -> None:
    """Raw metrics of an evaluation: a row per clip, and the code histograms they are rolled up from."""
    per_clip.write.mode("overwrite").parquet(f"{folder}/clips")
    histograms.write.mode("overwrite").parquet(f"{folder}/histograms")


def teacher_check(clips: DataFrame, teacher: Callable[[np.ndarray], np.ndarray], fps: float = 30.0, most: int = 300) -> DataFrame:
    """(row_id, frames, width, finite, norm) of what a teacher makes of every clip, brought to its
    rate along straight lines and cut to ``most`` frames."""
    schema = "row_id long, frames int, width int, finite boolean, norm double"

    def work(batches):
        for batch in batches:
            rows = []
            for k, rate, x in zip(batch.column("row_id").to_pylist(), batch.column("fps").to_pylist(), batch.column("features")):
                v = x.values.to_numpy(zero_copy_only=False).reshape(-1, RECORD_WIDTH)
                m = max(1, int(round(len(v) * fps / (rate if rate and rate > 0 else 50.0))))
                at = np.linspace(0, len(v) - 1, m)
                low = np.floor(at).astype(int)
                w = (at - low)[:, None]
                v = (v[low] * (1 - w) + v[np.minimum(low + 1, len(v) - 1)] * w)[:most]
                e = np.asarray(teacher(v), np.float64)
                rows.append({"row_id": k, "frames": len(v), "width": e.size, "finite": bool(np.isfinite(e).all()), "norm": float(np.linalg.norm(e))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row_id", pa.int64()), ("frames", pa.int32()), ("width", pa.int32()), ("finite", pa.bool_()), ("norm", pa.float64())]))

    fit = clips.where(F.col("features").isNotNull() & (F.size("features") > 0) & (F.size("features") % RECORD_WIDTH == 0))
    return fit.select("row_id", "fps", "features").mapInArrow(work, schema)


def fixed_windows(clips: DataFrame, width: int = 64, step: int = 32, cap: int = 64) -> DataFrame:
    """(row_id, rec_id, start, features): every window of every clip, cut from the clip's own row."""
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    cut = lambda at: F.struct(at.alias("start"), F.slice("features", at * RECORD_WIDTH + 1, width * RECORD_WIDTH).alias("features"))
    each = F.transform(windows.window_starts(n, width, step, cap), cut)  # cut first: no copy of the clip per window
    return clips.where("features is not null").select("row_id", "rec_id", F.explode(each).alias("w")).select("row_id", "rec_id", "w.start", "w.features")


def ragged_parts(clips: DataFrame, least: int = 48, most: int = 300, stride: int = 4) -> tuple[DataFrame, DataFrame]:
    """Index (row_id, rec_id, take, offset, row_no) and data (row_id, features) of the heads of
    all clips long enough.  Only the index is put in order; the wide heads stay where they are."""
    if not 0 < stride <= least <= most:
        raise ValueError("lengths must satisfy 0 < stride <= least <= most")
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    taken = clips.where("features is not null").withColumn("take", windows.take_length(n, least, most, stride)).where("take is not null")
    index = windows.running_offsets(taken.select("row_id", "rec_id", "take"), ["row_id"], "take")
    return index, taken.select("row_id", F.slice("features", F.lit(1), F.col("take") * RECORD_WIDTH).alias("features"))


def ragged(clips: DataFrame, least: int = 48, most: int = 300, stride: int = 4) -> DataFrame:
    """(row_id, rec_id, take, offset, row_no, features): the head of every clip long enough."""
    index, data = ragged_parts(clips, least, most, stride)
    return index.join(data, "row_id")


def crops(clips: DataFrame, width: int, seed: int = 0, fps: float = motion.FPS) -> DataFrame:
    """(row_id, start, features, joints77_pos, init_.., error): one random window of every clip, with the pose it starts from.

    The anchor of a window inside the clip is the pose of the record before it and the root's
    place in its first frame.  A clip of another rate, or too short, gives an error.
    """
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    error = (
        F.when(F.col("features").isNull() | F.col("joints77_pos").isNull(), "no features or positions")
        .when(~(F.abs(F.col("fps") - fps) <= 1e-3) | F.col("fps").isNull(), "other rate")
        .when(n < width, "too short")
        .when((F.size("features") != n * RECORD_WIDTH) | (F.size("joints77_pos") != (n + 1) * 231), "ragged")
    )
    rows = clips.select("*", error.alias("error"), windows.crop_start(F.col("row_id"), n, width, seed).alias("start"))
    s, fine = F.col("start"), F.col("error").isNull()
    before = (s - 1) * RECORD_WIDTH
    (turn, turn_width), (pose, pose_width) = (slices()[k] for k in ("root_rot6d", "joints76_rot6d"))

    def anchor(own, inside):
        return F.when(fine, F.when(s == 0, F.col(own)).otherwise(inside)).alias(own)

    return rows.select(
        "row_id",
        F.when(fine, s).alias("start"),
        F.when(fine, F.slice("features", s * RECORD_WIDTH + 1, width * RECORD_WIDTH)).alias("features"),
        F.when(fine, F.slice("joints77_pos", s * 231 + 1, (width + 1) * 231)).alias("joints77_pos"),
        anchor("init_root_pos", F.slice("joints77_pos", F.greatest(s, F.lit(0)) * 231 + 1, 3)),
        anchor("init_root_rot6d", F.slice("features", F.greatest(before, F.lit(0)) + turn + 1, turn_width)),
        anchor("init_joints76_rot6d", F.slice("features", F.greatest(before, F.lit(0)) + pose + 1, pose_width)),
        "error",
    )


def batch_crops(clips: DataFrame, batch: str, length: str, stride: int = 4, seed: int = 0, aligned: bool = False) -> DataFrame:
    """Adds (crop, start): every clip is cut to the shortest of its batch, a multiple of the
    stride; with ``aligned`` starts, too, are multiples of it, as tokens are."""
    least = clips.groupBy(batch).agg(F.min(length).alias("_least"))
    crop = F.greatest(F.floor(F.col("_least") / stride) * stride, F.lit(stride)).cast("int")
    step = stride if aligned else 1
    rows = clips.join(least, batch).withColumn("crop", crop).drop("_least")
    return rows.withColumn("start", F.coalesce(windows.crop_start(F.col("row_id"), F.col(length) - F.col("crop"), 0, seed, step), F.lit(0)))


def collated(rows: DataFrame, batch: str, place: str, columns: list[str]) -> DataFrame:
    """(batch, column..): the rows of each batch as arrays in the order of their places."""
    packed = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(place, *columns))).alias("_r"))  # as many as a batch holds

    def only(c):
        return F.transform("_r", lambda e: e[c]).alias(c)

    return packed.select(batch, *map(only, columns))


def tokens_of(clips: DataFrame, tokens: DataFrame, length: str = "take", stride: int = 4) -> DataFrame:
    """Clips (row_id, length) with their tokens (row_id, token, ..) in order, and whether there
    are as many as the length asks for: (row_id, n_tokens, complete, tokens)."""
    packed = tokens.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("token", *(c for c in tokens.columns if c not in ("row_id", "token"))))).alias("tokens"), F.count("*").alias("n_tokens"))
    rows = clips.select("row_id", length).join(packed, "row_id", "left")
    n = F.coalesce("n_tokens", F.lit(0))
    return rows.select("row_id", n.alias("n_tokens"), (n == F.floor(F.col(length) / stride)).alias("complete"), "tokens")


def outcomes(release: DataFrame, least: int, done: DataFrame) -> DataFrame:
    """(row_id, status): what a run does with each row: written, skipped (done before), short or failed."""
    n = F.size("features") / RECORD_WIDTH
    rows = release.select("row_id", "rec_id", "features").join(done.select(F.col("rec_id"), F.lit(True).alias("_done")).distinct(), "rec_id", "left")
    status = F.when(F.col("_done"), "skipped").when(F.col("features").isNull() | (n != F.floor(n)), "failed").when(n < least, "short").otherwise("written")
    return rows.select("row_id", status.alias("status"))


def look_up(table: DataFrame, ids: list[int], key: str = "row_id", most: int = 1 << 16) -> DataFrame:
    """Rows of a list of ids, each once, in any order; a list of up to ``most`` goes to every task."""
    wanted = table.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"`{key}` {table.schema[key].dataType.simpleString()}")
    return table.join(F.broadcast(wanted) if len(ids) <= most else wanted, key, "left_semi")


def normalization(clips: DataFrame, fps: float = motion.FPS) -> DataFrame:
    """(dim, n, mean, std) over clips of one rate; binary dimensions are left alone."""
    same = clips.where(F.abs(F.col("fps") - fps) <= 1e-3)
    return stats.packed(stats.wide_moments(same, [], "features", RECORD_WIDTH), slices()["foot_contact"][0])


def field_of(dim: F.Column) -> F.Column:
    """Name of the field a dimension lies in."""
    out = F.lit(None).cast("string")
    for name, (start, width) in slices().items():
        out = F.when((dim >= start) & (dim < start + width), name).otherwise(out)
    return out


def field_statistics(clips: DataFrame, by: list[str]) -> DataFrame:
    """(by, field, i, n, mean, std, rate): moments of every dimension under its field's name and
    its number there; of contacts the rate instead of the deviation."""
    m = stats.wide_moments(clips, by, "features", RECORD_WIDTH)
    start = F.create_map(*(x for name, (at, _) in slices().items() for x in (F.lit(name), F.lit(at))))
    m = m.withColumn("field", field_of(F.col("dim")))
    binary = F.col("field") == "foot_contact"
    return m.select(*by, "field", (F.col("dim") - start[F.col("field")]).cast("int").alias("i"), "n", "mean", F.when(~binary, F.col("std")).alias("std"), F.when(binary, F.col("mean")).alias("rate"))


def mean_pool(x: np.ndarray) -> np.ndarray:
    """Stand-in of a teacher: the mean record, of length one; zero below two records."""
    if len(x) < 2:
        return np.zeros(x.shape[1])
    v = np.nan_to_num(x.astype(np.float64)).mean(axis=0)
    return v / max(np.linalg.norm(v), 1e-12)


def token_targets(clips: DataFrame, events: DataFrame | None = None, teacher: Callable[[np.ndarray], np.ndarray] = mean_pool, stride: int = 4, width: int = 180, mode: str = "centred", group: int = 1) -> DataFrame:
    """(row_id, token, emb): an embedding per token, of its span.

    ``centred`` spans lie around the token (or the group's first token), ``block`` ones
    tile the clip, ``event`` ones are those of the first event the token lies in (null
    outside of all).  A span shared by several tokens is embedded once.
    """
    if mode not in ("centred", "block", "event"):
        raise ValueError(f"no such mode: {mode}")
    if (mode == "event") != (events is not None):
        raise ValueError("events go with the mode 'event', and only with it")
    if stride < 1 or width < 1 or group < 1:
        raise ValueError("stride, width and group must be positive")
    rows = clips.where("features is not null").select("row_id", "rec_id", "features", F.floor(F.size("features") / RECORD_WIDTH).cast("int").alias("n"), F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps"))
    if mode == "centred":
        spans = windows.token_spans(F.col("n"), stride, width, group)
    elif mode == "block":
        spans = F.transform(windows.token_blocks(F.col("n"), stride, width), lambda e: F.struct(e["token"].alias("token"), (e["block"] * width).alias("start"), F.least(F.col("n"), (e["block"] + 1) * width).alias("stop")))
    else:
        rows = rows.join(events.select("rec_id", "events"), "rec_id", "left")
        tokens = F.when(F.col("n") >= stride, F.sequence(F.lit(0), F.floor(F.col("n") / stride).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

        def span(g):
            e = F.get("events", first_event(F.col("events"), g * stride / F.col("fps")))
            inside = lambda c: F.greatest(F.lit(0), F.least(F.col("n"), F.rint(e[c] * F.col("fps")).cast("int")))
            frame = lambda c: F.when(e.isNotNull(), inside(c))
            return F.struct(g.alias("token"), frame("start_time").alias("start"), frame("end_time").alias("stop"))

        spans = F.transform(tokens, span)

    def work(batches):
        for batch in batches:
            for k, s, x in zip(batch.column("row_id").to_pylist(), batch.column("spans").to_pylist(), batch.column("features")):
                v = x.values.to_numpy(zero_copy_only=False).reshape(-1, RECORD_WIDTH)
                once = {key: teacher(v[key[0] : key[1]]) for key in {(e["start"], e["stop"]) for e in s if e["start"] is not None}}
                yield pa.RecordBatch.from_pylist([{"row_id": k, "token": e["token"], "emb": once.get((e["start"], e["stop"]))} for e in s], schema=_arrow("row_id long, token int, emb array<double>"))

    fit = rows.where(F.size("features") % RECORD_WIDTH == 0).select("row_id", spans.alias("spans"), "features")
    return fit.mapInArrow(work, "row_id long, token int, emb array<double>")


def evaluate(pairs: DataFrame, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Joint metrics per clip of (key, pred, gt), flat positions of 77 joints, and their
    summary over the corpus; both are cut to the shorter, clips under eight frames left out."""
    names = [n for n in metrics.joint_metrics(np.zeros((4, 2, 3)), np.zeros((4, 2, 3))) if n != "n_frames"]
    kind = pairs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            rows = []
            for i, (p, g) in enumerate(zip(batch.column("pred"), batch.column("gt"))):
                if p.values is None or g.values is None or len(p.values) % 231 or len(g.values) % 231:
                    continue
                p, g = (x.values.to_numpy(zero_copy_only=False).reshape(-1, 77, 3)[:, BODY22] for x in (p, g))
                if min(len(p), len(g)) >= 8:
                    rows.append({key: batch.column(key)[i].as_py()} | metrics.joint_metrics(p, g))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(key, batch.schema.field(key).type), *((n, pa.float64()) for n in names), ("n_frames", pa.int32())]))

    clips = pairs.select(key, "pred", "gt").mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names) + ", n_frames int")
    long = clips.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (metric, x)"))
    return clips, stats.summary(long, ["metric"])
