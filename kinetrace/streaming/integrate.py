"""Stateful streams: decoding records one by one, running moments, codebook updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "rec_id string, t int, x double, y double, z double, missing int"
STATE = "last int, x double, z double, waiting binary"
POSES = "rec_id string, frame int, transl array<double>, poses array<double>, contacts array<double>, missing int"
POSE_STATE = "last int, place array<double>, waiting binary"


def steps(readings: DataFrame) -> DataFrame:
    """(rec_id, t, dx, dz, y): floor step of each record, half from its own frame, half from the world's."""
    from ..functions import rotation as R
    from ..functions.vectors import at

    def moved(angle):
        lx, lz = R.out_of_heading(at(F.col("root_traj"), 0), at(F.col("root_traj"), 1), angle)
        return F.struct(*((0.5 * a + 0.5 * at(F.col("root_traj"), i)).alias(n) for a, i, n in ((lx, 2, "dx"), (lz, 3, "dz"))))

    step = R.let(R.yaw(R.matrix_of_rot6d(F.col("root_rot6d"))), moved)
    return readings.select("rec_id", "t", step["dx"].alias("dx"), step["dz"].alias("dz"), at(F.col("root_traj"), 4).alias("y"))


def in_turn(last: int, rows: np.ndarray, give_up: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Of records (number first, in the order they came): those whose turn it is after
    ``last``, those that wait, and how many are given up before the first.

    Of records with one number the first to come counts; one seen before is dropped.
    """
    _, first = np.unique(rows[:, 0], return_index=True)
    rows = rows[first]
    rows = rows[rows[:, 0] > last]
    if not len(rows):
        return rows, rows, 0
    missing = int(rows[0, 0]) - last - 1 if give_up else 0
    there = rows[:, 0] == last + 1 + missing + np.arange(len(rows))
    k = len(rows) if there.all() else int(there.argmin())
    return rows[:k], rows[k:], missing if k else 0


def _waiting(raw: bytes | None, width: int) -> np.ndarray:
    return np.frombuffer(raw or b"").reshape(-1, width)


def _settle(state: GroupState, values: tuple, now: np.ndarray, waiting: np.ndarray, patience: int | None) -> None:
    """Keep the state; a recording silent for its ``patience`` with nothing left to give is closed."""
    if patience is not None and state.hasTimedOut and not len(now) and not len(waiting):
        state.remove()
        return
    state.update((*values, np.ascontiguousarray(waiting).tobytes()))
    if patience is not None:
        state.setTimeoutDuration(patience)


def integrate(patience: int | None = None):
    """Positions of the records of one recording, as a stateful function.

    Records may come in any order: one ahead of its turn waits in the state until all before
    it are there, or, with ``patience`` (milliseconds without a record of this recording),
    until the missing ones are given up: their number stands at the record that follows, and
    their steps count as none.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, x, z, raw = state.get if state.exists else (-1, 0.0, 0.0, b"")
        came = [_waiting(raw, 4)] if state.hasTimedOut else [_waiting(raw, 4), *(p[["t", "dx", "dz", "y"]].to_numpy(np.float64) for p in batches)]
        now, waiting, missing = in_turn(last, np.concatenate(came), state.hasTimedOut)
        if len(now):
            xs, zs = x + np.cumsum(now[:, 1]), z + np.cumsum(now[:, 2])
            last, x, z = int(now[-1, 0]), float(xs[-1]), float(zs[-1])
        _settle(state, (last, x, z), now, waiting, patience)
        if len(now):
            yield pd.DataFrame({"rec_id": key[0], "t": now[:, 0].astype(np.int32), "x": xs, "y": now[:, 3], "z": zs, "missing": np.r_[missing, np.zeros(len(now) - 1)].astype(np.int32)})

    return run


def decoded_stream(step_stream: DataFrame, patience: int | None = None) -> DataFrame:
    """Positions from a stream of ``steps``; restartable from its checkpoint."""
    kind = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout
    return step_stream.groupBy("rec_id").applyInPandasWithState(integrate(patience), OUT, STATE, "append", kind)


ANCHOR = {"init_root_pos": 3, "init_root_rot6d": 6, "init_joints76_rot6d": 456}


def decode_poses(patience: int | None = None):
    """Frames of one recording, as a stateful function: a record gives the frame after it.

    The first record in turn brings the anchor, which is frame 0; from then on the frame just
    decoded is the anchor of the next.  Order and ``patience`` are as in ``integrate``.
    """
    from ..catalog import RECORD_WIDTH
    from ..kernels import motion

    own = RECORD_WIDTH + sum(ANCHOR.values())

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, place, raw = state.get if state.exists else (-1, None, b"")
        came = [_waiting(raw, own + 1)]
        for p in batches if not state.hasTimedOut else ():
            if len(p):
                came.append(np.column_stack([p["t"].to_numpy(np.float64), *(np.stack(p[c].to_numpy()) for c in ("features", *ANCHOR))]))
        now, waiting, missing = in_turn(last, np.concatenate(came), state.hasTimedOut)
        out = None
        if len(now):
            features, rest = now[:, 1 : RECORD_WIDTH + 1], now[0, RECORD_WIDTH + 1 :]
            first = place is None
            m, path, down = motion.decode(features, rest[:3] if first else np.array(place), rest[3:9], rest[9:])
            skip = 0 if first else 1
            last, place = int(now[-1, 0]), path[-1].tolist()
            frame = np.r_[now[0, 0], now[:, 0] + 1].astype(np.int32)
            gone = np.zeros(len(frame), np.int32)
            gone[1] = missing
            out = pd.DataFrame({"rec_id": key[0], "frame": frame, "transl": list(path), "poses": list(motion.axis_angles(m).reshape(len(m), -1)), "contacts": list(down), "missing": gone})[skip:]
        _settle(state, (last, place), now, waiting, patience)
        if out is not None:
            yield out

    return run


def poses_stream(records: DataFrame, patience: int | None = None) -> DataFrame:
    """``POSES`` of a stream of records (rec_id, t, features and the recording's anchor, all of their widths)."""
    fits = F.col("t").isNotNull() & (F.size("features") == 499)
    for name, width in ANCHOR.items():
        fits = fits & (F.size(name) == width)
    kind = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout
    return records.where(fits).groupBy("rec_id").applyInPandasWithState(decode_poses(patience), POSES, POSE_STATE, "append", kind)


def decoded_batch(step_table: DataFrame) -> DataFrame:
    """The same as a batch query."""
    from ..operators.temporal import running_sums

    return running_sums(step_table, "rec_id", "t", ["dx", "dz"]).select("rec_id", "t", F.col("s_dx").alias("x"), "y", F.col("s_dz").alias("z"))


def running_moments(stream: DataFrame, by: list[str], x: str) -> DataFrame:
    """Count, mean and deviation that a stream keeps up to date."""
    return stream.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.sqrt(F.var_pop(x) + 1e-8).alias("std"))


def equivalence(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: root mean square distance in millimetres of two decodings, and how many frames match."""
    j = one.alias("a").join(other.alias("b"), ["rec_id", "t"])
    d = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "yz"), (F.col("a.x") - F.col("b.x")) ** 2)
    return j.agg((F.sqrt(F.avg(d / 3)) * 1000).alias("trans_rmse_mm"), F.count("*").alias("frames"))


def pose_equivalence(streamed: DataFrame, offline: DataFrame) -> DataFrame:
    """(rec_id, frames, feat_rmse, trans_rmse_mm, rot_rmse): streamed frames against the whole
    clips (rec_id, poses, transl) decoded at once, by rotation vectors, positions and angles."""
    import pyarrow as pa

    from ..kernels.motion import axis_angles, matrices

    frames = F.floor(F.size("transl") / 3).cast("int")
    each = F.transform(F.sequence(F.lit(0), frames - 1), lambda k: F.struct(k.alias("frame"), F.slice("transl", k * 3 + 1, 3).alias("p"), F.slice("poses", k * 231 + 1, 231).alias("r")))
    whole = offline.where("size(transl) >= 3").select("rec_id", F.explode(each).alias("f")).select("rec_id", "f.frame", "f.p", "f.r")
    both = streamed.select("rec_id", "frame", F.col("transl").alias("sp"), F.col("poses").alias("sr")).join(whole, ["rec_id", "frame"]).select("rec_id", "sp", "p", "sr", "r")

    def squares(batches):
        for batch in batches:
            sp, p, sr, r = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in ("sp", "p", "sr", "r"))
            a, b = (matrices(x.reshape(-1, 3)) for x in (sr, r))
            angle = np.linalg.norm(axis_angles(np.swapaxes(a, 1, 2) @ b), axis=-1).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), *(pa.array((x**2).mean(axis=1)) for x in (sp - p, sr - r, angle))], ["rec_id", "p", "r", "g"])

    per = both.mapInArrow(squares, "rec_id string, p double, r double, g double").groupBy("rec_id")
    return per.agg(F.count("*").alias("frames"), F.sqrt(F.avg("r")).alias("feat_rmse"), (F.sqrt(F.avg("p")) * 1000).alias("trans_rmse_mm"), F.sqrt(F.avg("g")).alias("rot_rmse"))


def update_codebook(stream: DataFrame, key: str, vector: str, start: DataFrame, folder: str, momentum: float = 0.99):
    """A stream writer that averages each batch of vectors into a codebook.

    ``start`` has (code, vec).  Version k, after batch k, is a Parquet folder of its own under
    ``folder`` with the codebook and its running sums and counts (code, dim, total, size, c),
    so a batch that runs again writes the same version again.
    """
    from ..operators import codes, matching, stats

    spark = stream.sparkSession
    codes.fresh(stats.exploded(start, ["code"], "vec").withColumnRenamed("x", "c")).write.mode("overwrite").parquet(f"{folder}/v=-1")

    def batch(df: DataFrame, number: int) -> None:
        state = spark.read.parquet(f"{folder}/v={number - 1}")
        good = df.where(F.col(vector).isNotNull())
        assigned = matching.quantized(good, key, vector, [matching.codebook(*codes.as_book(state))])
        codes.updated(state, assigned, stats.exploded(good, [key], vector), key, momentum).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.select(key, vector).writeStream.foreachBatch(batch)
