"""Skeleton trees: order, template offsets and forward kinematics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def order_of(parents: list[int]) -> list[int]:
    """Joints so that each follows its parent; an error when the parents form no tree."""
    children: dict[int, list[int]] = {}
    for j, p in enumerate(parents):
        if not -1 <= p < len(parents):
            raise ValueError(f"joint {j} has no such parent: {p}")
        children.setdefault(p, []).append(j)
    if len(children.get(-1, [])) != 1:
        raise ValueError("a skeleton has exactly one root")
    out = list(children[-1])
    for j in out:
        out += children.get(j, [])
    if len(out) != len(parents):
        raise ValueError("the parents form a cycle")
    return out


def offsets(rest: DataFrame) -> DataFrame:
    """(joint, parent, dx, dy, dz) from rest positions (joint, parent, x, y, z); the root keeps its own."""
    up = rest.select(F.col("joint").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in "xyz"))
    return rest.join(up, "parent", "left").select("joint", "parent", *((F.col(c) - F.coalesce(f"p_{c}", F.lit(0.0))).alias(f"d{c}") for c in "xyz"))


def write_template(rest: DataFrame, path: str) -> None:
    """Keep a skeleton, rest positions (joint, parent, x, y, z), as (joint, parent, dx, dy, dz)."""
    offsets(rest).coalesce(1).write.mode("overwrite").parquet(path)


def read_template(spark: SparkSession, path: str) -> tuple[list[int], np.ndarray]:
    """Parents and offsets [J, 3] of a kept skeleton; an error if its parents form no tree."""
    rows = spark.read.parquet(path).orderBy("joint").limit(1 << 12).collect()
    if [r.joint for r in rows] != list(range(len(rows))):
        raise ValueError("the joints are not numbered from 0")
    parents = [r.parent for r in rows]
    order_of(parents)
    return parents, np.array([[r.dx, r.dy, r.dz] for r in rows], np.float64).reshape(-1, 3)


def forward(parents: list[int], offset: np.ndarray, turns: np.ndarray, root: np.ndarray) -> np.ndarray:
    """World positions [T, J, 3] of local rotations [T, J, 3, 3] and root positions [T, 3]."""
    t, j = turns.shape[:2]
    world, place = np.empty((t, j, 3, 3)), np.empty((t, j, 3))
    for k in order_of(parents):
        p = parents[k]
        if p < 0:
            world[:, k], place[:, k] = turns[:, k], root
        else:
            world[:, k] = world[:, p] @ turns[:, k]
            place[:, k] = place[:, p] + world[:, p] @ offset[k]
    return place


def rotations_of_rot6d(x: np.ndarray) -> np.ndarray:
    """Gram-Schmidt of [..., 6] to [..., 3, 3], columns first."""
    a, b = x[..., :3].astype(np.float64), x[..., 3:].astype(np.float64)
    a = a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-8)
    b = b - (a * b).sum(axis=-1, keepdims=True) * a
    b = b / np.maximum(np.linalg.norm(b, axis=-1, keepdims=True), 1e-8)
    return np.stack([a, b, np.cross(a, b)], axis=-1)


def posed(clips: DataFrame, key: str, rot6d: str, root: str, parents: list[int], offset: np.ndarray) -> DataFrame:
    """(key, joints): flat world positions of clips of flat rot6d per joint and flat root positions.

    Clips whose arrays do not fit the skeleton give null.
    """
    kind, j = clips.schema[key].dataType.simpleString(), len(parents)

    def work(batches):
        for batch in batches:
            out = []
            for r, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if r is None or p is None or len(r) % (6 * j) or len(p) * 2 * j != len(r):
                    out.append(None)
                    continue
                turns = rotations_of_rot6d(np.array(r, np.float64).reshape(-1, j, 6))
                out.append(forward(parents, offset, turns, np.array(p, np.float64).reshape(-1, 3)).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "joints"])

    return clips.select(key, rot6d, root).mapInArrow(work, f"`{key}` {kind}, joints array<double>")
