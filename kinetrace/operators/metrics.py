"""Reconstruction, geometry and motion metrics of paired readings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MM = 1000.0


def errors(pairs: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """(by, feat_mse, feat_mae, n) over paired values."""
    d = F.col(pred) - F.col(gt)
    return pairs.groupBy(*by).agg(F.avg(d * d).alias("feat_mse"), F.avg(F.abs(d)).alias("feat_mae"), F.count(d).alias("n"))


def f1(pred: Column, target: Column) -> Column:
    """F1 as an aggregate: predicted above 0, true above 0.5; 1 if nothing is positive at all."""
    p, t = pred > 0, target > 0.5
    tp, fp, fn = F.count_if(p & t), F.count_if(p & ~t), F.count_if(~p & t)
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    both = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return F.when(tp + fp + fn == 0, 1.0).otherwise(both)


def rmse_mm(d: list[Column]) -> Column:
    """Root of the mean square over all components, in millimetres, as an aggregate."""
    return F.sqrt(F.avg(sum((x * x for x in d[1:]), d[0] * d[0]) / len(d))) * MM


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def mean_distance_mm(a: list[Column], b: list[Column]) -> Column:
    return F.avg(distance(a, b)) * MM


def rotation_rmse(angle: Column, of: Column | None = None) -> Column:
    """Root mean square of angles between rotations, as an aggregate, of the rows that ``of`` names."""
    return F.sqrt(F.avg(angle * angle if of is None else F.when(of, angle * angle)))


def drift(path: Column, true_path: Column, same_shape: Column) -> Column:
    """How far a path's length is off; the length itself where there is no truth of the same shape."""
    return F.when(F.coalesce(same_shape, F.lit(False)), F.abs(path - true_path)).otherwise(path)


def nonfinite_share(x: Column) -> Column:
    """Share of NaN and infinite values among those present, as an aggregate."""
    return F.avg(F.when(x.isNull(), None).when(F.isnan(x) | (F.abs(x) == float("inf")), 1.0).otherwise(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def recall(rank: str, ks: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    """R@k as aggregates."""
    return [F.avg((F.col(rank) < k).cast("double")).alias(f"r_at_{k}") for k in ks]


def procrustes(pred: np.ndarray, gt: np.ndarray) -> np.ndarray:
    """``pred`` [T, J, 3] moved, turned and scaled onto ``gt`` frame by frame (least squares, no mirror)."""
    a, b = pred.astype(np.float64), gt.astype(np.float64)
    ca, cb = a.mean(axis=1, keepdims=True), b.mean(axis=1, keepdims=True)
    x, y = a - ca, b - cb
    u, s, vt = np.linalg.svd(np.einsum("tji,tjk->tik", x, y))
    mirror = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    s[:, 2] *= mirror
    u[:, :, 2] *= mirror[:, None]
    scale = s.sum(axis=1) / np.maximum((x**2).sum(axis=(1, 2)), 1e-12)
    return scale[:, None, None] * (x @ (u @ vt)) + cb


def joint_metrics(pred: np.ndarray, gt: np.ndarray) -> dict[str, float]:
    """Metrics of one clip of paired joints [T, J, 3] in metres; millimetres out.

    Differences a clip is too short for are NaN.
    """
    n = min(len(pred), len(gt))
    p, g = pred[:n].astype(np.float64), gt[:n].astype(np.float64)
    pl, gl = p - p[:, :1], g - g[:, :1]

    def mean(x):
        return float(np.linalg.norm(x, axis=-1).mean() * MM) if x.size else float("nan")

    def diff(x, k):
        return np.diff(x, k, axis=0)

    floor = [0, 2]
    out = {"mpjpe": mean(pl - gl), "pampjpe": mean(procrustes(p, g) - g) if n else float("nan")}
    for name, k in (("accel", 2), ("jerk", 3)):
        dp, dg = diff(pl, k), diff(gl, k)
        out |= {f"{name}_err": mean(dp - dg), f"{name}_pred": mean(dp), f"{name}_gt": mean(dg)}
    vp, vg = diff(p, 1), diff(g, 1)
    out |= {
        "ape_root": mean(p[:, 0] - g[:, 0]), "ape_traj": mean((p - g)[:, 0][:, floor]), "ape_pose": mean(pl - gl), "ape_joints": mean(p - g),
        "ave_root": mean((vp - vg)[:, 0]), "ave_traj": mean((vp - vg)[:, 0][:, floor]), "ave_pose": mean(diff(pl, 1) - diff(gl, 1)), "ave_joints": mean(vp - vg),
    }
    return out | {"n_frames": n}
