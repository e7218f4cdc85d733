"""Recordings to feature records and back (NumPy, one clip at a time).

Positions are metres [T, 77, 3], rotations axis-angle vectors [T, 77, 3]; a record
describes the step into its frame, so T frames give T - 1 records.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..catalog import slices
from ..operators.skeleton import rotations_of_rot6d
from .signal import quaternions, resample, rotation_vectors, slerp

FPS = 50.0
# Joints that give the facing direction (right hip, left hip, right shoulder, left shoulder).
FACING = (72, 67, 40, 12)
# Feet whose contact is derived (left foot, left toe base, right foot, right toe base).
FEET = (69, 70, 74, 75)
# Joints whose velocity is kept.
KEYS = (3, 6, 14, 42, 69, 70, 74, 75)
# Fixed values of the format: the bound below which a foot is down, the horizons of the rates, and
# the share the decoder takes of local and of world steps.
CONTACT = 0.002  #: squared displacement, in square metres a frame, below which a foot is down
HORIZONS = (0.2, 0.4)  #: seconds
SHARE = 0.5


@dataclass
class Clip:
    features: np.ndarray  #: [T - 1, 499]
    root_pos: np.ndarray  #: of frame 0, [3]
    root_rot6d: np.ndarray  #: of frame 0, [6]
    joints_rot6d: np.ndarray  #: of frame 0, [76, 6]
    joints: np.ndarray  #: canonical positions [T, 77, 3]


def matrices(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of axis-angle vectors."""
    w, x, y, z = np.moveaxis(quaternions(v.astype(np.float64)), -1, 0)
    rows = (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))
    return np.stack(rows, axis=-1).reshape(*v.shape[:-1], 3, 3)


def axis_angles(m: np.ndarray) -> np.ndarray:
    """Axis-angle vectors of rotation matrices, by the largest quaternion component."""
    d = np.einsum("...ii->...i", m)
    t = d.sum(axis=-1, keepdims=True)
    four = np.concatenate([1 + t, 1 - t + 2 * d], axis=-1)
    a, b, c = m[..., 2, 1] - m[..., 1, 2], m[..., 0, 2] - m[..., 2, 0], m[..., 1, 0] - m[..., 0, 1]
    e, f, g = m[..., 1, 0] + m[..., 0, 1], m[..., 0, 2] + m[..., 2, 0], m[..., 2, 1] + m[..., 1, 2]
    table = np.stack([np.stack(r, axis=-1) for r in ((four[..., 0], a, b, c), (a, four[..., 1], e, f), (b, e, four[..., 2], g), (c, f, g, four[..., 3]))], axis=-2)
    k = four.argmax(axis=-1)
    q = np.take_along_axis(table, k[..., None, None], axis=-2)[..., 0, :]
    return rotation_vectors(q / np.linalg.norm(q, axis=-1, keepdims=True))


def rot6d(m: np.ndarray) -> np.ndarray:
    return np.concatenate([m[..., :, 0], m[..., :, 1]], axis=-1)


def headings(root: np.ndarray) -> np.ndarray:
    return np.arctan2(root[:, 0, 2], root[:, 2, 2])


def turned(x: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Vectors [T, ..., 3] in frames turned by ``angle`` around the vertical."""
    shape = (-1, *([1] * (x.ndim - 2)))
    c, s = np.cos(angle).reshape(shape), np.sin(angle).reshape(shape)
    return np.stack([c * x[..., 0] - s * x[..., 2], x[..., 1], s * x[..., 0] + c * x[..., 2]], axis=-1)


def canonical(joints: np.ndarray, rotations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floor at 0, root of frame 0 above the origin, facing +Z; the root's rotations turned along."""
    x = joints.astype(np.float64).copy()
    x[..., 1] -= x[..., 1].min()
    x -= x[0, 0] * np.array([1.0, 0.0, 1.0])
    hip_r, hip_l, shoulder_r, shoulder_l = (x[0, j] for j in FACING)
    across = hip_r - hip_l + shoulder_r - shoulder_l
    facing = np.cross([0.0, 1.0, 0.0], across)
    angle = np.arctan2(facing[0], facing[2])
    x = turned(x, np.full(len(x), angle))
    r = rotations.astype(np.float64).copy()
    lift = matrices(np.array([0.0, -angle, 0.0]))
    r[:, 0] = axis_angles(lift @ matrices(r[:, 0]))
    return x, r


def horizon(seconds: float, fps: float) -> int:
    return max(1, int(round(seconds * fps)))


def contacts(x: np.ndarray, most: float = CONTACT) -> np.ndarray:
    return ((np.diff(x[:, FEET], axis=0) ** 2).sum(axis=-1) < most).astype(np.float64)


def encode(joints: np.ndarray, rotations: np.ndarray, fps: float, target: float = FPS) -> Clip:
    """Feature records of a recording, brought to ``target`` frames a second."""
    if len(joints) < 2 or len(joints) != len(rotations):
        raise ValueError("a recording needs two frames at least, with as many rotations")
    if abs(fps - target) > 1e-6:
        joints = resample(joints.astype(np.float64), fps, target)
        rotations = slerp(rotations, fps, target, len(joints))
    if len(joints) < 2:
        raise ValueError("too few frames are left after resampling")
    x, r = canonical(joints, rotations)
    m = matrices(r)
    angle, floor = headings(m[1:, 0]), [0, 2]
    step = np.diff(x, axis=0)
    out = np.empty((len(x) - 1, 499))
    out[:, 0:2] = turned(step[:, 0], angle)[:, floor]
    out[:, 2:4] = step[:, 0][:, floor]
    out[:, 4] = x[1:, 0, 1]
    t = np.arange(1, len(x))
    for k, seconds in enumerate(HORIZONS):
        before = np.maximum(0, t - horizon(seconds, target))
        out[:, 5 + 2 * k : 7 + 2 * k] = (x[t, 0] - x[before, 0])[:, floor] / (t - before)[:, None]
    at = slices()
    fields = {"root_rot6d": rot6d(m[1:, 0]), "joints76_rot6d": rot6d(m[1:, 1:]), "sparse_vel": turned(step[:, KEYS], angle), "foot_contact": contacts(x)}
    for name, value in fields.items():
        start, width = at[name]
        out[:, start : start + width] = value.reshape(len(out), width)
    return Clip(out, x[0, 0], rot6d(m[0, 0]), rot6d(m[0, 1:]), x)


def fk_losses(pred: np.ndarray, true: np.ndarray, down: np.ndarray) -> dict[str, float]:
    """Mean distances per axis of joints [T, 77, 3], their steps and second differences, and the
    movement of feet that the records [T - 1, 4] say are down."""

    def mean(k):
        d = np.diff(pred, k, axis=0) - np.diff(true, k, axis=0) if k else pred - true
        return float(np.abs(d).mean()) if d.size else float("nan")

    moved = np.abs(np.diff(pred[:, FEET], axis=0)).sum(axis=-1)
    return {"fk_joint": mean(0), "fk_vel": mean(1), "fk_acc": mean(2), "skate": float((moved * down).sum() / (down.sum() * 3 + 1e-6))}


def decode(features: np.ndarray, root_pos: np.ndarray, root_rot6d: np.ndarray, joints_rot6d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation matrices [T, 77, 3, 3], root positions [T, 3] and contacts [T, 4] of records."""
    at, n = slices(), len(features)
    field = {k: features[:, a : a + w].astype(np.float64) for k, (a, w) in at.items()}
    turns = np.concatenate([field["root_rot6d"][:, None], field["joints76_rot6d"].reshape(n, 76, 6)], axis=1)
    first = np.concatenate([np.reshape(root_rot6d, (1, 6)), np.reshape(joints_rot6d, (76, 6))])
    m = rotations_of_rot6d(np.concatenate([first[None], turns]))
    traj = field["root_traj"]
    flat = np.zeros((n, 3))
    flat[:, [0, 2]] = traj[:, 0:2]
    local = turned(flat, -headings(m[1:, 0]))[:, [0, 2]]
    place = np.empty((n + 1, 3))
    place[0] = root_pos
    place[1:, [0, 2]] = place[0, [0, 2]] + np.cumsum(SHARE * local + (1 - SHARE) * traj[:, 2:4], axis=0)
    place[1:, 1] = traj[:, 4]
    down = np.clip(field["foot_contact"], 0, 1)
    return m, place, np.concatenate([down[:1], down])
