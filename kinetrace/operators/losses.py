"""Losses and schedules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def huber(d: Column, beta: float = 1.0) -> Column:
    return F.when(F.abs(d) < beta, 0.5 * d * d / beta).otherwise(F.abs(d) - 0.5 * beta)


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column, y: Column, positive: float = 1.0) -> Column:
    """Binary cross-entropy of a logit; positives weigh ``positive``."""
    return positive * y * softplus(-logit) + (1 - y) * softplus(logit)


def focal(logit: Column, y: Column, alpha: float = 0.5, gamma: float = 2.0) -> Column:
    p = 1 / (1 + F.exp(-logit))
    hit = y * p + (1 - y) * (1 - p)
    weight = alpha * y + (1 - alpha) * (1 - y)
    return weight * F.pow(1 - hit, F.lit(gamma)) * bce(logit, y)


def cosine_loss(cos: Column, present: Column | None = None) -> Column:
    """Mean of 1 - cos as an aggregate.  With ``present`` (one teacher vector a token) those
    without a teacher are masked, and the mean of none is 0."""
    if present is None:
        return F.avg(1 - cos)
    return F.coalesce(F.sum(F.when(present, 1 - cos)), F.lit(0.0)) / F.greatest(F.count_if(present), F.lit(1))


def orthogonality(first: list[Column], second: list[Column]) -> Column:
    """Square of the dot product of the two columns of a rot6d: 0 where they are at right angles."""
    dot = sum((x * y for x, y in zip(first[1:], second[1:])), first[0] * second[0])
    return dot * dot


def foot_skate(step: list[Column], contact: Column) -> Column:
    """Movement of feet in contact, per axis, as an aggregate; ``step`` is a foot's x, y, z difference."""
    moved = sum((F.abs(c) for c in step[1:]), F.abs(step[0]))
    return F.sum(contact * moved) / (F.sum(contact) * 3 + 1e-6)


def commitment(dist: Column, width: int) -> Column:
    """Mean square distance of vectors to their codes, per number, as an aggregate of squared distances."""
    return F.avg(dist / width)


def root_header(traj: Column, rot6d: Column, traj_weight: float = 1.0, rot_weight: float = 1.0) -> Column:
    """Both losses of the root, each by its number of channels."""
    return (traj_weight * 9.0 * traj + rot_weight * 6.0 * rot6d) / 15.0


def weighted(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of the terms by their weights; a term without a weight does not count."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        if weight:
            out = out + weight * terms[name]
    return out


def learning_rate(step: Column, base: float, warm: int, total: int, least: float = 0.0) -> Column:
    """Linear warm-up, then a cosine down to ``least``."""
    up = base * (step + 1) / max(1, warm)
    x = F.least(F.lit(1.0), (step - warm) / max(1, total - warm))
    return F.when(step < warm, up).otherwise(least + (base - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * x)))


def ramp(step: Column, start: int, stop: int, top: float) -> Column:
    return F.lit(top) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - start) / max(1, stop - start)))
