"""Column builders over arrays and numbers; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUDGE = 1e-9  #: added before rounding, so that engines agree on decimal ties


def rounded(x: Column, places: int = 6) -> Column:
    """Round for comparison between engines; null, NaN and infinity as null."""
    x = x.cast("double")
    return F.when(finite(x), F.round(x + NUDGE, places))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def at(x: Column, i: int) -> Column:
    """Element ``i`` counted from 0 as a double, null beyond the end."""
    return F.get(x, F.lit(i)).cast("double")


def part(x: Column, start: int, width: int) -> Column:
    """``width`` elements from ``start``, counted from 0."""
    return F.slice(x, start + 1, width)


def split_streams(record: Column) -> tuple[Column, Column]:
    """A record as root, velocities and contacts on one side and the joints' rotations on the other."""
    from ..catalog import slices

    at_, width = slices()["joints76_rot6d"]
    return F.concat(part(record, 0, at_), F.slice(record, at_ + width + 1, 1 << 20)), part(record, at_, width)


def joined_streams(rest: Column, joints: Column) -> Column:
    """The record of its two streams."""
    from ..catalog import slices

    at_, _ = slices()["joints76_rot6d"]
    return F.concat(part(rest, 0, at_), joints, F.slice(rest, at_ + 1, 1 << 20))


def without_contacts(record: Column) -> Column:
    from ..catalog import slices

    return part(record, 0, slices()["foot_contact"][0])


def pick(x: Column, places: list[int]) -> Column:
    """Elements at fixed places, which may repeat."""
    return F.array(*(F.get(x, F.lit(i)) for i in places))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") * by)


def unit(x: Column, floor: float = 1e-12) -> Column:
    """L2-normalised, the norm floored."""
    return scaled(x, 1.0 / F.greatest(norm(x), F.lit(floor)))


def unit_added(x: Column, eps: float = 1e-8) -> Column:
    """L2-normalised with the epsilon added to the norm."""
    return scaled(x, 1.0 / (norm(x) + eps))


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def zscore(x: Column, mu: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(x, mu, lambda a, m: a.cast("double") - m), sd, lambda a, s: a / s)


def unzscore(z: Column, mu: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(z, sd, lambda a, s: a * s), mu, lambda a, m: a + m)


def half_even(x: Column) -> Column:
    """Whole number by half-to-even."""
    return F.rint(x)


def trimmed(n: Column, stride: int) -> Column:
    """Largest multiple of the stride not above ``n``."""
    return n - F.pmod(n, F.lit(stride))


def next_power_of_two(m: Column) -> Column:
    """Smallest power of two above ``m``; 1 for 0."""
    return F.when(m <= 0, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(m))).cast("long"))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def scale_label(n: Column) -> Column:
    """1234 -> '1k'; smaller numbers as they are; negative ones are an error."""
    return F.when(n < 0, F.raise_error(F.lit("a count must not be negative"))).when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def all_zero(x: Column) -> Column:
    """The sentinel of a missing vector."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))) == 0


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
