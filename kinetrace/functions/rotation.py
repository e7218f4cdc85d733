"""Rotations as column expressions.

A matrix is an array of 9 doubles, row by row; a rot6d is its first column, then its
second; a quaternion is (w, x, y, z).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import at

SMALL = 1e-8


def let(x: Column, f) -> Column:
    """``f`` of ``x`` evaluated once: else every use of ``x`` would hold its whole tree."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _length(a):
    return F.sqrt(sum((x * x for x in a[1:]), a[0] * a[0]))


def matrix_of_rot6d(r: Column) -> Column:
    """Gram-Schmidt on the two columns, norms floored at 1e-8."""

    def first(r):
        a = [at(r, i) for i in range(3)]
        n = F.greatest(_length(a), F.lit(SMALL))
        return F.array(*(x / n for x in a), *(at(r, i) for i in range(3, 6)))

    def second(q):
        a, b = [at(q, i) for i in range(3)], [at(q, i) for i in range(3, 6)]
        along = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        return F.array(*a, *(y - along * x for x, y in zip(a, b)))

    def scaled(q):
        b = [at(q, i) for i in range(3, 6)]
        n = F.greatest(_length(b), F.lit(SMALL))
        return F.array(*(at(q, i) for i in range(3)), *(x / n for x in b))

    def whole(q):
        a, b = [at(q, i) for i in range(3)], [at(q, i) for i in range(3, 6)]
        columns = (a, b, _cross(a, b))
        return F.array(*(columns[j][i] for i in range(3) for j in range(3)))

    return let(r, lambda v: let(first(v), lambda q: let(second(q), lambda q: let(scaled(q), whole))))


def rot6d_of_matrix(m: Column) -> Column:
    return F.array(*(at(m, 3 * i + j) for j in range(2) for i in range(3)))


def matrix_of_axis_angle(v: Column) -> Column:
    """Rodrigues; the identity at angle 0."""
    x, y, z = (at(v, i) for i in range(3))
    angle = _length((x, y, z))
    safe = F.when(angle < 1e-12, F.lit(1.0)).otherwise(angle)
    k = [c / safe for c in (x, y, z)]
    s, t = F.sin(angle), 1 - F.cos(angle)
    cross = ((None, -k[2], k[1]), (k[2], None, -k[0]), (-k[1], k[0], None))
    rows = []
    for i in range(3):
        for j in range(3):
            turn = t * k[i] * k[j]
            rows.append(turn + F.cos(angle) if i == j else turn + s * cross[i][j])
    return F.array(*rows)


def quaternion_of_matrix(m: Column) -> Column:
    """The largest component is found first, so no division by little; w is not negative."""

    def parts(m):
        a = [[at(m, 3 * i + j) for j in range(3)] for i in range(3)]
        four = (1 + a[0][0] + a[1][1] + a[2][2], 1 + a[0][0] - a[1][1] - a[2][2], 1 - a[0][0] + a[1][1] - a[2][2], 1 - a[0][0] - a[1][1] + a[2][2])
        return F.array(*four, a[2][1] - a[1][2], a[0][2] - a[2][0], a[1][0] - a[0][1], a[1][0] + a[0][1], a[0][2] + a[2][0], a[2][1] + a[1][2])

    def chosen(p):
        c = [F.get(p, F.lit(i)) for i in range(10)]
        table = ((c[0], c[4], c[5], c[6]), (c[4], c[1], c[7], c[8]), (c[5], c[7], c[2], c[9]), (c[6], c[8], c[9], c[3]))
        top = F.greatest(*c[:4])
        out = F.array(*table[3])
        for k in (2, 1, 0):
            out = F.when(c[k] == top, F.array(*table[k])).otherwise(out)
        return F.concat(out, F.array(2 * F.sqrt(F.greatest(top, F.lit(1e-30)))))

    def signed(q):
        by = F.when(F.get(q, F.lit(0)) < 0, -1.0).otherwise(1.0) / F.get(q, F.lit(4))
        return F.transform(F.slice(q, 1, 4), lambda v: v * by)

    return let(let(m, parts), lambda p: let(chosen(p), signed))


def axis_angle_of_matrix(m: Column) -> Column:
    def turned(q):
        v = [F.get(q, F.lit(i)) for i in (1, 2, 3)]
        s = _length(v)
        by = F.when(s < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(s, F.get(q, F.lit(0))) / F.greatest(s, F.lit(1e-12)))
        return F.array(*(c * by for c in v))

    return let(quaternion_of_matrix(m), turned)


def compose(p: Column, q: Column) -> Column:
    """Quaternion product: first ``q``, then ``p``."""
    (a, b, c, d), (e, f, g, h) = ([at(x, i) for i in range(4)] for x in (p, q))
    return F.array(a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def xyzw_of_wxyz(q: Column) -> Column:
    return F.array(*(at(q, i) for i in (1, 2, 3, 0)))


def transposed(m: Column) -> Column:
    return F.array(*(at(m, 3 * j + i) for i in range(3) for j in range(3)))


def times(m: Column, n: Column) -> Column:
    def product(both):
        a, b = ([at(F.get(both, F.lit(k)), i) for i in range(9)] for k in (0, 1))
        return F.array(*(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)))

    return let(F.array(m, n), product)


def apply(m: Column, v: Column) -> Column:
    a, x = [at(m, i) for i in range(9)], [at(v, i) for i in range(3)]
    return F.array(*(a[3 * i] * x[0] + a[3 * i + 1] * x[1] + a[3 * i + 2] * x[2] for i in range(3)))


def geodesic(m: Column, n: Column) -> Column:
    """Angle between two rotations."""

    def angle(q):
        return 2 * F.atan2(_length([F.get(q, F.lit(i)) for i in (1, 2, 3)]), F.abs(F.get(q, F.lit(0))))

    return let(quaternion_of_matrix(times(let(m, transposed), n)), angle)


def yaw(m: Column) -> Column:
    """Heading of the third column in the floor plane."""
    return let(m, lambda v: F.atan2(at(v, 2), at(v, 8)))


def into_heading(x: Column, z: Column, angle: Column) -> tuple[Column, Column]:
    """A floor vector seen from a frame turned by ``angle``."""
    return F.cos(angle) * x - F.sin(angle) * z, F.sin(angle) * x + F.cos(angle) * z


def out_of_heading(x: Column, z: Column, angle: Column) -> tuple[Column, Column]:
    return F.cos(angle) * x + F.sin(angle) * z, F.cos(angle) * z - F.sin(angle) * x
