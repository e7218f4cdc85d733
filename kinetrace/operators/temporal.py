"""Operators over ordered readings of an entity.

Readings have an integer position.  Work is split by (entity, stretch of positions): a
stretch also sees ``halo`` positions before it, so an entity with very many readings is
many tasks.  Running sums add a base per stretch.  Positions may have gaps: the reading
before is the one with the next lower position.  Rows without entity or position are left
out; null values give null results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

STRETCH = 8192


class Stretches:
    """Rows of ``df`` by (entity, stretch) with the readings before each stretch."""

    def __init__(self, df: DataFrame, entity: str, position: str, halo: int, stretch: int = STRETCH):
        if halo >= stretch:
            raise ValueError("the halo must be smaller than a stretch")
        c, m = F.floor(F.col(position) / stretch).cast("long"), F.pmod(F.col(position), F.lit(stretch))
        both = F.when(m >= stretch - halo, F.array(c, c + 1)).otherwise(F.array(c)) if halo else F.array(c)
        self.columns = df.columns
        self.df = df.where(F.col(entity).isNotNull() & F.col(position).isNotNull()).withColumn("_own", c).withColumn("_stretch", F.explode(both))
        self.by = Window.partitionBy(entity, "_stretch").orderBy(position)

    def select(self, **columns: Column) -> DataFrame:
        """The rows of ``df`` with further columns, which may use windows over ``by``."""
        return self.df.withColumns(columns).where("_own = _stretch").select(*self.columns, *columns)


def differences(df: DataFrame, entity: str, position: str, values: list[str], order: int = 1, halo: int = 64) -> DataFrame:
    """First to third differences ``d_<value>`` to the readings before; null for the first ones."""
    taps = {1: (1, -1), 2: (1, -2, 1), 3: (1, -3, 3, -1)}[order]
    s = Stretches(df, entity, position, halo)

    def tap(v):
        out = F.col(v)
        for k, w in enumerate(taps[1:], 1):
            out = out + w * F.lag(v, k).over(s.by)
        return out

    return s.select(**{f"d_{v}": tap(v) for v in values})


def rates(df: DataFrame, entity: str, position: str, values: list[str], horizon: int) -> DataFrame:
    """``r_<value>``: change since ``horizon`` readings before, or since the first, per reading."""
    s = Stretches(df, entity, position, max(64, 4 * horizon))
    frame = s.by.rowsBetween(-horizon, 0)
    steps = F.count("*").over(frame) - 1
    return s.select(**{f"r_{v}": F.try_divide(F.col(v) - F.first(v).over(frame), steps) for v in values})


def running_sums(df: DataFrame, entity: str, position: str, values: list[str], stretch: int = STRETCH) -> DataFrame:
    """``s_<value>``: sums up to and with each reading."""
    parts = materialize(df.where(F.col(entity).isNotNull() & F.col(position).isNotNull()).withColumn("_stretch", F.floor(F.col(position) / stretch).cast("long")))  # read twice below
    bases = parts.groupBy(entity, "_stretch").agg(*(F.sum(v).alias(f"_b_{v}") for v in values))
    before = Window.partitionBy(entity).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    bases = bases.select(entity, "_stretch", *(F.coalesce(F.sum(f"_b_{v}").over(before), F.lit(0.0)).alias(f"_b_{v}") for v in values))
    inside = Window.partitionBy(entity, "_stretch").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(bases, [entity, "_stretch"])
    return out.select(*df.columns, *((F.col(f"_b_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0.0))).alias(f"s_{v}") for v in values))


def latest(df: DataFrame, keys: list[str], order: str, arrays: dict[str, int] | None = None) -> DataFrame:
    """One row per key, the one with the least ``order``, which must be unique in a key:
    second deliveries dropped.  With plain numbers beside the keys this is a hash
    aggregate, combined before the shuffle.

    ``arrays`` names array columns and their widths: they are taken apart for it and put
    together after; one of another width becomes null.
    """
    arrays = arrays or {}
    parts = {name: [f"_{name}_{i}" for i in range(width)] for name, width in arrays.items()}
    plain = [c for c in df.columns if c not in arrays]
    flat = df.select(*plain, *((F.size(name) == width).alias(f"_{name}") for name, width in arrays.items()), *(F.get(name, F.lit(i)).alias(p) for name, ps in parts.items() for i, p in enumerate(ps)))
    rest = [c for c in flat.columns if c not in keys and c != order]
    once = flat.groupBy(*keys).agg(*(F.min_by(c, order).alias(c) for c in rest))
    whole = {name: F.when(F.col(f"_{name}"), F.array(*ps)).alias(name) for name, ps in parts.items()}
    return once.select(*keys, *(whole.get(c, c) for c in df.columns if c not in keys and c != order))


def path_length(df: DataFrame, entity: str, x: str, z: str) -> DataFrame:
    """(entity, path, n) from per-reading floor steps."""
    return df.groupBy(entity).agg(F.sum(F.sqrt(F.col(x) * F.col(x) + F.col(z) * F.col(z))).alias("path"), F.count("*").alias("n"))


def resampled(df: DataFrame, entity: str, position: str, value: str, ratio: float) -> DataFrame:
    """Linear resampling to max(1, round(n * ratio)) readings: (entity, k, value).

    Positions must run from 0 without gaps.  Target k lies at k (n-1)/(m-1).
    """
    rows = df.select(entity, F.col(position).alias("_p"), F.col(value).cast("double").alias("_v"))
    size = rows.groupBy(entity).agg(F.count("*").alias("_n"))
    grid = size.withColumn("_m", F.greatest(F.lit(1), F.rint(F.col("_n") * ratio).cast("long"))).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("k"))
    spot = F.when(F.col("_m") > 1, F.col("k") * (F.col("_n") - 1) / (F.col("_m") - 1)).otherwise(0.0)
    grid = grid.withColumn("_at", spot).withColumn("_low", F.floor("_at")).withColumn("_high", F.ceil("_at"))
    low = rows.select(entity, F.col("_p").alias("_low"), F.col("_v").alias("_a"))
    high = rows.select(entity, F.col("_p").alias("_high"), F.col("_v").alias("_b"))
    w = F.col("_at") - F.col("_low")
    return grid.join(low, [entity, "_low"]).join(high, [entity, "_high"]).select(entity, "k", (F.col("_a") * (1 - w) + F.col("_b") * w).alias(value))
