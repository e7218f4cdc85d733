"""Plans: windows over clips, token grids, ragged offsets, shards and batches.

A plan is a table of (key, start, length); nothing here depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def window_starts(n: Column, width: int, step: int, cap: int = 0) -> Column:
    """Starts of the windows of a clip of ``n`` records: every ``step`` from 0, the last
    window appended where it is missing, then the first ``cap`` kept (0: all).

    Null and too short clips have none; a step below 1 gives the start 0 alone.
    """
    if width < 1:
        raise ValueError("a window needs at least one record")
    last = n - width
    starts = F.array(F.lit(0)) if step < 1 else F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    if cap:
        starts = F.slice(starts, 1, cap)
    return F.when(n.isNull() | (n < width), F.array().cast("array<int>")).otherwise(starts)


def take_length(n: Column, least: int, most: int, stride: int) -> Column:
    """Records taken of a clip in a variable-length plan; null where it is too short."""
    take = F.least(n, F.lit(most))
    take = take - take % stride
    return F.when((n >= least) & (take >= least), take)


def exploded(plan: DataFrame, starts: str, start: str = "start") -> DataFrame:
    return plan.select("*", F.explode(starts).alias(start)).drop(starts)


def running_offsets(df: DataFrame, order: list[str], length: str, offset: str = "offset", row: str = "row_no") -> DataFrame:
    """Exclusive running sum of ``length`` and the row number in a total order.

    One range shuffle; sums of the ranges, one row each, give every range its base, so no
    task sees the whole table.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    bases = ranged.groupBy("_range").agg(F.sum(length).alias("_sum"), F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    bases = bases.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(bases, "_range").withColumn(offset, F.col("_base") + F.coalesce(F.sum(length).over(so_far), F.lit(0)))
    return out.withColumn(row, F.col("_first") + F.row_number().over(inside) - 1).drop("_range", "_base", "_first")


def token_spans(n: Column, stride: int, width: int, group: int = 1) -> Column:
    """Centred spans of the tokens of a clip: array of (token, start, stop), clamped to the clip."""
    tokens = F.floor(n / stride).cast("int")

    def span(g):
        centre = (g - g % group) * stride + stride / 2.0
        low = F.greatest(F.lit(0.0), F.rint(centre - width / 2.0))
        high = F.least(n.cast("double"), F.rint(centre + width / 2.0))
        return F.struct(g.alias("token"), low.cast("int").alias("start"), high.cast("int").alias("stop"))

    return F.when(tokens > 0, F.transform(F.sequence(F.lit(0), tokens - 1), span)).otherwise(F.array().cast("array<struct<token:int,start:int,stop:int>>"))


def token_blocks(n: Column, stride: int, width: int, origin: int = 0) -> Column:
    """Tumbling block of each token: array of (token, block), blocks counted from ``origin``."""
    tokens = F.floor(n / stride).cast("int")
    each = F.transform(F.sequence(F.lit(0), tokens - 1), lambda g: F.struct(g.alias("token"), F.floor((g * stride + origin) / width).cast("int").alias("block")))
    return F.when(tokens > 0, each).otherwise(F.array().cast("array<struct<token:int,block:int>>"))


def shard_of(position: Column, n: Column, shards: int) -> Column:
    """Contiguous shard of a position among ``n``."""
    return F.floor(position / F.greatest(F.lit(1), F.ceil(n / shards))).cast("int")


def strided(position: Column, chunks: int) -> Column:
    return F.pmod(position, F.lit(chunks)).cast("int")


def length_batches(df: DataFrame, position: str, length: str, batch: int, mega: int) -> DataFrame:
    """Batches of similar length: sorted by length inside mega-batches of consecutive
    positions, remainders left out.  Adds (mega, batch_no, place)."""
    out = df.withColumn("mega", F.floor(F.col(position) / (batch * mega)).cast("long"))
    w = Window.partitionBy("mega").orderBy(F.col(length), F.col(position))
    out = out.withColumn("_k", F.row_number().over(w) - 1)
    full = F.count("*").over(Window.partitionBy("mega"))
    out = out.withColumn("_full", full - full % batch).where("_k < _full")
    return out.select(*df.columns, "mega", F.floor(F.col("_k") / batch).cast("long").alias("batch_no"), (F.col("_k") % batch).cast("long").alias("place"))


def crop_start(key: Column, n: Column, width: int, seed: int = 0, stride: int = 1) -> Column:
    """Start of a random crop, a multiple of the stride, that depends on key and seed alone;
    null where the clip is too short."""
    mixed = F.pmod(F.pmod(key.cast("long"), F.lit(1 << 30)) * 2654435761 + (seed * 40503 + 12345), F.lit(1 << 31))
    return F.when(n >= width, (F.pmod(F.shiftright(mixed, 7), F.floor((n - width) / stride) + 1) * stride).cast("int"))


def sampled(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows without replacement, chosen by hash; 0 for all."""
    return df if not size else df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(size)
