"""Corpus statistics of vector columns.

Narrow vectors are exploded and aggregated by built-in functions, which combine before
the shuffle.  Wide ones (hundreds of dimensions) are summed per partition in NumPy, so
that a row does not become hundreds; both give count, mean and second moment that merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

EPS = 1e-8


def exploded(df: DataFrame, keys: list[str], vector: str, start: int = 0) -> DataFrame:
    """(keys, dim, x): one row per element, ``dim`` from ``start``."""
    return df.select(*keys, F.posexplode(vector).alias("_d", "_x")).select(*keys, (F.col("_d") + start).alias("dim"), F.col("_x").cast("double").alias("x"))


def deviation(var: Column) -> Column:
    return F.sqrt(var + EPS)


def moments(values: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Count, mean and deviation with the epsilon under the root; an empty group gives no row."""
    return values.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), deviation(F.var_pop(x)).alias("std"))


LONG = 1 << 22  #: values of a clip that one task may sort


def mean_of_quantiles(values: DataFrame, clip: list[str], by: list[str], shares: dict[str, float], x: str = "x", most: int = LONG) -> DataFrame:
    """Quantiles per clip, linearly interpolated, then averaged over clips of any length alike.

    Clips of up to ``most`` values are settled by the aggregate, longer ones by ranges: the
    same numbers, and no task grows with a clip.
    """
    size = values.groupBy(*clip).agg(F.count("*").alias("_n"))
    long = materialize(size.where(F.col("_n") > most).select(*(F.col(c).alias(f"_{c}") for c in clip)))
    plain = lambda rows: rows.groupBy(*clip, *by).agg(*(F.percentile(x, F.lit(q)).alias(name) for name, q in shares.items()))
    if long.isEmpty():
        per = plain(values)
    else:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in clip]
        per = plain(values.join(long, same, "left_anti")).unionByName(quantiles(values.join(long, same, "left_semi"), [*clip, *by], x, shares))
    return per.groupBy(*by).agg(*(F.avg(name).alias(name) for name in shares))


def packed(stats: DataFrame, binary_from: int) -> DataFrame:
    """Mean and deviation to normalise by: the deviation clamped, binary dimensions left alone."""
    binary = F.col("dim") >= binary_from
    return stats.withColumns({"mean": F.when(binary, 0.0).otherwise(F.col("mean")), "std": F.when(binary, 1.0).otherwise(F.greatest(F.col("std"), F.lit(1e-6)))})


def as_vectors(stats: DataFrame) -> DataFrame:
    """One row with the vectors ``mu`` and ``sd``; as many values as there are dimensions."""
    rows = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.agg(rows.alias("r")).select(F.transform("r", lambda e: e["mean"]).alias("mu"), F.transform("r", lambda e: e["std"]).alias("sd"))


def positive_rate(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("rate"), F.count(x).alias("n"))


def wide_moments(df: DataFrame, by: list[str], column: str, width: int) -> DataFrame:
    """(by, dim, n, mean, std) of the finite values of flat arrays of ``width``-wide records.

    Each partition sums around its own first values and sends a row per key and dimension.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in by}

    def work(batches):
        state: dict[tuple, list[np.ndarray]] = {}
        types = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            data = batch.column(column)
            off, ok, v = data.offsets.to_numpy(), data.is_valid().to_numpy(zero_copy_only=False), data.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in by)) if by else [()] * len(batch)):
                if not ok[i] or off[i + 1] == off[i] or (off[i + 1] - off[i]) % width:
                    continue
                x = v[off[i] : off[i + 1]].reshape(-1, width).astype(np.float64)
                fine = np.isfinite(x)
                n = fine.sum(axis=0)
                mean = np.where(fine, x, 0).sum(axis=0) / np.maximum(n, 1)
                m2 = np.where(fine, (x - mean) ** 2, 0).sum(axis=0)
                if key in state:
                    n0, mean0, m0 = state[key]
                    both = np.maximum(n0 + n, 1)
                    d = mean - mean0
                    state[key] = [n0 + n, mean0 + d * n / both, m0 + m2 + d * d * n0 * n / both]
                else:
                    state[key] = [n, mean, m2]
        for key, (n, mean, m2) in state.items():
            head = [pa.array([k] * width, t) for k, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(width, dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(m2)], [*by, "dim", "n", "mean", "m2"])

    head = "".join(f"`{c}` {k}, " for c, k in kinds.items())
    parts = df.select(*by, column).mapInArrow(work, head + "dim int, n long, mean double, m2 double").where("n > 0")
    total = parts.groupBy(*by, "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("_q")
    )
    mean = F.col("_s") / F.col("n")
    return total.select(*by, "dim", "n", mean.alias("mean"), deviation(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def collapsed(values: DataFrame, entity: str, x: str = "x", most: float = 1e-5) -> DataFrame:
    """(entity, dim, mean, constant): vectors that hardly vary within an entity collapse to one."""
    per = values.groupBy(entity, "dim").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    worst = per.groupBy(entity).agg((F.max("sd") <= most).alias("constant"))
    return per.join(worst, entity).select(entity, "dim", "mean", "constant")


def metric_names(df: DataFrame, metrics: str) -> DataFrame:
    """(name): every name that some row's map of metrics has."""
    return df.select(F.explode(F.map_keys(metrics)).alias("name")).distinct()


def quantiles(values: DataFrame, by: list[str], x: str, shares: dict[str, float], lower: bool = False) -> DataFrame:
    """(by, name..): exact quantiles per group, linearly interpolated (``lower``: the value at or below).

    Equal values are counted first, then ranged by (group, value): the ranges' sums, a row
    each, give every range its first rank, so no task holds a group, however large.  Nulls
    do not count; a group without values gives no row.
    """
    counted = values.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    ranged = materialize(counted.repartitionByRange(*by, "_x").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_s"))
    every = Window.partitionBy(*by)  # a row per range
    sums = sums.select(*by, "_range", F.sum("_s").over(every).alias("_all"), (F.sum("_s").over(every.orderBy("_range")) - F.col("_s")).alias("_base"))
    inside = Window.partitionBy(*by, "_range").orderBy("_x")
    same = F.expr(" and ".join([f"r.{c} <=> s.{c}" for c in [*by, "_range"]]))
    rows = ranged.alias("r").join(sums.alias("s"), same).select(*(F.col(f"r.{c}").alias(c) for c in by), F.col("r._range").alias("_range"), "_x", "_n", "_all", "_base")
    rows = rows.withColumn("_to", F.col("_base") + F.sum("_n").over(inside))

    def at(rank):
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n")), F.col("_x").cast("double")))

    out, spots = [], {}
    for name, q in shares.items():
        spot = F.lit(q) * (F.col("_all") - 1)
        if lower:
            spot = F.greatest(F.ceil(F.lit(q) * F.col("_all")) - 1, F.lit(0))
        spots[name] = (at(F.floor(spot)).alias(f"_a_{name}"), at(F.ceil(spot)).alias(f"_b_{name}"), F.max(spot - F.floor(spot)).alias(f"_w_{name}"))
        out.append((F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * F.col(f"_w_{name}")).alias(name))
    return rows.groupBy(*by).agg(*(c for three in spots.values() for c in three)).select(*by, *out)


def summary(long: DataFrame, by: list[str], x: str = "x", finite_only: bool = True) -> DataFrame:
    """Mean, median of the two middles, least, most and count per metric."""
    if finite_only:
        long = long.where(f"`{x}` is not null and not isnan(`{x}`) and abs(`{x}`) < double('inf')")
    plain = long.groupBy(*by).agg(F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.count(x).alias("n"))
    return plain.join(quantiles(long, by, x, {"median": 0.5}), by, "left").select(*by, "mean", "median", "least", "most", "n")
