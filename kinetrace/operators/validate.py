"""Checks of clips, plans and alignments; findings are data, not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import finite


def report(df: DataFrame, key: list[str], failures: dict[str, F.Column], warnings: dict[str, F.Column] | None = None, stats: dict[str, F.Column] | None = None) -> DataFrame:
    """(key, failures, warnings, stats): one row per row; conditions that hold are named."""

    def named(conditions):
        each = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in (conditions or {}).items()]
        return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")

    values = F.create_map(*(x for name, v in (stats or {}).items() for x in (F.lit(name), v.cast("double")))) if stats else F.create_map().cast("map<string,double>")
    return df.select(*key, named(failures).alias("failures"), named(warnings).alias("warnings"), values.alias("stats"))


def clip_checks(width: int = 499, joints: int = 231, fps: float = 50.0) -> tuple[dict, dict, dict]:
    """Failures, warnings and stats of rows with flat features and positions."""
    n = F.size("features") / width
    bad = lambda c: F.exists(c, lambda v: ~finite(v))
    failures = {
        "no features": F.col("features").isNull(), "ragged features": F.size("features") % width != 0,
        "no positions": F.col("joints77_pos").isNull(), "frames are not records + 1": F.size("joints77_pos") != (n + 1) * joints,
        "non-finite features": bad("features"), "non-finite positions": bad("joints77_pos"),
    }
    warnings = {"other rate": F.abs(F.col("fps") - fps) > 1e-3, "no rate": ~(F.col("fps") > 0) | F.col("fps").isNull(), "wrong num_records": F.col("num_records") != n}
    return failures, warnings, {"records": n, "fps": F.col("fps")}


def recording_report(readings: DataFrame, rates: DataFrame) -> DataFrame:
    """(rec_id, n, n_bad, y_mean, y_min, y_max, speed_p99, no_contact, odd_rate) of recordings as they came in.

    ``readings`` has (rec_id, root_traj, foot_contact), ``rates`` (rec_id, fps).  A reading
    with a missing or infinite value is bad; a recording in which no foot is ever down fails;
    a rate outside 5 to 240 is odd.  The speed is that over the floor, metres a second.
    """
    traj, contact = F.col("root_traj"), F.col("foot_contact")

    def value(array, i):
        return F.when(finite(F.get(array, F.lit(i))), F.get(array, F.lit(i)).cast("double"))

    bad = F.coalesce(F.exists(traj, lambda v: ~finite(v)), F.lit(True))
    v = readings.select("rec_id", bad.alias("bad"), value(traj, 4).alias("y"), F.sqrt(value(traj, 2) ** 2 + value(traj, 3) ** 2).alias("step"), *(value(contact, i).alias(f"c{i}") for i in range(4)))
    s = v.groupBy("rec_id").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.avg("y").alias("y_mean"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.percentile("step", F.lit(0.99)).alias("step"), F.greatest(*(F.avg(f"c{i}") for i in range(4))).alias("most"),
    )
    fps = F.col("fps")
    s = s.join(rates, "rec_id", "left")
    return s.select("rec_id", "n", "n_bad", "y_mean", "y_min", "y_max", (F.col("step") * fps).alias("speed_p99"), F.coalesce(F.col("most") < 1e-6, F.lit(False)).alias("no_contact"), F.coalesce((fps < 5) | (fps > 240), F.lit(False)).alias("odd_rate"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with their side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def tiles(ranges: DataFrame, start: str, stop: str, least: int, most: int) -> DataFrame:
    """One row: do the ranges, a handful, tile [least, most) without gap or overlap?"""
    from pyspark.sql import Window

    w = Window.orderBy(start)  # a layout has a handful of ranges
    checked = ranges.select(F.col(start).alias("a"), F.col(stop).alias("b"), F.lag(stop).over(w).alias("before"))
    return checked.agg(((F.min("a") == least) & (F.max("b") == most) & F.bool_and(F.col("before").isNull() | (F.col("before") == F.col("a")))).alias("tiles"))


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df
