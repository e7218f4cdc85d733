"""Caches of windows and heads of clips on disk, and what tells whether one may be used.

A cache is a folder with Parquet tables and a line of JSON that says what it holds and by
which parameters it was made.  The line is written last: a cache without it is not there.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipelines
from .catalog import RECORD_WIDTH
from .sources.files import VARIANT


def write_meta(spark: SparkSession, folder: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def read_meta(spark: SparkSession, folder: str) -> dict | None:
    """What the cache says of itself; None where there is none, or nothing that can be read."""
    try:
        line = spark.read.text(f"{folder}/meta").head()
        meta = json.loads(line[0]) if line else None
        return meta if isinstance(meta, dict) else None
    except (AnalysisException, ValueError):
        return None


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_fixed(clips: DataFrame, folder: str, width: int = 64, step: int = 32, cap: int = 64, manifest: str = "") -> dict:
    """A cache of all windows of all clips."""
    spark = clips.sparkSession
    pipelines.fixed_windows(clips, width, step, cap).write.mode("overwrite").parquet(f"{folder}/data")
    n = spark.read.parquet(f"{folder}/data").count()
    meta = {"mode": "fixed", "feature_variant": VARIANT, "dtype": "float32", "window": width, "step": step, "max_windows_per_clip": cap, "manifest_hash": manifest, "shape": [n, width, RECORD_WIDTH]}
    write_meta(spark, folder, meta)
    return meta


def write_ragged(clips: DataFrame, folder: str, least: int = 48, most: int = 300, stride: int = 4) -> dict:
    """A cache of the heads of all clips long enough, with the index that puts them in one row."""
    spark = clips.sparkSession
    index, data = pipelines.ragged_parts(clips, least, most, stride)
    index.select("row_no", "row_id", "rec_id", F.col("offset").cast("long").alias("offset"), F.col("take").cast("long").alias("length")).write.mode("overwrite").parquet(f"{folder}/index")
    data.write.mode("overwrite").parquet(f"{folder}/data")
    size = spark.read.parquet(f"{folder}/index").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).head()
    meta = {"mode": "varlen", "varlen": True, "feature_variant": VARIANT, "dtype": "float32", "min_frames": least, "max_frames": most, "token_stride": stride, "n_clips": size.n, "total_frames": size.total, "shape": [size.total, RECORD_WIDTH]}
    write_meta(spark, folder, meta)
    return meta


def is_ready(spark: SparkSession, folder: str) -> bool:
    """Does the cache hold what it says: the variant, the type, and as many rows?"""
    meta = read_meta(spark, folder)
    if not meta or meta.get("feature_variant") != VARIANT or meta.get("dtype") != "float32":
        return False
    data, shape = _table(spark, f"{folder}/data"), meta.get("shape")
    if data is None or not isinstance(shape, list) or not shape or shape[-1] != RECORD_WIDTH or data.schema["features"].dataType.simpleString() != "array<float>":
        return False
    if meta.get("varlen"):
        index = _table(spark, f"{folder}/index")
        return len(shape) == 2 and index is not None and index.count() == data.count() == meta.get("n_clips")
    return len(shape) == 3 and data.count() == shape[0]  # counts come from the files' footers


def matches(spark: SparkSession, folder: str, **parameters) -> bool:
    """Is the cache ready, and made by these parameters?"""
    meta = read_meta(spark, folder)
    return bool(meta) and all(meta.get(k) == v for k, v in parameters.items()) and is_ready(spark, folder)


def held(df: DataFrame, in_memory: bool = True) -> DataFrame:
    """A table kept by the executors once it is read: in memory as far as there is room, or on their disks."""
    return df.persist(StorageLevel.MEMORY_AND_DISK if in_memory else StorageLevel.DISK_ONLY)


def open_ragged(spark: SparkSession, folder: str, teacher: DataFrame | None = None, per_token: bool = False) -> tuple[DataFrame, DataFrame]:
    """Index and data of a ragged cache.  A ``teacher`` table (row_id, and one row per token
    with ``per_token``) must have as many rows as the clips, or tokens, of each ask for."""
    meta = read_meta(spark, folder)
    if not meta or not meta.get("varlen"):
        raise ValueError(f"{folder} is no ragged cache")
    if not is_ready(spark, folder):
        raise ValueError(f"{folder} does not hold what it says")
    index, data = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/data")
    if teacher is not None:
        want = F.floor(F.col("length") / meta["token_stride"]) if per_token else F.lit(1)
        have = teacher.groupBy("row_id").agg(F.count("*").alias("have"))
        wrong = index.select("row_id", want.alias("want")).join(have, "row_id", "full").where(F.coalesce("want", F.lit(0)) != F.coalesce("have", F.lit(0))).limit(1).count()
        if wrong:
            raise ValueError("the teacher's rows do not fit the clips")
    return index, data
