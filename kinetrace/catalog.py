"""Named slices of the 499-wide record and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Field layout of one record (name, width), in order.
LAYOUT = (("root_traj", 9), ("root_rot6d", 6), ("joints76_rot6d", 456), ("sparse_vel", 24), ("foot_contact", 4))
RECORD_WIDTH = sum(w for _, w in LAYOUT)
JOINTS, JOINT_WIDTH = 77, 231
# The 22 body joints of the evaluation subset among the 77, pelvis first.
BODY22 = (0, 67, 72, 1, 68, 73, 2, 69, 74, 3, 70, 75, 4, 11, 39, 6, 12, 40, 13, 41, 14, 42)


def slices() -> dict[str, tuple[int, int]]:
    """Field name -> (start, width), start counted from 0."""
    out, at = {}, 0
    for name, width in LAYOUT:
        out[name] = (at, width)
        at += width
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
