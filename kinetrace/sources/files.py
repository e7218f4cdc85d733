"""Readers and writers beside Parquet: npz clips, manifests, event lines, JSON reports.

Bad input becomes a row with an ``error``, never a failed job.
"""

from __future__ import annotations

import io
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "KINETRACE_DATA_ROOT"
VARIANT = "delta_root_multiscale_sparsevel"  # Fixed value: the feature variant of a clip file.

# Arrays of a clip file and their trailing shapes.
CLIP_ARRAYS = {"features": (499,), "init_root_pos": (3,), "init_root_rot6d": (6,), "init_joints76_rot6d": (76, 6), "identity_coeffs": None, "joint_orient": (78, 3, 3), "joints77_pos": (77, 3)}
RECORDING_ARRAYS = {"poses": (77, 3), "transl": (3,), "identity_coeffs": None, "joint_orient": (78, 3, 3), "foot_contacts": (4,)}


def _schema(arrays: dict) -> str:
    return "path string, fps double, variant string, " + ", ".join(f"{a} array<float>" for a in arrays) + ", error string"


def read_npz(spark: SparkSession, path: str, arrays: dict = CLIP_ARRAYS, variant: str | None = None) -> DataFrame:
    """One row per npz file under ``path``: its arrays flat, or what is wrong with it."""

    def load(content: bytes) -> dict:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            missing = [a for a in arrays if a not in z.files]
            if missing:
                raise ValueError("missing arrays: " + ", ".join(missing))
            row = {}
            for name, tail in arrays.items():
                x = z[name].astype(np.float32)
                if tail is not None and x.shape[-len(tail) :] != tail:
                    raise ValueError(f"{name} has the shape {x.shape}")
                row[name] = x.ravel()
            row["fps"] = float(z["fps"]) if "fps" in z.files else None
            row["variant"] = str(z["feature_variant"]) if "feature_variant" in z.files else None
            if variant and row["variant"] not in (None, variant):
                raise ValueError(f"the variant is {row['variant']}")
            return row

    def work(batches):
        kinds = [("path", pa.string()), ("fps", pa.float64()), ("variant", pa.string()), *((a, pa.list_(pa.float32())) for a in arrays), ("error", pa.string())]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    row = load(content.as_py()) | {"path": name, "error": None}
                except Exception as e:  # any bad file is a row
                    row = {"path": name, "error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(work, _schema(arrays))


def write_npz(clips: DataFrame, key: str, folder: str, arrays: dict = CLIP_ARRAYS) -> DataFrame:
    """Write each clip to ``folder/<key>/clip.npz`` on a path all executors see; returns
    (key, path, error).  A file appears whole or not at all."""

    def work(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                where, error = os.path.join(folder, str(r[key]), "clip.npz"), None
                try:
                    os.makedirs(os.path.dirname(where), exist_ok=True)
                    data = {a: np.array(r[a], np.float32).reshape(-1, *tail) if tail and not a.startswith("init") and a != "joint_orient" else np.array(r[a], np.float32).reshape(tail or (1, -1)) for a, tail in arrays.items()}
                    with open(where + f".{os.getpid()}", "wb") as out:
                        np.savez(out, **data, fps=np.float64(r["fps"]), feature_variant=VARIANT)
                    os.replace(where + f".{os.getpid()}", where)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append({key: str(r[key]), "path": where, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(key, pa.string()), ("path", pa.string()), ("error", pa.string())]))

    return clips.select(key, "fps", *arrays).mapInArrow(work, f"`{key}` string, path string, error string")


def root_dir(given: str | None = None) -> str:
    return given or os.environ.get(ROOT, "data")


def resolved_uri(uri: Column, root: str) -> Column:
    """``local://X`` to ``root/X``; anything else as it is.  Blanks around and doubled slashes go."""
    u = F.trim(uri)
    rest = F.regexp_replace(F.substring(u, len("local://") + 1, 1 << 20), "/+", "/")
    return F.when(F.lower(u).startswith("local://"), F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(rest, F.lit("/")))).otherwise(u)


def unresolved_uri(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.concat(F.lit("local://"), F.substring(path, len(base) + 1, 1 << 20))).otherwise(path)


def resolved_entry(entry: Column, root: str, name: str) -> Column:
    """A manifest entry: URI, path, or bare id below the root."""
    e = F.trim(entry)
    as_is = e.contains("/") | e.endswith(".npz")
    return F.when(e.startswith("local://"), resolved_uri(e, root)).when(as_is, e).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), e, F.lit(name)))


def read_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_no, line_no, entry) of text manifests in the order given; blanks and # lines dropped.

    A manifest is read in as many parts as Spark cuts it into; where a part starts in the file
    and the order inside it give its lines their numbers.
    """
    from ..plans.windows import running_offsets

    out = None
    for k, path in enumerate(paths):
        lines = spark.read.text(path).select(F.lit(k).alias("file_no"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
        out = lines if out is None else out.unionByName(lines)
    order = ["file_no", "_file", "_start", "_at"]
    numbered = running_offsets(out.withColumn("_one", F.lit(1)), order, "_one", row="_row")
    first = numbered.groupBy("file_no").agg(F.min("_row").alias("_first"))  # a row per manifest
    rows = numbered.join(first, "file_no").select("file_no", (F.col("_row") - F.col("_first")).cast("int").alias("line_no"), F.trim("value").alias("entry"))
    return rows.where((F.col("entry") != "") & ~F.col("entry").startswith("#"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    """Name of the folder a file lies in; null where the path names none."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def with_suffix(path: Column, suffix: str) -> Column:
    """The path with its last suffix, if any, replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def comma_set(x: Column) -> Column:
    """The words of a list written with commas, each once, without blanks around them."""
    words = F.transform(F.split(x, ","), lambda w: F.trim(w))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def head(entries: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` entries in order; 0 for all."""
    return entries if not n else entries.orderBy(*order).limit(n)


def discover(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """(path, split) of the Parquet files below a folder, or its part of one split, in the order
    of their names; the split is the folder a file lies in.  No file is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{folder}/{split}" if split else folder)
    paths = found.select("path", parent_name(F.col("path")).alias("split")).orderBy("path")
    if paths.isEmpty():
        raise FileNotFoundError(f"no Parquet files below {folder}")
    return paths


EVENTS = "rec_id string, events array<struct<start_time: double, end_time: double>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, events) of JSON lines: the last line of a recording counts, no events are an empty list."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    parsed = lines.select("line", F.from_json("value", EVENTS).alias("r")).where("r.rec_id is not null")
    return parsed.groupBy("r.rec_id").agg(F.max_by(F.coalesce("r.events", F.array().cast("array<struct<start_time:double,end_time:double>>")), "line").alias("events"))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per row with sorted keys, in one file; Spark commits it whole."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def split_keys(table: dict, prefix: str) -> tuple[dict, dict]:
    """Entries under a key prefix (the prefix cut off), and the others."""
    return {k[len(prefix) :]: v for k, v in table.items() if k.startswith(prefix)}, {k: v for k, v in table.items() if not k.startswith(prefix)}


def split_map(m: Column, prefix: str) -> tuple[Column, Column]:
    """The same of a map column."""
    inside = F.map_filter(m, lambda k, v: k.startswith(prefix))
    return F.transform_keys(inside, lambda k, v: F.substring(k, len(prefix) + 1, 1 << 20)), F.map_filter(m, lambda k, v: ~k.startswith(prefix))


def dumps(stats: dict) -> str:
    return json.dumps(stats, sort_keys=True)


def ordered_hash(entries: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(sha256, n) of all entries in order: the fields of each with a zero byte between them and a
    newline after.  A hash of a sequence is made one entry after the other: the entries are
    sorted by many tasks and pass through the last one, which holds none of them.  No entries, no row."""

    def work(batches):
        import hashlib

        h, n = hashlib.sha256(), 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(columns)))):
                h.update(b"\0".join(str(v).encode("utf-8") for v in row) + b"\n")
            n += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()]), pa.array([n], pa.int64())], ["sha256", "n"])

    return entries.orderBy(*order).select(*columns).coalesce(1).mapInArrow(work, "sha256 string, n long")


def fingerprint(entries: DataFrame, position: str, *columns: str) -> DataFrame:
    """One row with the SHA-256 of the entries in order, the fields of each ended by a zero
    byte and a newline.  Entries of one range are hashed together, then the ranges' hashes,
    so no task gathers the whole manifest."""
    line = F.concat(*(x for c in columns for x in (F.col(c), F.lit("\x00"))), F.lit("\n"))
    parts = entries.select(F.floor(F.col(position) / 65536).alias("g"), F.struct(F.col(position).alias("p"), line.alias("s")).alias("e"))
    per = parts.groupBy("g").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["s"]), ""), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda e: e["h"]), ""), 256).alias("sha256"))
