"""Codecs of feature clips: to codes and back, whole or in groups of fields.

A codec cuts clips to whole tokens, normalises the dimensions of each group of fields, takes
the mean of each token's records, projects it, quantizes it in residual layers and undoes all
that; every group has a stride of its own, and a clip is cut to a multiple of them all.
Its parameters are a table, small by a stated bound, and go to every task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import RECORD_WIDTH
from .operators.matching import CODES, nearest_code
from .plans.windows import take_length


@dataclass(frozen=True)
class Config:
    """What a codec is made by; keys it does not know are passed over."""

    name: str = "identity"
    strides: dict = field(default_factory=lambda: {"all": 4})  #: group -> records of a token
    dims: dict = field(default_factory=lambda: {"all": (0, RECORD_WIDTH)})  #: group -> first dimension and one past the last

    @classmethod
    def of(cls, **given) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    @property
    def stride(self) -> int:
        return math.lcm(*self.strides.values())


def pooled(x: np.ndarray, stride: int) -> np.ndarray:
    """Mean of each token's records, missing values taken for zero."""
    x = np.where(np.isfinite(x), x, 0.0)
    return x[: len(x) // stride * stride].reshape(-1, stride, x.shape[1]).mean(axis=1)


def semantic(latents: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], over_time: bool = True) -> np.ndarray:
    """Head of a semantic branch: linear layers with rectifiers between, the mean over time, length one."""
    h = latents
    for k, (w, b) in enumerate(layers):
        h = h @ w + b
        if k < len(layers) - 1:
            h = np.maximum(h, 0.0)
    if over_time:
        h = h.mean(axis=0, keepdims=True)
    return h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)


class Identity:
    """Gives clips back as they are, cut to whole tokens; has no codes."""

    def __init__(self, config: Config):
        self.config = config

    def reconstruct(self, clips: DataFrame, key: str = "row_id") -> DataFrame:
        """(key, features) of all clips of at least one token."""
        n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
        take = take_length(n, self.config.stride, 1 << 30, self.config.stride)
        rows = clips.where(F.col("features").isNotNull() & (F.size("features") % RECORD_WIDTH == 0)).withColumn("_take", take).where("_take is not null")
        return rows.select(key, F.slice("features", F.lit(1), F.col("_take") * RECORD_WIDTH).alias("features"))

    def tokens(self, clips: DataFrame, key: str = "row_id") -> DataFrame:
        kind = clips.schema[key].dataType.simpleString()
        return clips.sparkSession.createDataFrame([], f"`{key}` {kind}, grp string, token int, layer int, code long")


class VectorCodec(Identity):
    """Residual quantizers per group.

    ``parameters`` has, for each group: ``<g>.mean`` and ``<g>.std`` (optional), ``<g>.down`` and
    ``<g>.up``, the projections to the latent and back (optional), and ``<g>.book.<k>``, the codes
    of layer k.
    """

    def __init__(self, config: Config, parameters: dict[str, np.ndarray]):
        super().__init__(config)
        if sum(p.size for p in parameters.values()) > CODES:
            raise ValueError(f"a codec of more than {CODES} numbers is not sent to every task")
        self.parameters = parameters

    def _encoded(self, x: np.ndarray, group: str) -> list[np.ndarray]:
        """Codes of each layer, per token."""
        p, (a, b) = self.parameters, self.config.dims[group]
        v = x[:, a:b].astype(np.float64)
        if f"{group}.mean" in p:
            v = (v - p[f"{group}.mean"]) / p[f"{group}.std"]
        left = pooled(v, self.config.strides[group])
        if f"{group}.down" in p:
            left = left @ p[f"{group}.down"]
        out = []
        while f"{group}.book.{len(out)}" in p:
            book = p[f"{group}.book.{len(out)}"]
            out.append(nearest_code(left, book)[0])
            left = left - book[out[-1]]
        return out

    def _decoded(self, codes: list[np.ndarray], group: str) -> np.ndarray:
        """Records of the codes of the first layers."""
        p = self.parameters
        z = sum(p[f"{group}.book.{k}"][c] for k, c in enumerate(codes))
        if f"{group}.up" in p:
            z = z @ p[f"{group}.up"]
        v = np.repeat(z, self.config.strides[group], axis=0)
        return v * p[f"{group}.std"] + p[f"{group}.mean"] if f"{group}.mean" in p else v

    def _clips(self, batches):
        stride = self.config.stride
        for batch in batches:
            for i, v in enumerate(batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False).reshape(-1, RECORD_WIDTH)
                yield batch.column(0).slice(i, 1), x[: len(x) // stride * stride]

    def tokens(self, clips: DataFrame, key: str = "row_id") -> DataFrame:
        """(key, grp, token, layer, code) of all clips of at least one token."""
        kind = clips.schema[key].dataType.simpleString()

        def work(batches):
            for name, x in self._clips(batches):
                for group in self.config.dims:
                    for layer, codes in enumerate(self._encoded(x, group)):
                        n = len(codes)
                        yield pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(n, np.int64))), pa.array([group] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, layer, np.int32)), pa.array(codes)], [key, "grp", "token", "layer", "code"])

        return super().reconstruct(clips, key).mapInArrow(work, f"`{key}` {kind}, grp string, token int, layer int, code long")

    def reconstruct(self, clips: DataFrame, key: str = "row_id", prefix: int | None = None) -> DataFrame:
        """(key, features): clips encoded and decoded again by the first ``prefix`` layers;
        dimensions of no group are zero."""
        kind = clips.schema[key].dataType.simpleString()

        def work(batches):
            for name, x in self._clips(batches):
                out = np.zeros(x.shape, np.float32)
                for group, (a, b) in self.config.dims.items():
                    out[:, a:b] = self._decoded(self._encoded(x, group)[:prefix], group)
                yield pa.RecordBatch.from_arrays([name, pa.array([out.ravel()], pa.list_(pa.float32()))], [key, "features"])

        return super().reconstruct(clips, key).mapInArrow(work, f"`{key}` {kind}, features array<float>")


def build(config: Config, parameters: dict[str, np.ndarray] | None = None) -> Identity:
    """The codec a configuration names."""
    kinds = {"identity": lambda: Identity(config), "vector": lambda: VectorCodec(config, parameters or {})}
    if config.name not in kinds:
        raise ValueError(f"no such codec: {config.name}")
    return kinds[config.name]()


def save_parameters(spark: SparkSession, parameters: dict[str, np.ndarray], path: str) -> None:
    rows = [(name, list(p.shape), [float(v) for v in p.ravel()]) for name, p in parameters.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """All parameters of a codec; refused above what goes to every task."""
    table = spark.read.parquet(path)
    if table.agg(F.sum(F.size("numbers"))).head()[0] > CODES:
        raise ValueError(f"a codec of more than {CODES} numbers is not sent to every task")
    return {r.name: np.array(r.numbers).reshape(r["shape"]) for r in table.collect()}
