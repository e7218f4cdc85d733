"""Implausible readings: spikes, stuck values and impossible values per source.

One Arrow pass decomposes every series (``kernels.wavelet``) and writes a compact row
per series: heights of short excursions, runs of zero detail, impossible readings, and
histograms of its details and runs.  The histograms add up to each source's ordinary
detail and run length, by which the excursions and runs are then judged.

Null and NaN readings are missing and never reported; rows without an id, or without a
reading number, cannot be named and are left out; of several deliveries of a reading the
latest counts.  An excursion at either end of a recording has one edge and is judged by it;
in two readings alone none is told.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import JOINT_WIDTH, RECORD_WIDTH, slices
from ..kernels import wavelet
from ..shared import materialize

RATIO = 16.0  #: an excursion is this many times the median nonzero change of its source
RUN_RISK = 5e-7  #: chance of a run that long under the source's ordinary repeats
FLOOR, CEILING = -0.5, 4.0  #: bounds of a height over the floor, metres
ROTATION = 1.5  #: bound of a rotation entry
FEW = 50  #: changes of all sources that a source's own are mixed with; repeats that tell how they go on
TAIL = 0.05  #: share of a source's runs that counts as its ordinary long ones
CHUNK, HALO = 4096, 1024  #: readings of a series in one task, and shared with either neighbour

SCHEMA = (
    "field string, rec_id string, source string, "
    "xg array<int>, xt array<int>, xh array<double>, "  # excursions: group, reading, height
    "rg array<int>, rl array<int>, rt array<array<int>>, "  # runs: group, length, readings
    "sg array<int>, sl array<int>, sc array<boolean>, st array<array<int>>, "  # stretches of one run: as runs; does it begin in the core
    "mg array<int>, lo array<double>, hi array<double>, "  # stretches: least and largest reading of each group
    "pt array<int>, "  # impossible readings
    "hk array<int>, hn array<int>, "  # detail histogram: group * 1024 + bin
    "lk array<int>, ln array<int>"  # run histogram: group * 1024 + length
)


@dataclass(frozen=True)
class Field:
    """How one array field is read: groups of dimensions share a usual change."""

    name: str
    width: int
    group: tuple[int, ...]  #: group of each dimension
    whole: bool  #: a reading is stuck only as a whole
    heights: tuple[int, ...]  #: dimensions bounded by floor and ceiling
    rotations: tuple[int, ...] = ()
    longest: int = 12  #: runs below this are never called stuck


def _features() -> Field:
    at = slices()
    group, k = [], 9
    for name, (_, width) in at.items():
        group += range(9) if name == "root_traj" else [k] * width
        k += name != "root_traj"
    start = at["root_rot6d"][0]
    stop = sum(at["joints76_rot6d"])
    return Field("features", RECORD_WIDTH, tuple(group), True, (4,), tuple(range(start, stop)), 8)


FEATURES = _features()
JOINTS = Field("joints77_pos", JOINT_WIDTH, tuple(d % 3 for d in range(JOINT_WIDTH)), True, tuple(range(1, JOINT_WIDTH, 3)), (), 8)
ROOT_TRAJ = Field("root_traj", 9, tuple(range(9)), False, (4,), (), 16)


def _counts(keys: np.ndarray) -> tuple[list[int], list[int]]:
    k, n = np.unique(keys, return_counts=True)
    return k.tolist(), n.tolist()


def scan(field: Field, x: np.ndarray, t: np.ndarray, core: np.ndarray, part: bool = False) -> dict:
    """One series: readings ``x`` in order, their numbers ``t``; only ``core`` ones report.

    A series that never moves is no stuck one.  A stretch (``part``) cannot tell: what is one
    run here is reported apart, with the bounds by which the whole series is judged.
    """
    n, group = len(x), np.array(field.group)
    groups = int(group.max()) + 1
    y, missing = wavelet.fill(x.astype(np.float64))
    odd = np.isinf(x)
    with np.errstate(invalid="ignore"):
        h = x[:, field.heights]
        odd[:, field.heights] |= (h < FLOOR) | (h > CEILING)
        if field.rotations:
            odd[:, field.rotations] |= np.abs(x[:, field.rotations]) > ROTATION
    bad = odd.any(axis=1)
    out = {"pt": t[bad & core].tolist()}

    # impossible readings are reported as such, and are no level to leave
    level, absent = (y, missing) if not bad.any() else wavelet.fill(np.where(odd, np.nan, x.astype(np.float64)))
    high = np.where(absent, 0.0, wavelet.excursions(level))
    step = np.abs(np.diff(y, axis=0))
    step[missing[1:] | ~core[1:, None]] = 0.0
    xg, xt, xh, keys = [], [], [], []
    for g in range(groups):
        dims = group == g
        top = high[:, dims].max(axis=1)
        at = np.flatnonzero((top > 0) & core)
        xg += [g] * len(at)
        xt += t[at].tolist()
        xh += top[at].tolist()
        d = step[:, dims]
        keys.append(wavelet.bin_of(d[d > 1e-7]) + g * 1024)
    out |= {"xg": xg, "xt": xt, "xh": xh}
    out["hk"], out["hn"] = _counts(np.concatenate(keys))

    rg, rl, rt, lengths = [], [], [], []
    still = {k: [] for k in ("sg", "sl", "sc", "st", "mg", "lo", "hi")}
    if field.whole:
        present = ~missing.all(axis=1)
        at = [(0, np.flatnonzero(present), y)]
    else:
        at = [(d, np.flatnonzero(~missing[:, d]), y[:, d : d + 1]) for d in range(field.width)]
    for g, rows, v in at:
        if part and len(rows):
            for k, b in (("mg", g), ("lo", float(v[rows].min())), ("hi", float(v[rows].max()))):
                still[k].append(b)
        if len(rows) < 2:
            continue
        v = v[rows]
        starts, ends = wavelet.runs((v[1:] == v[:-1]).all(axis=1))
        if len(starts) < 2:  # never moves here
            if part:
                for k, b in (("sg", g), ("sl", len(rows)), ("sc", bool(core[rows[0]])), ("st", t[rows[core[rows]]].tolist())):
                    still[k].append(b)
            continue
        length = ends - starts
        lengths.append(np.minimum(length[core[rows[starts]]], wavelet.RUN_CAP) + g * 1024)
        for k in np.flatnonzero(length >= wavelet.SHORTEST_RUN):
            inside = rows[starts[k] : ends[k]]
            inside = inside[core[inside]]
            if len(inside):
                rg.append(g)
                rl.append(int(length[k]))
                rt.append(t[inside].tolist())
    out |= {"rg": rg, "rl": rl, "rt": rt} | still
    out["lk"], out["ln"] = _counts(np.concatenate(lengths) if lengths else np.empty(0, np.int64))
    return out


def _rows(column: pa.Array, width: int) -> list[np.ndarray | None]:
    """The readings of each array as a matrix; None for null, empty and ragged ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    off, ok = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    v = column.values.to_numpy(zero_copy_only=False)
    return [v[a:b].reshape(-1, width) if k and b > a and (b - a) % width == 0 else None for a, b, k in zip(off[:-1], off[1:], ok)]


def _out(rows: list[dict]) -> pa.RecordBatch:
    i32 = pa.list_(pa.int32())
    kinds = {"field": pa.string(), "rec_id": pa.string(), "source": pa.string(), "xg": i32, "xt": i32, "xh": pa.list_(pa.float64()), "rg": i32, "rl": i32, "rt": pa.list_(i32), "sg": i32, "sl": i32, "sc": pa.list_(pa.bool_()), "st": pa.list_(i32), "mg": i32, "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()), "pt": i32, "hk": i32, "hn": i32, "lk": i32, "ln": i32}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def scan_clips(clips: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Scan clips whose arrays hold the whole series: no shuffle."""

    def work(batches):
        for batch in batches:
            rec, src = batch.column("rec_id").to_pylist(), batch.column("source").to_pylist()
            for at in range(0, len(rec), 64):
                rows, part = [], batch.slice(at, 64)
                for field in fields:
                    for i, x in enumerate(_rows(part.column(field.name), field.width)):
                        if x is not None:
                            t = np.arange(len(x), dtype=np.int32)
                            found = scan(field, x, t, np.ones(len(x), bool))
                            rows.append(found | {"field": field.name, "rec_id": rec[at + i], "source": src[at + i]})
                if rows:
                    yield _out(rows)

    return clips.where("rec_id is not null").select("rec_id", "source", *(f.name for f in fields)).mapInArrow(work, SCHEMA)


def scan_readings(readings: DataFrame, field: Field, order: str = "ingested_at") -> DataFrame:
    """Scan readings kept one per row.

    Of the deliveries of one reading the latest by ``order`` counts, as a whole (of those at
    the same time, the one with the larger hash); they are combined before the shuffle where
    they meet.  A task then has a stretch of ``CHUNK`` readings of a recording and sees
    ``HALO`` more on either side, so that neither a long recording nor many copies make a long
    task, and no excursion, and no run of up to ``HALO`` readings, is lost at a border.
    """
    dims = [f"_v{d}" for d in range(field.width)]

    def work(table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        order = np.argsort(t)
        x = np.stack([table.column(d).to_numpy() for d in dims], axis=1)[order]
        t, chunk = t[order].astype(np.int32), table.column("_chunk")[0].as_py()
        found = scan(field, x, t, t // CHUNK == chunk, part=True)
        one = _out([found | {"field": field.name, "rec_id": table.column("rec_id")[0].as_py(), "source": table.column("source")[0].as_py()}])
        return pa.Table.from_batches([one])

    c, m = f"t div {CHUNK}", f"t % {CHUNK}"
    spread = F.expr(f"explode(filter(array({c}, if({m} < {HALO}, {c} - 1, -1L), if({m} >= {CHUNK - HALO}, {c} + 1, -1L)), k -> k >= 0)) as _chunk")
    fits = F.size(field.name) == field.width
    each = [F.get(field.name, F.lit(d)).cast("float") for d in range(field.width)]
    values = [F.when(fits & ~F.isnan(v), v).alias(name) for v, name in zip(each, dims)]
    # one number that orders deliveries keeps this a hash aggregate; all dimensions follow it alike
    when = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-1)) * 4096 + F.pmod(F.xxhash64(field.name), F.lit(4096))
    rows = readings.where("rec_id is not null and t >= 0").select("rec_id", "source", "t", when.alias("_when"), *values)
    once = rows.groupBy("rec_id", "source", "t").agg(*(F.max_by(d, "_when").alias(d) for d in dims))
    return once.select("*", spread).groupBy("rec_id", "source", "_chunk").applyInArrow(work, SCHEMA)


def usual_change(scanned: DataFrame) -> DataFrame:
    """Median nonzero change of each source, field and group: (field, source, g, usual).

    It is mixed with the median over all sources, as if ``FEW`` changes spoke for that: what a
    source has delivered little of is judged by the others, and less so with every change.
    """
    cells = (
        scanned.select("field", "source", F.explode(F.arrays_zip("hk", "hn")).alias("c"))
        .groupBy("field", "source", (F.expr("c.hk div 1024").cast("int")).alias("g"), F.expr("c.hk % 1024").alias("b"))
        .agg(F.sum("c.hn").alias("n"))
    )
    # the pooled cells of all sources ride along as source null -> pooled flag
    both = cells.withColumn("pool", F.lit(False)).unionByName(
        cells.groupBy("field", "g", "b").agg(F.sum("n").alias("n")).select("field", F.lit(None).cast("string").alias("source"), "g", "b", "n", F.lit(True).alias("pool"))
    )
    median = F.expr(
        "aggregate(c, named_struct('seen', 0L, 'b', -1), (a, x) -> named_struct('seen', a.seen + x.n,"
        " 'b', if(a.b < 0 and (a.seen + x.n) * 2 >= total, x.b, a.b))).b"
    )
    found = both.groupBy("pool", "field", "source", "g").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("c"), F.sum("n").alias("total"))
    found = found.select("pool", "field", "source", "g", "total", F.pow(F.lit(2.0), (median - wavelet.BIN_SHIFT + 0.5) / wavelet.BINS).alias("usual"))
    pooled = found.where("pool").select("field", "g", F.col("usual").alias("usual_all"))
    mixed = F.exp((F.col("total") * F.ln("usual") + FEW * F.ln("usual_all")) / (F.col("total") + FEW))
    return found.where("not pool").join(pooled, ["field", "g"]).select("field", "source", "g", mixed.alias("usual"))


def moving_stills(scanned: DataFrame) -> DataFrame:
    """(field, rec_id, source, g, l, core, ts): stretches of one run, of series that move elsewhere."""
    key = ["field", "rec_id", "source", "g"]
    bounds = scanned.select(*key[:3], F.explode(F.arrays_zip("mg", "lo", "hi")).alias("c")).select(*key[:3], F.col("c.mg").alias("g"), "c.lo", "c.hi")
    runs = scanned.select(*key[:3], F.explode(F.arrays_zip("sg", "sl", "sc", "st")).alias("c")).select(*key[:3], F.col("c.sg").alias("g"), F.struct(F.col("c.sl").alias("l"), F.col("c.sc").alias("core"), F.col("c.st").alias("ts")).alias("s"))
    moving = bounds.groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    on = F.expr("s.field = m.field and s.rec_id = m.rec_id and s.source <=> m.source and s.g = m.g")
    return runs.alias("s").join(moving.alias("m"), on, "left_semi").select(*key, "s.l", "s.core", "s.ts")


def usual_run(scanned: DataFrame, stills: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Run length beyond which a source, field and group counts as stuck.

    How likely a reading ordinarily repeats is read from the longest ``TAIL`` of the runs, and
    from how many runs of two and three readings there are for each of one and two; stuck runs
    are few and long, so neither follows them.
    """
    cells = scanned.select("field", "source", F.explode(F.arrays_zip("lk", "ln")).alias("c")).select("field", "source", F.expr("cast(c.lk div 1024 as int)").alias("g"), F.expr("cast(c.lk % 1024 as int)").alias("l"), F.col("c.ln").cast("long").alias("n"))
    cells = cells.unionByName(stills.where("core").select("field", "source", "g", F.least("l", F.lit(wavelet.RUN_CAP)).alias("l"), F.lit(1).cast("long").alias("n")))
    per = cells.groupBy("field", "source", "g", "l").agg(F.sum("n").alias("n")).groupBy("field", "source", "g").agg(
        F.sort_array(F.collect_list(F.struct("l", "n"))).alias("c"), F.sum("n").alias("total"), *(F.sum(F.when(F.col("l") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3))
    )  # at most RUN_CAP lengths
    tail = F.expr(f"aggregate(c, named_struct('seen', 0L, 'l', -1), (a, x) -> if(a.l < 0, named_struct('seen', a.seen + x.n, 'l', if((a.seen + x.n) >= total * {1 - TAIL}, x.l, -1)), a))")
    per = per.select("field", "source", "g", "total", "n1", "n2", "n3", tail.alias("tail"))
    longest = F.pow((F.col("total") - F.col("tail.seen") + 0.5) / (F.col("total") + 1.0), 1.0 / F.col("tail.l"))

    def ratio(a, b, least):
        return F.when((F.col(b) >= least) & (F.col(a) < F.col(b)), F.col(a) / F.col(b)).otherwise(0.0)

    p = F.greatest(longest, ratio("n2", "n1", FEW), ratio("n3", "n2", FEW))
    least = F.create_map(*(x for f in fields for x in (F.lit(f.name), F.lit(float(f.longest)))))
    return per.select("field", "source", "g", F.greatest(least[F.col("field")], 1 + F.ceil(F.log(F.lit(RUN_RISK)) / F.log(p))).alias("most"))


def implausible(scanned: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """(field, rec_id, t) of implausible readings, from the scanned rows of all fields."""
    stills = moving_stills(scanned)
    change, run = usual_change(scanned), usual_run(scanned, stills, fields)
    spikes = (
        scanned.select("field", "rec_id", "source", F.explode(F.arrays_zip("xg", "xt", "xh")).alias("c"))
        .select("field", "rec_id", "source", F.col("c.xg").alias("g"), F.col("c.xt").alias("t"), F.col("c.xh").alias("h"))
        .alias("s")
        .join(change.alias("u"), F.expr("s.field = u.field and s.source <=> u.source and s.g = u.g"))
        .where(F.col("h") >= RATIO * F.col("usual"))
        .select("s.field", "s.rec_id", "s.t")
    )
    stuck = (
        scanned.select("field", "rec_id", "source", F.explode(F.arrays_zip("rg", "rl", "rt")).alias("c"))
        .select("field", "rec_id", "source", F.col("c.rg").alias("g"), F.col("c.rl").alias("l"), F.col("c.rt").alias("ts"))
        .unionByName(stills.drop("core"))
        .alias("s")
        .join(run.alias("u"), F.expr("s.field = u.field and s.source <=> u.source and s.g = u.g"))
        .where(F.col("l") >= F.col("most"))
        .select("s.field", "s.rec_id", F.explode("s.ts").alias("t"))
    )
    impossible = scanned.select("field", "rec_id", F.explode("pt").alias("t"))
    return spikes.unionByName(stuck).unionByName(impossible).distinct()


def find(umr: DataFrame, readings: DataFrame) -> DataFrame:
    """Distinct (field, rec_id, t) of implausible readings of both tables."""
    fields = (FEATURES, JOINTS, ROOT_TRAJ)
    scanned = materialize(scan_clips(umr, fields[:2]).unionByName(scan_readings(readings, ROOT_TRAJ)))
    return implausible(scanned, fields)
