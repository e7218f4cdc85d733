"""Queries on clips, caches, crops, losses, validators and jobs, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import caches, codec, pipelines
from ..catalog import BODY22, RECORD_WIDTH, slices, table
from ..functions import rotation as R
from ..functions import vectors as V
from ..functions.vectors import at, finite, rounded
from ..operators import losses, metrics, spikes, stats, temporal, validate
from ..plans import windows
from ..shared import materialize, shared_dir
from ..sources import files
from .series import GRAM, READINGS, VALUES, matrices, r6, readings, values

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def umr(spark, sf_dir):
    return table(spark, sf_dir, "umr_release")


WHOLE = f"size(features) > 0 and size(features) % {RECORD_WIDTH} = 0"
#: features of whole records, one row per record: r counts from 0
RECORDS = "recs as (select row_id, source, len(features) // 499 as n, unnest(range(0, len(features) // 499)) as r, features from umr_release where len(features) > 0 and len(features) % 499 = 0)"
#: positions of the body's joints, one row per frame, joint j of the 22, with a copy on a grid of 1/16 m
PLACES = "list_value(" + ", ".join(map(str, BODY22)) + ")"
FRAMES = f"""pf as (select row_id, unnest(range(0, len(joints77_pos) // 231)) as f, joints77_pos as p from umr_release where len(joints77_pos) > 0 and len(joints77_pos) % 231 = 0),
pj as (select row_id, f, p, unnest(range(0, 22)) as j from pf), pk as (select row_id, f, j, (f * 231 + ({PLACES})[j + 1] * 3)::bigint as o, p from pj),
pos as (select row_id, f, j, {", ".join(f"case when isfinite(p[o + {k + 1}]) then p[o + {k + 1}]::double else 0 end as {c}" for k, c in enumerate("xyz"))} from pk),
both_ as (select *, {", ".join(f"floor({c} * 16 + 0.5) / 16 as p{c}" for c in "xyz")} from pos)"""


def _arrow_joints(spark, sf_dir, names, schema, work):
    """Runs ``work`` (clip of joints [T, 77, 3], its copy on the grid -> dict) on every clip."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for k, x in zip(batch.column("row_id").to_pylist(), batch.column("joints77_pos")):
                g = x.values.to_numpy(zero_copy_only=False).reshape(-1, 77, 3).astype(np.float64)
                g = np.where(np.isfinite(g), g, 0.0)
                rows.append({"row_id": k} | work(np.floor(g * 16 + 0.5) / 16, g))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row_id", pa.int64()), *((n, pa.float64()) for n in names)]))

    rows = umr(spark, sf_dir).where("size(joints77_pos) > 0 and size(joints77_pos) % 231 = 0").select("row_id", "joints77_pos")
    return rows.mapInArrow(run, schema)


_DIST = "sqrt(({x})*({x}) + ({y})*({y}) + ({z})*({z}))"
_N3 = lambda a: _DIST.format(x=a.format(c="x"), y=a.format(c="y"), z=a.format(c="z"))
_N2 = lambda a: f"sqrt(({a.format(c='x')})*({a.format(c='x')}) + ({a.format(c='z')})*({a.format(c='z')}))"


@query(f"""with {FRAMES}, rel as (select b.*, {", ".join(f"b.{c} - r.{c} as l{c}, b.p{c} - r.p{c} as q{c}" for c in "xyz")} from both_ b join both_ r on b.row_id = r.row_id and b.f = r.f and r.j = 0),
v as (select *, {", ".join(f"{a}{c} - lag({a}{c}) over w as d{a or 'g'}{c}" for a in ("", "p", "l", "q") for c in "xyz")} from rel window w as (partition by row_id, j order by f))
select row_id, {r6(f"avg({_N3('p{c} - {c}')}) filter (j = 0) * 1000")} as ape_root, {r6(f"avg({_N2('p{c} - {c}')}) filter (j = 0) * 1000")} as ape_traj, {r6(f"avg({_N3('q{c} - l{c}')}) * 1000")} as ape_pose, {r6(f"avg({_N3('p{c} - {c}')}) * 1000")} as ape_joints,
{r6(f"avg({_N3('dp{c} - dg{c}')}) filter (j = 0) * 1000")} as ave_root, {r6(f"avg({_N2('dp{c} - dg{c}')}) filter (j = 0) * 1000")} as ave_traj, {r6(f"avg({_N3('dq{c} - dl{c}')}) * 1000")} as ave_pose, {r6(f"avg({_N3('dp{c} - dg{c}')}) * 1000")} as ave_joints from v group by row_id""")
def ape_ave(spark, sf_dir):
    """Errors of positions and of their steps: root, floor path, pose and all joints."""
    names = [f"{k}_{n}" for k in ("ape", "ave") for n in ("root", "traj", "pose", "joints")]
    clips = _arrow_joints(spark, sf_dir, names, "row_id long, " + ", ".join(f"{n} double" for n in names), lambda p, g: {n: v for n, v in metrics.joint_metrics(p[:, BODY22], g[:, BODY22]).items() if n in names})
    return clips.select("row_id", *(rounded(F.col(n)).alias(n) for n in names))


@query(f"""with {FRAMES}, rel as (select b.row_id, b.f, b.j, {", ".join(f"b.{c} - r.{c} as l{c}, b.p{c} - r.p{c} as q{c}" for c in "xyz")} from both_ b join both_ r on b.row_id = r.row_id and b.f = r.f and r.j = 0),
d as (select *, {", ".join(f"{a}{c} - 2 * lag({a}{c}) over w + lag({a}{c}, 2) over w as a{a}{c}, {a}{c} - 3 * lag({a}{c}) over w + 3 * lag({a}{c}, 2) over w - lag({a}{c}, 3) over w as j{a}{c}" for a in "lq" for c in "xyz")} from rel window w as (partition by row_id, j order by f))
select row_id, {r6(f"avg({_N3('q{c} - l{c}')}) * 1000")} as mpjpe, {r6(f"avg({_N3('aq{c} - al{c}')}) * 1000")} as accel_err, {r6(f"avg({_N3('al{c}')}) * 1000")} as accel_gt, {r6(f"avg({_N3('jq{c} - jl{c}')}) * 1000")} as jerk_err, {r6(f"avg({_N3('jl{c}')}) * 1000")} as jerk_gt from d group by row_id""")
def motion_errors(spark, sf_dir):
    """Joint distances against the pelvis, and errors of second and third differences."""
    names = ["mpjpe", "accel_err", "accel_gt", "jerk_err", "jerk_gt"]
    clips = _arrow_joints(spark, sf_dir, names, "row_id long, " + ", ".join(f"{n} double" for n in names), lambda p, g: {n: v for n, v in metrics.joint_metrics(p[:, BODY22], g[:, BODY22]).items() if n in names})
    return clips.select("row_id", *(rounded(F.col(n)).alias(n) for n in names))


@query(f"""with pf as (select row_id, unnest(range(0, len(joints77_pos) // 231)) as f, joints77_pos as p from umr_release where len(joints77_pos) > 0 and len(joints77_pos) % 231 = 0),
r as (select row_id, f, p[f * 231 + 1]::double as x, p[f * 231 + 3]::double as z from pf), g as (select row_id, f, case when isfinite(x) then x else 0 end as x, case when isfinite(z) then z else 0 end as z from r),
b as (select *, floor(x * 16 + 0.5) / 16 as px, floor(z * 16 + 0.5) / 16 as pz from g), d as (select *, x - lag(x) over w as dx, z - lag(z) over w as dz, px - lag(px) over w as dpx, pz - lag(pz) over w as dpz from b window w as (partition by row_id order by f)),
s as (select row_id, coalesce(sum(sqrt(dpx*dpx + dpz*dpz)), 0) as path, coalesce(sum(sqrt(dx*dx + dz*dz)), 0) as gt, row_id % 5 <> 0 as there from d group by row_id)
select row_id, {r6("path")} as path, {r6("case when there then abs(path - gt) else path end")} as drift from s""")
def path_drift(spark, sf_dir):
    """Length of the root's floor path, and how far off it is; every fifth clip has no truth to hold against."""
    import numpy as np

    def work(p, g):
        return {n: float(np.sqrt((np.diff(x[:, 0][:, [0, 2]], axis=0) ** 2).sum(axis=1)).sum()) for n, x in (("path", p), ("gt", g))}

    clips = _arrow_joints(spark, sf_dir, ["path", "gt"], "row_id long, path double, gt double", work)
    return clips.select("row_id", rounded(F.col("path")).alias("path"), rounded(metrics.drift(F.col("path"), F.col("gt"), F.col("row_id") % 5 != 0)).alias("drift"))


@query(f"""with {READINGS.replace("feature_fields where", "feature_fields where")}, {GRAM}, p as (select rec_id, t, a1, a2, a3, b1, b2, b3, c1, c2, c3, {", ".join(f"lag({c}) over w as p{c}" for c in "a1 a2 a3 b1 b2 b3 c1 c2 c3".split())} from mats window w as (partition by rec_id order by t)),
r as (select rec_id, t, pa1*a1+pa2*a2+pa3*a3 as r11, pa1*b1+pa2*b2+pa3*b3 as r12, pa1*c1+pa2*c2+pa3*c3 as r13, pb1*a1+pb2*a2+pb3*a3 as r21, pb1*b1+pb2*b2+pb3*b3 as r22, pb1*c1+pb2*c2+pb3*c3 as r23,
  pc1*a1+pc2*a2+pc3*a3 as r31, pc1*b1+pc2*b2+pc3*b3 as r32, pc1*c1+pc2*c2+pc3*c3 as r33 from p where pa1 is not null),
g as (select rec_id, t, atan2(0.5 * sqrt((r32-r23)*(r32-r23)+(r13-r31)*(r13-r31)+(r21-r12)*(r21-r12)), 0.5 * (r11+r22+r33-1)) as angle from r)
select rec_id, count(*) as n, round(sqrt(avg(angle * angle)) + 1e-7, 5) as rot_rmse, round(sqrt(avg(angle * angle) filter (t % 2 = 0)) + 1e-7, 5) as even_rmse from g group by rec_id""")
def rotation_rmse(spark, sf_dir):
    """Root mean square angle between the rotations of neighbouring readings, all and those of even readings."""
    s = temporal.Stretches(matrices(spark, sf_dir), "rec_id", "t", 64)
    d = s.select(before=F.lag("m").over(s.by)).where("before is not null").select("rec_id", "t", R.geodesic(F.col("before"), F.col("m")).alias("angle"))
    one = lambda c: F.round(c + 1e-7, 5)
    return d.groupBy("rec_id").agg(F.count("*").alias("n"), one(metrics.rotation_rmse(F.col("angle"))).alias("rot_rmse"), one(metrics.rotation_rmse(F.col("angle"), F.col("t") % 2 == 0)).alias("even_rmse"))


def _clean_clips(spark, sf_dir):
    """Clips that can be decoded: whole and finite features, with an anchor."""
    return umr(spark, sf_dir).where(WHOLE).where("size(init_root_pos) = 3 and size(init_root_rot6d) = 6 and size(init_joints76_rot6d) = 456").where(~F.exists("features", lambda v: ~finite(v)))


@query("""select row_id, cast(len(features) // 499 + 1 as bigint) as frames, true as same from umr_release where len(features) > 0 and len(features) % 499 = 0 and len(init_root_pos) = 3 and len(init_root_rot6d) = 6 and len(init_joints76_rot6d) = 456
and len(list_filter(features, lambda v: v is null or not isfinite(v))) = 0""")
def stream_equivalence(spark, sf_dir):
    """Frames of every clip decoded by a stream that keeps the last frame as its anchor, and whether they are those of the whole clip."""
    from ..streaming import integrate as I

    clips = materialize(_clean_clips(spark, sf_dir).select(F.col("row_id").cast("string").alias("rec_id"), "features", *I.ANCHOR))
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.struct(t.alias("t"), F.slice("features", t * RECORD_WIDTH + 1, RECORD_WIDTH).alias("features")))
    records = materialize(clips.select("rec_id", F.explode(each).alias("r"), *I.ANCHOR).select("rec_id", "r.t", "r.features", *I.ANCHOR))
    home = f"{shared_dir(spark)}/kinetrace/{uuid.uuid4().hex}"
    stream = I.poses_stream(spark.readStream.schema(records.schema).parquet(records.inputFiles()[0].rsplit("/", 1)[0])) if records.inputFiles() else None
    if stream is None:
        return spark.createDataFrame([], "row_id long, frames long, same boolean")
    run = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    e = I.pose_equivalence(spark.read.schema(I.POSES).parquet(f"{home}/out"), pipelines.decode(clips).where("error is null"))
    return e.select(F.col("rec_id").cast("long").alias("row_id"), "frames", ((F.col("feat_rmse") < 1e-4) & (F.col("trans_rmse_mm") < 0.1) & (F.col("rot_rmse") < 1e-4)).alias("same"))


# caches, crops and batches


@query("""select * from (values ('no cache', false), ('ready', true), ('same parameters', true), ('other window', false), ('other manifest', false), ('ragged ready', true), ('teacher fits', true), ('teacher short', false)) as v(what, holds)""")
def cache_valid(spark, sf_dir):
    """What is told of caches written from the release rows: fixed windows and ragged heads."""
    home, clips = f"{shared_dir(spark)}/kinetrace/{uuid.uuid4().hex}", umr(spark, sf_dir)
    manifest = files.ordered_hash(table(spark, sf_dir, "recordings").where("rec_id is not null and uri is not null"), ["manifest_line", "rec_id", "uri"], ["rec_id", "uri"]).head().sha256
    found = [("no cache", caches.is_ready(spark, f"{home}/none"))]
    caches.write_fixed(clips, f"{home}/fixed", 64, 32, 64, manifest)
    knobs = {"window": 64, "step": 32, "max_windows_per_clip": 64, "manifest_hash": manifest}
    found += [("ready", caches.is_ready(spark, f"{home}/fixed")), ("same parameters", caches.matches(spark, f"{home}/fixed", **knobs))]
    found += [("other window", caches.matches(spark, f"{home}/fixed", **knobs | {"window": 32})), ("other manifest", caches.matches(spark, f"{home}/fixed", **knobs | {"manifest_hash": "0"}))]
    caches.write_ragged(clips, f"{home}/ragged", 8, 300, 4)
    found.append(("ragged ready", caches.is_ready(spark, f"{home}/ragged")))
    index, _ = caches.open_ragged(spark, f"{home}/ragged")
    tokens = index.select("row_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / 4).cast("int") - 1)).alias("token"))
    for what, teacher in (("teacher fits", tokens), ("teacher short", tokens.where("token > 0"))):
        try:
            caches.open_ragged(spark, f"{home}/ragged", teacher, per_token=True)
            found.append((what, True))
        except ValueError:
            found.append((what, False))
    return spark.createDataFrame(found, "what string, holds boolean")


@query("""with t as (select row_id, rec_id, least(len(features) // 499, 300) - least(len(features) // 499, 300) % 4 as take from umr_release where len(features) // 499 >= 8)
select row_id, rec_id, cast(take as bigint) as length, cast(coalesce(sum(take) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", row_number() over (order by row_id) - 1 as row_no from t where take >= 8""")
def ragged_index(spark, sf_dir):
    """Index of a ragged cache, written and opened again."""
    home = f"{shared_dir(spark)}/kinetrace/{uuid.uuid4().hex}"
    caches.write_ragged(umr(spark, sf_dir), home, 8, 300, 4)
    index, _ = caches.open_ragged(spark, home)
    return index.select("row_id", "rec_id", "length", "offset", F.col("row_no").cast("long").alias("row_no"))


CROP = "((((row_id % 1073741824) * 2654435761 + 12345) % 2147483648) >> 7)"
GOOD = "features is not null and joints77_pos is not null and abs(fps - 50) <= 1e-3 and len(features) // 499 >= 16 and len(features) % 499 = 0 and len(joints77_pos) = (len(features) // 499 + 1) * 231"


@query(f"""with c as (select *, {CROP} % (len(features) // 499 - 16 + 1) as s from umr_release where {GOOD})
select row_id, cast(s as int) as start, cast(len(features[s * 499 + 1 : (s + 16) * 499]) as int) as n, cast(len(joints77_pos[s * 231 + 1 : (s + 17) * 231]) as int) as n_joints,
{r6("case when s = 0 then init_root_pos[1] else joints77_pos[s * 231 + 1] end::double")} as x, {r6("case when s = 0 then init_root_pos[2] else joints77_pos[s * 231 + 2] end::double")} as y,
{r6("case when s = 0 then init_root_rot6d[1] else features[(s - 1) * 499 + 10] end::double")} as turn, {r6("case when s = 0 then init_joints76_rot6d[456] else features[(s - 1) * 499 + 471] end::double")} as pose,
{r6("features[s * 499 + 5]::double")} as first_y, {r6("features[(s + 15) * 499 + 5]::double")} as last_y from c""")
def crop_anchor(spark, sf_dir):
    """A window of 16 records of every clip, with the pose it starts from."""
    c = pipelines.crops(umr(spark, sf_dir), 16).where("error is null")
    get = lambda name, i: rounded(F.get(name, F.lit(i)))
    return c.select(
        "row_id", "start", F.size("features").alias("n"), F.size("joints77_pos").alias("n_joints"), get("init_root_pos", 0).alias("x"), get("init_root_pos", 1).alias("y"), get("init_root_rot6d", 0).alias("turn"),
        get("init_joints76_rot6d", 455).alias("pose"), get("features", 4).alias("first_y"), get("features", 15 * RECORD_WIDTH + 4).alias("last_y"),
    )


@query("""select case when features is null or joints77_pos is null then 'no features or positions' when fps is null or not abs(fps - 50) <= 1e-3 then 'other rate' when len(features) // 499 < 16 then 'too short'
when len(features) % 499 <> 0 or len(joints77_pos) <> (len(features) // 499 + 1) * 231 then 'ragged' else 'cropped' end as outcome, count(*) as n from umr_release group by all""")
def crop_outcomes(spark, sf_dir):
    """Clips that gave a window, and why the others did not."""
    return pipelines.crops(umr(spark, sf_dir), 16).groupBy(F.coalesce("error", F.lit("cropped")).alias("outcome")).agg(F.count("*").alias("n"))


LENGTHS = "l as (select row_id, len(features) // 499 as n, row_number() over (order by row_id) - 1 as pos from umr_release where len(features) // 499 >= 1)"


def _batches(spark, sf_dir):
    """Rows in order, eight to a batch."""
    rows = umr(spark, sf_dir).where(f"size(features) >= {RECORD_WIDTH}").select("row_id", F.floor(F.size("features") / RECORD_WIDTH).cast("int").alias("n"))
    return windows.running_offsets(rows, ["row_id"], "n", row="pos").select("row_id", "n", F.floor(F.col("pos") / 8).cast("long").alias("batch"), (F.col("pos") % 8).cast("int").alias("place"))


@query(f"""with {LENGTHS}, b as (select *, pos // 8 as batch, greatest(min(n) over (partition by pos // 8) // 4 * 4, 4) as crop from l)
select row_id, batch, cast(crop as int) as crop, cast(case when n >= crop then {CROP} % ((n - crop) // 4 + 1) * 4 else 0 end as int) as start from b""")
def batch_crop(spark, sf_dir):
    """Clips of a batch cut to the shortest of them, whole tokens long and starting at one."""
    c = pipelines.batch_crops(_batches(spark, sf_dir), "batch", "n", 4, aligned=True)
    return c.select("row_id", "batch", "crop", "start")


@query(f"""with {LENGTHS} select pos // 8 as batch, string_agg(row_id::varchar, ',' order by pos) as ids, string_agg(n::varchar, ',' order by pos) as lengths from l group by all""")
def collate(spark, sf_dir):
    """Rows of each batch put together in order."""
    c = pipelines.collated(_batches(spark, sf_dir), "batch", "place", ["row_id", "n"])
    return c.select("batch", F.array_join(F.col("row_id").cast("array<string>"), ",").alias("ids"), F.array_join(F.col("n").cast("array<string>"), ",").alias("lengths"))


@query(f"""with {RECORDS}, t as (select distinct row_id, n, r // 4 as token from recs where r // 4 < n // 4 and not (row_id % 3 = 0 and r // 4 = 1)), k as (select row_id, count(*) as k, sum(token * token) as s from t group by row_id),
c as (select row_id, len(features) // 499 as n from umr_release where len(features) > 0 and len(features) % 499 = 0)
select c.row_id, coalesce(k, 0) as n_tokens, coalesce(k, 0) = n // 4 as complete, cast(coalesce(s, 0) as bigint) as total from c left join k on c.row_id = k.row_id""")
def teacher_join(spark, sf_dir):
    """Clips with their tokens, a ragged one-to-many join, and whether none is missing."""
    clips = umr(spark, sf_dir).where(WHOLE).select("row_id", F.floor(F.size("features") / RECORD_WIDTH).cast("int").alias("take"))
    tokens = clips.where("take >= 4").select("row_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("take") / 4).cast("int") - 1)).alias("token")).where("not (row_id % 3 = 0 and token = 1)").withColumn("v", F.col("token") * F.col("token"))
    j = pipelines.tokens_of(clips, tokens)
    return j.select("row_id", F.col("n_tokens").cast("long").alias("n_tokens"), "complete", F.coalesce(F.aggregate("tokens", F.lit(0).cast("long"), lambda s, e: s + e["v"]), F.lit(0)).cast("long").alias("total"))


# records


@query(f"""with {RECORDS}, x as (select row_id, r, unnest(range(0, 499)) as d, features as f from recs), v as (select row_id, r, d, f[r * 499 + d + 1] as v from x)
select row_id, cast(r as int) as r, {r6("sum(case when isfinite(v) then v::double else 0 end) filter (d < 495)")} as masked, {r6("sum(case when isfinite(v) then v::double else 0 end) filter (d < 15 or d >= 471)")} as traj_contact, {r6("sum(case when isfinite(v) then v::double else 0 end) filter (d >= 15 and d < 471)")} as joints, true as joined from v group by row_id, r""")
def stream_split(spark, sf_dir):
    """Records split into the two streams and joined again, and all but the contacts."""
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.struct(r.alias("r"), F.slice("features", r * RECORD_WIDTH + 1, RECORD_WIDTH).alias("v")))
    rows = umr(spark, sf_dir).where(WHOLE).select("row_id", F.explode(each).alias("e")).select("row_id", "e.r", "e.v")
    rest, joints = V.split_streams(F.col("v"))
    rows = rows.select("row_id", "r", "v", rest.alias("rest"), joints.alias("joints"))
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda s, v: s + F.when(finite(v), v.cast("double")).otherwise(0.0)))
    return rows.select("row_id", "r", total(V.without_contacts(F.col("v"))).alias("masked"), total("rest").alias("traj_contact"), total("joints").alias("joints"), (V.joined_streams(F.col("rest"), F.col("joints")) == F.col("v")).alias("joined"))


@query("select row_id, cast(len(features) // 499 as int) as records, cast(len(features) // 499 + 1 as int) as frames, len(features) % 499 = 0 as whole from umr_release where features is not null")
def derived_sizes(spark, sf_dir):
    """Records and frames of every clip."""
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    return umr(spark, sf_dir).where("features is not null").select("row_id", n.alias("records"), (n + 1).alias("frames"), (F.size("features") % RECORD_WIDTH == 0).alias("whole"))


_FIELD = "case " + " ".join(f"when dim >= {a} and dim < {a + w} then '{n}'" for n, (a, w) in slices().items()) + " end"
_START = "case " + " ".join(f"when dim >= {a} and dim < {a + w} then {a}" for n, (a, w) in slices().items()) + " end"


@query(f"""with e as (select (i - 1) % 499 as dim, cast(x as double) as x from (select unnest(features) as x, generate_subscripts(features, 1) as i from umr_release where len(features) % 499 = 0) where isfinite(x)),
s as (select dim, count(*) as n, avg(x) as mean, sqrt(var_pop(x) + 1e-8) as sd from e group by dim), k as (select *, {_FIELD} as field, dim - {_START} as i from s)
select field, cast(i as int) as i, n, {r6("mean")} as mean, case when field <> 'foot_contact' then {r6("sd")} end as std, case when field = 'foot_contact' then {r6("mean")} end as rate from k""")
def field_statistics(spark, sf_dir):
    """Statistics of every field of the record, contacts by their rate."""
    s = pipelines.field_statistics(umr(spark, sf_dir), [])
    return s.select("field", "i", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "std", "rate")))


@query(f"""with {READINGS}, e as (select source, i - 1 as dim, x::double as x from (select source, unnest(foot_contact) as x, generate_subscripts(foot_contact, 1) as i from readings where len(foot_contact) = 4) where isfinite(x))
select source, {", ".join(r6(f"coalesce(avg(x) filter (dim = {d}), 0)") + f" as rate{d}, count(x) filter (dim = {d}) as n{d}" for d in range(4))} from e group by source""")
def positive_rates(spark, sf_dir):
    """Share of readings with each foot on the ground."""
    c = readings(spark, sf_dir, "foot_contact").where("foot_contact is not null").select("source", *(F.when(finite(F.get("foot_contact", F.lit(d))), at(F.col("foot_contact"), d)).alias(f"c{d}") for d in range(4)))
    c = c.where(" or ".join(f"c{d} is not null" for d in range(4)))
    out = None
    for d in range(4):
        one = stats.positive_rate(c, ["source"], F.col(f"c{d}")).select("source", rounded(F.col("rate")).alias(f"rate{d}"), F.col("n").alias(f"n{d}"))
        out = one if out is None else out.join(one.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
    return out


@query(f"""with {VALUES}, e as (select rec_id, unnest([lx, lz, y]) as x, unnest([0, 1, 2]) as dim from vals), p as (select rec_id, dim, avg(x) as mean, stddev_pop(x) as sd from e where x is not null group by rec_id, dim), w as (select rec_id, max(sd) <= 0.02 as constant from p group by rec_id)
select p.rec_id, cast(dim as int) as dim, {r6("mean")} as mean, constant from p join w on p.rec_id = w.rec_id""")
def identity_collapse(spark, sf_dir):
    """Vectors that hardly vary in a recording collapse to their mean."""
    v = values(spark, sf_dir).select("rec_id", F.posexplode(F.array("lx", "lz", "y")).alias("dim", "x")).where("x is not null")
    return stats.collapsed(v, "rec_id", most=0.02).select("rec_id", "dim", rounded(F.col("mean")).alias("mean"), "constant")


@query(f"""with {VALUES}, k as (select rec_id, t // 4 as token, avg(y) as m from vals where y is not null group by rec_id, t // 4) select rec_id, count(*) as tokens, {r6("avg(m)")} as latent from k group by rec_id""")
def latent_mean_pool(spark, sf_dir):
    """Mean over time of what tokens hold."""
    k = values(spark, sf_dir).where("y is not null").groupBy("rec_id", F.floor(F.col("t") / 4).alias("token")).agg(F.avg("y").alias("m"))
    return k.groupBy("rec_id").agg(F.count("*").alias("tokens"), rounded(F.avg("m")).alias("latent"))


@query(f"""with c as (select row_id, len(features) // 499 as n, features as f from umr_release where len(features) > 0 and len(features) % 499 = 0), g as (select *, greatest(1, round_even(n * 0.6, 0))::bigint as m from c),
k as (select *, unnest(range(0, m)) as k from g), a as (select row_id, k, f, n, case when m > 1 then k * (n - 1) / (m - 1)::double else 0.0 end as p from k), b as (select *, floor(p)::bigint as lo, ceil(p)::bigint as hi from a),
v as (select row_id, k, p - lo as w, f[lo * 499 + 5]::double as x, f[hi * 499 + 5]::double as y from b) select row_id, k, {r6("x * (1 - w) + y * w")} as y from v""")
def resample_linear(spark, sf_dir):
    """Heights of every clip resampled to three fifths of the rate, along straight lines."""
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    y = F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.struct(r.alias("t"), F.get("features", r * RECORD_WIDTH + 4).cast("double").alias("y")))
    rows = umr(spark, sf_dir).where(WHOLE).select("row_id", F.explode(y).alias("e")).select("row_id", "e.t", "e.y")
    return temporal.resampled(rows, "row_id", "t", "y", 0.6).select("row_id", "k", rounded(F.col("y")).alias("y"))


# losses on records: the copy on a grid of 1/16 stands for the reconstruction


_PAIR = f"x as (select row_id, source, unnest(features)::double as g, generate_subscripts(features, 1) - 1 as i from umr_release where len(features) > 0 and len(features) % 499 = 0), v as (select row_id, source, i // 499 as r, i % 499 as d, g from x), e as (select row_id, source, r, d, g, floor(g * 16 + 0.5) / 16 as p from v where isfinite(g))"
_H = "case when abs(p - g) < 1 then 0.5 * (p - g) * (p - g) else abs(p - g) - 0.5 end"
_B = "g * (greatest(-p, 0) + ln(1 + exp(-abs(p)))) + (1 - g) * (greatest(p, 0) + ln(1 + exp(-abs(p))))"


def _record_pairs(spark, sf_dir):
    """(row_id, source, r, d, g, p): values of every record and their copies on a grid."""
    rows = umr(spark, sf_dir).where(WHOLE).select("row_id", "source", F.posexplode("features").alias("i", "g")).select("row_id", "source", F.floor(F.col("i") / RECORD_WIDTH).cast("int").alias("r"), (F.col("i") % RECORD_WIDTH).alias("d"), F.col("g").cast("double").alias("g"))
    return rows.where(finite(F.col("g"))).withColumn("p", F.floor(F.col("g") * 16 + 0.5) / 16)


def _loss_terms(pairs):
    """One aggregate per term: square errors of the fields, contact cross-entropy, smooth L1."""
    g, p, d = F.col("g"), F.col("p"), F.col("d")
    inside = {n: (d >= a) & (d < a + w) for n, (a, w) in slices().items()}
    terms = {n: F.avg(F.when(inside[n], (p - g) * (p - g))) for n in ("root_traj", "root_rot6d", "joints76_rot6d", "sparse_vel")}
    terms["foot_contact"] = F.avg(F.when(inside["foot_contact"], losses.bce(p, g)))
    terms |= {"recon": F.avg(losses.huber(p - g)), "traj_smooth": F.avg(F.when(inside["root_traj"], losses.huber(p - g))), "rot_smooth": F.avg(F.when(inside["root_rot6d"], losses.huber(p - g)))}
    return pairs.groupBy("source").agg(*(c.alias(n) for n, c in terms.items()))


WEIGHTS = {"root_traj": 1.0, "root_rot6d": 1.0, "joints76_rot6d": 2.0, "sparse_vel": 0.5, "foot_contact": 0.1}
_MSE = lambda lo, hi: f"avg((p - g) * (p - g)) filter (d >= {lo} and d < {hi})"


@query(f"""with {_PAIR}, t as (select source, {_MSE(0, 9)} as root_traj, {_MSE(9, 15)} as root_rot6d, {_MSE(15, 471)} as joints76_rot6d, {_MSE(471, 495)} as sparse_vel, avg({_B}) filter (d >= 495) as foot_contact from e group by source)
select source, {", ".join(f"{r6(n)} as {n}" for n in WEIGHTS)}, {r6(" + ".join(f"{w} * {n}" for n, w in WEIGHTS.items()))} as total from t""")
def loss_total(spark, sf_dir):
    """Losses of the fields and their weighted sum."""
    t = _loss_terms(_record_pairs(spark, sf_dir))
    return t.select("source", *(rounded(F.col(n)).alias(n) for n in WEIGHTS), rounded(losses.weighted({n: F.col(n) for n in WEIGHTS}, WEIGHTS)).alias("total"))


@query(f"""with {_PAIR}, t as (select source, avg({_H}) as recon, avg({_H}) filter (d < 9) as traj, avg({_H}) filter (d >= 9 and d < 15) as rot from e group by source)
select source, {r6("recon")} as recon, {r6("(1.0 * 9 * traj + 0.5 * 6 * rot) / 15")} as header, {r6("recon + 2 * (1.0 * 9 * traj + 0.5 * 6 * rot) / 15")} as total from t""")
def smooth_recon(spark, sf_dir):
    """Smooth L1 of records, and of the root by its channels."""
    t = _loss_terms(_record_pairs(spark, sf_dir)).withColumn("header", losses.root_header(F.col("traj_smooth"), F.col("rot_smooth"), 1.0, 0.5))
    return t.select("source", rounded(F.col("recon")).alias("recon"), rounded(F.col("header")).alias("header"), rounded(F.col("recon") + 2 * F.col("header")).alias("total"))


@query(f"""with {RECORDS}, j as (select source, r, unnest(range(0, 77)) as j, features as f from recs), k as (select source, j, {", ".join(f"f[r * 499 + 9 + 6 * j + {i + 1}]::double as v{i}" for i in range(6))} from j),
o as (select source, j, pow(v0 * v3 + v1 * v4 + v2 * v5, 2) as x from k where isfinite(v0 + v1 + v2 + v3 + v4 + v5)) select source, {r6("avg(x) filter (j = 0) + avg(x) filter (j > 0)")} as penalty from o group by source""")
def rot6d_penalty(spark, sf_dir):
    """How far the two columns of root and joints are from right angles."""
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    rows = umr(spark, sf_dir).where(WHOLE).select("source", "features", F.explode(F.sequence(F.lit(0), n * 77 - 1)).alias("k"))
    spot = F.floor(F.col("k") / 77).cast("int") * RECORD_WIDTH + 9 + 6 * (F.col("k") % 77)
    v = rows.select("source", (F.col("k") % 77).alias("j"), *(F.get("features", spot.cast("int") + i).cast("double").alias(f"v{i}") for i in range(6)))
    v = v.where(finite(sum((F.col(f"v{i}") for i in range(1, 6)), F.col("v0"))))
    x = losses.orthogonality([F.col(f"v{i}") for i in range(3)], [F.col(f"v{i}") for i in range(3, 6)])
    return v.groupBy("source").agg((F.avg(F.when(F.col("j") == 0, x)) + F.avg(F.when(F.col("j") > 0, x))).alias("penalty")).select("source", rounded(F.col("penalty")).alias("penalty"))


_FEET = (69, 70, 74, 75)


_FOOT = " ".join(f"when {j} then {i}" for i, j in enumerate(_FEET))


@query(f"""with u as (select row_id, features, joints77_pos from umr_release where len(features) > 0 and len(features) % 499 = 0 and len(joints77_pos) = (len(features) // 499 + 1) * 231),
x as (select row_id, unnest(joints77_pos)::double as v, generate_subscripts(joints77_pos, 1) - 1 as i from u), g as (select row_id, i // 231 as f, i % 231 as k, case when isfinite(v) then v else 0 end as g from x), b as (select *, floor(g * 16 + 0.5) / 16 as p from g),
d as (select *, p - lag(p) over w as dp, g - lag(g) over w as dg, p - 2 * lag(p) over w + lag(p, 2) over w as ap, g - 2 * lag(g) over w + lag(g, 2) over w as ag from b window w as (partition by row_id, k order by f)),
y as (select row_id, unnest(features)::double as c, generate_subscripts(features, 1) - 1 as i from u), t as (select row_id, i // 499 + 1 as f, i % 499 - 495 as foot, case when isfinite(c) then c else 0 end as c from y where i % 499 >= 495),
l as (select row_id, {r6("avg(abs(p - g))")} as fk_joint, {r6("avg(abs(dp - dg))")} as fk_vel, {r6("avg(abs(ap - ag))")} as fk_acc from d group by row_id),
m as (select d.row_id, sum(abs(dp) * c) as moved, sum(c) / 3 as down from d join t on d.row_id = t.row_id and d.f = t.f and t.foot = case d.k // 3 {_FOOT} end where d.f >= 1 group by d.row_id)
select l.*, {r6("coalesce(moved, 0) / (coalesce(down, 0) * 3 + 1e-6)")} as skate from l left join m on l.row_id = m.row_id""")
def fk_geometry(spark, sf_dir):
    """Losses of joint positions, their steps and second differences, and of feet that slide while they are down."""
    import numpy as np
    import pyarrow as pa

    from ..kernels.motion import fk_losses

    names = ("fk_joint", "fk_vel", "fk_acc", "skate")

    def work(batches):
        for batch in batches:
            rows = []
            for k, x, f in zip(batch.column("row_id").to_pylist(), batch.column("joints77_pos"), batch.column("features")):
                g = np.nan_to_num(x.values.to_numpy(zero_copy_only=False).reshape(-1, 77, 3).astype(np.float64), posinf=0, neginf=0)
                down = np.nan_to_num(f.values.to_numpy(zero_copy_only=False).reshape(-1, RECORD_WIDTH)[:, 495:].astype(np.float64), posinf=0, neginf=0)
                rows.append({"row_id": k} | fk_losses(np.floor(g * 16 + 0.5) / 16, g, down))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row_id", pa.int64()), *((n, pa.float64()) for n in names)]))

    rows = umr(spark, sf_dir).where(WHOLE).where(f"size(joints77_pos) = (size(features) / {RECORD_WIDTH} + 1) * 231").select("row_id", "joints77_pos", "features")
    return rows.mapInArrow(work, "row_id long, " + ", ".join(f"{n} double" for n in names)).select("row_id", *(rounded(F.col(n)).alias(n) for n in names))


# codecs


@query("""select row_id, cast(len(features) // 499 // 4 * 4 as int) as n, true as same from umr_release where len(features) % 499 = 0 and len(features) // 499 >= 4""")
def codec_identity(spark, sf_dir):
    """Clips cut to whole tokens and given back as they are."""
    rows = umr(spark, sf_dir)
    out = codec.build(codec.Config.of(name="identity", unknown=1)).reconstruct(rows).withColumnRenamed("features", "back")
    j = rows.select("row_id", "features").join(out, "row_id")
    return j.select("row_id", F.floor(F.size("back") / RECORD_WIDTH).cast("int").alias("n"), (F.slice("features", F.lit(1), F.size("back")) == F.col("back")).alias("same"))


_GROUPS = {"root": (0, 9, 4), "contact": (495, 499, 2)}
_POOLED = f"""u as (select row_id, features, len(features) // 499 // 4 * 4 as n from umr_release where len(features) % 499 = 0 and len(features) // 499 >= 4),
x as (select row_id, n, unnest(features)::double as v, generate_subscripts(features, 1) - 1 as i from u), y as (select row_id, i // 499 as r, i % 499 as d, case when isfinite(v) then v else 0 end as v from x where i // 499 < n),
p as ({" union all ".join(f"select row_id, '{g}' as grp, r // {s} as token, d - {a} as d, avg(v) as v from y where d >= {a} and d < {b} group by row_id, r // {s}, d" for g, (a, b, s) in _GROUPS.items())}),
f as (select row_id, row_number() over (order by row_id) - 1 as code from (select distinct row_id from u order by row_id limit 8))"""


@query(f"""with {_POOLED}, bk as (select grp, code, d, v from p join f using (row_id) where token = 0), q as (select p.row_id, p.grp, p.token, bk.code, round(sum((p.v - bk.v) * (p.v - bk.v)), 9) as dist from p join bk on p.grp = bk.grp and p.d = bk.d group by all),
k as (select *, row_number() over (partition by row_id, grp, token order by dist, code) as k from q) select row_id, grp, cast(token as int) as token, cast(code as bigint) as code from k where k = 1""")
def codec_tokens(spark, sf_dir):
    """Codes of two groups of fields, each at its own rate; the codes are the first tokens of eight clips."""
    return _group_codec(spark, sf_dir).tokens(umr(spark, sf_dir)).select("row_id", "grp", "token", "code")


def _group_codec(spark, sf_dir):
    import numpy as np

    rows = umr(spark, sf_dir).where(WHOLE).where(f"size(features) >= {4 * RECORD_WIDTH}")
    first = rows.orderBy("row_id").limit(8).select("row_id", F.slice("features", 1, 4 * RECORD_WIDTH).alias("x")).collect()
    x = [np.array(r.x, np.float64).reshape(4, RECORD_WIDTH) for r in first]
    books = {f"{g}.book.0": np.stack([codec.pooled(v[:s, a:b], s)[0] for v in x]) for g, (a, b, s) in _GROUPS.items()}
    config = codec.Config.of(name="vector", dims={g: (a, b) for g, (a, b, _) in _GROUPS.items()}, strides={g: s for g, (_, _, s) in _GROUPS.items()})
    return codec.build(config, books)


@query(f"""with {_POOLED}, bk as (select grp, code, d, v from p join f using (row_id) where token = 0), q as (select p.row_id, p.grp, p.token, bk.code, round(sum((p.v - bk.v) * (p.v - bk.v)), 9) as dist from p join bk on p.grp = bk.grp and p.d = bk.d group by all),
k as (select *, row_number() over (partition by row_id, grp, token order by dist, code) as k from q) select row_id, k.grp, cast(count(*) as bigint) as n, {r6("sum(v::float)")} as total from k join bk on k.grp = bk.grp and k.code = bk.code where k.k = 1 group by row_id, k.grp""")
def codec_decode(spark, sf_dir):
    """Clips decoded from their codes: numbers of each group and their sum, once a token."""
    out = _group_codec(spark, sf_dir).reconstruct(umr(spark, sf_dir))
    rows = out.select("row_id", F.posexplode("features").alias("i", "v")).select("row_id", F.floor(F.col("i") / RECORD_WIDTH).alias("r"), (F.col("i") % RECORD_WIDTH).alias("d"), "v")
    grp = F.lit(None).cast("string")
    for g, (a, b, s) in _GROUPS.items():
        grp = F.when((F.col("d") >= a) & (F.col("d") < b) & (F.col("r") % s == 0), g).otherwise(grp)
    return rows.select("row_id", grp.alias("grp"), F.col("v").cast("double").alias("v")).where("grp is not null").groupBy("row_id", "grp").agg(F.count("*").alias("n"), rounded(F.sum("v")).alias("total"))


# validators and jobs


@query("""select row_id, cast(least(300, greatest(1, round_even((len(features) // 499) * 30.0::double / case when fps > 0 then fps else 50.0 end, 0))) as int) as frames, 499 as width from umr_release where len(features) > 0 and len(features) % 499 = 0""")
def teacher_smoke(spark, sf_dir):
    """Frames a teacher is given of every clip, and the width of what it makes of them."""
    return pipelines.teacher_check(umr(spark, sf_dir), pipelines.mean_pool).select("row_id", "frames", "width")


@query(f"""with {READINGS}, v as (select rec_id, t, {", ".join(f"case when isfinite(root_traj[{i}]) then root_traj[{i}]::double end as {n}" for i, n in ((3, "wx"), (4, "wz"), (5, "y")))}, {", ".join(f"case when isfinite(foot_contact[{i}]) then foot_contact[{i}]::double end as c{i}" for i in range(1, 5))},
  (root_traj is null or len(root_traj) <> 9 or len(list_filter(root_traj, lambda a: a is null or not isfinite(a))) > 0) as bad from readings), f as (select rec_id, max(fps) as fps from recordings where fps > 0 group by rec_id),
s as (select v.rec_id, count(*) as n, count(*) filter (bad) as n_bad, avg(y) as y_mean, min(y) as y_min, max(y) as y_max, quantile_cont(sqrt(wx * wx + wz * wz), 0.99) as step_p99, {", ".join(f"avg(c{i}) as rate{i}" for i in range(1, 5))} from v group by v.rec_id)
select s.rec_id, n, n_bad, {r6("y_mean")} as y_mean, {r6("y_min")} as y_min, {r6("y_max")} as y_max, {r6("step_p99 * fps")} as speed_p99, coalesce(greatest(rate1, rate2, rate3, rate4) < 1e-6, false) as no_contact, coalesce(fps < 5 or fps > 240, false) as odd_rate from s left join f on s.rec_id = f.rec_id""")
def source_report(spark, sf_dir):
    """Checks and statistics of every recording as it came in."""
    rows = readings(spark, sf_dir, "root_traj", "foot_contact")
    rates = table(spark, sf_dir, "recordings").where("fps > 0").groupBy("rec_id").agg(F.max("fps").alias("fps"))
    r = validate.recording_report(rows, rates)
    return r.select("rec_id", "n", "n_bad", *(rounded(F.col(c)).alias(c) for c in ("y_mean", "y_min", "y_max", "speed_p99")), "no_contact", "odd_rate")


@query(f"""with r as (select row_id, case when rec_id in (select rec_id from umr_release where split = 'test') then 'skipped' when features is null or len(features) % 499 <> 0 then 'failed' when len(features) // 499 < 16 then 'short' else 'written' end as status from umr_release)
select status, count(*) as n from r group by status""")
def run_counters(spark, sf_dir):
    """What a run does with the rows, counted: those of recordings in the test split were done before."""
    done = umr(spark, sf_dir).where("split = 'test' and rec_id is not null").select("rec_id")
    return pipelines.outcomes(umr(spark, sf_dir), 16, done).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""select source, {r6("sum(fps * num_records) filter (fps is not null and num_records is not null) / nullif(sum(num_records) filter (fps is not null), 0)")} as mean, cast(sum(num_records) as bigint) as size from norm_stats group by source""")
def epoch_mean(spark, sf_dir):
    """Means of batches weighted by their sizes."""
    n = table(spark, sf_dir, "norm_stats")
    return n.groupBy("source").agg(rounded(metrics.weighted_mean(F.col("fps"), F.when(F.col("fps").isNotNull(), F.col("num_records")))).alias("mean"), F.sum("num_records").cast("long").alias("size"))


@query("select distinct metric from (select unnest(['n', 'height']) as metric union all select case when source is not null then 'path' end from recordings) where metric is not null")
def metric_names(spark, sf_dir):
    """Names of all metrics that any row has."""
    r = table(spark, sf_dir, "recordings")
    maps = r.select(F.create_map(F.lit("n"), F.lit(1), F.lit("height"), F.lit(2)).alias("m")).unionByName(r.where("source is not null").select(F.create_map(F.lit("path"), F.lit(3)).alias("m")))
    return stats.metric_names(maps, "m").withColumnRenamed("name", "metric")


@query("""with p as (select clip_id, planned_at, source_path as p from clip_plans where source_path is not null)
select p as path, string_split(p, '/')[-1] as name, case when len(string_split(p, '/')) > 1 then string_split(p, '/')[-2] end as parent, regexp_replace(p, '\\.[^./]*$', '') || '.meta.json' as meta, count(*) as n from p group by all""")
def path_parts(spark, sf_dir):
    """File name, folder, and the path of what is kept beside it."""
    p = table(spark, sf_dir, "clip_plans").where("source_path is not null")
    c = F.col("source_path")
    return p.groupBy(c.alias("path"), files.file_name(c).alias("name"), files.parent_name(c).alias("parent"), files.with_suffix(c, ".meta.json").alias("meta")).agg(F.count("*").alias("n"))


@query("""with t as (select doc_id, array_to_string(tags, ', ') || ',,' || coalesce(tags[1], '') as s from documents where tags is not null), w as (select doc_id, trim(unnest(string_split(s, ','))) as w from t)
select doc_id, count(distinct w) as n, string_agg(distinct w, ' ' order by w) as words from w where w <> '' group by doc_id""")
def comma_set(spark, sf_dir):
    """Lists written with commas, as sets."""
    t = table(spark, sf_dir, "documents").where("tags is not null").select("doc_id", F.concat(F.array_join("tags", ", "), F.lit(",,"), F.coalesce(F.get("tags", F.lit(0)), F.lit(""))).alias("s"))
    s = files.comma_set(F.col("s"))
    return t.select("doc_id", s.alias("w")).where("size(w) > 0").select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


@query("select manifest_line, rec_id from recordings where rec_id is not null order by manifest_line, rec_id limit 100")
def manifest_head(spark, sf_dir):
    """The first hundred entries of the manifest (the limit is what is asked for)."""
    return files.head(table(spark, sf_dir, "recordings").where("rec_id is not null").select("manifest_line", "rec_id"), ["manifest_line", "rec_id"], 100)


@query(f"""select row_id, cast(case when len(features) // 499 >= 16 then {CROP} % (len(features) // 499 - 16 + 1) end as int) as start from umr_release where features is not null""")
def crop_starts(spark, sf_dir):
    """A random start for every clip, the same in every run."""
    n = F.floor(F.size("features") / RECORD_WIDTH).cast("int")
    return umr(spark, sf_dir).where("features is not null").select("row_id", windows.crop_start(F.col("row_id"), n, 16).alias("start"))


@query("select row_id, rec_id, split from umr_release where row_id in (select unnest(range(1, 257)))")
def point_lookup(spark, sf_dir):
    """Rows of a list of ids, of which some are not there and one is named twice."""
    return pipelines.look_up(umr(spark, sf_dir).select("row_id", "rec_id", "split"), [*range(1, 257), 7])


@query("""with j as (select row_id, rec_id, unnest(range(0, len(joints77_pos) // 231)) as f, joints77_pos as p from umr_release where joints77_pos is not null and len(joints77_pos) % 231 = 0 and rec_id is not null),
a as (select 'joints77_pos' as field, rec_id, f as t, p[f * 231 + 1 : f * 231 + 231] as v from j),
b as (select field, rec_id, t from a where len(list_filter(v, lambda x: isinf(x))) > 0 or len(list_filter(range(0, 77), lambda k: v[k * 3 + 2] < -0.5 or v[k * 3 + 2] > 4) ) > 0),
g as (select rec_id, unnest(range(0, len(features) // 499)) as r, features as p from umr_release where features is not null and len(features) % 499 = 0 and rec_id is not null), h as (select 'features' as field, rec_id, r as t, p[r * 499 + 1 : r * 499 + 499] as v from g),
i as (select field, rec_id, t from h where len(list_filter(v, lambda x: isinf(x))) > 0 or v[5] < -0.5 or v[5] > 4 or len(list_filter(v[10:471], lambda x: not isnan(x) and abs(x) > 1.5)) > 0)
select distinct field, rec_id, cast(t as int) as t from (select * from b union all select * from i)""")
def p1_impossible(spark, sf_dir):
    """Readings of features and joints77_pos that are physically impossible whatever their source."""
    scanned = spikes.scan_clips(umr(spark, sf_dir), (spikes.FEATURES, spikes.JOINTS))
    return scanned.select("field", "rec_id", F.explode("pt").alias("t")).distinct()
