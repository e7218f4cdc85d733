"""Queries on readings, clips and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import BODY22, RECORD_WIDTH, table
from ..functions import rotation as R
from ..functions.vectors import at, finite, part, rounded
from ..operators import losses, matching, metrics, stats, temporal
from ..plans import windows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x: str) -> str:
    """SQL of ``rounded``."""
    return f"case when isfinite({x}) then round({x} + 1e-9, 6) end"


WIDTHS = {"root_traj": 9, "root_rot6d": 6, "foot_contact": 4}


def readings(spark, sf_dir, *columns: str):
    """The first delivery of each reading, with the array columns asked for; arrays of another width than theirs are null."""
    rows = table(spark, sf_dir, "feature_fields").where("rec_id is not null and t is not null")
    return temporal.latest(rows.select("rec_id", "source", "t", "row_id", *columns), ["rec_id", "source", "t"], "row_id", {c: WIDTHS[c] for c in columns})


NAMES = ("lx", "lz", "wx", "wz", "y")


def values(spark, sf_dir):
    """Finite values of the trajectory, one row per reading."""
    rows = table(spark, sf_dir, "feature_fields").where("rec_id is not null and t is not null")
    each = {n: at(F.col("root_traj"), i) for i, n in enumerate(NAMES)}
    rows = rows.select("rec_id", "source", "t", "row_id", *(F.when(finite(x), x).alias(n) for n, x in each.items()))
    return temporal.latest(rows, ["rec_id", "source", "t"], "row_id")


READINGS = "readings as (select * from (select *, row_number() over (partition by rec_id, t order by row_id) as k from feature_fields where rec_id is not null and t is not null) where k = 1)"
VALUES = READINGS + ", vals as (select rec_id, source, t, " + ", ".join(f"case when isfinite(root_traj[{i + 1}]) then cast(root_traj[{i + 1}] as double) end as {n}" for i, n in enumerate(NAMES)) + " from readings)"
PLANS = "plans as (select clip_id, num_frames as n from (select *, row_number() over (partition by clip_id order by planned_at desc, num_frames desc) as k from clip_plans where error is null and clip_id is not null) where k = 1)"


def plans(spark, sf_dir):
    rows = table(spark, sf_dir, "clip_plans").where("error is null and clip_id is not null")
    return rows.groupBy("clip_id").agg(F.max(F.struct("planned_at", "num_frames"))["num_frames"].alias("n"))


@query(f"""with e as (select source, (i - 1) % 499 as dim, cast(x as double) as x from
  (select source, unnest(features) as x, generate_subscripts(features, 1) as i from umr_release where len(features) % 499 = 0) where isfinite(x))
select source, cast(dim as int) as dim, count(*) as n, {r6("avg(x)")} as mean, {r6("sqrt(var_pop(x) + 1e-8)")} as std from e group by source, dim""")
def wide_stats(spark, sf_dir):
    """Moments of all 499 dimensions per source."""
    m = stats.wide_moments(table(spark, sf_dir, "umr_release"), ["source"], "features", RECORD_WIDTH)
    return m.select("source", "dim", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query(f"""with {READINGS}, e as (select rec_id, i - 1 as dim, cast(x as double) as x from
  (select rec_id, unnest(root_traj) as x, generate_subscripts(root_traj, 1) as i from readings) where isfinite(x)),
c as (select rec_id, dim, quantile_cont(x, 0.01) as a, quantile_cont(x, 0.99) as b from e group by rec_id, dim)
select cast(dim as int) as dim, {r6("avg(a)")} as p01, {r6("avg(b)")} as p99 from c group by dim""")
def clip_quantile_mean(spark, sf_dir):
    """Mean over clips of each clip's 1st and 99th percentile."""
    x = stats.exploded(readings(spark, sf_dir, "root_traj"), ["rec_id"], "root_traj").where(finite(F.col("x")))
    q = stats.mean_of_quantiles(x, ["rec_id"], ["dim"], {"p01": 0.01, "p99": 0.99})
    return q.select("dim", rounded(F.col("p01")).alias("p01"), rounded(F.col("p99")).alias("p99"))


@query(f"""with {VALUES}, c as (select source, rec_id, quantile_cont(sqrt(wx * wx + wz * wz), 0.95) as q from vals where wx is not null and wz is not null group by source, rec_id)
select source, {r6("avg(q)")} as p95 from c group by source""")
def planar_p95(spark, sf_dir):
    """Mean over clips of the 95th percentile of the floor step."""
    v = values(spark, sf_dir).withColumn("x", F.sqrt(F.col("wx") * F.col("wx") + F.col("wz") * F.col("wz"))).where("x is not null")
    q = stats.mean_of_quantiles(v, ["rec_id"], ["source"], {"p95": 0.95})
    return q.select("source", rounded(F.col("p95")).alias("p95"))


@query(f"""with {READINGS}, p as (select source, unnest(list_concat(root_traj, root_rot6d, foot_contact)) as x, unnest(range(1, 20)) as i from readings
  where len(root_traj) = 9 and len(root_rot6d) = 6 and len(foot_contact) = 4)
select source, {r6("sum(cast(x as double)) filter (i <= 9)")} as root_traj, {r6("sum(cast(x as double)) filter (i between 10 and 15)")} as root_rot6d, {r6("sum(cast(x as double)) filter (i > 15)")} as foot_contact
from p where isfinite(x) group by source""")
def field_slices(spark, sf_dir):
    """Fields packed into one vector and cut out again by their slices."""
    rows = readings(spark, sf_dir, "root_traj", "root_rot6d", "foot_contact").where("size(root_traj) = 9 and size(root_rot6d) = 6 and size(foot_contact) = 4")
    packed = rows.select("source", F.concat("root_traj", "root_rot6d", "foot_contact").alias("v"))

    def total(start, width):
        x = lambda v: v.cast("double")
        return F.aggregate(part(F.col("v"), start, width), F.lit(0.0), lambda s, v: s + F.when(finite(v), x(v)).otherwise(0.0))

    sums = packed.select("source", total(0, 9).alias("a"), total(9, 6).alias("b"), total(15, 4).alias("c")).groupBy("source").agg(*(F.sum(c).alias(c) for c in "abc"))
    return sums.select("source", *(rounded(F.col(c)).alias(n) for c, n in zip("abc", ("root_traj", "root_rot6d", "foot_contact"))))


@query(f"""with {PLANS}, s as (select clip_id, unnest(range(0, n - 63, 32)) as start from plans where n >= 64
  union all select clip_id, n - 64 from plans where n >= 64 and (n - 64) % 32 <> 0),
k as (select *, row_number() over (partition by clip_id order by start) as k from s)
select clip_id, cast(start as int) as start from k where k <= 64""")
def window_starts(spark, sf_dir):
    """Starts of windows of 64 by 32, the tail appended before the cap of 64."""
    p = plans(spark, sf_dir).withColumn("starts", windows.window_starts(F.col("n"), 64, 32, 64))
    return windows.exploded(p, "starts").select("clip_id", "start")


@query(f"""with {VALUES}, c as (select rec_id, max(t) + 1 as n from vals group by rec_id),
s as (select rec_id, unnest(range(0, n - 63, 32)) as start from c where n >= 64 union all select rec_id, n - 64 from c where n >= 64 and (n - 64) % 32 <> 0)
select s.rec_id, cast(start as int) as start, count(*) as n, {r6("sum(y)")} as sum_y from s join vals v on v.rec_id = s.rec_id and v.t >= start and v.t < start + 64 group by s.rec_id, start""")
def window_sums(spark, sf_dir):
    """Readings and sum of heights in every window: a reading is sent to its windows, at most three."""
    v = values(spark, sf_dir)
    lengths = v.groupBy("rec_id").agg((F.max("t") + 1).alias("n"))
    last = F.col("n") - 64
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - 63) / 32)).cast("int")
    high = F.least(F.floor(F.col("t") / 32), F.floor(last / 32)).cast("int")
    grid = F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * 32)).otherwise(F.array().cast("array<int>"))
    tail = F.when((last % 32 != 0) & (F.col("t") >= last), F.array(last)).otherwise(F.array().cast("array<int>"))
    rows = v.join(lengths, "rec_id").where("n >= 64").select("rec_id", "y", F.explode(F.concat(grid, tail)).alias("start"))
    return rows.groupBy("rec_id", "start").agg(F.count("*").alias("n"), F.sum("y").alias("s")).select("rec_id", "start", "n", rounded(F.col("s")).alias("sum_y"))


@query(f"""with {PLANS}, t as (select clip_id, least(n, 300) - least(n, 300) % 4 as take from plans where n >= 48)
select clip_id, cast(take as int) as take, cast(coalesce(sum(take) over (order by clip_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", row_number() over (order by clip_id) - 1 as row_no from t where take >= 48""")
def ragged_plan(spark, sf_dir):
    """Variable-length plan with running offsets, without a global window."""
    p = plans(spark, sf_dir).select("clip_id", windows.take_length(F.col("n"), 48, 300, 4).alias("take")).where("take is not null")
    return windows.running_offsets(p, ["clip_id"], "take").select("clip_id", F.col("take").cast("int").alias("take"), F.col("offset").cast("long").alias("offset"), F.col("row_no").cast("long").alias("row_no"))


def _difference(k):
    def run(spark, sf_dir):
        d = temporal.differences(values(spark, sf_dir), "rec_id", "t", ["y"], k)
        return d.select("rec_id", "t", rounded(F.col("d_y")).alias("d"))

    return run


for _name, _k, _taps in (("first_diff", 1, "y - lag(y) over w"), ("accel", 2, "y - 2 * lag(y) over w + lag(y, 2) over w"), ("jerk", 3, "y - 3 * lag(y) over w + 3 * lag(y, 2) over w - lag(y, 3) over w")):
    QUERIES[_name] = _difference(_k)
    SQL[_name] = f"with {VALUES}, d as (select rec_id, t, {_taps} as x from vals window w as (partition by rec_id order by t)) select rec_id, t, {r6('x')} as d from d"


@query(f"""with {VALUES}, d as (select rec_id, t, y - first(y) over w as d, count(*) over w - 1 as k from vals window w as (partition by rec_id order by t rows between 10 preceding and current row))
select rec_id, t, case when k > 0 then {r6("d / k")} end as r from d""")
def multi_horizon(spark, sf_dir):
    """Change of height over the last ten readings, clamped at the start."""
    return temporal.rates(values(spark, sf_dir), "rec_id", "t", ["y"], 10).select("rec_id", "t", rounded(F.col("r_y")).alias("r"))


@query(f"with {VALUES}, c as (select rec_id, t, coalesce(sum(wx) over (partition by rec_id order by t), 0) as s from vals) select rec_id, t, {r6('s')} as s from c")
def cumsum(spark, sf_dir):
    """Running floor position, in stretches with a base each."""
    return temporal.running_sums(values(spark, sf_dir), "rec_id", "t", ["wx"]).select("rec_id", "t", rounded(F.col("s_wx")).alias("s"))


@query(f"""with {VALUES}, d as (select source, y - lag(y) over (partition by rec_id order by t) as d from vals)
select source, count(d) as n, {r6("avg(case when d * d < 0.00002 then 1.0 else 0.0 end) filter (d is not null)")} as rate from d group by source""")
def contact_flag(spark, sf_dir):
    """Share of readings whose squared displacement lies below a threshold."""
    d = temporal.differences(values(spark, sf_dir), "rec_id", "t", ["y"])
    flag = F.when(F.col("d_y").isNotNull(), F.when(F.col("d_y") * F.col("d_y") < 0.00002, 1.0).otherwise(0.0))
    out = d.groupBy("source").agg(F.count("d_y").alias("n"), F.avg(flag).alias("rate"))
    return out.select("source", "n", rounded(F.col("rate")).alias("rate"))


@query(f"""with {VALUES}, b as (select rec_id, t // 4 as token, ((t // 4) * 4) // 64 as block, y from vals),
m as (select rec_id, block, avg(y) as m from b group by rec_id, block)
select distinct b.rec_id, cast(b.token as int) as token, cast(b.block as int) as block, {r6("m.m")} as m from b join m on b.rec_id = m.rec_id and b.block = m.block""")
def token_blocks(spark, sf_dir):
    """Tokens of four readings share the mean of their block of 64."""
    v = values(spark, sf_dir).withColumn("token", F.floor(F.col("t") / 4).cast("int")).withColumn("block", F.floor(F.col("token") * 4 / 64).cast("int"))
    means = v.groupBy("rec_id", "block").agg(F.avg("y").alias("m"), F.collect_set("token").alias("tokens"))  # at most 16 tokens
    return means.select("rec_id", F.explode("tokens").alias("token"), "block", rounded(F.col("m")).alias("m"))


@query(f"""with {PLANS}, g as (select clip_id, n, unnest(range(0, n // 4)) as g from plans where n >= 4),
s as (select clip_id, greatest(0, round_even(cast(g * 4 + 2.0 - 90 as double), 0)) as a, least(n, round_even(cast(g * 4 + 2.0 + 90 as double), 0)) as b from g)
select clip_id, count(*) as tokens, cast(sum(a) as bigint) as sum_start, cast(sum(b) as bigint) as sum_stop from s group by clip_id""")
def token_centered(spark, sf_dir):
    """Centred spans of 180 around tokens of 4, clamped to the clip."""
    p = plans(spark, sf_dir).where("n >= 4").withColumn("s", windows.token_spans(F.col("n"), 4, 180))
    total = lambda k: F.aggregate("s", F.lit(0).cast("long"), lambda a, e: a + e[k])
    return p.select("clip_id", F.size("s").cast("long").alias("tokens"), total("start").alias("sum_start"), total("stop").alias("sum_stop"))


@query(f"""with {VALUES}, c as (select rec_id, max(t) + 1 as n from vals group by rec_id),
g as (select rec_id, n, unnest(range(0, n // 4)) as g from c),
s as (select rec_id, g, greatest(0, g * 4 - 6) as a, least(n, g * 4 + 10) as b from g)
select s.rec_id, cast(g as int) as token, {r6("avg(y)")} as m from s join vals v on v.rec_id = s.rec_id and v.t >= a and v.t < b group by s.rec_id, g""")
def frame_to_token_pool(spark, sf_dir):
    """Mean of the readings in each token's span; a reading is sent to its four tokens."""
    v = values(spark, sf_dir)
    last = v.groupBy("rec_id").agg(F.floor((F.max("t") + 1) / 4).cast("int").alias("k"))
    low = F.greatest(F.lit(0), F.floor((F.col("t") - 10) / 4).cast("int") + 1)
    high = F.least(F.col("k") - 1, F.floor((F.col("t") + 6) / 4).cast("int"))
    rows = v.join(last, "rec_id").withColumn("low", low).withColumn("high", high).where("low <= high")
    return rows.select("rec_id", "y", F.explode(F.sequence("low", "high")).alias("token")).groupBy("rec_id", "token").agg(rounded(F.avg("y")).alias("m"))


@query("""with l as (select rec_id, events from (select *, row_number() over (partition by rec_id order by line_no desc) as k from event_tracks where rec_id is not null) where k = 1),
u as (select row_id, rec_id, coalesce(len(features) // 499, num_records) // 4 as tokens, case when fps > 0 then fps else 30.0 end as fps from umr_release),
t as (select row_id, rec_id, fps, unnest(range(0, tokens)) as g from u where tokens > 0),
e as (select rec_id, unnest(events) as e, generate_subscripts(events, 1) - 1 as i from l),
m as (select t.row_id, t.g, min(e.i) as i from t left join e on e.rec_id = t.rec_id and e.e.start_time <= (t.g * 4) / t.fps and (t.g * 4) / t.fps < e.e.end_time group by t.row_id, t.g)
select row_id, count(*) as tokens, count(i) as matched, cast(coalesce(sum(i), 0) as bigint) as sum_event from m group by row_id""")
def interval_first_match(spark, sf_dir):
    """First listed event of each token, found inside the events array."""
    last = matching.last_line(table(spark, sf_dir, "event_tracks"), "rec_id", "line_no", "events")
    n = F.coalesce(F.floor(F.size(F.when(F.col("features").isNotNull(), F.col("features"))) / 499).cast("int"), F.col("num_records"))
    n = F.when(F.col("features").isNull(), F.col("num_records")).otherwise(n)
    rows = table(spark, sf_dir, "umr_release").select("row_id", "rec_id", F.floor(n / 4).cast("int").alias("k"), F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps")).where("k > 0")
    hits = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda g: matching.first_event(F.col("events"), g * 4 / F.col("fps")))
    tokens = rows.join(last, "rec_id", "left").select("row_id", hits.alias("i"))  # the clip stays one row
    total = F.aggregate("i", F.lit(0).cast("long"), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return tokens.select("row_id", F.size("i").cast("long").alias("tokens"), F.size(F.array_compact("i")).cast("long").alias("matched"), total.alias("sum_event"))


@query(f"""with {READINGS}, e as (select source, i - 1 as dim, x from (select source, unnest(root_traj) as x, generate_subscripts(root_traj, 1) as i from readings) where x is not null)
select source, cast(dim as int) as dim, count(*) as n, {r6("avg(case when isfinite(x) then 0.0 else 1.0 end)")} as share from e group by source, dim""")
def nonfinite_fraction(spark, sf_dir):
    """Share of NaN and infinite values per source and dimension."""
    x = stats.exploded(readings(spark, sf_dir, "root_traj"), ["source"], "root_traj").where("x is not null")
    return x.groupBy("source", "dim").agg(F.count("*").alias("n"), rounded(metrics.nonfinite_share(F.col("x"))).alias("share"))


GRAM = """m1 as (select rec_id, t, cast(root_rot6d[1] as double) a1, cast(root_rot6d[2] as double) a2, cast(root_rot6d[3] as double) a3, cast(root_rot6d[4] as double) b1, cast(root_rot6d[5] as double) b2, cast(root_rot6d[6] as double) b3, root_traj from readings
  where len(root_rot6d) = 6 and isfinite(list_sum(list_transform(root_rot6d, lambda v: cast(v as double))))),
m2 as (select *, greatest(sqrt(a1*a1+a2*a2+a3*a3), 1e-8) as n from m1), m3 as (select rec_id, t, root_traj, a1/n as a1, a2/n as a2, a3/n as a3, b1, b2, b3 from m2),
m4 as (select *, a1*b1+a2*b2+a3*b3 as d from m3), m5 as (select rec_id, t, root_traj, a1, a2, a3, b1-d*a1 as b1, b2-d*a2 as b2, b3-d*a3 as b3 from m4),
m6 as (select *, greatest(sqrt(b1*b1+b2*b2+b3*b3), 1e-8) as n from m5), m7 as (select rec_id, t, root_traj, a1, a2, a3, b1/n as b1, b2/n as b2, b3/n as b3 from m6),
mats as (select *, a2*b3-a3*b2 as c1, a3*b1-a1*b3 as c2, a1*b2-a2*b1 as c3 from m7)"""


def matrices(spark, sf_dir):
    r = readings(spark, sf_dir, "root_traj", "root_rot6d").where("size(root_rot6d) = 6").where(F.forall("root_rot6d", lambda v: finite(v)))
    return r.select("rec_id", "t", "root_traj", R.matrix_of_rot6d(F.col("root_rot6d")).alias("m"))


@query(f"with {READINGS}, {GRAM} select rec_id, t, " + ", ".join(f"{r6(c)} as {n}" for c, n in zip("a1 b1 c1 a2 b2 c2 a3 b3 c3".split(), "m0 m1 m2 m3 m4 m5 m6 m7 m8".split())) + " from mats")
def rot6d_gramschmidt(spark, sf_dir):
    """Rotation matrices from their first two columns."""
    return matrices(spark, sf_dir).select("rec_id", "t", *(rounded(at(F.col("m"), i)).alias(f"m{i}") for i in range(9)))


@query(f"""with {READINGS}, {GRAM}, h as (select rec_id, t, atan2(c1, c3) as h, cast(root_traj[3] as double) as x, cast(root_traj[4] as double) as z from mats where isfinite(root_traj[3]) and isfinite(root_traj[4]))
select rec_id, t, {r6("cos(h) * x - sin(h) * z")} as lx, {r6("sin(h) * x + cos(h) * z")} as lz from h""")
def yaw_rotate(spark, sf_dir):
    """Floor steps seen from the reading's own heading."""
    m = matrices(spark, sf_dir).select("rec_id", "t", R.yaw(F.col("m")).alias("h"), at(F.col("root_traj"), 2).alias("x"), at(F.col("root_traj"), 3).alias("z")).where(finite(F.col("x")) & finite(F.col("z")))
    x, z = R.into_heading(F.col("x"), F.col("z"), F.col("h"))
    return m.select("rec_id", "t", rounded(x).alias("lx"), rounded(z).alias("lz"))


@query(f"""with {READINGS}, {GRAM}, p as (select rec_id, t, a1, a2, a3, b1, b2, b3, c1, c2, c3, {", ".join(f"lag({c}) over w as p{c}" for c in "a1 a2 a3 b1 b2 b3 c1 c2 c3".split())} from mats window w as (partition by rec_id order by t)),
r as (select rec_id, t, pa1*a1+pa2*a2+pa3*a3 as r11, pa1*b1+pa2*b2+pa3*b3 as r12, pa1*c1+pa2*c2+pa3*c3 as r13, pb1*a1+pb2*a2+pb3*a3 as r21, pb1*b1+pb2*b2+pb3*b3 as r22, pb1*c1+pb2*c2+pb3*c3 as r23,
  pc1*a1+pc2*a2+pc3*a3 as r31, pc1*b1+pc2*b2+pc3*b3 as r32, pc1*c1+pc2*c2+pc3*c3 as r33 from p where pa1 is not null)
select rec_id, t, round(atan2(0.5 * sqrt((r32-r23)*(r32-r23)+(r13-r31)*(r13-r31)+(r21-r12)*(r21-r12)), 0.5 * (r11+r22+r33-1)) + 1e-7, 5) as angle from r""")
def geodesic(spark, sf_dir):
    """Angle between the rotations of neighbouring readings."""
    s = temporal.Stretches(matrices(spark, sf_dir), "rec_id", "t", 64)
    d = s.select(before=F.lag("m").over(s.by)).where("before is not null")
    return d.select("rec_id", "t", F.round(R.geodesic(F.col("before"), F.col("m")) + 1e-7, 5).alias("angle"))


STEPS = f"""{READINGS}, {GRAM}, h as (select rec_id, t, atan2(c1, c3) as h, cast(root_traj[1] as double) as lx, cast(root_traj[2] as double) as lz, cast(root_traj[3] as double) as wx, cast(root_traj[4] as double) as wz, cast(root_traj[5] as double) as y from mats
  where isfinite(root_traj[5]) and isfinite(root_traj[1]) and isfinite(root_traj[2]) and isfinite(root_traj[3]) and isfinite(root_traj[4])),
steps as (select rec_id, t, y, 0.5 * (cos(h) * lx + sin(h) * lz) + 0.5 * wx as dx, 0.5 * (cos(h) * lz - sin(h) * lx) + 0.5 * wz as dz from h)"""


def step_rows(spark, sf_dir):
    from ..streaming.integrate import steps

    r = readings(spark, sf_dir, "root_traj", "root_rot6d").where("size(root_rot6d) = 6").where(F.forall("root_rot6d", lambda v: finite(v)))
    traj = F.col("root_traj")
    for i in range(5):
        r = r.where(finite(at(traj, i)))
    return steps(r)


@query(f"with {STEPS}, s as (select rec_id, t, y, sum(dx) over w as x, sum(dz) over w as z from steps window w as (partition by rec_id order by t)) select rec_id, t, {r6('x')} as x, {r6('y')} as y, {r6('z')} as z from s")
def decode_clip(spark, sf_dir):
    """Root positions integrated from the records, half by local, half by world steps."""
    from ..streaming.integrate import decoded_batch

    d = decoded_batch(step_rows(spark, sf_dir))
    return d.select("rec_id", "t", *(rounded(F.col(c)).alias(c) for c in "xyz"))


@query(f"""with {STEPS}, s as (select rec_id, t, y, sum(dx) over w as x, sum(dz) over w as z, row_number() over w - 1 as k from steps window w as (partition by rec_id order by t))
select rec_id, t, {r6('x')} as x, {r6('y')} as y, {r6('z')} as z from s where k = t""")
def stream_decode(spark, sf_dir):
    """The same decoded by a stateful stream, as far as no record is missing."""
    import uuid

    from ..shared import materialize, shared_dir
    from ..streaming.integrate import OUT, decoded_stream

    rows = materialize(step_rows(spark, sf_dir))
    home = f"{shared_dir(spark)}/kinetrace/{uuid.uuid4().hex}"
    stream = decoded_stream(spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0]))
    run = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(OUT).parquet(f"{home}/out")
    return out.select("rec_id", "t", *(rounded(F.col(c)).alias(c) for c in "xyz"))


@query(f"""with {VALUES}, m as (select rec_id, min(y) as low, arg_min(wx, t) as x0 from vals where y is not null and wx is not null group by rec_id)
select v.rec_id, v.t, {r6("v.y - m.low")} as y, {r6("v.wx - m.x0")} as x from vals v join m on v.rec_id = m.rec_id where v.y is not null and v.wx is not null""")
def canonicalize(spark, sf_dir):
    """Heights over the lowest reading, steps against the first: two numbers per clip joined back."""
    v = values(spark, sf_dir).where("y is not null and wx is not null")
    m = v.groupBy("rec_id").agg(F.min("y").alias("low"), F.min_by("wx", "t").alias("x0"))
    return v.join(m, "rec_id").select("rec_id", "t", rounded(F.col("y") - F.col("low")).alias("y"), rounded(F.col("wx") - F.col("x0")).alias("x"))


METRICS = f"""{VALUES}, m as (select rec_id, count(*) * 1.0 as n, avg(y) as height, sum(sqrt(wx * wx + wz * wz)) as path from vals where y is not null and wx is not null and wz is not null group by rec_id)"""


def clip_metrics(spark, sf_dir):
    v = values(spark, sf_dir).where("y is not null and wx is not null and wz is not null")
    return v.groupBy("rec_id").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("height"), F.sum(F.sqrt(F.col("wx") * F.col("wx") + F.col("wz") * F.col("wz"))).alias("path"))


@query(f"""with {METRICS}, u as (select unnest(['n', 'height', 'path']) as metric, unnest([n, height, path]) as x from m)
select metric, {r6("avg(x)")} as mean, {r6("median(x)")} as median, {r6("min(x)")} as least, {r6("max(x)")} as most, count(*) as n from u group by metric""")
def metric_summary(spark, sf_dir):
    """Mean, median, extremes and count of each clip metric."""
    long = clip_metrics(spark, sf_dir).select(F.expr("stack(3, 'n', n, 'height', height, 'path', path) as (metric, x)"))
    s = stats.summary(long, ["metric"])
    return s.select("metric", *(rounded(F.col(c)).alias(c) for c in ("mean", "median", "least", "most")), "n")


@query(f"with {METRICS} select rec_id, {r6('n')} as n, {r6('height')} as height, {r6('path')} as path from m")
def per_clip_pivot(spark, sf_dir):
    """Long metrics turned into a row per clip."""
    long = clip_metrics(spark, sf_dir).select("rec_id", F.expr("stack(3, 'n', n, 'height', height, 'path', path) as (metric, x)"))
    wide = long.groupBy("rec_id").pivot("metric", ["n", "height", "path"]).agg(F.first("x"))
    return wide.select("rec_id", *(rounded(F.col(c)).alias(c) for c in ("n", "height", "path")))


@query(f"""with {READINGS}, c as (select source, cast(foot_contact[1] as double) - 0.5 as p, cast(foot_contact[2] as double) as y from readings where isfinite(foot_contact[1]) and isfinite(foot_contact[2])),
k as (select source, count(*) filter (p > 0 and y > 0.5) as tp, count(*) filter (p > 0 and not y > 0.5) as fp, count(*) filter (not p > 0 and y > 0.5) as fn from c group by source)
select source, tp, fp, fn, {r6("case when tp + fp + fn = 0 then 1.0 when tp = 0 then 0.0 else 2.0 * tp / (2.0 * tp + fp + fn) end")} as f1 from k""")
def binary_f1(spark, sf_dir):
    """F1 of one contact flag as a guess of another."""
    c = readings(spark, sf_dir, "foot_contact").select("source", (at(F.col("foot_contact"), 0) - 0.5).alias("p"), at(F.col("foot_contact"), 1).alias("y")).where(finite(F.col("p")) & finite(F.col("y")))
    p, y = F.col("p") > 0, F.col("y") > 0.5
    return c.groupBy("source").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), rounded(metrics.f1(F.col("p"), F.col("y"))).alias("f1"))


@query(f"""with {READINGS}, c as (select source, cast(root_traj[5] as double) as l, cast(foot_contact[1] as double) as y, cast(root_traj[3] as double) - cast(root_traj[1] as double) as d from readings
  where isfinite(root_traj[5]) and isfinite(root_traj[3]) and isfinite(root_traj[1]) and isfinite(foot_contact[1])),
e as (select source, l, y, d, 1 / (1 + exp(-l)) as p, greatest(l, 0) + ln(1 + exp(-abs(l))) as sp, greatest(-l, 0) + ln(1 + exp(-abs(l))) as sn from c)
select source, {r6("avg(case when abs(d) < 1 then 0.5 * d * d else abs(d) - 0.5 end)")} as huber, {r6("avg(2.0 * y * sn + (1 - y) * sp)")} as bce,
  {r6("avg((0.5 * y + 0.5 * (1 - y)) * pow(1 - (y * p + (1 - y) * (1 - p)), 2) * (y * sn + (1 - y) * sp))")} as focal from e group by source""")
def huber_bce_focal(spark, sf_dir):
    """Smooth L1, weighted cross-entropy and focal loss."""
    traj = F.col("root_traj")
    c = readings(spark, sf_dir, "root_traj", "foot_contact").select("source", at(traj, 4).alias("l"), at(F.col("foot_contact"), 0).alias("y"), at(traj, 2).alias("a"), at(traj, 0).alias("b"))
    for k in "laby":
        c = c.where(finite(F.col(k)))
    d, l, y = F.col("a") - F.col("b"), F.col("l"), F.col("y")
    return c.groupBy("source").agg(rounded(F.avg(losses.huber(d))).alias("huber"), rounded(F.avg(losses.bce(l, y, 2.0))).alias("bce"), rounded(F.avg(losses.focal(l, y))).alias("focal"))


@query()
def resample_polyphase(spark, sf_dir):
    """Heights of every umr_release clip brought to 50 readings a second (NumPy FIR; no SQL)."""
    import numpy as np
    import pyarrow as pa

    from ..kernels.signal import resample

    def work(batches):
        for batch in batches:
            out = []
            for x, fps in zip(batch.column("features"), batch.column("fps").to_pylist()):
                v = x.values.to_numpy(zero_copy_only=False).reshape(-1, RECORD_WIDTH)[:, 4].astype(np.float64)
                v = np.where(np.isfinite(v), v, 0.0)
                out.append(resample(v, fps if fps and fps > 0 else 30.0, 50.0))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(out, pa.list_(pa.float64()))], ["row_id", "y"])

    rows = table(spark, sf_dir, "umr_release").where(f"size(features) > 0 and size(features) % {RECORD_WIDTH} = 0").select("row_id", "fps", "features")
    return rows.mapInArrow(work, "row_id long, y array<double>").select("row_id", F.transform("y", lambda v: F.round(v, 4)).alias("y"))


@query()
def pose_metrics(spark, sf_dir):
    """All joint metrics of each clip against its positions on a 5 cm grid (Procrustes; no SQL)."""
    import numpy as np
    import pyarrow as pa

    from ..operators.metrics import joint_metrics

    names = [*joint_metrics(np.zeros((4, 2, 3)), np.zeros((4, 2, 3)))][:-1]

    def work(batches):
        for batch in batches:
            rows = []
            for k, x in zip(batch.column("row_id").to_pylist(), batch.column("joints77_pos")):
                g = x.values.to_numpy(zero_copy_only=False).reshape(-1, 77, 3).astype(np.float64)
                g = np.where(np.isfinite(g), g, 0.0)
                rows.append({"row_id": k} | {n: (round(v, 3) if np.isfinite(v) else None) if n != "n_frames" else v for n, v in joint_metrics(np.round(g[:, BODY22] * 20) / 20, g[:, BODY22]).items()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row_id", pa.int64()), *((n, pa.float64()) for n in names), ("n_frames", pa.int32())]))

    rows = table(spark, sf_dir, "umr_release").where("size(joints77_pos) > 0 and size(joints77_pos) % 231 = 0").select("row_id", "joints77_pos")
    return rows.mapInArrow(work, "row_id long, " + ", ".join(f"{n} double" for n in names) + ", n_frames int")
