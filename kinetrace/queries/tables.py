"""Queries on vectors, codes, lookups and manifests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import vectors as V
from ..functions.vectors import rounded
from ..operators import codes, losses, matching, metrics, spikes, stats, validate
from ..plans import windows
from ..shared import materialize
from ..sources import files
from .series import r6

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


E = "e as (select vec_id, label, i - 1 as dim, cast(x as double) as x from (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings))"


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def long(spark, sf_dir):
    return stats.exploded(emb(spark, sf_dir), ["vec_id", "label"], "embedding")


@query(f"with {E} select cast(dim as int) as dim, count(*) as n, {r6('avg(x)')} as mean, {r6('sqrt(var_pop(x) + 1e-8)')} as std from e group by dim")
def dim_stats(spark, sf_dir):
    """Count, mean and deviation of every dimension."""
    m = stats.wide_moments(emb(spark, sf_dir), [], "embedding", 64)
    return m.select("dim", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


Z = f"{E}, s as (select dim, avg(x) as mu, greatest(sqrt(var_pop(x) + 1e-8), 1e-6) as sd from e group by dim)"


def _normal(spark, sf_dir):
    one = stats.as_vectors(stats.packed(stats.wide_moments(emb(spark, sf_dir), [], "embedding", 64), 1 << 30))
    return emb(spark, sf_dir).crossJoin(F.broadcast(one))  # one row


@query(f"with {Z} select e.vec_id, cast(e.dim as int) as dim, {r6('(x - mu) / sd')} as z from e join s on e.dim = s.dim")
def zscore(spark, sf_dir):
    """Vectors normalised by the corpus statistics."""
    z = _normal(spark, sf_dir).select("vec_id", V.zscore(F.col("embedding"), F.col("mu"), F.col("sd")).alias("z"))
    return z.select("vec_id", F.posexplode("z").alias("dim", "z")).select("vec_id", "dim", rounded(F.col("z")).alias("z"))


@query(f"with {Z} select cast(e.dim as int) as dim, round(max(abs(((x - mu) / sd) * sd + mu - x)), 6) as worst from e join s on e.dim = s.dim group by e.dim")
def zscore_inverse(spark, sf_dir):
    """Largest error of normalising and undoing it."""
    d = _normal(spark, sf_dir)
    back = V.unzscore(V.zscore(F.col("embedding"), F.col("mu"), F.col("sd")), F.col("mu"), F.col("sd"))
    x = d.select(F.posexplode(F.zip_with(back, "embedding", lambda a, b: F.abs(a - b))).alias("dim", "d"))
    return x.groupBy("dim").agg(F.round(F.max("d"), 6).alias("worst"))


PLACES = [0, 3, 3, 17, 63, 5]


@query("select vec_id, " + ", ".join(f"{r6(f'cast(embedding[{p + 1}] as double)')} as g{k}" for k, p in enumerate(PLACES)) + " from embeddings")
def gather_dims(spark, sf_dir):
    """Fixed dimensions picked, one twice."""
    g = emb(spark, sf_dir).select("vec_id", V.pick(F.col("embedding"), PLACES).alias("g"))
    return g.select("vec_id", *(rounded(V.at(F.col("g"), k)).alias(f"g{k}") for k in range(len(PLACES))))


@query(f"""with {E}, c as (select label, dim, avg(x) as c from e group by label, dim)
select e.vec_id, {r6("sqrt(sum(x * x))")} as norm, {r6("sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c)))")} as cos from e join c on e.label = c.label and e.dim = c.dim group by e.vec_id""")
def l2_normalize(spark, sf_dir):
    """Norm of each vector, and cosine to the centroid of its label."""
    c = long(spark, sf_dir).groupBy("label", "dim").agg(F.avg("x").alias("c")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("c"))
    d = emb(spark, sf_dir).join(c.select("label", F.transform("c", lambda e: e["c"]).alias("c")), "label")
    return d.select("vec_id", rounded(V.norm(F.col("embedding"))).alias("norm"), rounded(V.cosine(V.unit(F.col("embedding")), F.col("c"))).alias("cos"))


BOOK = "b as (select label as code, embedding as v from embeddings where vec_id in (select min(vec_id) from embeddings group by label))"
DIST = "round(list_sum(list_transform(list_zip({a}, {b}), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double)))), 9)"
ASSIGN = f"""{BOOK}, d as (select vec_id, label, embedding, code, v, {DIST.format(a='embedding', b='v')} as dist from embeddings, b),
a as (select * from (select *, row_number() over (partition by vec_id order by dist, code) as k from d) where k = 1)"""


def book(spark, sf_dir):
    """First vector of each label: as many codes as there are labels."""
    return emb(spark, sf_dir).groupBy(F.col("label").alias("code")).agg(F.min_by("embedding", "vec_id").alias("v"))


def _assigned(spark, sf_dir, layers=1):
    b = matching.codebook(book(spark, sf_dir), "code", "v", 64)
    return matching.quantized(emb(spark, sf_dir), "vec_id", "embedding", [b] * layers)


def _long_book(spark, sf_dir):
    return stats.exploded(book(spark, sf_dir), ["code"], "v").select("code", "dim", F.col("x").alias("c"))


@query(f"with {ASSIGN} select vec_id, cast(code as bigint) as code, {r6('dist')} as dist from a")
def vq_assign(spark, sf_dir):
    """Nearest code of every vector."""
    return _assigned(spark, sf_dir).select("vec_id", "code", rounded(F.col("dist")).alias("dist"))


LAYERS = f"""{ASSIGN}, r as (select vec_id, list_transform(list_zip(embedding, v), lambda p: cast(p[1] as double) - cast(p[2] as double)) as rest, code as code0, v as v0, dist as dist0, embedding from a),
d2 as (select r.*, b.code, b.v, {DIST.format(a='rest', b='b.v')} as dist from r, b),
a2 as (select * from (select *, row_number() over (partition by vec_id order by dist, code) as k from d2) where k = 1)"""


@query(f"""with {LAYERS} select vec_id, 0 as layer, cast(code0 as bigint) as code, {r6('dist0')} as dist from a2 union all select vec_id, 1, cast(code as bigint), {r6('dist')} from a2""")
def residual_vq2(spark, sf_dir):
    """Two layers, the second on what the first left over."""
    return _assigned(spark, sf_dir, 2).select("vec_id", "layer", "code", rounded(F.col("dist")).alias("dist"))


def _decoded_error(spark, sf_dir, layers, prefix):
    b = _long_book(spark, sf_dir)
    books = b.withColumn("layer", F.explode(F.array(*(F.lit(k) for k in range(layers)))))
    got = matching.dequantized(_assigned(spark, sf_dir, layers), "vec_id", books, prefix).withColumnRenamed("x", "pred")
    return long(spark, sf_dir).withColumnRenamed("x", "gt").join(got, ["vec_id", "dim"])


@query(f"""with {ASSIGN}, x as (select label, unnest(list_zip(embedding, v)) as p from a)
select label, {r6("avg((p[2]::double - p[1]::double) * (p[2]::double - p[1]::double))")} as feat_mse, {r6("avg(abs(p[2]::double - p[1]::double))")} as feat_mae, count(*) as n from x group by label""")
def recon_mse_mae(spark, sf_dir):
    """Reconstruction errors per label."""
    e = metrics.errors(_decoded_error(spark, sf_dir, 1, None), ["label"])
    return e.select("label", rounded(F.col("feat_mse")).alias("feat_mse"), rounded(F.col("feat_mae")).alias("feat_mae"), "n")


@query(f"""with {LAYERS}, x as (select unnest(list_zip(embedding, v0, v)) as p from a2)
select 1 as layers, {r6("avg((p[2]::double - p[1]::double) * (p[2]::double - p[1]::double))")} as mse from x union all
select 2, {r6("avg((p[2]::double + p[3]::double - p[1]::double) * (p[2]::double + p[3]::double - p[1]::double))")} from x""")
def prefix_decode(spark, sf_dir):
    """Error when only the first layers are decoded."""
    out = None
    for k in (1, 2):
        one = _decoded_error(spark, sf_dir, 2, k).agg(rounded(F.avg((F.col("pred") - F.col("gt")) * (F.col("pred") - F.col("gt")))).alias("mse")).select(F.lit(k).alias("layers"), "mse")
        out = one if out is None else out.unionByName(one)
    return out


def _near(vectors: str, book: str, out: str) -> str:
    """SQL of the nearest code of each vector."""
    return f"{out} as (select * from (select *, row_number() over (partition by vec_id order by dist, code) as k from (select vec_id, embedding, code, {DIST.format(a='embedding', b='v')} as dist from {vectors}, {book})) where k = 1)"


def _after(assigned: str, state: str, out: str) -> str:
    """SQL of a codebook's state after a batch: (code, dim, total, size, c)."""
    return f"""{out}_m as (select code, i - 1 as dim, x::double as x from (select code, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from {assigned})),
{out}_s as (select code, dim, sum(x) as s, count(*) as n from {out}_m group by code, dim),
{out}_r as (select vec_id, row_number() over (order by vec_id) - 1 as p, count(*) over () as n, embedding from {assigned}),
{out}_k as (select code, row_number() over (order by code) - 1 as k, count(*) over () as most from (select distinct code from {state})),
{out}_x as (select code, embedding from {out}_k join {out}_r on p = k % least(n, most)),
{out}_u as (select t.code, t.dim, 0.9 * t.total + 0.1 * coalesce(s.s, 0) as total, 0.9 * t.size + 0.1 * coalesce(s.n, 0) as size, embedding[t.dim + 1]::double as spare from {state} t left join {out}_s s on t.code = s.code and t.dim = s.dim left join {out}_x x on x.code = t.code),
{out} as (select code, dim, total, size, case when size >= 1 then total / size else spare end as c from {out}_u)"""


EMA = f"""{BOOK}, s0 as (select code, i - 1 as dim, x::double as total, 1.0::double as size, x::double as c from (select code, unnest(v) as x, generate_subscripts(v, 1) as i from b)),
e1 as (select vec_id, embedding from embeddings where vec_id % 3 = 0), {_near('e1', 'b', 'a1')}, {_after('a1', 's0', 's1')},
b1 as (select code, list(c order by dim) as v from s1 group by code), e2 as (select vec_id, embedding from embeddings where vec_id % 3 <> 0), {_near('e2', 'b1', 'a2')}, {_after('a2', 's1', 's2')}"""


@query(f"with {EMA} select code::bigint as code, dim::int as dim, {r6('size')} as size, {r6('total')} as total, {r6('c')} as c from s2")
def ema_update(spark, sf_dir):
    """Codebook after two batches of averaged updates, dead codes replaced: a third of the vectors, then the others."""
    state = materialize(codes.fresh(_long_book(spark, sf_dir).withColumn("code", F.col("code").cast("long"))))
    for own in ("vec_id % 3 = 0", "vec_id % 3 <> 0"):
        batch = emb(spark, sf_dir).where(own)
        assigned = matching.quantized(batch, "vec_id", "embedding", [matching.codebook(*codes.as_book(state))])
        state = materialize(codes.updated(state, assigned, stats.exploded(batch, ["vec_id"], "embedding"), "vec_id", 0.9))
    return state.select("code", "dim", *(rounded(F.col(c)).alias(c) for c in ("size", "total", "c")))


@query(f"with {LAYERS} select 0 as layer, {r6('avg(dist0 / 64)')} as loss from a2 union all select 1, {r6('avg(dist / 64)')} from a2")
def commitment_loss(spark, sf_dir):
    """Mean square distance of what each layer quantizes to its code."""
    return _assigned(spark, sf_dir, 2).groupBy("layer").agg(rounded(losses.commitment(F.col("dist"), 64)).alias("loss"))


@query(f"with {LAYERS}, x as (select vec_id, unnest(list_zip(v0, v)) as p, unnest(range(0, 64)) as dim from a2) select vec_id, cast(dim as int) as dim, {r6('p[1]::double + p[2]::double')} as x from x")
def vq_decode(spark, sf_dir):
    """Vectors decoded from the codes of two layers."""
    books = _long_book(spark, sf_dir).withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    d = matching.dequantized(_assigned(spark, sf_dir, 2), "vec_id", books)
    return d.select("vec_id", "dim", rounded(F.col("x")).alias("x"))


@query(f"""with {ASSIGN}, r as (select *, row_number() over (partition by vec_id order by dist, code) as k from (select vec_id, b.code, {DIST.format(a='embedding', b='b.v')} as dist, b.v from embeddings, b)),
s as (select a.vec_id, a.code as sem, a.v as sv, r.code as res, r.v as rv from a join r on a.vec_id = r.vec_id and r.k = 1), x as (select vec_id, unnest(list_zip(sv, rv)) as p from s)
select vec_id, cast(max(sem) as bigint) as semantic, cast(max(res) as bigint) as residual, {r6('sum(p[1]::double + p[2]::double)')} as total from s join x using (vec_id) group by vec_id""")
def split_vq(spark, sf_dir):
    """Two branches that both quantize the whole vector: their codes side by side, their code vectors summed."""
    b = matching.codebook(book(spark, sf_dir), "code", "v", 64)
    c = matching.split_quantized(emb(spark, sf_dir), "vec_id", "embedding", b, [b])
    books = _long_book(spark, sf_dir).withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    total = matching.dequantized(c, "vec_id", books).groupBy("vec_id").agg(F.sum("x").alias("total"))
    side = c.groupBy("vec_id").agg(F.max(F.when(F.col("layer") == 0, F.col("code"))).alias("semantic"), F.max(F.when(F.col("layer") == 1, F.col("code"))).alias("residual"))
    return side.join(total, "vec_id").select("vec_id", "semantic", "residual", rounded(F.col("total")).alias("total"))


@query(f"""with {ASSIGN}, c as (select label, vec_id % 7 <> 0 as present, list_dot_product(embedding::double[], v::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v::double[], v::double[]))) as c from a)
select label, {r6('avg(1 - c)')} as loss, {r6('coalesce(sum(1 - c) filter (present), 0) / greatest(1, count(*) filter (present))')} as masked from c group by label""")
def distill_loss(spark, sf_dir):
    """Cosine loss of vectors against a teacher (their code), and with every seventh teacher missing."""
    a = _assigned(spark, sf_dir).select("vec_id", "code").join(book(spark, sf_dir).withColumn("code", F.col("code").cast("long")), "code")
    c = emb(spark, sf_dir).join(a, "vec_id").select("label", V.cosine(F.col("embedding"), F.col("v")).alias("c"), (F.col("vec_id") % 7 != 0).alias("present"))
    return c.groupBy("label").agg(rounded(losses.cosine_loss(F.col("c"))).alias("loss"), rounded(losses.cosine_loss(F.col("c"), F.col("present"))).alias("masked"))


K = "k as (select event_type, user_id, try_cast(json_extract_string(props, '$.k') as int) as code from events)"
SIZE = 128


def event_codes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "user_id", F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("code"))


@query(f"""with {K}, g as (select event_type, unnest(range(0, {SIZE}))::int as code from (select distinct event_type from k)),
c as (select event_type, code, count(*) as n from k where code >= 0 and code < {SIZE} group by event_type, code)
select g.event_type, g.code, coalesce(n, 0) as n from g left join c on g.event_type = c.event_type and g.code = c.code""")
def code_histogram(spark, sf_dir):
    """Counts of every code, zeros kept."""
    return codes.histogram(event_codes(spark, sf_dir), ["event_type"], "code", SIZE)


@query(f"""with {K}, c as (select event_type, code, count(*) as n from k where code >= 0 and code < {SIZE} group by event_type, code), p as (select *, n / sum(n) over (partition by event_type) as p from c)
select event_type, {r6(f"count(*) / {SIZE}.0")} as usage, {r6(f"1 - count(*) / {SIZE}.0")} as dead_code_ratio, {r6("exp(-sum(p * ln(p)))")} as perplexity from p group by event_type""")
def codebook_usage(spark, sf_dir):
    """Usage, dead codes and perplexity per stream."""
    u = codes.usage(codes.histogram(event_codes(spark, sf_dir), ["event_type"], "code", SIZE), ["event_type"], SIZE)
    return u.select("event_type", *(rounded(F.col(c)).alias(c) for c in ("usage", "dead_code_ratio", "perplexity")))


@query(f"""with {K}, v as (select * from k where code >= 0 and code < {SIZE}), c as (select event_type, code, count(*) as n from v group by event_type, code union all select null, code, count(*) from v group by code),
p as (select *, n / sum(n) over (partition by event_type) as p from c)
select event_type, {r6(f"count(*) / {SIZE}.0")} as usage, cast(sum(n) as bigint) as n_codes, {r6("exp(-sum(p * ln(p)))")} as perplexity from p group by event_type""")
def usage_rollup(spark, sf_dir):
    """The same per stream and over all of them."""
    u = codes.usage_rollup(event_codes(spark, sf_dir), "event_type", "code", SIZE)
    return u.select("event_type", rounded(F.col("usage")).alias("usage"), "n_codes", rounded(F.col("perplexity")).alias("perplexity"))


@query(f"with {K} select event_type, max(code) as most, case when max(code) <= 0 then 1 else cast(power(2, floor(log2(max(code))) + 1) as bigint) end as size from k group by event_type")
def next_pow2(spark, sf_dir):
    """Codebook size guessed from the largest code."""
    return event_codes(spark, sf_dir).groupBy("event_type").agg(F.max("code").alias("most")).select("event_type", "most", V.next_power_of_two(F.col("most")).alias("size"))


@query(f"""with u as (select source, (len(features) // 499) as n, case when fps > 0 then fps else 30.0 end as fps from umr_release where features is not null)
select source, {r6("sum((n // 4) * 16) / sum(n / fps)")} as codes_s, {r6("sum((n // 4) * 16) / sum(n / fps) * log2(1024)")} as bits_s from u group by source""")
def token_rate(spark, sf_dir):
    """Codes and bits per second of sixteen codes per token of four records."""
    n = F.floor(F.size("features") / 499)
    rows = table(spark, sf_dir, "umr_release").where("features is not null").select("source", n.alias("n"), F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0).alias("fps"))
    a, b = codes.token_rate(F.floor(F.col("n") / 4) * 16, F.col("n") / F.col("fps"), 1024)
    return rows.groupBy("source").agg(rounded(a).alias("codes_s"), rounded(b).alias("bits_s"))


JOINTS = f"""{ASSIGN}, j as (select label, vec_id, unnest(range(0, 21)) as j, embedding as p, v as g from a),
c as (select label, p[3*j+1]::double - g[3*j+1]::double as dx, p[3*j+2]::double - g[3*j+2]::double as dy, p[3*j+3]::double - g[3*j+3]::double as dz, p[1]::double - g[1]::double as rx, p[2]::double - g[2]::double as ry, p[3]::double - g[3]::double as rz from j)"""


@query(f"""with {JOINTS} select label, {r6("sqrt(avg((dx*dx+dy*dy+dz*dz)/3)) * 1000")} as trans_rmse, {r6("avg(sqrt(dx*dx+dy*dy+dz*dz)) * 1000")} as mpjpe,
{r6("avg(sqrt((dx-rx)*(dx-rx)+(dy-ry)*(dy-ry)+(dz-rz)*(dz-rz))) * 1000")} as mpjpe_root from c group by label""")
def joint_errors(spark, sf_dir):
    """Translation error and joint distances, free and against the first joint."""
    a = _assigned(spark, sf_dir).select("vec_id", "code").join(book(spark, sf_dir).withColumn("code", F.col("code").cast("long")), "code")
    d = emb(spark, sf_dir).join(a, "vec_id").select("label", F.zip_with("embedding", "v", lambda x, y: x.cast("double") - y.cast("double")).alias("d"))
    j = d.select("label", "d", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"))
    for k, c in enumerate("xyz"):
        j = j.withColumn(f"d{c}", F.get("d", F.col("j") * 3 + k)).withColumn(f"r{c}", F.get("d", F.lit(k)))
    free, root = [F.col(f"d{c}") for c in "xyz"], [F.col(f"r{c}") for c in "xyz"]
    zero = [F.lit(0.0)] * 3
    return j.groupBy("label").agg(rounded(metrics.rmse_mm(free)).alias("trans_rmse"), rounded(metrics.mean_distance_mm(free, zero)).alias("mpjpe"), rounded(metrics.mean_distance_mm(free, root)).alias("mpjpe_root"))


RANKS = """n as (select vec_id, embedding[1:32]::double[] as t, embedding::double[] as s from embeddings),
u as (select vec_id, list_transform(t, lambda v: v / sqrt(list_dot_product(t, t))) as t, list_transform(s, lambda v: v / sqrt(list_dot_product(s, s))) as s from n),
p as (select a.vec_id as q, b.vec_id as c, round(list_dot_product(a.t, b.t), 9) as st, round(list_dot_product(a.s, b.s), 9) as ss from u a, u b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
best as (select q, c as target, ss as own from (select *, row_number() over (partition by q order by st desc, c) as k from p) where k = 1),
ranks as (select p.q, best.target, count(*) filter (ss > own) as rank from p join best on p.q = best.q group by p.q, best.target)"""


def _ranks(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 32).alias("teacher"), F.col("embedding").alias("student"))
    return matching.retrieval(e, "vec_id", "teacher", "student")


@query(f"with {RANKS} select q as vec_id, target, rank from ranks")
def retrieval_ranks(spark, sf_dir):
    """Rank of each query's nearest teacher neighbour among all rows by the student."""
    return _ranks(spark, sf_dir)


@query(f"with {RANKS} select {r6('avg((rank < 1)::double)')} as r_at_1, {r6('avg((rank < 5)::double)')} as r_at_5, {r6('avg((rank < 10)::double)')} as r_at_10, quantile_disc(rank, 0.5)::double as median_rank from ranks")
def recall_at_k(spark, sf_dir):
    """R@1, R@5, R@10 and the lower median rank."""
    ranks = materialize(_ranks(spark, sf_dir))
    r = ranks.agg(*metrics.recall("rank")).crossJoin(stats.quantiles(ranks, [], "rank", {"median_rank": 0.5}, lower=True))  # one row each
    return r.select(*(rounded(F.col(c)).alias(c) for c in ("r_at_1", "r_at_5", "r_at_10")), "median_rank")


@query(f"""with {ASSIGN}, c as (select list_dot_product(embedding::double[], v::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v::double[], v::double[]))) as c from a)
select {r6("avg(c)")} as cos_mean, {r6("median(c)")} as cos_median, {r6("quantile_cont(c, 0.1)")} as cos_p10, {r6("quantile_cont(c, 0.9)")} as cos_p90 from c""")
def cos_summary(spark, sf_dir):
    """Cosines between vectors and their codes."""
    a = _assigned(spark, sf_dir).select("vec_id", "code").join(book(spark, sf_dir).withColumn("code", F.col("code").cast("long")), "code")
    c = emb(spark, sf_dir).join(a, "vec_id").select(V.cosine(F.col("embedding"), F.col("v")).alias("c"))
    c = materialize(c)
    s = c.agg(F.avg("c").alias("cos_mean")).crossJoin(stats.quantiles(c, [], "c", {"cos_median": 0.5, "cos_p10": 0.1, "cos_p90": 0.9}))  # one row each
    return s.select(*(rounded(F.col(n)).alias(n) for n in s.columns))


@query("""select c_custkey, count(s_suppkey) as n from customer join supplier on s_acctbal <= c_acctbal and c_acctbal < s_acctbal + 50 group by c_custkey""")
def interval_nokey(spark, sf_dir):
    """Points in spans without a common key, by cells of the axis."""
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    hit = matching.overlapping(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", spans, "low", "high", 50.0)
    return hit.groupBy("c_custkey").agg(F.count("s_suppkey").alias("n"))


@query("""select count(*) filter (a.id is not null and b.id is not null) as matched, count(*) filter (b.id is null) as left_only, count(*) filter (a.id is null) as right_only
from (select distinct vec_id as id from embeddings) a full join (select distinct doc_id as id from documents) b on a.id = b.id""")
def positional_join(spark, sf_dir):
    """Two tables by row id, with the ids that lack a partner."""
    return matching.aligned(emb(spark, sf_dir).select(F.col("vec_id").alias("id")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")


LAST = "l as (select rec_id, coalesce(len(events), 0) as k from (select *, row_number() over (partition by rec_id order by line_no desc) as r from event_tracks where rec_id is not null) where r = 1)"


@query(f"with {LAST} select split, count(*) as n, cast(sum(coalesce(k, 0)) as bigint) as n_events from recordings left join l on recordings.rec_id = l.rec_id group by split")
def lookup_left(spark, sf_dir):
    """Recordings with the number of events of their last line, 0 where there is none."""
    last = matching.last_line(table(spark, sf_dir, "event_tracks"), "rec_id", "line_no", "events").select("rec_id", F.when(F.col("events").isNull(), 0).otherwise(F.size("events")).alias("k"))
    r = table(spark, sf_dir, "recordings").join(last, "rec_id", "left")
    return r.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.coalesce("k", F.lit(0))).cast("long").alias("n_events"))


@query("select manifest_line, rec_id from recordings where rec_id in (select rec_id from umr_release)")
def semi_ids(spark, sf_dir):
    """Manifest lines of released recordings."""
    return table(spark, sf_dir, "recordings").join(table(spark, sf_dir, "umr_release").select("rec_id"), "rec_id", "left_semi").select("manifest_line", "rec_id")


@query("select manifest_line, rec_id from recordings r where not exists (select 1 from umr_release u where u.rec_id = r.rec_id)")
def anti_done(spark, sf_dir):
    """Manifest lines still to be released."""
    return table(spark, sf_dir, "recordings").join(table(spark, sf_dir, "umr_release").select("rec_id"), "rec_id", "left_anti").select("manifest_line", "rec_id")


@query("""select row_id, json_extract_string(p, '$.dataset') as dataset, try_cast(json_extract_string(p, '$.rev') as int) as rev from (select row_id, case when json_valid(provenance_json) then provenance_json end as p from umr_release)
where json_extract_string(p, '$.dataset') in ('kestrel', 'ouzel')""")
def json_filter(spark, sf_dir):
    """Rows whose provenance names a dataset; broken JSON names none."""
    p = F.expr("try_variant_get(try_parse_json(provenance_json), '$.dataset', 'string')")
    rev = F.expr("try_variant_get(try_parse_json(provenance_json), '$.rev', 'int')")
    return table(spark, sf_dir, "umr_release").select("row_id", p.alias("dataset"), rev.alias("rev")).where(F.col("dataset").isin("kestrel", "ouzel"))


@query("select source, count(*) filter (n_chars >= 200) as kept, count(*) filter (not coalesce(n_chars >= 200, false)) as skipped from documents group by source")
def min_len(spark, sf_dir):
    """Rows long enough, and the others counted."""
    good = F.coalesce(F.col("n_chars") >= 200, F.lit(False))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


@query("""select r.manifest_line, case when r.fps > 0 then r.fps when s.nominal_fps > 0 then s.nominal_fps else 30.0 end as fps,
coalesce(abs(case when r.fps > 0 then r.fps when s.nominal_fps > 0 then s.nominal_fps else 30.0 end - 50) <= 1e-3, false) as usual from recordings r left join capture_sources s on r.source = s.source""")
def fps_resolve(spark, sf_dir):
    """Rate from the row, else the source, else 30; and whether it is 50."""
    s = table(spark, sf_dir, "capture_sources").select("source", "nominal_fps")
    up = lambda c: F.when(F.col(c) > 0, F.col(c))
    fps = F.coalesce(up("fps"), up("nominal_fps"), F.lit(30.0))
    return table(spark, sf_dir, "recordings").join(s, "source", "left").select("manifest_line", fps.alias("fps"), (F.abs(fps - 50) <= 1e-3).alias("usual"))


@query("""select manifest_line, case when starts_with(lower(u), 'local://') then '/data/' || ltrim(regexp_replace(substr(u, 9), '/+', '/', 'g'), '/') else u end as path from (select manifest_line, trim(uri) as u from recordings)""")
def uri_resolve(spark, sf_dir):
    """Manifest URIs as paths."""
    return table(spark, sf_dir, "recordings").select("manifest_line", files.resolved_uri(F.col("uri"), "/data").alias("path"))


@query("""select sha256(string_agg(rec_id || chr(0) || uri || chr(10), '' order by manifest_line, rec_id, uri)) as sha256, count(*) as n from recordings where rec_id is not null and uri is not null""")
def manifest_hash(spark, sf_dir):
    """Hash of the manifest's lines in order."""
    return files.ordered_hash(table(spark, sf_dir, "recordings").where("rec_id is not null and uri is not null"), ["manifest_line", "rec_id", "uri"], ["rec_id", "uri"])


@query("""with p as (select manifest_line // 65536 as g, manifest_line as p, rec_id || chr(0) || uri || chr(0) || chr(10) as s from recordings where rec_id is not null and uri is not null),
h as (select g, sha256(string_agg(s, '' order by p, s)) as h from p group by g) select sha256(string_agg(h, '' order by g)) as sha256 from h""")
def range_hash(spark, sf_dir):
    """Hash of the manifest by ranges: cheap to compute, comparable only with its own kind."""
    return files.fingerprint(table(spark, sf_dir, "recordings").where("rec_id is not null and uri is not null"), "manifest_line", "rec_id", "uri")


D = "d as (select doc_id, coalesce(n_chars, 0) as len, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents)"


def positions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("len"))
    return windows.running_offsets(d, ["doc_id"], "len", row="pos")


@query(f"with {D} select doc_id, cast(floor(pos / greatest(1, ceil(n / 7.0))) as int) as shard, cast(pos % 7 as int) as chunk from d")
def shard_ranges(spark, sf_dir):
    """Contiguous shards and strided chunks of the rows in order."""
    p = positions(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))
    return p.crossJoin(F.broadcast(n)).select("doc_id", windows.shard_of(F.col("pos"), F.col("n"), 7).alias("shard"), windows.strided(F.col("pos"), 7).alias("chunk"))


@query(f"""with {D}, m as (select *, pos // 64 as mega from d), k as (select *, row_number() over (partition by mega order by len, pos) - 1 as k, count(*) over (partition by mega) as c from m)
select doc_id, cast(mega as bigint) as mega, cast(k // 8 as bigint) as batch_no, cast(k % 8 as bigint) as place from k where k < c - c % 8""")
def length_buckets(spark, sf_dir):
    """Batches of eight of similar length inside mega-batches of eight batches."""
    return windows.length_batches(positions(spark, sf_dir).select("doc_id", "len", "pos"), "pos", "len", 8, 8).select("doc_id", "mega", "batch_no", "place")


@query(f"""select cast(s as int) as step, {r6("case when s < 50 then 0.001 * (s + 1) / 50 else 0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(pi() * least(1.0, (s - 50) / 950.0))) end")} as lr,
{r6("0.5 * greatest(0.0, least(1.0, (s - 100) / 300.0))")} as weight from (select unnest(range(0, 1200)) as s)""")
def schedule(spark, sf_dir):
    """Warm-up and cosine of the rate, linear ramp of a weight."""
    s = spark.range(1200).select(F.col("id").cast("int").alias("step"))
    return s.select("step", rounded(losses.learning_rate(F.col("step"), 0.001, 50, 1000, 0.00001)).alias("lr"), rounded(losses.ramp(F.col("step"), 100, 400, 0.5)).alias("weight"))


@query("""with c as (select row_id, unnest([case when features is null then 'no features' end, case when len(features) % 499 <> 0 then 'ragged features' end, case when joints77_pos is null then 'no positions' end,
  case when len(joints77_pos) <> (len(features) / 499.0 + 1) * 231 then 'frames are not records + 1' end, case when len(list_filter(features, lambda v: v is null or not isfinite(v))) > 0 then 'non-finite features' end,
  case when len(list_filter(joints77_pos, lambda v: v is null or not isfinite(v))) > 0 then 'non-finite positions' end]) as finding, 'failure' as kind from umr_release
 union all select row_id, unnest([case when abs(fps - 50) > 1e-3 then 'other rate' end, case when fps is null or not fps > 0 then 'no rate' end, case when num_records <> len(features) / 499.0 then 'wrong num_records' end]), 'warning' from umr_release)
select kind, finding, count(*) as n from c where finding is not null group by kind, finding""")
def validation_report(spark, sf_dir):
    """Findings of the clip validator, counted."""
    r = validate.report(table(spark, sf_dir, "umr_release"), ["row_id"], *validate.clip_checks())
    one = lambda k, c: r.select(F.lit(k).alias("kind"), F.explode(c).alias("finding"))
    return one("failure", "failures").unionByName(one("warning", "warnings")).groupBy("kind", "finding").agg(F.count("*").alias("n"))


def p1_found(spark, sf_dir):
    """Distinct implausible readings of features, joints77_pos and root_traj."""
    return spikes.find(table(spark, sf_dir, "umr_release"), table(spark, sf_dir, "feature_fields"))


QUERIES["p1_found"] = p1_found
