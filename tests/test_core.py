import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions import rotation as R
from kinetrace.functions import vectors as V
from kinetrace.kernels import signal
from kinetrace.operators import codes, losses, matching, metrics, skeleton, stats, temporal, validate
from kinetrace.plans import windows
from kinetrace.sources import files


def one(df):
    return df.collect()[0][0]


def starts(spark, n, w, step, cap=0):
    return one(spark.createDataFrame([(n,)], "n int").select(windows.window_starts(F.col("n"), w, step, cap)))


def test_window_starts(spark):
    assert starts(spark, 19, 7, 3) == [0, 3, 6, 9, 12]
    assert starts(spark, 11, 7, 3) == [0, 3, 4]
    assert starts(spark, 7, 7, 3) == [0]
    assert starts(spark, 6, 7, 3) == []
    assert starts(spark, None, 7, 3) == []
    assert starts(spark, 200, 7, 3, 4) == [0, 3, 6, 9]
    assert starts(spark, 9, 7, 0) == [0]
    with pytest.raises(ValueError):
        windows.window_starts(F.col("n"), 0, 1)


def test_take_length(spark):
    df = spark.createDataFrame([(47,), (48,), (51,), (301,), (None,)], "n int")
    assert [r[0] for r in df.select(windows.take_length(F.col("n"), 48, 300, 4)).collect()] == [None, 48, 48, 300, None]


def test_running_offsets(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "id int, n int").repartition(7)
    got = {r.id: (r.offset, r.row_no) for r in windows.running_offsets(df, ["id"], "n").collect()}
    total = 0
    for i in range(100):
        assert got[i] == (total, i)
        total += i % 5


def test_moments_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=(200, 5))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k int, v array<double>")
    got = {r.dim: (r.mean, r["std"]) for r in stats.moments(stats.exploded(df, ["k"], "v"), ["dim"]).collect()}
    for d in range(5):
        assert got[d] == pytest.approx((x[:, d].mean(), math.sqrt(x[:, d].var() + 1e-8)), rel=1e-10)


def test_wide_moments_skip_bad_values(spark):
    rows = [("a", [1.0, 2.0, 3.0, float("nan")]), ("a", [5.0, float("inf")]), ("a", [1.0]), ("b", None), (None, [7.0, 8.0])]
    df = spark.createDataFrame(rows, "s string, v array<float>").withColumn("dim", F.lit(1))
    got = {(r.s, r.dim): (r.n, r.mean) for r in stats.wide_moments(df, ["s"], "v", 2).collect()}
    assert got == {("a", 0): (3, 3.0), ("a", 1): (1, 2.0), (None, 0): (1, 7.0), (None, 1): (1, 8.0)}
    assert stats.wide_moments(df.limit(0), ["s"], "v", 2).count() == 0


def test_differences_across_stretches(spark):
    n = 100
    df = spark.createDataFrame([("a", t, float(t * t)) for t in range(n)] + [("a", None, 1.0), (None, 3, 1.0)], "e string, t int, x double")
    s = temporal.Stretches(df, "e", "t", 4, 16)
    got = {r.t: r.d for r in s.select(d=F.col("x") - F.lag("x").over(s.by)).collect()}
    assert got[0] is None and all(got[t] == 2 * t - 1 for t in range(1, n)) and len(got) == n
    run = {r.t: r.s_x for r in temporal.running_sums(df, "e", "t", ["x"], 16).collect()}
    assert run[99] == sum(t * t for t in range(100)) and run[17] == sum(t * t for t in range(18))
    third = {r.t: r.d_x for r in temporal.differences(df, "e", "t", ["x"], 3).collect()}
    assert third[2] is None and third[50] == 0


def test_rates_clamped(spark):
    df = spark.createDataFrame([("a", t, float(3 * t)) for t in range(30)], "e string, t int, x double")
    got = {r.t: r.r_x for r in temporal.rates(df, "e", "t", ["x"], 10).collect()}
    assert got[0] is None and got[1] == 3.0 and got[29] == 3.0


def test_resampled_line(spark):
    df = spark.createDataFrame([("a", t, float(2 * t)) for t in range(11)], "e string, t int, x double")
    got = sorted((r.k, r.x) for r in temporal.resampled(df, "e", "t", "x", 0.6).collect())
    assert len(got) == 7 and got[0][1] == 0 and got[-1][1] == 20 and got[3][1] == pytest.approx(10)


def test_rotations(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(v)] + [(50, [0.0, 0.0, 0.0]), (51, [math.pi - 1e-3, 0.0, 0.0])], "k int, v array<double>")
    m = R.matrix_of_axis_angle(F.col("v"))
    out = df.select("v", R.axis_angle_of_matrix(m).alias("w"), R.matrix_of_rot6d(R.rot6d_of_matrix(m)).alias("r"), m.alias("m"), R.geodesic(m, m).alias("g")).collect()
    for r in out:
        angle = np.linalg.norm(r.v)
        near = np.array(r.v) if angle <= math.pi else np.array(r.v) * (1 - 2 * math.pi / angle)
        assert np.allclose(r.w, near, atol=1e-6)
        assert np.allclose(r.r, r.m, atol=1e-9) and r.g < 1e-6
        a = np.array(r.m).reshape(3, 3)
        assert np.allclose(a @ a.T, np.eye(3), atol=1e-9)


def test_quaternions(spark):
    q = F.array(*(F.lit(x) for x in (0.5, 0.5, 0.5, 0.5)))
    e = F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)))
    r = spark.range(1).select(R.compose(q, e).alias("a"), R.xyzw_of_wxyz(e).alias("b")).collect()[0]
    assert r.a == [0.5] * 4 and r.b == [0.0, 0.0, 0.0, 1.0]


def test_headings_invert(spark):
    h, x, z = F.lit(0.7), F.lit(2.0), F.lit(-1.0)
    a, b = R.into_heading(x, z, h)
    r = spark.range(1).select(*R.out_of_heading(a, b, h)).collect()[0]
    assert r[0] == pytest.approx(2.0) and r[1] == pytest.approx(-1.0)


def test_small_functions(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (4,), (1023,), (1024,)], "m int")
    assert [r[0] for r in df.select(V.next_power_of_two(F.col("m"))).collect()] == [1, 2, 4, 8, 1024, 2048]
    r = spark.range(1).select(V.half_even(F.lit(2.5)), V.scale_label(F.lit(1234)), V.scale_label(F.lit(12)), V.trimmed(F.lit(11), 4), V.clipped(F.lit(1.5))).collect()[0]
    assert list(r) == [2.0, "1k", "12", 8, 1.0]
    assert one(spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(V.all_zero(F.col("v"))))


def test_first_event_takes_first_listed(spark):
    events = [(2.0, 5.0), (0.0, 3.0), (None, 9.0)]
    df = spark.createDataFrame([(events, t) for t in (2.5, 0.0, 5.0)] + [(None, 1.0), ([], 1.0)], "e array<struct<start_time:double,end_time:double>>, t double")
    assert [r[0] for r in df.select(matching.first_event(F.col("e"), F.col("t"))).collect()] == [0, 1, None, None, None]


def test_quantized(spark):
    book = ([3, 7], np.array([[0.0, 0.0], [1.0, 1.0]]))
    df = spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0])], "id int, v array<float>").withColumn("code", F.lit("x"))
    got = {(r.id, r.layer): r.code for r in matching.quantized(df, "id", "v", [book, book]).collect()}
    assert got[1, 0] == 3 and got[2, 0] == 3 and got[3, 0] is None and got[4, 0] is None and got[5, 1] is None
    with pytest.raises(ValueError):
        matching.codebook(df.select(F.col("id"), F.col("v")), "id", "v", 2, most=4)


def test_overlapping_equals_brute_force(spark):
    p = spark.createDataFrame([(i, i * 1.7) for i in range(60)], "p int, x double")
    s = spark.createDataFrame([(i, i * 3.0, i * 3.0 + i) for i in range(30)], "s int, low double, high double")
    got = {(r.p, r.s) for r in matching.overlapping(p, "x", s, "low", "high", 5.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(30) if j * 3.0 <= i * 1.7 < j * 3.0 + j}


def test_full_codebook(spark):
    c = spark.createDataFrame([("a", k % 64) for k in range(640)] + [("a", None), ("a", -1), ("a", 64)], "s string, code int")
    u = codes.usage(codes.histogram(c, ["s"], "code", 64), ["s"], 64).collect()[0]
    assert u.usage == 1 and u.perplexity == pytest.approx(64) and u.dead_code_ratio == 0
    empty = codes.usage(codes.histogram(c.where("code < 0"), ["s"], "code", 64), ["s"], 64).collect()[0]
    assert empty.usage == 0 and empty.perplexity == 0


def test_losses(spark):
    zero, y = F.lit(0.0), F.lit(1.0)
    r = spark.range(1).select(losses.bce(zero, y), losses.focal(F.lit(0.3), y, 0.5, 0.0), losses.bce(F.lit(0.3), y), losses.huber(F.lit(2.0)), losses.huber(F.lit(0.5)), losses.bce(F.lit(-800.0), y)).collect()[0]
    assert r[0] == pytest.approx(math.log(2)) and r[1] == pytest.approx(0.5 * r[2]) and r[3] == 1.5 and r[4] == 0.125 and r[5] == pytest.approx(800)


def test_f1_edges(spark):
    df = spark.createDataFrame([("none", -1.0, 0.0), ("half", 1.0, 0.5), ("hit", 1.0, 1.0)], "k string, p double, y double")
    got = {r.k: r.f for r in df.groupBy("k").agg(metrics.f1(F.col("p"), F.col("y")).alias("f")).collect()}
    assert got == {"none": 1.0, "half": 0.0, "hit": 1.0}


def test_joint_metrics():
    rng = np.random.default_rng(2)
    g = rng.normal(size=(8, 22, 3))
    same = metrics.joint_metrics(g, g)
    assert all(abs(v) < 1e-6 for k, v in same.items() if k not in ("n_frames", "accel_pred", "accel_gt", "jerk_pred", "jerk_gt"))
    turn = signal.quaternions(np.array([0.3, -0.2, 0.5]))
    m = skeleton.rotations_of_rot6d(np.array([[0.8, 0.6, 0, -0.6, 0.8, 0]]))[0]
    moved = 1.7 * g @ m.T + np.array([1.0, 2.0, 3.0])
    assert np.allclose(metrics.procrustes(moved, g), g, atol=1e-9) and len(turn) == 4
    mirrored = g * np.array([-1.0, 1, 1])
    assert np.linalg.norm(metrics.procrustes(mirrored, g) - g) > 1
    short = metrics.joint_metrics(g[:2], g[:2])
    assert math.isnan(short["accel_err"]) and math.isnan(short["jerk_err"]) and short["n_frames"] == 2


def test_resample_keeps_lines_and_waves():
    t = np.arange(90) / 30
    assert np.allclose(signal.resample(3 * t + 1, 30, 50), 3 * np.arange(150) / 50 + 1, atol=1e-6)
    wave = np.sin(2 * np.pi * t)
    out = signal.resample(wave, 30, 50)
    assert np.abs(out - np.sin(2 * np.pi * np.arange(150) / 50))[20:-25].max() < 0.01
    assert signal.resample(wave, 30, 30).shape == (90,)
    with pytest.raises(ValueError):
        signal.resample(wave, 0, 50)


def test_slerp_halfway():
    v = np.array([[[0.0, 0, 0]], [[0, 0, 1.0]], [[0, 0, 2.0]]])
    out = signal.slerp(v, 1.0, 2.0, 5)
    assert np.allclose(out[:, 0, 2], [0, 0.5, 1, 1.5, 2], atol=1e-9)


def test_causal_convolution_sees_no_future():
    rng = np.random.default_rng(3)
    x, k = rng.normal(size=(20, 2)), rng.normal(size=(3, 2, 4))
    a = signal.convolve(x, k, np.zeros(3))
    y = x.copy()
    y[10:] = 0
    assert a.shape == (20, 3) and np.allclose(signal.convolve(y, k, np.zeros(3))[:10], a[:10])
    assert signal.strides_of(12) == [2, 2, 3] and signal.strides_of(4) == [2, 2]


def test_skeleton(spark):
    assert skeleton.order_of([-1, 0, 1, 0]) == [0, 1, 3, 2]
    for bad in ([0, 1], [-1, 2, 1], [-1, -1], [-1, 5]):
        with pytest.raises(ValueError):
            skeleton.order_of(bad)
    rest = spark.createDataFrame([(0, -1, 1.0, 0.0, 0.0), (1, 0, 1.0, 2.0, 0.0)], "joint int, parent int, x double, y double, z double")
    got = {r.joint: (r.dx, r.dy, r.dz) for r in skeleton.offsets(rest).collect()}
    assert got == {0: (1.0, 0.0, 0.0), 1: (0.0, 2.0, 0.0)}
    clips = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0] * 2, [0.0, 1.0, 0.0]), (2, [1.0], [0.0, 1.0, 0.0]), (3, None, None)], "id int, r array<double>, p array<double>")
    got = {r.id: r.joints for r in skeleton.posed(clips, "id", "r", "p", [-1, 0], np.array([[0, 0, 0], [0, 2.0, 0]])).collect()}
    assert got == {1: [0.0, 1.0, 0.0, 0.0, 3.0, 0.0], 2: None, 3: None}


def test_validation(spark):
    layout = spark.createDataFrame([(0, 9), (9, 15), (15, 499)], "a int, b int")
    assert one(validate.tiles(layout, "a", "b", 0, 499)) is True
    assert one(validate.tiles(layout.where("a <> 9"), "a", "b", 0, 499)) is False
    with pytest.raises(ValueError):
        validate.required(layout, ["a", "c"])
    assert validate.differences(layout, layout).count() == 0


def test_npz_round_trip(spark, tmp_path):
    n = 4
    row = (
        "clip1", 50.0, [float(v) for v in range(n * 499)], [0.0] * 3, [0.0] * 6, [0.0] * 456, [0.1] * 10, [0.0] * 702, [1.0] * ((n + 1) * 231),
    )
    names = "rec_id string, fps double, features array<float>, init_root_pos array<float>, init_root_rot6d array<float>, init_joints76_rot6d array<float>, identity_coeffs array<float>, joint_orient array<float>, joints77_pos array<float>"
    done = files.write_npz(spark.createDataFrame([row], names), "rec_id", str(tmp_path)).collect()
    assert done[0].error is None
    (tmp_path / "bad.npz").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_npz(spark, str(tmp_path), variant=files.VARIANT).collect()}
    assert got["clip.npz"].features == row[2] and got["clip.npz"].fps == 50.0 and got["bad.npz"].error
    other = {r.path.rsplit("/", 1)[-1]: r for r in files.read_npz(spark, str(tmp_path), variant="other").collect()}
    assert "variant" in other["clip.npz"].error


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n one \n\nlocal://x/y.npz\n")
    (tmp_path / "b.txt").write_text("one\r\n")
    got = files.read_manifest(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).orderBy("file_no", "line_no").collect()
    assert [r.entry for r in got] == ["one", "local://x/y.npz", "one"]
    paths = [r[0] for r in spark.createDataFrame([(r.entry,) for r in got], "e string").select(files.resolved_entry(F.col("e"), "/d", "c.npz")).collect()]
    assert paths == ["/d/one/c.npz", "/d/x/y.npz", "/d/one/c.npz"]
    back = spark.createDataFrame([("/d/x/y.npz",), ("/e",)], "p string").select(files.unresolved_uri(F.col("p"), "/d")).collect()
    assert [r[0] for r in back] == ["local://x/y.npz", "/e"]
    (tmp_path / "e.jsonl").write_text('{"rec_id": "a", "events": [{"start_time": 0, "end_time": 1}]}\n{"rec_id": "b"}\nnot json\n{"rec_id": "a", "events": []}\n')
    assert {r.rec_id: len(r.events) for r in files.read_events(spark, str(tmp_path / "e.jsonl")).collect()} == {"a": 0, "b": 0}
    files.write_report(spark.createDataFrame([(2, 1.5)], "b int, a double"), str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r"), "a double, b int").collect()[0].a == 1.5
    assert files.split_keys({"q.a": 1, "b": 2}, "q.") == ({"a": 1}, {"b": 2})


def test_stream_equals_batch(spark, tmp_path):
    from kinetrace.streaming import integrate as I

    rng = np.random.default_rng(5)
    rows = [(r, t, float(rng.normal()), float(rng.normal()), 1.0) for r in ("a", "b") for t in range(40)]
    df = spark.createDataFrame(rows, "rec_id string, t int, dx double, dz double, y double")
    df.orderBy(F.rand(1)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = I.decoded_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = I.equivalence(spark.read.schema(I.OUT).parquet(str(tmp_path / "out")), I.decoded_batch(df)).collect()[0]
    assert r.frames == 80 and r.trans_rmse_mm < 1e-6


def test_batches_of_similar_length(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(100)], "pos long, n int")
    got = windows.length_batches(df, "pos", "n", 4, 5).collect()
    assert len(got) == 100 and len({(r.mega, r.batch_no, r.place) for r in got}) == 100
    assert windows.sampled(df, "pos", 10).count() == 10 and windows.sampled(df, "pos", 0).count() == 100


def test_split_quantizer(spark):
    sem, res = ([0, 1], np.array([[0.0, 0.0], [2.0, 2.0]])), ([0, 1], np.array([[1.0, 1.0], [0.5, 0.5]]))
    df = spark.createDataFrame([(1, [1.6, 1.6])], "id int, v array<double>")
    got = {r.layer: r.code for r in matching.split_quantized(df, "id", "v", sem, [res, res]).collect()}
    assert got == {0: 1, 1: 0, 2: 1}


def test_codebook_stream(spark, tmp_path):
    from kinetrace.streaming import integrate as I

    rows = [(k, [0.0, 1.0]) for k in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    start = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "code long, vec array<double>")
    q = I.update_codebook(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "v", start, str(tmp_path / "book"), 0.5).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    got = {(r.code, r.dim): (r.size, r.total, r.c) for r in spark.read.parquet(str(tmp_path / "book" / "v=0")).collect()}
    assert got[0, 0] == (5.5, 0.0, 0.0) and got[0, 1] == (5.5, 5.0, pytest.approx(5.0 / 5.5))
    assert got[1, 0] == (0.5, 4.5, 0.0) and got[1, 1] == (0.5, 4.5, 1.0)  # dead: the batch's second vector


def test_codebook_over_batches(spark):
    """The mean of many equal batches is where the codebook goes, and counts are carried on."""
    state = codes.fresh(spark.createDataFrame([(0, 0, 9.0)], "code long, dim int, c double"))
    batch = spark.createDataFrame([(k, [float(v)]) for k, v in enumerate([1.0, 3.0, 5.0] * 33)], "id long, v array<double>")
    size, total = 1.0, 9.0
    for _ in range(3):
        assigned = matching.quantized(batch, "id", "v", [matching.codebook(*codes.as_book(state))])
        state = codes.updated(state, assigned, stats.exploded(batch, ["id"], "v"), "id", 0.99)
        size, total = 0.99 * size + 0.01 * 99, 0.99 * total + 0.01 * 297
        r = state.collect()[0]
        assert (r["size"], r.total, r.c) == pytest.approx((size, total, total / size))
    empty = codes.updated(state, assigned.limit(0), stats.exploded(batch, ["id"], "v"), "id", 0.5).collect()[0]
    assert empty.c == pytest.approx(total / size if size * 0.5 < 1 else total / size)


def test_running_moments_stream(spark, tmp_path):
    from kinetrace.streaming import integrate as I

    x = np.random.default_rng(7).normal(size=90)
    spark.createDataFrame([("a", float(v)) for v in x], "k string, x double").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = I.running_moments(stream, ["k"], "x").writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("moments").collect()[0]
    assert r.n == 90 and r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(math.sqrt(x.var() + 1e-8))
