"""Caches, crops, batches, streams with gaps, exact quantiles, and small readers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace import caches, codec, pipelines
from kinetrace.functions import vectors as V
from kinetrace.operators import losses, matching, skeleton, stats
from kinetrace.sources import files
from kinetrace.streaming import integrate as I

W = 499
SCHEMA = "row_id long, rec_id string, fps double, features array<float>, joints77_pos array<float>, init_root_pos array<float>, init_root_rot6d array<float>, init_joints76_rot6d array<float>, error string"


def clips(spark, lengths=(20, 12, 4, 1)):
    rng = np.random.default_rng(0)
    rows = []
    for k, n in enumerate(lengths):
        f, j = rng.normal(size=(n, W)), rng.normal(size=(n + 1, 231))
        rows.append((k, f"r{k}", 50.0, *([float(v) for v in x.ravel()] for x in (f, j, rng.normal(size=3), rng.normal(size=6), rng.normal(size=456))), "clash"))
    rows += [(90, "null", 50.0, None, None, None, None, None, None), (91, "rate", 30.0, *rows[0][3:]), (92, "ragged", 50.0, [0.0] * (W * 8 + 1), rows[0][4], None, None, None, None), (93, "norate", None, *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA)


def test_crops_and_their_anchors(spark):
    c = clips(spark)
    own = {r.row_id: r for r in c.collect()}
    for seed in range(3):
        got = {r.row_id: r for r in pipelines.crops(c.drop("error"), 8, seed).collect()}
        assert {k: r.error for k, r in got.items()} == {0: None, 1: None, 2: "too short", 3: "too short", 90: "no features or positions", 91: "other rate", 92: "ragged", 93: "other rate"}
        for k in (0, 1):
            r, s = got[k], got[k].start
            f, j = np.array(own[k].features).reshape(-1, W), np.array(own[k].joints77_pos).reshape(-1, 231)
            assert 0 <= s <= len(f) - 8
            assert np.array_equal(np.array(r.features).reshape(-1, W), f[s : s + 8]) and np.array_equal(np.array(r.joints77_pos).reshape(-1, 231), j[s : s + 9])
            assert list(r.init_root_pos) == (list(own[k].init_root_pos) if s == 0 else j[s, :3].tolist())
            assert list(r.init_root_rot6d) == (list(own[k].init_root_rot6d) if s == 0 else f[s - 1, 9:15].tolist())
            assert list(r.init_joints76_rot6d) == (list(own[k].init_joints76_rot6d) if s == 0 else f[s - 1, 15:471].tolist())
    assert pipelines.crops(c.drop("error").limit(0), 8).count() == 0


def test_batches_cut_to_the_shortest(spark):
    rows = spark.createDataFrame([(k, k // 4, k % 4, 5 + (k * 7) % 30) for k in range(40)], "row_id long, batch long, place int, n int")
    for aligned in (False, True):
        got = pipelines.batch_crops(rows, "batch", "n", 4, 1, aligned).collect()
        least = {b: min(r.n for r in got if r.batch == b) for b in range(10)}
        assert len(got) == 40 and all(r.crop == max(4, least[r.batch] // 4 * 4) and 0 <= r.start <= max(0, r.n - r.crop) and not (aligned and r.start % 4) for r in got)
    packed = pipelines.collated(rows, "batch", "place", ["row_id", "n"]).collect()
    assert all(r.row_id == [4 * r.batch + k for k in range(4)] and len(r.n) == 4 for r in packed)


def test_caches(spark, tmp_path):
    c, home = clips(spark).where("row_id < 90 or row_id = 90"), f"file://{tmp_path}"
    assert not caches.is_ready(spark, f"{home}/none") and caches.read_meta(spark, f"{home}/none") is None
    meta = caches.write_fixed(c, f"{home}/f", 7, 3, 16, "hash")
    assert meta["shape"] == [9, 7, W] and caches.is_ready(spark, f"{home}/f")
    assert caches.matches(spark, f"{home}/f", window=7, step=3, manifest_hash="hash") and not caches.matches(spark, f"{home}/f", window=8)
    caches.write_meta(spark, f"{home}/f", meta | {"shape": [10, 7, W]})
    assert not caches.is_ready(spark, f"{home}/f")
    caches.write_meta(spark, f"{home}/f", meta | {"feature_variant": "other"})
    assert not caches.is_ready(spark, f"{home}/f")
    assert caches.write_ragged(c, f"{home}/r", 4, 14, 4)["n_clips"] == 3
    index, data = caches.open_ragged(spark, f"{home}/r")
    assert [(r.row_id, r.length, r.offset) for r in index.orderBy("row_no").collect()] == [(0, 12, 0), (1, 12, 12), (2, 4, 24)] and data.count() == 3
    good = spark.createDataFrame([(0,), (1,), (2,)], "row_id long")
    caches.open_ragged(spark, f"{home}/r", good)
    for wrong, per_token in ((good.limit(2), False), (good, True), (good.union(good), False)):
        with pytest.raises(ValueError):
            caches.open_ragged(spark, f"{home}/r", wrong, per_token)
    with pytest.raises(ValueError):
        caches.open_ragged(spark, f"{home}/f")


def test_outcomes_and_tokens(spark):
    done = spark.createDataFrame([("r1",), ("r1",)], "rec_id string")
    got = {r.row_id: r.status for r in pipelines.outcomes(clips(spark), 5, done).collect()}
    assert got == {0: "written", 1: "skipped", 2: "short", 3: "short", 90: "failed", 91: "written", 92: "failed", 93: "written"}
    c = spark.createDataFrame([(0, 8), (1, 9), (2, 3)], "row_id long, take int")
    t = spark.createDataFrame([(0, 1, 1.0), (0, 0, 0.0), (1, 0, 5.0)], "row_id long, token int, v double")
    assert {r.row_id: (r.n_tokens, r.complete) for r in pipelines.tokens_of(c, t).collect()} == {0: (2, True), 1: (1, False), 2: (0, True)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=301), "b": rng.integers(0, 4, 200).astype(float), "c": np.array([7.0]), None: rng.random(50)}
    df = spark.createDataFrame([(k, float(v)) for k, xs in x.items() for v in xs] + [("a", None)], "k string, x double").repartition(5)
    got = {r.k: r for r in stats.quantiles(df, ["k"], "x", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    for k, xs in x.items():
        assert (got[k].low, got[k].mid, got[k].top) == pytest.approx(tuple(np.quantile(xs, [0.1, 0.5, 1.0])))
    lower = {r.k: r.mid for r in stats.quantiles(df, ["k"], "x", {"mid": 0.5}, lower=True).collect()}
    assert lower["b"] == np.sort(x["b"])[99] and stats.quantiles(df.limit(0), ["k"], "x", {"mid": 0.5}).count() == 0


def test_long_clips_give_the_same_quantiles(spark):
    rng = np.random.default_rng(9)
    rows = [(c, d, float(v)) for c, n in (("a", 400), ("b", 30), (None, 50)) for d in (0, 1) for v in rng.normal(size=n)]
    df = spark.createDataFrame(rows, "c string, d int, x double").repartition(4)
    want = {d: np.mean([np.quantile([v for c, e, v in rows if c == k and e == d], 0.9) for k in ("a", "b", None)]) for d in (0, 1)}
    for most in (1 << 22, 500, 0):
        got = {r.d: r.q for r in stats.mean_of_quantiles(df, ["c"], ["d"], {"q": 0.9}, most=most).collect()}
        assert got == {d: pytest.approx(v) for d, v in want.items()}


def test_nearest_code_equals_plain_search():
    rng = np.random.default_rng(2)
    book = rng.normal(size=(40, 8)).round(1)
    book[7] = book[3]
    x = np.vstack([rng.normal(size=(500, 8)), book, (book[1] + book[2])[None] / 2])
    found, dist = matching.nearest_code(x, book, 64)
    d = np.round(((x[:, None] - book[None]) ** 2).sum(axis=2), 9)
    assert (found == d.argmin(axis=1)).all() and np.allclose(dist, d.min(axis=1), atol=1e-9) and found[500 + 7] == 3


def test_a_gap_is_given_up():
    rows = np.array([[0, 1.0], [1, 1.0], [5, 1.0], [4, 1.0], [4, 9.0], [1, 7.0]])
    now, wait, missing = I.in_turn(-1, rows, False)
    assert now[:, 0].tolist() == [0, 1] and wait[:, 0].tolist() == [4, 5] and missing == 0 and wait[0, 1] == 1.0
    now, wait, missing = I.in_turn(1, wait, True)
    assert now[:, 0].tolist() == [4, 5] and len(wait) == 0 and missing == 2
    assert [len(p) for p in I.in_turn(5, rows, True)[:2]] == [0, 0]


class State:
    """A group's state, as the stream keeps it."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.get, self.wait = False, False, None, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_state_of_a_silent_recording_goes():
    import pandas as pd

    run, state = I.integrate(1000), State()
    frame = lambda *ts: pd.DataFrame({"t": ts, "dx": [1.0] * len(ts), "dz": [0.5] * len(ts), "y": [1.0] * len(ts)})
    out = pd.concat(run(("r",), iter([frame(0), frame(3, 1)]), state))
    assert out["t"].tolist() == [0, 1] and out["x"].tolist() == [1.0, 2.0] and state.wait == 1000
    state.hasTimedOut = True
    out = pd.concat(run(("r",), iter([]), state))
    assert out["t"].tolist() == [3] and out["missing"].tolist() == [1] and out["x"].tolist() == [3.0] and state.exists
    assert list(run(("r",), iter([]), state)) == [] and not state.exists


def test_poses_step_by_step_equal_the_whole(spark):
    import pandas as pd

    from kinetrace.kernels import motion as M

    rng = np.random.default_rng(3)
    f, pos, root, rest = rng.normal(size=(9, W)), rng.normal(size=3), rng.normal(size=6), rng.normal(size=456)
    m, place, down = M.decode(f, pos, root, rest)
    run, state, out = I.decode_poses(), State(), []
    frame = lambda *ts: pd.DataFrame({"t": ts, "features": [f[t] for t in ts], "init_root_pos": [pos] * len(ts), "init_root_rot6d": [root] * len(ts), "init_joints76_rot6d": [rest] * len(ts)})
    for part in ([1], [0, 2, 2], [5, 3], [4], [8, 7, 6]):
        out += list(run(("r",), iter([frame(*part)]), state))
    out = pd.concat(out)
    assert out["frame"].tolist() == list(range(10)) and np.allclose(np.stack(out["transl"]), place) and np.allclose(np.stack(out["contacts"])[1:], down[1:])
    assert np.allclose(M.matrices(np.stack(out["poses"]).reshape(10, 77, 3)), m, atol=1e-9)


def test_streams_of_a_record(spark):
    record = [float(k) for k in range(W)]
    rest, joints = V.split_streams(F.col("v"))
    r = spark.createDataFrame([(record,)], "v array<double>").select("v", rest.alias("a"), joints.alias("b"), V.without_contacts(F.col("v")).alias("c")).select("*", V.joined_streams(F.col("a"), F.col("b")).alias("d")).collect()[0]
    assert len(r.a) == 43 and len(r.b) == 456 and r.c == record[:495] and r.d == record


def test_codec_in_groups(spark, tmp_path):
    rng = np.random.default_rng(4)
    c = clips(spark, (9, 3)).drop("error")
    config = codec.Config.of(name="vector", strides={"a": 4, "b": 2}, dims={"a": (0, 9), "b": (495, 499)}, what="else")
    p = {"a.book.0": rng.normal(size=(6, 5)), "a.book.1": rng.normal(size=(6, 5)) / 4, "a.down": rng.normal(size=(9, 5)), "a.up": rng.normal(size=(5, 9)), "b.book.0": rng.normal(size=(3, 4)), "b.mean": rng.normal(size=4), "b.std": rng.random(4) + 0.5}
    codec.save_parameters(spark, p, f"file://{tmp_path}/p")
    p = codec.load_parameters(spark, f"file://{tmp_path}/p")
    k = codec.build(config, p)
    got = {(r.row_id, r.grp, r.token, r.layer): r.code for r in k.tokens(c).collect()}
    x = np.array(c.where("row_id = 0").collect()[0].features).reshape(-1, W)
    z = x[:8, :9].reshape(2, 4, 9).mean(axis=1) @ p["a.down"]
    one = ((z[:, None] - p["a.book.0"]) ** 2).sum(axis=2).argmin(axis=1)
    two = (((z - p["a.book.0"][one])[:, None] - p["a.book.1"]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[0, "a", t, 0] for t in (0, 1)] == one.tolist() and [got[0, "a", t, 1] for t in (0, 1)] == two.tolist()
    assert {k for k, *_ in got} == {0, 91, 93} and sum(k == 0 for k, *_ in got) == 2 * 2 + 4
    back = {r.row_id: np.array(r.features).reshape(-1, W) for r in k.reconstruct(c).collect()}
    want = np.repeat((p["a.book.0"][one] + p["a.book.1"][two]) @ p["a.up"], 4, axis=0)
    assert back[0].shape == (8, W) and np.allclose(back[0][:, :9], want, atol=1e-5) and not back[0][:, 9:495].any()
    b = [got[0, "b", t, 0] for t in range(4)]
    assert np.allclose(back[0][:, 495:], np.repeat(p["b.book.0"][b], 2, axis=0) * p["b.std"] + p["b.mean"], atol=1e-5)
    first = {r.row_id: np.array(r.features).reshape(-1, W) for r in k.reconstruct(c, prefix=1).collect()}
    assert np.allclose(first[0][:, :9], np.repeat(p["a.book.0"][one] @ p["a.up"], 4, axis=0), atol=1e-5)
    same = codec.build(codec.Config.of()).reconstruct(c).collect()
    assert {r.row_id: len(r.features) // W for r in same} == {0: 8, 91: 8, 93: 8} and codec.build(codec.Config()).tokens(c).count() == 0
    with pytest.raises(ValueError):
        codec.build(codec.Config.of(name="other"))
    h = codec.semantic(z, [(rng.normal(size=(5, 7)), np.zeros(7)), (rng.normal(size=(7, 3)), np.ones(3))])
    assert h.shape == (1, 3) and np.linalg.norm(h) == pytest.approx(1)


def test_files_of_a_release(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for k, n in enumerate((4, 1, 3)):
        arrays = [rng.normal(size=m) for m in (n * W, 3, 6, 456, 10, 702, (n + 1) * 231)]
        rows.append((k, f"r{k}", 50.0, *([float(v) for v in a] for a in arrays), "{}", f"text {k}" if k else None))
    rows.append((9, "r0", *rows[0][2:]))
    df = spark.createDataFrame(rows, "row_id long, rec_id string, fps double, features array<float>, init_root_pos array<float>, init_root_rot6d array<float>, init_joints76_rot6d array<float>, identity_coeffs array<float>, joint_orient array<float>, joints77_pos array<float>, provenance_json string, text string")
    got = {r.rec_id: r.error for r in pipelines.export(df, str(tmp_path / "x")).collect()}
    assert got == {"r0": None, "r2": None}
    back = {r.path.split("/")[-2]: r for r in files.read_npz(spark, str(tmp_path / "x")).collect()}
    assert set(back) == {"r0", "r2"} and np.allclose(back["r2"].features, rows[2][3], atol=1e-6) and back["r0"].error is None
    assert [r.value for r in spark.read.text(str(tmp_path / "x" / "manifest")).collect()] == ["r0", "r2"]
    assert {r.rec_id: r.text for r in files.read_report(spark, str(tmp_path / "x" / "captions"), "rec_id string, text string").collect()} == {"r0": "", "r2": "text 2"}


def test_teacher_template_and_raw_metrics(spark, tmp_path):
    got = {r.row_id: r for r in pipelines.teacher_check(clips(spark), pipelines.mean_pool, most=10).collect()}
    assert {k: r.frames for k, r in got.items()} == {0: 10, 1: 7, 2: 2, 3: 1, 91: 10, 93: 10} and all(r.finite and r.width == W for r in got.values())
    assert got[0].norm == pytest.approx(1) and got[3].norm == 0
    rest = spark.createDataFrame([(1, 0, 1.0, 2.0, 0.0), (0, -1, 1.0, 0.0, 0.0)], "joint int, parent int, x double, y double, z double")
    skeleton.write_template(rest, f"file://{tmp_path}/t")
    parents, offset = skeleton.read_template(spark, f"file://{tmp_path}/t")
    assert parents == [-1, 0] and offset.tolist() == [[1.0, 0.0, 0.0], [0.0, 2.0, 0.0]]
    skeleton.write_template(rest.where("joint = 1"), f"file://{tmp_path}/u")
    with pytest.raises(ValueError):
        skeleton.read_template(spark, f"file://{tmp_path}/u")
    pipelines.write_metrics(spark.range(3), spark.range(2), f"file://{tmp_path}/m")
    assert spark.read.parquet(f"file://{tmp_path}/m/clips").count() == 3
    df = caches.held(spark.range(3), in_memory=False)
    assert df.count() == 3 and df.is_cached
    df.unpersist()


def test_small_losses(spark):
    r = spark.range(1).select(losses.orthogonality([F.lit(1.0), F.lit(2.0), F.lit(0.0)], [F.lit(1.0), F.lit(1.0), F.lit(5.0)]), losses.root_header(F.lit(1.0), F.lit(2.0), 1.0, 0.5), losses.weighted({"a": F.lit(2.0), "b": F.lit(3.0)}, {"a": 0.5, "b": 0.0})).collect()[0]
    assert list(r) == [9.0, 1.0, 1.0]
    df = spark.createDataFrame([(0.2, 1.0, True), (0.8, 0.0, False), (None, 1.0, False)], "c double, contact double, there boolean")
    r = df.agg(losses.cosine_loss(F.col("c")), losses.cosine_loss(F.col("c"), F.col("there")), losses.cosine_loss(F.col("c"), F.lit(False)), losses.foot_skate([F.col("contact")] * 3, F.col("contact")), losses.commitment(F.col("contact"), 2)).collect()[0]
    assert list(r) == pytest.approx([0.5, 0.8, 0.0, 6 / 6.000001, 1 / 3])


def test_paths_sets_and_files(spark, tmp_path):
    df = spark.createDataFrame([("/a/b/c.npz", "x, y,,x"), ("c", ""), ("a.d/c", None), (None, " ")], "p string, s string")
    c = F.col("p")
    got = df.select(files.file_name(c).alias("n"), files.parent_name(c).alias("d"), files.with_suffix(c, ".meta.json").alias("m"), files.comma_set(F.col("s")).alias("s")).collect()
    assert [tuple(r)[:3] for r in got] == [("c.npz", "b", "/a/b/c.meta.json"), ("c", None, "c.meta.json"), ("c", "a.d", "a.d/c.meta.json"), (None, None, None)]
    assert [r.s for r in got] == [["x", "y"], [], None, []]
    for split in ("val", "train"):
        spark.range(3).repartition(2).write.parquet(str(tmp_path / "d" / split))
    found = files.discover(spark, str(tmp_path / "d")).collect()
    assert [r.split for r in found] == ["train", "train", "val", "val"] and [r.path for r in found] == sorted(r.path for r in found)
    assert files.discover(spark, str(tmp_path / "d"), "val").count() == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path / "none"))
    assert [r.id for r in files.head(spark.range(9), ["id"], 2).collect()] == [0, 1] and files.head(spark.range(9), ["id"], 0).count() == 9


def test_ordered_hash(spark):
    import hashlib

    lines = [(k, f"id{k}", f"/p/{k}") for k in range(500)]
    df = spark.createDataFrame(lines, "pos int, id string, path string").repartition(7)
    want = hashlib.sha256("".join(f"{a}\0{b}\n" for _, a, b in lines).encode()).hexdigest()
    r = files.ordered_hash(df, ["pos"], ["id", "path"]).collect()[0]
    assert (r.sha256, r.n) == (want, 500)
    assert files.ordered_hash(df.limit(0), ["pos"], ["id", "path"]).count() == 0


def test_statistics_of_fields(spark):
    s = {(r.field, r.i): r for r in pipelines.field_statistics(clips(spark, (20,)).where("row_id = 0"), []).collect()}
    x = np.array(clips(spark, (20,)).where("row_id = 0").collect()[0].features).reshape(-1, W)
    assert len(s) == W and s["root_rot6d", 2].mean == pytest.approx(x[:, 11].mean()) and s["root_rot6d", 2].rate is None
    assert s["foot_contact", 3].rate == pytest.approx(x[:, 498].mean()) and s["foot_contact", 3]["std"] is None and s["sparse_vel", 0]["std"] == pytest.approx(math.sqrt(x[:, 471].var() + 1e-8))


def test_shared_folder_must_be_named_on_a_cluster():
    from kinetrace import shared

    class Conf:
        def get(self, *_):
            return None

    class Context:
        def getConf(self):
            return Conf()

    for master, fails in (("spark://x:7077", True), ("local-cluster[2,1,1024]", True), ("yarn", True)):
        Context.master = master
        session = type("S", (), {"conf": Conf(), "sparkContext": Context()})()
        with pytest.raises(RuntimeError):
            shared.shared_dir(session)
