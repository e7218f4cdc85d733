"""Recordings to clips and back, windows, token targets, evaluation."""

import numpy as np
import pytest

from kinetrace import pipelines as P
from kinetrace.kernels import motion as M
from kinetrace.operators.skeleton import forward

W = 499


def recording(rng, n=64):
    """A rig of short bones that walks and turns."""
    parents = [-1, *rng.integers(0, np.arange(1, 77))]
    offset = rng.normal(size=(77, 3)) * 0.1
    poses = np.cumsum(rng.normal(size=(n, 77, 3)) * 0.01, axis=0) + rng.normal(size=(77, 3)) * 0.2
    poses[:, 0] = [0.0, 0.4, 0.0] + np.linspace(0, 1, n)[:, None] * [0.05, 0.9, 0.02]
    root = np.stack([np.linspace(0, 1.5, n), 0.95 + 0.02 * np.sin(np.arange(n)), np.linspace(0, -0.7, n)], axis=1)
    return forward([int(p) for p in parents], offset, M.matrices(poses), root), poses


def test_rotation_round_trips():
    v = np.random.default_rng(0).normal(size=(100, 3))
    m = M.matrices(v)
    assert np.allclose(m @ np.swapaxes(m, 1, 2), np.eye(3), atol=1e-12)
    assert np.allclose(M.matrices(M.axis_angles(m)), m, atol=1e-10)
    half = M.matrices(np.array([[np.pi, 0, 0], [0, np.pi, 0], [0, 0, np.pi], [0, 0, 0]]))
    assert np.allclose(M.matrices(M.axis_angles(half)), half, atol=1e-9)


def test_canonical_clip():
    x, v = recording(np.random.default_rng(1))
    y, r = M.canonical(x, v)
    assert abs(y[..., 1].min()) < 1e-12 and np.allclose(y[0, 0, [0, 2]], 0)
    a, b, c, d = (y[0, j] for j in M.FACING)
    facing = np.cross([0, 1, 0], a - b + c - d)
    assert abs(facing[0]) < 1e-9 and facing[2] > 0
    assert np.allclose(np.linalg.norm(np.diff(y, axis=0), axis=-1), np.linalg.norm(np.diff(x, axis=0), axis=-1))
    z, _ = M.canonical(y, r)
    assert np.allclose(z, y, atol=1e-9)


def test_encode_decode():
    x, v = recording(np.random.default_rng(2))
    c = M.encode(x, v, 50.0)
    assert c.features.shape == (63, W)
    m, place, down = M.decode(c.features, c.root_pos, c.root_rot6d, c.joints_rot6d)
    assert np.allclose(place, c.joints[:, 0], atol=1e-9)
    assert np.allclose(m[:, 1:], M.matrices(v)[:, 1:], atol=1e-9)
    assert down.shape == (64, 4) and set(np.unique(down)) <= {0.0, 1.0}
    assert np.allclose(c.features[0, 5:7], c.features[0, 2:4])
    assert np.allclose(c.features[40, 5:7], (c.joints[41, 0] - c.joints[31, 0])[[0, 2]] / 10)
    slow = M.encode(x, v, 30.0)
    assert abs(len(slow.features) + 1 - round(64 * 50 / 30)) <= 1
    with pytest.raises(ValueError):
        M.encode(x[:1], v[:1], 50.0)


def test_convert_and_decode_tables(spark):
    x, v = recording(np.random.default_rng(3), 12)
    rows = [("a", 50.0, x.ravel().tolist(), v.ravel().tolist()), ("b", None, x.ravel().tolist(), v.ravel().tolist()), ("bad", 50.0, [1.0], [1.0]), ("null", 50.0, None, None)]
    clips = P.convert(spark.createDataFrame(rows, "rec_id string, fps double, joints array<double>, poses array<double>"))
    got = {r.rec_id: r for r in clips.collect()}
    assert got["a"].num_records == 11 and got["a"].error is None and got["b"].num_records == 19 and got["bad"].error and got["null"].error
    back = {r.rec_id: r for r in P.decode(clips.where("error is null")).collect()}
    assert np.allclose(np.array(back["a"].transl).reshape(-1, 3), np.array(got["a"].joints77_pos).reshape(-1, 77, 3)[:, 0], atol=1e-4)
    assert P.convert(spark.createDataFrame(rows, "rec_id string, fps double, joints array<double>, poses array<double>").limit(0)).count() == 0


def clips(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate((20, 12, 4, 1)):
        f = rng.normal(size=(n, W))
        f[:, 495:] = rng.integers(0, 2, (n, 4))
        rows.append((k, f"r{k}", 50.0 if k != 1 else 30.0, [float(x) for x in f.ravel()], '{"dataset": "x"}' if k else None))
    rows.append((9, "none", None, None, "{"))
    return spark.createDataFrame(rows, "row_id long, rec_id string, fps double, features array<float>, provenance_json string")


def test_windows_hold_the_clips_records(spark):
    c = clips(spark)
    source = {r.row_id: np.array(r.features).reshape(-1, W) for r in c.where("features is not null").collect()}
    got = P.fixed_windows(c, 7, 3, 16).collect()
    assert len(got) == 6 + 3  # 0 3 6 9 12 13, and 0 3 5
    for r in got:
        assert np.array_equal(np.array(r.features).reshape(-1, W), source[r.row_id][r.start : r.start + 7])
    heads = P.ragged(c, 4, 14, 4).orderBy("row_no").collect()
    assert [(r.row_id, r["take"], r.offset) for r in heads] == [(0, 12, 0), (1, 12, 12), (2, 4, 24)]
    assert np.array_equal(np.array(heads[0].features).reshape(-1, W), source[0][:12])
    with pytest.raises(ValueError):
        P.ragged(c, 2, 1, 4)
    assert {r.row_id for r in P.look_up(c, [0, 9, 77]).collect()} == {0, 9}


def test_materialize_and_normalization(spark):
    c = clips(spark)
    assert {r.row_id for r in P.materialize(c, ["x"], least=4).collect()} == {1, 2}
    assert {r.row_id for r in P.materialize(c, None, c.where("row_id < 3"), 4, c.where("row_id = 0")).collect()} == {1, 2}
    n = {r.dim: r for r in P.normalization(c).collect()}
    x = np.concatenate([np.array(r.features).reshape(-1, W) for r in c.where("fps = 50 and features is not null").collect()])
    assert n[3].n == 25 and n[3].mean == pytest.approx(x[:, 3].mean()) and n[3]["std"] == pytest.approx(np.sqrt(x[:, 3].var() + 1e-8)) and n[497].mean == 0 and n[497]["std"] == 1


def test_token_targets(spark):
    c = clips(spark)
    x = np.array(c.where("row_id = 0").collect()[0].features, np.float32).reshape(-1, W)
    got = {(r.row_id, r.token): r.emb for r in P.token_targets(c, width=8).collect()}
    assert len(got) == 5 + 3 + 1
    assert np.allclose(got[0, 2], P.mean_pool(x[6:14]), atol=1e-6)  # 10 - 4 .. 10 + 4
    block = {(r.row_id, r.token): r.emb for r in P.token_targets(c, width=8, mode="block").collect()}
    assert block[0, 2] == block[0, 3] and np.allclose(block[0, 4], P.mean_pool(x[16:20]), atol=1e-6)
    events = spark.createDataFrame([("r0", [(0.0, 0.1), (0.0, 0.3)]), ("r1", None)], "rec_id string, events array<struct<start_time:double,end_time:double>>")
    e = {(r.row_id, r.token): r.emb for r in P.token_targets(c, events, mode="event").collect()}
    assert np.allclose(e[0, 0], P.mean_pool(x[0:5]), atol=1e-6) and np.allclose(e[0, 2], P.mean_pool(x[0:15]), atol=1e-6) and e[0, 4] is None and e[1, 0] is None
    for bad in ({"mode": "x"}, {"mode": "event"}, {"stride": 0}):
        with pytest.raises(ValueError):
            P.token_targets(c, **bad)


def test_evaluate(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(10, 77, 3)).ravel().tolist()
    rows = [(1, g, g), (2, g[: 9 * 231], g), (3, g[: 3 * 231], g), (4, None, g), (5, [1.0], g)]
    per, total = P.evaluate(spark.createDataFrame(rows, "row_id long, pred array<double>, gt array<double>"))
    assert {r.row_id: r.n_frames for r in per.collect()} == {1: 10, 2: 9}
    assert {r.metric: r["mean"] for r in total.collect()}["mpjpe"] == pytest.approx(0)
