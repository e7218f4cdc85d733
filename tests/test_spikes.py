"""Implausible readings, on small made-up recordings."""

import numpy as np

from kinetrace.operators import spikes as S

SCHEMA = "row_id long, rec_id string, source string, t int, root_traj array<float>, ingested_at timestamp_ntz, field string"


def recording(rng, n=120, noise=0.01):
    x = np.cumsum(rng.normal(size=(n, 9)) * 0.001, axis=0) + rng.normal(size=(n, 9)) * noise
    x[:, 4] += 0.95
    return np.round(x, 4)


def rows(rec, x, source="s", drop=()):
    return [(k, rec, source, k, [float(v) for v in r], None, "clash") for k, r in enumerate(x) if k not in drop]


def found(spark, data):
    scanned = S.scan_readings(spark.createDataFrame(data, SCHEMA), S.ROOT_TRAJ)
    return {(r.rec_id, r.t) for r in S.implausible(scanned, (S.ROOT_TRAJ,)).collect()}


def test_kinds_of_cases(spark):
    rng = np.random.default_rng(0)
    clean, spiked, stuck, sunk, stepped, wavy, gap = (recording(rng) for _ in range(7))
    spiked[40:42, 2] += 0.9
    stuck[30:60, 6] = stuck[30, 6]
    sunk[10:13, 4] = -2.0
    sunk[70, 1] = np.inf
    stepped[50:, 4] += 0.4
    wavy[:, 0] += 0.5 * np.sin(np.arange(120) / 5)
    gap[20, 3] = 5.0
    gap[21, 3] = np.nan
    data = []
    for name, x in (("clean", clean), ("spiked", spiked), ("stuck", stuck), ("sunk", sunk), ("stepped", stepped), ("wavy", wavy), ("gap", gap)):
        data += rows(name, x)
    data += rows("spiked", spiked)  # second deliveries
    data += [(1, None, "s", 1, [0.0] * 9, None, ""), (2, "clean", "s", None, [0.0] * 9, None, ""), (3, "clean", None, 500, None, None, ""), (4, "clean", "s", 501, [1.0], None, "")]
    want = {("spiked", 40), ("spiked", 41), *(("stuck", t) for t in range(30, 60)), *(("sunk", t) for t in (10, 11, 12, 70)), ("gap", 20)}
    assert found(spark, data) == want


def test_runs_and_spikes_at_the_border_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 64)
    monkeypatch.setattr(S, "HALO", 24)
    rng = np.random.default_rng(1)
    x = recording(rng, 300)
    x[60:70, 1] = x[60, 1]
    x[118:160, 5] = x[118, 5]
    x[64, 0] += 2.0
    x[127:129, 7] -= 2.0
    want = {("r", t) for t in [*range(118, 160), 64, 127, 128]}
    assert found(spark, rows("r", x)) == want


def test_stuck_through_whole_stretches(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 64)
    monkeypatch.setattr(S, "HALO", 24)
    rng = np.random.default_rng(4)
    tail, middle, head, still, apart = (recording(rng, 400) for _ in range(5))
    tail[180:, 1] = tail[180, 1]
    middle[50:350, 6] = middle[50, 6]
    head[:300, 0] = head[300, 0]
    still[:, 8] = 0.25
    apart[:, 3] = 1.0
    apart[200:, 3] = 2.0
    data = [r for name, x in (("tail", tail), ("middle", middle), ("head", head), ("still", still)) for r in rows(name, x)]
    data += rows("apart", apart, drop=range(128, 256))  # each of the stretches left is one run
    want = {("tail", t) for t in range(180, 400)} | {("middle", t) for t in range(50, 350)} | {("head", t) for t in range(301)}
    assert found(spark, data) == want | {("apart", t) for t in (*range(128), *range(256, 400))}


def test_constant_dimension_and_coarse_source(spark):
    rng = np.random.default_rng(2)
    still = recording(rng)
    still[:, 8] = 0.25
    coarse = [np.round(recording(rng, 300), 2) for _ in range(4)]
    data = rows("still", still)
    for k, x in enumerate(coarse):
        data += rows(f"c{k}", x, "coarse")
    assert not {r for r in found(spark, data) if r[0] == "still"}


def test_either_end_short_series_and_neighbouring_spikes(spark):
    rng = np.random.default_rng(5)
    ends, pair, near = (recording(rng, 200) for _ in range(3))
    ends[0, 2] += 2.0
    ends[198:, 6] -= 2.0
    pair[50, 0] += 2.0
    pair[51, 0] -= 2.0
    near[70, 1] += 2.0
    near[72, 1] += 2.0
    data = [r for name, x in (("ends", ends), ("pair", pair), ("near", near)) for r in rows(name, x)]
    for n in (1, 2, 3):
        x = recording(rng, n)
        x[n // 2, 3] += 5.0
        data += rows(f"short{n}", x)
    want = {("ends", 0), ("ends", 198), ("ends", 199), ("pair", 50), ("pair", 51), ("near", 70), ("near", 72), ("short3", 1)}
    assert found(spark, data) == want


def test_runs_of_a_source_that_mostly_repeats(spark):
    rng = np.random.default_rng(6)
    data = []
    for k in range(4):
        x = recording(rng, 2000)
        keep = rng.random((2000, 9)) < 0.95
        for t in range(1, 2000):
            x[t, keep[t]] = x[t - 1, keep[t]]
        if k == 3:
            x[500:1200, 2] = x[500, 2]
        data += rows(f"r{k}", x, "slow")
    got = found(spark, data)
    assert {("r3", t) for t in range(500, 1200)} <= got and {r for r, t in got} == {"r3"} and len(got) < 800


def test_many_stuck_runs_do_not_become_usual(spark):
    rng = np.random.default_rng(7)
    data, want = [], set()
    for k in range(3):
        x = recording(rng, 2000)
        for t in range(20, 1900, 90):
            x[t : t + 20, 4] = x[t, 4]
            want |= {(f"r{k}", u) for u in range(t, t + 20)}
        data += rows(f"r{k}", x)
    assert found(spark, data) == want


def test_latest_delivery_counts_as_a_whole(spark):
    from datetime import datetime

    rng = np.random.default_rng(8)
    x = recording(rng)
    late, early = datetime(2024, 5, 2), datetime(2024, 5, 1)
    data = [(k, "r", "s", k, [float(v) for v in r], early, "") for k, r in enumerate(x)]
    wrong, gone = list(x[40]), list(x[60])
    wrong[3], gone[3] = 9.0, None
    data += [(500, "r", "s", 40, [float(v) for v in wrong], late, ""), (501, "r", "s", 60, [float(v) + 9.0 for v in x[60]], datetime(2024, 4, 1), "")]
    data += [(502, "r", "s", 80, [float(v) + 9.0 for v in x[80]], early, ""), (503, "r", "s", 80, [None] * 9, late, "")]
    assert found(spark, data) == {("r", 40)}


def test_whole_readings_and_empty_tables(spark):
    rng = np.random.default_rng(3)
    feats = rng.normal(size=(40, 499)).cumsum(axis=0) * 0.001 + rng.normal(size=(40, 499)) * 0.003
    joints = rng.normal(size=(41, 231)) * 0.003 + 1.0
    feats[:, 4] += 1
    feats[10:25] = feats[10]
    joints[30, 7] += 0.9
    joints[33, 4] = -3
    data = [(1, "a", "s", feats.ravel().astype(float).tolist(), joints.ravel().astype(float).tolist()), (2, "b", None, None, [1.0]), (3, None, "s", None, None), (4, "c", "s", [], None)]
    df = spark.createDataFrame(data, "row_id long, rec_id string, source string, features array<float>, joints77_pos array<float>")
    fields = (S.FEATURES, S.JOINTS)
    got = {(r.field, r.rec_id, r.t) for r in S.implausible(S.scan_clips(df, fields), fields).collect()}
    assert got == {*(("features", "a", t) for t in range(10, 25)), ("joints77_pos", "a", 30), ("joints77_pos", "a", 33)}
    assert S.implausible(S.scan_clips(df.limit(0), fields), fields).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert S.find(df.limit(0), none).count() == 0
