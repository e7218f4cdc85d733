"""Pieces: limits, overlap, natural cuts, edge cases."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrace.llm import pieces as P

UMR = "row_id long, rec_id string, num_records int, fps double, features array<float>, n int"
PLANS = "clip_id string, num_frames int, starts array<int>, error string, planned_at timestamp_ntz, item_id string"
EVENTS = "line_no long, rec_id string, events array<struct<start_time:double,end_time:double>>"
RECS = "rec_id string, source string, fps double"
SOURCES = "source string, nominal_fps double"


def sound(parts, n, limit, overlap):
    assert parts[0][0] == 0 and parts[-1][1] == n
    for a, b, _ in parts:
        assert 0 < b - a <= limit
    for (a, b, _), (c, d, _) in zip(parts, parts[1:]):
        assert c == b - overlap and d > b


@given(st.integers(301, 3000), st.lists(st.integers(-5, 3100), max_size=30), st.lists(st.integers(-5, 3100), max_size=30), st.integers(0, 60))
@settings(deadline=None)
def test_pieces_fit_overlap_and_cover(n, marks, starts, overlap):
    events = [{"start_time": m / 50, "end_time": (m + 7) / 50} for m in marks]
    parts = P.pieces_of(n, starts, 50.0, events, None, 300, overlap)
    sound(parts, n, 300, overlap)
    bounds = {p for m in marks for p in (m, m + 7)}
    for a, b, what in parts[:-1]:
        assert what != "event" or b in bounds
        assert what != "start" or b in starts
        if what != "event":  # no bound of an event was within reach
            assert not any(a + overlap < p <= a + 300 and 0 < p < n for p in bounds)
        if what == "limit":
            assert b == a + 300 and not any(a + overlap < s <= a + 300 and 0 < s < n for s in starts)


def test_deepest_valley_of_the_motion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 499)) * 0.05
    x[180:] += rng.normal(size=499)  # another movement from 180 on
    depth = P.motion_depth(x)
    assert abs(int(depth[100:299].argmax()) + 100 - 180) <= 2
    marks = [{"start_time": t / 50, "end_time": (t + 1000) / 50} for t in (160, 181, 290)]
    assert P.pieces_of(500, None, 50.0, marks, depth)[0][1] == 181


def test_valleys_where_there_is_neither_event_nor_start():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(130, 499)) * 0.05 + rng.normal(size=499) for _ in range(5)])
    parts = P.pieces_of(650, None, 50.0, None, P.motion_depth(x))
    sound(parts, 650, 300, 30)
    assert {what for *_, what in parts[:-1]} == {"valley"}
    assert all(min(abs(b - m) for m in (130, 260, 390, 520)) <= 2 for _, b, _ in parts[:-1])
    assert P.pieces_of(650, None, 50.0, None, np.zeros(650))[0] == (0, 300, "limit")
    assert P.pieces_of(650, [64], 50.0, None, P.motion_depth(x))[0] == (0, 64, "start")


def test_no_usable_events():
    for events in (None, [], [None], [{"start_time": None, "end_time": 1.0}], [{"start_time": float("nan"), "end_time": 1.0}], [{"start_time": -5.0, "end_time": 1e9}]):
        for fps in (None, 0.0, float("nan"), 50.0):
            parts = P.pieces_of(700, [None, 0, 256, 256, 128, 9999], fps, events, None)
            sound(parts, 700, 300, 30)
            assert parts[0] == (0, 256, "start")
    assert P.pieces_of(700, None, None, None, None)[0] == (0, 300, "limit")


def test_tables(spark):
    from datetime import datetime as D

    long = [0.5] * (310 * 499)
    umr = [
        (1, "a", 5, 50.0, long, 0), (2, "a", None, 0.0, long, 0), (3, "b", 400, None, None, 0), (4, "c", 900, 50.0, [0.5] * 499, 0),
        (5, None, 900, 50.0, None, 0), (6, "d", None, 50.0, None, 0), (7, "e", 300, 50.0, None, 0), (8, "f", 900, 50.0, [], 0),
    ]
    t = [D(2024, 1, k) for k in range(1, 9)]
    plans = [
        ("p", 900, [64], None, t[0], ""), ("p", 200, None, None, t[1], ""), ("p", 999, None, "x", t[2], ""), ("q", 100, None, None, t[0], ""), ("q", 301, [], None, t[1], ""),
        ("q", 301, [], None, t[1], ""), ("r", None, None, "x", t[0], ""), ("s", 5000, [1], None, t[0], ""), (None, 900, [], None, t[0], ""), ("t", 300, [], None, None, ""),
    ]
    events = [(1, "s", [(0.0, 3.0)]), (2, "s", [(1.0, 5.0), (5.0, 9.0)]), (3, "q", None), (4, None, []), (5, "a", [])]
    recs = [("s", "k", None), ("s", "k", 50.0), ("q", None, None), (None, "k", 1.0)]
    frames = [spark.createDataFrame(x, k) for x, k in ((umr, UMR), (plans, PLANS), (events, EVENTS), (recs, RECS), ([("k", 30.0), (None, None)], SOURCES))]
    got = P.pieces(*frames).collect()
    assert {(r.table_name, r.item_id) for r in got} == {("umr_release", "a"), ("umr_release", "b"), ("clip_plans", "q"), ("clip_plans", "s")}
    assert {r.row_key for r in got if r.item_id == "a"} == {1, 2}
    own = sorted((r.piece, r.start, r.stop, r.cut) for r in got if r.item_id == "s")
    sound([p[1:] for p in own], 5000, 300, 30)
    assert own[0][2:] == (250, "event")
    checked = P.sound(P.pieces(*frames)).collect()
    assert all(r.sound for r in checked) and {(r.item_id, r.row_key, r.length) for r in checked} == {("a", 1, 310), ("a", 2, 310), ("b", 3, 400), ("q", None, 301), ("s", None, 5000)}
    spoilt = P.pieces(*frames).where("not (item_id = 's' and piece = 3)")
    assert {r.item_id for r in P.sound(spoilt).collect() if not r.sound} == {"s"}
    assert P.pieces(*(f.limit(0) for f in frames)).count() == 0


def test_deepest_bound_of_the_whole_window():
    assert P.cut(500, {120: 0.9, 200: 0.1}, {})[0] == (0, 120, "event")
    assert P.cut(500, {120: 0.5, 200: 0.5}, {})[0] == (0, 200, "event")
    assert P.cut(500, {}, {40: 0.9, 290: 0.1})[0] == (0, 40, "start")
