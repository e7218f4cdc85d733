"""Overlaps between splits: planted pairs, distractors, edge cases."""

import numpy as np

from kinetrace.llm import splits as S
from kinetrace.shared import materialize

SCHEMA = "row_id long, split string, source string, rec_id string, text string, features array<float>, cls string"
CAPTION = "a careful teacher in a navy skirt slides over a hurdle then kicks inside the dusty kitchen a plank with a stiff wrist before bowing while a judge hides"


def motion(rng, n=20):
    a, b, c = rng.normal(size=(3, 499))
    t = np.arange(n)[:, None] / 10
    return np.clip(np.sin(a * 3 + b * t * 2 + c), -1, 1)


def row(k, split, rec, text=None, x=None):
    return (k, split, "s", rec, text, None if x is None else [float(v) for v in np.asarray(x).ravel()], "clash")


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = S.overlaps(df, materialize)
    got = {(r.row_id_a, r.row_id_b) for r in S.pairs_of_rows(found).collect()}
    return got, found, df


def test_planted_pairs(spark):
    rng = np.random.default_rng(0)
    x = [motion(rng) for _ in range(8)]
    far = [motion(rng) for _ in range(30)]
    rows = [row(k, "train", f"base_{k:04d}_t01", None, m) for k, m in enumerate(x)]
    rows += [row(100 + k, "train", f"far_{k:04d}_t01", "a person walks forward", m) for k, m in enumerate(far)]
    rows += [
        row(200, "val", "e_1", None, x[0]),
        row(201, "test", "e_2", None, np.round(x[1], 2)),
        row(202, "test", "e_3", None, x[2] + rng.normal(size=x[2].shape) * 0.002),
        row(203, "val", "e_4", None, np.delete(x[3], [2, 7, 8, 13], axis=0)),
        row(204, "val", "e_5", None, np.vstack([motion(rng, 2), x[4], motion(rng, 2)])),
        row(205, "test", "e_6", None, x[5] + 0.06),  # another take
        row(206, "test", "BASE-0006-T01", None, motion(rng)),
        row(207, "test", "base_0007_t01_r3", None, motion(rng)),
        row(208, "test", "e_7", "A person walks forward.", motion(rng)),
        row(209, "other", "e_8", None, x[0]),
        row(210, None, "e_9", None, x[0]),
    ]
    near = CAPTION.replace("over", "across").replace("a judge", "one judge")
    half = " ".join(CAPTION.split()[:15] + "umbrella near some old bridge where two dogs sleep quietly under trees until rain comes".split())
    rows += [row(300, "train", "c_1", CAPTION), row(301, "val", "c_2", CAPTION.upper() + "!"), row(302, "test", "c_3", near), row(303, "test", "c_4", half), row(304, "train", "c_5", CAPTION)]
    got, found, df = pairs(spark, rows)
    want = {(k, 200 + k) for k in (0, 1, 2, 3, 4)} | {(6, 206), (7, 207)} | {(a, b) for a in (300,) for b in (301, 302)} | {(301, 304), (302, 304)}
    assert got == want
    report = {(r.kind, r.split): (r.n_pairs, r.n_rows) for r in S.report(found, df).collect()}
    assert report == {("id", "test"): (2, 2), ("caption", "val"): (2, 1), ("caption", "test"): (2, 1), ("motion", "val"): (3, 3), ("motion", "test"): (2, 2), ("any", "val"): (None, 4), ("any", "test"): (None, 5)}
    links = {(r.row_id, r.kind): r.n_links for r in S.links_of_rows(found).collect()}
    assert links[301, "caption"] == 2 and links[200, "motion"] == 1 and len(links) == 9


def test_dirt_and_empty_tables(spark):
    nan = np.full((3, 499), np.nan)
    rows = [
        row(1, "train", None, "", nan), row(2, "val", None, "", nan), row(3, "train", "", " ", [[1.0] * 3]), row(4, "test", "--", None, [[1.0] * 3]),
        row(5, "train", "x", "word " * 5000), row(6, "test", "y", "word " * 5000), row(7, "Train ", "z_t01", None, []), row(8, "val", "z_t01_v2", None, []), row(None, "val", "z_t01", None, None),
    ]
    got, *_ = pairs(spark, rows)
    assert {(5, 6), (7, 8)} <= got and got <= {(5, 6), (7, 8), (1, 2)}
    df = spark.createDataFrame(rows, SCHEMA).limit(0)
    assert S.pairs_of_rows(S.overlaps(df, materialize)).count() == 0


def test_group_of_copies_is_one_class(spark):
    """Copies are compared once; their pairs come from the class alone."""
    rng = np.random.default_rng(1)
    x = motion(rng)
    rows = [row(k, "train" if k < 40 else "val", f"r{k}_", None, x) for k in range(60)]
    got, *_ = pairs(spark, rows)
    assert got == {(a, b) for a in range(40) for b in range(40, 60)}


def test_most_records_that_pair_in_order():
    rng = np.random.default_rng(5)
    b = motion(rng).astype(np.float32)
    a = np.vstack([b[10:11], b])  # a copy of a later record in front
    assert S.matched(a, b) == S.matched(b, a) == 20 and S.same_motion(a, b)
    for _ in range(20):
        x, y = (b[np.sort(rng.choice(20, n))] for n in rng.integers(1, 20, 2))
        same, best = S.alike(x, y), np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + same[i, j])
        assert S.matched(x, y) == S.matched(y, x) == best[-1, -1]
    y = b.copy()
    y[:, S._LOOK[:14]] += 1.0  # as many values as may differ, all among those looked at first
    assert S.matched(b, y) == 20
    y[:, S._LOOK[:15]] += 1.0
    assert S.matched(b, y) == 0


def test_hot_band_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    rows = [(f"t{k}", [7, k], True, False, 10 + k % 9) for k in range(40)] + [(f"e{k}", [7], False, True, 10 + k) for k in range(9)]
    classes = spark.createDataFrame(rows, "cls string, bands array<long>, on_train boolean, on_eval boolean, size int")
    got = {(r.ct, r.ce) for r in S._candidates(classes).collect()}
    assert got == {(f"t{k}", f"e{j}") for k in range(40) for j in range(9)}
    close = {(r.ct, r.ce) for r in S._candidates(classes, size="size", ratio=0.9).collect()}
    assert close < got and {(f"t{k}", f"e{j}") for k in range(40) for j in range(9) if min(10 + k % 9, 10 + j) >= 0.9 * max(10 + k % 9, 10 + j)} <= close


def test_words_are_told_by_one_rule(spark):
    glued = "left-hand/right-hand:turns,then-jumps/over-the-low:wall and lands_softly"
    assert len(glued.split()) < S.LEAST_WORDS <= len(S.caption_words(glued))
    got, *_ = pairs(spark, [row(1, "train", "a_1", glued), row(2, "val", "b_2", glued.replace("-", " "))])
    assert got == {(1, 2)}


def test_candidates_lose_no_near_pair():
    """Bands must bring together pairs at the edge of what counts as the same."""
    rng = np.random.default_rng(2)
    hit = 0
    for _ in range(60):
        x = motion(rng, int(rng.integers(6, 40)))
        y = np.round(x + rng.normal(size=x.shape) * 0.002, 2)
        y = np.delete(y, rng.choice(len(y), len(y) // 4, replace=False), axis=0)
        m = S.matched(x.astype(np.float32), y.astype(np.float32))
        assert m >= S.MOTION_JACCARD * (len(x) + len(y) - m)
        hit += bool({*S.motion_signature(x)} & {*S.motion_signature(y)})
    assert hit == 60
    words = CAPTION.split()
    hit = 0
    for _ in range(100):
        other = list(words)
        for k in rng.choice(len(words), 3, replace=False):
            other[k] = f"w{rng.integers(1e9)}"
        hit += bool({*S.caption_signature(words)[1]} & {*S.caption_signature(other)[1]})
    assert hit >= 99


def test_short_captions_with_few_words_changed(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for n in range(12, 28):
        words = [f"w{n}x{k}" for k in range(n)]
        rows.append(row(n, "train", f"t{n}", " ".join(words)))
        for k in (1, 2, 3, 5):
            other = list(words)
            for i in np.linspace(1, n - 2, k).astype(int):
                other[i] = f"v{rng.integers(1e9)}"
            rows.append(row(100 * k + n, "val", f"e{n}_{k}", " ".join(other)))
            if k <= S.CHANGED:
                want.add((n, 100 * k + n))
        if n >= 14:  # two left out, one put in
            rows.append(row(1000 + n, "test", f"f{n}", " ".join([*words[:2], "new", *words[2:5], *words[6:9], *words[10:]])))
            want.add((n, 1000 + n))
    got, *_ = pairs(spark, rows)
    assert got == want


def test_dead_channel_leaves_the_other_bands():
    rng = np.random.default_rng(4)
    for dead in range(15, 471, 19):
        x = motion(rng)
        y = x + rng.normal(size=x.shape) * 0.002
        x[:, dead] = np.nan
        assert {*S.motion_signature(x)} & {*S.motion_signature(y)}
        y[:, dead] = np.nan
        assert {*S.motion_signature(x)} & {*S.motion_signature(y)}
    assert S.motion_signature(np.full((3, 499), np.nan)) == []
