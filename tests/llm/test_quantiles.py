"""Percentiles: error bound, merging, edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrace.llm import quantiles as Q


def digest(x, dim=0):
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    return Q.add((np.int64(dim) << Q._NODE) | (Q.leaf(x) + (1 << Q.LEVELS)), np.ones(len(x), np.int64))


def rank_error(x, keys, counts, percents=Q.PERCENTS):
    """Largest distance of an answer's ranks from the wanted one, as a share."""
    _, n, values = Q.percentiles(keys, counts, percents)
    own = np.sort(Q.leaf(np.asarray(x, float)))
    worst = 0
    for p, v in zip(percents, values[0]):
        at = Q.leaf(np.array([v]))[0]
        want = max(1, np.ceil(p / 100 * len(own) - 1e-9))
        low, high = np.searchsorted(own, at, "left") + 1, np.searchsorted(own, at, "right")
        worst = max(worst, want - high, low - want)
    assert n[0] == len(own)
    return worst / len(own)


@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False), min_size=1, max_size=50))
@settings(deadline=None)
def test_leaves_keep_order_and_value(xs):
    x = np.sort(np.array(xs))
    at = Q.leaf(x)
    assert (np.diff(at) >= 0).all()
    assert np.allclose(Q.value(at), x, rtol=3e-4, atol=1e-37)


def test_extremes():
    x = np.array([0.0, -0.0, 1e300, -1e300, 3.4e38, 1e-45])
    back = Q.value(Q.leaf(x))
    assert back[0] == back[1] == 0 and np.isfinite(back).all() and back[2] > 3e38 and back[3] < -3e38


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "sorted"])
def test_error_stays_within_bound_whatever_the_merges(kind):
    rng = np.random.default_rng(0)
    n = 60_000
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n) * 1.0, "wide": np.exp(rng.normal(size=n) * 20), "sorted": np.sort(rng.random(n))}[kind]
    for parts in (1, 7, 60):
        k, c = np.empty(0, np.int64), np.empty(0, np.int64)
        for piece in np.array_split(x, parts):  # a chain of merges
            a, b = Q.compress(*digest(piece))
            k, c = Q.compress(*Q.add(np.r_[k, a], np.r_[c, b]))
        assert c.sum() == n
        assert len(k) <= 3 * Q.K + 1
        assert rank_error(x, k, c) <= Q.ERROR


def test_small_digests_are_exact():
    x = np.array([3.0, 1.0, 2.0, 2.0])
    _, n, v = Q.percentiles(*Q.compress(*digest(x)), (25, 50, 75, 99))
    assert n[0] == 4 and v[0].tolist() == [1.0, 2.0, 2.0, 3.0]


def test_columns_with_every_kind_of_dirt(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(60):
        s = ["a", "b", None][k % 3] if k % 2 else "a"
        v = [float(x) for x in np.round(rng.normal(size=6), 3)]
        v[k % 6] = [float("nan"), float("inf"), None][k % 3]
        rows.append((s, k % 4, v, "x"))
        for d, x in enumerate(v):
            if x is not None and np.isfinite(x):
                want.setdefault((s, d % 3), []).append(x)
    rows += [("a", 1, None, ""), ("a", 1, [], ""), ("a", 1, [1.0], ""), ("c", 1, [float("nan")] * 3, "")]
    df = spark.createDataFrame(rows, "source string, day int, v array<double>, block string").withColumnRenamed("block", "nodes")
    for salted in (False, True):
        d = Q.digests(df, "v", 3, ["source", "day"] if salted else ["source"])
        total = Q.merged(d.drop("day") if salted else d, ["source"])
        got = {(r.source, r.dim): r for r in Q.read(total, ["source"]).collect()}
        assert got.keys() == want.keys()
        for key, xs in want.items():
            xs = np.sort(xs)
            assert got[key].n == len(xs) and got[key].p50 == pytest.approx(xs[int(np.ceil(len(xs) / 2)) - 1], abs=3e-4)
    assert Q.column_percentiles(df.limit(0), "v", 3, ["source"]).count() == 0


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 5 * Q.BLOCK, 4000) << Q._NODE | rng.integers(1, 1 << Q._NODE, 4000))
    counts = rng.integers(1, 1 << 46, len(keys))
    for block, nodes, n in Q._packed(keys, counts):
        batch = Q.pa.RecordBatch.from_arrays([nodes, n], ["nodes", "counts"])
        k, c = Q._nodes(batch, block)
        assert (k == keys).all() and (c == counts).all()
        part = [Q._nodes(some, block[:1] + at) for at, some in enumerate(batch.slice(i, 1) for i in range(len(batch)))]
        assert (np.concatenate([x[0] for x in part]) == keys).all()
    none = Q.pa.RecordBatch.from_arrays([Q.pa.array([], Q.pa.binary())] * 2, ["nodes", "counts"])
    assert len(Q._nodes(none, np.empty(0, np.int64))[0]) == 0


def test_tree_of_many_partitions_keeps_the_bound(spark, monkeypatch):
    monkeypatch.setattr(Q, "FAN", 3)
    rng = np.random.default_rng(3)
    rows = [(None if k % 5 else "a", [float(v) for v in rng.normal(size=600)], k) for k in range(200)]
    df = spark.createDataFrame(rows, "source string, v array<double>, part int").repartition(29)
    raw, parts = Q.partials(df, "v", 3, ["source"])
    assert parts == 29
    got = Q.read(Q.tree(raw, parts, ["source"]), ["source"])
    values = df.select("source", Q.F.posexplode("v").alias("i", "x")).select("source", (Q.F.col("i") % 3).alias("dim"), "x")
    for most in (1, 1000):
        worst = Q.rank_errors(values, got, ["source"], most=most).collect()
        assert sorted((str(r.source), r.dim, r.n) for r in worst) == sorted((s, d, n) for s, n in (("None", 32000), ("a", 8000)) for d in range(3))
        assert all(r.worst <= Q.ERROR for r in worst)
    wrong = got.withColumn("p50", Q.F.col("p50") + 1)
    assert all(r.worst > 0.2 for r in Q.rank_errors(values, wrong, ["source"]).collect())
