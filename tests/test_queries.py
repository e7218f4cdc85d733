"""Every query of the driver contract, against its SQL in DuckDB where it has one."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(plain(float(v) if hasattr(v, "dtype") and v.dtype.kind == "f" else v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # whole numbers stay whole on both sides
        if want[c].dtype.kind in "iu" and got[c].dtype.kind == "f":
            got[c] = got[c].astype(want[c].dtype)
    assert rows(got) == rows(want)


def test_every_query_has_sql_or_a_test_of_its_own():
    rest = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not (n[0] == "p" and n[1].isdigit() and n[1] != "1")}
    assert rest == {"p1_found", "resample_polyphase", "pose_metrics"}


def test_p1_found_holds_what_is_impossible(spark):
    found = entry.queries()["p1_found"](spark, DATA).collect()
    assert found and len(set(found)) == len(found)
    impossible = {(r.field, r.rec_id, r.t) for r in entry.queries()["p1_impossible"](spark, DATA).collect()}
    assert impossible <= {(r.field, r.rec_id, r.t) for r in found}


def test_resample_polyphase_against_a_plain_filter(spark):
    """Every output is the sum of the taps over the inputs, the line through the ends taken out."""
    import numpy as np

    from kinetrace.catalog import RECORD_WIDTH
    from kinetrace.kernels.signal import lowpass

    got = {r.row_id: r.y for r in entry.queries()["resample_polyphase"](spark, DATA).collect()}
    rows = spark.read.parquet(DATA + "/umr_release.parquet").where(f"size(features) > 0 and size(features) % {RECORD_WIDTH} = 0").select("row_id", "fps", "features").collect()
    assert {r.row_id for r in rows} == set(got)
    for r in rows:
        x = np.array(r.features, np.float64).reshape(-1, RECORD_WIDTH)[:, 4]
        x = np.where(np.isfinite(x), x, 0.0)
        fps = round(r.fps) if r.fps and r.fps > 0 else 30
        if abs((r.fps or 30) - 50) < 1e-6 or len(x) < 2:
            assert np.allclose(got[r.row_id], x, atol=1e-4)
            continue
        g = math.gcd(50, fps)
        up, down, n = 50 // g, fps // g, len(x)
        line = x[0] + np.arange(n) * (x[-1] - x[0]) / (n - 1)
        wide = np.zeros(n * up)
        wide[::up] = x - line
        h = lowpass(up, down)
        whole = np.convolve(wide, h)[len(h) // 2 :]
        m = -(-n * up // down)
        want = np.array([whole[k * down] for k in range(m)]) + x[0] + np.arange(m) * down / up * (x[-1] - x[0]) / (n - 1)
        assert np.allclose(got[r.row_id], want, atol=2e-4)


def test_pose_metrics_against_their_definition(spark):
    import numpy as np

    from kinetrace.catalog import BODY22

    got = {r.row_id: r for r in entry.queries()["pose_metrics"](spark, DATA).collect()}
    rows = spark.read.parquet(DATA + "/umr_release.parquet").where("size(joints77_pos) > 0 and size(joints77_pos) % 231 = 0").select("row_id", "joints77_pos").collect()
    assert {r.row_id for r in rows} == set(got)
    for r in rows:
        g = np.nan_to_num(np.array([0.0 if v is None else v for v in r.joints77_pos], np.float64), posinf=0, neginf=0).reshape(-1, 77, 3)[:, BODY22]
        p = np.round(g * 20) / 20
        far = np.linalg.norm((p - p[:, :1]) - (g - g[:, :1]), axis=-1).mean() * 1000
        assert got[r.row_id].mpjpe == pytest.approx(far, abs=2e-3) and got[r.row_id].n_frames == len(g)
        assert got[r.row_id].pampjpe <= np.linalg.norm(p - g, axis=-1).mean() * 1000 * 1.5 + 1e-3


def test_entry(spark):
    assert entry.entry(spark).count() == 64
