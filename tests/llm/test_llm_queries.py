"""Queries that SQL cannot say, on the driver's small tables."""

import os

import pytest

from kinetrace.llm import queries, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def run(spark):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = queries.QUERIES[name](spark, DATA).collect()
        return kept[name]

    return get


def test_percentiles_rise_and_days_add_up(run):
    for name, key in (("p2_percentiles", ("field", "source", "dim")), ("p2_from_days", ("field", "source", "dim")), ("p2_days", ("field", "source", "day", "dim"))):
        rows = run(name)
        assert rows and len({tuple(r[k] for k in key) for r in rows}) == len(rows)
        assert all(r.p01 <= r.p05 <= r.p25 <= r.p50 <= r.p75 <= r.p95 <= r.p99 and r.n > 0 for r in rows)
    whole = {(r.field, r.source, r.dim): r for r in run("p2_percentiles")}
    joined = {(r.field, r.source, r.dim): r for r in run("p2_from_days")}
    assert whole.keys() == joined.keys() and all(r.n == joined[k].n for k, r in whole.items())
    assert all(r == joined[k] for k, r in whole.items() if r.n < 2000)  # exact below that many values
    n = {}
    for r in run("p2_days"):
        n[r.field, r.source, r.dim] = n.get((r.field, r.source, r.dim), 0) + r.n
    assert n == {k: r.n for k, r in whole.items()}
    assert {r.field for r in run("p2_days")} == {"features", "packed_clip_p01", "packed_clip_p99", "root_traj"}


def test_pieces_are_cut_within_the_limit(run):
    rows = run("p3_pieces")
    assert rows and all(0 < r.stop - r.start <= 300 and r.cut in ("event", "start", "valley", "limit", "end") for r in rows)
    assert all(r.sound for r in run("p3_sound"))


def test_pairs_links_and_report_agree(run):
    found = {(r.row_id_a, r.row_id_b) for r in run("p4_found")}
    assert all(a < b for a, b in found)
    links, report = run("p4_links"), run("p4_report")
    assert {r.row_id for r in links} <= {k for p in found for k in p}
    for kind in ("id", "caption", "motion"):
        assert sum(r.n_links for r in links if r.kind == kind) == sum(r.n_pairs for r in report if r.kind == kind)
    assert sum(r.n_rows for r in report if r.kind == "any") == len({r.row_id for r in links})
    assert {(r.row_id_a, r.row_id_b) for r in run("p4_ids")} <= found


def test_ids_and_containers_agree(run):
    size = {r.doc_id: len(r.ids) for r in run("p5_ids")}
    coder = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN)
    assert all(0 <= i < len(coder.ranks) for r in run("p5_ids") for i in r.ids)
    packed, fill = {}, {}
    for r in run("p6_pack"):
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert packed == size
    assert fill == {r.container: r.n_tokens for r in run("p6_fill")} and all(r.unused == 2048 - r.n_tokens >= 0 for r in run("p6_fill"))


def test_restored_texts(run, spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(DATA + "/documents.parquet").collect()}
    restored = run("p7_restored")
    assert {r.doc_id for r in run("p7_found")} == {r.doc_id for r in restored}
    for r in restored:
        assert 0 <= r.n_restored <= r.n_words > 0 and (r.restored is None) == (r.n_restored == 0)
        assert r.restored != texts[r.doc_id]
