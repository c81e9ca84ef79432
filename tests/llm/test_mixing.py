import numpy as np
import pytest

from fathomline.llm import mixing
from fathomline.llm.mixing import flight, landing, mix_sources


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(2)
    size = rng.integers(0, 5000, 4000).astype(float)
    p = np.full(4000, 0.37)
    out = flight(p, size, np.random.default_rng(9))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-4 and abs((out * size).sum() - (p * size).sum()) < 1e-2
    final = landing(out, size)
    assert set(np.unique(final)) <= {0.0, 1.0} and abs(final.sum() - p.sum()) <= 2


def test_flight_is_unbiased_and_handles_ties():
    size = np.array([5.0, 5, 5, 9, 1, 0, 0])
    draws = np.array([flight(np.full(7, 0.4), size, np.random.default_rng(i)) for i in range(4000)])
    assert np.abs(draws.mean(axis=0) - 0.4).max() < 0.04


@pytest.fixture
def sizes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "big", int(x)) for i, x in enumerate(rng.integers(1, 400, 3000))]
    rows += [(10_000 + i, "small", 100) for i in range(50)] + [(20_000, "tiny", 10), (20_001, None, 500), (20_002, "unknown", 500), (20_003, "big", 0), (20_003, "big", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


TARGETS = [("big", 0.5, 2), ("small", 0.02, 6), ("tiny", 0.4, 3), ("absent", 0.08, 5)]


def test_shares_and_caps(spark, sizes, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 200)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix, report = mix_sources(sizes, targets)
    by = {r.source: r for r in report.collect()}
    assert {s for s, r in by.items() if r.falls_short} == {"tiny", "absent"}
    assert by["tiny"].mixed_tokens == 30 and by["absent"].mixed_tokens == 0
    for s in ("big", "small"):
        assert abs(by[s].mixed_tokens - by[s].target_tokens) <= 400
    taken = {(r.doc_id, r.copies, r.source) for r in mix.collect()}
    repeats = {s: m for s, _, m in TARGETS}
    assert all(1 <= c <= repeats[s] for _, c, s in taken) and not {20_001, 20_002} & {d for d, _, _ in taken}
    assert sum(r.actual_share for r in by.values()) == pytest.approx(1)
    again, _ = mix_sources(sizes, targets)
    assert {(r.doc_id, r.copies, r.source) for r in again.collect()} == taken


def test_empty(spark, sizes):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mix, report = mix_sources(sizes.limit(0), targets)
    assert mix.count() == 0 and report.count() == 4
    mix, report = mix_sources(sizes, targets.limit(0))
    assert mix.count() == 0 and report.count() == 0
