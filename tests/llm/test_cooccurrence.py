import itertools
import math
import random
from collections import Counter

import numpy as np

from fathomline.llm import cooccurrence, queries
from fathomline.llm.cooccurrence import item_pairs, pair_codes


def brute(rows, least):
    baskets, singles, pairs = {}, Counter(), Counter()
    for rec, t in rows:
        baskets.setdefault(rec, set()).update([t] if t is not None else [])
    for b in baskets.values():
        singles.update(b)
        pairs.update(itertools.combinations(sorted(b, key=str.encode), 2))
    n = len(baskets)
    return {(a, b): (c, singles[a], singles[b], n) for (a, b), c in pairs.items() if c >= least}


def test_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(60)}", rng.choice(["é", "z", "Z", "a", "b", "c", "d", None])) for _ in range(700)] + [("lonely", None), ("empty", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "rec string, t string, item string, n int").repartition(3)
    for least in (1, 20):
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in item_pairs(df, ["rec"], ["t"], min_records=least).collect()}
        assert got == brute(rows, least)


def test_large_baskets_are_cut(spark, monkeypatch):
    """Baskets above the limit, among them one with a third of all rows, give the pairs that small ones would."""
    monkeypatch.setattr(cooccurrence, "BASKET_ITEMS", 7)
    rng = random.Random(9)
    rows = [("hot", f"i{i}") for i in range(60)] + [("warm", f"i{i}") for i in range(0, 40, 2)] + [(f"r{rng.randrange(12)}", f"i{rng.randrange(30)}") for _ in range(150)] + [("hot", None), ("hot", "i3")]
    df = spark.createDataFrame(rows, "rec string, t string").repartition(4)
    for least in (1, 3):
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in item_pairs(df, ["rec"], ["t"], min_records=least).collect()}
        assert got == brute(rows, least)


def test_share_and_statistics(spark):
    rows = [(i, t) for i in range(100) for t in (["a", "b"] if i < 20 else ["c"] if i < 60 else [None])] + [(0, "b"), (99, "a")]
    df = spark.createDataFrame(rows, "rec int, t string")
    (r,) = item_pairs(df, ["rec"], ["t"], min_share=(1, 100)).collect()
    assert (r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n_records) == ("a", "b", 20, 21, 20, 100)
    assert math.isclose(r.lift, 20 * 100 / (21 * 20))
    k = np.array([[20, 1], [0, 79]], dtype=float)
    h = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    assert math.isclose(r.llr, 2 * (h(k) - h(k.sum(0)) - h(k.sum(1)) + h(k.sum().reshape(1))), rel_tol=1e-9)
    assert item_pairs(df, ["rec"], ["t"], min_share=(1, 2)).count() == 0


def test_blocks_and_flushes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK_PAIRS", 50)
    basket = np.arange(40, dtype=np.int64) * 3
    codes = np.concatenate(list(pair_codes([basket], 1000)))
    assert sorted(codes) == sorted(int(a) * 1000 + int(b) for a, b in itertools.combinations(basket, 2))


def test_empty(spark):
    df = spark.createDataFrame([], "rec string, t string")
    assert item_pairs(df, ["rec"], ["t"]).count() == 0


def test_registered_pairs_are_all_pairs(spark, tmp_path):
    rows = [("r", f"d{i}", "A" if i < 150 else "B", "x:1", i) for i in range(300)] + [("r", "d0", t, k, 300 + i) for i, (t, k) in enumerate([("rare", "x:2"), (" Rarer", "y:1"), (None, None)])]
    spark.createDataFrame(rows, "run_id string, domain string, technology string, rule_id string, evidence_id long").write.parquet(f"{tmp_path}/evidence.parquet")
    spark.createDataFrame([("x:1", "A"), ("x:2", "a"), ("y:1", "C")], "rule_id string, technology string").write.parquet(f"{tmp_path}/rules.parquet")
    got = {(r.field, r.item_a, r.item_b): r for r in queries.QUERIES["p4_pairs"](spark, str(tmp_path)).collect()}
    assert set(got) == {("technology", *p) for p in (("a", "rare"), ("a", "rarer"), ("rare", "rarer"))} | {("rule_id", *p) for p in (("x:1", "x:2"), ("x:1", "y:1"), ("x:2", "y:1"))}
    r = got["technology", "rare", "rarer"]
    assert (r.n_ab, r.n_a, r.n_b, r.n_records, r.lift, r.significance) == (1, 1, 1, 300, 300.0, 0.001)
    assert got["technology", "a", "rare"].significance is None
    assert queries.QUERIES["p4_found"](spark, str(tmp_path)).count() == 0
