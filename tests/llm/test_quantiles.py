import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm import quantiles
from fathomline.llm.quantiles import UNIVERSE_BITS, build_digests, compress, leaf_bounds, leaf_of, merge_digests, quantile_leaves, read_quantiles


@given(st.lists(st.integers(-(2**61), 2**61), min_size=1, max_size=50))
def test_leaves_keep_the_order_and_hold_their_values(values):
    v = np.sort(np.array(values, dtype=np.int64))
    leaves = leaf_of(v)
    low, high = leaf_bounds(leaves)
    assert (np.diff(leaves) >= 0).all() and (low <= v).all() and (v <= high).all()
    assert ((leaves >= 0) & (leaves < 1 << UNIVERSE_BITS)).all()
    small = np.abs(v) < 1 << 21
    assert (low[small] == v[small]).all() and (high[small] == v[small]).all()


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=600), st.sampled_from([8, 64, 512]), st.integers(1, 5))
def test_digest_of_parts_holds_the_true_rank(values, k, parts):
    v = np.array(values, dtype=np.int64)
    pieces = [compress(np.zeros(len(p), np.int64), leaf_of(p) + (1 << UNIVERSE_BITS), np.ones(len(p), np.int64), k) for p in np.array_split(v, parts)]
    _, node, count = compress(*(np.concatenate(a) for a in zip(*pieces)), k)
    assert count.sum() == len(v) and len(node) <= 4 * k * UNIVERSE_BITS
    ordered = np.sort(v)
    for p in (1, 50, 95, 100):
        rank = max(1, -(-p * len(v) // 100))
        ((low, high),) = quantile_leaves(node, count, [rank])
        true = ordered[rank - 1]
        assert leaf_bounds(np.array([low]))[0][0] <= true <= leaf_bounds(np.array([high]))[1][0]
        # The answer's rank is off by no more than the guarantee (per part and merge: twice the bound).
        answer = leaf_bounds(np.array([high]))[1][0]
        assert (ordered <= answer).sum() >= rank and (ordered < leaf_bounds(np.array([low]))[0][0]).sum() <= rank
        assert abs(int((ordered <= answer).sum()) - rank) <= 2 * UNIVERSE_BITS * len(v) / k + np.count_nonzero(ordered == answer) + np.count_nonzero(ordered == true)


def test_percentiles_by_group_equal_the_exact_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 3}", int(x), i % 4) for i, x in enumerate(rng.lognormal(8, 2, 3000))] + [("one", 7, 0), ("ties", 5, 1), ("ties", 5, 2), (None, 3, 1), ("g0", None, 1)]
    df = spark.createDataFrame(rows, "g string, v long, day int").repartition(5)
    daily = merge_digests(build_digests(df, ["g", "day"], "v"), ["g", "day"])
    got = {r.g: r for r in read_quantiles(merge_digests(daily.drop("day"), ["g"]), [50, 95]).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for name, v, _ in rows if name == g and v is not None)
        assert got[g].n == len(values) and math.isclose(got[g].average, sum(values) / len(values))
        for p in (50, 95):
            true = values[-(-p * len(values) // 100) - 1]
            assert got[g][f"p{p}_lo"] <= true <= got[g][f"p{p}_hi"]
            if true < 1 << 21:
                assert got[g][f"p{p}_lo"] == got[g][f"p{p}_hi"] == true


def test_small_k_and_levels_of_merging_keep_the_bound(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("v"), F.lit("a").alias("g")).repartition(8)
    r = read_quantiles(merge_digests(build_digests(df, ["g"], "v", k=200), ["g"], k=200, parts=70000), [50]).first()
    assert r.n == 20000 and r.p50_lo <= 9999 <= r.p50_hi and r.p50_hi - r.p50_lo <= 2 * UNIVERSE_BITS * 20000 / 200


def test_many_digests_merge_in_levels_and_without_keys(spark, monkeypatch):
    """More digests than one merge takes, of one group and of all rows; the number comes from the digests themselves."""
    monkeypatch.setattr(quantiles, "FAN_IN", 3)
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("v"), (F.col("id") % 2).alias("g")).repartition(20)
    for keys, n, middle in ((["g"], 2000, (1999, 1998)), ([], 4000, (1999,))):
        merged = merge_digests(build_digests(df, keys, "v", k=400), keys, k=400)
        rows = read_quantiles(merged, [50]).collect()
        assert len(rows) == max(1, 2 * len(keys)) and all(r.n == n for r in rows)
        assert all(r.p50_lo <= m <= r.p50_hi for r, m in zip(sorted(rows, key=lambda r: -r.g if keys else 0), middle))
    plan = merge_digests(build_digests(df, [], "v"), [])._jdf.queryExecution().toString()
    assert "Coalesce 1" not in plan


def test_fractions_nan_infinite_and_empty(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("a", float("nan")), ("a", float("inf")), ("a", None), ("b", -2.5)], "g string, v double")
    got = {r.g: r for r in read_quantiles(merge_digests(build_digests(df, ["g"], "v", unit=0.5), ["g"]), [50], unit=0.5).collect()}
    assert got["a"].n == 3 and got["a"].p50_lo == 1.5 and got["b"].p50_lo == -2.5
    assert read_quantiles(merge_digests(build_digests(df.limit(0), ["g"], "v"), ["g"]), [50]).count() == 0
