"""The evaluation of cheaper collection against plain recomputation on small random cohorts."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.operators import evaluation as E

SALTS = {"tie": "tie", "control": "control", "random": "random", "label": "label"}


def salted(salt, key):
    return hashlib.sha256(f"{salt}\0{key}".encode()).hexdigest()


def cohort(seed, n=60):
    rng = random.Random(seed)
    full, cheap, tokens = {}, {}, {}
    for i in range(n):
        key = f"d{i:02d}"
        full[key] = {f"n{rng.randrange(12)}" for _ in range(rng.randrange(6))} | ({f"rare{i}"} if rng.random() < 0.2 else set()) | ({f"often{rng.randrange(4)}"} if rng.random() < 0.5 else set())
        cheap[key] = {x for x in full[key] if not x.startswith(("rare", "often")) and rng.random() < 0.6} | ({f"n{rng.randrange(14)}"} if rng.random() < 0.1 else set())
        tokens[key] = {f"t{rng.randrange(8)}" for _ in range(rng.randrange(1, 5))}
    return full, cheap, tokens, {k: int(salted("f", k)[:8], 16) % 5 for k in full}


def tables(spark, full, cheap, tokens, folds):
    views = spark.createDataFrame([(k, "full", n) for k, v in full.items() for n in v] + [(k, "t2", n) for k, v in cheap.items() for n in v], "key string, view string, name string")
    return spark.createDataFrame([(k, t) for k, v in tokens.items() for t in v], "key string, token string"), views, spark.createDataFrame(list(folds.items()), "key string, fold int")


def plain_model(full, cheap, tokens, training):
    known = {n for k in training for n in cheap[k]}
    support = defaultdict(int)
    for k in training:
        for n in full[k] - known:
            support[n] += 1
    sums = defaultdict(lambda: [0, 0, 0, defaultdict(int)])
    pair = {k: len(full[k] - cheap[k]) for k in training}
    rare = {k: sum(1 for n in full[k] - known if support[n] == 1) for k in training}
    for k in training:
        for t in tokens[k]:
            s = sums[t]
            s[0] += 1
            s[1] += pair[k]
            s[2] += rare[k]
            for n in full[k] - known:
                if support[n] > 1:
                    s[3][n] += 1
    pairs, kept = sum(len(full[k]) for k in training), sum(len(full[k] & cheap[k]) for k in training)
    names = {n for k in training for n in full[k]}
    deficits = max(1, -(-pairs * 80 // 100) - kept), max(1, -(-len(names) * 95 // 100) - len(names & known))
    return sums, {n: s for n, s in support.items() if s > 1}, sum(pair.values()) / len(training), sum(rare.values()) / len(training), deficits, len(training)


def plain_prediction(model, own):
    sums, heads, pair_mean, rare_mean, _, size = model
    met = [sums[t] for t in own if t in sums]
    smooth = lambda k, mean: (mean + sum((s[k] + 4 * mean) / (s[0] + 4) for s in met)) / (1 + len(met))
    chance = {n: min(1, max(0, (c / size + sum((s[3].get(n, 0) + 4 * c / size) / (s[0] + 4) for s in met)) / (1 + len(met)))) for n, c in heads.items()}
    return smooth(1, pair_mean), smooth(2, rare_mean), chance


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_and_greedy_choice(spark, seed):
    full, cheap, tokens, folds = cohort(seed)
    t, v, f = tables(spark, full, cheap, tokens, folds)
    everywhere = {n for x in cheap.values() for n in x}
    model = E.train(t, v, f)
    predictions = E.predict(model, t, f)
    got = {r.key: r for r in E.scores(model, predictions).collect()}
    plain = {}
    for fold in range(5):
        m = plain_model(full, cheap, tokens, [k for k in full if folds[k] != fold])
        for k in (k for k in full if folds[k] == fold):
            pair, rare, chance = plain_prediction(m, tokens[k])
            chance = {n: p for n, p in chance.items() if n not in everywhere}
            plain[k] = (pair / m[4][0], rare, chance, m[4][1])
            want = pair / m[4][0] + (rare + sum(chance.values())) / m[4][1]
            assert abs(got[k].score - want) < 1e-9 and abs(got[k].expected - sum(chance.values())) < 1e-9 and abs(got[k].pair_lift - pair) < 1e-9
    quotas = E.fold_quotas(f.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), 20, 2)
    seats = {r.fold: r.trigger for r in quotas.collect()}
    assert sum(seats.values()) == 18
    want = []
    for fold, n in seats.items():
        covered, left = defaultdict(float), [k for k in full if folds[k] == fold]
        for place in range(1, n + 1):
            worth = {k: round(plain[k][0] + (plain[k][1] + sum(p * (1 - covered[x]) for x, p in plain[k][2].items())) / plain[k][3], 9) for k in left}
            best = min(left, key=lambda k: (-worth[k], salted("tie", k)))
            want.append((fold, best, place))
            left.remove(best)
            for x, p in plain[best][2].items():
                covered[x] = 1 - (1 - covered[x]) * (1 - p)
    for pool in (2, 500):  # the smallest pool has to grow until its choice is proven
        assert sorted((r.fold, r.key, r.place) for r in E.greedy_selection(model, predictions, quotas, "tie", pool=pool).collect()) == sorted(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_label_aware_choice(spark, seed):
    full, cheap, tokens, folds = cohort(seed)
    real = {n for x in full.values() for n in x}
    shown = defaultdict(int)
    for x in cheap.values():
        for n in x & real:
            shown[n] += 1
    left, want = set(full), []
    for place in range(1, 13):
        lift = lambda k: len(full[k] - cheap[k])
        gain = lambda k: sum(1 for n in full[k] - cheap[k] if not shown[n]) - sum(1 for n in (cheap[k] & real) - full[k] if shown[n] == 1)
        best = min(left, key=lambda k: (-lift(k), -gain(k), salted("label", k)))
        want.append((place, best, lift(best), gain(best)))
        left.remove(best)
        for n in cheap[best] & real:
            shown[n] -= 1
        for n in full[best]:
            shown[n] += 1
    _, v, _ = tables(spark, full, cheap, tokens, folds)
    for pool in (1, 500):
        assert [(r.place, r.key, r.pair_lift, r.name_lift) for r in E.label_aware_selection(v, 12, "label", pool=pool).orderBy("place").collect()] == want


def test_metrics_of_selections(spark):
    full, cheap, tokens, folds = cohort(5)
    _, v, f = tables(spark, full, cheap, tokens, folds)
    arms = {"a": ["d01", "d02"], "b": sorted(full)[:30], "none": ["absent"]}
    selected = spark.createDataFrame([(a, k) for a, ks in arms.items() for k in ks], "arm string, key string")
    costs = spark.createDataFrame([(k, i) for i, k in enumerate(sorted(full))], "key string, ms long")
    got = {r.arm: r for r in E.verdict(E.selection_metrics(v, selected, costs, ["ms"]), ["ms"]).collect()}
    for arm, keys in arms.items():
        seen = {k: full[k] if k in keys else cheap[k] for k in full}
        names, shown = {n for x in full.values() for n in x}, {n for x in seen.values() for n in x}
        r = got[arm]
        assert (r.names, r.names_kept, r.pairs, r.pairs_kept) == (len(names), len(names & shown), sum(map(len, full.values())), sum(len(full[k] & seen[k]) for k in full))
        assert (r.extra_names, r.extra_pairs) == (len(shown - names), sum(len(seen[k] - full[k]) for k in full))
        assert abs(r.macro_domain - sum(len(full[k] & seen[k]) / len(full[k]) for k in full if full[k]) / sum(1 for k in full if full[k])) < 1e-9
        assert (r.ms_selected, r.ms_full) == (sum(i for i, k in enumerate(sorted(full)) if k in keys), sum(range(len(full))))
    assert not got["b"].accepted


def test_quotas_wins_and_decision(spark):
    sizes = spark.createDataFrame([(0, 40), (1, 41), (2, 39), (3, 40), (4, 40)], "fold int, n int")
    assert sum(r.quota for r in E.largest_remainder(sizes, "fold", "n", 38).collect()) == 38
    rows = [("l", 0, 5, 2), ("r", 0, 5, 3), ("l", 1, 5, 2), ("r", 1, 6, 1), ("l", 2, 5, 2), ("r", 2, 5, 2), ("l", 3, 1, 1), ("r", 3, 2, 2)]
    outcomes = spark.createDataFrame(rows, "arm string, fold int, pair_lift long, novel_names long")
    assert {r.fold: r.right_won for r in E.fold_wins(outcomes, "l", "r").collect()} == {0: True, 1: False, 2: False, 3: True}
    cases = [(True, True, 5, "left"), (False, True, 4, "right"), (False, True, 3, "none"), (False, False, 5, "none")]
    df = spark.createDataFrame([c[:3] for c in cases], "a boolean, b boolean, w int")
    assert [r[0] for r in df.select(E.decide(F.col("a"), F.col("b"), F.col("w"))).collect()] == [c[3] for c in cases]


def test_tiers(spark):
    rows = [("http", "header", "p1", 1), ("http", "header", None, 1), ("dns", "dns_record", None, 1), ("tls", "tls_issuer", None, 1), ("http", "probe", None, 2), ("http", "robots", None, 2), ("http", "html", "p2", 2), ("http", "html", "p3", 3), ("browser", "dom", "p1", 3), (None, "html", "p1", 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, s string, p string, want int").orderBy("i")
    assert [r[0] for r in df.select(E.tier(F.col("c"), F.col("s"), F.col("p"))).collect()] == [r[3] for r in rows]


def test_tokens(spark):
    names = spark.createDataFrame([("a", "t1", "x"), ("a", "t2", "x"), ("a", "t2", 'y"z'), ("a", "full", "w"), ("b", "t2", "x")], "key string, view string, name string")
    states = spark.createDataFrame([("a", "t1", "available", None, 1), ("a", "t2", "available", None, 2), ("b", "t1", "unavailable", "failed", None), ("b", "t2", "unavailable", "failed", None)], "key string, view string, state string, reason string, raw_direct int")
    errors = spark.createDataFrame([("a", "t2", "http", "E", True, 3)], "key string, view string, stage string, code string, retryable boolean, n long")
    features = spark.createDataFrame([("a", 5, None), ("b", 0, "q")], "key string, size int, word string")
    got = defaultdict(set)
    for r in E.feature_tokens(names, states, errors, features, ["size"], ["word"]).collect():
        got[r.key].add(r.token)
    assert got["a"] == {
        "t1.state=available", "t2.state=available", 't1.direct="x"', 't2.direct="x"', 't2.direct="y\\"z"', "t1.direct.count=1", "t2.direct.count=2-3", "t1.detection.raw_direct=1", "t2.detection.raw_direct=2-3",
        "t2.error=http:E:true", "t2.error.count=http:E:true:2-3", 't2.incrementalDirect="y\\"z"', "t2.incrementalDirect.count=1", "preBrowser.size=4-7", "preBrowser.word=null",
    }
    assert got["b"] == {"t1.state=unavailable", "t1.reason=failed", "t2.state=unavailable", "t2.reason=failed", "preBrowser.size=0", "preBrowser.word=q"}


def test_empty_cohort(spark):
    t, v, f = tables(spark, {}, {}, {}, {})
    assert E.select_triggered(t, v, f, SALTS).count() == 0 and E.label_aware_selection(v, 40, "label").count() == 0
    assert E.selection_metrics(v, spark.createDataFrame([], "arm string, key string"), spark.createDataFrame([], "key string, ms long"), ["ms"]).count() == 0


def written_rows(spark, after):
    """The rows that each stage after that number wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() > after}


def test_names_that_a_pool_meets_never_move_as_rows(spark, monkeypatch):
    """with more names than are broadcast, every domain of the pool meets every name by each of its tokens."""
    n, names, words = 40, 60, 8
    full = {f"d{i:02d}": {f"often{x}" for x in range(names)} for i in range(n)}
    tokens = {k: {f"t{x}" for x in range(words)} for k in full}
    folds = {k: i % 2 for i, k in enumerate(full)}
    t, v, f = tables(spark, full, {k: set() for k in full}, tokens, folds)
    model = E.train(t, v, f)
    predictions = E.predict(model, t, f)
    assert model.parts.count() == 2 * names * words
    quotas = spark.createDataFrame([(0, 3), (1, 3)], "fold int, trigger int")
    monkeypatch.setattr(E, "MOST_NAMES", 0)
    before = max(written_rows(spark, -1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = E.greedy_selection(model, predictions, quotas, "tie").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(chosen) == 6 and {r.key for r in chosen if r.fold == 0} == set(sorted((k for k in full if folds[k] == 0), key=lambda k: salted("tie", k))[:3])
    assert max(written_rows(spark, before).values()) < n * names
    assert E.name_parts(model, predictions[1]).count() == n
