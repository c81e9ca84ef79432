"""Evaluation over one row per record, against the long tables; figures of size are in the README."""

import random

from pyspark.sql import functions as F

from fathomline.operators import evaluation as E
from fathomline.operators import results as R

COLLECTED = [("dns", "dns_record", None), ("http", "header", "p1"), ("http", "robots", None), ("http", "html", "p2"), ("browser", "dom", "p1"), (None, "html", "p1")]
EDGES = "revision string, kind string, name string, target string, rule_id string, confidence int, version string, category int"


def found(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{i % 9}", rng.choice(["a", "b", "c", "d", None]), rng.choice(["r1", "r2", "r3", None]), rng.choice([0, 0, 40, 70]), *rng.choice(COLLECTED), None) for i in range(150)]
    evidence = spark.createDataFrame(rows, "key string, technology string, rule_id string, confidence int, collector string, source string, page_id string, version string")
    revisions = spark.createDataFrame([(f"k{i}", [None, "x", "y"][i % 3]) for i in range(8)] + [("empty", "x")], "key string, revision string")
    edges = spark.createDataFrame([("x", "requires", "a", "q", None, None, None, None), ("x", "implies", "b", "q", "i", 50, None, None), ("y", "requires", "c", "d", None, None, None, None)], EDGES)
    return evidence, revisions, edges


def test_scores_need_no_row_per_name(spark):
    """the tokens of a domain stay with it; predictions hold no row per domain and recurring name."""
    rng = random.Random(1)
    views = [(f"d{i}", "full", f"n{j}") for i in range(20) for j in range(6) if rng.random() < 0.5]
    folds = spark.createDataFrame([(f"d{i}", i % 5) for i in range(20)], "key string, fold int")
    tokens = spark.createDataFrame([(f"d{i}", f"t{i % 3}") for i in range(20)], "key string, token string")
    model = E.train(tokens, spark.createDataFrame(views, "key string, view string, name string"), folds)
    first, own = E.predict(model, tokens, folds)
    assert own.count() == 20 and "name" not in own.columns
    got = {r.key: r.expected for r in E.scores(model, (first, own)).collect()}
    parts = {r.key: r.s for r in E.name_parts(model, own).groupBy("key").agg(F.sum("part").alias("s")).collect()}
    means = {r.fold: r.m for r in E.wanted_heads(model).groupBy("fold").agg(F.sum("mean").alias("m")).collect()}
    for r in first.collect():
        assert abs(got[r.key] - (means[r.fold] * (1 + 4 * r.weight) + parts[r.key]) / (1 + r.matched)) < 1e-9


def test_packed_views_are_the_detector_views(spark):
    for seed in (1, 2):
        evidence, revisions, edges = found(spark, seed)
        known = evidence.join(revisions, "key", "left_semi")
        want = {(r.key, r.view, r.technology) for r in E.detector_views(known, revisions, edges, ["key"]).where("type = 'direct'").collect()}
        packed = E.packed_views(evidence, revisions, edges, slice_rows=2)
        assert {tuple(r) for r in E.long_views(packed).collect()} == want
        stats = {(r.key, r.view): (r.raw_direct, r.gated_direct, r.suppressed_direct, r.retained_direct) for r in E.detector_views(known, revisions, edges, ["key"]).collect()}
        assert {(r.key, v): tuple(r[f"{v}_stats"]) for r in packed.collect() for v in E.VIEWS if r[f"{v}_stats"] is not None} == stats


def test_latest_without_moving_what_came_once(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, 1, "d"), (None, 1, "e"), (None, 2, None), (3, None, "f")]
    df = spark.createDataFrame(rows, "id long, ingested_at int, v string")
    assert sorted(map(repr, R.latest_in_place(df, ["id"]).collect())) == sorted(map(repr, R.latest(df, ["id"]).collect()))


def test_gates_are_met_once_for_a_record(monkeypatch):
    """the gate of a record is not worked out again for each of its detections."""
    from fathomline.operators import graph

    calls = []
    real = graph.admit
    monkeypatch.setattr(graph, "admit", lambda *x: calls.append(1) or real(*x))
    assert graph.resolve({"a": 1, "b": 2, "c": 3}, graph.Relations())[1] == (3, 0, 0, 3) and len(calls) == 1


def test_evidence_of_contents_is_that_of_candidates(spark):
    """contents are matched once; the pieces of each record, page and collector stay the same."""
    from fathomline.operators import detection as D
    from fathomline.operators import matching as M

    raw = spark.createDataFrame([(f"r{i}", "n", "T", s, None, p, p, "regex", 100, None, None) for i, (s, p) in enumerate([("html", "alpha"), ("html", "a"), ("header", "beta")])], "rule_id string, namespace string, technology string, source string, locator string, original string, pattern string, match_mode string, confidence int, version_template string, locator_pattern string")
    rows = [("d1", "http", "value", "html", "p1", None, "alpha 1"), ("d1", "http", "value", "html", "p1", None, "alpha 2"), ("d1", "http", "value", "html", "p1", None, "alpha 2"), ("d2", None, "value", "html", None, None, "alpha 1"), ("d2", "http", "value", "header", "p1", "k", "beta"), ("d2", "http", "presence", "header", "p1", "k", "")]
    cands = spark.createDataFrame(rows, "domain string, collector string, kind string, source string, page_id string, key string, value string")
    rules = M.prepare_rules(raw)
    want = D.build_evidence(M.match_rules(cands.distinct(), rules), ["domain"])
    pieces, contents = D.content_evidence(cands, rules, ["domain"])
    got = pieces.join(contents, "_piece").select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_greedy_choice_never_widens_its_pool(spark, monkeypatch):
    """where names get covered, the next round weighs all domains anew; no round spreads more than its pool over names."""
    rng = random.Random(7)
    folds = spark.createDataFrame([(f"d{i:02d}", i % 2) for i in range(40)], "key string, fold int")
    views = spark.createDataFrame([(f"d{i:02d}", "full", f"n{j}") for i in range(40) for j in range(6) if rng.random() < 0.5], "key string, view string, name string")
    tokens = spark.createDataFrame([(f"d{i:02d}", f"t{i % 5}") for i in range(40)], "key string, token string")
    model = E.train(tokens, views, folds)
    predictions, quotas = E.predict(model, tokens, folds), spark.createDataFrame([(0, 6), (1, 6)], "fold int, trigger int")
    choice = lambda pool: [(r.fold, r.place, r.key, round(r.score, 8)) for r in E.greedy_selection(model, predictions, quotas, "tie", pool=pool).orderBy("fold", "place").collect()]
    want, seen, real = choice(500), [], E.name_parts
    monkeypatch.setattr(E, "name_parts", lambda model, own, key="key": seen.append(max(r["count"] for r in own.groupBy("fold").count().collect())) or real(model, own, key))
    assert choice(2) == want and len(want) == 12
    assert len(seen) > 1 and max(seen) <= 3


def test_many_revisions_are_not_cut_for_cores(spark):
    """the relations of a revision are copied to as many slices as its rows need where there are many revisions."""
    from fathomline.operators import graph

    many = spark.createDataFrame([(f"r{i}",) for i in range(100)] + [("r0",)] * 20, "revision string")
    got = {r.revision: r._slices for r in graph.slices(many, 10).collect()}
    assert got.pop("r0") == 3 and set(got.values()) == {1}
    assert graph.slices(many.where("revision = 'r1'"), 10).first()._slices == graph.LEAST_SLICES


def test_detections_without_evidence(spark):
    """contents are matched once and move as numbers; costs, budget and the bound of matches stay those of the whole detection."""
    from fathomline.functions.text import present
    from fathomline.operators import detection as D
    from fathomline.operators import matching as M

    raw = spark.createDataFrame([(f"r{i}", "n", t, s, None, p, p, "regex", c, None, None) for i, (t, s, p, c) in enumerate([("T", "html", "alpha", 60), ("T", "html", "a", 70), ("U", "header", "beta", 0), ("V", "html", "2", 30), (" ", "html", "1", 30)])], "rule_id string, namespace string, technology string, source string, locator string, original string, pattern string, match_mode string, confidence int, version_template string, locator_pattern string")
    cands = spark.createDataFrame([(f"d{i % 3}", "http", "value", s, "p1", k, v) for i, (s, k, v) in enumerate([("html", None, "alpha 1"), ("html", None, "alpha 2"), ("html", None, "none 2"), ("html", None, "a 1"), ("header", "k", "beta"), ("html", None, "a"), ("html", None, "alpha 1")])], "domain string, collector string, kind string, source string, page_id string, key string, value string")
    rules = M.prepare_rules(raw)
    revisions, edges = spark.createDataFrame([], "domain string, revision string"), spark.createDataFrame([], EDGES)
    rows = lambda df: sorted(tuple(r) for r in df.select("domain", "technology", "confidence").collect())
    flat = lambda df: df.select("domain", F.explode(F.arrays_zip("technology", "confidence")).alias("d")).select("domain", "d.technology", "d.confidence")
    for budget in (100, 5):
        assert rows(flat(D.detected(cands, rules, ["domain"], budget))) == rows(D.detect(cands, rules, revisions, edges, ["domain"], budget)[1])
    first = D.direct_detections(D.build_evidence(M.dedupe_matches(M.match_rules(D.number_candidates(cands, ["domain"]), rules), ["domain"], 2), ["domain"]).withColumn("technology", present(F.col("technology"))), ["domain"])
    assert rows(flat(D.detected(cands, rules, ["domain"], 100, 2))) == rows(first)


def test_names_are_spelled_once(spark):
    """F8: the form of technologies and rule ids is worked out for their distinct spellings, whatever rows of other deliveries hold."""
    from fathomline.functions.text import present

    for seed in (1, 2):
        evidence, revisions, edges = found(spark, seed)
        dirty = evidence.withColumns({c: F.when(F.xxhash64("key", c) % 3 == 0, F.concat(F.lit(" "), F.upper(c))).otherwise(F.col(c)) for c in ("technology", "rule_id")})
        clean = dirty.withColumns({c: present(F.col(c)) for c in ("technology", "rule_id")})
        more = dirty.unionByName(dirty.limit(1).withColumns({"technology": F.lit("elsewhere"), "rule_id": F.lit(" ")}))
        more = more.unionByName(dirty.limit(1).withColumns({"technology": F.lit("elsewhere"), "rule_id": F.lit("r")}))
        views = lambda df, **x: sorted(map(repr, E.packed_views(df, revisions, edges, slice_rows=2, **x).collect()))
        assert views(dirty, spelling=present, deliveries=more) == views(clean) != views(dirty)


def test_direct_names_without_implied_ones(monkeypatch):
    """F8: where nothing is excluded, the direct technologies and counts come without working out what is implied."""
    from fathomline.operators import graph

    own = {"a": 10, "b": 5, "c": 7}
    plain = [{"kind": "implies", "name": "a", "target": "d", "rule_id": None, "confidence": 50, "version": None, "category": None}, {"kind": "requires", "name": "b", "target": "x", "rule_id": None, "confidence": None, "version": None, "category": None}]
    less = [*plain, {"kind": "excludes", "name": "a", "target": "c", "rule_id": None, "confidence": None, "version": None, "category": None}]
    for edges in (plain, less):
        rows, counts = graph.resolve(own, graph.relations_of(edges))
        assert graph.direct_names(own, graph.relations_of(edges)) == ([n for n, kind, *_ in rows if kind == "direct"], counts)
    monkeypatch.setattr(graph, "imply", None)
    assert graph.direct_names(own, graph.relations_of(plain)) == (["a", "c"], (3, 1, 0, 2))


def test_sums_of_tokens_are_worked_out_once(spark):
    """F8: the sums of each fold are written; the tokens of a case are not spread anew for the total and for the fold that is left out."""
    cases = spark.createDataFrame([(f"d{i}", i % 2, [f"t{j}" for j in range(8)], ["n"], ["n", f"m{i % 3}"]) for i in range(12)], "key string, fold int, tokens array<string>, t2 array<string>, full array<string>")
    model = E.train_cases(cases)
    tokens = E.train_tokens(cases, model.heads, model.held)
    assert tokens._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(tokens") <= 1
    assert {(r.held_out, r.token): (r.n, r.pair_sum) for r in tokens.collect()} == {(h, f"t{j}"): (6, 6) for h in (0, 1) for j in range(8)}


def test_json_text_of_names(spark):
    """F8: the text of a name without a pattern."""
    names = ["a", 'q"[x]\\y', "é€😀", "", "[", "]", "a\nb", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = F.regexp_extract(F.to_json(F.array("name")), r"(?s)\A\[(.*)\]\z", 1)
    assert all(r[0] == r[1] for r in df.select(E._quoted(F.col("name")), want).collect())
