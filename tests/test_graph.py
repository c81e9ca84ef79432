"""Relation graphs against a plain recomputation and against cases worked out by hand."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.operators.graph import EDGE_SCHEMA, Relations, admit, components, exclude, imply, resolve, resolve_technologies


def relations(implies=(), requires=(), excludes=(), categories=(), needs=()):
    r = Relations()
    for a, b, c, *v in implies:
        r.implies[a].append((b, f"{a}>{b}", c, v[0] if v else None))
    for a, b in requires:
        r.requires[a].add(b)
    for a, b in excludes:
        r.excludes[a].add(b)
    for a, k in categories:
        r.categories[a].add(k)
    for a, k in needs:
        r.requires_category[a].add(k)
    return r


def test_gates():
    r = relations([("root", "implied", 80)], [("by name", "implied"), ("self", "self")], categories=[("by name", 2), ("own", 3)], needs=[("by category", 2), ("own", 3)])
    assert admit(dict.fromkeys(["root", "by name", "by category", "own", "self"], 100), r) == {"root", "by name", "by category"}


def test_widest_paths_and_ties():
    r = relations([("one", "m1", 70), ("two", "m2", 70), ("m1", "parent", 100, "1.0"), ("m2", "parent", 100, "2.0"), ("one", "strong", 90), ("short", "strong", 60), ("tie", "s", 70), ("short", "s", 100)])
    out = imply({"one": 80, "two": 80, "short": 60, "tie": 70}, r)
    assert out["strong"][:2] == (80, 1) and [p[0] for p in out["strong"][2]] == ["one"]
    assert out["s"][:2] == (70, 1) and [p[0] for p in out["s"][2]] == ["tie"]
    assert out["parent"][:2] == (70, 2) and [(p[0], p[3]) for p in out["parent"][2]] == [("m1", "1.0"), ("m2", "2.0")]


def test_exclusion_chain_and_circles():
    every = lambda *n: {x: (True, 100) for x in n}
    assert exclude(every("a", "b", "c"), {"a": {"b"}, "b": {"c"}})[0] == {"a", "c"}
    assert exclude(every("ext", "x", "y"), {"ext": {"x"}, "x": {"y"}, "y": {"x"}})[0] == {"ext", "y"}
    assert exclude({"d": (True, 1), "i": (False, 100)}, {"d": {"i"}, "i": {"d"}})[0] == {"d"}
    assert exclude({"a": (True, 50), "b": (True, 50)}, {"a": {"b"}, "b": {"a"}})[0] == {"a"}
    chain = [f"n{i:05d}" for i in range(20_000)]
    began = time.time()
    assert exclude(every(*chain), {a: {b} for a, b in zip(chain, chain[1:])})[0] == set(chain[::2])
    assert time.time() - began < 8


NAMES = "abcdefgh"
EDGES = st.lists(st.tuples(st.sampled_from(NAMES), st.sampled_from(NAMES)), max_size=14)


def plain_exclude(nodes, excludes):
    left, kept = set(nodes), set()
    while left:
        free = {n for n in left if not any(n in excludes.get(m, ()) for m in left)}
        if free:
            kept |= free
            left -= free | {t for n in free for t in excludes.get(n, ())}
            continue
        groups = components(left, {n: {t for t in excludes.get(n, ()) if t in left} for n in left})
        for g in groups:
            if any(t in g for n in left - set(g) for t in excludes.get(n, ())):
                continue
            winner = min(g, key=lambda n: (not nodes[n][0], -nodes[n][1], n))
            if len(g) == 1:
                kept.add(winner)
                left -= {winner} | set(excludes.get(winner, ()))
            else:
                left -= set(g) - {winner}
            break
    return kept


@settings(deadline=None, max_examples=300)
@given(st.dictionaries(st.sampled_from(NAMES), st.tuples(st.booleans(), st.integers(1, 3)), min_size=1), EDGES)
def test_exclusion_equals_plain_recomputation(nodes, edges):
    excludes = {}
    for a, b in edges:
        if a != b:
            excludes.setdefault(a, set()).add(b)
    kept, gone = exclude(nodes, excludes)
    assert kept == plain_exclude(nodes, excludes) and kept | gone == set(nodes) and not kept & gone


@settings(deadline=None, max_examples=300)
@given(st.dictionaries(st.sampled_from(NAMES), st.integers(1, 100), min_size=1, max_size=4), st.lists(st.tuples(st.sampled_from(NAMES), st.sampled_from(NAMES), st.integers(1, 100)), max_size=14))
def test_implication_equals_full_recomputation(direct, edges):
    r = relations([e for e in edges if e[0] != e[1]])
    labels = {}
    for _ in range(30):
        sources = {n: (c, 0) for n, c in direct.items()} | labels
        new = {}
        for a, targets in r.implies.items():
            if a in sources:
                for b, _, c, _ in targets:
                    if b not in direct:
                        label = (min(sources[a][0], c), sources[a][1] + 1)
                        if b not in new or (label[0], -label[1]) > (new[b][0], -new[b][1]):
                            new[b] = label
        if new == labels:
            break
        labels = new
    assert {n: x[:2] for n, x in imply(direct, r).items()} == labels


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.sampled_from(NAMES), st.integers(1, 100), min_size=1), EDGES, EDGES)
def test_counts_add_up_and_order_does_not_matter(direct, needs, excl):
    build = lambda n, e: relations([("a", "h", 50), ("h", "g", 60)], [x for x in n if x[0] != x[1]], [x for x in e if x[0] != x[1]])
    rows, (raw, gated, suppressed, retained) = resolve(direct, build(needs, excl))
    assert raw == gated + suppressed + retained == len(direct)
    items = list(direct.items())
    random.Random(1).shuffle(items)
    assert resolve(dict(items), build(needs[::-1], excl[::-1]))[0] == rows


def test_records_in_spark(spark):
    direct = spark.createDataFrame([("r1", "v1", "a", 80), ("r1", "v1", "b", 50), ("r1", "v1", "a", 60), ("r2", "v2", "a", 40), ("r3", None, "a", 40), ("r4", "v1", "gated", 9), ("r5", "v1", None, 9), ("r6", "v1", "z", 0)], "rec string, revision string, technology string, confidence int")
    edges = spark.createDataFrame([("v1", "implies", "a", "x", "r", 70, "2.0", None), ("v1", "excludes", "a", "b", None, None, None, None), ("v1", "requires", "gated", "q", None, None, None, None)], EDGE_SCHEMA)
    got = {(r.rec, r.technology): (r.type, r.confidence, r.inferred_version, r.raw_direct, r.gated_direct, r.suppressed_direct, r.retained_direct) for r in resolve_technologies(direct, edges, ["rec"]).collect()}
    assert got == {
        ("r1", "a"): ("direct", 80, None, 2, 0, 1, 1), ("r1", "x"): ("inferred", 70, "2.0", 2, 0, 1, 1), ("r2", "a"): ("direct", 40, None, 1, 0, 0, 1),
        ("r3", "a"): ("direct", 40, None, 1, 0, 0, 1), ("r4", None): (None, None, None, 1, 1, 0, 0),
    }
    assert resolve_technologies(direct.limit(0), edges, ["rec"]).count() == 0
