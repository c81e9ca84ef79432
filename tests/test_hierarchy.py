import pytest

from fathomline.operators.hierarchy import build_hierarchy

SCHEMA = "revision string, name string, target string, loaded_at int, node string, depth string"


def build(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return build_hierarchy(df, "name", "target", {"revision": "revision"}, newest="loaded_at")


def as_dict(h):
    return {(r.revision, r.node): (r.parent, r.root, r.depth, r.path) for r in h.nodes.collect()}


def test_chain_branches_and_scopes(spark):
    h = build(spark, [("1", "b", "a", 1), ("1", "c", "b", 1), ("1", "d", "b", 1), ("2", "b", "c", 1), ("1", "c", "b", 1)])
    assert as_dict(h) == {
        ("1", "a"): (None, "a", 0, ["a"]),
        ("1", "b"): ("a", "a", 1, ["a", "b"]),
        ("1", "c"): ("b", "a", 2, ["a", "b", "c"]),
        ("1", "d"): ("b", "a", 2, ["a", "b", "d"]),
        ("2", "c"): (None, "c", 0, ["c"]),
        ("2", "b"): ("c", "c", 1, ["c", "b"]),
    }
    pairs = {(r.revision, r.ancestor, r.descendant, r.distance) for r in h.descendants().collect()}
    assert pairs == {("1", "a", "b", 1), ("1", "a", "c", 2), ("1", "a", "d", 2), ("1", "b", "c", 1), ("1", "b", "d", 1), ("2", "c", "b", 1)}


def test_circles_and_nodes_below_them(spark):
    h = build(spark, [("1", "a", "b", 1), ("1", "b", "a", 1), ("1", "c", "b", 1), ("1", "d", "c", 1), ("1", "s", "s", 1), ("1", "x", "y", 1)])
    nodes = as_dict(h)
    assert {k[1] for k, v in nodes.items() if v[2] == -1} == {"a", "b", "c", "d", "s"}
    assert all(v[1] == "" and v[3] is None for v in nodes.values() if v[2] == -1)
    assert {r.node: r.on_circle for r in h.circular().collect()} == {"a": True, "b": True, "s": True, "c": False, "d": False}


def test_nulls_blanks_ties_and_null_scope(spark):
    h = build(spark, [(None, "b", "a", 1), ("1", "b", None, 9), ("1", "c", "", 1), ("1", None, "a", 1), ("1", "k", "old", 1), ("1", "k", "new", 2), ("1", "t", "p", 1), ("1", "t", "q", 1)])
    nodes = as_dict(h)
    assert nodes[(None, "b")][0] == "a" and ("1", "b") not in nodes and ("1", "c") not in nodes
    assert nodes[("1", "k")][0] == "new" and nodes[("1", "t")][0] == "q"


def test_empty(spark):
    h = build(spark, [])
    assert h.nodes.count() == 0 and h.descendants().count() == 0 and h.circular().count() == 0


def test_deep_chain_and_wide_parent(spark):
    rows = [("1", f"n{i:03d}", f"n{i - 1:03d}", 1) for i in range(1, 25)] + [("1", f"w{i}", "n000", 1) for i in range(300)]
    nodes = as_dict(build(spark, rows))
    assert nodes[("1", "n024")][2] == 24 and sum(v[2] == 1 for v in nodes.values()) == 301


def test_second_parents_are_an_explicit_choice(spark):
    links = spark.createDataFrame([("b", "a", 1), ("b", "c", 2), ("b", "c", 3), ("d", "c", 1)], "node string, parent string, t int")
    h = build_hierarchy(links, "node", "parent", newest="t")
    assert [(r.node, r.parent) for r in h.dropped.collect()] == [("b", "a")]
    with pytest.raises(ValueError, match="1 links"):
        build_hierarchy(links, "node", "parent", newest="t", several="error")
    assert build_hierarchy(links.where("parent = 'c'"), "node", "parent", several="error").dropped.count() == 0
    bare = build_hierarchy(links, "node", "parent", newest="t", paths=False)
    assert {(r.node, r.root, r.depth, r.path) for r in bare.nodes.collect()} == {("c", "c", 0, None), ("b", "c", 1, None), ("d", "c", 1, None)}
    with pytest.raises(ValueError, match="paths"):
        bare.descendants()
