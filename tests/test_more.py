import json

import pytest
from pyspark.sql import functions as F

from fathomline.operators import catalog as K
from fathomline.operators import evaluation as E
from fathomline.operators import robots as B
from fathomline.operators import extract as X
from fathomline.operators import results as V
from fathomline.operators.nested import flatten_json
from fathomline.plans.data_problems import CATALOG_SHAPE
from fathomline.session import read_table


def test_rules_of_raw_catalogs_against_brute_force(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "catalog_docs")
    flat = flatten_json(docs, "doc_no", "payload", CATALOG_SHAPE)
    got = {tuple(r) for r in K.rules_from_documents(flat, "n").drop("namespace").collect()}
    want = set()
    sources = {"headers": "header", "js": "javascript", "meta": "meta", "dom": "dom"}
    for d in docs.collect():
        try:
            value = json.loads(d.payload)
        except ValueError:
            continue
        value = value.get("technologies", value) if isinstance(value, dict) else value
        for name, tech in value.items() if isinstance(value, dict) else [(t["name"], t) for t in value]:
            for field, source in sources.items():
                fields = tech.get(field) or {}
                for locator, patterns in fields.items() if isinstance(fields, dict) else [(x["name"], x["value"]) for x in fields]:
                    for p in patterns if isinstance(patterns, list) else [patterns]:
                        if isinstance(p, dict):
                            want |= {(d.doc_no, name, source, f"{locator} {fact}" + (f".{inner}" if inner else ""), text) for fact, x in p.items() for inner, text in (x.items() if isinstance(x, dict) else [("", x)])}
                        elif p is not None:
                            want.add((d.doc_no, name, source, locator, p))
    assert got == want and len(want) > 50


def test_catalog_limits(spark):
    rules = spark.createDataFrame([("t", "x" * 10), ("u", "y")], "technology string, original string")
    assert tuple(K.catalog_limits(rules, 2, 9).first()) == (2, 2, 10, False)
    assert tuple(K.catalog_limits(rules.limit(0)).first()) == (0, 0, 0, True)


def test_inferred_depths(spark):
    row = "rec string, technology string, type string, hops int, parents array<struct<technology:string>>"
    good = [("r", "a", "direct", 0, []), ("r", "b", "inferred", 1, [("a",)])]
    bad = [("s", "x", "inferred", 1, [("y",)]), ("s", "y", "inferred", 1, [("x",)]), ("s", "z", "inferred", 2, [("gone",)])]
    got = {(r.technology, r.issue) for r in V.inference_issues(spark.createDataFrame(good + bad, row), ["rec"]).collect()}
    assert got == {("x", "parent at wrong depth"), ("y", "parent at wrong depth"), ("z", "parent missing")}


def test_record_bounds_and_features(spark):
    df = spark.createDataFrame([("d", ["x" * 50]), ("e", ["y"])], "domain string, technologies array<string>")
    got = {r.domain: (r.limit_exceeded, len(r.technologies)) for r in V.bound_record(df, 60).collect()}
    assert got == {"d": (True, 0), "e": (False, 1)}
    pages = spark.createDataFrame([("d", "é", [1], [1, 2]), ("d", None, None, [])], "domain string, text string, urls array<int>, metadata array<int>")
    r = V.page_features(pages, ["domain"]).first()
    assert (r.n_pages, r.n_bytes, r.n_chars) == (2, 2, 1)


def test_validation_and_bounds_of_errors(spark):
    rows = [("r", "http", f"C{i:03d}", None, None, "m") for i in range(10)] + [("r", "http", "C000", None, None, "m"), ("q", "dns", "D", None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, stage string, code string, page_id string, rule_id string, message string")
    got = sorted((r.run_id, r.code) for r in V.bound_errors(df, ["run_id"], 4).collect())
    assert got == [("q", "D"), ("r", "C000"), ("r", "C001"), ("r", "C002"), ("r", "RESULT_LIMIT_EXCEEDED")]


def test_evaluation_helpers(spark):
    names = spark.createDataFrame([("d", "a"), ("d", "b")], "key string, name string")
    categories = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "name string, category int")
    assert {r.token for r in E.category_tokens(names, categories, "key").collect()} == {"t2.category=1", "t2.category=2"}
    with pytest.raises(ValueError):
        E.category_tokens(names, categories.where("name = 'a'"), "key")
    with pytest.raises(ValueError):
        E.snapshots(names, "key", 5)
    with pytest.raises(ValueError):
        E.snapshots(names.where("name = 'a'"), "key", 0)
    bins = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (1 << 40,), (None,), (-1,)], "v long").select(E.power_bin(F.col("v"))).collect()
    assert [r[0] for r in bins] == ["0", "1", "2-3", "2-3", "4-7", f"{1 << 40}-{(1 << 41) - 1}", None, None]
    r = E.training_deficits(names, names.limit(0), "key").first()
    assert (r.pair_deficit, r.name_deficit) == (2, 2)


def test_bodies_are_read_in_their_encoding(spark):
    cases = [
        ("é".encode(), "utf-8", "é", "utf-8"), ("é".encode("cp1252"), "ISO-8859-1", "é", "cp1252"), ("\ufeffé".encode(), None, "é", "utf-8"), ("é".encode("utf-16-be"), None, None, "utf-8"), (b"\xfe\xff" + "é".encode("utf-16-be"), "latin1", "é", "utf-16-be"),
        ('<meta charset="windows-1251">ы'.encode("cp1251"), None, '<meta charset="windows-1251">ы', "cp1251"), (b'<meta charset="utf-16">x', None, '<meta charset="utf-16">x', "utf-8"), (b'<meta charset="nonsense">x', None, '<meta charset="nonsense">x', "utf-8"), (b"x", "nonsense", None, None), (b"", None, "", "utf-8"), (None, "utf-8", None, None), (b"\xff", "utf-8", "\ufffd", "utf-8"),
    ]
    df = spark.createDataFrame([(i, b, c) for i, (b, c, _, _) in enumerate(cases)], "i int, b binary, c string").orderBy("i")
    got = [(r.d.text, r.d.encoding) for r in df.select(X.decode_body("b", "c").alias("d")).collect()]
    assert [g for g, c in zip(got, cases) if c[2] is not None or c[3] is None] == [(t, e) for _, _, t, e in cases if t is not None or e is None]


def test_robots_paths_and_fetches(spark):
    rows = [("/a%7eb", "/a~b"), ("/a%2fb", "/a%2Fb"), ("/é", "/%C3%A9"), ("/100%", "/100%"), ("/%zz", "/%zz"), ("/%41%42", "/AB"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(B.normal_path(F.col("p"))).collect()] == [w for _, w in rows]
    texts = spark.createDataFrame([(1, "User-agent: *\nDisallow: /%7ejoe/caf\u00e9*"), (2, "User-agent: *\n" + "Disallow: /x\n" * 60_000 + "Disallow: /last")], "id int, t string")
    rules = B.robots_rules(texts, ["id"], "t", "bot")
    asked = spark.createDataFrame([(1, "/~joe/caf%c3%a9/1"), (1, "/~jo"), (2, "/x/1"), (2, "/last")], "id int, p string")
    assert {(r.id, r.path): r.allowed for r in B.robots_decisions(asked, rules, ["id"], "p").collect()} == {(1, "/~joe/caf%c3%a9/1"): False, (1, "/~jo"): True, (2, "/x/1"): False, (2, "/last"): True}
    start = spark.createDataFrame([(1, "a"), (2, "x"), (3, "q"), (4, "none")], "id int, url string")
    hops = spark.createDataFrame([("a", "b"), ("x", "y"), ("y", "x")], "from_url string, to_url string")
    statuses = spark.createDataFrame([("b", 200), ("q", 404), ("x", 200)], "url string, status int")
    assert {r.id: r.policy for r in B.robots_fetched(start, hops, statuses, "id").collect()} == {1: "parse", 2: "unavailable", 3: "no_rules", 4: "unavailable"}
