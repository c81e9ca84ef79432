"""Loading of catalogs, ledgers of corrections, relations, categories, plans, and the detection from observations to technologies."""

import json

import pytest
from pyspark.sql import functions as F

from fathomline.operators import candidates as C
from fathomline.operators import catalog as K
from fathomline.operators import detection as D
from fathomline.operators import matching as M


def folder(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))
    return str(tmp_path)


def test_catalog_folder(spark, tmp_path):
    path = folder(tmp_path, a={"Tool": {"cats": [1]}}, categories={"1": {"name": "x"}})
    files, digest = K.load_catalog(spark, path)
    assert sorted(r.file for r in files.collect()) == ["a.json", "categories.json"] and digest == K.catalog_digest([("categories.json", b'{"1": {"name": "x"}}'), ("a.json", b'{"Tool": {"cats": [1]}}')])
    assert K.load_catalog(spark, path, digest)[1] == digest
    with pytest.raises(ValueError, match="digest"):
        K.load_catalog(spark, path, "sha256:0")
    for name, content in (("notes.txt", "{}"), ("ab.json", "{}")):
        (tmp_path / name).write_text(content)
        with pytest.raises(ValueError, match="other entries"):
            K.load_catalog(spark, path)
        (tmp_path / name).unlink()
    for bad in ("[]", '{"a": 1, "a": 2}', "{", "[" * 70 + "]" * 70):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ValueError):
            K.load_catalog(spark, path)
    (tmp_path / "b.json").unlink()
    (tmp_path / "a.json").unlink()
    (tmp_path / "categories.json").unlink()
    with pytest.raises(ValueError, match="1 to"):
        K.load_catalog(spark, path)


def test_corrections_hit_exactly_once(spark):
    rules = spark.createDataFrame([("r1", "A", "html", None, "a"), ("r2", "B", "header", "x", "b"), ("r3", "C", "html", None, "c")], "rule_id string, technology string, source string, locator string, original string")
    technologies = lambda *x: spark.createDataFrame([(t,) for t in x], "technology string")
    ids = lambda *x: spark.createDataFrame([(t,) for t in x], "rule_id string")
    swap = lambda *x: spark.createDataFrame(list(x), "target_rule_id string, technology string, source string, locator string, original string")
    good = K.apply_corrections(rules, technologies("A"), ids("r3"), swap(("r2", "B", "header", "x", "new")))
    assert [(r.rule_id, r.original) for r in good.collect()] == [("r2", "new")]
    cases = [
        (technologies("Z"), ids(), swap(), ("drop_technology", "Z", "hits nothing")), (technologies(), ids("r9"), swap(), ("drop_rule", "r9", "hits nothing")), (technologies(), ids("r1", "r1"), swap(), ("drop_rule", "r1", "named twice")),
        (technologies(), ids(), swap(("r2", "B", "header", "y", "n")), ("replace_rule", "r2", "replaces another rule")), (technologies(), ids(), swap(("r8", "B", "header", "x", "n")), ("replace_rule", "r8", "hits nothing")),
    ]
    for t, r, s, want in cases:
        assert [tuple(x) for x in K.correction_issues(rules, t, r, s).collect()] == [want]
        with pytest.raises(ValueError, match="rejected"):
            K.apply_corrections(rules, t, r, s)
    assert K.correction_issues(rules.union(rules), technologies(), ids("r1"), swap()).first().problem == "hits several"


def test_relations_and_categories(spark):
    known = spark.createDataFrame([("A",), ("B",)], "name string")
    rows = [("A", "implies", "B", 50, None), ("A", "implies", "A", 50, None), ("A", "requires", "A", None, None), ("B", "excludes", "B", None, None), ("A", "implies", "Z", 50, None), ("Y", "requires", "A", None, None), ("A", "implies", "B", 0, None), ("B", "implies", "A", 101, None), ("B", "implies", "A", 9, "\\1"), ("A", "requires", None, None, None)]
    raw = spark.createDataFrame(rows, "name string, kind string, target string, confidence int, version string")
    got = {(r.name, r.kind, r.target, r.problem) for r in K.relation_issues(raw, known).collect()}
    assert got == {("A", "requires", "A", "refers to itself"), ("B", "excludes", "B", "refers to itself"), ("A", "implies", "Z", "unknown target"), ("Y", "requires", "A", "unknown technology"), ("A", "implies", "B", "confidence out of range"), ("B", "implies", "A", "confidence out of range"), ("B", "implies", "A", "version is no plain text"), ("A", "requires", None, "unknown target")}
    technologies = spark.createDataFrame([("A", [1, 2, 2]), ("B", [9]), ("C", None)], "name string, cats array<int>")
    found = {tuple(r) for r in K.category_issues(technologies, spark.createDataFrame([(1,), (2,), (3,), (3,)], "id int")).collect()}
    assert found == {("A", 2, "named twice"), ("B", 9, "unknown category"), (None, 3, "defined twice")}


def test_inspection_plan_by_kind(spark):
    rules = spark.createDataFrame([("dom", "p", "presence"), ("dom", "p", "regex"), ("javascript", "a.b", "regex"), ("probe", "/x", "literal"), ("dns_record", " mx ", "regex"), ("tls_issuer", None, "literal"), ("html", None, "regex")], "source string, locator string, match_mode string")
    assert {tuple(r) for r in K.inspection_plan(rules).collect()} == {
        ("dom_fact", "dom", "p", True, True), ("script_path", "javascript", "a.b", False, True), ("probe_path", "probe", "/x", False, True), ("dns_type", "dns_record", "MX", False, True), ("tls", "tls_issuer", None, False, True), ("other", "html", None, False, True),
    }


PAGES = "rec string, collector string, page_id string, final_url string, redirects array<struct<from_url:string,to_url:string>>, headers array<struct<key:string,value:string>>, cookies array<struct<key:string,value:string>>, html array<string>, script_urls array<string>, dom array<struct<key:string,value:string>>"


def test_observations_to_technologies(spark):
    pages = spark.createDataFrame([
        ("d", "http", "p1", "https://d.tld/", [("http://d.tld/", "https://d.tld/")], [("Server", "ngx/1.5")], [("sid", None)], ["<shopkit>"], ["/b.js", "/a.js", "/a.js"], None),
        ("d", "browser", "p1", "https://d.tld/", None, None, None, None, [f"/{i}.js" for i in range(90)], [("p.x", None)]), ("e", "http", "p1", None, None, None, None, None, None, None),
    ], PAGES)
    observed = spark.createDataFrame([("d", "dns", "dns_record", "mx", "mail.d.tld"), ("d", "tls", "tls_issuer", "ignored", "Some CA"), ("d", "http", "robots", None, "Disallow: /"), ("d", "http", "probe", "/x", "ok")], "rec string, collector string, source string, key string, value string")
    got = C.collect_candidates(pages, observed, ["rec"])
    rows = {(r.collector, r.kind, r.source, r.page_id, r.key, r.value) for r in got.collect() if not (r.collector == "browser" and r.source == "script_url")}
    assert rows == {
        ("http", "value", "url", "p1", None, "https://d.tld/"), ("http", "value", "url", "p1", None, "http://d.tld/"), ("http", "value", "header", "p1", "server", "ngx/1.5"), ("http", "presence", "cookie", "p1", "sid", ""), ("http", "value", "html", "p1", None, "<shopkit>"),
        ("http", "value", "script_url", "p1", None, "/a.js"), ("http", "value", "script_url", "p1", None, "/b.js"), ("browser", "value", "url", "p1", None, "https://d.tld/"), ("browser", "presence", "dom", "p1", "p.x", ""),
        ("dns", "value", "dns_record", None, "MX", "mail.d.tld"), ("tls", "value", "tls_issuer", None, None, "Some CA"), ("http", "value", "robots", None, None, "Disallow: /"), ("http", "value", "probe", None, "/x", "ok"),
    }
    assert got.where("collector = 'browser' AND source = 'script_url'").count() == 90 and C.cap_script_urls(got, ["rec"], 1).where("collector = 'http' AND source = 'script_url'").count() == 1
    raw = spark.createDataFrame([("n", "Ngx", "header", "Server", "ngx/([\\d.]+)\\;version:\\1"), ("n", "Kit", "html", None, "shopkit\\;confidence:40"), ("n", "Mail", "dns_record", "mx", "mail"), ("n", "Late", "cookie", "sid", "")], "namespace string, technology string, source string, locator string, original string")
    edges = [("v1", "implies", "kit", "base", "i1", 70, None, None), ("v1", "requires", "mail", "absent", None, None, None, None), ("v1", "excludes", "ngx", "late", None, None, None, None)]
    edges = spark.createDataFrame(edges, "revision string, kind string, name string, target string, rule_id string, confidence int, version string, category int")
    evidence, direct, resolved = D.detect(got, M.prepare_rules(K.compile_rules(raw)), spark.createDataFrame([("d", "v1")], "rec string, revision string"), edges, ["rec"])
    assert {(r.technology, r.confidence, r.version) for r in direct.collect()} == {("ngx", 100, "1.5"), ("kit", 40, None), ("mail", 100, None), ("late", 100, None)}
    found = {(r.technology, r.type, r.confidence, r.raw_direct, r.gated_direct, r.suppressed_direct, r.retained_direct) for r in resolved.collect()}
    assert found == {("ngx", "direct", 100, 4, 1, 1, 2), ("kit", "direct", 40, 4, 1, 1, 2), ("base", "inferred", 40, 4, 1, 1, 2)}
    nothing = D.detect(got.limit(0), M.prepare_rules(K.compile_rules(raw)), spark.createDataFrame([], "rec string, revision string"), edges, ["rec"])
    assert nothing[2].count() == 0
    assert got.where(F.col("rec") == "e").count() == 0
