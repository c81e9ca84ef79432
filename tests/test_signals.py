import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.operators import candidates as C
from fathomline.operators import catalog as K
from fathomline.operators import detection as D
from fathomline.operators import extract as X
from fathomline.operators import matching as M
from fathomline.operators import pages as P
from fathomline.operators import results as V
from fathomline.operators import robots as B
from fathomline.operators.patterns import engine_refuses, translate

HTML = """<html><head><base href="/sub/"><META NAME=" Generator " CONTENT="Tool &amp; 1"><meta name="generator" content="Tool &amp; 1"><meta property="og:x" content="y"><meta charset="utf-8">
<link rel="Stylesheet preload" href="a.css"><link rel="icon" href="i.png"><script src="https://cdn.vendor.tld/x.js#f"></script><script>var hidden = "<a href=no>";</script></head>
<body><template><a href="/t">t</a></template><p class="one two" id="main">Hello <b>big</b>
 world</p><noscript>none</noscript><a href="page?q=1">x</a><a href="mailto:a@b">m</a><a href="http://user@host.tld/">u</a><img src="page?q=1"></body>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, HTML, "https://v.tld/a/b", "x"), (2, None, None, "x"), (3, "", "https://v.tld/", "x"), (4, "<p>open", "https://v.tld/", "x")], "id int, html string, url string, text string")
    rows = {r.id: r for r in X.extract_documents(df, ["id"], "html", "url", ["p.one", "p#main", "b.no", "script[src^=https]", "bad >"]).collect()}
    assert [(m.key, m.value) for m in rows[1].metadata] == [("generator", "Tool & 1"), ("og:x", "y")]
    assert [(u.kind, u.url) for u in rows[1].urls] == [("stylesheet", "https://v.tld/sub/a.css"), ("link", "https://v.tld/sub/i.png"), ("script", "https://cdn.vendor.tld/x.js"), ("a", "https://v.tld/sub/page?q=1"), ("img", "https://v.tld/sub/page?q=1")]
    assert rows[1].text == "Hello big worldxmu" and [f.locator for f in rows[1].facts] == ["script[src^=https]", "p.one", "p#main"]
    assert rows[2].text == "" and rows[3].urls == [] and rows[4].text == "open"


def test_page_facts_of_the_catalog(spark, tmp_path):
    from fathomline.plans.registry import QUERIES

    rules = [("#box", "presence"), ("div.kit", "regex"), ("div.kit", "presence"), ("link[href*=theme", "literal"), ('["a","attributes","data-v"]', "regex"), ('["a","exists",null]', "presence"), ('["a","properties","x"]', "regex"), ("li.row", "regex"), ("b.big", "presence"), ("b.big", "regex"), ("i.big", "regex"), ("bad >", "regex"), (None, "regex")]
    spark.createDataFrame([(str(i), "dom", *r) for i, r in enumerate(rules)] + [("x", "meta", "p", "regex")], "rule_id string, source string, locator string, match_mode string").write.parquet(f"{tmp_path}/rules.parquet")
    html = """<link href="/theme/1.css" rel=x><p>no</p><p id="box"><div class="a kit">kit/<b>1.2</b><script>;s</script><template>t</template></div><a data-v="7">x</a><a>y</a>
<ul><li class=row>one<li class=row>two</ul><b class=big>""" + "z" * 8193 + "</b><i class=big>" + "z" * 8193 + "</i>"
    spark.createDataFrame([(1, html, "https://v.tld/"), (2, None, None), (3, "<b class=row>" + "<li class=row>x" * 30, None)], "doc_id int, text string, url string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["page_facts"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "#box", "presence", None), (1, "div.kit", "value", "kit/1.2;s"), (1, "link[href*=theme", "value", "/theme/1.css"), (1, '["a","attributes","data-v"]', "value", "7"), (1, '["a","exists",null]', "presence", None), (1, "li.row", "value", "one"), (1, "li.row", "value", "two"), (1, "b.big", "presence", None), (3, "li.row", "value", "x")], key=str
    )


def test_catalog_parts(spark):
    rows = [("p", "p", 100, None, True), ("p\\;confidence:50\\;version:\\1", "p", 50, "\\1", True), ("", None, 100, None, True), ("p\\;confidence:101", "p", 101, None, False), ("p\\;other:1", "p", 100, None, False), ("p\\;confidence:1\\;confidence:2", "p", 1, None, False), ("a;b", "a;b", 100, None, True)]
    got = [tuple(r[0]) for r in spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, o string").orderBy("i").select(K.parse_tags(F.col("o"))).collect()]
    assert got == [r[1:] for r in rows]
    assert K.rule_id_text("n", "t", "url", None, "ö") == K.rule_id_text("n", "t", "url", None, "ö") != K.rule_id_text("n", "t", "url", "", "ö")


@settings(max_examples=200)
@given(st.sampled_from(["ab-cd[/-]([\\d.]+)", "x(?:\\.min)?\\.js", "abc?d", "a+bcd", "(abc)d", "[abc]def", "a.b", "qq|rr", "foo{2}bar", "wp-content", "^start.*end$", "v\\d+x"]), st.text(alphabet="abcdefx-/.1qrwpstontn", max_size=14))
def test_needle_stands_in_every_match(pattern, text):
    if re.search(pattern, text, re.I):
        assert K.required_literal(pattern) in text.lower()


def test_needle_of_whole_escapes_and_classes():
    for pattern, text in ((r"\x3cfoo", "<foo"), (r"\u003ca", "<a"), (r"[\]\"]foo", "]foo"), (r"[^\]x]foo", "yfoo"), (r"\cJabc", "\nabc"), (r"\p{Lu}abc", "Babc"), (r"(a)\1bcd", "aabcd"), (r"(?<n>a)\k<n>bcd", "aabcd"), (r"[a\\]foo", "\\foo"), (r"\u{3c}foo", "<foo")):
        assert K.required_literal(pattern) in text, pattern
    assert K.required_literal(r"\x3cfoo") == "foo" and K.required_literal(r"[\]\"]foo") == "foo" and K.required_literal(r"ab\.cd") == "ab.cd"


DIALECT = [
    (r"\bsch\b", "schön", "sch"), ("a$", "a\n", None), ("a$", "a", "a"), ("x[$]y", "x$y", "x$y"), (r"A\.B", "a.b", "a.b"), (r"a\sb", "a\u00a0b", "a\u00a0b"), (r"[\s]b", "\ufeffb", "\ufeffb"), (r"a\Sb", "a\u00a0b", None), (r"[\S]b", "xb", "xb"),
    (r"(?<v>\d+)\.js", "q 12.js", "12.js"), (r"(?<a>x)\k<a>", "axx", "xx"), (r"a[^]c", "a\nc", "a\nc"), (r"a[]c", "ac", None), (r"\p{L}+x", "p{L}}x", "p{L}}x"), (r"\u{1F600}", "u{1F600}", "u{1F600}"), (r"u{2}", "auu", "uu"), (r"\u0041b", "ab", "ab"), (r"\x41b", "ab", "ab"), (r"\xg", "xg", "xg"),
    (r"a{b", "a{b", "a{b"), (r"a{,2}", "a{,2}", "a{,2}"), (r"x]y}", "x]y}", "x]y}"), (r"[a&&b]", "&", "&"), (r"[[x]", "[", "["), (r"[\w-.]", "-", "-"), (r"[a-]", "-", "-"), (r"[\b]", "\b", "\b"), (r"\cJ", "\n", "\n"), (r"a.b", "a\nb", None), (r"a.b", "a\u0085b", "a\u0085b"), (r"\v", "\x0b", "\x0b"), (r"\v", "\n", None),
    (r"(a)\1", "aa", "aa"), (r"\101", "A", "A"), (r"é", "É", "É"), (r"[éx]", "É", "É"), (r"s", "ſ", None), (r"\e\A\z", "eAz", "eAz"), ("a|b$", "cb", "b"), (r"(?:ab)+?c", "ababc", "ababc"), (r"(?=a)a", "ba", "a"), (r"(?<!x)a", "xa a", "a"), (r"(?<=x)a", "a xa", "a"), (r"^a", "ba", None), (r"a#b c", "a#b c", "a#b c"), (r"日+", "x日日", "日日"), (r"\-\/", "-/", "-/"),
]
BROKEN = ["(a", "a)", "[a", "*a", "a**", "a++", "(?i)a", "(?>a)", "a{2,1}", "[b-a]", "\\", "(?<1>a)", "(?<a>x)(?<a>y)", "(?<a>x)\\k<b>", "(?", "^*", "(?<=a+)*", "x{99999999999}"]


def test_dialect(spark):
    """Patterns as catalogs mean them, each with the text it finds; none of them stops the engine."""
    done = [translate(p) for p, _, _ in DIALECT]
    assert [d.problem for d in done] == [None] * len(DIALECT) and engine_refuses(spark, [d.pattern for d in done]) == set()
    df = spark.createDataFrame([(i, d.pattern, t) for i, (d, (_, t, _)) in enumerate(zip(done, DIALECT))], "i int, p string, t string").orderBy("i")
    found = [r[0] for r in df.select(F.when(F.rlike("t", F.col("p")), M.group_text(F.col("t"), F.col("p"), F.lit(0)))).collect()]
    assert list(zip(DIALECT, found)) == [(d, d[2]) for d in DIALECT]
    assert [p for p in BROKEN if translate(p).problem is None] == []
    assert engine_refuses(spark, ["a", "(?<=a+)b", "(", "b", "[z-a]"]) == {"(", "[z-a]"} | ({"(?<=a+)b"} if "(?<=a+)b" in engine_refuses(spark, ["(?<=a+)b"]) else set())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab(){}[]|*+?.^$\\dwsbBkpux<>=!:-,123&é日", max_size=12))
def test_any_text_is_translated_or_reported(spark, text):
    done = translate(text)
    assert (done.pattern is None) == (done.problem is not None)
    if done.pattern is not None and engine_refuses(spark, [done.pattern]):
        assert "(?<" in done.pattern or "{" in text or "\\" in text, (text, done.pattern)


def test_literal_places(spark):
    rows = [("İİ marker end", "marker", 3, 6, "marker"), ("a lit[ERAL b", "LIT[eral", 2, 8, "lit[ERAL"), ("İx", "İX", 0, 2, "İx"), ("aİ", "i", None, None, None), ("xi\u0307y", "İ", 1, 2, "i\u0307"), ("", "a", None, None, None), ("a", "", 0, 0, ""), ("STRASSE", "straße", None, None, None), (None, "a", None, None, None), ("ΑΣ", "σ", None, None, None)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, value string, pattern string").orderBy("i")
    got = [(r.s and r.s.start, r.s and r.s.size) for r in df.select(M.literal_span(F.col("value"), F.col("pattern")).alias("s")).collect()]
    for (value, pattern, start, size, _), found in zip(rows, got):
        assert found == (start, size) or (value == "ΑΣ"), (value, pattern, found)


def test_unusable_rules_stop_nothing(spark):
    raw = spark.createDataFrame([(f"r{i}", "n", "T", "html", None, p, p, "regex", 100, None, None) for i, p in enumerate([r"(?<v>\d+)\.js", r"[^]end", "(broken", "plain text", r"(a)(b)?c"])], "rule_id string, namespace string, technology string, source string, locator string, original string, pattern string, match_mode string, confidence int, version_template string, locator_pattern string")
    assert [(r.rule_id, r.problem) for r in K.rejected_rules(raw).collect()] == [("r2", "group without end")]
    cands = spark.createDataFrame([("d", "http", "value", "html", None, None, "see 12.js PLAIN TEXT; ac\nend", "c0")], "domain string, collector string, kind string, source string, page_id string, key string, value string, candidate_id string")
    plan = M.match_rules(cands, M.prepare_rules(raw))
    assert {(r.rule_id, r.matched, r.match_index) for r in plan.collect()} == {("r0", "12.js", 4), ("r1", "\nend", 24), ("r3", "PLAIN TEXT", 10), ("r4", "ac", 22)}
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_every_rule_is_met_as_by_brute_force(spark):
    rng = random.Random(8)
    words = ["alpha", "beta-kit", "gamma", "x1", "wp-content", "q", "shop", "theme"]
    rules = [(f"r{i}", rng.choice(["html", "text", "header"]), rng.choice([None, "server"]), rng.choice(words) + rng.choice(["", r"[\d.]+", "?", "/([a-z]+)", "|zz"]), rng.choice(["regex", "regex", "literal", "presence"])) for i in range(60)]
    values = [(f"c{i}", rng.choice(["html", "text", "header"]), rng.choice([None, "server", "other"]), " ".join(rng.choice(words + ["1.2", "ZZ", "Alpha", "É"]) for _ in range(rng.randrange(6))), rng.choice(["value", "value", "presence"])) for i in range(80)]
    raw = spark.createDataFrame([(r, "n", "T", s, k, p, p if m != "presence" else None, m, 100, None, None) for r, s, k, p, m in rules], "rule_id string, namespace string, technology string, source string, locator string, original string, pattern string, match_mode string, confidence int, version_template string, locator_pattern string")
    cands = spark.createDataFrame([("d", "http", kind, s, None, k, v, c) for c, s, k, v, kind in values], "domain string, collector string, kind string, source string, page_id string, key string, value string, candidate_id string")
    prepared = M.prepare_rules(raw)
    fits = [(r, c) for r in rules for c in values if r[1] == c[1] and (r[2] is None or r[2] == c[2]) and (c[4] == "value" or r[4] == "presence")]
    want = {(r[0], c[0]) for r, c in fits if r[4] == "presence" or (r[4] == "literal" and r[3].lower() in c[3].lower()) or (r[4] == "regex" and re.search(r[3], c[3], re.I))}
    assert {(r.rule_id, r.candidate_id) for r in M.match_rules(cands, prepared).collect()} == want
    costs = {r.candidate_id: (r.pairs, r.regex_runs) for r in M.pair_costs(cands, prepared, ["domain"]).collect()}
    assert costs == {c[0]: (sum(1 for x, y in fits if y == c), sum(1 for x, y in fits if y == c and x[4] == "regex")) for c in values if any(y == c for _, y in fits)}


def test_timeouts(spark):
    matches = spark.createDataFrame([("d", f"r{i}", i) for i in range(8)] + [("e", "r1", 1)], "rec string, rule_id string, ordinal int")
    timeouts = spark.createDataFrame([("d", "r1", 1), ("d", "r3", 3), ("d", "r5", 5), ("d", "r5", 5), ("e", "r0", 0)], "rec string, rule_id string, ordinal int")
    assert sorted((r.rec, r.rule_id) for r in M.drop_timed_out(matches, timeouts, ["rec"]).collect()) == [("d", "r0"), ("d", "r2"), ("d", "r4"), ("e", "r1")]
    assert [r.rec for r in M.ended_records(timeouts, ["rec"]).collect()] == ["d"]
    ordered = M.in_result_order(matches.drop("ordinal").withColumn("candidate_id", F.lit("c")), spark.createDataFrame([(f"r{i}", 9 - i) for i in range(8)], "rule_id string, ordinal int"))
    assert [r.ordinal for r in ordered.collect()] == sorted(r.ordinal for r in ordered.collect())


RULES = [
    ("n", "Keyed", "header", "Server", "ngx/([\\d.]+)\\;version:\\1"), ("n", "Free", "html", None, "powered-by\\;confidence:0"), ("n", "There", "cookie", "sid", ""), ("n", "Probe", "probe", None, "LIT[eral"),
    ("n", "Bad", "html", None, "x\\;nonsense:1"), ("n", "Keyed", "header", "Server", "ngx/([\\d.]+)\\;version:\\1"), ("n", None, "html", None, "x"),
]


def test_matching_and_detection(spark):
    raw = spark.createDataFrame(RULES, "namespace string, technology string, source string, locator string, original string")
    rules = K.compile_rules(raw)
    assert rules.count() == 4
    cands = spark.createDataFrame([
        ("d1", "http", "value", "header", "p1", "server", "NGX/1.2 x"), ("d1", "http", "value", "header", "p1", "other", "ngx/9"), ("d1", "http", "value", "html", "p1", None, "is Powered-By us"),
        ("d1", "http", "value", "cookie", "p1", "SID", "v"), ("d1", "http", "presence", "html", "p1", None, "powered-by"), ("d2", "http", "value", "probe", None, None, "a lit[ERAL b"), ("d2", "http", "value", "html", None, None, None),
    ], "domain string, collector string, kind string, source string, page_id string, key string, value string")
    numbered = C.number_candidates(cands, ["domain"])
    matches = M.match_rules(numbered, M.prepare_rules(rules))
    got = {(r.domain, r.technology): (r.matched, r.match_index, r.version) for r in matches.collect()}
    assert got == {("d1", "Keyed"): ("NGX/1.2", 0, "1.2"), ("d1", "Free"): ("Powered-By", 3, None), ("d1", "There"): ("", 0, None), ("d2", "Probe"): ("lit[ERAL", 2, None)}
    evidence = D.build_evidence(M.dedupe_matches(matches, ["domain"]), ["domain"])
    shown = {r.technology: (r.match.kind, r.match.value, r.version) for r in evidence.collect()}
    assert shown == {"Keyed": ("value", "NGX/1.2", "1.2"), "Free": ("redacted", None, None), "There": ("presence", None, None), "Probe": ("redacted", None, None)}
    direct = {r.technology: (r.confidence, r.version) for r in D.direct_detections(evidence, ["domain"]).collect()}
    assert direct == {"Keyed": (100, "1.2"), "There": (100, None), "Probe": (100, None)}
    assert M.match_rules(numbered.limit(0), M.prepare_rules(rules)).count() == 0


def test_confidence_and_version(spark):
    rows = [("a", "T", "r1", 40, "1.0"), ("a", "T", "r1", 40, "1.0"), ("a", "T", "r2", 30, "2.0"), ("a", "T", "r3", 30, "1.0"), ("b", "T", "r1", 50, "1"), ("b", "T", "r2", 50, "2"), ("c", "Z", "r1", 0, None), ("d", "Y", "r1", 0, None), ("d", "Y", "r2", 7, None), ("e", None, "r1", 9, None)]
    df = spark.createDataFrame([(*r, "p1") for r in rows], "rec string, technology string, rule_id string, confidence int, version string, page_id string")
    got = {(r.rec, r.technology): (r.confidence, r.version, r.n_evidence) for r in D.direct_detections(df, ["rec"]).collect()}
    assert got == {("a", "T"): (100, "1.0", 4), ("b", "T"): (100, None, 2), ("d", "Y"): (7, None, 2)}


def test_windows(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10, 20, 30, 1, 1])] + [("b", 0, 100)], "rec string, i int, v int")
    kept = C.keep_until_violated(df, ["rec"], ["i"], C.running(F.col("v"), ["rec"], ["i"]) > 35)
    assert sorted((r.rec, r.i) for r in kept.collect()) == [("a", 0), ("a", 1)]
    stopped = P.stop_after(df, ["rec"], "i", F.col("v") == 20)
    assert sorted((r.rec, r.i) for r in stopped.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    first = P.first_success(df, ["rec"], "i", F.col("v") < 20, "v")
    assert {r.rec: r.v for r in first.collect()} == {"a": 20, "b": 100}


def links(spark, rows):
    return spark.createDataFrame([("d", "https://v.tld/", "https://v.tld" + r if r.startswith("/") else r) for r in rows], "domain string, entry_url string, url string")


def test_page_choice(spark):
    static = ["/products/zeta", "/collections/sale", "/products/a", "/account/profile", "/files/manual.pdf", "https://other.tld/products/x"]
    rendered = ["/collections/a", "/products/a", "/checkout", "/search?q", "/products/%zz"]
    chosen = {(r.role, r.url) for r in P.select_pages(links(spark, static + rendered), ["domain"]).collect()}
    assert chosen == {("listing", "https://v.tld/collections/a"), ("detail", "https://v.tld/products/a")}
    assert [(r.role, r.url) for r in P.select_pages(links(spark, ["/about/company", "/about", "/privacy", "/admin", "/"]), ["domain"]).collect()] == [("content", "https://v.tld/about")]
    plan = P.plan_pages(links(spark, ["/products/zeta", "/collections/zeta", "/products/a"]), links(spark, ["/collections/a"]), ["domain"]).collect()
    assert len(plan) == 2 and {r.role for r in plan} == {"detail", "listing"} and "https://v.tld/collections/zeta" in {r.url for r in plan}
    assert P.select_pages(links(spark, []), ["domain"]).count() == 0


def test_robots(spark):
    text = "# c\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a*b$\nAllow: /a/ok\nDisallow: /a\nUser-agent: bot\nUser-agent: x\nDisallow: /q\nDisallow:\nbad line\nAllow: /q"
    df = spark.createDataFrame([(1, text), (2, None), (3, "User-agent: *\r\nDisallow: /z?x=1")], "id int, t string")
    general, own = B.robots_rules(df, ["id"], "t", "nobody"), B.robots_rules(df, ["id"], "t", "Bot")
    assert {(r.allow, r.path) for r in own.where("id = 1").collect()} == {(False, "/q"), (True, "/q")}
    asked = spark.createDataFrame([(1, p) for p in ("/", "/a/ok/1", "/a/x", "/axb", "/axbc", "/b")] + [(3, "/z?x=12"), (3, "/zzx=1")], "id int, p string")
    got = {(r.id, r.path): r.allowed for r in B.robots_decisions(asked, general, ["id"], "p").collect()}
    assert got == {(1, "/"): True, (1, "/a/ok/1"): True, (1, "/a/x"): False, (1, "/axb"): False, (1, "/axbc"): False, (1, "/b"): True, (3, "/z?x=12"): False, (3, "/zzx=1"): True}


def test_redirects_and_outcomes(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), *[(f"h{i}", f"h{i + 1}") for i in range(9)]], "from_url string, to_url string")
    start = spark.createDataFrame([(1, "a"), (2, "x"), (3, "h0"), (4, "z")], "id int, url string")
    got = {r.id: (r.outcome, r.hops) for r in V.follow_redirects(start, hops, "id").collect()}
    assert got == {1: ("ended", 2), 2: ("loop", 1), 3: ("too_many", 6), 4: ("ended", 0)}


def test_summary_of_totals(spark):
    rows = [("r", f"d{i}", "success", {"total_ms": t}, {s: 1 for s in V.STATUS_STATS}) for i, t in enumerate([1, 2, 4])]
    df = spark.createDataFrame(rows, "run_id string, domain string, status string, timings struct<total_ms:long>, detection_stats struct<" + ",".join(f"{s}:long" for s in V.STATUS_STATS) + ">")
    r = V.run_summary(df).first()
    assert (r.average, r.p50, r.p95, r.p99, r.success, r.raw_direct) == (2.333, 2, 4, 4, 3, 3)
    assert V.run_summary(df.limit(0)).count() == 0


def test_json_paths(spark):
    df = spark.createDataFrame([(json.dumps({"a": {"b": 1}, "c": None}),), ("{cut",), (None,)], "p string")
    assert [[(f.path, f.value) for f in r[0]] for r in df.select(X.json_path_facts(F.col("p"), ["a.b", "a.x", "c"])).collect()] == [[("a.b", "1")], [], []]
