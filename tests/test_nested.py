import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.operators.nested import Shape, flatten_json, load_deep, plan_inlining, records
from fathomline.plans.data_problems import CATALOG_SHAPE, RESULT_SHAPE, p6_found
from fathomline.session import read_table

RECORD = {
    "schemaVersion": 1,
    "technologies": [
        {"name": "A", "evidence": [{"ruleId": "r1", "match": {"kind": "value", "value": "v"}}, None, {"rule_id": "r2", "match": "text"}, {"ruleId": None}]},
        None,
        {"name": "B", "evidence": {"RuleID": "r3", "match": None, "confidence": 5}},
        {"name": "C"},
    ],
    "errors": [{"ruleId": "not evidence"}],
}


def flatten(spark, payloads, shape=RESULT_SHAPE):
    df = spark.createDataFrame([(i, p, "clash", 1) for i, p in enumerate(payloads)], "id long, payload string, doc_id string, `table` int")
    return flatten_json(df, "id", "payload", shape)


def evidence(flat):
    names = {(r.doc_key, r.node_id): r.n for r in flat.table("technologies", {"n": "name"}).collect()}
    return sorted((r.doc_id, names[r.doc_key, r.parent_id], r.ordinal, r.r, r.v or r.m) for r in flat.table("evidence", {"r": "ruleid", "v": "match.value", "m": "match"}).collect())


EXPECTED = [("A", 0, "r1", "v"), ("A", 2, "r2", "text"), ("A", 3, None, None), ("B", 0, "r3", None)]


def test_irregular_records_and_wrappers(spark):
    payloads = [json.dumps(RECORD), json.dumps({"data": {"result": RECORD, "attempt": 2}}), json.dumps([RECORD]), json.dumps(json.dumps(RECORD))]
    flat = flatten(spark, payloads)
    got = evidence(flat)
    assert sorted(got, key=str) == sorted([(i, *e) for i in range(4) for e in EXPECTED], key=str)
    assert {"record", "technologies", "evidence", "errors"} == set(flat.plan.tables)


def test_broken_payloads_give_nothing(spark):
    flat = flatten(spark, [None, "", "   ", json.dumps(RECORD)[:90], "null", "7", json.dumps({})])
    assert flat.df.select("doc_id", "table").collect() == [(6, "record")]


def test_empty_table_and_repeated_rows(spark):
    assert flatten(spark, []).df.count() == 0
    df = spark.createDataFrame([(1, json.dumps(RECORD)), (1, json.dumps(RECORD))], "id long, payload string")
    got = evidence(flatten_json(df, "id", "payload", RESULT_SHAPE))
    assert len(got) == 8


def test_catalog_forms(spark):
    tech = {"headers": {"X-Powered-By": ["p", "", None, "q"], "X-Powered": "no"}}
    listed = {"name": "T", "headers": [{"name": "x-powered-by", "value": "one"}, {"name": "Via", "value": ["v"]}]}
    flat = flatten(spark, [json.dumps({"T": tech}), json.dumps({"technologies": {"T": tech}}), json.dumps([listed]), json.dumps({"technologies": [listed]})], CATALOG_SHAPE)
    headers = {(r.doc_key, r.node_id): r.h for r in flat.table("headers", {"h": "name"}).collect()}
    got = sorted((r.doc_id, headers[r.doc_key, r.parent_id], r.ordinal, r.p) for r in flat.table("value", {"p": "value"}).collect())
    once = [("X-Powered", 0, "no"), ("X-Powered-By", 0, "p"), ("X-Powered-By", 1, ""), ("X-Powered-By", 3, "q")]
    twice = [("Via", 0, "v"), ("x-powered-by", 0, "one")]
    assert got == [(i, *x) for i in (0, 1) for x in once] + [(i, *x) for i in (2, 3) for x in twice]


def test_shared_and_recursive_elements_get_tables():
    plan = plan_inlining([("r", "a", False, True), ("r", "b", False, True), ("a", "s", False, True), ("b", "s", False, True), ("s", "n", False, False), ("a", "t", False, True), ("t", "t", False, True)], "r")
    assert plan.tables == {"r", "s", "t"}


def test_deep_nesting_does_not_fail(spark):
    flat = flatten(spark, ['{"technologies": ' + '{"x": ' * 300 + "1" + "}" * 301], Shape("record", "technologies"))
    assert flat.df.count() > 0


def test_found_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    want = set()
    for row in read_table(spark, folder, "result_records").collect():
        try:
            value = json.loads(row.payload)
        except (TypeError, ValueError):
            continue
        for record in records(value, RESULT_SHAPE):
            for tech in record.get("technologies") or []:
                items = (tech or {}).get("evidence")
                for at, item in enumerate(items if isinstance(items, list) else [items]):
                    rule = (item or {}).get("ruleId") or (item or {}).get("rule_id")
                    if rule:
                        match = item.get("match")
                        want.add(("result_records", row.record_no, tech["name"], at, rule, (match.get("value") if isinstance(match, dict) else match) or ""))
    for row in read_table(spark, folder, "catalog_docs").collect():
        try:
            value = json.loads(row.payload)
        except ValueError:
            continue
        value = value.get("technologies", value) if isinstance(value, dict) else value
        for name, tech in value.items() if isinstance(value, dict) else [(t["name"], t) for t in value]:
            headers = tech.get("headers") or {}
            for header, patterns in headers.items() if isinstance(headers, dict) else [(h["name"], h["value"]) for h in headers]:
                if header.lower() == "x-powered-by":
                    want |= {("catalog_docs", row.doc_no, name, at, "", p) for at, p in enumerate(patterns if isinstance(patterns, list) else [patterns]) if p is not None}
    got = p6_found(spark, folder).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_found_whatever_else_the_collection_holds(spark, tmp_path):
    from fathomline.plans.data_problems import p6_found

    plain = '{"technologies": [{"name": "T", "evidence": [{"ruleId": "r1", "match": {"value": "v1"}}, null, {"ruleId": "r2", "match": "text"}]}]}'
    lone = '{"technologies": {"name": "L", "evidence": {"ruleId": "r3", "match": {"value": "v3"}}}}'
    deep = '{"w": ' * 9 + plain.replace("r1", "r9") + "}" * 9
    odd = '{"technologies": [{"name": ["N"], "evidence": [{"ruleId": "r4", "match": [null, {"value": ["v4", "x"]}]}, {"ruleId": "r5"}], "other": {"match": {"value": 1}}}]}'
    header = '{"technologies": {"H": {"headers": {"X-Powered-By": "php"}}}}'
    listed = '{"technologies": {"H": {"headers": {"x-powered-by": ["a", null, "b"]}, "dom": {"#x": {"text": "t"}}}}}'
    want = {plain: [("T", 0, "r1", "v1"), ("T", 2, "r2", "text")], lone: [("L", 0, "r3", "v3")], deep: [("T", 0, "r9", "v1"), ("T", 2, "r2", "text")], odd: [("N", 0, "r4", "v4"), ("N", 1, "r5", "")], header: [("H", 0, "", "php")], listed: [("H", 0, "", "a"), ("H", 2, "", "b")]}
    for at, (records, catalogs) in enumerate((([plain], [header]), ([lone], [header]), ([plain, lone, deep, odd], [header, listed]))):
        folder = f"{tmp_path}/{at}"
        spark.createDataFrame(list(enumerate(records)), "record_no long, payload string").write.parquet(f"{folder}/result_records.parquet")
        spark.createDataFrame(list(enumerate(catalogs)), "doc_no long, payload string").write.parquet(f"{folder}/catalog_docs.parquet")
        got = sorted(tuple(r) for r in p6_found(spark, folder).collect())
        assert got == sorted((t, n, *x) for t, texts in (("result_records", records), ("catalog_docs", catalogs)) for n, text in enumerate(texts) for x in want[text])


def test_any_depth(spark):
    """Wrappers, lists, objects and JSON in strings far deeper than any stack; nothing turns into text or gets lost."""
    deep = 3_000
    wrapped = '{"w":' * deep + '{"technologies":[{"name":"A"}]}' + "}" * deep
    nested = '{"technologies":[{"name":"B","x":' + '{"y":' * deep + '{"technologies":[{"name":"C"}]}' + "}" * deep + "}]}"
    listed = '{"technologies":' + "[" * deep + '{"name":"D"}' + "]" * deep + "}"
    texts = [json.dumps({"technologies": [{"name": "E"}]})]
    for _ in range(7):
        texts.append(json.dumps(texts[-1]))
    df = spark.createDataFrame(list(enumerate([wrapped, nested, listed, texts[-1], wrapped[:-1]])), "no long, payload string")
    flat = flatten_json(df, "no", "payload", Shape(root="record", anchor="technologies", tables=frozenset(("technologies",))))
    names = {(r.doc_id, r.name) for r in flat.table("technologies", {"name": "name"}).collect()}
    assert names == {(0, "A"), (1, "B"), (1, "C"), (2, "D"), (3, "E")}


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12), st.integers(0, 40))
def test_deep_reader_equals_the_library(value, cut):
    text = json.dumps(value, ensure_ascii=bool(cut % 2), indent=cut % 3 or None)
    assert load_deep(text) == value
    short = text[: max(0, len(text) - 1 - cut)]
    try:
        want = json.loads(short)
    except ValueError:
        with pytest.raises(ValueError):
            load_deep(short)
    else:
        assert load_deep(short) == want
