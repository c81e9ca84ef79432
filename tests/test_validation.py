"""Every rule of the validation by a valid record and one fault each."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from fathomline.operators import validation as V

FLAT = {
    "schema_version": 1, "run_id": "26a6d9d0-4cf7-4daf-8e32-8c40cd184235", "domain": "a.tld", "status": "success", "final_url": "https://a.tld/x", "detection_stats": {"raw_direct": 3, "gated_direct": 1, "suppressed_direct": 1, "retained_direct": 1},
    "timings": {"total_ms": 100, **{c: 10 for c in V.STAGES}}, "usage": {"http_requests": 4, "browser_requests": 2, "retries": 1, "pages_visited": 2, "probes_issued": 1, "script_bodies_inspected": 1, "static_transferred_bytes": 10, "browser_transferred_bytes": 10},
}
FLAT_SCHEMA = "schema_version int, run_id string, domain string, status string, final_url string, detection_stats struct<" + ",".join(f"{c}:long" for c in V.STATS) + ">, timings struct<total_ms:long," + ",".join(f"{c}:long" for c in V.STAGES) + ">, usage struct<" + ",".join(f"{c}:long" for c in V.USAGE) + ">"
FLAT_FAULTS = [
    ("unsupported schema", {"schema_version": 2}), ("no run or domain", {"domain": None}), ("run id is no uuid", {"run_id": "x"}), ("domain is not canonical", {"domain": "A.tld"}), ("unknown status", {"status": "odd"}),
    ("address is not sanitised", {"final_url": "https://a.tld/x?q=1"}), ("stats do not add up", {"detection_stats.raw_direct": 9}), ("negative count", {"usage.probes_issued": -1}), ("failed record has detections", {"status": "failed"}),
    ("failed record has an address", {"status": "failed"}), ("failed record has pages", {"status": "failed"}), ("successful record has no entry page", {"final_url": None}), ("successful record lacks a stage", {"timings.robots_ms": None}),
    ("no total time", {"timings.total_ms": None}), ("negative time", {"timings.dns_ms": -1}), ("stage longer than total", {"timings.dns_ms": 101}), ("detections without detection time", {"timings.detect_ms": None}),
    ("browser requests without browser time", {"timings.browser_ms": None}), ("probes without http time", {"timings.http_ms": None}), ("retries do not fit requests", {"usage.retries": 3}), ("static bytes without request", {"usage.http_requests": 0}),
    ("browser bytes without request", {"usage.browser_requests": 0}), ("more probes than requests", {"usage.probes_issued": 5}), ("total time too large to sum", {"timings.total_ms": V.AGGREGATE_UNIT + 1}), ("usage too large to sum", {"usage.static_transferred_bytes": V.AGGREGATE_UNIT + 1}),
    *[(f"{c} above its limit", {f"usage.{c}": V.LIMITS[c] + 1}) for c in ("http_requests", "browser_requests", "probes_issued", "script_bodies_inspected", "browser_transferred_bytes")], ("pages_visited above its limit", {"usage.pages_visited": 4}),
]


def changed(record, changes):
    out = copy.deepcopy(record)
    for path, value in changes.items():
        *above, last = path.split(".")
        at = out
        for step in above:
            at = at[int(step)] if isinstance(at, list) else at[step]
        at[int(last) if isinstance(at, list) else last] = value
    return out


def read(spark, rows, schema):
    text = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, j string")
    return text.select("i", F.from_json("j", schema).alias("r")).select("i", "r.*").orderBy("i")


def test_flat_rules(spark):
    df = V.validation_issues(read(spark, [FLAT] + [changed(FLAT, c) for _, c in FLAT_FAULTS], FLAT_SCHEMA))
    got = [r.issues for r in df.collect()]
    assert got[0] == []
    assert [name for (name, _), issues in zip(FLAT_FAULTS, got[1:]) if name not in issues] == []
    assert {name for name, _ in FLAT_FAULTS} == set(V.flat_rules())


def piece(**more):
    return {"collector": "http", "source": "header", "page_id": "p1", "key": "server", "match": {"kind": "value", "value": "ngx/1", "truncated": False}, "rule_id": "r1", "pattern": "ngx/(.*)", "confidence": 60, "version": "1", **more}


RECORD = {"technologies": [
    {"name": "A", "categories": [{"id": 1, "name": "one"}, {"id": 2, "name": "two"}], "version": "1", "confidence": 90, "type": "direct", "page_ids": ["p1"], "inferred_from": [],
     "evidence": [piece(), piece(rule_id="r2", pattern="x", confidence=30, version=None, match={"kind": "redacted", "value": None, "truncated": False})]},
    {"name": "B", "categories": [{"id": 1, "name": "one"}], "version": None, "confidence": 80, "type": "inferred", "page_ids": [], "evidence": [], "inferred_from": [{"technology": "A", "rule_id": "i1", "confidence": 80, "version": None}]},
]}
SCHEMA = "technologies array<struct<name:string,categories:array<struct<id:int,name:string>>,version:string,confidence:int,type:string,page_ids:array<string>,evidence:array<struct<collector:string,source:string,page_id:string,key:string,match:struct<kind:string,value:string,truncated:boolean>,rule_id:string,pattern:string,confidence:int,version:string>>,inferred_from:array<struct<technology:string,rule_id:string,confidence:int,version:string>>>>"
E0, T0, T1 = "technologies.0.evidence.0", "technologies.0", "technologies.1"
FAULTS = [
    ("confidence below 1", {f"{T0}.confidence": 0}), ("unknown type", {f"{T0}.type": "odd"}), ("categories out of order", {f"{T0}.categories": [{"id": 2, "name": "two"}, {"id": 1, "name": "one"}]}), ("categories repeated", {f"{T0}.categories": [{"id": 1, "name": "one"}] * 2}),
    ("pages out of order", {f"{T0}.page_ids": ["p2", "p1"]}), ("pages repeated", {f"{T0}.page_ids": ["p1", "p1"]}), ("pages are not those of the record", {f"{T0}.page_ids": ["p7"]}), ("evidence out of order", {f"{E0}.rule_id": "r9"}), ("evidence repeated", {f"{T0}.evidence": [piece(), piece()]}),
    ("evidence disagrees about a rule", {f"{T0}.evidence": [piece(), piece(page_id="p2", confidence=5)]}), ("direct without evidence", {f"{T0}.evidence": []}), ("direct with inferences", {f"{T0}.inferred_from": RECORD["technologies"][1]["inferred_from"]}), ("pages are not those of the evidence", {f"{T0}.page_ids": []}),
    ("confidence is not that of its rules", {f"{T0}.confidence": 91}), ("version is not that of its evidence", {f"{T0}.version": None}), ("inferred without inferences", {f"{T1}.inferred_from": []}), ("confidence is not that of its inferences", {f"{T1}.confidence": 79}), ("version is not that of its inferences", {f"{T1}.version": "1"}),
    ("inference does not win", {f"{T1}.inferred_from": [{"technology": "A", "rule_id": "i1", "confidence": 80, "version": None}, {"technology": "A", "rule_id": "i2", "confidence": 7, "version": None}]}), ("inferences out of order", {f"{T1}.inferred_from": [{"technology": "A", "rule_id": x, "confidence": 80, "version": None} for x in ("i2", "i1")]}),
    ("inferences repeated", {f"{T1}.inferred_from": [{"technology": "A", "rule_id": "i", "confidence": 80, "version": None}] * 2}), ("parent is missing", {f"{T1}.inferred_from.0.technology": "Z"}), ("inference above its parent", {f"{T0}.confidence": 70}), ("name too long", {f"{T0}.name": "x" * 300}),
    ("too many categories", {f"{T0}.categories": [{"id": i, "name": str(i)} for i in range(40)]}), ("version of record too long", {f"{T0}.version": "1" * 70}), ("technologies out of order", {"technologies": RECORD["technologies"][::-1]}), ("technology repeated", {"technologies": RECORD["technologies"][:1] * 2}),
    ("category with several names", {f"{T1}.categories.0.name": "other"}), ("value is hidden but given", {f"{E0}.match.kind": "redacted"}), ("value too long", {f"{E0}.match.value": "x y" * 100}), ("value too long", {f"{E0}.match.truncated": True}), ("value is no sanitised address", {f"{E0}.source": "url"}), ("value is no public host", {f"{E0}.source": "network_hostname"}),
    ("header value is secret", {f"{E0}.match.value": "Bearer abc"}), ("header value is secret", {f"{E0}.key": "set-cookie"}), ("metadata value is secret", {f"{E0}.source": "meta", f"{E0}.match.value": "f" * 16}), ("record value has no form of its type", {f"{E0}.source": "dns_record", f"{E0}.key": "A"}),
    ("version is secret", {f"{E0}.version": "f" * 16}), ("version without visible value", {f"{E0}.match": {"kind": "redacted", "value": None, "truncated": False}}), ("presence with pattern or version", {f"{E0}.match": {"kind": "presence", "value": None, "truncated": False}}), ("probe without path", {f"{E0}.source": "probe", f"{E0}.key": "x?y"}),
    ("pattern too long", {f"{E0}.pattern": "x" * 70_000}), ("version too long", {f"{E0}.version": "1" * 70}),
]


def test_technology_rules(spark):
    df = read(spark, [RECORD] + [changed(RECORD, c) for _, c in FAULTS], SCHEMA)
    found = {}
    for r in V.technology_issues(df, ["i"], F.array(F.lit("p1"), F.lit("p2"))).collect():
        found.setdefault(r.i, set()).add(r.issue)
    assert 0 not in found
    assert [(name, found.get(i)) for i, (name, _) in enumerate(FAULTS, 1) if name not in found.get(i, ())] == []
    none = V.technology_issues(df.limit(1), ["i"], limits=V.LIMITS | {"technologies": 1, "evidence": 1, "inferences": 0, "evidence_per_technology": 1, "inferences_per_technology": 0})
    assert {r.issue for r in none.collect()} == {"too many technologies", "too much evidence in all", "too many inferences in all", "too much evidence", "too many inferences"}


def test_errors(spark):
    records = read(spark, [{"run_id": "r", "domain": "d", "timings": {"http_ms": 1, "dns_ms": None}}], "run_id string, domain string, timings struct<" + ",".join(f"{c}:long" for c in V.STAGES) + ">").drop("i")
    rows = [("d", "http", "HTTP_TIMEOUT", None), ("d", "http", "NO_SUCH", None), ("d", "dns", "HTTP_TIMEOUT", None), ("d", "http", "HTTP_TIMEOUT", "see https://u@h/"), ("e", "http", "HTTP_TIMEOUT", None), ("d", "odd", "DOMAIN_DEADLINE_EXCEEDED", "m")]
    errors = spark.createDataFrame([("r", *r) for r in rows], "run_id string, domain string, stage string, code string, message string")
    got = {(r.domain, r.code, r.issue) for r in V.error_issues(errors, records, ["run_id", "domain"]).collect()}
    assert got == {
        ("d", "NO_SUCH", "code is not registered"), ("d", "HTTP_TIMEOUT", "code of another stage"), ("d", "HTTP_TIMEOUT", "stage has no time"), ("d", "HTTP_TIMEOUT", "message may expose data"), ("e", "HTTP_TIMEOUT", "error of no record"),
        ("d", "DOMAIN_DEADLINE_EXCEEDED", "unknown stage"), ("d", "DOMAIN_DEADLINE_EXCEEDED", "code of another stage"),
    }


def test_empty(spark):
    assert V.validation_issues(read(spark, [FLAT], FLAT_SCHEMA).limit(0)).count() == 0
    assert V.technology_issues(read(spark, [RECORD], SCHEMA).limit(0), ["i"]).count() == 0


@pytest.mark.parametrize("versions, want", [([("r1", 50, "1"), ("r2", 50, "2")], None), ([("r1", 50, "1"), ("r1", 40, "1"), ("r2", 45, "2")], "1"), ([("r1", 5, None)], None), ([], None)])
def test_version_of_evidence(spark, versions, want):
    df = read(spark, [{"e": [{"rule_id": r, "confidence": c, "version": v} for r, c, v in versions]}], "e array<struct<rule_id:string,confidence:int,version:string>>")
    assert df.select(V.direct_version(F.col("e"))).first()[0] == want
