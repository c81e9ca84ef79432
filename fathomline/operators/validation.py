"""Validation of result records: every rule that a record breaks, as texts in an array.

Rules are column expressions, so a record is judged where it lies, in one narrow
pass; rules over its technologies recompute confidence, version, pages and
inferred values from the evidence that the record itself shows. A rule whose
operands are missing is not broken, unless the rule is about what is missing.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import policy
from fathomline.functions.normalize import ascii_hostname, is_public_ipv4
from fathomline.functions.redact import has_credential, has_sensitive_word, is_sensitive, sanitize_url

STAGES = ("target_ms", "robots_ms", "http_ms", "dns_ms", "tls_ms", "browser_ms", "detect_ms")
STATS = ("raw_direct", "gated_direct", "suppressed_direct", "retained_direct")
USAGE = ("http_requests", "browser_requests", "retries", "pages_visited", "probes_issued", "script_bodies_inspected", "static_transferred_bytes", "browser_transferred_bytes")
#: Stages that a successful record must have gone through.
MANDATORY = ("target_ms", "robots_ms", "http_ms", "browser_ms", "detect_ms")
#: Sums over a million records stay exact up to this value a record.
AGGREGATE_UNIT = (2**53 - 1) // 1_000_000
UUID4 = r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
#: Limits of a configuration; a record beyond one of them is not valid under it.
LIMITS = {
    "http_requests": 1_000, "browser_requests": 1_000, "probes_issued": 100, "script_bodies_inspected": 32, "browser_transferred_bytes": 100_000_000, "retries_per_request": 1, "pages": 3,
    "technologies": 5_000, "errors": policy.ERRORS_PER_DOMAIN, "evidence": 50_000, "evidence_per_technology": 5_000, "inferences": 50_000, "inferences_per_technology": 5_000,
    "name_points": 256, "categories_per_technology": 32, "pattern_units": 65_536, "version_units": policy.VERSION_UNITS,
}


def _issues(rules: Mapping[str, Column]) -> Column:
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for text, broken in rules.items()])
    return F.filter(found, lambda x: x.isNotNull())


def flat_rules(limits: Mapping[str, int] = LIMITS) -> dict[str, Column]:
    """The rules over a record's own columns: identity, status, counts, times and usage."""
    s, t, u = F.col("detection_stats"), F.col("timings"), F.col("usage")
    status = F.col("status")
    any_of = lambda columns, test: reduce(lambda a, b: a | b, [F.coalesce(test(c), F.lit(False)) for c in columns])
    stages, stats, usage = [t[c] for c in STAGES], [s[c] for c in STATS], [u[c] for c in USAGE]
    first = u["http_requests"] - u["retries"]
    return {
        "unsupported schema": F.col("schema_version") != 1,
        "no run or domain": F.col("run_id").isNull() | F.col("domain").isNull(),
        "run id is no uuid": ~F.col("run_id").rlike(UUID4),
        "domain is not canonical": F.col("domain").isNotNull() & ~F.coalesce(ascii_hostname(F.col("domain")) == F.col("domain"), F.lit(False)),
        "unknown status": ~status.isin("success", "partial", "failed"),
        "address is not sanitised": F.col("final_url").isNotNull() & ~F.coalesce(sanitize_url(F.col("final_url"))["url"] == F.col("final_url"), F.lit(False)),
        "stats do not add up": s["raw_direct"] != s["gated_direct"] + s["suppressed_direct"] + s["retained_direct"],
        "negative count": any_of([*stats, *usage], lambda c: c < 0),
        "failed record has detections": (status == "failed") & any_of(stats, lambda c: c != 0),
        "failed record has an address": (status == "failed") & F.col("final_url").isNotNull(),
        "failed record has pages": (status == "failed") & (u["pages_visited"] > 0),
        "successful record has no entry page": (status == "success") & (F.col("final_url").isNull() | (u["pages_visited"] < 1)),
        "successful record lacks a stage": (status == "success") & any_of([t[c] for c in MANDATORY], lambda c: c.isNull()),
        "no total time": t["total_ms"].isNull(),
        "negative time": any_of([t["total_ms"], *stages], lambda c: c < 0),
        "stage longer than total": any_of(stages, lambda c: c > t["total_ms"]),
        "detections without detection time": (s["raw_direct"] > 0) & t["detect_ms"].isNull(),
        "browser requests without browser time": (u["browser_requests"] > 0) & t["browser_ms"].isNull(),
        "probes without http time": (u["probes_issued"] > 0) & t["http_ms"].isNull(),
        "retries do not fit requests": (first < 0) | (u["retries"] > first * limits["retries_per_request"]),
        "static bytes without request": (u["static_transferred_bytes"] > 0) & (u["http_requests"] == 0),
        "browser bytes without request": (u["browser_transferred_bytes"] > 0) & (u["browser_requests"] == 0),
        "more probes than requests": u["probes_issued"] > u["http_requests"],
        "total time too large to sum": t["total_ms"] > AGGREGATE_UNIT,
        "usage too large to sum": any_of(usage, lambda c: c > AGGREGATE_UNIT),
        **{f"{c} above its limit": u[c] > limits[c] for c in ("http_requests", "browser_requests", "probes_issued", "script_bodies_inspected", "browser_transferred_bytes")},
        "pages_visited above its limit": u["pages_visited"] > limits["pages"],
    }


def _sorted_unique(array: Column, key) -> tuple[Column, Column]:
    """Whether the keys of neighbours fall, and whether one repeats. Keys are compared as structs, nulls first."""
    keys = F.transform(array, key)
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(keys) - 1, F.lit(1))), lambda i: F.coalesce(F.get(keys, i) < F.get(keys, i - 1), F.lit(False)))
    return (F.size(keys) > 1) & falls, F.size(F.array_distinct(keys)) < F.size(keys)


def _evidence_key(e: Column) -> Column:
    parts = [policy.rank(e["collector"], policy.COLLECTORS), policy.rank(e["source"], policy.EVIDENCE_SOURCES), e["page_id"], e["key"], e["rule_id"], e["match"]["kind"], e["match"]["value"], e["version"]]
    return F.named_struct(*[x for i, p in enumerate(parts) for x in (F.lit(f"o{i}"), p)])


def direct_confidence(evidence: Column) -> Column:
    """The rules' highest confidences added, at most 100."""
    rules = F.array_distinct(F.transform(evidence, lambda e: e["rule_id"]))
    best = F.transform(rules, lambda r: F.array_max(F.transform(F.filter(evidence, lambda e: e["rule_id"].eqNullSafe(r)), lambda e: e["confidence"])))
    return F.least(F.lit(100), F.aggregate(best, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))))


def direct_version(evidence: Column) -> Column:
    """The version with the highest sum of its rules' highest confidences, if it is alone."""
    versions = F.array_distinct(F.filter(F.transform(evidence, lambda e: e["version"]), lambda v: v.isNotNull()))
    weighed = F.transform(versions, lambda v: F.named_struct(F.lit("w"), direct_weight(F.filter(evidence, lambda e: e["version"] == v)), F.lit("v"), v))

    def pick(weighed: Column) -> Column:
        top = F.filter(weighed, lambda x: x["w"] == F.array_max(F.transform(weighed, lambda y: y["w"])))
        return F.when(F.size(top) == 1, top[0]["v"])

    return F.transform(F.array(weighed), pick)[0]


def direct_weight(evidence: Column) -> Column:
    rules = F.array_distinct(F.transform(evidence, lambda e: e["rule_id"]))
    best = F.transform(rules, lambda r: F.array_max(F.transform(F.filter(evidence, lambda e: e["rule_id"].eqNullSafe(r)), lambda e: e["confidence"])))
    return F.aggregate(best, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def evidence_rules(e: Column) -> dict[str, Column]:
    """The rules over one piece of evidence: its value may show nothing secret and must have the form of its source."""
    value, source, key = e["match"]["value"], e["source"], e["key"]
    shown = (e["match"]["kind"] == "value") & value.isNotNull()
    return {
        "value is hidden but given": (e["match"]["kind"] != "value") & value.isNotNull(),
        "value too long": shown & ((F.char_length(value) > policy.MATCH_POINTS) | (e["match"]["truncated"] & (F.char_length(value) != policy.MATCH_POINTS))),
        "value is no sanitised address": shown & source.isin(*policy.URL_SOURCES) & ~F.coalesce(sanitize_url(value)["url"] == value, F.lit(False)),
        "value is no public host": shown & (source == "network_hostname") & ~F.coalesce(ascii_hostname(value) == value, F.lit(False)),
        "header value is secret": shown & (source == "header") & (has_sensitive_word(F.coalesce(F.lower(key), F.lit("")), policy.SENSITIVE_HEADER_WORDS) | has_credential(value) | is_sensitive(value)),
        "metadata value is secret": shown & (source == "meta") & (has_credential(value) | is_sensitive(value)),
        "record value has no form of its type": shown & (source == "dns_record") & F.when(key == "A", ~F.coalesce(is_public_ipv4(value), F.lit(False))).when(key == "AAAA", F.lit(False)).otherwise(~F.coalesce(ascii_hostname(value) == value, F.lit(False))),
        "version is secret": is_sensitive(e["version"]),
        "version without visible value": e["version"].isNotNull() & ~shown,
        "presence with pattern or version": (e["match"]["kind"] == "presence") & (e["pattern"].isNotNull() | e["version"].isNotNull()),
        "probe without path": (source == "probe") & (key.isNull() | ~key.rlike(r"\A/[^\s?#\\]*\z")),
        "pattern too long": F.char_length(e["pattern"]) > LIMITS["pattern_units"],
        "version too long": F.char_length(e["version"]) > LIMITS["version_units"],
    }


def technology_rules(t: Column, pages: Column, limits: Mapping[str, int] = LIMITS) -> dict[str, Column]:
    """The rules over one technology of a record; pages: ids of the record's pages (null: not checked)."""
    direct = t["type"] == "direct"
    evidence, parents = F.coalesce(t["evidence"], F.array()), F.coalesce(t["inferred_from"], F.array())
    falls, repeats = {}, {}
    for name, array, key in (("categories", t["categories"], lambda c: c["id"]), ("pages", t["page_ids"], lambda p: p), ("evidence", evidence, _evidence_key), ("inferences", parents, lambda p: F.named_struct(F.lit("t"), p["technology"], F.lit("r"), p["rule_id"]))):
        falls[name], repeats[name] = _sorted_unique(array, key)
    missing = lambda ids: F.size(F.array_except(ids, pages)) > 0
    seen = F.array_sort(F.array_distinct(F.filter(F.transform(evidence, lambda e: e["page_id"]), lambda p: p.isNotNull())))
    meta = lambda e: F.named_struct(F.lit("s"), e["source"], F.lit("k"), F.when(e["source"] != "cookie", e["key"]), F.lit("p"), e["pattern"], F.lit("c"), e["confidence"])
    facts = F.array_distinct(F.transform(evidence, lambda e: F.named_struct(F.lit("r"), e["rule_id"], F.lit("m"), meta(e))))
    versions = F.array_distinct(F.filter(F.transform(parents, lambda p: p["version"]), lambda v: v.isNotNull()))
    inferred_version = F.when(F.size(versions) == 1, versions[0])
    best = F.coalesce(F.array_max(F.transform(parents, lambda p: p["confidence"])), F.lit(0))
    return {
        "confidence below 1": t["confidence"] < 1,
        "unknown type": ~t["type"].isin("direct", "inferred"),
        **{f"{n} out of order": x for n, x in falls.items()},
        **{f"{n} repeated": x for n, x in repeats.items()},
        "pages are not those of the record": missing(F.coalesce(t["page_ids"], F.array())) | missing(seen),
        "evidence disagrees about a rule": F.size(F.array_distinct(F.transform(facts, lambda x: x["r"]))) < F.size(facts),
        "direct without evidence": direct & (F.size(evidence) == 0),
        "direct with inferences": direct & (F.size(parents) > 0),
        "pages are not those of the evidence": direct & (seen != F.coalesce(t["page_ids"], F.array())),
        "confidence is not that of its rules": direct & (direct_confidence(evidence) != t["confidence"]),
        "version is not that of its evidence": direct & ~direct_version(evidence).eqNullSafe(t["version"]),
        "inferred without inferences": ~direct & (F.size(parents) == 0),
        "confidence is not that of its inferences": ~direct & (best != t["confidence"]),
        "version is not that of its inferences": ~direct & ~inferred_version.eqNullSafe(t["version"]),
        "inference does not win": ~direct & F.exists(parents, lambda p: p["confidence"] != t["confidence"]),
        "name too long": F.char_length(t["name"]) > limits["name_points"],
        "too many categories": F.size(t["categories"]) > limits["categories_per_technology"],
        "too much evidence": F.size(evidence) > limits["evidence_per_technology"],
        "too many inferences": F.size(parents) > limits["inferences_per_technology"],
        "version of record too long": F.char_length(t["version"]) > limits["version_units"],
    }


def technology_issues(records: DataFrame, keys: list[str], pages: Column | None = None, limits: Mapping[str, int] = LIMITS) -> DataFrame:
    """keys, technology, issue of the technologies of records (column ``technologies``, an array of structs).

    Covers each technology, its evidence, and what the technologies of a record
    say of each other: order, repetition, parents that are missing or weaker,
    categories with several names, and totals.
    """
    pages = F.lit(None).cast("array<string>") if pages is None else pages
    slim = records.select(*keys, "technologies", pages.alias("_pages"))
    own = slim.select(*keys, F.explode("technologies").alias("t"), "_pages", F.transform("technologies", lambda t: F.named_struct(F.lit("n"), t["name"], F.lit("c"), t["confidence"])).alias("_all"))
    parents = F.coalesce(F.col("t")["inferred_from"], F.array())
    named = lambda p: F.filter(F.col("_all"), lambda x: x["n"] == p["technology"])
    rules = technology_rules(F.col("t"), F.col("_pages"), limits) | {
        "parent is missing": F.exists(parents, lambda p: F.size(named(p)) == 0),
        "inference above its parent": F.exists(parents, lambda p: F.exists(named(p), lambda x: p["confidence"] > x["c"])),
    }
    single = own.select(*keys, F.col("t")["name"].alias("technology"), F.explode(_issues(rules)).alias("issue"))
    pieces = own.select(*keys, F.col("t")["name"].alias("technology"), F.explode(F.col("t")["evidence"]).alias("e"))
    of_evidence = pieces.select(*keys, "technology", F.explode(_issues(evidence_rules(F.col("e")))).alias("issue")).distinct()
    falls, repeats = _sorted_unique(F.col("technologies"), lambda t: t["name"])
    categories = F.array_distinct(F.flatten(F.transform("technologies", lambda t: F.coalesce(t["categories"], F.array()))))
    count = lambda c: F.aggregate("technologies", F.lit(0), lambda n, t: n + F.coalesce(F.size(t[c]), F.lit(0)))
    whole = {
        "technologies out of order": falls, "technology repeated": repeats, "category with several names": F.size(F.array_distinct(F.transform(categories, lambda c: c["id"]))) < F.size(categories),
        "too many technologies": F.size("technologies") > limits["technologies"], "too much evidence in all": count("evidence") > limits["evidence"], "too many inferences in all": count("inferred_from") > limits["inferences"],
    }
    of_record = slim.select(*keys, F.lit(None).cast("string").alias("technology"), F.explode(_issues(whole)).alias("issue"))
    return single.unionByName(of_evidence).unionByName(of_record)


def error_issues(errors: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, issue of the errors of records: codes not registered, of another stage, of a stage without time, messages that show too much.

    errors: keys, stage, code, message; records: keys, timings.
    """
    stages = F.create_map(*[x for code, allowed in policy.ERROR_CODES.items() for x in (F.lit(code), F.array(*[F.lit(s) for s in allowed]))])
    allowed = F.try_element_at(stages, F.col("code"))
    time = reduce(lambda c, s: c.when(F.col("stage") == s, F.col("timings")[f"{s}_ms"]), policy.ERROR_STAGES[1:], F.when(F.col("stage") == policy.ERROR_STAGES[0], F.col("timings")[f"{policy.ERROR_STAGES[0]}_ms"]))
    rules = {
        "code is not registered": allowed.isNull(),
        "unknown stage": ~F.col("stage").isin(*policy.ERROR_STAGES),
        "code of another stage": allowed.isNotNull() & ~F.array_contains(allowed, F.col("stage")),
        "stage has no time": F.col("stage").isin(*policy.ERROR_STAGES) & F.col("timings").isNotNull() & time.isNull(),
        "message may expose data": is_sensitive(F.col("message")) | F.col("message").rlike(r"(?i)https?://[^\s/]*@|https?://\S*[?#]"),
        "error of no record": F.col("timings").isNull(),
    }
    joined = errors.join(records.select(*keys, "timings"), keys, "left")
    return joined.select(*keys, "code", F.explode(_issues(rules)).alias("issue")).distinct()


def validation_issues(records: DataFrame, limits: Mapping[str, int] = LIMITS) -> DataFrame:
    """Add ``issues``: the flat rules that a result record breaks (an empty array for a valid one)."""
    return records.withColumn("issues", _issues(flat_rules(limits)))
