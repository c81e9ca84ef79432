"""Queries of run results and of the evaluation of cheaper collection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import policy
from fathomline.functions.policy import sql_rank
from fathomline.functions.text import present, same_value, sql_same_value
from fathomline.operators import evaluation as ev
from fathomline.operators import results, validation
from fathomline.plans.signals import SQL_EV, SQL_DIRECT, nested_records, revision_edges, sql_resolved
from fathomline.session import materialize, read_table

RECORD = ["run_id", "domain"]
SALT = "fold-1"
#: Limits that the data reach.
TIGHT = validation.LIMITS | {"http_requests": 20, "browser_requests": 100, "probes_issued": 2, "script_bodies_inspected": 1, "browser_transferred_bytes": 2_000_000, "pages": 2}


def _records(spark, folder) -> DataFrame:
    return results.latest_records(read_table(spark, folder, "domain_results"))


def _evidence(spark, folder) -> DataFrame:
    e = results.latest_in_place(read_table(spark, folder, "evidence"), ["evidence_id"])
    return e.withColumn("technology", present(F.col("technology"))).where("technology IS NOT NULL")


def _errors(spark, folder) -> DataFrame:
    e = results.latest_in_place(read_table(spark, folder, "scan_errors"), ["error_id"])
    return e.withColumn("code", F.upper(present(F.col("code")))).where("code IS NOT NULL")


def technology_frequency(spark, folder):
    return results.technology_frequency(_evidence(spark, folder), RECORD)


def run_summary(spark, folder):
    return results.run_summary(_records(spark, folder))


def attribution(spark, folder):
    return results.attribution(_evidence(spark, folder), RECORD)


def error_groups(spark, folder):
    return results.error_groups(_errors(spark, folder))


def diagnostics(spark, folder):
    """Grouped errors of each record: stage, code, whether a retry may help, and how many."""
    return results.diagnostics(_errors(spark, folder), RECORD)


def hard_limits(spark, folder):
    e = _errors(spark, folder).where(results.is_hard_limit(F.col("code")))
    return e.groupBy("run_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("domain").alias("domains"))


def limit_hits(spark, folder):
    e = _errors(spark, folder).where("limit_name IS NOT NULL").select(F.col("limit_name").alias("category"), F.col("stage").alias("ordinal"), "domain", "page_id")
    return ev.limit_hits(e)


def bound_errors(spark, folder):
    """Errors of a record, cut at three (a limit that the data reach) with a marker."""
    return results.bound_errors(_errors(spark, folder), RECORD, 3)


def validation_issues(spark, folder):
    """The flat rules that records break, under limits that the data reach."""
    return validation.validation_issues(_records(spark, folder), TIGHT).select(*RECORD, F.explode("issues").alias("issue"))


def error_issues(spark, folder):
    """Errors whose code, stage, time or message is not valid; every fourth stage is made another one."""
    e = _errors(spark, folder).withColumn("stage", F.when(F.col("error_id") % 4 == 0, "detect").otherwise(F.col("stage")))
    return validation.error_issues(e.where("stage IS NOT NULL"), _records(spark, folder), RECORD)


def technology_issues(spark, folder):
    """Records with planted faults: of each record some technologies get another confidence, version, pages, type or order."""
    place = lambda f: F.transform("technologies", lambda t, i: f(t, i))

    def spoil(t, i):
        t = t.withField("confidence", F.when(i % 5 == 1, F.pmod(t["confidence"], F.lit(100)) + 1).otherwise(t["confidence"])).withField("version", F.when(i % 5 == 2, F.lit("9.9.9")).otherwise(t["version"]))
        return t.withField("page_ids", F.when(i % 5 == 3, F.array(F.lit("p9"))).otherwise(t["page_ids"]))

    spoiled = nested_records(spark, folder).withColumn("technologies", place(spoil))
    both = F.concat("technologies", F.slice("technologies", 1, F.when(F.char_length("domain") % 3 == 0, 1).otherwise(0)))
    return validation.technology_issues(spoiled.withColumn("technologies", both), RECORD).where(F.col("issue").isin(*PLANTED))


PLANTED = ("confidence is not that of its rules", "confidence is not that of its inferences", "version is not that of its evidence", "version is not that of its inferences", "pages are not those of the evidence", "technology repeated", "technologies out of order")


def recomputed_technologies(spark, folder):
    """Issues of the records as the engine builds them: what their evidence, as delivered, does not support."""
    return validation.technology_issues(nested_records(spark, folder), RECORD)


def top_technologies(spark, folder):
    """Technologies by the domains that have them, directly or by implication."""
    rows = nested_records(spark, folder).select("domain", F.explode("technologies").alias("t")).select("domain", F.col("t.name").alias("name"), F.col("t.type").alias("type"))
    return results.top_technologies(rows)


def domain_status(spark, folder):
    """Status from errors and signals, beside the stated one."""
    n = _errors(spark, folder).groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n_errors"))
    r = _records(spark, folder).join(n, RECORD, "left")
    signal = (F.col("detection_stats.raw_direct") > 0) | F.col("final_url").isNotNull()
    weak = F.coalesce(F.startswith("final_url", F.lit("http:")), F.lit(False))
    return r.select(*RECORD, "status", results.domain_status(F.coalesce("n_errors", F.lit(0)), signal, weak).alias("computed"))


def response_outcomes(spark, folder):
    """Outcome of every status code, with and without an HTML body."""
    rows = read_table(spark, folder, "orders").select(F.pmod(F.col("o_orderkey"), F.lit(700)).cast("int").alias("status"), (F.pmod(F.col("o_custkey"), F.lit(2)) == 0).alias("internal"), F.when(F.pmod(F.col("o_custkey"), F.lit(3)) > 0, "text/html").alias("media")).distinct()
    return rows.withColumn("outcome", results.response_outcome(F.col("status"), F.col("media"), F.col("internal")))


def stated_detections(spark, folder):
    """Records whose stated number of retained detections is not what their evidence holds."""
    seen = _evidence(spark, folder).groupBy(*RECORD).agg(F.countDistinct("technology").alias("n"))
    stated = _records(spark, folder).select(*RECORD, F.col("detection_stats.retained_direct").alias("n"))
    out = results.check_detections(stated, seen, RECORD, ["n"])
    return out.select(*RECORD, F.col("stated.n").alias("stated"), F.col("recomputed.n").alias("recomputed"))


def resume_antijoin(spark, folder):
    """Scanned domains that have no raw record yet."""
    done = read_table(spark, folder, "result_records").select(*RECORD).distinct()
    return _records(spark, folder).select(*RECORD).join(done, RECORD, "left_anti")


LIMITS = {"http_requests": 20, "browser_requests": 100, "pages_visited": 2, "retries": 1}


def limit_issues(spark, folder):
    """Records whose usage is above (tight) limits."""
    return results.limit_issues(_records(spark, folder), LIMITS).select(*RECORD, F.explode("limit_issues").alias("counter"))


def document_classes(spark, folder):
    rows = read_table(spark, folder, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey"), F.lit(700)).cast("int").alias("status"), (F.pmod(F.col("o_custkey"), F.lit(2)) == 0).alias("same_site"))
    return rows.select("o_orderkey", results.document_class(F.col("status"), F.col("same_site"), F.lit(True)).alias("class"))


# --- evaluation -------------------------------------------------------------------

SALTS = {"tie": "score-tie", "control": "more", "random": "controls", "label": "label-tie"}
COSTS = ["pages_visited", "http_requests", "browser_requests", "browser_transferred_bytes", "browser_ms"]
NUMBERS = ["http_requests", "probes_issued", "static_transferred_bytes"]
WORDS = ["scan_mode", "scheme"]
EARLY_STAGES = {"t1": ("target", "http", "dns", "tls"), "t2": ("target", "robots", "http", "dns", "tls")}


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.concat_ws("/", *RECORD))


def _snapshots(spark, folder) -> DataFrame:
    return _key(_records(spark, folder))


def _folds(spark, folder) -> DataFrame:
    return _snapshots(spark, folder).select("key", ev.fold(SALT, F.col("key")).alias("fold"))


def _detected(spark, folder) -> DataFrame:
    """The detector's result on each prefix of the observations of every record."""
    e = _key(_evidence(spark, folder).withColumn("rule_id", present(F.col("rule_id")))).drop(*RECORD)
    revisions = _snapshots(spark, folder).select("key", F.col("catalog_revision").alias("revision"))
    return ev.detector_views(e.join(revisions.select("key"), "key", "left_semi"), revisions, revision_edges(spark, folder), ["key"])


def _packed(spark, folder, revisions: DataFrame | None = None) -> DataFrame:
    """One row per record with the direct technologies of its views, written once."""
    rows = read_table(spark, folder, "evidence")
    e = _key(results.latest_in_place(rows, ["evidence_id"])).drop(*RECORD)
    if revisions is None:
        revisions = materialize(_snapshots(spark, folder).select("key", F.col("catalog_revision").alias("revision")), "records")[0]
    return materialize(ev.packed_views(e, revisions, revision_edges(spark, folder), spelling=present, deliveries=rows), "packed")[0]


def _views(spark, folder) -> DataFrame:
    """key, view, name of the direct technologies."""
    return ev.long_views(_packed(spark, folder))


def detector_views(spark, folder):
    """Direct and implied technologies of every record on each prefix of its observations."""
    return _detected(spark, folder).select("key", "view", "technology", "type", "raw_direct", "gated_direct", "suppressed_direct", "retained_direct")


def _cases(spark, folder, categorised: bool = False) -> DataFrame:
    """Cases: every record with its fold, tokens, the names of t2 and the full view, and category tokens if asked for; written once."""
    records = _snapshots(spark, folder).select("key", ev.fold(SALT, F.col("key")).alias("fold"), (F.col("status") == "failed").alias("failed"), *[F.col(f"usage.{c}").alias(c) for c in NUMBERS], "scan_mode", F.regexp_extract("final_url", "^[a-z]+", 0).alias("scheme"), F.col("catalog_revision").alias("revision"))
    records, _, _ = materialize(records, "records")
    packed = _packed(spark, folder, records.select("key", "revision"))
    e = _key(_errors(spark, folder)).where(F.col("stage").isin(*{x for stages in EARLY_STAGES.values() for x in stages}))
    groups = results.diagnostics(e, ["key"])
    what = F.concat_ws(":", "stage", "code", F.col("retryable").cast("string"))
    of_views = F.filter(F.array(*[F.when(F.col("stage").isin(*stages), F.lit(v)) for v, stages in EARLY_STAGES.items()]), lambda v: v.isNotNull())
    errors = groups.select("key", F.explode(of_views).alias("view"), what.alias("what"), "n").groupBy("key").agg(F.collect_list(F.struct("view", "what", "n")).alias("errors"))
    rows = records.join(packed, "key", "left").join(errors, "key", "left")
    if categorised:
        cheap = packed.select("key", F.explode("t2").alias("name"))
        known = F.broadcast(_categories(spark, folder, cheap))
        more = cheap.join(known, "name").groupBy("key").agg(F.collect_set(F.concat(F.lit("t2.category="), F.col("category").cast("string"))).alias("categories"))
        rows = rows.join(more, "key", "left")
    none = F.array().cast("array<string>")
    tokens = ev.case_tokens(rows, NUMBERS, WORDS, results.STATUS_STATS)
    return materialize(rows.select("key", "fold", tokens.alias("tokens"), *[F.coalesce(c, none).alias(c) for c in ("t2", "full", *["categories"] * categorised)]), "cases")[0]


def _costs(spark, folder) -> DataFrame:
    return _snapshots(spark, folder).select("key", *[F.coalesce(F.col(f"{'timings' if c == 'browser_ms' else 'usage'}.{c}"), F.lit(0)).alias(c) for c in COSTS])


def _categories(spark, folder, names: DataFrame) -> DataFrame:
    """Categories of every name; names that the catalog lacks have category 0, so that none goes unmapped unseen."""
    known = read_table(spark, folder, "technologies").select(same_value("name").alias("name"), F.explode("categories").alias("c")).select("name", F.col("c.id").alias("category")).distinct()
    return known.unionByName(ev.unmapped_names(names.select("name").distinct(), known).select("name", F.lit(0).alias("category")))


def fold_assign(spark, folder):
    return _folds(spark, folder)


def count_bins(spark, folder):
    return _snapshots(spark, folder).select("key", ev.power_bin(F.col("usage.browser_transferred_bytes")).alias("bytes_bin"), ev.power_bin(F.col("usage.retries")).alias("retries_bin"))


def feature_tokens(spark, folder):
    return _cases(spark, folder).select("key", F.explode("tokens").alias("token"))


def lift_targets(spark, folder):
    return ev.pair_targets(_views(spark, folder), _folds(spark, folder))


def _model(spark, folder) -> ev.Model:
    return ev.train_cases(_cases(spark, folder))


def token_model(spark, folder):
    """Sums of every token without each fold: domains, pair lift, names of one domain."""
    return _model(spark, folder).tokens


def recurring_model(spark, folder):
    """Sums of every token and recurring name without each fold."""
    return _model(spark, folder).recurring


def name_heads(spark, folder):
    """Names that no training domain shows before the full view, with their support, without each fold."""
    views = _views(spark, folder)
    return ev.name_heads(ev.name_counts(views, _folds(spark, folder)), _folds(spark, folder).select(F.col("fold").alias("held_out")).distinct())


def training_objectives(spark, folder):
    views, folds = _views(spark, folder), _folds(spark, folder)
    out = ev.objectives(ev.name_counts(views, folds), ev.pair_targets(views, folds), folds.select(F.col("fold").alias("held_out")).distinct())
    return out.select("held_out", "domains", "pair_sum", "rare_sum", "pair_deficit", "name_deficit")


def oof_scores(spark, folder):
    """Predictions and worth of every record by the model that has not seen its fold."""
    model = _model(spark, folder)
    out = ev.scores(model, ev.predict_cases(model, model.cases))
    return out.select("key", "fold", "matched", *[F.round(c, 6).alias(c) for c in ("pair_lift", "rare_novelty", "expected", "score")])


def quotas_largest_remainder(spark, folder):
    return ev.fold_quotas(_folds(spark, folder).groupBy("fold").agg(F.count(F.lit(1)).alias("n")))


def hash_sample(spark, folder):
    return ev.hash_sample(_folds(spark, folder), SALTS["random"], "key", ev.MOST_SELECTED).select("key")


def greedy_selection(spark, folder):
    """The greedy choice of domains in each fold, with their worth when chosen."""
    model = _model(spark, folder)
    out = ev.greedy_selection(model, ev.predict_cases(model, model.cases), quotas_largest_remainder(spark, folder), SALTS["tie"])
    return out.select("fold", "key", "place", F.round("score", 6).alias("score"))


def label_aware_selection(spark, folder):
    """The choice by one who knows the full views, step by step."""
    return ev.label_aware_selection(_views(spark, folder), ev.MOST_SELECTED, SALTS["label"])


def control_sample(spark, folder):
    """Controls of each fold besides the triggered domains."""
    return ev.select_cases(_cases(spark, folder), SALTS).where("source = 'control'").select("fold", "key")


def _hash_arm(spark, folder) -> DataFrame:
    return hash_sample(spark, folder).withColumn("arm", F.lit("random"))


def retention_metrics(spark, folder):
    """What the random selection keeps."""
    r = ev.selection_metrics(_views(spark, folder), _hash_arm(spark, folder), _costs(spark, folder), COSTS)
    return r.select("pairs", "pairs_kept", "names", "names_kept", F.round("macro_technology", 6).alias("macro_technology"), F.round("macro_domain", 6).alias("macro_domain"), "extra_names", "extra_pairs")


def cost_guardrails(spark, folder):
    """Costs of the random selection and the verdict over retention and costs."""
    out = ev.verdict(ev.selection_metrics(_views(spark, folder), _hash_arm(spark, folder), _costs(spark, folder), COSTS), COSTS)
    return out.select("domains_full", "domains_selected", *[c for m in COSTS for c in (f"{m}_full", f"{m}_selected")], "accepted")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("arm", "pairs", "pairs_kept", "names", "names_kept", F.round("macro_technology", 6).alias("macro_technology"), F.round("macro_domain", 6).alias("macro_domain"), "extra_pairs", "domains_selected", *[f"{m}_selected" for m in COSTS], "accepted")


def development_report(spark, folder):
    """Metrics and verdicts of the model's selection, a random one and the label-aware one."""
    return _shown(ev.development_report(_cases(spark, folder), _costs(spark, folder), COSTS, SALTS))


def _arms(spark, folder) -> dict[str, DataFrame]:
    """The cases without and with category tokens."""
    cases = _cases(spark, folder, categorised=True)
    return {"baseline": cases, "category": cases.withColumn("tokens", F.concat("tokens", "categories"))}


def fold_wins(spark, folder):
    """Outcomes of the triggered domains of both arms in each fold, and whether the one with category tokens won."""
    arms = _arms(spark, folder)
    chosen = ev.chosen_of_arms(arms, SALTS).where("source = 'trigger'")
    targets = arms["baseline"].select("key", F.size(F.array_except("full", "t2")).cast("long").alias("target"))
    return ev.fold_wins(ev.fold_outcomes(ev.case_sides(arms["baseline"]), chosen, targets), "baseline", "category")


def paired_report(spark, folder):
    """Decision between the arms without and with category tokens."""
    return ev.paired_report(_arms(spark, folder), _costs(spark, folder), COSTS, SALTS)


def frozen_report(spark, folder):
    """The verdict on domains that took no part in training: two fifths of all, judged by the model of the others."""
    cases = _cases(spark, folder).withColumn("fold", (F.col("fold") >= 3).cast("int"))
    return _shown(ev.frozen_report(cases, _costs(spark, folder), COSTS, SALTS))


def category_tokens(spark, folder):
    """Category tokens of the second view; category 0 stands for names that the catalog lacks."""
    cheap = _views(spark, folder).where("view = 't2'").select("key", "name")
    return ev.category_tokens(cheap, _categories(spark, folder, cheap), "key")


def category_gaps(spark, folder):
    """Names of the second view without category entry, for which the strict form of category tokens raises, and their domains."""
    cheap = _views(spark, folder).where("view = 't2'").select("key", "name")
    known = read_table(spark, folder, "technologies").select(same_value("name").alias("name"))
    return ev.unmapped_names(cheap, known).groupBy("name").agg(F.count(F.lit(1)).alias("domains"))


def training_deficits(spark, folder):
    views = _views(spark, folder)
    return ev.training_deficits(*[views.where(F.col("view") == v) for v in ("full", "t2")], "key")


NAMES = [
    technology_frequency, run_summary, attribution, error_groups, hard_limits, limit_hits, bound_errors, validation_issues, error_issues, technology_issues, recomputed_technologies, top_technologies, domain_status, response_outcomes, stated_detections, resume_antijoin, limit_issues, document_classes,
    detector_views, category_tokens, category_gaps, training_deficits, training_objectives, control_sample, fold_assign, count_bins, feature_tokens, lift_targets, name_heads, token_model, recurring_model, oof_scores,
    quotas_largest_remainder, hash_sample, greedy_selection, label_aware_selection, retention_metrics, cost_guardrails, development_report, fold_wins, paired_report, frozen_report, diagnostics,
]
QUERIES = {f.__name__: f for f in NAMES}

_SQL = f"""rec AS (SELECT * FROM domain_results QUALIFY row_number() OVER (PARTITION BY run_id, domain ORDER BY ingested_at DESC) = 1),
e AS (SELECT * FROM (SELECT * REPLACE ({sql_same_value("technology")} AS technology) FROM evidence QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at DESC) = 1) WHERE length(technology) > 0),
err AS (SELECT * FROM (SELECT * REPLACE (upper({sql_same_value("code")}) AS code) FROM scan_errors QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY ingested_at DESC) = 1) WHERE length(code) > 0)"""
# Gates are met step by step: what is available grows until nothing new comes in.
_SQL_VIEWS = f"""{_SQL},
snap AS (SELECT run_id || '/' || domain AS key, *, CAST(('0x' || substr(sha256('{SALT}' || chr(0) || run_id || '/' || domain), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM rec),
tiered AS (SELECT run_id || '/' || domain AS key, technology, {sql_same_value("rule_id")} AS rule, confidence, CASE WHEN collector IN ('dns', 'tls') THEN 1 WHEN collector = 'http' AND source IN ('probe', 'robots') THEN 2
  WHEN collector = 'http' AND coalesce(page_id, 'p1') = 'p1' THEN 1 WHEN collector = 'http' AND page_id = 'p2' THEN 2 ELSE 3 END AS tier FROM e WHERE length({sql_same_value("rule_id")}) > 0),
direct AS (SELECT t.key, s.catalog_revision AS revision, v.view, technology AS name FROM tiered t JOIN snap s USING (key) JOIN (VALUES ('t1', 1), ('t2', 2), ('full', 3)) AS v(view, n) ON tier <= n GROUP BY 1, 2, 3, 4 HAVING max(confidence) > 0),
edges AS (SELECT DISTINCT revision, kind, {sql_same_value("name")} AS name, {sql_same_value("target")} AS target FROM (SELECT revision, 'implies' AS kind, name, target FROM tech_implies UNION ALL SELECT revision, 'requires', name, target FROM tech_requires)
  WHERE length({sql_same_value("target")}) > 0 AND {sql_same_value("target")} <> {sql_same_value("name")}),
needs AS MATERIALIZED (SELECT d.key, d.view, d.name, g.target FROM direct d JOIN edges g ON g.revision = d.revision AND g.kind = 'requires' AND g.name = d.name),
gives AS MATERIALIZED (SELECT DISTINCT revision, name, target FROM edges WHERE kind = 'implies'),
available AS (
  SELECT d.key, d.view, d.revision, d.name FROM direct d WHERE NOT EXISTS (SELECT 1 FROM needs n WHERE n.key = d.key AND n.view = d.view AND n.name = d.name)
  UNION (SELECT a.key, a.view, a.revision, g.target FROM available a JOIN gives g ON g.revision = a.revision AND g.name = a.name UNION ALL SELECT a.key, a.view, a.revision, n.name FROM available a JOIN needs n ON n.key = a.key AND n.view = a.view AND n.target = a.name)),
views AS MATERIALIZED (SELECT d.key, d.view, d.name FROM direct d WHERE NOT EXISTS (SELECT 1 FROM needs n WHERE n.key = d.key AND n.view = d.view AND n.name = d.name)
  OR EXISTS (SELECT 1 FROM needs n JOIN available a ON a.key = n.key AND a.view = n.view AND a.name = n.target WHERE n.key = d.key AND n.view = d.view AND n.name = d.name)),
sides AS MATERIALIZED (SELECT key, name, max((view = 't2')::INT) AS cheap, max((view = 'full')::INT) AS filled FROM views WHERE view IN ('t2', 'full') GROUP BY 1, 2),
target AS (SELECT s.key, s.fold, count(x.name) AS target FROM snap s LEFT JOIN (SELECT * FROM sides WHERE filled = 1 AND cheap = 0) x USING (key) GROUP BY 1, 2),
randoms AS (SELECT key FROM snap ORDER BY sha256('{SALTS["random"]}' || chr(0) || key), key LIMIT {ev.MOST_SELECTED})"""


def _bin(x: str) -> str:
    # Binary digits instead of a logarithm: exact at powers of two.
    k = f"(length(ltrim(CAST(({x})::BIGINT::BIT AS VARCHAR), '0')) - 1)"
    return f"CASE WHEN {x} IN (0, 1) THEN ({x})::VARCHAR WHEN {x} > 1 THEN (1::BIGINT << {k}) || '-' || (2 * (1::BIGINT << {k}) - 1) END"


def _sql_union(parts: list[str]) -> str:
    return " UNION ".join(parts)


_SQL_TOKENS = f"""{_SQL_VIEWS},
state AS (SELECT key, v AS view, status = 'failed' AS failed FROM snap, (VALUES ('t1'), ('t2')) AS t(v)),
shown AS (SELECT w.* FROM views w JOIN state s ON s.key = w.key AND s.view = w.view AND NOT failed),
stats AS (SELECT s.key, s.view, count(d.name) AS raw_direct, count(d.name) - count(w.name) AS gated_direct, 0 AS suppressed_direct, count(w.name) AS retained_direct FROM state s LEFT JOIN direct d ON d.key = s.key AND d.view = s.view LEFT JOIN views w ON w.key = d.key AND w.view = d.view AND w.name = d.name WHERE NOT failed GROUP BY 1, 2),
more AS (SELECT key, name FROM shown WHERE view = 't2' EXCEPT SELECT key, name FROM shown WHERE view = 't1'),
faults AS (SELECT run_id || '/' || domain AS key, view, stage || ':' || code || ':' || retryable AS what, count(*) AS n FROM err JOIN (VALUES {", ".join(f"('{v}', '{x}')" for v, stages in EARLY_STAGES.items() for x in stages)}) AS t(view, known) ON stage = known GROUP BY 1, 2, 3),
tokens AS MATERIALIZED ({_sql_union([
    "SELECT key, view || '.state=' || CASE WHEN failed THEN 'unavailable' ELSE 'available' END AS token FROM state", "SELECT key, view || '.reason=failed' FROM state WHERE failed",
    "SELECT key, view || '.direct=' || CAST(to_json(name) AS VARCHAR) FROM shown", f"SELECT key, view || '.direct.count=' || {_bin('retained_direct')} FROM stats",
    *[f"SELECT key, view || '.detection.{c}=' || {_bin(c)} FROM stats" for c in results.STATUS_STATS],
    "SELECT f.key, f.view || '.error=' || what FROM faults f JOIN state s ON s.key = f.key AND s.view = f.view AND NOT failed", f"SELECT f.key, f.view || '.error.count=' || what || ':' || {_bin('n')} FROM faults f JOIN state s ON s.key = f.key AND s.view = f.view AND NOT failed",
    "SELECT key, 't2.incrementalDirect=' || CAST(to_json(name) AS VARCHAR) FROM more", f"SELECT key, 't2.incrementalDirect.count=' || {_bin('n')} FROM (SELECT s.key, count(m.name) AS n FROM snap s LEFT JOIN more m USING (key) WHERE status <> 'failed' GROUP BY 1)",
    *[f"SELECT key, 'preBrowser.{c}=' || {_bin(f'usage.{c}')} FROM snap WHERE usage.{c} >= 0" for c in NUMBERS],
    "SELECT key, 'preBrowser.scan_mode=' || coalesce(scan_mode, 'null') FROM snap", "SELECT key, 'preBrowser.scheme=' || coalesce(regexp_extract(final_url, '^[a-z]+'), 'null') FROM snap",
])})"""
_SQL_HEADS = """folds AS (SELECT DISTINCT fold AS held_out FROM snap),
named AS (SELECT held_out, name, sum(cheap) AS n_t2, sum(filled) AS n_full, sum(cheap * filled) AS n_kept FROM sides JOIN snap USING (key) JOIN folds ON fold <> held_out GROUP BY 1, 2),
heads AS MATERIALIZED (SELECT held_out, name, CAST(n_full AS BIGINT) AS support FROM named WHERE n_t2 = 0 AND n_full > 0)"""
_SQL_MODEL = f"""{_SQL_TOKENS}, {_SQL_HEADS},
rare AS (SELECT held_out, key, count(*) AS n FROM sides JOIN snap USING (key) JOIN heads USING (name) WHERE filled = 1 AND support = 1 AND fold <> held_out GROUP BY 1, 2),
model AS MATERIALIZED (SELECT f.held_out, token, count(*) AS n, CAST(sum(target) AS BIGINT) AS pair_sum, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS rare_sum FROM tokens JOIN target USING (key) JOIN folds f ON fold <> f.held_out LEFT JOIN rare r ON r.held_out = f.held_out AND r.key = target.key GROUP BY 1, 2),
recurring AS MATERIALIZED (SELECT h.held_out, token, h.name, count(*) AS total FROM tokens t JOIN snap USING (key) JOIN sides s ON s.key = t.key AND filled = 1 JOIN heads h ON h.name = s.name AND support >= {ev.RECURRING} AND fold <> h.held_out GROUP BY 1, 2, 3),
lacks AS (SELECT held_out, greatest(1, (sum(n_full) * 80 + 99) // 100 - sum(n_kept)) AS pair_deficit, greatest(1, (count(*) FILTER (n_full > 0) * 95 + 99) // 100 - count(*) FILTER (n_full > 0 AND n_t2 > 0)) AS name_deficit, count(*) FILTER (n_t2 = 0 AND n_full = 1) AS rare_sum FROM named GROUP BY 1),
goals AS MATERIALIZED (SELECT held_out, count(*) AS domains, CAST(sum(target) AS BIGINT) AS pair_sum, any_value(rare_sum) AS rare_sum, sum(target) / count(*) AS pair_mean, any_value(rare_sum) / count(*) AS rare_mean, CAST(any_value(pair_deficit) AS BIGINT) AS pair_deficit, CAST(any_value(name_deficit) AS BIGINT) AS name_deficit FROM target JOIN folds ON fold <> held_out JOIN lacks USING (held_out) GROUP BY 1)"""
_SQL_SCORES = f"""{_SQL_MODEL},
met AS MATERIALIZED (SELECT t.key, s.fold, m.token, m.n, (m.pair_sum + 4 * pair_mean) / (m.n + 4) AS pair, (m.rare_sum + 4 * rare_mean) / (m.n + 4) AS rare FROM tokens t JOIN snap s USING (key) JOIN model m ON m.held_out = s.fold AND m.token = t.token JOIN goals g ON g.held_out = s.fold),
first AS (SELECT s.key, s.fold, count(token) AS matched, coalesce(sum(1 / (n + 4)), 0) AS weight, (any_value(pair_mean) + coalesce(sum(pair), 0)) / (1 + count(token)) AS pair_lift, (any_value(rare_mean) + coalesce(sum(rare), 0)) / (1 + count(token)) AS rare_novelty FROM snap s JOIN goals g ON g.held_out = s.fold LEFT JOIN met m ON m.key = s.key GROUP BY 1, 2),
parts AS (SELECT m.key, r.name, sum(total / (n + 4)) AS part FROM met m JOIN recurring r ON r.held_out = m.fold AND r.token = m.token GROUP BY 1, 2),
wanted AS (SELECT held_out AS fold, name, support / domains AS mean FROM heads JOIN goals USING (held_out) WHERE support >= {ev.RECURRING} AND name NOT IN (SELECT name FROM views WHERE view = 't2')),
chance AS MATERIALIZED (SELECT f.key, f.fold, w.name, greatest(0, least(1, (mean * (1 + 4 * weight) + coalesce(part, 0)) / (1 + matched))) AS p FROM first f JOIN wanted w USING (fold) LEFT JOIN parts x ON x.key = f.key AND x.name = w.name),
scored AS MATERIALIZED (SELECT f.*, coalesce(c.expected, 0) AS expected, pair_lift / pair_deficit + (rare_novelty + coalesce(c.expected, 0)) / name_deficit AS score FROM first f JOIN goals g ON g.held_out = f.fold LEFT JOIN (SELECT key, sum(p) AS expected FROM chance GROUP BY 1) c USING (key))"""


def _sql_quotas() -> str:
    seats = lambda k, name: f"{name}s AS (SELECT fold, CAST(whole + (row_number() OVER (ORDER BY rest DESC, fold) <= {k} - sum(whole) OVER ())::INT AS BIGINT) AS {name} FROM (SELECT fold, count(*) * {k} // (SELECT count(*) FROM snap) AS whole, count(*) * {k} % (SELECT count(*) FROM snap) AS rest FROM snap GROUP BY 1))"
    return f"{seats(ev.MOST_SELECTED, 'routed')}, {seats(ev.CONTROLS, 'control')}, quotas AS (SELECT fold, routed, control, routed - control AS trigger FROM routeds JOIN controls USING (fold))"


# One row per fold and step: the chosen keys, and of every wanted name the share that is not yet covered.
_SQL_GREEDY = f"""{_SQL_SCORES}, {_sql_quotas()},
vectors AS MATERIALIZED (SELECT s.key, s.fold, pair_lift / pair_deficit AS pair, rare_novelty, name_deficit, coalesce(v.p, []) AS p, sha256('{SALTS["tie"]}' || chr(0) || s.key) AS tie FROM scored s JOIN goals g ON g.held_out = s.fold LEFT JOIN (SELECT key, list(p ORDER BY name) AS p FROM chance GROUP BY 1) v USING (key)),
steps AS (
  SELECT fold, 0 AS place, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS score, CAST([] AS VARCHAR[]) AS chosen, list_transform(any_value(p), lambda x: 1.0::DOUBLE) AS rest FROM vectors GROUP BY 1
  UNION ALL SELECT fold, place + 1, key, worth, list_append(chosen, key), list_transform(list_zip(rest, p), lambda x: x[1] * (1 - x[2])) FROM (
    SELECT s.fold, s.place, v.key, s.chosen, s.rest, v.p, round(v.pair + (v.rare_novelty + coalesce(list_sum(list_transform(list_zip(s.rest, v.p), lambda x: x[1] * x[2])), 0)) / v.name_deficit, {ev.DECIMALS}) AS worth, v.tie
    FROM steps s JOIN quotas q USING (fold) JOIN vectors v ON v.fold = s.fold AND NOT list_contains(s.chosen, v.key) WHERE s.place < q.trigger)
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY worth DESC, tie) = 1),
triggered AS (SELECT fold, key, place, score FROM steps WHERE place > 0),
controlled AS (SELECT s.fold, s.key FROM snap s JOIN quotas q USING (fold) WHERE key NOT IN (SELECT key FROM triggered) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sha256('{SALTS["control"]}' || chr(0) || key), key) <= any_value(control) OVER (PARTITION BY fold))"""
_SQL_LABEL = f"""world AS MATERIALIZED (SELECT name, sum(cheap) AS n FROM sides GROUP BY 1 HAVING max(filled) = 1),
lifts AS MATERIALIZED (SELECT key, count(*) FILTER (filled = 1 AND cheap = 0) AS lift, sha256('{SALTS["label"]}' || chr(0) || key) AS tie FROM sides GROUP BY 1),
known AS MATERIALIZED (SELECT key, list(name) FILTER (filled = 1 AND cheap = 0) AS gains, list(name) FILTER (cheap = 1 AND filled = 0) AS losses, list(name) FILTER (cheap = 1) AS olds, list(name) FILTER (filled = 1) AS news FROM sides SEMI JOIN world USING (name) GROUP BY 1),
aware AS (
  SELECT 0 AS place, CAST(NULL AS VARCHAR) AS key, 0::BIGINT AS pair_lift, 0::BIGINT AS name_lift, CAST([] AS VARCHAR[]) AS chosen, (SELECT map_from_entries(list((name, n::BIGINT))) FROM world) AS counts
  UNION ALL SELECT place + 1, key, lift, gain, list_append(chosen, key), map_from_entries(list_transform(map_entries(counts), lambda x: (x.key, x.value - list_contains(coalesce(olds, []), x.key)::BIGINT + list_contains(coalesce(news, []), x.key)::BIGINT))) FROM (
    SELECT s.place, l.key, l.lift, l.tie, s.chosen, s.counts, k.olds, k.news, CAST(len(list_filter(coalesce(k.gains, []), lambda n: s.counts[n] = 0)) - len(list_filter(coalesce(k.losses, []), lambda n: s.counts[n] = 1)) AS BIGINT) AS gain
    FROM aware s, lifts l LEFT JOIN known k ON k.key = l.key WHERE s.place < {ev.MOST_SELECTED} AND NOT list_contains(s.chosen, l.key) AND l.lift = (SELECT max(x.lift) FROM lifts x WHERE NOT list_contains(s.chosen, x.key)))
  QUALIFY row_number() OVER (ORDER BY lift DESC, gain DESC, tie) = 1)"""


# The second arm: the same steps over the tokens with categories.
_SQL_MORE_TOKENS = f"""categorised AS (SELECT {sql_same_value('name')} AS name, unnest(categories).id AS category FROM technologies),
tokens AS MATERIALIZED (SELECT * FROM tokens UNION SELECT key, 't2.category=' || coalesce(category, 0) FROM (SELECT * FROM views WHERE view = 't2') LEFT JOIN categorised USING (name))"""
_ARM_STEPS = ("model", "recurring", "met", "first", "parts", "chance", "scored", "vectors", "steps", "triggered", "controlled")


def _second_arm() -> str:
    """The steps from tokens to triggered domains once more, each under a name of its own."""
    text = _SQL_MODEL.removeprefix(f"{_SQL_TOKENS}, {_SQL_HEADS},") + _SQL_SCORES.removeprefix(_SQL_MODEL) + _SQL_GREEDY.removeprefix(_SQL_SCORES)
    rows = text.split("\n")
    kept = "\n".join(r for r in rows if not re.match(r"(rare|lacks|goals|wanted) AS ", r) and r).replace(f", {_sql_quotas()},", ",")
    more = _SQL_MORE_TOKENS.replace("tokens AS MATERIALIZED", "tokens2 AS MATERIALIZED")
    return more + ",\n" + re.sub(r"\b(" + "|".join(_ARM_STEPS) + r"|tokens)\b", r"\g<1>2", kept).rstrip(",")


def _cost(c: str) -> str:
    return f"coalesce({'timings' if c == 'browser_ms' else 'usage'}.{c}, 0)"


_SQL_JUDGE = """mixed AS (SELECT arm, s.*, CASE WHEN c.key IS NOT NULL THEN filled ELSE cheap END AS seen FROM sides s CROSS JOIN (SELECT DISTINCT arm FROM chosen) a LEFT JOIN chosen c USING (arm, key)),
by_name AS (SELECT arm, name, sum(filled) AS n, sum(filled * seen) AS k, max(seen) AS any_seen, sum((1 - filled) * seen) AS extra FROM mixed GROUP BY 1, 2),
by_domain AS (SELECT arm, avg(k / n) AS macro_domain FROM (SELECT arm, key, sum(filled) AS n, sum(filled * seen) AS k FROM mixed GROUP BY 1, 2) WHERE n > 0 GROUP BY 1),
kept AS (SELECT arm, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(k) AS BIGINT) AS pairs_kept, count(*) FILTER (n > 0) AS names, count(*) FILTER (n > 0 AND any_seen > 0) AS names_kept, avg(k / n) FILTER (n > 0) AS macro_technology, count(*) FILTER (n = 0 AND any_seen > 0) AS extra_names, CAST(sum(extra) AS BIGINT) AS extra_pairs FROM by_name GROUP BY 1),
spent AS (SELECT arm, count(*) AS domains_full, count(c.key) AS domains_selected, """ + ", ".join(f"CAST(sum({_cost(m)}) AS BIGINT) AS {m}_full, CAST(coalesce(sum({_cost(m)}) FILTER (c.key IS NOT NULL), 0) AS BIGINT) AS {m}_selected" for m in COSTS) + """ FROM snap CROSS JOIN (SELECT DISTINCT arm FROM chosen) a LEFT JOIN chosen c USING (arm, key) GROUP BY 1),
judged AS (SELECT *, names > 0 AND names_kept >= 0.95 * names AND pairs_kept >= 0.8 * pairs AND domains_selected <= 40""" + "".join(f" AND {m}_selected * 10 <= {m}_full * 3" for m in COSTS) + """ AS accepted FROM kept JOIN by_domain USING (arm) JOIN spent USING (arm))"""
_SQL_WINS = """novel AS (SELECT key, name FROM sides WHERE filled = 1 AND name NOT IN (SELECT name FROM sides WHERE cheap = 1)),
outcome AS (SELECT arm, t.fold, CAST(sum(target) AS BIGINT) AS pair_lift FROM (SELECT 'l' AS arm, fold, key FROM triggered UNION ALL SELECT 'r', fold, key FROM triggered2) t JOIN target USING (key) GROUP BY 1, 2),
fresh AS (SELECT arm, t.fold, count(DISTINCT name) AS novel_names FROM (SELECT 'l' AS arm, fold, key FROM triggered UNION ALL SELECT 'r', fold, key FROM triggered2) t JOIN novel USING (key) GROUP BY 1, 2),
duel AS (SELECT l.fold, l.pair_lift AS left_pair_lift, coalesce(lf.novel_names, 0) AS left_novel_names, r.pair_lift AS right_pair_lift, coalesce(rf.novel_names, 0) AS right_novel_names FROM outcome l JOIN outcome r ON r.fold = l.fold AND r.arm = 'r' LEFT JOIN fresh lf ON lf.arm = 'l' AND lf.fold = l.fold LEFT JOIN fresh rf ON rf.arm = 'r' AND rf.fold = l.fold WHERE l.arm = 'l'),
won AS (SELECT *, right_pair_lift >= left_pair_lift AND right_novel_names >= left_novel_names AND right_pair_lift + right_novel_names > left_pair_lift + left_novel_names AS right_won FROM duel)"""
_SHOWN = "pairs, pairs_kept, names, names_kept, round(macro_technology, 6) AS macro_technology, round(macro_domain, 6) AS macro_domain"
_ANY = lambda columns, test: "(" + " OR ".join(f"coalesce({test.format(c)}, false)" for c in columns) + ")"
_TIMES, _COUNTS, _USED = ([f"{x}.{c}" for c in columns] for x, columns in (("timings", validation.STAGES), ("detection_stats", validation.STATS), ("usage", validation.USAGE)))
_SEGMENT = "[A-Za-z0-9._~-]{1,64}"
_FLAT_SQL = {
    "unsupported schema": "schema_version <> 1", "no run or domain": "run_id IS NULL OR domain IS NULL", "run id is no uuid": "NOT regexp_full_match(run_id, '[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}')",
    "domain is not canonical": "NOT regexp_full_match(domain, '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?')", "unknown status": "status NOT IN ('success', 'partial', 'failed')",
    "address is not sanitised": f"NOT regexp_full_match(final_url, 'https?://[a-z0-9.-]+/({_SEGMENT}/)*({_SEGMENT})?')",
    "stats do not add up": "detection_stats.raw_direct <> detection_stats.gated_direct + detection_stats.suppressed_direct + detection_stats.retained_direct", "negative count": _ANY([*_COUNTS, *_USED], "{} < 0"),
    "failed record has detections": f"status = 'failed' AND {_ANY(_COUNTS, '{} <> 0')}", "failed record has an address": "status = 'failed' AND final_url IS NOT NULL", "failed record has pages": "status = 'failed' AND usage.pages_visited > 0",
    "successful record has no entry page": "status = 'success' AND (final_url IS NULL OR usage.pages_visited < 1)", "successful record lacks a stage": "status = 'success' AND (" + " OR ".join(f"timings.{c} IS NULL" for c in validation.MANDATORY) + ")",
    "no total time": "timings.total_ms IS NULL", "negative time": _ANY(["timings.total_ms", *_TIMES], "{} < 0"), "stage longer than total": _ANY(_TIMES, "{} > timings.total_ms"),
    "detections without detection time": "detection_stats.raw_direct > 0 AND timings.detect_ms IS NULL", "browser requests without browser time": "usage.browser_requests > 0 AND timings.browser_ms IS NULL", "probes without http time": "usage.probes_issued > 0 AND timings.http_ms IS NULL",
    "retries do not fit requests": "usage.http_requests - usage.retries < 0 OR usage.retries > usage.http_requests - usage.retries", "static bytes without request": "usage.static_transferred_bytes > 0 AND usage.http_requests = 0", "browser bytes without request": "usage.browser_transferred_bytes > 0 AND usage.browser_requests = 0",
    "more probes than requests": "usage.probes_issued > usage.http_requests", "total time too large to sum": f"timings.total_ms > {validation.AGGREGATE_UNIT}", "usage too large to sum": _ANY(_USED, "{} > %d" % validation.AGGREGATE_UNIT),
    **{f"{c} above its limit": f"usage.{c} > {TIGHT[c]}" for c in ("http_requests", "browser_requests", "probes_issued", "script_bodies_inspected", "browser_transferred_bytes")}, "pages_visited above its limit": f"usage.pages_visited > {TIGHT['pages']}",
}
_STATUS = "CASE WHEN s IN (401, 403, 407, 451) THEN 'denied' WHEN s IN (408, 425, 429) OR s BETWEEN 500 AND 599 THEN 'retry' WHEN s IN (301, 302, 303, 307, 308) THEN 'redirect' WHEN s BETWEEN 300 AND 399 THEN 'invalid' WHEN s BETWEEN 200 AND 299 THEN CASE WHEN s IN (204, 205) OR media IS NULL THEN 'non_html' ELSE 'html' END WHEN internal THEN 'failed' ELSE 'soft' END"
_STAGES = ("target_ms", "robots_ms", "http_ms", "dns_ms", "tls_ms", "browser_ms", "detect_ms")

ORACLE_SQL = {
    "technology_frequency": f"WITH {_SQL} SELECT technology, count(DISTINCT (run_id, domain)) AS n_records, count(*) AS n_evidence FROM e GROUP BY 1",
    "run_summary": f"WITH {_SQL} SELECT run_id, count(*) AS domains, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'failed') AS failed, "
    + ", ".join(f"CAST(sum(detection_stats.{s}) AS BIGINT) AS {s}" for s in results.STATUS_STATS)
    + ", floor(sum(timings.total_ms) / count(timings.total_ms) * 1000 + 0.5) / 1000 AS average, quantile_disc(timings.total_ms, 0.5) AS p50, quantile_disc(timings.total_ms, 0.95) AS p95, quantile_disc(timings.total_ms, 0.99) AS p99 FROM rec GROUP BY 1",
    "attribution": f"WITH {_SQL}, p AS (SELECT run_id, domain, technology, bool_and(coalesce(collector = 'http', false)) AS a, bool_or(coalesce(collector = 'browser', false)) AS b, bool_or(source = 'probe') AS c, bool_or(coalesce(page_id IN ('p2', 'p3'), false)) AS d, bool_or(source = 'script_content') AS s FROM e GROUP BY 1, 2, 3) "
    "SELECT run_id, count(*) AS technologies, count(*) FILTER (WHERE a) AS only_http, count(*) FILTER (WHERE b) AS any_browser, count(*) FILTER (WHERE c) AS any_probe, count(*) FILTER (WHERE d) AS internal_page, count(*) FILTER (WHERE s) AS script_content FROM p GROUP BY 1",
    "error_groups": f"WITH {_SQL} SELECT run_id, stage, code, count(*) AS n, CAST({sql_rank('stage', policy.ERROR_STAGES)} AS BIGINT) AS stage_rank FROM err GROUP BY 1, 2, 3",
    "hard_limits": f"WITH {_SQL} SELECT run_id, count(*) AS hits, count(DISTINCT domain) AS domains FROM err WHERE ends_with(code, '_LIMIT_EXCEEDED') OR code IN ('REGEX_DOMAIN_BUDGET_EXCEEDED', 'REGEX_EXECUTION_LIMIT') GROUP BY 1",
    "limit_hits": f"WITH {_SQL} SELECT limit_name AS category, stage AS ordinal, count(*) AS hits, count(DISTINCT domain) AS domains, count(DISTINCT CASE WHEN page_id IS NOT NULL THEN (domain, page_id) END) AS pages FROM err WHERE limit_name IS NOT NULL GROUP BY 1, 2",
    "bound_errors": f"WITH {_SQL}, u AS (SELECT DISTINCT run_id, domain, stage, code, page_id, rule_id, message FROM err), p AS (SELECT *, row_number() OVER (PARTITION BY run_id, domain ORDER BY {sql_rank('stage', policy.ERROR_STAGES)}, code, page_id NULLS FIRST, rule_id NULLS FIRST, message NULLS FIRST) AS place, count(*) OVER (PARTITION BY run_id, domain) AS n FROM u) "
    "SELECT run_id, domain, stage, code, page_id, rule_id, message FROM p WHERE place <= CASE WHEN n > 3 THEN 2 ELSE 3 END UNION ALL SELECT run_id, domain, 'detect', 'RESULT_LIMIT_EXCEEDED', NULL, NULL, NULL FROM p WHERE n > 3 AND place = 1",
    "validation_issues": f"WITH {_SQL}, i AS (SELECT run_id, domain, unnest([" + ", ".join(f"CASE WHEN {sql} THEN '{text}' END" for text, sql in _FLAT_SQL.items()) + "]) AS issue FROM rec) SELECT * FROM i WHERE issue IS NOT NULL",
    "error_issues": f"WITH {_SQL}, c AS (SELECT run_id, domain, code, CASE WHEN error_id % 4 = 0 THEN 'detect' ELSE stage END AS stage FROM err), known AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{x}')" for c, stages in policy.ERROR_CODES.items() for x in stages)}) AS v(code, stage)), "
    "j AS (SELECT c.*, r.timings, r.run_id IS NULL AS lost, c.code IN (SELECT code FROM known) AS registered, EXISTS (SELECT 1 FROM known k WHERE k.code = c.code AND k.stage = c.stage) AS fits, CASE c.stage " + " ".join(f"WHEN '{x}' THEN r.timings.{x}_ms" for x in policy.ERROR_STAGES) + " END AS spent FROM c LEFT JOIN rec r USING (run_id, domain)) "
    "SELECT DISTINCT run_id, domain, code, issue FROM (SELECT *, unnest([CASE WHEN NOT registered THEN 'code is not registered' END, CASE WHEN registered AND NOT fits THEN 'code of another stage' END, CASE WHEN NOT lost AND spent IS NULL THEN 'stage has no time' END, CASE WHEN lost THEN 'error of no record' END]) AS issue FROM j) WHERE issue IS NOT NULL",
    "technology_issues": f"WITH RECURSIVE {SQL_EV}, {sql_resolved(False)}, {SQL_DIRECT}, n AS (SELECT s.*, d.version AS dv, d.pages, row_number() OVER (PARTITION BY s.run_id, s.domain ORDER BY s.technology) - 1 AS i, count(*) OVER (PARTITION BY s.run_id, s.domain) AS size FROM shown s LEFT JOIN directs d ON d.run_id = s.run_id AND d.domain = s.domain AND d.technology = s.technology WHERE s.technology IS NOT NULL), "
    "copies AS (SELECT *, 1 AS c FROM n UNION ALL SELECT *, 2 FROM n WHERE i = 0 AND length(domain) % 3 = 0), "
    "f AS (SELECT run_id, domain, technology, unnest([CASE WHEN i % 5 = 1 THEN CASE type WHEN 'direct' THEN 'confidence is not that of its rules' ELSE 'confidence is not that of its inferences' END END, CASE WHEN i % 5 = 2 THEN CASE WHEN type = 'direct' AND dv IS DISTINCT FROM '9.9.9' THEN 'version is not that of its evidence' WHEN type = 'inferred' AND inferred_version IS DISTINCT FROM '9.9.9' THEN 'version is not that of its inferences' END END, CASE WHEN i % 5 = 3 AND type = 'direct' AND pages <> 'p9' THEN 'pages are not those of the evidence' END]) AS issue FROM copies) "
    "SELECT * FROM f WHERE issue IS NOT NULL UNION ALL SELECT run_id, domain, NULL, 'technology repeated' FROM n WHERE i = 0 AND length(domain) % 3 = 0 UNION ALL SELECT run_id, domain, NULL, 'technologies out of order' FROM n WHERE i = 0 AND size > 1 AND length(domain) % 3 = 0",
    "top_technologies": f"WITH RECURSIVE {SQL_EV}, {sql_resolved(False)}, p AS (SELECT technology AS name, domain, max((type = 'direct')::INT) AS d FROM shown WHERE technology IS NOT NULL GROUP BY 1, 2) SELECT name, count(*) AS n_domains, CAST(sum(d) AS BIGINT) AS n_direct, CAST(sum(1 - d) AS BIGINT) AS n_inferred FROM p GROUP BY 1",
    "domain_status": f"WITH {_SQL}, n AS (SELECT run_id, domain, count(*) AS k FROM err GROUP BY 1, 2) SELECT r.run_id, r.domain, status, CASE WHEN coalesce(k, 0) = 0 AND NOT coalesce(final_url LIKE 'http:%', false) THEN 'success' WHEN detection_stats.raw_direct > 0 OR final_url IS NOT NULL OR (coalesce(k, 0) = 0 AND coalesce(final_url LIKE 'http:%', false)) THEN 'partial' ELSE 'failed' END AS computed FROM rec r LEFT JOIN n USING (run_id, domain)",
    "response_outcomes": f"WITH o AS (SELECT DISTINCT CAST(o_orderkey % 700 AS INTEGER) AS s, o_custkey % 2 = 0 AS internal, CASE WHEN o_custkey % 3 > 0 THEN 'text/html' END AS media FROM orders) SELECT s AS status, internal, media, {_STATUS} AS outcome FROM o",
    "stated_detections": f"WITH {_SQL}, a AS (SELECT run_id, domain, detection_stats.retained_direct AS n FROM rec), b AS (SELECT run_id, domain, count(DISTINCT technology) AS n FROM e GROUP BY 1, 2) SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.domain, b.domain) AS domain, a.n AS stated, b.n AS recomputed FROM a FULL JOIN b ON a.run_id = b.run_id AND a.domain = b.domain WHERE a.n IS DISTINCT FROM b.n",
    "resume_antijoin": f"WITH {_SQL} SELECT run_id, domain FROM rec r WHERE NOT EXISTS (SELECT 1 FROM result_records x WHERE x.run_id = r.run_id AND x.domain = r.domain)",
    "limit_issues": f"WITH {_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT run_id, domain, '{c}' AS counter FROM rec WHERE usage.{c} > {n}" for c, n in LIMITS.items()) + ")",
    "document_classes": "SELECT o_orderkey, CASE WHEN o_orderkey % 700 IN (401, 403, 407, 451) THEN 'denied' WHEN o_custkey % 2 = 0 AND o_orderkey % 700 BETWEEN 200 AND 299 THEN 'admitted' ELSE 'rejected' END AS class FROM orders",
    "diagnostics": f"WITH {_SQL} SELECT run_id, domain, stage, code, retryable, count(*) AS n FROM err GROUP BY ALL",
    "category_tokens": f"WITH RECURSIVE {_SQL_VIEWS}, c AS (SELECT {sql_same_value('name')} AS name, unnest(categories).id AS category FROM technologies) SELECT DISTINCT key, 't2.category=' || coalesce(category, 0) AS token FROM (SELECT * FROM views WHERE view = 't2') LEFT JOIN c USING (name)",
    "category_gaps": f"WITH RECURSIVE {_SQL_VIEWS} SELECT name, count(*) AS domains FROM views WHERE view = 't2' AND name NOT IN (SELECT {sql_same_value('name')} FROM technologies) GROUP BY 1",
    "training_deficits": f"WITH RECURSIVE {_SQL_VIEWS} SELECT greatest(1, (sum(filled)::BIGINT * 80 + 99) // 100 - sum(filled * cheap)::BIGINT) AS pair_deficit, greatest(1, (count(DISTINCT name) FILTER (filled = 1) * 95 + 99) // 100 - (SELECT count(*) FROM (SELECT name FROM sides GROUP BY 1 HAVING max(filled) = 1 AND max(cheap) = 1))) AS name_deficit FROM sides",
    "fold_assign": f"WITH RECURSIVE {_SQL_VIEWS} SELECT key, fold FROM snap",
    "count_bins": f"WITH RECURSIVE {_SQL_VIEWS} SELECT key, {_bin('usage.browser_transferred_bytes')} AS bytes_bin, {_bin('usage.retries')} AS retries_bin FROM snap",
    "feature_tokens": f"WITH RECURSIVE {_SQL_TOKENS} SELECT * FROM tokens",
    "lift_targets": f"WITH RECURSIVE {_SQL_VIEWS} SELECT * FROM target",
    "name_heads": f"WITH RECURSIVE {_SQL_VIEWS}, {_SQL_HEADS} SELECT * FROM heads",
    "token_model": f"WITH RECURSIVE {_SQL_MODEL} SELECT * FROM model",
    "recurring_model": f"WITH RECURSIVE {_SQL_MODEL} SELECT * FROM recurring",
    "training_objectives": f"WITH RECURSIVE {_SQL_MODEL} SELECT held_out, domains, pair_sum, rare_sum, pair_deficit, name_deficit FROM goals",
    "oof_scores": f"WITH RECURSIVE {_SQL_SCORES} SELECT key, fold, matched, round(pair_lift, 6) AS pair_lift, round(rare_novelty, 6) AS rare_novelty, round(expected, 6) AS expected, round(score, 6) AS score FROM scored",
    "quotas_largest_remainder": f"WITH RECURSIVE {_SQL_VIEWS}, {_sql_quotas()} SELECT * FROM quotas",
    "greedy_selection": f"WITH RECURSIVE {_SQL_GREEDY} SELECT fold, key, place, round(score, 6) AS score FROM triggered",
    "control_sample": f"WITH RECURSIVE {_SQL_GREEDY} SELECT * FROM controlled",
    "label_aware_selection": f"WITH RECURSIVE {_SQL_VIEWS}, {_SQL_LABEL} SELECT place, key, pair_lift, name_lift FROM aware WHERE place > 0",
    "hash_sample": f"WITH RECURSIVE {_SQL_VIEWS} SELECT key FROM randoms",
    "retention_metrics": f"WITH RECURSIVE {_SQL_VIEWS}, chosen AS (SELECT 'random' AS arm, key FROM randoms), {_SQL_JUDGE} SELECT {_SHOWN}, extra_names, extra_pairs FROM judged",
    "cost_guardrails": f"WITH RECURSIVE {_SQL_VIEWS}, chosen AS (SELECT 'random' AS arm, key FROM randoms), {_SQL_JUDGE} SELECT domains_full, domains_selected, " + ", ".join(f"{m}_full, {m}_selected" for m in COSTS) + ", accepted FROM judged",
    "fold_wins": f"WITH RECURSIVE {_SQL_GREEDY}, {_second_arm()}, {_SQL_WINS} SELECT * FROM won",
    "paired_report": f"WITH RECURSIVE {_SQL_GREEDY}, {_second_arm()}, {_SQL_WINS}, chosen AS (SELECT 'l' AS arm, key FROM triggered UNION ALL SELECT 'l', key FROM controlled UNION ALL SELECT 'r', key FROM triggered2 UNION ALL SELECT 'r', key FROM controlled2), {_SQL_JUDGE}, "
    f"verdicts AS (SELECT bool_or(accepted) FILTER (arm = 'l') AS left_accepted, bool_or(accepted) FILTER (arm = 'r') AS right_accepted, (SELECT count(*) FILTER (right_won) FROM won) AS wins, (SELECT count(*) FROM won) AS n_folds FROM judged) SELECT *, CASE WHEN left_accepted THEN 'left' WHEN right_accepted AND wins >= {ev.FOLD_WINS} THEN 'right' ELSE 'none' END AS decision FROM verdicts",
    "development_report": f"WITH RECURSIVE {_SQL_GREEDY}, {_SQL_LABEL}, chosen AS (SELECT 'random' AS arm, key FROM randoms UNION ALL SELECT 'label_aware', key FROM aware WHERE place > 0 UNION ALL SELECT 'model', key FROM triggered UNION ALL SELECT 'model', key FROM controlled), {_SQL_JUDGE} SELECT arm, {_SHOWN}, extra_pairs, domains_selected, " + ", ".join(f"{m}_selected" for m in COSTS) + ", accepted FROM judged",
}
