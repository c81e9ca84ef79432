"""From matches to technologies: evidence, direct confidence and version, nested results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import policy
from fathomline.functions.redact import evidence_key, evidence_match, evidence_version, sanitize_url
from fathomline.functions.text import present
from fathomline.operators.candidates import number_candidates, within_budget
from fathomline.operators.graph import resolve_technologies
from fathomline.operators.matching import dedupe_matches, drop_timed_out, match_rules, pair_costs
from fathomline.session import checked_broadcast, materialize

EVIDENCE_COLUMNS = ["collector", "source", "page_id", "key", "match", "rule_id", "pattern", "confidence", "version"]


def build_evidence(matches: DataFrame, record: list[str]) -> DataFrame:
    """Redacted evidence of matches, one row per distinct piece.

    matches: see :func:`fathomline.operators.matching.match_rules`. Presence
    matches carry no pattern and no version; a version needs a visible match.
    Only URLs that evidence shows visit the sanitising function.
    """
    is_url = F.col("source").isin(*policy.URL_SOURCES)
    rows = matches.withColumn("_u", sanitize_url(F.when(is_url & (F.col("match_mode") != "presence"), F.col("value"))))
    shown = evidence_match(F.col("source"), F.col("key"), F.col("value"), F.col("matched"), F.col("_u"))
    presence = F.struct(F.lit("presence").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("truncated"))
    present = F.col("match_mode") == "presence"
    rows = rows.withColumn("match", F.when(present, presence).otherwise(shown))
    version = F.when((F.col("match.kind") == "value") & ~present, evidence_version(F.col("source"), F.col("value"), F.col("matched"), F.col("version"), F.col("_u")))
    rows = rows.select(
        *record, "technology", "collector", "source", "page_id", evidence_key(F.col("source"), F.col("key")).alias("key"), "match", "rule_id",
        F.when(~present, F.col("pattern")).alias("pattern"), "confidence", version.alias("version"),
    )
    return rows.distinct()


#: Distinct contents that are broadcast; beyond that the planner joins them.
MOST_CONTENTS = 1_000_000


def content_evidence(candidates: DataFrame, rules: DataFrame, record: list[str]) -> tuple[DataFrame, DataFrame]:
    """The evidence of :func:`build_evidence` in two tables: record, collector, page_id, _piece, each once; and _piece with all other columns.

    What a candidate matches and shows hangs on its kind, source, key and value
    alone, and few of these are distinct. They are matched once, and only the
    numbers of what came out move with the records.
    """
    content = ["kind", "source", "key", "value"]
    own, _, _ = materialize(candidates.select(*content).distinct().withColumn("_content", F.monotonically_increasing_id()), "contents")
    bare = own.withColumns({c: F.lit(None).cast("string") for c in ("collector", "page_id")})
    shown = build_evidence(match_rules(bare, rules), ["_content"])
    columns = [c for c in ("technology", *EVIDENCE_COLUMNS) if c not in ("collector", "page_id")]
    pieces, _, _ = materialize(shown.groupBy(*columns).agg(F.collect_list("_content").alias("_contents")).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    held = pieces.select("_piece", F.explode("_contents").alias("_content")).groupBy("_content").agg(F.collect_list("_piece").alias("_pieces"))
    index, _, _ = materialize(own.join(held, "_content").select(*[F.col(c).alias(f"_{c}") for c in content], "_content", "_pieces"), "index")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content])
    spark = candidates.sparkSession
    # Candidates move to their record as numbers; the pieces, many more, come up and are told apart where the record is.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = candidates.join(checked_broadcast(index.drop("_pieces"), MOST_CONTENTS), same).select(*record, "collector", "page_id", "_content").repartition(parts, *record)
    shown = met.join(checked_broadcast(index.select("_content", "_pieces"), MOST_CONTENTS), "_content")
    return shown.select(*record, "collector", "page_id", F.explode("_pieces").alias("_piece")).distinct(), pieces.drop("_contents")


def direct_detections(evidence: DataFrame, record: list[str]) -> DataFrame:
    """Technologies with some positive evidence: confidence, version, pages, number of pieces.

    Confidence: the rules' highest confidences added, at most 100. Version: the
    one with the highest sum of its rules' highest confidences, if it is alone.
    Pieces of zero confidence stay as companions. Three aggregations that share
    their leading keys, each combined on the map side.
    """
    rows = evidence.where("technology IS NOT NULL AND rule_id IS NOT NULL")
    per_rule = rows.groupBy(*record, "technology", "rule_id").agg(F.max("confidence").alias("c"), F.count(F.lit(1)).alias("n"), F.collect_set("page_id").alias("pages"))
    base = per_rule.groupBy(*record, "technology").agg(
        F.least(F.lit(100), F.sum("c")).cast("int").alias("confidence"), F.max("c").alias("_top"), F.sum("n").alias("n_evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("page_ids")
    )
    base = base.where("_top > 0").drop("_top")
    versions = rows.where("version IS NOT NULL").groupBy(*record, "technology", "version", "rule_id").agg(F.max("confidence").alias("c"))
    versions = versions.groupBy(*record, "technology", "version").agg(F.sum("c").alias("weight"))
    w = Window.partitionBy(*record, "technology")
    top = versions.withColumn("_best", F.max("weight").over(w)).where("weight = _best").groupBy(*record, "technology").agg(F.when(F.count(F.lit(1)) == 1, F.max("version")).alias("version"))
    on = [*record, "technology"]
    return base.join(top, on, "left")


def nested_technologies(resolved: DataFrame, direct: DataFrame, evidence: DataFrame, categories: DataFrame, record: list[str]) -> DataFrame:
    """One row per record with the sorted array of its technologies and the detection counts; equal pieces of evidence are shown once.

    resolved: :func:`fathomline.operators.graph.resolve_technologies`; direct:
    :func:`direct_detections`; categories: name, categories.
    """
    pieces = evidence.groupBy(*record, "technology").agg(F.array_sort(F.collect_list(F.struct(*evidence_order(), *EVIDENCE_COLUMNS))).alias("e"))
    pieces = pieces.withColumn("evidence", F.array_distinct(F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in EVIDENCE_COLUMNS])))).drop("e")
    joined = resolved.join(direct.select(*record, "technology", "version", "page_ids"), [*record, "technology"], "left").join(pieces, [*record, "technology"], "left").join(categories.withColumnRenamed("name", "technology"), "technology", "left")
    is_direct = F.col("type") == "direct"
    technology = F.struct(
        F.col("technology").alias("name"), F.col("categories"), F.when(is_direct, F.col("version")).otherwise(F.col("inferred_version")).alias("version"), F.col("confidence"), F.col("type"),
        F.coalesce(F.when(is_direct, F.col("page_ids")), F.array().cast("array<string>")).alias("page_ids"), F.when(is_direct, F.col("evidence")).alias("evidence"), F.col("parents").alias("inferred_from"),
    )
    stats = ["raw_direct", "gated_direct", "suppressed_direct", "retained_direct"]
    grouped = joined.groupBy(*record).agg(F.array_sort(F.collect_list(F.when(F.col("technology").isNotNull(), technology))).alias("technologies"), *[F.max(s).alias(s) for s in stats])
    return grouped.select(*record, "technologies", F.struct(*stats).alias("detection_stats"))


def evidence_order() -> list:
    """Leading sort columns of evidence: collector, source, page, key, rule, kind, value, version."""
    return [policy.rank("collector", policy.COLLECTORS).alias("o1"), policy.rank("source", policy.EVIDENCE_SOURCES).alias("o2"), F.col("page_id").alias("o3"), F.col("key").alias("o4"), F.col("rule_id").alias("o5"), F.col("match.kind").alias("o6"), F.col("match.value").alias("o7"), F.col("version").alias("o8")]


def bounded_output(nested: DataFrame, most: int, most_evidence: int) -> DataFrame:
    """A record with too many technologies or pieces of evidence loses them all and gets an error flag."""
    pieces = F.aggregate("technologies", F.lit(0), lambda n, t: n + F.coalesce(F.size(t["evidence"]), F.lit(0)))
    over = (F.size("technologies") > most) | (pieces > most_evidence)
    return nested.withColumn("limit_exceeded", over).withColumn("technologies", F.when(~over, F.col("technologies")).otherwise(F.slice("technologies", 1, 0)))


def detected(candidates: DataFrame, rules: DataFrame, record: list[str], budget: int = policy.WORK_BUDGET, most: int = policy.MATCHES_PER_DOMAIN) -> DataFrame:
    """One row per record: the arrays technology and confidence of the direct detections of :func:`detect`, for those who need no evidence.

    What a candidate costs and matches hangs on its kind, source, key and value
    alone: distinct contents meet the rules once, candidates move to their
    record as numbers, and the rules of a record come up where it is. Only
    records with more than ``most`` matches are put in the order of matches.
    """
    content = ["kind", "source", "key", "value"]
    numbered, _, _ = materialize(number_candidates(candidates, record), "numbered")
    own, _, _ = materialize(numbered.select(*content).distinct().withColumn("_content", F.monotonically_increasing_id()), "contents")
    costs = pair_costs(own.withColumn("candidate_id", F.lit("")), rules, ["_content"]).drop("candidate_id")
    bare = own.withColumns({c: F.lit(None).cast("string") for c in ("collector", "page_id")})
    found = match_rules(bare, rules).groupBy("_content", "rule_id").agg(F.max(F.struct("confidence", "technology")).alias("r"))
    held = found.groupBy("_content").agg(F.collect_list(F.struct("rule_id", present(F.col("r.technology")).alias("technology"), F.col("r.confidence").alias("confidence"))).alias("_rules"))
    index, _, _ = materialize(own.join(costs, "_content").join(held, "_content", "left").select(*[F.col(c).alias(f"_{c}") for c in content], "_content", "pairs", "regex_runs", "_rules"), "index")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content])
    parts = 4 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = numbered.join(checked_broadcast(index.drop("_rules"), MOST_CONTENTS), same).select(*record, "candidate_id", "_content", "pairs", "regex_runs").repartition(parts, *record)
    admitted = within_budget(met.withColumn("priority", F.lit(False)), record, budget)
    shown = admitted.join(checked_broadcast(index.where("_rules IS NOT NULL").select("_content", "_rules"), MOST_CONTENTS), "_content")
    every = Window.partitionBy(*record)
    shown = shown.withColumn("_n", F.sum(F.size("_rules")).over(every)).select(*record, "candidate_id", "_n", F.explode("_rules").alias("r"))
    rows = shown.select(*record, "candidate_id", "_n", "r.*")
    cut = rows.where(F.col("_n") > most).withColumn("_at", F.row_number().over(every.orderBy("rule_id", "candidate_id"))).where(F.col("_at") <= most)

    def summed(rows: DataFrame) -> DataFrame:
        per_rule = rows.where("technology IS NOT NULL AND rule_id IS NOT NULL").groupBy(*record, "technology", "rule_id").agg(F.max("confidence").alias("c"))
        return per_rule.groupBy(*record, "technology").agg(F.least(F.lit(100), F.sum("c")).cast("int").alias("confidence"), F.max("c").alias("_top")).where("_top > 0").groupBy(*record).agg(F.collect_list(F.struct("technology", "confidence")).alias("d")).select(*record, "d.technology", "d.confidence")

    # One pass for the records that keep all; the others are few, and their window needs an order of its own.
    return summed(rows.where(F.col("_n") <= most)).unionByName(summed(cut))


def detect(candidates: DataFrame, rules: DataFrame, revisions: DataFrame, edges: DataFrame, record: list[str], budget: int = policy.WORK_BUDGET, timeouts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole detection: (evidence, direct detections, resolved technologies) of every record.

    candidates: record and identity columns (see
    :func:`fathomline.operators.candidates.collect_candidates`); rules: see
    :func:`fathomline.operators.matching.prepare_rules`; revisions: record,
    revision; edges: relations of the revisions. timeouts: record, rule_id of
    rules that did not end. Names of technologies are compared as ``same_value``
    has them.
    """
    numbered = number_candidates(candidates, record).withColumn("priority", F.lit(False))
    costs = pair_costs(numbered, rules, record).join(numbered.select(*record, "candidate_id", "priority"), [*record, "candidate_id"])
    admitted = within_budget(costs, record, budget).select(*record, "candidate_id")
    matches = match_rules(numbered.join(admitted, [*record, "candidate_id"], "left_semi").drop("priority"), rules)
    if timeouts is not None:
        matches = drop_timed_out(matches, timeouts, record)
    evidence, _, _ = materialize(build_evidence(dedupe_matches(matches, record), record).withColumn("technology", present(F.col("technology"))), "evidence")
    direct, _, _ = materialize(direct_detections(evidence, record), "direct")
    return evidence, direct, resolve_technologies(direct.join(revisions, record, "left"), edges, record)
