"""Outcomes of responses and domains, validation of results, run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import policy
from fathomline.session import materialize

STATUS_STATS = ["raw_direct", "gated_direct", "suppressed_direct", "retained_direct"]


def response_outcome(status: Column, media: Column, internal: Column) -> Column:
    """denied, retry, redirect, invalid, non_html, html, or soft (entry) and failed (internal) for other failures."""
    return (
        F.when(status.isin(401, 403, 407, 451), "denied").when(status.isin(408, 425, 429) | status.between(500, 599), "retry")
        .when(status.isin(301, 302, 303, 307, 308), "redirect").when(status.between(300, 399), "invalid")
        .when(status.between(200, 299), F.when(status.isin(204, 205) | media.isNull() | ~media.isin("text/html", "application/xhtml+xml"), "non_html").otherwise("html"))
        .otherwise(F.when(internal, "failed").otherwise("soft"))
    )


def follow_redirects(start: DataFrame, hops: DataFrame, key: str, most: int = 5) -> DataFrame:
    """key, final_url, hops, outcome (ended, loop, too_many) of redirect chains.

    start: key, url; hops: from_url, to_url. The number of rounds is fixed.
    """
    step = hops.select(F.col("from_url").alias("_from"), F.col("to_url").alias("_to")).distinct()
    current = start.select(key, F.col("url").alias("final_url"), F.array("url").alias("_seen"), F.lit(0).alias("hops"), F.lit(False).alias("_loop"))
    for _ in range(most + 1):
        moved = current.join(step, (F.col("final_url") == F.col("_from")) & ~F.col("_loop"), "left")
        goes = F.col("_to").isNotNull()
        again = goes & F.array_contains("_seen", F.col("_to"))
        current = moved.select(
            key, F.when(goes & ~again, F.col("_to")).otherwise(F.col("final_url")).alias("final_url"), F.when(goes, F.array_append("_seen", F.col("_to"))).otherwise(F.col("_seen")).alias("_seen"),
            (F.col("hops") + (goes & ~again).cast("int")).alias("hops"), (F.col("_loop") | again).alias("_loop"),
        )
    outcome = F.when(F.col("_loop"), "loop").when(F.col("hops") > most, "too_many").otherwise("ended")
    return current.select(key, "final_url", "hops", outcome.alias("outcome"))


def collection_state(usable: Column, truncated: Column) -> Column:
    return F.when(~usable, "failed").when(truncated, "truncated").otherwise("complete")


def domain_status(n_errors: Column, any_signal: Column, weak_page: Column) -> Column:
    """success without errors and weak pages; else partial if any signal came in; else failed."""
    return F.when((n_errors == 0) & ~weak_page, "success").when(any_signal | ((n_errors == 0) & weak_page), "partial").otherwise("failed")


def latest(df: DataFrame, keys: list[str], time: str = "ingested_at") -> DataFrame:
    """One row per key: the latest delivery; of several at one time the greatest by their other columns."""
    columns = [time, *[c for c in df.columns if c not in (time, *keys)]]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_r"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


#: Repeated keys that are broadcast; beyond that the planner joins them.
MOST_REPEATED = 2_000_000


def latest_in_place(df: DataFrame, keys: list[str], time: str = "ingested_at") -> DataFrame:
    """The rows of :func:`latest`, for tables whose keys hardly ever come twice: only rows of repeated keys move.

    The keys alone are grouped first; rows whose key comes once stay where they are, with the columns that are used.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    repeated, n, _ = materialize(counted, "repeated")
    small = F.broadcast(repeated) if n <= MOST_REPEATED else repeated
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(small, on, "left_anti").unionByName(latest(df.join(small, on, "left_semi"), keys, time))


def latest_records(results: DataFrame) -> DataFrame:
    """One row per (run_id, domain): the latest delivery."""
    return latest(results, ["run_id", "domain"])


def run_summary(records: DataFrame) -> DataFrame:
    """Status and detection counts and total times of every run.

    Mean to three decimals, half up; percentiles by nearest rank; sums of
    detection counts. A run without times has zeros.
    """
    total = F.col("timings.total_ms")
    pct = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY timings.total_ms)"), F.lit(0)).cast("long")
    return records.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("domains"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial", "failed")], *[F.sum(f"detection_stats.{s}").alias(s) for s in STATUS_STATS],
        F.coalesce(F.floor(F.sum(total) / F.count(total) * 1000 + 0.5) / 1000, F.lit(0.0)).alias("average"), pct(0.5).alias("p50"), pct(0.95).alias("p95"), pct(0.99).alias("p99"),
    )


def attribution(evidence: DataFrame, record: list[str]) -> DataFrame:
    """How many detected technologies rest only on http, or on any browser, probe, internal-page or script-content evidence."""
    per = evidence.groupBy(*record, "technology").agg(
        F.bool_and(F.coalesce(F.col("collector") == "http", F.lit(False))).alias("only_http"), F.bool_or(F.coalesce(F.col("collector") == "browser", F.lit(False))).alias("any_browser"), F.bool_or(F.col("source") == "probe").alias("any_probe"),
        F.bool_or(F.coalesce(F.col("page_id").isin("p2", "p3"), F.lit(False))).alias("internal_page"), F.bool_or(F.col("source") == "script_content").alias("script_content"),
    )
    flags = ["only_http", "any_browser", "any_probe", "internal_page", "script_content"]
    return per.groupBy("run_id").agg(F.count(F.lit(1)).alias("technologies"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def error_groups(errors: DataFrame) -> DataFrame:
    """Errors by run, stage and code, with the stage's rank for ordering."""
    return errors.groupBy("run_id", "stage", "code").agg(F.count(F.lit(1)).alias("n")).withColumn("stage_rank", policy.rank("stage", policy.ERROR_STAGES))


def diagnostics(errors: DataFrame, record: list[str]) -> DataFrame:
    """Errors of each record by stage, code and whether a retry may help, with their number."""
    return errors.groupBy(*record, "stage", "code", "retryable").agg(F.count(F.lit(1)).alias("n"))


def is_hard_limit(code: Column) -> Column:
    return F.endswith(code, F.lit("_LIMIT_EXCEEDED")) | code.isin("REGEX_DOMAIN_BUDGET_EXCEEDED", "REGEX_EXECUTION_LIMIT")


def bound_errors(errors: DataFrame, record: list[str], most: int = policy.ERRORS_PER_DOMAIN) -> DataFrame:
    """Distinct errors by (stage, code, page, rule, message) in order, at most ``most``; a limit marker takes the last place where some are cut."""
    identity = ["stage", "code", "page_id", "rule_id", "message"]
    unique = errors.select(*record, *identity).distinct()
    order = [policy.rank("stage", policy.ERROR_STAGES), "code", *[F.col(c).asc_nulls_first() for c in ("page_id", "rule_id", "message")]]
    w = Window.partitionBy(*record)
    placed = unique.withColumn("_at", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    over = F.col("_n") > most
    kept = placed.where(F.col("_at") <= F.when(over, most - 1).otherwise(most)).select(*record, *identity)
    marker = placed.where(over & (F.col("_at") == 1)).select(*record, F.lit("detect").alias("stage"), F.lit("RESULT_LIMIT_EXCEEDED").alias("code"), *[F.lit(None).cast("string").alias(c) for c in ("page_id", "rule_id", "message")])
    return kept.unionByName(marker)


def top_technologies(technologies: DataFrame) -> DataFrame:
    """name, n_domains, n_direct, n_inferred of technologies (domain, name, type), the most frequent first, ties by name."""
    per = technologies.groupBy("name", "domain").agg(F.max((F.col("type") == "direct").cast("int")).alias("d"))
    return per.groupBy("name").agg(F.count(F.lit(1)).alias("n_domains"), F.sum("d").alias("n_direct"), F.sum(1 - F.col("d")).alias("n_inferred")).orderBy(F.col("n_domains").desc(), "name")


def technology_frequency(evidence: DataFrame, record: list[str]) -> DataFrame:
    """Records and pieces of evidence of each technology."""
    per = evidence.groupBy(*record, "technology").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("technology").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_evidence"))


def check_detections(stated: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose stated values differ from the recomputed ones, or that only one side has."""
    a = stated.select(*keys, F.struct(*values).alias("stated"))
    b = recomputed.select(*keys, F.struct(*values).alias("recomputed"))
    return a.join(b, keys, "full").where(~F.col("stated").eqNullSafe(F.col("recomputed")))


def document_class(status: Column, same_site: Column, is_main: Column) -> Column:
    """What a document seen by the browser is: admitted, denied (refusals) or rejected."""
    return F.when(status.isin(401, 403, 407, 451), "denied").when(is_main & same_site & status.between(200, 299), "admitted").otherwise("rejected")


def bound_record(record: DataFrame, most_bytes: int) -> DataFrame:
    """Records beyond a size in JSON lose their technologies and get ``limit_exceeded``."""
    over = F.octet_length(F.to_json(F.struct("*"))) > most_bytes
    return record.withColumn("limit_exceeded", over).withColumn("technologies", F.when(~F.col("limit_exceeded"), F.col("technologies")).otherwise(F.slice("technologies", 1, 0)))


def page_features(pages: DataFrame, record: list[str]) -> DataFrame:
    """Sizes of what was seen before a browser ran: bytes, characters, links, metadata, pages."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    return pages.groupBy(*record).agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n_chars"), size("urls").alias("n_urls"), size("metadata").alias("n_metadata"))


def inference_issues(technologies: DataFrame, record: list[str], most_hops: int = 64) -> DataFrame:
    """Inferred technologies whose parents are missing, deeper than or as deep as themselves, or unequal in depth.

    technologies: record, technology, type, hops, parents (names in an array of
    structs). Depths make circles visible: a parent must stand one step higher.
    """
    own = technologies.select(*record, F.col("technology").alias("_p"), F.col("hops").alias("_h"))
    edges = technologies.where("type = 'inferred'").select(*record, "technology", "hops", F.explode("parents").alias("p")).select(*record, "technology", "hops", F.col("p.technology").alias("_p"))
    joined = edges.join(own, [*record, "_p"], "left")
    issue = F.when(F.col("_h").isNull(), "parent missing").when(F.col("_h") != F.col("hops") - 1, "parent at wrong depth").when(F.col("hops") > most_hops, "too deep")
    return joined.select(*record, "technology", issue.alias("issue")).where("issue IS NOT NULL").distinct()


def limit_issues(records: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Add ``limit_issues``: usage counters above their configured limits (missing counters are within)."""
    found = F.array(*[F.when(F.coalesce(F.col(f"usage.{c}") > most, F.lit(False)), F.lit(c)) for c, most in limits.items()])
    return records.withColumn("limit_issues", F.filter(found, lambda x: x.isNotNull()))
