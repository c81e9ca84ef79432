"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import present, same_value, sql_same_value
from fathomline.llm import cooccurrence, langid, mixing, quantiles, term_counts, tokens
from fathomline.plans.registry import prepared
from fathomline.session import materialize, new_path, read_table

# --- percentiles of stage times --------------------------------------------------

STAGES = ("total", "target", "robots", "http", "dns", "tls", "browser", "detect")


def stage_times(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, stage, day, ms: every non-null stage time, each record counted once (latest delivery)."""
    timings = F.struct(*[F.col(f"timings.{s}_ms").alias(s) for s in STAGES])
    records = read_table(spark, folder, "domain_results").groupBy("run_id", "domain").agg(F.max_by(F.struct(F.to_date("ingested_at").alias("day"), timings.alias("t")), "ingested_at").alias("r"))
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"r.t.{s}").alias("ms")) for s in STAGES])
    return records.select("run_id", F.col("r.day").alias("day"), F.explode(pairs).alias("p")).select("run_id", "p.stage", "day", "p.ms").where("ms IS NOT NULL")


def run_digests(times: DataFrame) -> DataFrame:
    """Digests of each run and stage, merged from the digests of its days."""
    daily = quantiles.merge_digests(quantiles.build_digests(times, ["run_id", "stage", "day"], "ms"), ["run_id", "stage", "day"])
    return quantiles.merge_digests(daily.drop("day"), ["run_id", "stage"])


def p1_stage_times(spark: SparkSession, folder: str) -> DataFrame:
    """Average, p50 and p95 of every stage of every run, with the interval that holds each percentile."""
    return quantiles.read_quantiles(run_digests(stage_times(spark, folder)), [50, 95])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of run_summaries that are off by more than a fifth of the right value.

    The digest's interval decides; only where it leaves both answers open are
    the values around the stated figure counted exactly.
    """
    times, _, _ = materialize(stage_times(spark, folder), "stage-times")
    right = quantiles.read_quantiles(run_digests(times), [50, 95])
    said = read_table(spark, folder, "run_summaries").select("run_id", "stage", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("said")) for m in ("average", "p50", "p95")])).alias("s"))
    said = said.select("run_id", "stage", "s.measure", "s.said").where("said IS NOT NULL").distinct()
    measure, v = F.col("measure"), F.col("said")
    low = F.when(measure == "p50", F.col("p50_lo")).when(measure == "p95", F.col("p95_lo")).otherwise(F.col("average"))
    high = F.when(measure == "p50", F.col("p50_hi")).when(measure == "p95", F.col("p95_hi")).otherwise(F.col("average"))
    off = lambda x: F.abs(v - x) * 5 > F.abs(x)
    # A figure v is right for every value between 5v/6 and 5v/4, so the ends of the interval decide unless it crosses one of them.
    between = (v * 5 >= low * 4) & (v * 5 <= high * 6)
    verdict = F.when(~off(low) & ~off(high), "right").when(off(low) & off(high) & ~between, "wrong").otherwise("open")
    judged, _, path = materialize(said.join(right, ["run_id", "stage"]).select("run_id", "stage", "measure", "said", "n", verdict.alias("verdict")), "verdicts")
    wrong = judged.where("verdict = 'wrong'").select("run_id", "stage", "measure")
    still_open = judged.where("verdict = 'open'")
    if still_open.limit(1).count():
        percent = F.when(measure == "p50", 50).otherwise(95)
        counted = times.join(still_open, ["run_id", "stage"]).groupBy("run_id", "stage", "measure", "said", "n").agg(
            F.sum((F.col("ms") * 6 < v * 5).cast("long")).alias("below"), F.sum((F.col("ms") * 4 <= v * 5).cast("long")).alias("upto")
        )
        rank = F.floor((percent * F.col("n") + 99) / 100)
        wrong = wrong.unionByName(counted.where((F.col("below") >= rank) | (F.col("upto") < rank)).select("run_id", "stage", "measure"))
    return wrong.distinct()


#: A digest size at which the stages of a small collection are compressed too.
SMALL_K = 256


def p1_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of every stage over all runs by small digests, checked against exact ranks.

    Gives stage, percent, n, the true value, whether it lies in the reported
    interval, and whether the ranks of the interval's ends are off by no more
    than the guarantee allows.
    """
    times, _, _ = materialize(stage_times(spark, folder), "stage-times")
    small = quantiles.merge_digests(quantiles.build_digests(times, ["stage", "day"], "ms", k=SMALL_K), ["stage", "day"], k=SMALL_K)
    read = quantiles.read_quantiles(quantiles.merge_digests(small.drop("day"), ["stage"], k=SMALL_K), [50, 95])
    asked = read.select("stage", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"p{p}_lo").alias("lo"), F.col(f"p{p}_hi").alias("hi")) for p in (50, 95)])).alias("q")).select("stage", "n", "q.*")
    asked = asked.withColumn("rank", F.floor((F.col("percent") * F.col("n") + 99) / 100))
    # Stages and percents are few; each value is counted once per percent.
    ranks = times.join(F.broadcast(asked), "stage").groupBy("stage", "percent", "n", "lo", "hi", "rank").agg(F.sum((F.col("ms") < F.col("lo")).cast("long")).alias("below"), F.sum((F.col("ms") <= F.col("hi")).cast("long")).alias("upto"))
    exact = times.groupBy("stage").agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY ms)").cast("long").alias(f"v{p}") for p in (50, 95)])
    allowed = quantiles.UNIVERSE_BITS * F.col("n") / SMALL_K
    out = ranks.join(F.broadcast(exact), "stage").withColumn("value", F.when(F.col("percent") == 50, F.col("v50")).otherwise(F.col("v95")))
    return out.select("stage", "percent", "n", "value", ((F.col("lo") <= F.col("value")) & (F.col("value") <= F.col("hi"))).alias("holds"), ((F.col("rank") - F.col("below") <= allowed + 1) & (F.col("upto") - F.col("rank") <= allowed + 1)).alias("within_bound"))


# --- frequency of every term -----------------------------------------------------

#: The batch that a nightly run would add to the state: what came in over the last days.
NEWEST_DAYS = 7


FIELDS = ("technology", "rule_id", "code")


def count_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of technologies, rule ids and error codes, from the persistent state.

    The state takes everything but the newest week first, then the newest week
    (late rows and re-deliveries among it) as a batch of signed deltas.
    """
    old, new = [], []
    for space, (table, row, own) in enumerate((("evidence", "evidence_id", FIELDS[:2]), ("scan_errors", "error_id", FIELDS[2:]))):
        source = read_table(spark, folder, table)
        newest = source.agg(F.max("ingested_at")).first()[0]
        cut = F.lit(newest).cast(source.schema["ingested_at"].dataType) - F.expr(f"INTERVAL {NEWEST_DAYS} DAYS")
        terms = {f: present(F.col(f)) if f in own else F.lit(None).cast("string") for f in FIELDS}
        for batches, part in ((old, source.where(F.col("ingested_at") <= cut)), (new, source.where((F.col("ingested_at") > cut) | F.col("ingested_at").isNull()))):
            batches.append(term_counts.changes(part, [row], ["run_id", "domain"], "ingested_at", terms, space=space))
    state = term_counts.new_state(spark, new_path(spark, "term-state"), list(FIELDS))
    for batch in (old, new):
        state, _ = term_counts.apply_changes(state, batch[0].unionByName(batch[1]))
    term_counts.save_state(spark, state)
    return term_counts.read_counts(spark, state)


def _all_records(spark: SparkSession, folder: str) -> int:
    return read_table(spark, folder, "domain_results").select("run_id", "domain").distinct().count()


def p2_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, records and mark of every term."""
    return term_counts.mark_terms(count_terms(spark, folder), _all_records(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms in fewer than 3 records (rare) or in more than a quarter of all records (common)."""
    return p2_term_counts(spark, folder).where("mark IS NOT NULL").select("field", "term", "mark")


_SQL_COUNTS = f"""e AS (
  SELECT run_id, domain, {sql_same_value("technology")} AS technology, {sql_same_value("rule_id")} AS rule_id FROM evidence
  QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at DESC) = 1
), s AS (
  SELECT run_id, domain, {sql_same_value("code")} AS code FROM scan_errors QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY ingested_at DESC) = 1
), terms AS (
  SELECT 'technology' AS field, technology AS term, run_id, domain FROM e UNION ALL SELECT 'rule_id', rule_id, run_id, domain FROM e UNION ALL SELECT 'code', code, run_id, domain FROM s
), counts AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT (run_id, domain)) AS records FROM terms WHERE length(term) > 0 GROUP BY field, term
), marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.25 * (SELECT count(DISTINCT (run_id, domain)) FROM domain_results) THEN 'common' END AS mark FROM counts
)"""

# --- items that appear together --------------------------------------------------


def _pairs(spark: SparkSession, folder: str, **support) -> DataFrame:
    evidence = read_table(spark, folder, "evidence").select("run_id", "domain", present(F.col("technology")).alias("technology"), present(F.col("rule_id")).alias("rule_id"))
    return cooccurrence.item_pairs(evidence, ["run_id", "domain"], ["technology", "rule_id"], **support)


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of technologies and of rule ids, their ratio to chance and its significance."""
    pairs = _pairs(spark, folder).withColumn("significance", cooccurrence.significance())
    return pairs.withColumn("lift", F.round("lift", 6)).withColumn("llr", F.round("llr", 4))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs in at least 3 records and a hundredth of all that share at least five times as many as chance would give."""
    pairs = _pairs(spark, folder, min_records=3, min_share=(1, 100))
    # The catalog of rules has a fixed size; rules with equal names of their technology are no case.
    rules = read_table(spark, folder, "rules").select(same_value("rule_id").alias("rule"), same_value("technology").alias("tech")).distinct()
    side = lambda x: rules.select(F.col("rule").alias(f"item_{x}"), F.lit("rule_id").alias("field"), F.col("tech").alias(f"tech_{x}"))
    same = pairs.where("field = 'rule_id'").select("field", "item_a", "item_b").join(side("a"), ["field", "item_a"]).join(side("b"), ["field", "item_b"]).where("tech_a = tech_b")
    pairs = pairs.join(same.select("field", "item_a", "item_b").distinct(), ["field", "item_a", "item_b"], "left_anti")
    return pairs.where("n_ab >= 3 AND 100 * n_ab >= n_records AND n_ab * n_records >= 5 * n_a * n_b").select("field", "item_a", "item_b")


_SQL_PAIRS = f"""items AS (
  SELECT DISTINCT run_id, domain, 'technology' AS field, {sql_same_value("technology")} AS item FROM evidence UNION
  SELECT DISTINCT run_id, domain, 'rule_id', {sql_same_value("rule_id")} FROM evidence
), held AS (SELECT * FROM items WHERE length(item) > 0),
total AS (SELECT count(DISTINCT (run_id, domain)) AS n_records FROM evidence),
single AS (SELECT field, item, count(*) AS n FROM held GROUP BY field, item),
often AS (SELECT h.* FROM held h JOIN single USING (field, item), total WHERE n >= 3 AND 100 * n >= n_records),
pair_counts AS (SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM often a JOIN often b ON a.run_id = b.run_id AND a.domain = b.domain AND a.field = b.field AND a.item < b.item GROUP BY 1, 2, 3),
rule AS (SELECT DISTINCT {sql_same_value("rule_id")} AS rule, {sql_same_value("technology")} AS tech FROM rules),
pairs AS (
  SELECT p.*, x.n AS n_a, y.n AS n_b, n_records FROM pair_counts p JOIN single x ON x.field = p.field AND x.item = item_a JOIN single y ON y.field = p.field AND y.item = item_b, total
  WHERE n_ab >= 3 AND 100 * n_ab >= n_records
  AND NOT (p.field = 'rule_id' AND EXISTS (SELECT 1 FROM rule r JOIN rule s ON r.tech = s.tech WHERE r.rule = item_a AND s.rule = item_b))
)"""

_SQL_ALL_PAIRS = f"""items AS (
  SELECT DISTINCT run_id, domain, 'technology' AS field, {sql_same_value("technology")} AS item FROM evidence UNION
  SELECT DISTINCT run_id, domain, 'rule_id', {sql_same_value("rule_id")} FROM evidence
), held AS (SELECT * FROM items WHERE length(item) > 0),
total AS (SELECT count(DISTINCT (run_id, domain)) AS n_records FROM evidence),
single AS (SELECT field, item, count(*) AS n FROM held GROUP BY field, item),
counted AS (SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM held a JOIN held b ON a.run_id = b.run_id AND a.domain = b.domain AND a.field = b.field AND a.item < b.item GROUP BY 1, 2, 3),
cells AS (SELECT p.*, x.n AS n_a, y.n AS n_b, n_records FROM counted p JOIN single x ON x.field = p.field AND x.item = item_a JOIN single y ON y.field = p.field AND y.item = item_b, total),
measured AS (SELECT *, greatest(0, 2 * ({" + ".join(f"CASE WHEN {x} > 0 THEN ({x})::DOUBLE * ln({x}) ELSE 0 END" for x in ("n_ab", "n_a - n_ab", "n_b - n_ab", "n_records - n_a - n_b + n_ab", "n_records"))}
  - {" - ".join(f"CASE WHEN {x} > 0 THEN ({x})::DOUBLE * ln({x}) ELSE 0 END" for x in ("n_a", "n_records - n_a", "n_b", "n_records - n_b"))})) AS llr FROM cells)"""

# --- token ids and mixing ---------------------------------------------------------


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text; null and empty texts have the empty list."""
    return tokens.encode_corpus(read_table(spark, folder, "documents"), ["doc_id"], "text")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = read_table(spark, folder, "documents").select("doc_id", present(F.col("source")).alias("source"), "text")
    sizes = tokens.encode_corpus(documents, ["doc_id", "source"], "text", count_only=True)
    targets = read_table(spark, folder, "source_targets").select(same_value("source").alias("source"), "target_share", "max_repeats")
    return mixing.mix_sources(sizes, targets)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, folder)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that fall short of their share although every document is used as often as allowed."""
    return p8_shares(spark, folder).where("falls_short AND mixed_tokens = capacity_tokens").select("source")


# --- languages --------------------------------------------------------------------


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every stretch of every document, with the label it came with."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text", langid.label_code(F.col("lang")).alias("label"))
    model = langid.fit(read_table(spark, folder, "lang_samples"), documents)
    return langid.label_documents(documents, ["doc_id", "label"], "text", model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of several languages, and documents whose label is missing or wrong."""
    return p9_segments(spark, folder).where("n_segments > 1 OR label IS NULL OR label <> lang").select("doc_id", "segment_no", "lang")


QUERIES = {
    "p1_found": p1_found,
    "p1_stage_times": p1_stage_times,
    "p1_bounds": p1_bounds,
    "p2_found": p2_found,
    "p2_term_counts": p2_term_counts,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_mix": p8_mix,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
}

_SQL_TIMES = """records AS (SELECT run_id, timings FROM domain_results QUALIFY row_number() OVER (PARTITION BY run_id, domain ORDER BY ingested_at DESC) = 1),
times AS (""" + " UNION ALL ".join(f"SELECT run_id, '{s}' AS stage, timings.{s}_ms AS ms FROM records" for s in STAGES) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY ms) AS r, count(*) OVER (PARTITION BY run_id, stage) AS n FROM times WHERE ms IS NOT NULL),
rights AS (SELECT run_id, stage, avg(ms) AS average, max(CASE WHEN r = (50 * n + 99) // 100 THEN ms END) AS p50, max(CASE WHEN r = (95 * n + 99) // 100 THEN ms END) AS p95 FROM ranked GROUP BY 1, 2)"""

ORACLE_SQL = {
    "p1_found": f"WITH {_SQL_TIMES} "
    + " UNION ".join(f"SELECT s.run_id, s.stage, '{m}' AS measure FROM run_summaries s JOIN rights r USING (run_id, stage) WHERE abs(s.{m} - r.{m}) * 5 > r.{m}" for m in ("average", "p50", "p95")),
    "p1_stage_times": f"WITH {_SQL_TIMES} SELECT run_id, stage, count(*) AS n, sum(ms) / count(*) AS average, CAST(any_value(p50) AS BIGINT) AS p50_lo, CAST(any_value(p50) AS BIGINT) AS p50_hi, CAST(any_value(p95) AS BIGINT) AS p95_lo, CAST(any_value(p95) AS BIGINT) AS p95_hi FROM ranked JOIN rights USING (run_id, stage) GROUP BY 1, 2",
    "p1_bounds": f"WITH {_SQL_TIMES}, o AS (SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms) AS r, count(*) OVER (PARTITION BY stage) AS n FROM times WHERE ms IS NOT NULL), q AS (SELECT unnest([50, 95])::INTEGER AS percent) "
    "SELECT stage, percent, n, ms AS value, true AS holds, true AS within_bound FROM o, q WHERE r = (percent * n + 99) // 100",
    "p2_found": f"WITH {_SQL_COUNTS} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_term_counts": f"WITH {_SQL_COUNTS} SELECT * FROM marked",
    "p4_pairs": f"WITH {_SQL_ALL_PAIRS} SELECT field, item_a, item_b, n_ab, n_a, n_b, n_records, round(n_ab * n_records / (n_a::DOUBLE * n_b), 6) AS lift, round(llr, 4) AS llr, CASE "
    + " ".join(f"WHEN llr >= {least} THEN {level}::DOUBLE" for level, least in cooccurrence.LEVELS) + " END AS significance FROM measured",
    "p4_found": f"WITH {_SQL_PAIRS} SELECT field, item_a, item_b FROM pairs WHERE n_ab * n_records >= 5 * n_a * n_b",
}

QUERIES = {name: prepared(query) for name, query in QUERIES.items()}
