"""The join of candidates with rules: presence, literal and pattern predicates.

Candidates look rules up by hash. A rule stands in one slot of its source: under
its key if it has an exact locator; otherwise under a run of four characters that
every match must hold, where there is one; otherwise under the source alone. A
candidate looks into the slots of its key, of the runs of its value and of its
source, so that a long value meets the few rules whose run it holds instead of
all of them. The rules are a bounded dimension (checked in rows and bytes), so
candidates never move.

Everything runs on the JVM: patterns are translated and compiled when a catalog
is prepared, and those that are not valid are set apart (:func:`fathomline.operators.catalog.rejected_rules`).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import policy
from fathomline.functions.redact import render_version
from fathomline.operators.catalog import MAX_RULES, compile_patterns, locator_kind, normal_locator
from fathomline.session import checked_broadcast, materialize

#: Characters of the runs by which rules without a key are looked up.
RUN = 4


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules that can run, with their engine patterns, needle and slot, materialised once (a bounded table)."""
    spark = rules.sparkSession
    compiled = checked_broadcast(compile_patterns(rules), 2 * MAX_RULES)
    own = compiled.select(F.col("pattern").alias("_p"), "java_pattern", "n_groups", "needle", F.col("problem").alias("_bad"))
    key = compiled.select(F.col("pattern").alias("_l"), F.col("java_pattern").alias("java_locator"), F.col("problem").alias("_bad_key"))
    literal = F.col("match_mode") == "literal"
    needle = F.when(literal & F.col("pattern").rlike(r"\A[\x00-\x7f]*\z"), F.lower("pattern")).when(F.col("match_mode") == "regex", F.col("needle")).otherwise("")
    joined = rules.join(own, (rules["pattern"] == F.col("_p")) & (F.col("match_mode") == "regex"), "left").join(key, F.col("locator_pattern") == F.col("_l"), "left").where("_bad IS NULL AND _bad_key IS NULL")
    ready = joined.select(
        "rule_id", "technology", F.col("source").alias("r_source"), normal_locator(F.col("source"), F.col("locator")).alias("locator"), "java_locator", "pattern", "match_mode", "confidence", "version_template",
        "java_pattern", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce(needle, F.lit("")).alias("needle"), locator_kind().alias("locator_kind"),
    )
    needles = [r[0] for r in ready.where((F.col("locator_kind") == "none") & (F.length("needle") >= RUN)).select("needle").distinct().collect()]
    often = Counter(run for n in needles for run in {n[i : i + RUN] for i in range(len(n) - RUN + 1)})
    runs = [(n, min((n[i : i + RUN] for i in range(len(n) - RUN + 1)), key=lambda r: (often[r], r))) for n in needles]
    chosen = spark.createDataFrame(runs, "_n string, _run string")
    slot = F.when(F.col("locator_kind") == "exact", F.concat(F.lit("="), "locator")).when((F.col("locator_kind") == "none") & F.col("_run").isNotNull(), F.concat(F.lit("~"), "_run")).otherwise("*")
    placed = ready.join(checked_broadcast(chosen, MAX_RULES), F.col("needle") == F.col("_n"), "left").withColumn("slot", slot).drop("_n", "_run")
    return materialize(placed, "rules")[0]


def lookups(sources: list[str]) -> Column:
    """The slots that a candidate looks into. sources: those whose rules are looked up by runs of the value."""
    own = F.array(F.lit("*"), F.concat(F.lit("="), "key"))
    runs = F.regexp_extract_all(F.lower("value"), F.lit(f"(?s)(?=(.{{{RUN}}}))"), F.lit(1))
    held = F.when(F.col("source").isin(sources) & F.col("value").isNotNull(), F.transform(F.array_distinct(runs), lambda r: F.concat(F.lit("~"), r)))
    return F.filter(F.concat(own, F.coalesce(held, F.array().cast("array<string>"))), lambda x: x.isNotNull())


def applicable(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of candidates and rules that may match by source, key, kind and what the value holds.

    One hash join; a rule stands in one slot, so a pair comes up once. Candidates stay where they are.
    """
    sources = sorted(r[0] for r in rules.where(F.startswith("slot", F.lit("~"))).select("r_source").distinct().collect())
    looking = candidates.withColumn("_slot", F.explode(lookups(sources)))
    kind_fits = (F.col("kind") == "value") | (F.col("match_mode") == "presence")
    named = (F.col("locator_kind") != "pattern") | F.rlike("key", F.col("java_locator"))
    on = (F.col("source") == F.col("r_source")) & (F.col("_slot") == F.col("slot")) & kind_fits & named
    return looking.join(checked_broadcast(rules, MAX_RULES), on).drop("_slot", "slot")


def group_text(value: Column, pattern: Column, group: Column) -> Column:
    """The text of a group of the first match (group 0: the match); empty if the group took no part."""
    return F.call_function("regexp_extract", value, pattern, group)


def literal_span(value: Column, pattern: Column) -> Column:
    """Struct start, size of the first place of a text, letters of both cases alike; null if there is none.

    The search runs over lower-case texts; where lower case changes the length,
    places are counted back character by character, and a place that begins or
    ends inside a character is none.
    """
    low, wanted = F.lower(value), F.lower(pattern)
    at, size = F.position(wanted, low), F.char_length(wanted)
    grown = F.transform(F.split(value, ""), lambda c: F.char_length(F.lower(c)))
    ends = F.aggregate(grown, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))

    def counted(ends: Column) -> Column:
        start, stop = F.array_position(ends, at - 1), F.array_position(ends, at - 1 + size)
        return F.when((start > 0) & (stop > 0), F.struct((start - 1).cast("int").alias("start"), (stop - start).cast("int").alias("size")))

    plain = F.struct((at - 1).cast("int").alias("start"), size.cast("int").alias("size"))
    same = F.char_length(low) == F.char_length(value)
    return F.when(at > 0, F.when(same, plain).otherwise(F.transform(F.array(ends), counted)[0]))


def is_match() -> Column:
    """The predicate of the rule's mode on a pair."""
    mode, value = F.col("match_mode"), F.col("value")
    pattern = F.contains(F.lower(value), F.col("needle")) & F.rlike("value", F.col("java_pattern"))
    return F.when(mode == "presence", True).when(mode == "literal", literal_span(value, F.col("pattern")).isNotNull()).otherwise(pattern)


def match_rules(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches with the matched text, its place and the rendered version.

    candidates: any columns with source, kind, key, value (keys as candidates
    have them); rules: see :func:`prepare_rules`. Only the first match of a rule
    in a value counts. Null values meet presence rules only.
    """
    mode, value = F.col("match_mode"), F.col("value")
    regex, literal = mode == "regex", mode == "literal"
    pairs = applicable(candidates, rules).where(is_match()).withColumn("_span", F.when(literal, literal_span(value, F.col("pattern"))))
    matched = F.when(regex, group_text(value, F.col("java_pattern"), F.lit(0))).when(literal, F.substring(value, F.col("_span.start") + 1, F.col("_span.size"))).otherwise("")
    place = F.when(regex, F.regexp_instr(value, F.col("java_pattern")) - 1).when(literal, F.col("_span.start")).otherwise(0).cast("int")
    groups = F.transform(F.sequence(F.lit(1), F.col("n_groups")), lambda i: group_text(value, F.col("java_pattern"), i))
    held = F.when(F.col("n_groups") > 0, groups).otherwise(F.array().cast("array<string>"))
    version = F.when(regex & F.col("version_template").isNotNull(), render_version(F.col("version_template"), held))
    shown = pairs.select("*", matched.alias("matched"), place.alias("match_index"), F.char_length(matched).alias("match_length"), version.alias("version"))
    return shown.drop("_span", "r_source", "locator", "java_locator", "java_pattern", "n_groups", "needle", "locator_kind")


def dedupe_matches(matches: DataFrame, record: list[str], most: int = policy.MATCHES_PER_DOMAIN) -> DataFrame:
    """One match per rule and candidate, at most ``most`` of a record, with ``overflow`` where the limit cut."""
    unique = matches.dropDuplicates([*record, "rule_id", "candidate_id"])
    w = Window.partitionBy(*record)
    numbered = unique.withColumn("_at", F.row_number().over(w.orderBy("rule_id", "candidate_id"))).withColumn("overflow", F.count(F.lit(1)).over(w) > most)
    return numbered.where(F.col("_at") <= most).drop("_at")


def in_result_order(matches: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Matches by the rule's place in the catalog, then the candidate's id. ordinals: rule_id, ordinal (see :func:`fathomline.operators.catalog.rule_order`)."""
    return matches.join(checked_broadcast(ordinals.select("rule_id", "ordinal"), MAX_RULES), "rule_id").orderBy("ordinal", "candidate_id")


def pair_costs(candidates: DataFrame, rules: DataFrame, record: list[str]) -> DataFrame:
    """Work of each candidate: the rules of its source that fit its key and kind, and among them pattern runs.

    Rules with the same conditions are counted once for all candidates; only
    those with a pattern for the key meet each candidate of their source.
    """
    kinds = F.col("match_mode")
    counts = rules.where("locator_kind <> 'pattern'").groupBy("r_source", F.when(F.col("locator_kind") == "exact", F.col("locator")).alias("_exact")).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(kinds == "presence").alias("_presence"), F.count_if(kinds == "regex").alias("_regex")
    )
    key = F.col("key")
    looking = candidates.withColumn("_key", F.explode(F.when(key.isNotNull(), F.array(F.lit(None).cast("string"), key)).otherwise(F.array(F.lit(None).cast("string")))))
    direct = looking.join(checked_broadcast(counts, MAX_RULES), (F.col("source") == F.col("r_source")) & F.col("_key").eqNullSafe(F.col("_exact")))
    valued = F.col("kind") == "value"
    parts = [direct.select(*record, "candidate_id", F.when(valued, F.col("_all")).otherwise(F.col("_presence")).alias("pairs"), F.when(valued, F.col("_regex")).otherwise(0).alias("regex_runs"))]
    named = rules.where("locator_kind = 'pattern'")
    fits = (F.col("source") == F.col("r_source")) & F.rlike("key", F.col("java_locator")) & (valued | (F.col("match_mode") == "presence"))
    parts.append(candidates.join(checked_broadcast(named, MAX_RULES), fits).select(*record, "candidate_id", F.lit(1).alias("pairs"), (F.col("match_mode") == "regex").cast("int").alias("regex_runs")))
    return parts[0].unionByName(parts[1]).groupBy(*record, "candidate_id").agg(F.sum("pairs").alias("pairs"), F.sum("regex_runs").alias("regex_runs")).where("pairs > 0")


#: Timeouts of rules in one record after which its detection ends.
MOST_TIMEOUTS = 3


def ended_records(timeouts: DataFrame, record: list[str], most: int = MOST_TIMEOUTS) -> DataFrame:
    """Records in which so many rules timed out that detection ended. timeouts: record, rule_id."""
    return timeouts.select(*record, "rule_id").distinct().groupBy(*record).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select(*record)


def drop_timed_out(matches: DataFrame, timeouts: DataFrame, record: list[str]) -> DataFrame:
    """Without the matches of rules that timed out in the record, and of rules that would have run after the one that ended it.

    timeouts: record, rule_id and, where rules ran in order, ordinal; matches
    then need ordinal too.
    """
    if "ordinal" in timeouts.columns and "ordinal" in matches.columns:
        nth = F.row_number().over(Window.partitionBy(*record).orderBy("ordinal"))
        last = timeouts.select(*record, "rule_id", "ordinal").distinct().withColumn("_nth", nth).where(F.col("_nth") == MOST_TIMEOUTS).select(*record, F.col("ordinal").alias("_last"))
        matches = matches.join(last, record, "left").where("_last IS NULL OR ordinal < _last").drop("_last")
    return matches.join(timeouts.select(*record, "rule_id").distinct(), [*record, "rule_id"], "left_anti")
