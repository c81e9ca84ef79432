"""Evaluation of cheaper collection: detector views, folds, tokens, smoothed models, quotas, selections, retention, verdicts.

A *view* is what the detector finds on a prefix of the observations of a record:
``t1`` the entry page and infrastructure, ``t2`` also one more static page, probes
and robots texts, ``full`` everything. A model learns from the full views of
other records which records are worth a full collection; a bounded number of
them is selected and judged by what they keep and cost.

Views are long tables (key, view, name). Models are long tables of sums per
token; a model without a fold is the total minus that fold's sums, so no row of
a record is copied per fold. The selections are sequential, but a record's worth
never rises while others are selected, so a pool of the best worths is enough as
long as the pool's choice beats every record outside of it; that is proven by
the run itself. Otherwise the greedy choice weighs all records anew and takes
another pool of that size, and the pool of the label-aware one doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fathomline.operators.detection import direct_detections
from fathomline.operators.graph import direct_names, relations_of, resolve_technologies, slices
from fathomline.session import ensure_workers_import, materialize

N_FOLDS = 5
PRIOR = 4
RECURRING = 2
VIEWS = ("t1", "t2", "full")
#: Fixed values of the verdict: shares of names and pairs to keep, domains to select, tenths of each cost, folds to win.
NAME_SHARE, PAIR_SHARE, MOST_SELECTED, COST_TENTHS, FOLD_WINS = 0.95, 0.80, 40, 3, 4
CONTROLS = 2
FIRST_POOL = 500
#: Names, rules and tokens that are broadcast; beyond that the planner joins them.
MOST_NAMES = 1_000_000
#: Worths that are equal to this many decimals are ties.
DECIMALS = 9


# --- folds and samples ------------------------------------------------------------


def salted_number(salt: str, value: Column) -> Column:
    """The first 32 bits of the SHA-256 of salt, NUL and value."""
    return F.conv(F.substring(salted_hash(salt, value), 1, 8), 16, 10).cast("long")


def salted_hash(salt: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), value), 256)


def fold(salt: str, domain: Column, n: int = N_FOLDS) -> Column:
    return F.pmod(salted_number(salt, domain), F.lit(n)).cast("int")


def hash_sample(df: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """The n rows with the smallest salted hashes: a report-sized, repeatable sample."""
    return df.withColumn("_h", salted_hash(salt, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def control_sample(domains: DataFrame, selected: DataFrame, key: str, group: str, salt: str, per_group: DataFrame) -> DataFrame:
    """Per group the domains with the smallest salted hashes among those not selected; per_group: group, quota."""
    rest = domains.join(selected.select(key).distinct(), key, "left_anti")
    most = per_group.agg(F.max("quota")).first()[0] or 0
    w = Window.partitionBy(group).orderBy(salted_hash(salt, F.col(key)), key)
    # A constant bound lets every task keep its own few rows before they move.
    first = rest.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= most)
    return first.join(F.broadcast(per_group.select(group, F.col("quota").alias("_quota"))), group).where(F.col("_at") <= F.col("_quota")).drop("_at", "_quota")


def largest_remainder(sizes: DataFrame, key: str, size: str, seats: int) -> DataFrame:
    """key, quota: seats in proportion to sizes, the rest by largest remainder, ties by key; no quota above its size."""
    every = Window.partitionBy()
    exact = F.col(size) * seats
    rows = sizes.withColumn("_sum", F.sum(size).over(every)).withColumn("_whole", F.floor(exact / F.col("_sum")).cast("long")).withColumn("_rest", exact - F.col("_whole") * F.col("_sum"))
    rows = rows.withColumn("_left", F.lit(seats) - F.sum("_whole").over(every)).withColumn("_place", F.row_number().over(Window.orderBy(F.col("_rest").desc(), key)))
    return rows.select(key, F.least(F.col(size).cast("long"), F.col("_whole") + (F.col("_place") <= F.col("_left")).cast("long")).alias("quota"))


def fold_quotas(sizes: DataFrame, seats: int = MOST_SELECTED, controls: int = CONTROLS) -> DataFrame:
    """fold, routed, control, trigger: the seats of each fold (fold, n) and which of them are controls."""
    routed, control = (largest_remainder(sizes, "fold", "n", k).withColumnRenamed("quota", name) for k, name in ((seats, "routed"), (controls, "control")))
    return routed.join(control, "fold").select("fold", "routed", "control", (F.col("routed") - F.col("control")).alias("trigger"))


# --- views and tokens --------------------------------------------------------------


def tier(collector: Column, source: Column, page_id: Column) -> Column:
    """The first view that has an observation: 1 entry page and infrastructure, 2 the second static page, probes and robots texts, 3 everything else."""
    static = collector == "http"
    return (
        F.when(collector.isin("dns", "tls"), 1).when(static & source.isin("probe", "robots"), 2).when(static & (page_id.isNull() | (page_id == "p1")), 1)
        .when(static & (page_id == "p2"), 2).otherwise(3)
    )


def detector_views(evidence: DataFrame, revisions: DataFrame, edges: DataFrame, record: list[str]) -> DataFrame:
    """record, view, technology, type, confidence and counts of the detector run on each prefix of the observations.

    evidence: one row per match of an observation, with collector, source and
    page_id. Matching looks at one observation at a time, so the matches of a
    prefix are those of its observations; confidence, gates, implications and
    exclusions are worked out anew for every view.
    """
    first = tier(F.col("collector"), F.col("source"), F.col("page_id"))
    seen = evidence.withColumn("_view", F.explode(F.sequence(first, F.lit(len(VIEWS))))).withColumn("view", F.get(F.array(*[F.lit(v) for v in VIEWS]), F.col("_view") - 1))
    direct = direct_detections(seen, [*record, "view"]).join(revisions, record, "left")
    return resolve_technologies(direct, edges, [*record, "view"])


def packed_views(evidence: DataFrame, revisions: DataFrame, edges: DataFrame, key: str = "key", slice_rows: int = 20_000, spelling: Callable[[Column], Column] | None = None, deliveries: DataFrame | None = None) -> DataFrame:
    """One row per record with evidence: key and for every view the direct technologies (``t1``, ``t2``, ``full``) and their counts (``t1_stats`` and so on).

    What :func:`detector_views` finds, without implied technologies. evidence:
    key, technology, rule_id, confidence, collector, source, page_id. Evidence
    moves once, as numbers of its (technology, rule); a record's views are
    resolved together and equal ones once. revisions: key, revision; evidence of
    other records is left out. spelling: the form under which technologies and
    rule ids are the same value (null: no value), worked out for their distinct
    spellings alone; default: they are compared as they stand. deliveries: rows
    with at least the technologies and rule ids of evidence that cost less to read.
    """
    spark = evidence.sparkSession
    ensure_workers_import(spark)
    words, same = ["technology", "rule_id"], spelling or (lambda c: c)
    found = evidence.where(f"`{key}` IS NOT NULL").select(key, *words, F.col("confidence").cast("int").alias("confidence"), tier(F.col("collector"), F.col("source"), F.col("page_id")).alias("_tier"))
    spelled = (evidence if deliveries is None else deliveries).select(*words).distinct().select(*words, *[same(F.col(c)).alias(f"_{c}") for c in words]).where("_technology IS NOT NULL AND _rule_id IS NOT NULL")
    spelled, n_spelled, _ = materialize(spelled.withColumn("_pair", F.dense_rank().over(Window.orderBy("_technology", "_rule_id"))), "pairs")
    pairs = spelled.select("_pair", F.col("_technology").alias("technology")).distinct()
    known = spelled.select(*words, "_pair")
    if n_spelled <= MOST_NAMES:
        known, pairs = F.broadcast(known), F.broadcast(pairs)
    slim = found.join(known, words).select(key, "_pair", "confidence", "_tier").repartition(key)
    views = range(1, len(VIEWS) + 1)
    per_rule = slim.groupBy(key, "_pair").agg(*[F.max(F.when(F.col("_tier") <= v, F.col("confidence"))).alias(f"_c{v}") for v in views])
    sums = [x for v in views for x in (F.least(F.lit(100), F.sum(f"_c{v}")).cast("int").alias(f"_s{v}"), F.max(f"_c{v}").alias(f"_m{v}"))]
    per_name = per_rule.join(pairs, "_pair").groupBy(key, "technology").agg(*sums)
    packed = per_name.groupBy(key).agg(F.collect_list(F.struct("technology", *[F.when(F.col(f"_m{v}") > 0, F.col(f"_s{v}")).alias(f"c{v}") for v in views])).alias("_found"))
    known_revisions = revisions.select(key, F.coalesce("revision", F.lit("")).alias("revision"))
    sizes, _, _ = materialize(slices(known_revisions, slice_rows), "slices")
    left = packed.join(known_revisions, key).join(F.broadcast(sizes), "revision").select(key, "revision", F.pmod(F.xxhash64(key), F.col("_slices")).alias("_slice"), "_found.technology", *[f"_found.c{v}" for v in views])
    right = edges.where("revision IS NOT NULL").join(F.broadcast(sizes), "revision").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    schema = f"`{key}` string, " + ", ".join(f"`{v}` array<string>, `{v}_stats` array<int>" for v in VIEWS)
    result = to_arrow_schema(StructType.fromDDL(schema))

    def run(rows: pa.Table, links: pa.Table) -> pa.Table:
        relations = relations_of(links.to_pylist())
        out: list[list] = [[] for _ in result]
        for record, names, *confidences in zip(*[rows[c].to_pylist() for c in (key, "technology", *[f"c{v}" for v in views])]):
            out[0].append(record)
            before, done = None, (None, None)
            for v, of_view in enumerate(confidences):
                own = {n: c for n, c in zip(names, of_view) if c is not None and c > 0}
                if own != before:
                    before, done = own, direct_names(own, relations) if own else ([], None)
                out[1 + 2 * v].append(done[0])
                out[2 + 2 * v].append(done[1])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, result)], schema=result)

    return left.groupBy("revision", "_slice").cogroup(right.groupBy("revision", "_slice")).applyInArrow(run, schema)


def long_views(packed: DataFrame, key: str = "key") -> DataFrame:
    """key, view, name of packed views."""
    both = F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("names")) for v in VIEWS])
    return packed.select(key, F.explode(both).alias("v")).select(key, "v.view", F.explode("v.names").alias("name"))


def power_bin(value: Column) -> Column:
    """``0``, ``1`` or the power-of-two interval ``lo-hi`` of a whole number, by its binary digits (no logarithm)."""
    k = F.length(F.bin(value.cast("long"))) - 1
    low = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return F.when(value.isin(0, 1), value.cast("string")).when(value > 1, F.concat(low.cast("string"), F.lit("-"), (low * 2 - 1).cast("string")))


def _quoted(name: Column) -> Column:
    """The JSON text of a name: that of a list of it without its brackets."""
    text = F.to_json(F.array(name))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def feature_tokens(names: DataFrame, states: DataFrame, errors: DataFrame, features: DataFrame, numbers: list[str], words: list[str], key: str = "key") -> DataFrame:
    """key, token of what is known before a full collection: the first two views and features of the entry; each token once.

    names: key, view, name of direct detections. states: key, view, state, reason
    and the counts raw_direct to retained_direct. errors: key, view, stage, code,
    retryable, n. features: key, numbers (binned) and words.
    The full view, its costs and inferred names are not among the inputs.
    """
    early = lambda df: df.where(F.col("view").isin("t1", "t2"))
    names, states, errors = early(names).select(key, "view", "name").distinct(), early(states), early(errors)
    available = states.where("state = 'available'").select(key, "view")
    names = names.join(available, [key, "view"], "left_semi")
    counts = available.join(names.groupBy(key, "view").agg(F.count(F.lit(1)).alias("n")), [key, "view"], "left").select(key, "view", F.coalesce("n", F.lit(0)).alias("n"))
    both = available.groupBy(key).agg(F.count(F.lit(1)).alias("_views")).where("_views = 2").select(key)
    more = names.where("view = 't2'").select(key, "name").join(names.where("view = 't1'").select(key, "name"), [key, "name"], "left_anti").join(both, key, "left_semi")
    more_counts = both.join(more.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    stats = [c for c in ("raw_direct", "gated_direct", "suppressed_direct", "retained_direct") if c in states.columns]
    error = F.concat_ws(":", "stage", "code", F.col("retryable").cast("string"))
    tokens = [
        states.select(key, F.explode(F.array(F.concat("view", F.lit(".state="), "state"), F.concat("view", F.lit(".reason="), F.when(F.col("state") != "available", F.col("reason"))))).alias("token")),
        names.select(key, F.concat("view", F.lit(".direct="), _quoted(F.col("name"))).alias("token")),
        counts.select(key, F.concat("view", F.lit(".direct.count="), power_bin(F.col("n"))).alias("token")),
        states.where("state = 'available'").select(key, F.explode(F.array(*[F.concat("view", F.lit(f".detection.{c}="), power_bin(F.coalesce(F.col(c), F.lit(0)))) for c in stats])).alias("token")),
        errors.join(available, [key, "view"], "left_semi").select(key, F.explode(F.array(F.concat("view", F.lit(".error="), error), F.concat("view", F.lit(".error.count="), error, F.lit(":"), power_bin(F.col("n"))))).alias("token")),
        more.select(key, F.concat(F.lit("t2.incrementalDirect="), _quoted(F.col("name"))).alias("token")),
        more_counts.select(key, F.concat(F.lit("t2.incrementalDirect.count="), power_bin(F.col("n"))).alias("token")),
        features.select(key, F.explode(F.array(*[F.concat(F.lit(f"preBrowser.{c}="), power_bin(F.col(c))) for c in numbers], *[F.concat(F.lit(f"preBrowser.{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in words])).alias("token")),
    ]
    return reduce(DataFrame.unionByName, tokens).where("token IS NOT NULL").distinct()


def case_tokens(records: DataFrame, numbers: list[str], words: list[str], stats: list[str]) -> Column:
    """The tokens of :func:`feature_tokens` of a record as an array, each once, from the record's own row.

    records has failed, t1, t2, t1_stats, t2_stats (see :func:`packed_views`;
    null: nothing found), errors (array of view, what, n), numbers and words.
    """
    usable, none = ~F.col("failed"), F.array().cast("array<string>")
    names = {v: F.coalesce(F.col(v), none) for v in ("t1", "t2")}
    labelled = lambda prefix: lambda x: F.concat(F.lit(prefix), _quoted(x))
    count = lambda prefix, n: F.concat(F.lit(prefix), power_bin(n))
    of_view = lambda v: F.filter(F.coalesce("errors", F.array().cast("array<struct<view:string,what:string,n:bigint>>")), lambda e: e["view"] == v)
    fault = lambda prefix: lambda e: F.concat(F.lit(prefix), e["what"])
    faults = lambda prefix: lambda e: F.concat(F.lit(prefix), e["what"], F.lit(":"), power_bin(e["n"]))
    more = F.array_except(names["t2"], names["t1"])
    parts = []
    for v in ("t1", "t2"):
        errors = of_view(v)
        parts.append(F.array(F.concat(F.lit(f"{v}.state="), F.when(usable, "available").otherwise("unavailable")), F.when(~usable, F.lit(f"{v}.reason=failed"))))
        parts.append(F.when(usable, F.concat(
            F.transform(names[v], labelled(f"{v}.direct=")), F.array(count(f"{v}.direct.count=", F.size(names[v]))),
            F.array(*[count(f"{v}.detection.{c}=", F.coalesce(F.get(f"{v}_stats", F.lit(i)), F.lit(0))) for i, c in enumerate(stats)]),
            F.transform(errors, fault(f"{v}.error=")), F.transform(errors, faults(f"{v}.error.count=")),
        )).otherwise(none))
    parts.append(F.when(usable, F.concat(F.transform(more, labelled("t2.incrementalDirect=")), F.array(count("t2.incrementalDirect.count=", F.size(more))))).otherwise(none))
    parts.append(F.array(*[count(f"preBrowser.{c}=", F.col(c)) for c in numbers], *[F.concat(F.lit(f"preBrowser.{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in words]))
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull()))


def pack(tokens: DataFrame, views: DataFrame, folds: DataFrame, key: str = "key") -> DataFrame:
    """Cases from long tables: key, fold, tokens, t2, full, one row per domain of folds."""
    t = tokens.groupBy(key).agg(F.collect_list("token").alias("tokens"))
    of = lambda v: F.collect_set(F.when(F.col("view") == v, F.col("name"))).alias(v)
    v = views.where("view IN ('t2', 'full')").groupBy(key).agg(of("t2"), of("full"))
    none = F.array().cast("array<string>")
    return folds.join(t, key, "left").join(v, key, "left").select(key, "fold", *[F.coalesce(c, none).alias(c) for c in ("tokens", "t2", "full")])


def case_sides(cases: DataFrame, key: str = "key") -> DataFrame:
    """key, name, cheap, full: the names of t2 and the full view of cases, and which of them has it."""
    named = cases.select(key, "t2", "full", F.explode(F.array_union("t2", "full")).alias("name"))
    return named.select(key, "name", F.array_contains("t2", F.col("name")).cast("int").alias("cheap"), F.array_contains("full", F.col("name")).cast("int").alias("full"))


def view_sides(views: DataFrame, key: str = "key") -> DataFrame:
    """key, name, cheap, full of long views (key, view, name); a table that has them already stays."""
    if {"cheap", "full"} <= set(views.columns):
        return views
    return views.where("view IN ('t2', 'full')").groupBy(key, "name").agg(F.max((F.col("view") == "t2").cast("int")).alias("cheap"), F.max((F.col("view") == "full").cast("int")).alias("full"))


def unmapped_names(names: DataFrame, categories: DataFrame) -> DataFrame:
    """The names (name) that have no category entry."""
    return names.join(categories.select("name").distinct(), "name", "left_anti")


def category_tokens(names: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """key, token of the categories of a domain's technologies; raises if a name has no category entry.

    names: key, name; categories: name, category.
    """
    if unmapped_names(names, categories).limit(1).count():
        raise ValueError("a technology has no category mapping")
    return names.join(categories, "name").select(key, F.concat(F.lit("t2.category="), F.col("category").cast("string")).alias("token")).distinct()


# --- targets and models ------------------------------------------------------------


def pair_targets(views: DataFrame, folds: DataFrame, key: str = "key") -> DataFrame:
    """key, fold, target: how many names only the full view has. views: key, view, name; folds: key, fold."""
    full, cheap = (views.where(F.col("view") == v).select(key, "name").distinct() for v in ("full", "t2"))
    n = full.join(cheap, [key, "name"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("target"))
    return folds.join(n, key, "left").select(key, "fold", F.coalesce("target", F.lit(0)).cast("long").alias("target"))


def name_counts(views: DataFrame, folds: DataFrame, key: str = "key") -> DataFrame:
    """name, fold, n_t2, n_full, n_kept: the domains of each fold whose view has the name, and that keep it in t2."""
    per = views.where("view IN ('t2', 'full')").join(folds, key).groupBy(key, "fold", "name").agg(F.max((F.col("view") == "t2").cast("int")).alias("a"), F.max((F.col("view") == "full").cast("int")).alias("b"))
    return per.groupBy("name", "fold").agg(F.sum("a").alias("n_t2"), F.sum("b").alias("n_full"), F.sum(F.col("a") * F.col("b")).alias("n_kept"))


def _without(sums: DataFrame, by: list[str], held: DataFrame, columns: list[str]) -> DataFrame:
    """Sums over all folds but the held-out one: the total minus that fold's. sums: a written table, it is read twice; held: held_out (a handful of folds)."""
    total = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])
    own = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("fold").alias("_fold"), *[F.col(c).alias(f"_own_{c}") for c in columns])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in by], F.col("held_out") == F.col("_fold"))
    spread = total.crossJoin(F.broadcast(held)).join(own, on, "left")
    return spread.select("held_out", *by, *[(F.col(c) - F.coalesce(f"_own_{c}", F.lit(0))).alias(c) for c in columns])


def name_heads(counts: DataFrame, held: DataFrame) -> DataFrame:
    """held_out, name, support of the names that no training domain has in t2 (support 1: rare, more: recurring)."""
    rest = _without(counts, ["name"], held, ["n_t2", "n_full"])
    return rest.where("n_t2 = 0 AND n_full > 0").select("held_out", "name", F.col("n_full").alias("support"))


def objectives(counts: DataFrame, targets: DataFrame, held: DataFrame) -> DataFrame:
    """One row per held-out fold: training domains, the sums and deficits of its training set."""
    rest = _without(counts, ["name"], held, ["n_t2", "n_full", "n_kept"])
    names = rest.groupBy("held_out").agg(
        F.sum("n_full").alias("pairs"), F.sum("n_kept").alias("pairs_kept"), F.count_if(F.col("n_full") > 0).alias("names"), F.count_if((F.col("n_full") > 0) & (F.col("n_t2") > 0)).alias("names_kept"),
        F.count_if((F.col("n_t2") == 0) & (F.col("n_full") == 1)).alias("rare_sum"),
    )
    per = targets.groupBy("fold").agg(F.count(F.lit(1)).alias("domains"), F.sum("target").alias("pair_sum")).withColumn("one", F.lit(1))
    sums = _without(materialize(per, "fold-sums")[0], ["one"], held, ["domains", "pair_sum"])
    deficit = lambda total, kept, percent: F.greatest(F.lit(1), ceil_share(F.col(total), percent) - F.col(kept))
    return sums.drop("one").where("domains > 0").join(names, "held_out", "left").select(
        "held_out", "domains", "pair_sum", F.coalesce("rare_sum", F.lit(0)).alias("rare_sum"), (F.col("pair_sum") / F.col("domains")).alias("pair_mean"), (F.coalesce("rare_sum", F.lit(0)) / F.col("domains")).alias("rare_mean"),
        F.coalesce(deficit("pairs", "pairs_kept", 80), F.lit(1)).alias("pair_deficit"), F.coalesce(deficit("names", "names_kept", 95), F.lit(1)).alias("name_deficit"),
    )


def ceil_share(total: Column, percent: int) -> Column:
    """Whole-number ceiling of a percentage."""
    return F.floor((total * percent + 99) / 100).cast("long")


def training_deficits(full: DataFrame, cheap: DataFrame, key: str) -> DataFrame:
    """One row: pairs and names that the cheap view lacks up to 80 and 95 percent of the full view, at least 1."""
    full, cheap = full.select(key, "name").distinct(), cheap.select(key, "name").distinct()
    kept = full.join(cheap, [key, "name"], "left_semi")
    names = full.select("name").distinct().join(cheap.select("name").distinct(), "name", "left_semi").agg(F.count(F.lit(1)).alias("names_kept"))
    totals = full.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("name").alias("names")).join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("pairs_kept")))).join(F.broadcast(names))
    return totals.select(
        F.greatest(F.lit(1), ceil_share(F.col("pairs"), 80) - F.col("pairs_kept")).alias("pair_deficit"), F.greatest(F.lit(1), ceil_share(F.col("names"), 95) - F.col("names_kept")).alias("name_deficit")
    )


def _named(cases: DataFrame, names: DataFrame) -> DataFrame:
    """fold, tokens and the columns of names for each name of a case's full view (names: one row per name and group, bounded by the catalog)."""
    return cases.select("fold", "tokens", F.explode("full").alias("name")).join(_few(names), "name")


def _few(df: DataFrame) -> DataFrame:
    """A written table of names or tokens, marked for broadcast if it is small."""
    return F.broadcast(df) if df.limit(MOST_NAMES + 1).count() <= MOST_NAMES else df


def train_tokens(cases: DataFrame, heads: DataFrame, held: DataFrame) -> DataFrame:
    """held_out, token, n, pair_sum, rare_sum: the sums of each token without the fold.

    rare_sum counts the names of support 1 of the training domains. Tokens are
    summed in the tasks that hold their cases; a case never moves.
    """
    per_fold = cases.select("fold", F.size(F.array_except("full", "t2")).cast("long").alias("target"), F.explode("tokens").alias("token")).groupBy("fold", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("pair_sum"))
    sums = _without(materialize(per_fold, "token-sums")[0], ["token"], held, ["n", "pair_sum"]).where("n > 0")
    rare = _named(cases, heads.where("support = 1").select("name", "held_out")).where("fold <> held_out")
    rare_sums = rare.select("held_out", F.explode("tokens").alias("token")).groupBy("held_out", "token").agg(F.count(F.lit(1)).alias("rare_sum"))
    return sums.join(rare_sums, ["held_out", "token"], "left").select("held_out", "token", "n", "pair_sum", F.coalesce("rare_sum", F.lit(0)).alias("rare_sum"))


def train_recurring(cases: DataFrame, heads: DataFrame, held: DataFrame) -> DataFrame:
    """held_out, token, name, total: training domains that hold both the token and the recurring name (none: no row)."""
    recurring = heads.where(F.col("support") >= RECURRING).select("held_out", "name")
    folds = sorted(r[0] for r in cases.select("fold").distinct().collect())
    per_fold = _named(cases, recurring.select("name").distinct()).select("fold", "name", F.explode("tokens").alias("token")).groupBy("token", "name").agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("fold") == f).alias(f"_{f}") for f in folds])
    own = reduce(lambda done, f: F.when(F.col("held_out") == f, F.col(f"_{f}")).otherwise(done), folds, F.lit(0).cast("long"))
    return per_fold.join(_few(recurring), "name").select("held_out", "token", "name", (F.col("_all") - own).alias("total")).where("total > 0")


class Model:
    """The sums of all held-out folds: objectives, heads, tokens; recurring names by token when they are asked for."""

    def __init__(self, objectives: DataFrame, heads: DataFrame, tokens: DataFrame, cases: DataFrame, held: DataFrame, baseline: DataFrame) -> None:
        self.objectives, self.heads, self.tokens, self.cases, self.held, self.baseline = objectives, heads, tokens, cases, held, baseline
        self._recurring: DataFrame | None = None
        self._parts: DataFrame | None = None
        self._wanted: DataFrame | None = None
        self._packed: DataFrame | None = None

    @property
    def recurring(self) -> DataFrame:
        if self._recurring is None:
            self._recurring = materialize(train_recurring(self.cases, self.heads, self.held), "model")[0]
        return self._recurring

    @property
    def parts(self) -> DataFrame:
        """fold, token, name, part: total / (n + 4) of the wanted recurring names."""
        if self._parts is None:
            heads = self.recurring.withColumnRenamed("held_out", "fold").join(_few(wanted_heads(self).select("fold", "name")), ["fold", "name"])
            known = heads.join(_few(self.tokens.select(F.col("held_out").alias("fold"), "token", "n")), ["fold", "token"])
            self._parts = materialize(known.select("fold", "token", "name", (F.col("total") / (F.col("n") + PRIOR)).alias("part")), "parts")[0]
        return self._parts

    @property
    def wanted(self) -> DataFrame:
        """The names of :func:`wanted_heads` with their number within the fold (_id)."""
        if self._wanted is None:
            numbered = F.row_number().over(Window.partitionBy("fold").orderBy("name")) - 1
            self._wanted = materialize(wanted_heads(self).withColumn("_id", numbered), "wanted")[0]
        return self._wanted

    @property
    def packed(self) -> DataFrame:
        """fold, token, ids, values: the parts of all names that a token meets, in one row by the names' numbers."""
        if self._packed is None:
            known = self.parts.join(_few(self.wanted.select("fold", "name", "_id")), ["fold", "name"])
            met = known.groupBy("fold", "token").agg(F.collect_list("_id").alias("ids"), F.collect_list("part").alias("values"))
            self._packed = materialize(met, "packed-parts")[0]
        return self._packed


def train(tokens: DataFrame, views: DataFrame, folds: DataFrame, held: DataFrame | None = None, key: str = "key") -> Model:
    """Models without each held-out fold (default: every fold).

    tokens: key, token; views: key, view, name; folds: key, fold. ``baseline``
    are the names that t2 finds anywhere: no selection is needed to see them.
    """
    model = train_cases(materialize(pack(tokens, views, folds, key), "cases")[0], held, key)
    model.baseline = views.where("view = 't2'").select("name").distinct()
    return model


def train_cases(cases: DataFrame, held: DataFrame | None = None, key: str = "key") -> Model:
    """The models of :func:`train` from cases (key, fold, tokens, t2, full), a written table."""
    held = (cases.select(F.col("fold").alias("held_out")).distinct() if held is None else held).coalesce(1)
    targets = cases.select(key, "fold", F.size(F.array_except("full", "t2")).cast("long").alias("target"))
    sides = case_sides(cases.select("fold", key, "t2", "full"), "fold")
    counts = sides.groupBy("name", "fold").agg(F.sum("cheap").alias("n_t2"), F.sum("full").alias("n_full"), F.sum(F.col("cheap") * F.col("full")).alias("n_kept"))
    counts = materialize(counts, "counts")[0]
    heads = materialize(name_heads(counts, held), "heads")[0]
    parts = [materialize(p, "model")[0] for p in (objectives(counts, targets, held), train_tokens(cases, heads, held))]
    return Model(parts[0], heads, parts[1], cases, held, counts.where("n_t2 > 0").select("name").distinct())


def predict(model: Model, tokens: DataFrame, folds: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Predictions of each domain of folds, see :func:`predict_cases`. tokens: key, token; folds: key, fold."""
    none = F.array().cast("array<string>")
    own = folds.join(tokens.groupBy(key).agg(F.collect_list("token").alias("tokens")), key, "left").select(key, "fold", F.coalesce("tokens", none).alias("tokens"))
    return predict_cases(model, materialize(own, "cases")[0], key)


def predict_cases(model: Model, own: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Predictions of each domain by the model without its fold, and the domains with their tokens.

    First: key, fold, tokens, matched, weight, pair_lift, rare_novelty. Estimates are
    (sum + 4 * mean) / (n + 4); a prediction is the mean of the global mean and
    the estimates of the matched tokens.
    Second: key, fold, tokens. The probability of a recurring name is
    (mean * (1 + 4 * weight) + part) / (1 + matched), where mean is support /
    domains and part the sum of total / (n + 4) over the matched tokens, see
    :func:`name_parts`. It is a mean of shares, so it lies between 0 and 1, and
    sums of it over names need no row per name.
    """
    means = model.objectives.select("held_out", "pair_mean", "rare_mean")
    estimate = lambda c: (F.col(f"{c}_sum") + PRIOR * F.col(f"{c}_mean")) / (F.col("n") + PRIOR)
    known = model.tokens.join(F.broadcast(means), "held_out").select(F.col("held_out").alias("fold"), "token", (1 / (F.col("n") + PRIOR)).alias("w"), estimate("pair").alias("pair"), estimate("rare").alias("rare"))
    sums = _over_tokens(own, known, key, {"matched": F.count(F.lit(1)), "weight": F.sum("w"), "pair": F.sum("pair"), "rare": F.sum("rare")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = own.select(key, "fold", "tokens").join(F.broadcast(means.withColumnRenamed("held_out", "fold")), "fold").join(sums, key, "left")
    lift = lambda c: ((F.col(f"{c}_mean") + zero(c)) / (1 + zero("matched")))
    first = base.select(key, "fold", "tokens", zero("matched").alias("matched"), F.coalesce("weight", F.lit(0.0)).alias("weight"), lift("pair").alias("pair_lift"), lift("rare").alias("rare_novelty"))
    return materialize(first, "predictions")[0], own.select(key, "fold", "tokens")


def _over_tokens(own: DataFrame, known: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Sums of each case over the rows (fold, token, ...) that its tokens meet; they are folded in the task that holds the case."""
    met = own.select(key, "fold", F.explode("tokens").alias("token")).join(_few(materialize(known, "known")[0]), ["fold", "token"])
    return met.groupBy(key).agg(*[c.alias(n) for n, c in sums.items()])


def name_parts(model: Model, own: DataFrame, key: str = "key") -> DataFrame:
    """key, fold, part, ids, values of a few cases: the parts of the wanted recurring names that a case meets, by their numbers, and their sum.

    The cases of a fold meet its names in one task, as numbers; rows of a case,
    token and name never exist.
    """
    ensure_workers_import(own.sparkSession)
    columns = [key, "fold", "part", "ids", "values"]

    def meet(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        by_token, out = dict(zip(known["token"], zip(known["ids"], known["values"], strict=True), strict=True)), []
        for case, fold, tokens in zip(rows[key], rows["fold"], rows["tokens"], strict=True):
            met = [by_token[t] for t in tokens if t in by_token]
            ids = np.concatenate([m[0] for m in met]) if met else np.zeros(0, dtype=np.int32)
            sums = np.bincount(ids, np.concatenate([m[1] for m in met]) if met else None)
            at = np.flatnonzero(np.bincount(ids)).astype(np.int32)
            out.append((case, fold, float(sums.sum()), at, sums[at].astype(float)))
        return pd.DataFrame(out, columns=columns)

    return own.select(key, "fold", "tokens").groupBy("fold").cogroup(model.packed.groupBy("fold")).applyInPandas(meet, f"`{key}` string, fold int, part double, ids array<int>, values array<double>")


def token_parts(model: Model) -> DataFrame:
    """fold, token, parts: the sum of total / (n + 4) over the wanted recurring names of the model without the fold.

    Names that are wanted without the same folds are counted together.
    """
    wanted = wanted_heads(model).groupBy("name").agg(F.array_sort(F.collect_set("fold")).alias("_held"))
    per = _named(model.cases, materialize(wanted, "wanted")[0]).select("fold", "_held", F.explode("tokens").alias("token")).groupBy("fold", "_held", "token").agg(F.count(F.lit(1)).alias("total"))
    per = per.withColumn("held_out", F.explode("_held")).where("fold <> held_out").groupBy("held_out", "token").agg(F.sum("total").alias("total"))
    return per.join(model.tokens.select("held_out", "token", "n"), ["held_out", "token"]).select(F.col("held_out").alias("fold"), "token", (F.col("total") / (F.col("n") + PRIOR)).alias("parts"))


def wanted_heads(model: Model) -> DataFrame:
    """fold, name, mean of the recurring names that t2 finds nowhere."""
    heads = model.heads.where(F.col("support") >= RECURRING).join(model.baseline, "name", "left_anti")
    return heads.join(F.broadcast(model.objectives.select("held_out", "domains")), "held_out").select(F.col("held_out").alias("fold"), "name", (F.col("support") / F.col("domains")).alias("mean"))


def scores(model: Model, predictions: tuple[DataFrame, DataFrame], key: str = "key") -> DataFrame:
    """key, fold, matched, weight, pair_lift, rare_novelty, expected, score.

    expected: the summed probabilities of the wanted recurring names; score:
    pair lift and novelty as shares of what the training set lacks.
    """
    first, own = predictions
    means = wanted_heads(model).groupBy("fold").agg(F.sum("mean").alias("means"))
    parts = _over_tokens(own, token_parts(model), key, {"parts": F.sum("parts")})
    joined = first.join(F.broadcast(means), "fold", "left").join(parts, key, "left").join(F.broadcast(model.objectives.select(F.col("held_out").alias("fold"), "pair_deficit", "name_deficit")), "fold")
    expected = (F.coalesce("means", F.lit(0.0)) * (1 + PRIOR * F.col("weight")) + F.coalesce("parts", F.lit(0.0))) / (1 + F.col("matched"))
    score = utility(F.col("pair_lift"), F.col("rare_novelty") + F.col("expected"), F.col("pair_deficit"), F.col("name_deficit"))
    return joined.withColumn("expected", expected).select(key, "fold", "matched", "weight", "pair_lift", "rare_novelty", "expected", score.alias("score"))


def utility(pair_gain: Column, novelty: Column, pair_deficit: Column, name_deficit: Column) -> Column:
    """Worth of a domain: its gains as shares of what is missing."""
    return pair_gain / pair_deficit + novelty / name_deficit


# --- selections --------------------------------------------------------------------


def _certified(run: Callable[[int], DataFrame], n_rows: int, pool: int) -> DataFrame:
    """The choice from the smallest pool, doubled until it is proven to be the choice from all."""
    while True:
        chosen = run(pool)
        rows = chosen.collect()  # at most one row per seat
        if pool >= n_rows or all(r["_proven"] for r in rows):
            return chosen.sparkSession.createDataFrame(rows, chosen.schema).drop("_proven")
        pool *= 2


def greedy_selection(model: Model, predictions: tuple[DataFrame, DataFrame], quotas: DataFrame, salt: str, key: str = "key", pool: int = FIRST_POOL) -> DataFrame:
    """fold, key, place, score: per fold the greedy choice of ``trigger`` domains with diminishing credit for expected names.

    A chosen domain covers a name with its probability p: the name's coverage c
    becomes 1 - (1 - c) * (1 - p), and later domains get p * (1 - c) for it.
    Ties go to the smallest salted hash. quotas: fold, trigger.

    Every round weighs all domains by what is still open of each name, takes the
    pool of the best and chooses from it as long as the choice beats the best
    domain outside; then the next round weighs again. The first choice of a
    round is always proven, so the pool never grows.

    Defined cases: a fold with fewer domains than seats gives all of them; an
    empty table gives no rows; a domain without tokens has the global means.
    """
    first, _ = predictions
    spark = first.sparkSession
    ensure_workers_import(spark)
    heads = model.wanted
    sizes = first.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    limits = materialize(model.objectives.select(F.col("held_out").alias("fold"), "pair_deficit", "name_deficit").join(quotas.select("fold", "trigger"), "fold").join(sizes, "fold").coalesce(1), "limits")[0]
    left = {r["fold"]: max(0, min(int(r["trigger"]), r["_n"])) for r in limits.collect()}  # a handful of folds
    columns = ["fold", key, "place", "score", "open"]
    schema = f"fold int, `{key}` string, place int, score double, open array<double>"
    taken: list[tuple] = []
    shares: dict[int, list[float]] = {}

    def choose(rows: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in columns})
        bound = rows.loc[rows["_place"] == pool + 1, "_rounded"]
        bound = float(bound.iloc[0]) if len(bound) else -np.inf
        rows = rows[rows["_place"] <= pool].reset_index(drop=True)
        means = means.sort_values("_id")
        chance = np.outer(1 + PRIOR * rows["weight"].to_numpy(), means["mean"].to_numpy(float))
        for i, (ids, values) in enumerate(zip(rows["ids"], rows["values"], strict=True)):
            chance[i, ids] += values
        chance /= (1 + rows["matched"].to_numpy())[:, None]
        np.clip(chance, 0, 1, out=chance)
        pair = rows["pair_lift"].to_numpy() / rows["pair_deficit"].to_numpy()
        rare, lack = rows["rare_novelty"].to_numpy(), rows["name_deficit"].to_numpy()
        open_share, free, out = means["open"].to_numpy(float), np.ones(len(rows), dtype=bool), []
        for place in range(1, min(int(rows["_seats"].iloc[0]), len(rows)) + 1):
            worth = np.round(pair + (rare + chance @ open_share) / lack, DECIMALS)
            best = max(worth[free])
            if out and not best > bound:
                break
            at = min(np.flatnonzero(free & (worth == best)), key=lambda i: rows["_tie"].iloc[i])
            out.append([int(rows["fold"].iloc[0]), rows[key].iloc[at], place, float(best), None])
            free[at] = False
            open_share = open_share * (1 - chance[at])
        out[-1][4] = list(open_share)
        return pd.DataFrame(out, columns=columns)

    while any(left.values()):
        seats = spark.createDataFrame([(f, n) for f, n in left.items() if n], "fold int, _seats int").coalesce(1)
        names = heads.withColumn("open", F.lit(1.0))
        if shares:  # as many as there are wanted names
            known = spark.createDataFrame(list(shares.items()), "fold int, _open array<double>").select("fold", F.posexplode("_open").alias("_id", "open"))
            names = heads.join(F.broadcast(known), ["fold", "_id"], "left").withColumn("open", F.coalesce("open", F.lit(1.0)))
        names = names.join(F.broadcast(seats.select("fold")), "fold", "left_semi")
        domains = first.join(F.broadcast(seats.select("fold")), "fold", "left_semi")
        if taken:
            domains = domains.join(F.broadcast(spark.createDataFrame([(t[1],) for t in taken], f"`{key}` string")), key, "left_anti")
        scored = _open_scores(model, domains, names, key).withColumn("_rounded", F.round("score", DECIMALS)).withColumn("_tie", salted_hash(salt, F.col(key)))
        w = Window.partitionBy("fold").orderBy(F.col("_rounded").desc(), "_tie")
        top = materialize(scored.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= pool + 1).drop("score"), "top")[0]
        sparse = name_parts(model, domains.join(F.broadcast(top.select(key)), key, "left_semi"), key).select(key, "ids", "values")
        rows = top.join(sparse, key).join(F.broadcast(limits.drop("_n", "trigger")), "fold").join(F.broadcast(seats), "fold")
        for r in sorted(rows.groupBy("fold").cogroup(names.groupBy("fold")).applyInPandas(choose, schema).collect(), key=lambda r: (r["fold"], r["place"])):  # at most one row per seat
            taken.append((r["fold"], r[key], sum(t[0] == r["fold"] for t in taken) + 1, r["score"]))
            left[r["fold"]] -= 1
            if r["open"] is not None:
                shares[r["fold"]] = r["open"]
    return spark.createDataFrame(taken, f"fold int, `{key}` string, place int, score double")


def _open_scores(model: Model, domains: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """domains (key, fold, tokens and what is predicted) without tokens, and their score if only the open share of each name counts.

    names: fold, name, mean, open. A domain moves once, with what it met.
    """
    of_fold = names.groupBy("fold").agg(F.sum(F.col("mean") * F.col("open")).alias("_means"))
    known = model.parts.join(_few(names.select("fold", "name", "open")), ["fold", "name"]).groupBy("fold", "token").agg(F.sum(F.col("part") * F.col("open")).alias("_parts"))
    own = [key, "fold", "matched", "weight", "pair_lift", "rare_novelty"]
    met = domains.select(*own, F.explode_outer("tokens").alias("token")).join(_few(materialize(known, "known")[0]), ["fold", "token"], "left")
    sums = met.groupBy(*own).agg(F.coalesce(F.sum("_parts"), F.lit(0.0)).alias("_parts"))
    lacks = model.objectives.select(F.col("held_out").alias("fold"), "pair_deficit", "name_deficit")
    joined = sums.join(F.broadcast(of_fold), "fold", "left").join(F.broadcast(lacks), "fold")
    expected = (F.coalesce("_means", F.lit(0.0)) * (1 + PRIOR * F.col("weight")) + F.col("_parts")) / (1 + F.col("matched"))
    return joined.select(*own, utility(F.col("pair_lift"), F.col("rare_novelty") + expected, F.col("pair_deficit"), F.col("name_deficit")).alias("score"))


def label_aware_selection(views: DataFrame, seats: int, salt: str, key: str = "key", pool: int = FIRST_POOL) -> DataFrame:
    """place, key, pair_lift, name_lift: the greedy choice by one who knows the full views.

    Each step takes the most names that only the full view has; among these the
    most names that the simulated result lacks as a whole, less those that it
    would lose; then the smallest salted hash.
    """
    spark = views.sparkSession
    ensure_workers_import(spark)
    sides = view_sides(views, key)
    world = sides.groupBy("name").agg(F.max("full").alias("real"), F.sum("cheap").cast("long").alias("n")).where("real = 1").select("name", "n")
    world = _few(materialize(world, "world")[0])
    # A name can only be missing at some step if no more domains show it than are selected.
    per = sides.join(world, "name", "left").groupBy(key).agg(F.count_if(F.expr("full = 1 AND cheap = 0")).alias("pair_lift"), F.count_if((F.col("full") == 1) & (F.col("cheap") == 0) & (F.col("n") <= seats)).alias("most_names"))
    ranked = per.withColumn("_tie", salted_hash(salt, F.col(key)))
    n_rows = per.count()
    columns = ["place", key, "pair_lift", "name_lift", "_proven"]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        edge = rows[rows["_place"] == rows["_pool"] + 1]
        bound = (int(edge["pair_lift"].iloc[0]), int(edge["most_names"].iloc[0])) if len(edge) else (-1, -1)
        rows = rows[rows["_place"] <= rows["_pool"]]
        shown: dict[str, int] = {}
        cheap: dict[str, set] = {}
        full: dict[str, set] = {}
        static: dict[str, tuple[int, str]] = {}
        for k, name, a, b, n, lift, tie in zip(rows[key], rows["name"], rows["cheap"], rows["full"], rows["n"], rows["pair_lift"], rows["_tie"], strict=True):
            static[k] = (int(lift), tie)
            cheap.setdefault(k, set()), full.setdefault(k, set())
            if pd.notna(n):
                shown[name] = int(n)
                (cheap[k].add(name) if a else None, full[k].add(name) if b else None)
        out = []
        for place in range(1, min(seats, len(static)) + 1):
            gain = lambda k: sum(1 for n in full[k] - cheap[k] if not shown[n]) - sum(1 for n in cheap[k] - full[k] if shown[n] == 1)
            top = max(lift for lift, _ in static.values())
            gains = {k: gain(k) for k, (lift, _) in static.items() if lift == top}
            best = min(gains, key=lambda k: (-gains[k], static[k][1]))
            out.append((place, best, top, gains[best], (top, gains[best]) > bound))
            del static[best]
            for n in cheap[best]:
                shown[n] -= 1
            for n in full[best]:
                shown[n] += 1
        return pd.DataFrame(out, columns=columns)

    def run(pool: int) -> DataFrame:
        w = Window.orderBy(F.col("pair_lift").desc(), F.col("most_names").desc(), "_tie")
        top = ranked.orderBy(F.col("pair_lift").desc(), F.col("most_names").desc(), "_tie").limit(pool + 1).withColumn("_place", F.row_number().over(w)).withColumn("_pool", F.lit(pool))
        rows = F.broadcast(top).join(sides, key).join(world, "name", "left").select(key, "name", "cheap", "full", "n", "pair_lift", "most_names", "_tie", "_place", "_pool")
        return rows.groupBy("_pool").applyInPandas(choose, f"place int, `{key}` string, pair_lift long, name_lift long, _proven boolean")

    return _certified(run, n_rows, pool)


# --- judgement ---------------------------------------------------------------------


def selection_metrics(views: DataFrame, selected: DataFrame, costs: DataFrame, measures: list[str], key: str = "key") -> DataFrame:
    """One row per arm: what is kept and what it costs if its selected domains take the full view and the others t2.

    views: key, view, name; selected: arm, key; costs: key and measures. All
    arms (a handful) are judged in one pass over the views.
    """
    sides = view_sides(views, key)
    chosen = selected.select("arm", key).distinct()
    arms = F.broadcast(chosen.select("arm").distinct())
    inside = F.broadcast(chosen.withColumn("_in", F.lit(1)))
    rows = sides.crossJoin(arms).join(inside, ["arm", key], "left").withColumn("seen", F.when(F.col("_in") == 1, F.col("full")).otherwise(F.col("cheap")))
    kept = F.col("full") * F.col("seen")
    by_name = rows.groupBy("arm", "name").agg(F.sum("full").alias("n"), F.sum(kept).alias("k"), F.max("seen").alias("any"), F.sum((1 - F.col("full")) * F.col("seen")).alias("extra"))
    names = by_name.groupBy("arm").agg(
        F.sum("n").alias("pairs"), F.sum("k").alias("pairs_kept"), F.count_if(F.col("n") > 0).alias("names"), F.count_if((F.col("n") > 0) & (F.col("any") > 0)).alias("names_kept"),
        F.avg(F.when(F.col("n") > 0, F.col("k") / F.col("n"))).alias("macro_technology"), F.count_if((F.col("n") == 0) & (F.col("any") > 0)).alias("extra_names"), F.sum("extra").alias("extra_pairs"),
    )
    by_domain = rows.groupBy("arm", key).agg(F.sum("full").alias("n"), F.sum(kept).alias("k")).where("n > 0").groupBy("arm").agg(F.avg(F.col("k") / F.col("n")).alias("macro_domain"), F.count(F.lit(1)).alias("domains_labelled"))
    spent = costs.crossJoin(arms).join(inside, ["arm", key], "left")
    own = F.col("_in").isNotNull()
    sums = spent.groupBy("arm").agg(F.count(F.lit(1)).alias("domains_full"), F.count_if(own).alias("domains_selected"), *[F.coalesce(F.sum(m), F.lit(0)).alias(f"{m}_full") for m in measures], *[F.coalesce(F.sum(F.when(own, F.col(m))), F.lit(0)).alias(f"{m}_selected") for m in measures])
    return names.join(by_domain, "arm", "left").join(sums, "arm", "left")


def verdict(metrics: DataFrame, measures: list[str], seats: int = MOST_SELECTED) -> DataFrame:
    """Add ``accepted``: enough names and pairs kept, few domains, every cost at most three tenths (exact whole numbers)."""
    fine = (F.col("names") > 0) & (F.col("names_kept") >= NAME_SHARE * F.col("names")) & (F.col("pairs_kept") >= PAIR_SHARE * F.col("pairs")) & (F.col("domains_selected") <= seats)
    for m in measures:
        fine = fine & (F.col(f"{m}_selected") * 10 <= F.col(f"{m}_full") * COST_TENTHS)
    return metrics.withColumn("accepted", F.coalesce(fine, F.lit(False)))


def fold_outcomes(views: DataFrame, selected: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """arm, fold, n_selected, pair_lift, novel_names of the selected domains (arm, fold, key); novel: t2 finds the name nowhere."""
    sides = view_sides(views, key)
    own = sides.where("full = 1").join(F.broadcast(selected.select(key).distinct()), key, "left_semi")
    novel = own.select(key, "name").join(sides.where("cheap = 1").select("name").distinct(), "name", "left_anti")
    lifts = selected.join(targets.select(key, "target"), key).groupBy("arm", "fold").agg(F.count(F.lit(1)).alias("n_selected"), F.sum("target").alias("pair_lift"))
    names = selected.join(novel, key).groupBy("arm", "fold").agg(F.countDistinct("name").alias("novel_names"))
    return lifts.join(names, ["arm", "fold"], "left").select("arm", "fold", "n_selected", "pair_lift", F.coalesce("novel_names", F.lit(0)).alias("novel_names"))


def fold_wins(outcomes: DataFrame, left: str, right: str) -> DataFrame:
    """fold, both arms' outcomes and whether the right one won: neither measure worse, at least one better."""
    side = lambda arm, p: outcomes.where(F.col("arm") == arm).select("fold", F.col("pair_lift").alias(f"{p}_pair_lift"), F.col("novel_names").alias(f"{p}_novel_names"))
    both = side(left, "left").join(side(right, "right"), "fold")
    better = lambda f: [f(F.col(f"right_{m}"), F.col(f"left_{m}")) for m in ("pair_lift", "novel_names")]
    no_worse = reduce(lambda a, b: a & b, better(lambda x, y: x >= y))
    some_better = reduce(lambda a, b: a | b, better(lambda x, y: x > y))
    return both.withColumn("right_won", no_worse & some_better)


def decide(left_accepted: Column, right_accepted: Column, wins: Column, least: int = FOLD_WINS) -> Column:
    """The arm to take: the left one if it is accepted, else the right one if it is accepted and won enough folds, else none."""
    return F.when(left_accepted, "left").when(right_accepted & (wins >= least), "right").otherwise("none")


def limit_hits(hits: DataFrame) -> DataFrame:
    """Limit hits by category and ordinal: hits, domains, pages."""
    return hits.groupBy("category", "ordinal").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("domain").alias("domains"), F.countDistinct("domain", "page_id").alias("pages"))


def snapshots(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Evaluation snapshots in order of their domains; raises on a repeated domain or more than ``most``."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).first()
    if sums.n != sums.d:
        raise ValueError("a domain has two snapshots")
    if sums.n > most:
        raise ValueError(f"{sums.n} snapshots; at most {most} are allowed")
    return rows.orderBy(key)


# --- drivers -----------------------------------------------------------------------


def select_triggered(tokens: DataFrame, views: DataFrame, folds: DataFrame, salts: dict[str, str], held: DataFrame | None = None, key: str = "key", seats: int = MOST_SELECTED) -> DataFrame:
    """source, fold, key, score: :func:`select_cases` of long tables (key, token; key, view, name; key, fold)."""
    return select_cases(materialize(pack(tokens, views, folds, key), "cases")[0], salts, held, key, seats)


def select_cases(cases: DataFrame, salts: dict[str, str], held: DataFrame | None = None, key: str = "key", seats: int = MOST_SELECTED) -> DataFrame:
    """source, fold, key, score: the triggered domains and controls of each fold, by models that have not seen it.

    cases: key, fold, tokens, t2, full, a written table. held: the folds to
    select from (default: all). Models learn from all folds but the held-out one.
    """
    model = train_cases(cases, held, key)
    judged = cases if held is None else cases.join(F.broadcast(held.withColumnRenamed("held_out", "fold")), "fold", "left_semi")
    if held is not None:
        model.baseline = materialize(judged.select(F.explode("t2").alias("name")).distinct(), "baseline")[0]
    predictions = predict_cases(model, judged, key)
    folds = judged.select(key, "fold")
    quotas = fold_quotas(folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), seats)
    triggered = greedy_selection(model, predictions, quotas, salts["tie"], key).select(F.lit("trigger").alias("source"), "fold", key, "score")
    controls = control_sample(folds, triggered, key, "fold", salts["control"], quotas.select("fold", F.col("control").alias("quota")))
    return triggered.unionByName(controls.select(F.lit("control").alias("source"), "fold", key, F.lit(None).cast("double").alias("score")))


def development_report(cases: DataFrame, costs: DataFrame, measures: list[str], salts: dict[str, str], key: str = "key") -> DataFrame:
    """One row per arm (model, random, label_aware): metrics and verdict."""
    sides = case_sides(cases, key)
    arms = [
        select_cases(cases, salts, None, key).select(F.lit("model").alias("arm"), key),
        hash_sample(cases.select(key), salts["random"], key, MOST_SELECTED).select(F.lit("random").alias("arm"), key),
        label_aware_selection(sides, MOST_SELECTED, salts["label"], key).select(F.lit("label_aware").alias("arm"), key),
    ]
    chosen = materialize(reduce(DataFrame.unionByName, arms), "chosen")[0]
    return verdict(selection_metrics(sides, chosen, costs, measures, key), measures)


def paired_report(arms: dict[str, DataFrame], costs: DataFrame, measures: list[str], salts: dict[str, str], key: str = "key") -> DataFrame:
    """One row: verdicts of two arms that differ in their tokens, folds the second won, and the decision.

    arms: two names with their cases; the first is the baseline.
    """
    (left, cases), (right, _) = arms.items()
    sides = case_sides(cases, key)
    both = chosen_of_arms(arms, salts, key)
    judged = verdict(selection_metrics(sides, both, costs, measures, key), measures)
    targets = cases.select(key, F.size(F.array_except("full", "t2")).cast("long").alias("target"))
    wins = fold_wins(fold_outcomes(sides, both.where("source = 'trigger'"), targets, key), left, right).agg(F.count_if("right_won").alias("wins"), F.count(F.lit(1)).alias("n_folds"))
    flags = judged.agg(*[F.max(F.when(F.col("arm") == a, F.col("accepted"))).alias(f"{p}_accepted") for a, p in ((left, "left"), (right, "right"))])
    return flags.join(F.broadcast(wins)).withColumn("decision", decide(F.col("left_accepted"), F.col("right_accepted"), F.col("wins")))


def chosen_of_arms(arms: dict[str, DataFrame], salts: dict[str, str], key: str = "key") -> DataFrame:
    """source, fold, key, score, arm of each arm's cases, written once (at most one row per seat and arm)."""
    return materialize(reduce(DataFrame.unionByName, [select_cases(c, salts, None, key).withColumn("arm", F.lit(a)) for a, c in arms.items()]), "chosen")[0]


def frozen_report(cases: DataFrame, costs: DataFrame, measures: list[str], salts: dict[str, str], key: str = "key") -> DataFrame:
    """One row: metrics and verdict of the selection from a held-out cohort by the model of the other one.

    cases: their fold is 0 for the training and 1 for the held-out domains.
    """
    held = cases.sparkSession.createDataFrame([(1,)], "held_out int")
    chosen = materialize(select_cases(cases, salts, held, key).withColumn("arm", F.lit("frozen")), "chosen")[0]
    outside = cases.where("fold = 1")
    return verdict(selection_metrics(case_sides(outside, key), chosen, costs.join(outside.select(key), key, "left_semi"), measures, key), measures)
