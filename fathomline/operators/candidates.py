"""Candidates: all observations of a domain as one relation, deduplicated, ordered, capped, prioritised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import policy

IDENTITY = ["collector", "kind", "source", "page_id", "key", "value"]


#: What a page observation holds, by column: evidence source, whether its entries have a key, and how they are read.
PAGE_BRANCHES = {
    "headers": ("header", True), "cookies": ("cookie", True), "html": ("html", False), "text": ("text", False), "css": ("css", False), "metadata": ("meta", True), "script_urls": ("script_url", False),
    "scripts": ("script_content", False), "dom": ("dom", True), "javascript": ("javascript", True), "network_urls": ("network_url", False), "network_hosts": ("network_hostname", False),
}
OBSERVATION = "struct<kind:string,source:string,page_id:string,key:string,value:string>"


def _observed(source: str, value: Column, key: Column | None = None, page_id: Column | None = None, kind: Column | None = None) -> Column:
    """One observation; header and meta keys come in lower case; a null value is the presence of the key."""
    key = F.lit(None).cast("string") if key is None else key
    kind = F.when(value.isNull(), F.lit("presence")).otherwise(F.lit("value")) if kind is None else kind
    return F.struct(
        kind.alias("kind"), F.lit(source).alias("source"), (F.lit(None).cast("string") if page_id is None else page_id).alias("page_id"),
        (F.lower(F.trim(key)) if source in ("header", "meta") else F.upper(F.trim(key)) if source == "dns_record" else key).alias("key"), F.coalesce(value, F.lit("")).alias("value"),
    )


def _entry(source: str, keyed: bool, page: Column):
    """How an entry of a page's list becomes an observation."""
    return (lambda x: _observed(source, x["value"], x["key"], page)) if keyed else (lambda x: _observed(source, x, page_id=page))


def page_addresses(page: DataFrame) -> Column:
    """The final address of a page and both ends of each redirect, each once."""
    ends = F.flatten(F.transform(F.coalesce("redirects", F.array()), lambda r: F.array(r["from_url"], r["to_url"])))
    return F.array_distinct(F.filter(F.concat(F.array("final_url"), ends), lambda u: u.isNotNull()))


def page_candidates(pages: DataFrame, record: list[str]) -> DataFrame:
    """Candidates of page observations: addresses and everything of :data:`PAGE_BRANCHES`, by one generator.

    pages: record, collector, page_id, final_url, redirects (array of from_url,
    to_url) and any of the columns of :data:`PAGE_BRANCHES`: arrays of (key,
    value) where entries have keys, of texts where they have none; a null value
    is a presence. Missing columns hold nothing. Stylesheets, images, frames,
    links and statuses are no candidates.
    """
    page = F.col("page_id")
    branches = [F.transform(page_addresses(pages), lambda u: _observed("url", u, page_id=page))]
    for column, (source, keyed) in PAGE_BRANCHES.items():
        if column in pages.columns:
            whole = F.coalesce(F.col(column), F.array())
            branches.append(F.transform(whole, _entry(source, keyed, page)))
    every = F.concat(*[b.cast(f"array<{OBSERVATION}>") for b in branches])
    return pages.select(*record, "collector", F.explode(every).alias("o")).select(*record, "collector", "o.*")


def record_candidates(observed: DataFrame, record: list[str]) -> DataFrame:
    """Candidates without a page: observed has record, collector, source (robots, probe, dns_record, tls_issuer), key, value."""
    parts = [observed.where(F.col("source") == s).select(*record, "collector", _observed(s, F.col("value"), F.col("key") if s in ("dns_record", "probe") else None).alias("o")) for s in ("robots", "probe", "dns_record", "tls_issuer")]
    return union_candidates(parts).select(*record, "collector", "o.*")


def collect_candidates(pages: DataFrame, observed: DataFrame, record: list[str]) -> DataFrame:
    """All observations of a record as one relation (record and the identity columns), script addresses capped."""
    every = page_candidates(pages, record).unionByName(record_candidates(observed, record)).select(*record, *IDENTITY)
    return cap_script_urls(every, record)


def union_candidates(branches: list[DataFrame]) -> DataFrame:
    """One relation from all branches."""
    return reduce(DataFrame.unionByName, branches)


def order_columns() -> list[Column]:
    """Total order of candidates: collector, kind, source, page, key, value; nulls first."""
    return [
        policy.rank("collector", policy.COLLECTORS).asc_nulls_first(), policy.rank("kind", ("presence", "value")).asc_nulls_first(), policy.rank("source", policy.EVIDENCE_SOURCES).asc_nulls_first(),
        F.col("page_id").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("value").asc_nulls_first(),
    ]


def number_candidates(candidates: DataFrame, record: list[str]) -> DataFrame:
    """Distinct candidates of each record with ids c00000000, c00000001, ... in total order.

    One exchange on the record serves the deduplication's window as well.
    """
    distinct = candidates.select(*record, *IDENTITY).distinct()
    w = Window.partitionBy(*record).orderBy(*order_columns())
    return distinct.withColumn("candidate_id", F.concat(F.lit("c"), F.lpad((F.row_number().over(w) - 1).cast("string"), 8, "0")))


def cap_in_order(df: DataFrame, record: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each record in order (script URLs, links, metadata, script bodies)."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*record).orderBy(*order))).where(F.col("_at") <= most).drop("_at")


def cap_script_urls(candidates: DataFrame, record: list[str], most: int = policy.SCRIPT_URLS_PER_DOMAIN) -> DataFrame:
    """At most ``most`` static script URLs of a record, by page and address; other candidates stay."""
    static = F.coalesce((F.col("source") == "script_url") & (F.col("collector") == "http") & (F.col("kind") == "value"), F.lit(False))
    distinct = candidates.where(static).select(*record, *IDENTITY).distinct()
    capped = cap_in_order(distinct, record, [F.col("page_id").asc_nulls_first(), "value"], most)
    return candidates.where(~static).select(*record, *IDENTITY).unionByName(capped)


def mark_priority(candidates: DataFrame, prefix: DataFrame, record: list[str]) -> DataFrame:
    """Add ``priority``: a multiset match of a prefix view that ignores pages.

    Of k equal candidates in the prefix the first k in order have priority.
    """
    same = ["collector", "kind", "source", "key", "value"]
    counts = prefix.groupBy(*record, *same).agg(F.count(F.lit(1)).alias("_k"))
    renamed = counts.select(*[F.col(c).alias(f"_p_{c}") for c in (*record, *same)], "_k")
    nth = F.row_number().over(Window.partitionBy(*record, *same).orderBy(F.col("page_id").asc_nulls_first()))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in (*record, *same)])
    return candidates.withColumn("_nth", nth).join(renamed, on, "left").withColumn("priority", F.coalesce(F.col("_nth") <= F.col("_k"), F.lit(False))).drop("_nth", "_k", *[f"_p_{c}" for c in (*record, *same)])


def keep_until_violated(df: DataFrame, record: list[str], order: list[Column | str], violated: Column) -> DataFrame:
    """Keep rows in order up to the first violation; that row and all later ones leave.

    violated: a condition that may hold window sums over the same order.
    """
    w = Window.partitionBy(*record).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_bad", violated.cast("int")).withColumn("_latch", F.max("_bad").over(w)).where("_latch = 0").drop("_bad", "_latch")


def running(column: Column, record: list[str], order: list[Column | str]) -> Column:
    """Sum of a column up to and including the row."""
    return F.sum(column).over(Window.partitionBy(*record).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def within_budget(costs: DataFrame, record: list[str], budget: int = policy.WORK_BUDGET) -> DataFrame:
    """Candidates admitted whole, priority first, until pairs or regex runs pass the budget.

    costs: record, candidate_id, priority, pairs, regex_runs.
    """
    order = [F.col("priority").desc(), "candidate_id"]
    over = (running(F.col("pairs"), record, order) > budget) | (running(F.col("regex_runs"), record, order) > budget)
    return keep_until_violated(costs, record, order, over)


def admit_cookies(cookies: DataFrame, record: list[str], order: str, limits: dict[str, int] = policy.COOKIE_LIMITS) -> DataFrame:
    """Cookies (name, value) in order until a count or size limit is broken."""
    size = F.octet_length("name") + F.octet_length("value")
    bad = (
        (running(F.lit(1), record, [order]) > limits["count"]) | (F.octet_length("name") > limits["name"])
        | (F.octet_length("value") > limits["value"]) | (running(size, record, [order]) > limits["total"])
    )
    return keep_until_violated(cookies, record, [order], bad)


def admit_dns(answers: DataFrame, record: list[str]) -> DataFrame:
    """DNS answers (type, value): a type with more than 32 raw answers leaves whole, types after 128 answers leave, duplicates last."""
    per_type = answers.groupBy(*record, "type").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= policy.DNS_PER_TYPE)
    order = [policy.rank("type", policy.DNS_TYPES)]
    kept = keep_until_violated(per_type, record, order, running(F.col("_n"), record, order) > policy.DNS_PER_DOMAIN)
    return answers.join(kept.drop("_n"), [*record, "type"]).select(*record, "type", "value").distinct()
