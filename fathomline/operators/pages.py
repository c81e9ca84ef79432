"""Choice of the internal pages of a site from its links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import policy


def _rank(segments: Column, words: tuple[str, ...]) -> Column:
    """The best (lowest) place of a word that stands among the segments."""
    places = [F.when(F.array_contains(segments, w), F.lit(i)) for i, w in enumerate(words)]
    return F.coalesce(*places)


def rank_links(links: DataFrame, entry: str, url: str) -> DataFrame:
    """Eligible links with role, token_rank and path_length.

    Eligible: same scheme, host and port as the entry, no user information,
    query or fragment, not the entry or ``/``, decodable segments, none of them
    excluded, no file suffix at the end. Null links are not eligible.
    """
    part = lambda c, what: F.expr(f"try_parse_url(`{c}`, '{what}')")
    path = part(url, "PATH")
    decoded = F.filter(F.split(F.lower(F.coalesce(F.try_url_decode(path), F.lit("%"))), "/"), lambda s: s != "")
    rows = links.withColumn("_path", path).withColumn("_segments", decoded)
    origin_same = reduce(lambda a, b: a & b, [part(url, w).eqNullSafe(part(entry, w)) for w in ("PROTOCOL", "AUTHORITY")])
    clean = part(url, "QUERY").isNull() & part(url, "REF").isNull() & part(url, "USERINFO").isNull() & ~F.col(url).rlike(r"[?#]")
    fine = (
        part(url, "PROTOCOL").isin("http", "https") & origin_same & clean & (F.length(url) <= policy.MAX_URL) & (F.col(url) != F.col(entry)) & (F.col("_path") != "/") & (F.size("_segments") > 0)
        & ~F.arrays_overlap("_segments", F.array(*[F.lit(w) for w in policy.EXCLUDED_SEGMENTS])) & ~F.try_element_at("_segments", F.lit(-1)).rlike(r"\.[a-z0-9]+\z") & ~F.array_contains("_segments", "%")
    )
    inner = F.slice("_segments", 1, F.greatest(F.size("_segments") - 1, F.lit(0)))
    detail, listing = _rank(inner, policy.DETAIL_SEGMENTS), _rank(F.col("_segments"), policy.LISTING_SEGMENTS)
    role = F.when(detail.isNotNull(), "detail").when(listing.isNotNull(), "listing").otherwise("content")
    return rows.where(fine).withColumn("role", role).withColumn("token_rank", F.coalesce(detail, listing, F.lit(0))).withColumn("path_length", F.length("_path")).drop("_path", "_segments")


def select_pages(links: DataFrame, record: list[str], entry: str = "entry_url", url: str = "url", most: int = 2) -> DataFrame:
    """The pages to visit: the best detail page and the best listing (else content) page, by address, at most ``most``.

    Best: token rank, then shorter path, then address. One exchange on the record
    serves deduplication, choice and order.
    """
    ranked = rank_links(links, entry, url).dropDuplicates([*record, url])
    by = [F.col("token_rank"), F.col("path_length"), F.col(url)]
    best = ranked.withColumn("_at", F.row_number().over(Window.partitionBy(*record, "role").orderBy(*by))).where("_at = 1")
    has_listing = F.max((F.col("role") == "listing").cast("int")).over(Window.partitionBy(*record))
    slots = best.withColumn("_listing", has_listing).where("role <> 'content' OR _listing = 0")
    return slots.withColumn("_place", F.row_number().over(Window.partitionBy(*record).orderBy(url))).where(F.col("_place") <= most).select(*record, "role", url, "token_rank", "path_length")


def plan_pages(static_links: DataFrame, rendered_links: DataFrame, record: list[str], entry: str = "entry_url", url: str = "url", most: int = 2) -> DataFrame:
    """The reserved page of the static links, and of all links at most one page from the other slot."""
    reserved = select_pages(static_links, record, entry, url).withColumn("_at", F.row_number().over(Window.partitionBy(*record).orderBy(url))).where("_at = 1").drop("_at")
    full = select_pages(static_links.unionByName(rendered_links), record, entry, url)
    slot = lambda role: F.when(role == "detail", 0).otherwise(1)
    own = reserved.select(*[F.col(c).alias(f"_r_{c}") for c in record], slot(F.col("role")).alias("_slot"), F.col(url).alias("_url"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in record])
    other = full.join(own, on, "left").where((F.col("_slot").isNull()) | ((slot(F.col("role")) != F.col("_slot")) & (F.col(url) != F.col("_url")))).drop("_slot", "_url", *[f"_r_{c}" for c in record])
    both = reserved.withColumn("reserved", F.lit(True)).unionByName(other.withColumn("reserved", F.lit(False)))
    order = Window.partitionBy(*record).orderBy(F.col("reserved").desc(), url)
    return both.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


def page_ids(pages: DataFrame, record: list[str], url: str = "url") -> DataFrame:
    """Add page ids: p1 is the entry page, internal pages follow by address."""
    return pages.withColumn("page_id", F.concat(F.lit("p"), (F.row_number().over(Window.partitionBy(*record).orderBy(url)) + 1).cast("string")))


def first_success(attempts: DataFrame, record: list[str], position: str, soft: Column, result: str) -> DataFrame:
    """The result of the first attempt, in order, that is no soft failure."""
    return attempts.where(~soft).groupBy(*record).agg(F.min_by(result, position).alias(result))


def stop_after(df: DataFrame, record: list[str], order: str, stops: Column) -> DataFrame:
    """Rows in order up to and including the first that stops (probes after a denial are not made)."""
    w = Window.partitionBy(*record).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_stopped", F.max(stops.cast("int")).over(w)).where("coalesce(_stopped, 0) = 0").drop("_stopped")
