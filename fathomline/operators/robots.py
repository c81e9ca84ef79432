"""robots.txt: rules of the group that applies, and decisions for addresses.

Ties between an allow and a disallow rule of equal length go to allow (RFC 9309).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.normalize import truncate_bytes
from fathomline.operators.results import follow_redirects


def robots_rules(texts: DataFrame, keys: list[str], text: str, product: str) -> DataFrame:
    """keys, allow, path, pattern: the rules for ``product``, from its own groups, else from the ``*`` groups.

    A group starts at a user-agent line that follows a rule; comments, unknown
    directives and empty rules leave; null texts give nothing. Of a text longer
    than ``MAX_TEXT_BYTES`` the whole lines within them count; a text with more
    than ``MAX_RULES`` rules gives none .
    """
    within = F.when(F.octet_length(F.col(text)) <= MAX_TEXT_BYTES, F.col(text)).otherwise(F.regexp_replace(truncate_bytes(F.col(text), MAX_TEXT_BYTES), r"[^\r\n]*\z", ""))
    lines = texts.select(*keys, F.posexplode(F.split(within, r"\r\n|\r|\n")).alias("line_no", "line"))
    plain = F.trim(F.regexp_replace("line", "#.*", ""))
    fields = lines.select(*keys, "line_no", F.lower(F.trim(F.substring_index(plain, ":", 1))).alias("field"), F.trim(F.regexp_extract(plain, r"^[^:]*:(.*)$", 1)).alias("value"), F.instr(plain, ":").alias("colon"))
    fields = fields.where("colon > 0 AND field IN ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy(*keys).orderBy("line_no")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = fields.withColumn("group_no", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("group_no > 0")
    own = F.max((F.col("field") == "user-agent") & (F.lower("value") == product.lower())).over(Window.partitionBy(*keys, "group_no"))
    general = F.max((F.col("field") == "user-agent") & (F.col("value") == "*")).over(Window.partitionBy(*keys, "group_no"))
    marked = grouped.withColumn("own", own).withColumn("general", general).withColumn("any_own", F.max("own").over(Window.partitionBy(*keys)))
    rules = marked.where("field <> 'user-agent' AND length(value) > 0 AND CASE WHEN any_own THEN own ELSE general END")
    distinct = rules.select(*keys, (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), path_pattern(normal_path(F.col("value"))).alias("pattern")).distinct()
    return distinct.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") <= MAX_RULES).drop("_n")


#: Limits of a robots text: bytes read, rules kept of one text.
MAX_TEXT_BYTES, MAX_RULES = 524_288, 10_000


def normal_path(path: Column) -> Column:
    """A path in the form in which rules and requests are compared.

    Percent escapes of unreserved characters are decoded, other escapes come in
    upper case, characters beyond ASCII are escaped by their UTF-8 bytes.
    """
    plain = F.when(path.rlike(r"\A[\x00-\x7f]*\z"), path).otherwise(F.array_join(F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"\A[\x00-\x7f]*\z"), c).otherwise(F.url_encode(c))), ""))

    def piece(text: Column) -> Column:
        code = F.upper(F.substring(text, 1, 2))
        sign = F.char(F.conv(code, 16, 10).cast("int"))
        decoded = F.when(sign.rlike(r"\A[A-Za-z0-9._~-]\z"), sign).otherwise(F.concat(F.lit("%"), code))
        return F.when(text.rlike(r"\A[0-9A-Fa-f]{2}"), F.concat(decoded, F.substring(text, F.lit(3), F.char_length(text)))).otherwise(F.concat(F.lit("%"), text))

    parts = F.split(plain, "%")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))


def path_pattern(path: Column) -> Column:
    """A path rule as an anchored pattern: ``*`` is anything, a final ``$`` the end."""
    quoted = F.regexp_replace(path, r"([.+?^()\[\]{}|\\$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\\\$\z", r"\\z"), r"\*+", ".*"))


def robots_decisions(urls: DataFrame, rules: DataFrame, keys: list[str], path: str) -> DataFrame:
    """keys, path, allowed: the longest matching rule decides; without one the path is allowed."""
    distinct = urls.select(*keys, F.col(path).alias("path")).distinct()
    asked = distinct.withColumn("_normal", normal_path(F.col("path")))
    r = rules.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "allow", F.col("path").alias("rule_path"), "pattern")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    matched = asked.join(r, on, "left").where(F.col("pattern").isNull() | F.rlike("_normal", F.col("pattern"))).drop("_normal")
    best = matched.groupBy(*keys, "path").agg(F.max(F.struct(F.length("rule_path").alias("n"), "allow")).alias("b"))
    decided = distinct.join(best, [*keys, "path"], "left")
    return decided.select(*keys, "path", F.coalesce("b.allow", F.lit(True)).alias("allowed"))


def robots_availability(status: Column) -> Column:
    """What a robots response means: parse, no_rules or unavailable."""
    hard = status.isin(401, 403, 407, 451, 408, 425, 429)
    return F.when(status.between(200, 299), "parse").when(status.between(400, 499) & ~hard, "no_rules").otherwise("unavailable")


def robots_fetched(start: DataFrame, hops: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """key, final_url, policy of the robots address of each site: redirects followed (at most five), then the status of where they end.

    start: key, url; hops: from_url, to_url; statuses: url, status. A loop, too
    many hops or an address without answer makes the policy unavailable.
    """
    ended = follow_redirects(start, hops, key)
    answers = statuses.groupBy("url").agg(F.max("status").alias("_status"))
    joined = ended.join(answers, F.col("final_url") == F.col("url"), "left")
    policy = F.when((F.col("outcome") == "ended") & F.col("_status").isNotNull(), robots_availability(F.col("_status"))).otherwise("unavailable")
    return joined.select(key, "final_url", policy.alias("policy"))
