"""Compilation of rule catalogs: tags, versions, locators, ids, corrections, indexes."""

from __future__ import annotations

import hashlib
import json
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions import policy
from fathomline.operators.patterns import engine_refuses, translate

LITERAL_SOURCES = ("robots", "probe", "tls_issuer")
#: Catalog fields and the evidence source of their rules.
FIELD_SOURCES = {
    "url": "url", "headers": "header", "cookies": "cookie", "html": "html", "text": "text", "css": "css", "meta": "meta", "scriptsrc": "script_url",
    "scripts": "script_content", "js": "javascript", "xhr": "network_url", "robots": "robots", "probe": "probe", "certissuer": "tls_issuer", "dns": "dns_record", "dom": "dom",
}
MAX_RULES = 1_000_000


def parse_tags(original: Column) -> Column:
    r"""Struct pattern, confidence, version_template, valid of a tagged pattern ``p\;confidence:N\;version:T``."""
    parts = F.split(original, r"\\;")
    tags = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = lambda name: F.filter(tags, lambda t: F.startswith(t, F.lit(f"{name}:")))
    value = lambda name: F.substring_index(F.try_element_at(named(name), F.lit(1)), f"{name}:", -1)
    confidence = F.coalesce(value("confidence").try_cast("int"), F.lit(100))
    known = F.forall(tags, lambda t: F.startswith(t, F.lit("confidence:")) | F.startswith(t, F.lit("version:")))
    single = (F.size(named("confidence")) <= 1) & (F.size(named("version")) <= 1)
    numeric = (F.size(named("confidence")) == 0) | value("confidence").rlike(r"\A\d{1,3}\z")
    return F.struct(
        F.when(F.length(parts[0]) > 0, parts[0]).alias("pattern"), confidence.alias("confidence"), value("version").alias("version_template"),
        (known & single & numeric & confidence.between(0, 100)).alias("valid"),
    )


def selector_parts(original: Column) -> Column:
    r"""A selector and its tags: only the first ``\;`` separates."""
    at = F.locate("\\;", original)
    return F.struct(F.when(at > 0, F.substring(original, F.lit(1), at - 1)).otherwise(original).alias("selector"), F.when(at > 0, F.substring(original, at + 2, F.length(original))).alias("tags"))


def valid_version_template(template: Column) -> Column:
    r"""Back references, free text and at most one conditional ``\N?a:b`` as the whole."""
    return template.isNull() | (template.rlike(r"\A\\[1-9]\d*\?[^:?]*:[^:?]*\z") | ~template.rlike(r"\?")) & ~template.rlike(r"\\(?:[^1-9]|\z)")


def match_mode(source: Column, pattern: Column) -> Column:
    """presence without a pattern, literal for robots, probes and issuers, else regex."""
    return F.when(pattern.isNull() | (F.length(pattern) == 0), "presence").when(source.isin(*LITERAL_SOURCES), "literal").otherwise("regex")


def normal_locator(source: Column, locator: Column) -> Column:
    """Headers and meta keys in lower case, DNS types in upper case."""
    return F.when(source.isin("header", "meta"), F.lower(F.trim(locator))).when(source == "dns_record", F.upper(F.trim(locator))).otherwise(locator)


def cookie_pattern(locator: Column) -> Column:
    """The whole-name pattern of a cookie locator."""
    return F.concat(F.lit("^(?:"), F.regexp_replace(locator, r"\A\(\?i\)", ""), F.lit(")$"))


def rule_id_text(namespace: str, technology: str, source: str, locator: str | None, original: str) -> str:
    raw = json.dumps([namespace, technology, source, locator, original], ensure_ascii=False, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(raw.encode()).hexdigest()


@F.pandas_udf(T.StringType())
def rule_id(namespace: pd.Series, technology: pd.Series, source: pd.Series, locator: pd.Series, original: pd.Series) -> pd.Series:
    """Digest of the canonical JSON array of a rule's identity."""
    rows = zip(namespace, technology, source, locator, original, strict=True)
    return pd.Series([None if o is None else rule_id_text(n, t, s, loc if isinstance(loc, str) else None, o) for n, t, s, loc, o in rows], dtype=object)


#: An escape as a whole: code points, control characters, properties, references by number or name, else one character.
ESCAPE = re.compile(r"\\(?:x\{[^}]*\}|x[0-9A-Fa-f]{1,2}|u\{[^}]*\}|u[0-9A-Fa-f]{1,4}|c[A-Za-z]|[pP](?:\{[^}]*\}|\w)|k(?:<[^>]*>|\{[^}]*\})|[0-9]+|.|$)", re.S)


def _class_end(pattern: str, at: int) -> int:
    """The place after the class that starts at ``at``; its escapes stay whole."""
    at += 2 if pattern[at + 1 : at + 2] == "^" else 1
    while at < len(pattern) and pattern[at] != "]":
        at = ESCAPE.match(pattern, at).end() if pattern[at] == "\\" else at + 1
    return min(at + 1, len(pattern))


def required_literal(pattern: str) -> str:
    """The longest run of plain lower-case characters that every match must hold; '' if none is certain."""
    best, run, depth, at = "", "", 0, 0
    if "|" in pattern or "[]" in pattern or "[^]" in pattern:  # dialects differ on where such a class ends
        return ""
    while at < len(pattern):
        c = pattern[at]
        step, plain = 1, c
        if c == "\\":
            nxt = pattern[at + 1 : at + 2]
            step, plain = ESCAPE.match(pattern, at).end() - at, nxt if nxt and not nxt.isalnum() else ""
        elif c == "[":
            step, plain = _class_end(pattern, at) - at, ""
        elif c in "()":
            depth += 1 if c == "(" else -1
            plain = ""
        elif c in ".^$*+?{":
            if c == "{":
                step = max(1, pattern.find("}", at) - at + 1)
            plain = ""
        follows = pattern[at + step : at + step + 1]
        if plain and depth == 0 and plain.isascii() and follows not in ("*", "?", "{"):
            run += plain.lower()
            if follows == "+":
                best, run = max(best, run, key=len), ""
        else:
            best, run = max(best, run, key=len), ""
        at += step
    return max(best, run, key=len)


def compile_patterns(rules: DataFrame) -> DataFrame:
    """pattern, java_pattern, n_groups, needle, problem of every pattern and locator pattern of the rules.

    The distinct patterns of a catalog (at most :data:`MAX_RULES`, checked) are
    translated and compiled once, on the driver.
    """
    spark = rules.sparkSession
    every = rules.select("pattern").unionByName(rules.select(F.col("locator_pattern").alias("pattern"))).where("pattern IS NOT NULL").distinct()
    found = sorted(r[0] for r in every.limit(2 * MAX_RULES + 1).collect())
    if len(found) > 2 * MAX_RULES:
        raise ValueError("too many patterns for one catalog")
    done = {p: translate(p) for p in found}
    refused = engine_refuses(spark, sorted({t.pattern for t in done.values() if t.pattern is not None}))
    rows = [(p, None if t.pattern in refused else t.pattern, t.groups, required_literal(p) if t.problem is None else "", t.problem or ("not compiled by the engine" if t.pattern in refused else None)) for p, t in done.items()]
    return spark.createDataFrame(rows, "pattern string, java_pattern string, n_groups int, needle string, problem string")


def rejected_rules(rules: DataFrame, compiled: DataFrame | None = None) -> DataFrame:
    """rule_id, field, pattern, problem of the rules that cannot run: those whose pattern or locator pattern is not valid."""
    bad = (compile_patterns(rules) if compiled is None else compiled).where("problem IS NOT NULL").select(F.col("pattern").alias("_p"), "problem")
    parts = [rules.where(kept).join(checked_small(bad), F.col(field) == F.col("_p")).select("rule_id", F.lit(field).alias("field"), F.col("_p").alias("pattern"), "problem") for field, kept in (("pattern", "match_mode = 'regex'"), ("locator_pattern", "true"))]
    return parts[0].unionByName(parts[1])


def compile_rules(raw: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Rules from (namespace, technology, source, locator, original): parsed, identified, deduplicated, numbered.

    Rules with invalid tags, confidence or version template leave; equal rules
    collapse to one. Null originals are no rules. scope: columns of ``raw``, as
    the revision, within which rules belong together.
    """
    tags = parse_tags(F.col("original"))
    rules = raw.where("original IS NOT NULL AND technology IS NOT NULL").withColumn("t", tags).where("t.valid").where(valid_version_template(F.col("t.version_template")))
    rules = rules.select(
        *scope, "namespace", "technology", "source", normal_locator(F.col("source"), F.col("locator")).alias("locator"), F.when(F.col("source") == "cookie", cookie_pattern(F.col("locator"))).alias("locator_pattern"),
        "original", "t.pattern", match_mode(F.col("source"), F.col("t.pattern")).alias("match_mode"), "t.confidence", "t.version_template",
    )
    rules = rules.withColumn("rule_id", rule_id("namespace", "technology", "source", "locator", "original")).dropDuplicates([*scope, "rule_id"])
    return rules.withColumn("locator_kind", locator_kind())


def locator_kind() -> Column:
    return F.when(F.col("locator_pattern").isNotNull(), "pattern").when(F.col("locator").isNotNull(), "exact").otherwise("none")


def rule_order(rules: DataFrame) -> DataFrame:
    """Add ``ordinal``: rules by source, technology, locator and id. A catalog is bounded, so one window serves."""
    w = Window.orderBy(policy.rank("source", policy.RULE_SOURCES), "technology", F.col("locator").asc_nulls_first(), "rule_id")
    return rules.withColumn("ordinal", F.row_number().over(w) - 1)


def correct_rules(rules: DataFrame, drop_technologies: DataFrame, drop_rules: DataFrame, replacements: DataFrame) -> DataFrame:
    """Apply a correction ledger: technologies and rules to drop, patterns to replace.

    replacements: target_rule_id, technology, source, locator, original; only a
    replacement for the same technology, source and locator counts.
    """
    kept = rules.join(checked_small(drop_technologies), rules["technology"] == drop_technologies["technology"], "left_anti")
    kept = kept.join(checked_small(drop_rules), kept["rule_id"] == drop_rules["rule_id"], "left_anti")
    new = replacements.select(F.col("target_rule_id").alias("_id"), F.col("technology").alias("_t"), F.col("source").alias("_s"), F.col("locator").alias("_l"), F.col("original").alias("_o"))
    on = (F.col("rule_id") == F.col("_id")) & (F.col("technology") == F.col("_t")) & (F.col("source") == F.col("_s")) & F.col("locator").eqNullSafe(F.col("_l"))
    return kept.join(checked_small(new), on, "left").withColumn("original", F.coalesce("_o", "original")).drop("_id", "_t", "_s", "_l", "_o")


def checked_small(df: DataFrame) -> DataFrame:
    from fathomline.session import checked_broadcast

    return checked_broadcast(df, MAX_RULES)


def correction_hits(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """How many rules each correction target (rule_id) hits; it must be exactly one."""
    return targets.select("rule_id").join(rules.select(F.col("rule_id").alias("_r")), F.col("rule_id") == F.col("_r"), "left").groupBy("rule_id").agg(F.count("_r").alias("hits"))


def correction_issues(rules: DataFrame, drop_technologies: DataFrame, drop_rules: DataFrame, replacements: DataFrame) -> DataFrame:
    """correction, target, problem of a ledger: targets that hit no rule or several, that are named twice, or whose replacement is for something else.

    A ledger with any issue is not applied (see :func:`apply_corrections`).
    """
    technologies = drop_technologies.select(F.col("technology").alias("target")).join(rules.select(F.col("technology").alias("target")).distinct().withColumn("_known", F.lit(1)), "target", "left")
    issues = [technologies.where("_known IS NULL").select(F.lit("drop_technology").alias("correction"), "target", F.lit("hits nothing").alias("problem"))]
    for kind, targets in (("drop_rule", drop_rules.select("rule_id")), ("replace_rule", replacements.select(F.col("target_rule_id").alias("rule_id")))):
        named = targets.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_times"))
        found = rules.select("rule_id").join(targets.select("rule_id").distinct(), "rule_id", "left_semi").groupBy("rule_id").agg(F.count(F.lit(1)).alias("_hits"))
        problem = F.when(F.col("_times") > 1, "named twice").when(F.col("_hits").isNull(), "hits nothing").when(F.col("_hits") > 1, "hits several")
        issues.append(named.join(found, "rule_id", "left").select(F.lit(kind).alias("correction"), F.col("rule_id").alias("target"), problem.alias("problem")).where("problem IS NOT NULL"))
    other = replacements.select(F.col("target_rule_id").alias("rule_id"), F.col("technology").alias("_t"), F.col("source").alias("_s"), F.col("locator").alias("_l")).join(rules.select("rule_id", "technology", "source", "locator"), "rule_id")
    wrong = ~((F.col("technology") == F.col("_t")) & (F.col("source") == F.col("_s")) & F.col("locator").eqNullSafe(F.col("_l")))
    issues.append(other.where(wrong).select(F.lit("replace_rule").alias("correction"), F.col("rule_id").alias("target"), F.lit("replaces another rule").alias("problem")))
    out = issues[0]
    for i in issues[1:]:
        out = out.unionByName(i)
    return out.distinct()


def apply_corrections(rules: DataFrame, drop_technologies: DataFrame, drop_rules: DataFrame, replacements: DataFrame) -> DataFrame:
    """The corrected rules; raises if the ledger has any issue."""
    bad = correction_issues(rules, drop_technologies, drop_rules, replacements).limit(5).collect()
    if bad:
        raise ValueError("corrections rejected: " + "; ".join(f"{r.correction} {r.target} {r.problem}" for r in bad))
    return correct_rules(rules, drop_technologies, drop_rules, replacements)


def signal_index(rules: DataFrame) -> DataFrame:
    """Rules per source and kind of locator."""
    kinds = rules.withColumn("locator_kind", locator_kind())
    return kinds.groupBy("source", "locator_kind").agg(F.count(F.lit(1)).alias("n_rules"), F.countDistinct("locator").alias("n_locators"))


#: What a plan demands of each kind of rule, by evidence source.
INSPECTIONS = {"dom": "dom_fact", "javascript": "script_path", "probe": "probe_path", "dns_record": "dns_type", "tls_issuer": "tls"}


def inspection_plan(rules: DataFrame) -> DataFrame:
    """Facts that the rules demand: per kind, source and locator whether presence or a value is needed.

    Kinds are dom_fact, script_path, probe_path, dns_type (in upper case), tls
    (one row without locator) and ``other`` for sources that are always observed.
    """
    mode = F.col("match_mode") == "presence"
    kind = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for s, k in INSPECTIONS.items()], F.lit("other"))
    locator = F.when(F.col("source") == "dns_record", F.upper(F.trim("locator"))).when(F.col("source") != "tls_issuer", F.col("locator"))
    return rules.groupBy(kind.alias("kind"), "source", locator.alias("locator")).agg(F.max(mode).alias("needs_presence"), F.max(~mode).alias("needs_value"))


def relation_issues(raw: DataFrame, technologies: DataFrame) -> DataFrame:
    """name, kind, target, problem of relations that reject a catalog: unknown ends, self requires or excludes, confidence or version out of form.

    raw: name, kind, target and, for implies, confidence and version. A technology
    that implies itself is ignored, not rejected.
    """
    known = checked_small(technologies.select(F.col("name").alias("_known")).distinct())
    ends = raw.join(known, F.col("target") == F.col("_known"), "left").withColumnRenamed("_known", "_target_known")
    ends = ends.join(known.withColumnRenamed("_known", "_own"), F.col("name") == F.col("_own"), "left")
    implies = F.col("kind") == "implies"
    problem = (
        F.when(F.col("_own").isNull(), "unknown technology").when(F.col("target").isNull() | F.col("_target_known").isNull(), "unknown target").when(~implies & (F.col("name") == F.col("target")), "refers to itself")
        .when(implies & ~F.coalesce(F.col("confidence").between(1, 100), F.lit(False)), "confidence out of range").when(implies & F.col("version").rlike(r"\\"), "version is no plain text")
    )
    return ends.select("name", "kind", "target", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def relation_edges(raw: DataFrame, technologies: DataFrame) -> DataFrame:
    """Valid relations of (name, kind, target): targets known, no self links. Kinds: implies, requires, excludes."""
    known = technologies.select(F.col("name").alias("_known")).distinct()
    return raw.where("name <> target").join(checked_small(known), F.col("target") == F.col("_known"), "left_semi").distinct()


def category_issues(technologies: DataFrame, categories: DataFrame) -> DataFrame:
    """name, category, problem: category ids of technologies that the list of categories lacks, ids a technology names twice, ids the list has twice.

    technologies: name, cats (ids); categories: id.
    """
    used = technologies.select("name", F.explode("cats").alias("category")).groupBy("name", "category").agg(F.count(F.lit(1)).alias("n"))
    known = categories.groupBy(F.col("id").alias("category")).agg(F.count(F.lit(1)).alias("_n"))
    of_technologies = used.join(known, "category", "left").select("name", "category", F.when(F.col("_n").isNull(), "unknown category").when(F.col("n") > 1, "named twice").alias("problem"))
    of_list = known.where("_n > 1").select(F.lit(None).cast("string").alias("name"), "category", F.lit("defined twice").alias("problem"))
    return of_technologies.unionByName(of_list).where("problem IS NOT NULL")


def category_names(technologies: DataFrame) -> DataFrame:
    """Categories of each technology, ordered by id."""
    return technologies.select("name", F.array_join(F.transform(F.array_sort("categories"), lambda c: F.concat(c["id"].cast("string"), F.lit(":"), c["name"])), ",").alias("categories"))


#: Limits of a catalog on disk.
MAX_FILES, MAX_FILE_BYTES, MAX_CATALOG_BYTES, MAX_NESTING = 64, 16_777_216, 67_108_864, 64
CATALOG_FILE = re.compile(r"(?:[a-z_]|categories|groups)\.json")


def load_catalog(spark, folder: str, digest: str | None = None, allowed: re.Pattern = CATALOG_FILE) -> tuple[DataFrame, str]:
    """(file, content) of a catalog folder and its digest.

    The folder may hold nothing but regular files whose names are allowed;
    numbers and sizes are limited; every file must be a JSON object of limited
    nesting without repeated names; a given digest must fit. Anything else
    rejects the catalog as a whole.
    """
    names = sorted(os.listdir(folder))
    strange = [n for n in names if not allowed.fullmatch(n) or not os.path.isfile(os.path.join(folder, n)) or os.path.islink(os.path.join(folder, n))]
    if strange or not 1 <= len(names) <= MAX_FILES:
        raise ValueError(f"the catalog folder holds other entries: {strange[:3]}" if strange else f"a catalog has 1 to {MAX_FILES} files")
    sizes = [os.path.getsize(os.path.join(folder, n)) for n in names]
    if max(sizes) > MAX_FILE_BYTES or sum(sizes) > MAX_CATALOG_BYTES:
        raise ValueError("the catalog is too large")
    files = []
    for n in names:
        with open(os.path.join(folder, n), "rb") as f:
            files.append((n, f.read()))
    found = catalog_digest(files)
    if digest is not None and digest != found:
        raise ValueError("the catalog does not have the expected digest")

    def unique(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a name stands twice in an object")
        return dict(pairs)

    rows = []
    for n, raw in files:
        text = raw.decode("utf-8")
        depth = most = 0
        for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text):
            depth += (c in "{[") - (c in "}]")
            most = max(most, depth)
        if most > MAX_NESTING:
            raise ValueError(f"{n} is nested too deeply")
        if not isinstance(json.loads(text, object_pairs_hook=unique), dict):
            raise ValueError(f"{n} holds no object")
        rows.append((n, text))
    return spark.createDataFrame(rows, "file string, content string"), found


def catalog_digest(files: list[tuple[str, bytes]]) -> str:
    """Digest over named files: names and contents framed by their lengths, in order of names."""
    h = hashlib.sha256()
    for name, content in sorted(files):
        for part in (name.encode(), content):
            h.update(len(part).to_bytes(8, "big"))
            h.update(part)
    return "sha256:" + h.hexdigest()


def rules_from_documents(flat, namespace: str) -> DataFrame:
    """Raw rules (doc_id, namespace, technology, source, locator, original) of flattened catalog documents.

    flat: tables of :func:`fathomline.operators.nested.flatten_json` whose
    dictionaries turn headers, js, meta and dom into entries of name and value.
    A selector with an object of facts gives one rule per fact, whose locator is
    selector and fact.
    Fields with one pattern or a list of patterns have no locator. The fields and
    their sources are :data:`FIELD_SOURCES`; tables that no document needs are absent.
    """
    technologies = flat.table("technologies", {"technology": "name"}).select(F.col("doc_key").alias("k"), F.col("node_id").alias("t_id"), "technology")
    keyed_fields = [f for f in ("headers", "js", "meta", "dom", "cookies", "dns") if f in flat.plan.tables]
    parts = []
    values = flat.table("value").select("parent_table", "doc_key", "parent_id", F.explode("columns").alias("fact", "original")) if "value" in flat.plan.tables else None
    for field in keyed_fields:
        entries = flat.table(field, {"locator": "name", "alone": "value"}).where("parent_table = 'technologies'").select(F.col("doc_key").alias("k"), F.col("doc_id"), F.col("node_id").alias("e_id"), F.col("parent_id").alias("t_id"), "locator", "alone")
        if values is not None:
            own = values.where(F.col("parent_table") == field).select(F.col("doc_key").alias("k"), F.col("parent_id").alias("e_id"), "fact", "original")
            listed = entries.join(own, ["k", "e_id"]).withColumn("locator", F.when(F.col("fact") == "value", F.col("locator")).otherwise(F.concat_ws(" ", "locator", "fact")))
        else:
            listed = entries.where("alone IS NOT NULL").withColumn("original", F.col("alone"))
        parts.append(listed.select("k", "doc_id", "t_id", F.lit(FIELD_SOURCES[field]).alias("source"), "locator", "original"))
    if {"attributes", "value", "dom"} <= flat.plan.tables:
        # dom entry > value object > attribute entry > pattern
        up = lambda table, parent, own, above, *columns: flat.table(table, dict(columns)).where(F.col("parent_table") == parent).select(F.col("doc_key").alias("k"), "doc_id", F.col("node_id").alias(own), F.col("parent_id").alias(above), *[c for c, _ in columns])
        selector = up("dom", "technologies", "d_id", "t_id", ("selector", "name"))
        holder = up("value", "dom", "v_id", "d_id").drop("doc_id")
        attribute = up("attributes", "value", "a_id", "v_id", ("attribute", "name")).drop("doc_id")
        pattern = up("value", "attributes", "p_id", "a_id", ("original", "value")).drop("doc_id")
        joined = selector.join(holder, ["k", "d_id"]).join(attribute, ["k", "v_id"]).join(pattern, ["k", "a_id"])
        parts.append(joined.select("k", "doc_id", "t_id", F.lit("dom").alias("source"), F.concat_ws(" ", "selector", F.concat(F.lit("attributes."), "attribute")).alias("locator"), "original"))
    for field in [f for f in FIELD_SOURCES if f in flat.plan.tables and f not in keyed_fields]:
        rows = flat.table(field, {"original": "value"}).where("parent_table = 'technologies'")
        parts.append(rows.select(F.col("doc_key").alias("k"), "doc_id", F.col("parent_id").alias("t_id"), F.lit(FIELD_SOURCES[field]).alias("source"), F.lit(None).cast("string").alias("locator"), "original"))
    schema = "doc_id long, namespace string, technology string, source string, locator string, original string"
    if not parts:
        return flat.df.sparkSession.createDataFrame([], schema)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("original IS NOT NULL").join(technologies, ["k", "t_id"]).select("doc_id", F.lit(namespace).alias("namespace"), "technology", "source", "locator", "original")


def catalog_limits(rules: DataFrame, most_rules: int = MAX_RULES, most_length: int = 65_536) -> DataFrame:
    """One row: numbers of rules and technologies, the longest pattern, and whether all limits hold."""
    sums = rules.agg(F.count(F.lit(1)).alias("n_rules"), F.countDistinct("technology").alias("n_technologies"), F.coalesce(F.max(F.length("original")), F.lit(0)).alias("longest"))
    return sums.withColumn("within_limits", (F.col("n_rules") <= most_rules) & (F.col("longest") <= most_length))
