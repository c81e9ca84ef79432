"""Queries of the core data-processing problems: hierarchies, skew, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import same_value, sql_same_value
from fathomline.operators.hierarchy import Hierarchy, build_hierarchy
from fathomline.operators.nested import Shape, flatten_json
from fathomline.operators.skew import balanced_aggregate, balanced_join
from fathomline.session import read_table

# --- hierarchies of technologies -------------------------------------------------


def technology_hierarchy(spark: SparkSession, folder: str, paths: bool = True) -> Hierarchy:
    """The parents of technologies in every catalog revision, from both kinds of links; of links loaded again the newest counts."""
    links = [
        read_table(spark, folder, t).select("revision", same_value("name").alias("name"), same_value("target").alias("target"), "loaded_at") for t in ("tech_implies", "tech_requires")
    ]
    return build_hierarchy(links[0].unionByName(links[1]), "name", "target", {"revision": "revision"}, newest="loaded_at", paths=paths)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of each technology that has a parent; circles have root '' and depth -1."""
    return technology_hierarchy(spark, folder, paths=False).linked().select("revision", F.col("node").alias("name"), "root", "depth")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path of every node from its root; null for nodes without a root."""
    nodes = technology_hierarchy(spark, folder).nodes
    return nodes.select("revision", F.col("node").alias("name"), "parent", "root", "depth", F.array_join("path", " > ").alias("path"))


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every ancestor and descendant with their distance."""
    return technology_hierarchy(spark, folder).descendants()


def p3_circles(spark: SparkSession, folder: str) -> DataFrame:
    """Technologies whose way up never ends, and whether they stand on the circle."""
    return technology_hierarchy(spark, folder, paths=False).circular().select("revision", F.col("node").alias("name"), "parent", "on_circle")


_SQL_LINKS = f"""links AS (
  SELECT revision, node, arg_max(parent, (loaded_at, parent)) AS parent FROM (
    SELECT revision, {sql_same_value("name")} AS node, {sql_same_value("target")} AS parent, loaded_at FROM tech_implies
    UNION ALL SELECT revision, {sql_same_value("name")}, {sql_same_value("target")}, loaded_at FROM tech_requires
  ) WHERE length(node) > 0 AND length(parent) > 0 GROUP BY revision, node
), tree AS (
  SELECT DISTINCT l.revision, l.parent AS node, CAST(NULL AS VARCHAR) AS parent, l.parent AS root, 0 AS depth, [l.parent] AS path FROM links l
  WHERE NOT EXISTS (SELECT 1 FROM links c WHERE c.revision = l.revision AND c.node = l.parent)
  UNION ALL SELECT l.revision, l.node, l.parent, t.root, t.depth + 1, list_append(t.path, l.node) FROM tree t JOIN links l ON l.revision = t.revision AND l.parent = t.node
), nodes AS (
  SELECT * FROM tree UNION ALL
  SELECT l.revision, l.node, l.parent, '', -1, NULL FROM links l WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.revision = l.revision AND t.node = l.node)
)"""

# --- skewed keys ----------------------------------------------------------------


def _evidence_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows per piece of evidence: its technology and its collector."""
    evidence = read_table(spark, folder, "evidence")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(same_value(f), F.lit("(null)")).alias("term")) for f in ("technology", "collector")])
    return evidence.select("confidence", F.explode(pairs).alias("p")).select("confidence", "p.field", "p.term")


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and summed confidence of every technology and collector of evidence as delivered."""
    return balanced_aggregate(_evidence_terms(spark, folder), ["field", "term"], {"n_rows": F.count(F.lit(1)), "sum_confidence": F.sum(F.col("confidence").cast("long"))})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that hold more than a twentieth of all rows of evidence.

    The number of all rows is one value, read from the file footers.
    """
    everything = read_table(spark, folder, "evidence").count()
    return p5_totals(spark, folder).where(F.col("n_rows") * 20 > everything).select("field", "term")


def p5_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence per category and collector: the skewed evidence joined with the catalog's categories."""
    evidence = read_table(spark, folder, "evidence").select("evidence_id", same_value("technology").alias("technology"), F.coalesce(same_value("collector"), F.lit("(null)")).alias("collector"), "confidence")
    categories = read_table(spark, folder, "technologies").select(same_value("name").alias("technology"), F.explode("categories").alias("c")).select("technology", F.col("c.name").alias("category"))
    joined = balanced_join(evidence, categories, ["technology"], spread=F.col("evidence_id"))
    return joined.groupBy("category", "collector").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("confidence").cast("long")).alias("sum_confidence"))


_SQL_TERMS = f"""terms AS (
  SELECT 'technology' AS field, coalesce({sql_same_value("technology")}, '(null)') AS term, confidence FROM evidence
  UNION ALL SELECT 'collector', coalesce({sql_same_value("collector")}, '(null)'), confidence FROM evidence
)"""

# --- nested records --------------------------------------------------------------

_EVIDENCE = {"rule_id": "ruleid", "match_value": "match.value", "match_text": "match", "match_kind": "match.kind", "collector": "collector", "source": "source", "confidence": "confidence"}
RESULT_SHAPE = Shape(root="record", anchor="technologies", tables=frozenset(("technologies", "evidence")), columns={"technologies": ("name",), "evidence": tuple(_EVIDENCE.values())})
CATALOG_SHAPE = Shape(
    root="catalog", anchor="technologies", bare=True, dictionaries={"technologies": ("name", None), "headers": ("name", "value"), "js": ("name", "value"), "meta": ("name", "value"), "dom": ("name", "value"), "attributes": ("name", "value")},
    tables=frozenset(("technologies", "headers", "value")), columns={"technologies": ("name",), "headers": ("name",)},
)


def _child_of(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Follow the foreign key from ``child`` to ``parent`` (whose columns carry the prefix p_)."""
    parent = parent.select(F.col("doc_key").alias("p_key"), F.col("node_id").alias("p_id"), *[F.col(c) for c in parent.columns if c.startswith("p_")])
    return child.join(parent, (F.col("doc_key") == F.col("p_key")) & (F.col("parent_id") == F.col("p_id")))


def p6_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of evidence of the raw result records with its technology and match."""
    flat = flatten_json(read_table(spark, folder, "result_records"), "record_no", "payload", RESULT_SHAPE)
    technologies = flat.table("technologies", {"technology": "name"}).select("doc_key", "node_id", F.col("technology").alias("p_technology"))
    evidence = flat.table("evidence", _EVIDENCE).where("parent_table = 'technologies'")
    return _child_of(evidence, technologies).select(
        F.col("doc_id").alias("record_no"), F.col("p_technology").alias("technology"), F.col("ordinal").alias("item_no"), "rule_id",
        F.coalesce("match_value", "match_text", F.lit("")).alias("match_value"), "match_kind", "collector", "source", F.col("confidence").cast("int").alias("confidence"),
    )


def p6_header_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Every header pattern of the raw catalogs with its technology, header and place."""
    flat = flatten_json(read_table(spark, folder, "catalog_docs"), "doc_no", "payload", CATALOG_SHAPE)
    technologies = flat.table("technologies", {"technology": "name"}).select("doc_key", "node_id", F.col("technology").alias("p_technology"))
    headers = flat.table("headers", {"header": "name"}).where("parent_table = 'technologies'")
    headers = _child_of(headers, technologies).select("doc_key", "node_id", F.col("header").alias("p_header"), "p_technology")
    patterns = flat.table("value", {"pattern": "value"}).where("parent_table = 'headers'")
    return _child_of(patterns, headers).select(
        F.col("doc_id").alias("doc_no"), F.col("p_technology").alias("technology"), F.col("p_header").alias("header"), F.col("ordinal").alias("item_no"), "pattern"
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence entries with a rule id, and patterns of the header X-Powered-By."""
    evidence = p6_evidence(spark, folder).where("rule_id IS NOT NULL")
    patterns = p6_header_patterns(spark, folder).where("lower(header) = 'x-powered-by'")
    return evidence.select(F.lit("result_records").alias("src_table"), "record_no", "technology", "item_no", "rule_id", "match_value").unionByName(
        patterns.select(F.lit("catalog_docs").alias("src_table"), F.col("doc_no").alias("record_no"), "technology", "item_no", F.lit("").alias("rule_id"), F.col("pattern").alias("match_value"))
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p3_circles": p3_circles,
    "p5_found": p5_found,
    "p5_totals": p5_totals,
    "p5_categories": p5_categories,
    "p6_found": p6_found,
    "p6_evidence": p6_evidence,
    "p6_header_patterns": p6_header_patterns,
}

ORACLE_SQL = {
    "p3_found": f"WITH RECURSIVE {_SQL_LINKS} SELECT revision, node AS name, root, depth FROM nodes WHERE parent IS NOT NULL",
    "p3_paths": f"WITH RECURSIVE {_SQL_LINKS} SELECT revision, node AS name, parent, root, depth, array_to_string(path, ' > ') AS path FROM nodes",
    "p3_descendants": f"WITH RECURSIVE {_SQL_LINKS}, pairs AS (SELECT revision, unnest(path) AS ancestor, generate_subscripts(path, 1) AS lvl, node AS descendant, depth FROM nodes WHERE depth > 0) "
    "SELECT revision, ancestor, descendant, CAST(depth - lvl + 1 AS INTEGER) AS distance FROM pairs WHERE lvl <= depth",
    "p3_circles": f"WITH RECURSIVE {_SQL_LINKS}, lost AS MATERIALIZED (SELECT revision, node, parent FROM nodes WHERE depth = -1), up AS (SELECT revision, node AS start, parent AS at_node FROM lost UNION SELECT u.revision, u.start, l.parent FROM up u JOIN lost l ON l.revision = u.revision AND l.node = u.at_node) "
    "SELECT revision, node AS name, parent, EXISTS (SELECT 1 FROM up u WHERE u.revision = lost.revision AND u.start = node AND u.at_node = node) AS on_circle FROM lost",
    "p5_totals": f"WITH {_SQL_TERMS} SELECT field, term, count(*) AS n_rows, CAST(sum(confidence) AS BIGINT) AS sum_confidence FROM terms GROUP BY field, term",
    "p5_found": f"WITH {_SQL_TERMS} SELECT field, term FROM terms GROUP BY field, term HAVING count(*) * 20 > (SELECT count(*) FROM evidence)",
    "p5_categories": f"""WITH c AS (SELECT {sql_same_value("name")} AS technology, unnest(categories).name AS category FROM technologies)
SELECT category, coalesce({sql_same_value("collector")}, '(null)') AS collector, count(*) AS n_rows, CAST(sum(confidence) AS BIGINT) AS sum_confidence
FROM evidence e JOIN c ON {sql_same_value("e.technology")} = c.technology GROUP BY 1, 2""",
}
