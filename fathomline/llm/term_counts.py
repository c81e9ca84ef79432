"""Occurrences and records of every distinct term, kept up to date by signed deltas.

The state of a collection is three append-only logs in a shared folder:

* *images*: which record and which terms each row had, and its version;
* *postings*: signed changes of how often a term occurs in a record;
* *counts*: signed changes of the occurrences and records of each term.

A batch of changes is set against the images of the rows it names. Rows whose
image changed take their old terms back and put their new ones in; the sums per
(record, term) are set against the postings of the same keys, which says whether
the term entered or left the record; sums per term are the batch's deltas. All
three results are appended. Added, changed, moved, re-delivered and deleted rows
follow the same rule; a re-delivery without change adds nothing.

Cost of a batch: it writes what it changes, and reads the buckets of the logs
that its rows, postings and terms fall into, from which a semi-join picks its
own keys before anything moves. Buckets are hashes, so a small batch reads
a small share; nothing of the state is rewritten but by compaction, which merges
the segments of a bucket once there are more than ``MOST_SEGMENTS`` of them. A
version lists the segments of each bucket and is published last, so a job that
dies leaves the old version whole.

Keys of rows and records are 128-bit hashes (a collision among 10**12 records is
less likely than 10**-14); the text of each term is kept once per segment.

Scale: every group is a row, a (record, term) or a term, each combined on the
map side, so a record or term that holds most rows makes no hot task. The bucket
function is the one by which the engine places the groups, so that each bucket
of a batch is written by one task. No list of terms or records is collected.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import drop_path, new_path

#: Keys of a batch up to this number are copied to all tasks to pick their part of the state; above it the planner decides.
BROADCAST_KEYS = 500_000
MOST_SEGMENTS = 8

Buckets = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class TermState:
    """A version of the state: the segments of each bucket of the three logs."""

    root: str
    buckets: int
    fields: tuple[str, ...]
    images: Buckets
    postings: Buckets
    counts: Buckets
    version: int


_LOGS = ("images", "postings", "counts")
ROW = ("row", "row_b")
POSTING = ("rec_a", "rec_b", "field_no", "a", "b")
TERM = ("field_no", "a", "b")
POSTING_SCHEMA = "rec_a long, rec_b long, field_no int, a long, b long, d long, d_records long"
COUNT_SCHEMA = "field_no int, a long, b long, term string, occurrences long, records long"


def _hash2(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns, F.lit(1)), F.xxhash64(F.lit(2), *reversed(columns))]


def _bucket(keys: tuple[str, ...], n: int) -> Column:
    """The engine's own placement of groups by these keys on ``n`` tasks."""
    return F.pmod(F.hash(*keys), F.lit(n))


def new_state(spark: SparkSession, root: str, fields: list[str], buckets: int | None = None) -> TermState:
    """The state of an empty collection; ``buckets`` defaults to the session's shuffle partitions."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return TermState(root, n, tuple(fields), ((),) * n, ((),) * n, ((),) * n, 0)


def save_state(spark: SparkSession, state: TermState) -> str:
    """Publish a version: one small file, written after all its tables."""
    path = f"{state.root}/version={state.version:06d}"
    spark.createDataFrame([(json.dumps(state.__dict__),)], "state string").coalesce(1).write.text(path)
    return path


def load_state(spark: SparkSession, path: str) -> TermState:
    """A published version."""
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    for name in _LOGS:
        raw[name] = tuple(tuple(x) for x in raw[name])
    return TermState(**(raw | {"fields": tuple(raw["fields"])}))


def _image(n: int) -> list[str]:
    """The columns of an image, in the order that decides between two of them."""
    return ["version", "rec_a", "rec_b", *[f"{x}_{i}" for i in range(n) for x in "ab"]]


def _image_schema(n: int) -> str:
    return "row long, row_b long, " + ", ".join(f"{c} long" for c in _image(n))


def _read(spark: SparkSession, schema: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def changes(df: DataFrame, row_key: list[str], record_key: list[str], version: Column | str, terms: Mapping[str, Column], deleted: Column | None = None, space: int = 0) -> DataFrame:
    """The change feed of a source table.

    terms: field name to the term of the row (null: none), in the order of the
    state's fields. A row with the same ``row_key`` and a greater version
    replaces the earlier one; ``deleted`` marks rows that take themselves back.
    space: number of the source, so that rows of several tables can share a state.
    """
    versions = F.col(version) if isinstance(version, str) else version
    if df.select(versions.alias("v")).dtypes[0][1].startswith("timestamp"):
        versions = F.unix_micros(versions.cast("timestamp"))
    versions = versions.cast("long")
    if len(row_key) == 1 and dict(df.dtypes)[row_key[0]] in ("bigint", "int"):
        row = [F.col(row_key[0]).cast("long"), F.lit(space).cast("long")]
    else:
        row = _hash2(F.lit(space), *[F.col(c) for c in row_key])
    record = _hash2(*[F.col(c) for c in record_key])
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    out = [record[0].alias("rec_a"), record[1].alias("rec_b"), row[0].alias("row"), row[1].alias("row_b"), versions.alias("version")]
    for at, (name, term) in enumerate(terms.items()):
        kept = F.when(~gone, term.cast("string"))
        out += [F.when(kept.isNotNull(), h).alias(f"{x}_{at}") for x, h in zip("ab", _hash2(F.lit(name), kept), strict=True)] + [kept.alias(f"term_{at}")]
    return df.select(*out)


def _append(spark: SparkSession, df: DataFrame, keys: tuple[str, ...], label: str, log: Buckets) -> tuple[Buckets, str]:
    """Write one segment per bucket that ``df`` has rows for; gives the log with them and their folder."""
    path = new_path(spark, label)
    df.withColumn("bucket", _bucket(keys, len(log))).write.partitionBy("bucket").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    written = {f.getPath().getName() for f in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)}
    return tuple((*segments, f"{path}/bucket={b}") if f"bucket={b}" in written else segments for b, segments in enumerate(log)), path


def _own_part(spark: SparkSession, schema: str, log: Buckets, wanted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of a log with the keys of a batch, from the buckets that these fall into."""
    touched = wanted.groupBy(_bucket(keys, len(log)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
    held = _read(spark, schema, [s for r in sorted(touched, key=lambda r: r["bucket"]) for s in log[r["bucket"]]])
    few = sum(r["n"] for r in touched) <= BROADCAST_KEYS
    return held.join(F.broadcast(wanted) if few else wanted, list(keys), "left_semi")


def apply_changes(state: TermState, feed: DataFrame) -> tuple[TermState, DataFrame]:
    """Apply one batch; gives the new state and the signed per-term deltas of the batch (field_no, a, b, term, occurrences, records).

    Defined cases: a batch may name a row several times (the greatest version
    counts; between equal versions and against the state, the greatest hashes);
    a version older than the state's is ignored (a null version is the oldest);
    a row that moves to another record leaves the old one; a null term is no
    term; an empty batch changes nothing.
    """
    spark = feed.sparkSession
    n = len(state.fields)
    image, schema = _image(n), _image_schema(n)
    slim = feed.select(*ROW, *image)
    if any(state.images):
        held = _own_part(spark, schema, state.images, slim.select(*ROW), ROW)
        rows = held.withColumn("_old", F.lit(True)).unionByName(slim.withColumn("_old", F.lit(False)))
        order = F.struct(*image)
        best = rows.groupBy(*ROW).agg(F.max(order).alias("new"), F.max(F.when(F.col("_old"), order)).alias("old")).where("NOT (new <=> old)")
    else:
        best = slim.groupBy(*ROW).agg(F.max(F.struct(*image)).alias("new")).withColumn("old", F.lit(None).cast("struct<" + ",".join(f"{c}:bigint" for c in image) + ">"))
    images, path = _append(spark, best.select(*ROW, *[F.col(f"new.{c}").alias(c) for c in image], "old"), ROW, "term-images", state.images)

    changed = spark.read.schema(f"{schema}, old struct<" + ",".join(f"{c}:bigint" for c in image) + ">").parquet(path)
    side = lambda at, prefix, sign: F.struct(F.col(f"{prefix}rec_a").alias("rec_a"), F.col(f"{prefix}rec_b").alias("rec_b"), F.lit(at).alias("field_no"), F.col(f"{prefix}a_{at}").alias("a"), F.col(f"{prefix}b_{at}").alias("b"), F.lit(sign).alias("d"))
    sides = [side(at, *x) for at in range(n) for x in ((("", 1), ("old.", -1)) if any(state.images) else (("", 1),))]
    events = changed.select(F.explode(F.array(*sides)).alias("e")).select("e.*").where("a IS NOT NULL")
    per = events.groupBy(*POSTING).agg(F.sum("d").alias("d"))
    if any(state.postings):
        known = _own_part(spark, POSTING_SCHEMA, state.postings, events.select(*POSTING).distinct(), POSTING)
        both = events.select(*POSTING, F.col("d").cast("long").alias("d"), F.lit(0).cast("long").alias("had")).unionByName(known.select(*POSTING, F.lit(0).cast("long").alias("d"), F.col("d").alias("had")))
        per = both.groupBy(*POSTING).agg(F.sum("d").alias("d"), F.sum("had").alias("had"))
    else:
        per = per.withColumn("had", F.lit(0).cast("long"))
    held_now = (F.col("had") + F.col("d") > 0).cast("long") - (F.col("had") > 0).cast("long")
    postings, path = _append(spark, per.where("d <> 0").select(*POSTING, "d", held_now.alias("d_records")), POSTING, "term-postings", state.postings)

    deltas = spark.read.schema(POSTING_SCHEMA).parquet(path).groupBy(*TERM).agg(F.sum("d").alias("occurrences"), F.sum("d_records").alias("records")).where("occurrences <> 0 OR records <> 0")
    spelled = feed.select(F.explode(F.array(*[F.struct(F.lit(i).alias("field_no"), F.col(f"term_{i}").alias("term")) for i in range(n)])).alias("t")).select("t.*").where("term IS NOT NULL").distinct()
    by_field = lambda k: reduce(lambda c, i: c.when(F.col("field_no") == i, _hash2(F.lit(state.fields[i]), F.col("term"))[k]), range(1, n), F.when(F.col("field_no") == 0, _hash2(F.lit(state.fields[0]), F.col("term"))[k]))
    spelled = spelled.select("field_no", by_field(0).alias("a"), by_field(1).alias("b"), "term")
    counts, path = _append(spark, deltas.join(spelled, list(TERM), "left").select(*TERM, "term", "occurrences", "records"), TERM, "term-counts", state.counts)
    after = compact(spark, replace(state, images=images, postings=postings, counts=counts, version=state.version + 1))
    return after, _read(spark, COUNT_SCHEMA, [path]).drop("bucket")


def compact(spark: SparkSession, state: TermState, most: int = MOST_SEGMENTS) -> TermState:
    """Merge the segments of the buckets that have more than ``most`` of them; other buckets stay as they are."""
    n = len(state.fields)
    order = F.struct(*_image(n))
    rules = {
        "images": (_image_schema(n), ROW, lambda df: df.groupBy(*ROW).agg(F.max(order).alias("r")).select(*ROW, *[F.col(f"r.{c}").alias(c) for c in _image(n)])),
        "postings": (POSTING_SCHEMA, POSTING, lambda df: df.groupBy(*POSTING).agg(F.sum("d").alias("d")).where("d <> 0").withColumn("d_records", F.lit(1).cast("long"))),
        "counts": (COUNT_SCHEMA, TERM, _summed),
    }
    for name, (schema, keys, merge) in rules.items():
        log = getattr(state, name)
        full = [b for b, segments in enumerate(log) if len(segments) > most]
        if full:
            emptied = tuple(() if b in full else segments for b, segments in enumerate(log))
            merged, _ = _append(spark, merge(_read(spark, schema, [s for b in full for s in log[b]])), keys, f"term-{name}", emptied)
            state = replace(state, **{name: merged})
    return state


def _summed(df: DataFrame) -> DataFrame:
    """Counts per term with its spelling; terms that occur no more are left out."""
    sums = df.groupBy(*TERM).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences > 0")
    spelled = df.where("term IS NOT NULL").select(*TERM, "term").distinct()
    return sums.join(spelled, list(TERM), "left").select(*TERM, "term", "occurrences", "records")


def read_counts(spark: SparkSession, state: TermState) -> DataFrame:
    """field, term, occurrences, records of every term that occurs."""
    names = F.array(*[F.lit(f) for f in state.fields])
    counts = _summed(_read(spark, COUNT_SCHEMA, [f for folders in state.counts for f in folders]))
    return counts.select(F.get(names, F.col("field_no")).alias("field"), "term", "occurrences", "records")


def mark_terms(counts: DataFrame, all_records: int, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """Add ``mark``: rare (in fewer than ``rare_below`` records), common (in more than that share of all records) or null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > all_records * common_above, "common")
    return counts.withColumn("mark", mark)


def drop_state(spark: SparkSession, state: TermState, kept: TermState | None = None) -> None:
    """Delete the segments of a version that ``kept`` does not use."""
    listed = lambda s: {f for name in _LOGS for folders in getattr(s, name) for f in folders}
    for f in listed(state) - (listed(kept) if kept else set()):
        drop_path(spark, f)
