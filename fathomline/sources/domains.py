"""Input of domains: contract, whole-input checks, order-independent digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions.normalize import normalize_hostnames
from fathomline.session import materialize

COLUMN = "root_domain"
#: Limits of an input file.
MAX_ROWS = 1_000_000
MAX_GROUP_ROWS = 65_536
CODECS = ("UNCOMPRESSED", "SNAPPY")
FORMATS = ("1", "2")
MAX_CHUNK_BYTES = 33_554_432


@dataclass(frozen=True)
class DomainInput:
    """An accepted input: its canonical hosts, their number and the digest of their set."""

    domains: DataFrame
    count: int
    digest: str

    def members(self, names: DataFrame, column: str) -> DataFrame:
        """The rows of ``names`` whose host is one of the input (a membership test of many names at once)."""
        known = self.domains.select(F.col("domain").alias("_member"))
        return names.join(known, names[column] == known["_member"], "left_semi")


def read_domains(spark: SparkSession, path: str, row_no: str | None = None) -> DataFrame:
    """The one required column; other columns are neither read nor decoded. ``row_no`` adds each row's place in its file, from 1."""
    df = spark.read.parquet(path)
    check_schema(df.schema)
    place = [(F.col("_metadata.row_index") + 1).alias(row_no)] if row_no else []
    return df.select(COLUMN, *place)


def open_domains(spark: SparkSession, path: str, allow_special_use: bool = False) -> DomainInput:
    """Check, normalise and digest an input file; raises before anything is written if a row or the file is unacceptable.

    The canonical hosts are written once to the scratch folder and read from there.
    """
    for name in _files(spark, path):
        check_file(name)
    hosts, count, _ = materialize(accepted(read_domains(spark, path, "row_no"), COLUMN, allow_special_use, "row_no"), "domains")
    return DomainInput(hosts, count, set_digest(hosts, "domain")[0])


def _files(spark: SparkSession, path: str) -> list[str]:
    return sorted(f.removeprefix("file://").removeprefix("file:") for f in spark.read.parquet(path).inputFiles())


def check_schema(schema: T.StructType) -> None:
    """Exactly one top-level string column ``root_domain``, in any spelling of its case only once, and nowhere nested."""
    found = [f for f in schema.fields if f.name == COLUMN]
    if len(found) != 1 or not isinstance(found[0].dataType, T.StringType):
        raise ValueError(f"the input needs one top-level string column {COLUMN}")
    if sum(f.name.lower() == COLUMN for f in schema.fields) != 1:
        raise ValueError(f"the column {COLUMN} stands twice")


def check_file(path: str, most_rows: int = MAX_ROWS) -> int:
    """Check the footer of one Parquet file; gives its number of rows.

    Column: one flat string column (annotated as text), required or optional.
    File: format version 1 or 2, codec, rows, rows of a group, bytes of the column's chunks.
    """
    import pyarrow.parquet as pq

    file = pq.ParquetFile(path)
    meta = file.metadata
    at = [i for i in range(len(meta.schema)) if meta.schema.column(i).path.split(".")[0] == COLUMN]
    if len(at) != 1:
        raise ValueError(f"the input needs one flat column {COLUMN}")
    leaf = meta.schema.column(at[0])
    if leaf.path != COLUMN or leaf.max_repetition_level or leaf.max_definition_level > 1:
        raise ValueError(f"the column {COLUMN} is nested or repeated")
    if leaf.physical_type != "BYTE_ARRAY" or leaf.logical_type.type != "STRING":
        raise ValueError(f"the column {COLUMN} is not annotated as text")
    if meta.format_version.split(".")[0] not in FORMATS:
        raise ValueError(f"format version {meta.format_version} is not allowed")
    if not 1 <= meta.num_rows <= most_rows:
        raise ValueError(f"the input has {meta.num_rows} rows; 1 to {most_rows} are allowed")
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        if group.num_rows > MAX_GROUP_ROWS:
            raise ValueError(f"row group {g} has {group.num_rows} rows; at most {MAX_GROUP_ROWS} are allowed")
        chunk = group.column(at[0])
        if chunk.compression not in CODECS:
            raise ValueError(f"codec {chunk.compression} is not allowed")
        if max(chunk.total_compressed_size, chunk.total_uncompressed_size) > MAX_CHUNK_BYTES:
            raise ValueError(f"row group {g} holds more than {MAX_CHUNK_BYTES} bytes")
    return meta.num_rows


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Add the place of each row, from 1, however the rows are split: the rows of earlier partitions plus the place within its own.

    One count per partition reaches the driver.
    """
    spark = df.sparkSession
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).cast("int")
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_before") + within + 1).drop("_id", "_part", "_before")


def preflight(df: DataFrame, column: str = COLUMN, allow_special_use: bool = False, row_no: str | None = None) -> DataFrame:
    """Rows that make the input unacceptable: row_no (from 1), problem (invalid or duplicate).

    Any such row rejects the whole input. Two spellings of one host are
    duplicates; the later row is reported. Values are never reported.
    row_no: the column that numbers the rows, where they come numbered.
    """
    numbered = df.select(column, F.col(row_no).alias("_id")) if row_no else number_rows(df.select(column), "_id_").withColumnRenamed("_id_", "_id")
    hosts = normalize_hostnames(numbered, column, "_host", allow_special_use)
    invalid = hosts.where("_host IS NULL").select("_id", F.lit("invalid").alias("problem"))
    first = hosts.where("_host IS NOT NULL").groupBy("_host").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = hosts.join(first, "_host").where("_id > _first").select("_id", F.lit("duplicate").alias("problem"))
    return invalid.unionByName(repeated).select(F.col("_id").alias("row_no"), "problem")


def accepted(df: DataFrame, column: str = COLUMN, allow_special_use: bool = False, row_no: str | None = None) -> DataFrame:
    """Canonical hosts of an input without any bad row; raises before anything is written otherwise, naming the first bad row of each kind."""
    bad = preflight(df, column, allow_special_use, row_no).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first")).collect()
    if bad:
        raise ValueError("input rejected: " + ", ".join(f"{r['n']} {r['problem']} (first in row {r['first']})" for r in sorted(bad)))
    return normalize_hostnames(df.select(column), column, "domain", allow_special_use).select("domain")


def set_digest(df: DataFrame, column: str) -> tuple[str, int]:
    """Digest and size of a set of names, independent of order and repetition.

    SHA-256 over a tag, the number of members and the sorted members framed by
    their lengths. Names stream to the driver partition by partition in sorted
    order, never as a whole.
    """
    distinct = df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    n = distinct.count()
    h = hashlib.sha256(b"domain-set\0")
    h.update(n.to_bytes(8, "big"))
    for row in distinct.orderBy("v").toLocalIterator(prefetchPartitions=True):
        raw = row.v.encode()
        h.update(len(raw).to_bytes(8, "big"))
        h.update(raw)
    return "sha256:" + h.hexdigest(), n


def partial_set_digest(df: DataFrame, column: str) -> DataFrame:
    """One row: a digest of a set that combines in any order, for sets too large to stream.

    The sum modulo 2**256 of the members' hashes, computed where the rows lie.
    """
    distinct = df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0, 0
        for frame in frames:
            for v in frame["v"]:
                total = (total + int.from_bytes(hashlib.sha256(v.encode()).digest(), "big")) % (1 << 256)
                n += 1
        yield pd.DataFrame({"part": [f"{total:064x}"], "n": [n]})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0, 0
        for frame in frames:
            total = (total + sum(int(x, 16) for x in frame["part"])) % (1 << 256)
            n += int(frame["n"].sum())
        yield pd.DataFrame({"digest": [f"{total:064x}"], "n": [n]})

    return distinct.mapInPandas(add, "part string, n long").repartition(1).mapInPandas(join, "digest string, n long")
