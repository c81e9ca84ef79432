"""Result records as JSON lines: sink, resume, summaries, canonical JSON."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.session import drop_path, materialize

MAX_RECORD_BYTES = 16 * 1024 * 1024
MAX_SIDECAR_BYTES = 64 * 1024 * 1024


def camel_case(df: DataFrame) -> DataFrame:
    """Top-level and nested names in the wire's spelling (snake_case to camelCase)."""

    def rename(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(_camel(f.name), rename(f.dataType), f.nullable) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(rename(kind.elementType), kind.containsNull)
        return kind

    return df.select(*[F.col(f"`{f.name}`").cast(rename(f.dataType)).alias(_camel(f.name)) for f in df.schema.fields])


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def write_records(df: DataFrame, path: str, mode: str = "create", key: str = "domain", summary: DataFrame | None = None, summary_path: str | None = None) -> None:
    """Write one JSON line per record, then the summary.

    mode: create (fails if the path exists), resume (only records whose key the
    output lacks) or force (replace). A repeated key or a record beyond 16 MiB
    rejects the whole batch before anything is written. The records are worked
    out once: what was checked is what is written. The summary is published
    last, so an output without one is unfinished.
    """
    spark = df.sparkSession
    lines = camel_case(df).select(F.col(_camel(key)).alias("_key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines, _, held = materialize(lines, "records")
    try:
        if lines.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"a {key} occurs twice")
        if lines.where(F.octet_length("value") > MAX_RECORD_BYTES).limit(1).count():
            raise ValueError("a record is too large")
        if mode == "resume":
            done = existing_keys(spark, path, key).select(F.col(key).alias("_key"))
            lines.join(done, "_key", "left_anti").select("value").write.mode("append").text(path)
        else:
            lines.select("value").write.mode({"create": "errorifexists", "force": "overwrite"}[mode]).text(path)
    finally:
        drop_path(spark, held)
    if summary is not None:
        write_summary(summary, summary_path or f"{path.rstrip('/')}.summary")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records with an explicit schema; malformed lines keep their text in ``_corrupt_record``."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def fits_schema(line: Column, schema: T.StructType) -> Column:
    """Whether a JSON text is exactly a value of a closed schema: all its fields, no others, of its types.

    The text and the value read from it are compared in one normal form. Null
    and invalid texts do not fit.
    """
    options = {"mode": "PERMISSIVE"}
    read = F.to_json(F.to_variant_object(F.from_json(line, schema, options)))
    return F.coalesce(F.to_json(F.try_parse_json(line)) == read, F.lit(False))


def existing_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys of the complete lines of an output; an unfinished line (a lost writer) does not count."""
    text = spark.read.text(path)
    return text.select(F.get_json_object("value", f"$.{_camel(key)}").alias(key)).where(F.col(key).isNotNull()).distinct()


def resume_issues(spark: SparkSession, path: str, schema: T.StructType, known: DataFrame, key: str, context: dict[str, str]) -> DataFrame:
    """line, problem of an output that is to be continued; none of it may be kept if there is any.

    Every complete line must fit the schema, carry the run's context (path of a
    field to its text), a key that is an input, and a key no other line has. A
    line that is cut off (what a lost writer leaves) is no problem: it does not
    count and its record is written again.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    whole = lines.where(F.try_parse_json("value").isNotNull())
    own = F.get_json_object("value", f"$.{_camel(key)}")
    same = reduce(lambda a, b: a & b, [F.coalesce(F.get_json_object("value", f"$.{name}") == want, F.lit(False)) for name, want in context.items()], F.lit(True))
    marked = whole.select("value", own.alias("_key"), fits_schema(F.col("value"), schema).alias("_fits"), same.alias("_same"))
    inputs = known.select(F.col(key).alias("_input")).distinct()
    times = marked.where("_key IS NOT NULL").groupBy(F.col("_key").alias("_k")).agg(F.count(F.lit(1)).alias("_times"))
    joined = marked.join(inputs, F.col("_key") == F.col("_input"), "left").join(times, F.col("_key") == F.col("_k"), "left")
    problem = F.when(~F.col("_fits"), "does not fit the schema").when(~F.col("_same"), "belongs to another run").when(F.col("_input").isNull(), "is of no input").when(F.col("_times") > 1, "has a key that repeats")
    return joined.select(F.sha2("value", 256).alias("line"), problem.alias("problem")).where("problem IS NOT NULL")


def resume_input(inputs: DataFrame, done: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Inputs still to do; raises if the output holds a key that is no input."""
    if done.join(known.select(key).distinct(), key, "left_anti").limit(1).count():
        raise ValueError("the output holds records of other inputs")
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of few rows as one JSON file, published by the job's commit."""
    camel_case(df).coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and without spaces; only whole numbers are allowed."""

    def check(x: object) -> None:
        if isinstance(x, float):
            raise ValueError("canonical JSON holds whole numbers only")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else ():
            check(y)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_sidecar(spark: SparkSession, value: object, path: str) -> str:
    """One value as canonical JSON beside the records; gives its digest. At most 64 MiB."""
    text = canonical_json(value)
    if len(text.encode()) > MAX_SIDECAR_BYTES:
        raise ValueError("the value is too large for one file")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path, lineSep="\n")
    return digest(value)


def read_sidecar(spark: SparkSession, path: str, expected: str) -> object:
    """The value of a file, if it is canonical, within the limit, and has the expected digest."""
    (text,) = [r[0] for r in spark.read.text(path).limit(2).collect()] or ("",)
    if len(text.encode()) > MAX_SIDECAR_BYTES:
        raise ValueError("the file is too large")
    value = json.loads(text)
    if canonical_json(value) != text or digest(value) != expected:
        raise ValueError("the file is not the expected one")
    return value
