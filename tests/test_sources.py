import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.sources import domains as S
from fathomline.sources import records as R
from fathomline.streaming.incremental import continue_run


def hosts(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "root_domain string")


def test_contract(tmp_path, spark):
    path = str(tmp_path / "in.parquet")
    pq.write_table(pa.table({"root_domain": ["a.tld", "b.tld"], "extra": [1, 2]}), path, compression="snappy")
    assert S.check_file(path) == 2 and S.read_domains(spark, path).columns == ["root_domain"]
    with pytest.raises(ValueError):
        S.check_file(path, most_rows=1)
    pq.write_table(pa.table({"root_domain": ["a.tld"]}), path, compression="zstd")
    with pytest.raises(ValueError):
        S.check_file(path)
    with pytest.raises(ValueError):
        S.check_schema(T.StructType([T.StructField("other", T.StringType())]))


def test_open(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    pq.write_table(pa.table({"root_domain": ["B.tld", "a.tld."]}), path, compression="snappy")
    opened = S.open_domains(spark, path)
    assert opened.count == 2 and opened.digest == S.set_digest(hosts(spark, ["a.tld", "b.tld"]), "root_domain")[0]
    assert [r.n for r in opened.members(spark.createDataFrame([("b.tld",), ("c.tld",), (None,)], "n string"), "n").collect()] == ["b.tld"]
    pq.write_table(pa.table({"root_domain": ["a.tld"] * 40 + ["x"]}), path, compression="snappy", row_group_size=7)
    with pytest.raises(ValueError, match=r"39 duplicate \(first in row 2\), 1 invalid \(first in row 41\)"):
        S.open_domains(spark, path)
    for column in (pa.array([["a.tld"]]), pa.array([b"a.tld"]), pa.array([{"x": "a.tld"}])):
        pq.write_table(pa.table({"root_domain": column}), path, compression="snappy")
        with pytest.raises(ValueError):
            S.open_domains(spark, path)


def test_preflight(spark):
    assert sorted(r.domain for r in S.accepted(hosts(spark, ["B.tld", "a.tld."])).collect()) == ["a.tld", "b.tld"]
    for n in (1, 2, 4, 7):  # the same rows in the same order, split in other ways
        rows = spark.sparkContext.parallelize([("a.tld",), ("A.TLD.",), (None,), ("x",)], n).toDF("root_domain string")
        assert {(r.row_no, r.problem) for r in S.preflight(rows).collect()} == {(2, "duplicate"), (3, "invalid"), (4, "invalid")}
    with pytest.raises(ValueError, match="1 duplicate"):
        S.accepted(hosts(spark, ["a.tld", "A.tld"]))


def test_set_digests_ignore_order_and_repetition(spark):
    one, two = hosts(spark, ["b", "a", "c"]), hosts(spark, ["c", "a", "b", "a", None]).repartition(3)
    assert S.set_digest(one, "root_domain") == S.set_digest(two, "root_domain") != S.set_digest(hosts(spark, ["a", "bc"]), "root_domain")
    assert S.partial_set_digest(one, "root_domain").collect() == S.partial_set_digest(two, "root_domain").collect()
    assert S.set_digest(hosts(spark, []), "root_domain")[1] == 0


def test_records(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a.tld", 1, None), ("b.tld", 2, "x")], "domain string, schema_version int, final_url string")
    R.write_records(df, path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines[0] == '{"domain":"a.tld","schemaVersion":1,"finalUrl":null}'
    with pytest.raises(Exception):
        R.write_records(df, path)
    with pytest.raises(ValueError):
        R.write_records(df.unionByName(df), str(tmp_path / "twice"))
    (tmp_path / "out" / "part-zz.txt").write_text('{"domain":"c.tld","sch')
    more = spark.createDataFrame([("b.tld", 3, None), ("c.tld", 4, None)], df.schema)
    R.write_records(more, path, "resume")
    back = R.read_records(spark, path, T.StructType([T.StructField("domain", T.StringType()), T.StructField("schemaVersion", T.IntegerType())]))
    assert sorted((r.domain, r.schemaVersion) for r in back.where("_corrupt_record IS NULL").collect()) == [("a.tld", 1), ("b.tld", 2), ("c.tld", 4)]
    done = R.existing_keys(spark, path, "domain")
    with pytest.raises(ValueError):
        R.resume_input(df.limit(1), done, df.limit(1), "domain")
    R.write_records(df, path, "force")
    assert spark.read.text(path).count() == 2
    assert R.canonical_json({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}' and R.digest({"a": 1}).startswith("sha256:")
    with pytest.raises(ValueError):
        R.canonical_json({"a": 0.5})


def test_stream_does_every_key_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
    schema = T.StructType([T.StructField("domain", T.StringType())])
    write = lambda names: spark.createDataFrame([(n,) for n in names], schema).write.mode("append").parquet(source)
    work = lambda df: df.withColumn("done", F.lit(True))
    write(["a", "b", "b", None])
    continue_run(spark, source, schema, sink, checkpoint, "domain", work).awaitTermination()
    write(["b", "c"])
    continue_run(spark, source, schema, sink, checkpoint, "domain", work).awaitTermination()
    continue_run(spark, source, schema, sink, checkpoint + "2", "domain", work).awaitTermination()
    assert sorted(r.domain for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


RUN_SCHEMA = T.StructType([T.StructField("domain", T.StringType()), T.StructField("runId", T.StringType()), T.StructField("n", T.LongType()), T.StructField("in", T.StructType([T.StructField("x", T.StringType())]))])


def test_resume_checks_every_line(spark, tmp_path):
    def problems(*lines):
        path = tmp_path / f"out{len(list(tmp_path.iterdir()))}"
        path.mkdir()
        (path / "part-0.txt").write_text("\n".join(lines))
        known = spark.createDataFrame([("a.tld",), ("b.tld",)], "domain string")
        return sorted(r.problem for r in R.resume_issues(spark, str(path), RUN_SCHEMA, known, "domain", {"runId": "r1"}).collect())

    line = lambda d, run="r1", n="1", more="": f'{{"domain":"{d}","runId":"{run}","n":{n},"in":{{"x":null}}{more}}}'
    assert problems(line("a.tld"), line("b.tld"), '{"domain":"a.tld","ru') == []
    assert problems(line("a.tld"), line("a.tld", n="2")) == ["has a key that repeats"] * 2
    assert problems(line("a.tld", run="r2"), line("z.tld"), line("b.tld", more=',"extra":1')) == ["belongs to another run", "does not fit the schema", "is of no input"]
    assert problems(line("a.tld", n='"x"'), '{"domain":"b.tld","runId":"r1","n":1}', "[1]") == ["does not fit the schema"] * 3


def test_records_are_worked_out_once_and_the_summary_comes_last(spark, tmp_path):
    df = spark.range(3).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"), F.rand().alias("score"))
    R.write_records(df, str(tmp_path / "o"), summary=df.agg(F.count(F.lit(1)).alias("n_domains")))
    assert spark.read.text(str(tmp_path / "o")).count() == 3 and "nDomains" in spark.read.text(str(tmp_path / "o.summary")).first().value
    with pytest.raises(ValueError):
        R.write_records(df.unionByName(df), str(tmp_path / "p"), summary=df)
    assert not (tmp_path / "p").exists() and not (tmp_path / "p.summary").exists()


def test_sidecar(spark, tmp_path):
    value = {"b": [1, "é"], "a": None}
    digest = R.write_sidecar(spark, value, str(tmp_path / "s"))
    assert R.read_sidecar(spark, str(tmp_path / "s"), digest) == value
    with pytest.raises(ValueError):
        R.read_sidecar(spark, str(tmp_path / "s"), "sha256:0")
    with pytest.raises(ValueError):
        R.write_sidecar(spark, {"a": 1.5}, str(tmp_path / "t"))
