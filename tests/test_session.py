import pytest

from fathomline import session as S


def test_scratch_is_removed(spark):
    df = spark.range(3)
    with S.scratch(spark):
        table, n, path = S.materialize(df, "x")
        assert n == 3 and table.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_broadcast_is_measured_in_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    df = spark.createDataFrame([("x" * 1000,)] * 10, "v string")
    assert hinted(S.checked_broadcast(df, 10)) and not hinted(S.checked_broadcast(df, 9)) and not hinted(S.checked_broadcast(df, 10, 5_000))
    assert hinted(S.checked_broadcast(df.limit(0), 1))


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="checkpoint"):
        S.scratch_dir(Session())
