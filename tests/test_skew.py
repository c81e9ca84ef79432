from collections import Counter

from pyspark.sql import functions as F

from fathomline.operators.skew import balanced_aggregate, balanced_join, place_keys

ROWS = [("hot", i, i % 7) for i in range(4000)] + [(None, i, 1) for i in range(900)] + [(f"k{i % 200}", i, 2) for i in range(3000)] + [("", 1, 5), ("", 1, 5)]
SCHEMA = "key string, id long, v int"


def test_counts_equal_plain_grouping(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.key: (r.n, r.s) for r in balanced_aggregate(df, ["key"], {"n": F.count(F.lit(1)), "s": F.sum("v")}).collect()}
    want = {}
    for k, _, v in ROWS:
        n, s = want.get(k, (0, 0))
        want[k] = (n + 1, s + v)
    assert got == want


def test_fragments_go_to_their_packed_task(spark):
    """The registered query itself moves partial rows by their task, not by a hash of the key, and reads evidence once."""
    from fathomline.plans.data_problems import p5_totals

    plan = p5_totals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "RepartitionById" in plan or "shufflepartitionid" in plan.lower()
    assert "evidence.parquet" not in plan


def test_rows_spread_over_tasks(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    placement = place_keys(df, ["key"], tasks=8)
    assert placement.n_heavy == 2 and placement.n_heavy <= 16
    sent = placement.send(placement.shard(df, F.col("id")))
    per_task = Counter(r[0] for r in sent.select(F.spark_partition_id()).collect())
    assert len(per_task) == 8 and max(per_task.values()) < 1.35 * len(ROWS) / 8
    assert sent.where(F.col("_task") != F.spark_partition_id()).count() == 0


def test_join_copies_matching_rows_once_per_row(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    match = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), (None, 3, "n"), ("k5", 4, "c"), ("absent", 5, "z")], "key string, v int, name string")
    for how in ("inner", "left"):
        got = Counter(balanced_join(df, match, ["key"], how, tasks=8).select("key", "id", "v", "v_match", "name").collect())
        by = {"hot": [(1, "a"), (2, "b")], None: [(3, "n")], "k5": [(4, "c")]}
        want = Counter((k, i, v, *m) for k, i, v in ROWS for m in by.get(k, [(None, None)] if how == "left" else []))
        assert got == want


def test_aggregate_with_matching_side(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    match = spark.createDataFrame([("hot", "x"), ("k5", "y")], "key string, label string")
    got = {(r.key, r.label): r.n for r in balanced_aggregate(df, ["key"], {"n": F.count(F.lit(1))}, match=match).collect()}
    assert got == {("hot", "x"): 4000, ("k5", "y"): 15}


def test_plan_has_no_second_exchange_before_the_task(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    placement = place_keys(df, ["key"], tasks=8)
    plan = placement.send(placement.shard(df, F.col("id"))).groupBy("key", "_task").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "hashpartitioning" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert balanced_aggregate(df, ["key"], {"n": F.count(F.lit(1))}).count() == 0
    assert balanced_join(df, df, ["key"]).count() == 0
