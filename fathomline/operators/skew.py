"""Per-key results when a few keys hold most of the rows.

Fragment-replicate by estimated load: the load of every key bucket is counted,
keys that exceed half a task's fair share are split into shards in proportion
to their load, and shards and light buckets are packed onto tasks, the largest
first. Rows go straight to their task (``repartitionById``); the matching side
of a join is copied only to the tasks that hold a shard of its key.

Size bounds: with ``tasks`` tasks there are at most ``2 * tasks`` heavy keys,
``4 * tasks`` shards and ``BUCKETS_PER_TASK * tasks`` light buckets. Only these
reach the driver and only they are broadcast, however many rows or keys exist.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.session import materialize

BUCKETS_PER_TASK = 16


@dataclass
class Placement:
    """Where the rows of each key go.

    heavy: one row per heavy key with the tasks of its shards (``_shards``).
    bucket_tasks: the task of each light bucket.
    loads: rows planned for each task.
    """

    keys: list[str]
    tasks: int
    heavy: DataFrame
    n_heavy: int
    bucket_tasks: list[int]
    loads: list[float]

    def _places(self, df: DataFrame) -> DataFrame:
        """Add ``_shards`` (null for light keys) and ``_light``, from two small tables of bounded size."""
        spark = df.sparkSession
        buckets = spark.createDataFrame(list(enumerate(self.bucket_tasks)), "_b long, _light int")
        placed = df.withColumn("_at", _bucket(self.keys, len(self.bucket_tasks)))
        placed = placed.join(F.broadcast(buckets), placed["_at"] == buckets["_b"], "left").drop("_at", "_b")
        if not self.n_heavy:
            return placed.withColumn("_shards", F.lit(None).cast("array<int>"))
        heavy = self.heavy.select(*[F.col(k).alias(f"_h_{i}") for i, k in enumerate(self.keys)], "_shards")
        on = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(heavy[f"_h_{i}"]) for i, k in enumerate(self.keys)])
        return placed.join(F.broadcast(heavy), on, "left").drop(*[f"_h_{i}" for i in range(len(self.keys))])

    def shard(self, df: DataFrame, spread: Column | None = None) -> DataFrame:
        """Add ``_task``: the one task of each row of the skewed side."""
        spread = F.monotonically_increasing_id() if spread is None else F.xxhash64(spread)
        pick = F.element_at("_shards", (F.pmod(spread, F.size("_shards")) + 1).cast("int"))
        return self._places(df).withColumn("_task", F.when(F.col("_shards").isNotNull(), pick).otherwise(F.col("_light"))).drop("_shards", "_light")

    def replicate(self, df: DataFrame) -> DataFrame:
        """Add ``_task``: a copy of each row of the matching side for every task that needs it."""
        targets = F.when(F.col("_shards").isNotNull(), F.array_distinct("_shards")).otherwise(F.array("_light"))
        return self._places(df).withColumn("_task", F.explode(targets)).drop("_shards", "_light")

    def send(self, df: DataFrame) -> DataFrame:
        """Move every row to its ``_task``, exactly."""
        return df.repartitionById(self.tasks, F.col("_task"))


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(17)), F.lit(n))


def place_keys(df: DataFrame, keys: list[str], tasks: int | None = None) -> Placement:
    """Estimate the load of all keys of ``df`` and pack them onto ``tasks``.

    Two aggregations, both combined on the map side: rows per hash bucket, then
    rows per key but only inside buckets that exceed half a task's share.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = BUCKETS_PER_TASK * tasks
    slim = df.select(*keys)
    by_bucket = {r["b"]: r["n"] for r in slim.groupBy(_bucket(keys, n_buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(by_bucket.values())
    share = total / tasks / 2
    full = [b for b, n in by_bucket.items() if n > share]
    heavy: list[tuple] = []
    if full and total:
        counted = slim.withColumn("_b", _bucket(keys, n_buckets)).where(F.col("_b").isin(full)).groupBy("_b", *keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
        for row in counted.collect():
            heavy.append((tuple(row[k] for k in keys), row["_n"]))
            by_bucket[row["_b"]] -= row["_n"]
    pieces = [(n, "bucket", b, 0) for b, n in by_bucket.items()]
    for at, (_, n) in enumerate(heavy):
        shards = max(2, -int(-n // max(share, 1)))
        pieces += [(n / shards, "key", at, s) for s in range(shards)]
    heap = [(0.0, t) for t in range(tasks)]
    bucket_tasks = [b % tasks for b in range(n_buckets)]
    shard_tasks: list[list[int]] = [[] for _ in heavy]
    for n, kind, at, _ in sorted(pieces, key=lambda p: (-p[0], p[1], p[2], p[3])):
        load, task = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, task))
        if kind == "bucket":
            bucket_tasks[at] = task
        else:
            shard_tasks[at].append(task)
    loads = [0.0] * tasks
    for load, task in heap:
        loads[task] = load
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField("_shards", T.ArrayType(T.IntegerType()))])
    table = spark.createDataFrame([(*key, shard_tasks[at]) for at, (key, _) in enumerate(heavy)], schema)
    return Placement(keys, tasks, table, len(heavy), bucket_tasks, loads)


def balanced_aggregate(df: DataFrame, keys: list[str], partials: Mapping[str, Column], merges: Mapping[str, Callable[[str], Column]] | None = None, match: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Per-key aggregates without an overloaded task.

    partials: name to aggregate over the rows of one fragment of a key; merges:
    how fragments are combined (default: sum). match: rows to join to the keys
    (inner), copied only to the tasks that hold a fragment.

    The rows are read once: each input task aggregates its rows per key, and
    these partial rows, at most one per key and input task, are what the load
    is estimated on and what moves. A key that many tasks hold is heavy and is
    split into shards; shards and light buckets are packed onto tasks, partial
    rows go straight to their task, are merged there, and the few results of a
    heavy key's shards are added up.

    Defined cases: a null key is a key; an empty table gives no rows; repeated
    rows all count; columns other than the keys are not touched, whatever their
    names (``_task``, ``_part``, ``_shards``, ``_light`` and names starting with ``_h_`` are reserved).
    """
    merges = {n: (merges or {}).get(n, F.sum) for n in partials}
    held, _, _ = materialize(df.withColumn("_part", F.spark_partition_id()).groupBy(*keys, "_part").agg(*[a.alias(n) for n, a in partials.items()]), "fragments")
    placement = place_keys(held, keys, tasks)
    combine = lambda table, by: table.groupBy(*by).agg(*[m(n).alias(n) for n, m in merges.items()])
    fragments = combine(placement.send(placement.shard(held, F.col("_part"))), [*keys, "_task"])
    if match is not None:
        fragments = _join_on_task(fragments, placement.send(placement.replicate(match)), keys, "inner")
        extra = [c for c in match.columns if c not in keys]
    else:
        extra = []
    return combine(fragments, [*keys, *extra])


def balanced_join(skewed: DataFrame, match: DataFrame, keys: list[str], how: str = "inner", spread: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Join a skewed table with its matching side by fragment and replicate.

    how: inner or left (the skewed side is kept). Null keys match null keys only
    if they stand in both tables as nulls. Non-key columns of the matching side
    that clash with the skewed side get the suffix ``_match``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    placement = place_keys(skewed, keys, tasks)
    clash = [c for c in match.columns if c not in keys and c in skewed.columns]
    match = match.withColumnsRenamed({c: f"{c}_match" for c in clash})
    return _join_on_task(placement.send(placement.shard(skewed, spread)), placement.send(placement.replicate(match)), keys, how).drop("_task")


def _join_on_task(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({"_task": "_r_task"} | {k: f"_r_{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{i}"]) for i, k in enumerate(keys)], left["_task"] == renamed["_r_task"])
    return left.join(renamed, on, how).drop("_r_task", *[f"_r_{i}" for i in range(len(keys))])
