"""Items that appear together in one record, and how much more often than chance.

Stripes: each task folds its records into stripes, one associative array of
co-occurring neighbours per item; stripes of equal items are merged by adding
their entries; counts of items and records give the ratio to chance and the
log-likelihood ratio of every pair.

Exact pruning: a pair shares at most as many records as its rarer item has, so
items below ``min_records`` (or below ``min_share`` of all records) cannot be
part of a wanted pair and leave before pairs are counted. No pair that the
thresholds admit is lost.

Scale: baskets hold each item once, so the hottest item is one entry per record.
Pairs never leave a task as rows: a task keeps them as packed numbers, folds
them in blocks and flushes whole stripes when ``FLUSH_PAIRS`` distinct pairs are
held. Merging is a sum by (item, neighbour) with a map-side combine, so no stripe
is gathered in one place. A basket above ``BASKET_ITEMS`` items is cut into chunks
that no task gathers again: each pair of chunks is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import ensure_workers_import, materialize

FLUSH_PAIRS = 4_000_000
BLOCK_PAIRS = 4_000_000
#: Items of a basket that one task pairs up; larger baskets are cut into chunks of about this size.
BASKET_ITEMS = 4_096
#: Chi-square of one degree of freedom at the usual levels of significance.
LEVELS = ((0.001, 10.828), (0.01, 6.635), (0.05, 3.841))

_STRIPES = pa.schema([("field", pa.string()), ("item", pa.int64()), ("neighbours", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def pair_codes(baskets: list[np.ndarray], base: int) -> Iterator[np.ndarray]:
    """Packed codes (a * base + b, a < b) of all pairs inside each basket, in bounded blocks.

    baskets: sorted distinct item numbers below ``base``.
    """
    for basket in baskets:
        n = len(basket)
        step = max(1, BLOCK_PAIRS // max(n, 1))
        for start in range(0, n - 1, step):
            left = np.arange(start, min(start + step, n - 1))
            sizes = n - 1 - left
            ends = np.cumsum(sizes)
            right = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(left + 1, sizes)
            yield basket[np.repeat(left, sizes)] * base + basket[right]


def cross_codes(left: np.ndarray, right: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """Packed codes of all pairs of one item of each of two disjoint chunks, the smaller item first, in bounded blocks."""
    step = max(1, BLOCK_PAIRS // max(len(right), 1))
    for start in range(0, len(left), step):
        a, b = np.meshgrid(left[start : start + step], right, indexing="ij")
        yield (np.minimum(a, b) * base + np.maximum(a, b)).ravel()


def fold_counts(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add the counts of equal codes."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts, first)


def _stripes(field: str, codes: np.ndarray, counts: np.ndarray, base: int) -> pa.RecordBatch:
    items, neighbours = codes // base, codes % base
    starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
    offsets = pa.array(np.r_[starts, len(codes)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (neighbours, counts)]
    return pa.RecordBatch.from_arrays([pa.array([field] * len(starts), pa.string()), pa.array(items[starts]), *lists], schema=_STRIPES)


def item_pairs(df: DataFrame, record: list[str], fields: list[str], min_records: int = 1, min_share: tuple[int, int] = (0, 1)) -> DataFrame:
    """Pairs of items of a field within a record.

    df: one row per occurrence, one column per field with the item (null: none).
    min_share: (a, b) keeps pairs in at least a / b of all records.

    Gives field, item_a < item_b (by bytes), n_ab, n_a, n_b, n_records, lift
    (n_ab * N / (n_a * n_b)) and llr, the log-likelihood ratio statistic.

    Defined cases: repeated items of a record count once; a record without items
    still counts in N; null record keys are a value like any other; an empty
    table or a field without items gives no rows.
    """
    spark = df.sparkSession
    ensure_workers_import(spark)
    a, b = min_share
    rows = df.select(F.xxhash64(*record, F.lit(1)).alias("rec_a"), F.xxhash64(F.lit(2), *reversed(record)).alias("rec_b"), *fields)
    measured = rows.groupBy("rec_a", "rec_b").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("records"), F.max("n").alias("most")).first()
    n_records = measured["records"]
    least = max(min_records, -(-a * n_records // b), 1)
    terms = rows.select("rec_a", "rec_b", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields])).alias("t")).select("rec_a", "rec_b", "t.field", "t.item")
    held = terms.where("item IS NOT NULL").select("rec_a", "rec_b", "field", "item").distinct()
    held, _, _ = materialize(held, "baskets")
    counts = held.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    items, n_items, _ = materialize(counts.withColumn("code", F.monotonically_increasing_id()), "items")
    base = 1 << 31
    numbered = _dense_codes(items, n_items)
    coded = held.join(numbered.select("field", "item", "code"), ["field", "item"]).select("rec_a", "rec_b", "field", "code")
    whole = coded
    large = None
    # A record cannot have more items than rows, so most collections have no large basket.
    if (measured["most"] or 0) > BASKET_ITEMS:
        coded, _, _ = materialize(coded, "coded")
        sizes = coded.groupBy("rec_a", "rec_b", "field").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > BASKET_ITEMS)
        sizes, n_large, _ = materialize(sizes, "large-baskets")
        if n_large:
            whole = coded.join(sizes, ["rec_a", "rec_b", "field"], "left_anti")
            large = _chunk_pairs(coded.join(sizes, ["rec_a", "rec_b", "field"]))
    baskets = whole.groupBy("rec_a", "rec_b", "field").agg(F.sort_array(F.collect_list("code")).alias("basket")).where(F.size("basket") > 1).select("field", "basket", F.lit(None).cast("array<long>").alias("other"))
    if large is not None:
        baskets = baskets.unionByName(large)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        pending: dict[str, int] = {}

        def settle(field: str) -> None:
            codes, counts = state.get(field, (np.empty(0, np.int64), np.empty(0, np.int64)))
            fresh = np.concatenate(waiting.pop(field))
            pending[field] = 0
            state[field] = fold_counts(np.r_[codes, fresh], np.r_[counts, np.ones(len(fresh), np.int64)])

        for batch in batches:
            names = batch.column("field").to_pylist()
            (flat, offsets), (more, ends) = ((c.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False))]) for c in (batch.column("basket"), batch.column("other")))
            for at, field in enumerate(names):
                own, other = flat[offsets[at] : offsets[at + 1]], more[ends[at] : ends[at + 1]]
                for codes in cross_codes(own, other, base) if len(other) else pair_codes([own], base):
                    waiting.setdefault(field, []).append(codes)
                    pending[field] = pending.get(field, 0) + len(codes)
                    if pending[field] >= BLOCK_PAIRS:
                        settle(field)
                        if len(state[field][0]) >= FLUSH_PAIRS:
                            yield _stripes(field, *state.pop(field), base)
        for field in list(waiting):
            settle(field)
        for field, (codes, counts) in state.items():
            if len(codes):
                yield _stripes(field, codes, counts, base)

    stripes = baskets.mapInArrow(fold, "field string, item long, neighbours array<long>, counts array<long>")
    entries = stripes.select("field", "item", F.explode(F.arrays_zip("neighbours", "counts")).alias("e"))
    merged = entries.groupBy("field", F.col("item").alias("a"), F.col("e.neighbours").alias("b")).agg(F.sum("e.counts").alias("n_ab")).where(F.col("n_ab") >= least)
    side = lambda x: numbered.select("field", F.col("code").alias(x), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
    named = merged.join(side("a"), ["field", "a"]).join(side("b"), ["field", "b"])
    swap = F.col("item_a") > F.col("item_b")
    ordered = named.select(
        "field",
        F.when(swap, F.col("item_b")).otherwise(F.col("item_a")).alias("item_a"), F.when(swap, F.col("item_a")).otherwise(F.col("item_b")).alias("item_b"),
        "n_ab", F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        F.lit(n_records).cast("long").alias("n_records"),
    )
    return ordered.withColumn("lift", F.col("n_ab") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b"))).withColumn("llr", log_likelihood_ratio())


def _chunk_pairs(coded: DataFrame) -> DataFrame:
    """field, basket, other: the chunks of large baskets, alone and in all pairs, each pair a row that any task may take.

    coded: rec_a, rec_b, field, code, _size. A chunk goes to every pair it is
    part of, which is as many rows as the basket has chunks.
    """
    chunks = F.ceil(F.col("_size") / BASKET_ITEMS).cast("int")
    own = F.pmod(F.xxhash64("code", F.lit(23)), chunks).cast("int")
    placed = coded.withColumn("_chunks", chunks).withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    low, high = F.least("_own", "_with"), F.greatest("_own", "_with")
    grouped = placed.groupBy("rec_a", "rec_b", "field", low.alias("_low"), high.alias("_high")).agg(F.sort_array(F.collect_list(F.when(F.col("_own") == low, F.col("code")))).alias("basket"), F.sort_array(F.collect_list(F.when((F.col("_own") == high) & (low != high), F.col("code")))).alias("other"))
    return grouped.where((F.size("basket") > 0) & ((F.size("other") > 0) | ((F.col("_low") == F.col("_high")) & (F.size("basket") > 1)))).select("field", "basket", "other")


def _dense_codes(items: DataFrame, n_items: int) -> DataFrame:
    """Numbers from 0 in place of the sparse ids, so that two of them fit one long."""
    spark = items.sparkSession
    parts = items.select((F.col("code").bitwiseAND(F.lit(-1 << 33))).alias("part")).groupBy("part").count().orderBy("part").collect()
    if n_items >= 1 << 31:
        raise ValueError("more items than pairs can be packed for: raise min_records")
    offset, table = 0, []
    for r in parts:
        table.append((r["part"], offset))
        offset += r["count"]
    offsets = F.broadcast(spark.createDataFrame(table, "part long, offset long"))
    dense = items.withColumn("part", F.col("code").bitwiseAND(F.lit(-1 << 33))).join(offsets, "part")
    return dense.select("field", "item", "n", (F.col("code") - F.col("part") + F.col("offset")).alias("code"))


def log_likelihood_ratio() -> Column:
    """2 * (H(cells) - H(rows) - H(columns)) of the two-by-two table of a pair, not below 0."""
    n, ab, a, b = (F.col(c).cast("double") for c in ("n_records", "n_ab", "n_a", "n_b"))

    def h(x):
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    cells = h(ab) + h(a - ab) + h(b - ab) + h(n - a - b + ab)
    return F.greatest(F.lit(0.0), 2 * (cells - h(a) - h(n - a) - h(b) - h(n - b) + h(n)))


def significance() -> Column:
    """The strictest of the usual levels at which the llr says that a pair is no chance (more or less often, as lift says); null: none."""
    return F.coalesce(*[F.when(F.col("llr") >= least, F.lit(level)) for level, least in LEVELS])
