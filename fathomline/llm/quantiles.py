"""Mergeable percentiles of very large numeric columns with a deterministic error.

Values are quantised to a bounded ordered universe of ``2**UNIVERSE_BITS``
leaves. A digest keeps counts at nodes of the dyadic tree above the leaves and
stays small by moving a node and its sibling into their parent as long as the
three together hold at most ``n // k`` values. Digests merge by adding the
counts of equal nodes, so tasks, files and days can be digested apart.

Guarantee: a rank read from a digest is off by at most ``UNIVERSE_BITS * n / k``;
the true percentile lies inside the reported interval [lo, hi], always. With
``n < k`` the leaves are kept and the interval is one leaf. Counts and sums are
kept exactly beside the tree.

Quantisation: with unit 1, whole numbers up to 2**21 are leaves of their own;
larger ones share a leaf with values that differ by less than one part in 2**20.

Scale: each task turns its rows into one digest per group (numpy, batch by
batch, flushed when large); only digests are shuffled. They are written once and
counted, so that merging runs in as many levels of about ``FAN_IN`` digests as the
group with the most digests needs, however many input tasks there were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.session import ensure_workers_import, materialize

MANTISSA_BITS = 20
#: Sign, exponent steps and mantissa of 62-bit whole numbers.
UNIVERSE_BITS = 27
FAN_IN = 256
FLUSH_NODES = 2_000_000
DEFAULT_K = 4096

_HALF = 1 << (UNIVERSE_BITS - 1)
_TOP = (1 << 62) - 1


def leaf_of(values: np.ndarray) -> np.ndarray:
    """The leaf of each whole number; order-preserving."""
    v = np.asarray(values, dtype=np.int64)
    negative = v < 0
    m = np.minimum(np.where(negative, -1 - v, v), _TOP)
    exponent = np.frexp(m.astype(np.float64))[1].astype(np.int64)
    exponent -= (m >> np.clip(exponent - 1, 0, 62)) == 0  # a float rounded up to the next power of two
    shift = np.maximum(exponent - (MANTISSA_BITS + 1), 0)
    code = (shift << MANTISSA_BITS) + (m >> shift)
    return np.where(negative, _HALF - 1 - code, _HALF + code)


#: The code of the greatest whole number; leaves beyond it are never used.
_LAST = ((61 - MANTISSA_BITS) << MANTISSA_BITS) + (1 << MANTISSA_BITS + 1) - 1


def _magnitude(code: np.ndarray, top: bool) -> np.ndarray:
    code = np.minimum(code, _LAST)
    shift = np.maximum((code >> MANTISSA_BITS) - 1, 0)
    mantissa = code - (shift << MANTISSA_BITS)
    return ((mantissa + 1) << shift) - 1 if top else mantissa << shift


def leaf_bounds(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole number of each leaf."""
    leaves = np.asarray(leaves, dtype=np.int64)
    negative = leaves < _HALF
    code = np.where(negative, _HALF - 1 - leaves, leaves - _HALF)
    low, high = _magnitude(code, False), _magnitude(code, True)
    return np.where(negative, -1 - high, low), np.where(negative, -1 - low, high)


def _add_up(group: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add the counts of equal nodes of a group."""
    if not len(node):
        return group, node, count
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])])
    return group[first], node[first], np.add.reduceat(count, first)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress the trees of all groups at once, from the leaves to the root.

    Nodes are numbered as in a heap: the root is 1, the children of x are 2x and
    2x + 1, leaf i is ``2**UNIVERSE_BITS + i``.
    """
    group, node, count = _add_up(group, node, count)
    if not len(node):
        return group, node, count
    limit = np.bincount(group, weights=count).astype(np.int64) // k
    if not limit.any():
        return group, node, count
    settled = []
    small = limit[group] == 0
    settled.append((group[small], node[small], count[small]))
    group, node, count = group[~small], node[~small], count[~small]
    depth = np.frexp(node.astype(np.float64))[1] - 1
    for level in range(UNIVERSE_BITS, 0, -1):
        here = depth == level
        if not here.any():
            continue
        above = depth == level - 1
        g, x, c = group[here], node[here], count[here]
        pg, px, pc = np.r_[g, group[above]], np.r_[x >> 1, node[above]], np.r_[c, count[above]]
        sg, sx, sc = _add_up(pg, px, pc)  # with the parent's own count
        fits = sc <= limit[sg]
        parent = np.searchsorted(sg * (1 << (UNIVERSE_BITS + 1)) + sx, g * (1 << (UNIVERSE_BITS + 1)) + (x >> 1))
        stay = ~fits[parent]
        settled.append((g[stay], x[stay], c[stay]))
        keep_up = np.ones(above.sum(), dtype=bool)
        up = np.searchsorted(sg * (1 << (UNIVERSE_BITS + 1)) + sx, group[above] * (1 << (UNIVERSE_BITS + 1)) + node[above])
        keep_up = ~fits[up]
        rest = ~here & ~above
        group = np.r_[group[rest], group[above][keep_up], sg[fits]]
        node = np.r_[node[rest], node[above][keep_up], sx[fits]]
        count = np.r_[count[rest], count[above][keep_up], sc[fits]]
        depth = np.r_[depth[rest], np.full(int(keep_up.sum() + fits.sum()), level - 1)]
    settled.append((group, node, count))
    return _add_up(*(np.concatenate(a) for a in zip(*settled, strict=True)))


def quantile_leaves(nodes: np.ndarray, counts: np.ndarray, ranks: Sequence[int]) -> list[tuple[int, int]]:
    """For each rank (from 1) the least and greatest leaf its value can have."""
    depth = np.frexp(nodes.astype(np.float64))[1].astype(np.int64) - 1
    below = UNIVERSE_BITS - depth
    low = (nodes << below) - (1 << UNIVERSE_BITS)
    high = low + (1 << below) - 1
    by_low, by_high = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
    up, down = np.cumsum(counts[by_low]), np.cumsum(counts[by_high])
    return [(int(low[by_low][np.searchsorted(up, r)]), int(high[by_high][np.searchsorted(down, r)])) for r in ranks]


def _digest_schema(df: DataFrame, keys: list[str], extra: list[T.StructField] | None = None) -> T.StructType:
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return T.StructType([
        *fields, *(extra or []), T.StructField("n", T.LongType()), T.StructField("total", T.LongType()),
        T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
    ])


def _rows(keys: pd.DataFrame, n: np.ndarray, total: np.ndarray, group: np.ndarray, node: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    starts = np.searchsorted(group, np.arange(len(keys)))
    out = keys.reset_index(drop=True).copy()
    out["n"], out["total"] = n, total
    out["nodes"], out["counts"] = np.split(node, starts[1:]), np.split(count, starts[1:])
    return out


def build_digests(df: DataFrame, keys: list[str], value: Column | str, k: int = DEFAULT_K, unit: float = 1) -> DataFrame:
    """One digest per group and input task: keys, _task, n, total, nodes, counts.

    value: numbers; they are divided by ``unit`` and rounded to whole numbers.
    Nulls and NaN are left out; infinite values count as the ends of the universe.
    """
    ensure_workers_import(df.sparkSession)
    column = F.col(value) if isinstance(value, str) else value
    kind = df.select(column.alias("v")).schema["v"].dataType
    if isinstance(kind, T.IntegralType) and unit == 1:
        whole = column.cast("long")
    else:
        number = column.cast("double") / F.lit(float(unit))
        edge = F.lit(float(1 << 61))
        whole = F.when(number.isNotNull() & ~F.isnan(number), F.round(F.greatest(F.least(number, edge), -edge)).cast("long"))
    slim = df.select(*keys, whole.alias("_value")).where(F.col("_value").isNotNull())

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: pd.DataFrame | None = None
        held: list[tuple] = []
        task, size = TaskContext.get().partitionId(), 0

        def fold() -> tuple:
            return compress(*(np.concatenate(a) for a in zip(*held, strict=True)), k)

        def out() -> pd.DataFrame:
            group, node, count = fold()
            rows = known.drop(columns=["_n", "_total"]).assign(_task=task)
            return _rows(rows, known["_n"].to_numpy(), known["_total"].to_numpy(), group, node, count)

        for frame in frames:
            if not len(frame):
                continue
            value = frame["_value"].to_numpy(np.int64)
            names = frame[keys] if keys else pd.DataFrame({"_": 0}, index=frame.index)
            part = names.groupby(list(names.columns), sort=False, dropna=False)
            local = part.ngroup().to_numpy()
            first = np.unique(local, return_index=True)[1]
            fresh = names.iloc[first].reset_index(drop=True)
            fresh["_n"] = np.bincount(local)
            sums = np.zeros(len(first), dtype=np.int64)
            np.add.at(sums, local, value)
            fresh["_total"] = sums
            both = fresh if known is None else pd.concat([known, fresh], ignore_index=True)
            ids = both.groupby(list(names.columns), sort=False, dropna=False).ngroup().to_numpy()
            merged = both.iloc[np.unique(ids, return_index=True)[1]].reset_index(drop=True)
            for c in ("_n", "_total"):
                added = np.zeros(len(merged), dtype=np.int64)
                np.add.at(added, ids, both[c].to_numpy(np.int64))
                merged[c] = added
            offset = 0 if known is None else len(known)
            group = ids[offset:][local].astype(np.int64)
            known = merged
            held.append(_add_up(group, leaf_of(value) + (1 << UNIVERSE_BITS), np.ones(len(value), dtype=np.int64)))
            size += len(held[-1][0])
            if size > FLUSH_NODES:
                held = [fold()]
                size = len(held[0][0])
                if size > FLUSH_NODES // 2:
                    yield out()[columns]
                    known, held, size = None, [], 0
        if known is not None:
            yield out()[columns]

    schema = _digest_schema(df, keys, [T.StructField("_task", T.IntegerType())])
    columns = schema.names
    return slim.mapInPandas(digest, schema)


def merge_digests(digests: DataFrame, keys: list[str], k: int = DEFAULT_K, parts: int | None = None) -> DataFrame:
    """One digest per group of ``keys`` from any digests that carry these keys.

    parts: the most digests that a group has; by default they are written and
    counted. Above ``FAN_IN`` they are merged in levels. Digests of other tables,
    files or days may be unioned in.
    """
    spark = digests.sparkSession
    ensure_workers_import(spark)
    if parts is None:
        digests, _, _ = materialize(digests.select(*keys, "n", "total", "nodes", "counts"), "digests")
        counted = digests.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
        parts = counted or 1

    def step(table: DataFrame, by: list[str]) -> DataFrame:
        """Add up the digests of each group; all groups of a batch at once, in the order of their keys."""
        schema = _digest_schema(table, by)
        names = [*by, "n", "total", "nodes", "counts"]

        def merged(frame: pd.DataFrame) -> pd.DataFrame:
            group = frame.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(frame), dtype=np.int64)
            sizes = np.array([len(x) for x in frame["nodes"]])
            node, count = (np.concatenate([np.asarray(x, dtype=np.int64) for x in frame[c]]) for c in ("nodes", "counts"))
            first = np.unique(group, return_index=True)[1]
            sums = [np.zeros(len(first), dtype=np.int64) for _ in range(2)]
            for out, c in zip(sums, ("n", "total"), strict=True):
                np.add.at(out, group, frame[c].to_numpy(np.int64))
            return _rows(frame[by].iloc[first], *sums, *compress(np.repeat(group, sizes), node, count, k))[names]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []  # digests of groups that may go on in the next batch
            for frame in frames:
                if not len(frame):
                    continue
                rows = pd.concat([*held, frame], ignore_index=True) if held else frame
                keys_of = rows[by].ne(rows[by].shift()) & ~(rows[by].isna() & rows[by].shift().isna()) if by else pd.DataFrame({"_": [False] * len(rows)})
                starts = np.flatnonzero(keys_of.any(axis=1).to_numpy()[1:]) + 1
                cut = int(starts[-1]) if len(starts) else 0
                if cut:
                    yield merged(rows.iloc[:cut])
                held = [rows.iloc[cut:]]
                if len(held[0]) > FAN_IN:
                    held = [merged(held[0])]
            if held and len(held[0]):
                yield merged(held[0])

        placed = table.repartition(*by).sortWithinPartitions(*by) if by else table.repartition(1)
        return placed.select(*names).mapInPandas(run, schema)

    table = digests.select(*keys, "n", "total", "nodes", "counts")
    while parts > FAN_IN:
        groups = math.ceil(parts / FAN_IN)
        # Any even split will do; the digest itself decides, so a lost task splits the same.
        spread = F.pmod(F.xxhash64("n", "total", "nodes", "counts", F.lit(parts)), F.lit(groups)).cast("int")
        table = step(table.withColumn("_group", spread), [*keys, "_group"]).drop("_group")
        parts = groups
    return step(table, keys)


def read_quantiles(digests: DataFrame, percents: Sequence[int], unit: float = 1) -> DataFrame:
    """Keys, n, average and per percent pNN_lo, pNN_hi: the interval that holds the percentile.

    The NN-th percentile is the least value such that at least NN % of the
    values are not above it. With ``unit`` 1 the bounds are whole numbers.
    """
    ensure_workers_import(digests.sparkSession)
    fields = [T.StructField(f"p{p}_{end}", T.LongType()) for p in percents for end in ("lo", "hi")]

    @F.pandas_udf(T.StructType(fields))
    def read(n: pd.Series, nodes: pd.Series, counts: pd.Series) -> pd.DataFrame:
        found = np.empty((len(n), 2 * len(percents)), dtype=np.int64)
        for at, (size, x, c) in enumerate(zip(n, nodes, counts, strict=True)):
            leaves = quantile_leaves(np.asarray(x, dtype=np.int64), np.asarray(c, dtype=np.int64), [max(1, -(-p * size // 100)) for p in percents])
            found[at, 0::2] = leaf_bounds(np.array([a for a, _ in leaves]))[0]
            found[at, 1::2] = leaf_bounds(np.array([b for _, b in leaves]))[1]
        return pd.DataFrame(found, columns=[f.name for f in fields])

    keys = [c for c in digests.columns if c not in ("n", "total", "nodes", "counts", "_task")]
    average = (F.col("total") / F.col("n") * F.lit(unit)).alias("average")
    read_out = digests.select(*keys, "n", average, read("n", "nodes", "counts").alias("_q"))
    scaled = [(F.col(f"_q.{f.name}") * F.lit(unit)).alias(f.name) if unit != 1 else F.col(f"_q.{f.name}") for f in fields]
    return read_out.select(*keys, "n", "average", *scaled)
