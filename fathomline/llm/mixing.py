"""Mixing sources to target shares of the total size.

Each source gets the share ``target_share`` of all tokens. Its documents are
taken ``floor(r)`` times each, where r is the target over the source's tokens,
and the remaining fraction is an inclusion probability that is drawn by the cube
method: the flight phase moves the probabilities through the null space of the
constraints (number of documents, number of tokens) until all but two documents
of a block are in or out, so both totals stay exactly where they were. What is
left of the blocks is put into blocks again; the last block's two documents are
the landing problem, solved by the closest of the four outcomes. A source whose
capacity (tokens times ``max_repeats``) is below its target gives every document
``max_repeats`` times and falls short.

Scale: one narrow table of (document, source, tokens) is written; blocks hold at
most ``BLOCK_DOCS`` documents on average however large a source is, and each
level leaves at most two documents per block, so the levels shrink by 10,000.
All draws are seeded by source, block and document id: a lost task redraws the
same.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import ensure_workers_import, materialize

BLOCK_DOCS = 20_000
BALANCED = 2
_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities until at most ``BALANCED`` lie strictly between 0 and 1.

    Keeps sum(p) and sum(p * size) of the start, up to rounding of floats.
    """
    p = p.astype(float).tolist()
    z = size.astype(float).tolist()
    coin = iter(rng.random(len(p) + 8).tolist())
    active: list[int] = []
    for unit in range(len(p)):
        if _EPS < p[unit] < 1 - _EPS:
            active.append(unit)
        while len(active) == BALANCED + 1:
            a, b, c = active
            # The null space of [[1, 1, 1], [za, zb, zc]].
            u = (z[c] - z[b], z[a] - z[c], z[b] - z[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(active, u, strict=True) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(active, u, strict=True) if d)
            step = up if next(coin) * (up + down) < down else -down
            for k, d in zip(active, u, strict=True):
                p[k] += step * d
                if p[k] < _EPS:
                    p[k] = 0.0
                elif p[k] > 1 - _EPS:
                    p[k] = 1.0
            active = [k for k in active if 0 < p[k] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last documents: of all outcomes the one nearest in tokens, then in documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    want_size, want_docs = float((p[left] * size[left]).sum()), float(p[left].sum())
    best = None
    for outcome in range(1 << len(left)):
        bits = np.array([outcome >> k & 1 for k in range(len(left))])
        off = (abs(float((bits * size[left]).sum()) - want_size), abs(bits.sum() - want_docs), outcome)
        if best is None or off < best[0]:
            best = (off, bits)
    p = p.copy()
    p[left] = best[1]
    return p


def plan_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: docs, tokens, target and how often each document is taken.

    sizes: doc_id, source, n_tokens. The total is over all sources in targets.
    """
    held = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    plan = targets.join(held, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    total = plan.agg(F.sum("tokens").alias("total_tokens"))
    plan = plan.join(F.broadcast(total)).withColumn("target_tokens", F.col("target_share") * F.col("total_tokens")).withColumn("capacity_tokens", F.col("tokens") * F.col("max_repeats"))
    short = F.col("capacity_tokens") < F.col("target_tokens")
    ratio = F.when(short | (F.col("tokens") == 0), F.col("max_repeats").cast("double")).otherwise(F.least(F.col("target_tokens") / F.col("tokens"), F.col("max_repeats").cast("double")))
    return plan.withColumn("falls_short", short).withColumn("whole_copies", F.floor(ratio).cast("int")).withColumn("fraction", ratio - F.floor(ratio)).withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS))


def mix_sources(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies >= 1) and the report per source.

    sizes: doc_id, source, n_tokens (one row per document); targets: source,
    target_share, max_repeats. Sources are compared as they stand.

    Report: source, target_share, target_tokens, max_repeats, n_docs, tokens,
    capacity_tokens, mixed_docs, mixed_tokens, actual_share, falls_short.

    Defined cases: a document without source or of a source without target is
    not taken; a source without documents falls short if its target is above 0;
    documents without tokens are drawn like others; repeated documents are drawn
    one by one; a null id counts as -1 and a null size as 0; empty tables give an empty mix.
    """
    spark = sizes.sparkSession
    ensure_workers_import(spark)
    sizes, _, _ = materialize(sizes.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).where("source IS NOT NULL"), "sizes")
    plan, _, _ = materialize(plan_sources(sizes, targets), "plan")
    planned = sizes.join(plan.select("source", "whole_copies", "fraction", "n_blocks"), "source")
    fixed = planned.where(F.col("fraction") <= _EPS).select("doc_id", "source", "n_tokens", F.col("whole_copies").alias("copies"))
    open_docs = planned.where(F.col("fraction") > _EPS).select("doc_id", "source", "n_tokens", "whole_copies", F.col("fraction").alias("p"), "n_blocks")

    def draw(last: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.assign(_order=pd.util.hash_array(frame["doc_id"].to_numpy(np.int64))).sort_values(["_order", "doc_id", "n_tokens", "p"], kind="stable")
            start = int(pd.util.hash_array(np.array([f"{seed}/{frame['source'].iloc[0]}/{frame['_block'].iloc[0]}"], dtype=object))[0])
            p = flight(frame["p"].to_numpy(), frame["n_tokens"].to_numpy(), np.random.default_rng(start))
            if last:
                p = landing(p, frame["n_tokens"].to_numpy())
            return frame.assign(p=p)[["doc_id", "source", "n_tokens", "whole_copies", "p", "n_blocks"]]

        return run

    schema = "doc_id long, source string, n_tokens long, whole_copies int, p double, n_blocks long"
    decided = [fixed]
    level, most = 0, plan.agg(F.max("n_blocks")).first()[0] or 0
    current = open_docs
    while most:
        last = most == 1
        block = F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.greatest("n_blocks", F.lit(1)))
        drawn, _, _ = materialize(current.withColumn("_block", block).groupBy("source", "_block").applyInPandas(draw(last), schema), "drawn")
        done = drawn if last else drawn.where("p = 0 OR p = 1")
        decided.append(done.select("doc_id", "source", "n_tokens", (F.col("whole_copies") + F.col("p").cast("int")).alias("copies")))
        if last:
            break
        # At most two documents of each block go on.
        current = drawn.where("p > 0 AND p < 1").withColumn("n_blocks", F.ceil(F.col("n_blocks") * BALANCED / BLOCK_DOCS).cast("long"))
        most = -(-most * BALANCED // BLOCK_DOCS)
        level += 1
    mix = reduce(DataFrame.unionByName, decided).where("copies > 0")
    mixed = mix.groupBy("source").agg(F.sum("copies").alias("mixed_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = plan.join(mixed, "source", "left").select("source", "target_share", "target_tokens", "max_repeats", "n_docs", "tokens", "capacity_tokens", zero("mixed_docs"), zero("mixed_tokens"), "falls_short")
    whole = report.agg(F.sum("mixed_tokens").alias("_whole"))
    report = report.join(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("_whole") > 0, F.col("mixed_tokens") / F.col("_whole"))).drop("_whole")
    return mix, report
