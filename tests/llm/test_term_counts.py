import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.functions.text import present
from fathomline.llm import term_counts
from fathomline.session import new_path

SCHEMA = "id long, rec string, t string, u string, v long, gone boolean, field string, term string"


def feed(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return term_counts.changes(df, ["id"], ["rec"], "v", {"t": present(F.col("t")), "u": present(F.col("u"))}, deleted=F.col("gone"))


def brute(rows):
    newest = {}
    for r in rows:
        if r[0] not in newest or r[4] > newest[r[0]][4]:
            newest[r[0]] = r
    occurrences, records = Counter(), defaultdict(set)
    for _, rec, t, u, _, gone in newest.values():
        for field, term in (("t", t), ("u", u)):
            term = term.strip(" \t ").lower() if term else term
            if term and not gone:
                occurrences[field, term] += 1
                records[field, term].add(rec)
    return {k: (n, len(records[k])) for k, n in occurrences.items()}


def counts(spark, state):
    return {(r.field, r.term): (r.occurrences, r.records) for r in term_counts.read_counts(spark, state).collect()}


@pytest.mark.parametrize("few, segments", [(500_000, 8), (0, 1)])
def test_batches_equal_a_full_count(spark, monkeypatch, few, segments):
    """Rows that come anew, change, move to other records, are deleted and come back, with and without compaction."""
    monkeypatch.setattr(term_counts, "BROADCAST_KEYS", few)
    monkeypatch.setattr(term_counts, "MOST_SEGMENTS", segments)
    rng = random.Random(4)
    rows = []
    for version in range(3):
        batch = []
        for _ in range(150):
            i = rng.randrange(160)
            batch.append((i, f"r{0 if i % 3 == 0 else rng.randrange(11)}", rng.choice(["A", "a ", "b", None, "", "\tc"]), rng.choice(["x", "y", None]), version * 1000 + len(batch), rng.random() < 0.1))
        rows.append(batch)
    state = term_counts.new_state(spark, new_path(spark, "test-state"), ["t", "u"], buckets=4)
    seen = []
    for batch in rows:
        before = counts(spark, state)
        state, deltas = term_counts.apply_changes(state, feed(spark, batch))
        seen += batch
        assert counts(spark, state) == brute(seen)
        change = Counter()
        for k, (n, _) in counts(spark, state).items():
            change[k] += n
        for k, (n, _) in before.items():
            change[k] -= n
        assert deltas.agg(F.sum("occurrences")).first()[0] == sum(change.values())


def test_redelivery_empty_batch_and_reload(spark):
    rows = [(1, "r1", "a", None, 1, False), (2, "r1", "a", "z", 1, False), (3, "r2", "a", None, 1, False)]
    state, _ = term_counts.apply_changes(term_counts.new_state(spark, new_path(spark, "test-state"), ["t", "u"]), feed(spark, rows))
    again, deltas = term_counts.apply_changes(state, feed(spark, rows[:2]))
    assert deltas.count() == 0 and counts(spark, again) == {("t", "a"): (3, 2), ("u", "z"): (1, 1)}
    nothing, deltas = term_counts.apply_changes(again, feed(spark, []))
    assert deltas.count() == 0 and counts(spark, nothing) == counts(spark, again)
    loaded = term_counts.load_state(spark, term_counts.save_state(spark, nothing))
    assert loaded == nothing
    gone, _ = term_counts.apply_changes(loaded, feed(spark, [(2, "r1", "a", "z", 2, True)]))
    assert counts(spark, gone) == {("t", "a"): (2, 2)}
    stale, deltas = term_counts.apply_changes(gone, feed(spark, [(1, "r1", "old", None, 0, False)]))
    assert deltas.count() == 0 and counts(spark, stale) == counts(spark, gone)


def folders(log):
    return {f for segments in log for f in segments}


def test_cost_of_a_small_batch(spark):
    """A batch of ten records writes what it changes, reads the buckets it names and leaves the state's segments as they are."""
    rows = [(i, f"r{i % 700}", f"t{i % 90}", None, 1, False) for i in range(4000)]
    state, _ = term_counts.apply_changes(term_counts.new_state(spark, new_path(spark, "test-state"), ["t", "u"], buckets=64), feed(spark, rows))
    batch = [(i, f"r{i % 700}", "fresh", None, 2, False) for i in range(10)]
    after, deltas = term_counts.apply_changes(state, feed(spark, batch))
    assert sum(r.occurrences for r in deltas.where("occurrences > 0").collect()) == 10 and sum(r.occurrences for r in deltas.collect()) == 0
    for name in ("images", "postings", "counts"):
        old, new = folders(getattr(state, name)), folders(getattr(after, name))
        assert old < new and len(new - old) <= 20
        assert spark.read.parquet(*(new - old)).count() <= 20
    part = term_counts._own_part(spark, term_counts._image_schema(2), state.images, feed(spark, batch).select("row", "row_b"), ("row", "row_b"))
    assert part.count() == 10 and len(part.inputFiles()) <= 10 < len(folders(state.images))
    want = brute(rows + batch)
    assert counts(spark, after) == want
    small = term_counts.compact(spark, after, most=1)
    assert counts(spark, small) == want and all(len(s) <= 1 for log in (small.images, small.postings, small.counts) for s in log)
    again, _ = term_counts.apply_changes(small, feed(spark, [(0, "r5", "fresh", None, 3, False)]))
    assert counts(spark, again) == brute(rows + batch + [(0, "r5", "fresh", None, 3, False)])
    term_counts.drop_state(spark, after, kept=small)
    assert counts(spark, small) == want


def test_one_state_of_two_tables(spark):
    left = term_counts.changes(spark.createDataFrame([(1, "r", "a", 1)], "id long, rec string, t string, v long"), ["id"], ["rec"], "v", {"t": F.col("t"), "u": F.lit(None).cast("string")})
    right = term_counts.changes(spark.createDataFrame([(1, "r", "a", 1)], "id long, rec string, u string, v long"), ["id"], ["rec"], "v", {"t": F.lit(None), "u": F.col("u")}, space=1)
    state, _ = term_counts.apply_changes(term_counts.new_state(spark, new_path(spark, "test-state"), ["t", "u"]), left.unionByName(right))
    assert counts(spark, state) == {("t", "a"): (1, 1), ("u", "a"): (1, 1)}


def test_marks(spark):
    df = spark.createDataFrame([("t", "a", 9, 2), ("t", "b", 9, 3), ("t", "c", 9, 5), ("t", "d", 90, 6)], "field string, term string, occurrences long, records long")
    assert {r.term: r.mark for r in term_counts.mark_terms(df, 20).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}
