"""Every registered query of the subpackage runs on the smallest tables and, where there is SQL, equals it."""

from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from fathomline.llm import langid, queries, tokens

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def normal(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, tables, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = tables.execute(queries.ORACLE_SQL[name])
    given = [d[0] for d in result.description]
    assert sorted(given) == columns
    order = sorted(range(len(given)), key=lambda i: given[i])
    assert normal([row[c] for c in columns] for row in df.collect()) == normal([row[i] for i in order] for row in result.fetchall())


def test_mix_keeps_shares_and_caps(spark, tables):
    """The mix against the tables: sizes counted by the library, every document at most as often as allowed, totals as planned."""
    bpe = tokens.load(f"{tokens.VOCABULARIES}/{tokens.BYTE_BPE}")
    clean = lambda s: (s or "").strip(" \t ").lower()
    documents = {i: (clean(s), len(bpe.leaf(t or ""))) for i, s, t in tables.execute("SELECT doc_id, source, text FROM documents").fetchall()}
    targets = {clean(s): (share, most) for s, share, most in tables.execute("SELECT source, target_share, max_repeats FROM source_targets").fetchall()}
    used = {r.doc_id: r for r in queries.QUERIES["p8_mix"](spark, FOLDER).collect()}
    mixed = Counter()
    for i, r in used.items():
        assert documents[i] == (r.source, r.n_tokens) and 1 <= r.copies <= targets[r.source][1]
        mixed[r.source] += r.copies * r.n_tokens
    held = defaultdict(int)
    for s, n in documents.values():
        if s in targets:
            held[s] += n
    total = sum(held.values())
    largest = max(n for _, n in documents.values())
    shares = {r.source: r for r in queries.QUERIES["p8_shares"](spark, FOLDER).collect()}
    assert set(shares) == set(targets)
    for s, (share, most) in targets.items():
        short = held[s] * most < share * total
        assert shares[s].falls_short == short and shares[s].mixed_tokens == mixed[s] and shares[s].tokens == held[s]
        assert mixed[s] == held[s] * most if short else abs(mixed[s] - share * total) <= largest
    assert {r.source for r in queries.QUERIES["p8_found"](spark, FOLDER).collect()} == {s for s, (share, most) in targets.items() if held[s] * most < share * total}


def test_languages_of_labelled_documents(spark, tables):
    """Most labels are right, so documents that are found wrong are few, and segments are numbered without gaps."""
    rows = queries.QUERIES["p9_segments"](spark, FOLDER).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(sorted(r.segment_no for r in x) == list(range(len(x))) and x[0].n_segments == len(x) for x in by.values())
    assert {r.lang for r in rows} <= set(langid.LABEL_FORMS)
    single = [x[0] for x in by.values() if len(x) == 1 and x[0].label]
    assert sum(r.lang == r.label for r in single) > 0.85 * len(single)
    found = {(r.doc_id, r.segment_no, r.lang) for r in queries.QUERIES["p9_found"](spark, FOLDER).collect()}
    assert found == {(r.doc_id, r.segment_no, r.lang) for r in rows if r.n_segments > 1 or r.label is None or r.label != r.lang}
