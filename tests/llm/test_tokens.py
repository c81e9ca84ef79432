import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm.tokens import BYTE_BPE, VOCABULARIES, encode_corpus, load

PATH = f"{VOCABULARIES}/{BYTE_BPE}"


@pytest.fixture(scope="module")
def bpe():
    return load(PATH)


def cut_and_assemble(bpe, text, part, piece):
    return bpe.assemble([(s, bpe.encode_part(s, p)) for s, p in bpe.parts(text, part, piece)])


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.sampled_from("ab e'sltrév5 1!?\n\t  日本語ы<|>endoftx​\U0001f600"), max_size=200), st.integers(1, 30), st.integers(2, 9))
def test_any_cut_gives_the_ids_of_the_whole(text, part, piece):
    bpe = load(PATH)
    assert cut_and_assemble(bpe, text, part, piece) == bpe.leaf(text)


@settings(deadline=None, max_examples=600)
@given(st.text(alphabet=st.sampled_from("ab e'slltrév5 1!?+\n\t  日本語。ы<|>'ve\u200b\U0001f600́"), max_size=300), st.integers(1, 20), st.integers(1, 80))
def test_tree_gives_the_ids_of_the_whole(text, leaf, most):
    bpe = load(PATH)
    assert bpe.encode(text, leaf, most) == bpe.leaf(text)


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=200), st.integers(1, 20))
def test_tree_of_any_text(text, leaf):
    bpe = load(PATH)
    assert bpe.encode(text, leaf) == bpe.leaf(text)


def test_every_text_of_the_corpus_through_the_tree(spark, bpe):
    """The registered query, the tree with tiny leaves and the spread parts give the ids that the library gives."""
    from fathomline.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: bpe.leaf(t or "") for i, t in texts.items()}
    assert {r.doc_id: r.ids for r in queries.p7_ids(spark, folder).collect()} == want
    assert {i: bpe.encode(t or "", leaf=8) for i, t in texts.items()} == want
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id: r.ids for r in encode_corpus(documents, ["doc_id"], "text", long_bytes=64).collect()} == want


@pytest.mark.parametrize("sign", ["\n", " ", "a", "-", "日"])
def test_runs_of_one_sign(spark, bpe, sign):
    """Runs on which the library itself fails as a whole: the ids are those of the run's bytes."""
    text = "x" + sign * 1_000_000 + "y"
    ids = bpe.encode(text)
    assert b"".join(bpe.spelling[x] for x in ids) == text.encode()
    short = "x" + sign * 40_000 + "y"
    assert bpe.encode(short) == bpe.leaf(short)
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert encode_corpus(df, ["doc_id"], "text").first().ids == ids == encode_corpus(df, ["doc_id"], "text", long_bytes=1 << 30).first().ids


@settings(deadline=None, max_examples=150)
@given(st.text(min_size=1, max_size=120), st.integers(0, 120))
def test_join_of_halves(text, at):
    bpe = load(PATH)
    raw = text.encode()
    assert bpe.join(bpe.piece(raw[:at]), bpe.piece(raw[at:])) == bpe.piece(raw)


def test_same_ids_as_the_other_library(bpe):
    import base64  # noqa: F401
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in ("Hello  world\n\n it's", "日本語テキスト 123", "<|endoftext|>", "a\t\t b   ", "Ünïcödé’s"):
        assert bpe.leaf(text) == other.encode(text, add_special_tokens=False).ids


def test_long_unsplit_texts(bpe):
    rng = random.Random(5)
    for text in ("a" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(40_000)), " " * 40_000 + "x", "日本語" * 9_000, "x" + "\n" * 30_000 + "y"):
        assert cut_and_assemble(bpe, text, 1 << 12, 1 << 10) == bpe.leaf(text) == bpe.encode(text)


def test_corpus(spark, bpe):
    texts = [None, "", "   ", "plain text", "word " * 3000 + "z" * 30_000, "<|endoftext|>", "plain text"]
    df = spark.createDataFrame([(i % 6, t, [1], "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, _other string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df, ["doc_id"], "text", long_bytes=10_000).collect())
    assert got == sorted((i % 6, bpe.leaf(t or "")) for i, t in enumerate(texts))
    counted = sorted((r.doc_id, r.n_tokens) for r in encode_corpus(df, ["doc_id"], "text", count_only=True, long_bytes=10_000).collect())
    assert counted == sorted((i % 6, len(bpe.leaf(t or ""))) for i, t in enumerate(texts))
    assert encode_corpus(df.limit(0), ["doc_id"], "text").count() == 0


def test_white_space_before_a_long_stretch(spark, bpe):
    texts = [f"abc{space}{'z' * 20_000}{space}end" for space in ("\n\n", "\t\t", "\n \n", " \n", "\r\n\r\n", "\n\n ", "  ", "\x1c\n\n")] + ["\n\n" + "z" * 20_000, "z" * 20_000 + "\n\n" + "7" * 20_000 + "\n\n"]
    for text in texts:
        assert cut_and_assemble(bpe, text, 1 << 18, 1 << 14) == bpe.leaf(text) == bpe.encode(text)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, ["doc_id"], "text", long_bytes=10_000).collect()}
    assert got == {i: bpe.leaf(t) for i, t in enumerate(texts)}
