import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import langid
from fathomline.llm.langid import fit, label_code, label_documents, repair, sentences, stretches
from fathomline.session import read_table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    documents = read_table(spark, FOLDER, "documents").select("doc_id", "text", label_code(F.col("lang")).alias("label"))
    return fit(read_table(spark, FOLDER, "lang_samples"), documents, docs_per_label=40)


def test_labels(spark):
    rows = [("EN",), (" de-AT",), ("pt_BR",), ("Français",), ("日本語",), ("nld",), ("und",), ("",), (None,), ("sv",), ("n/a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(label_code(F.col("l"))).collect()]
    assert got == ["en", "de", "pt", "fr", "ja", "nl", None, None, None, None, None]


def test_sentences_leave_out_what_has_no_language():
    assert sentences('User-agent: *\nDisallow: /q\nX-Cache: joraraeta/0.23\n{"p": "/v6", "s": 200}\nZelivaast (hosted)\nif (window.x) { load(9); }\n12/27/2026 14:10 +118,199,631 B') == []
    assert sentences('<p>The page is empty. ("nicht gefunden")</p><script>var the_page = 1;</script>') == ["the page is empty"]
    assert len(sentences("春のカタログが公開され、144点の新しい商品が並んでいます。次の文です。")) == 2
    assert sentences("") == [] and sentences("   \n") == []


@pytest.mark.parametrize("part", ["a", " ", "\n", "x.", "/", "日", "a(", "\"", "<b", "- ", "1/", "Ã©"])
def test_long_runs_take_linear_time(part):
    began = time.perf_counter()
    found = sentences("The page is empty. " + part * 300_000 + " The page is empty.")
    assert time.perf_counter() - began < 20 and (part in ("日", "a", "x.", "<b", "\"", "Ã©") or found[0] == "the page is empty")


def test_repair():
    assert repair("Esta pÃ¡gina estÃ¡ vazia") == "Esta página está vazia" and repair("déjà vu") == "déjà vu"


def test_hosts_of_all_kinds_are_names():
    for host in ("www.example.com", "shop.example.co.uk", "api.vendor.tld", "https://www.lemonde.fr/politique/une.html?q=le", "mail@firma.de", "docs.python.org:8080"):
        assert sentences(f"{host} {host}. The page of {host} is empty today.") == ["the page of is empty today"], host
    assert sentences("We closed it.Then we left the house.") == ["we closed it then we left the house"]


@pytest.fixture(scope="module")
def unseen(spark):
    """A model from half of the samples and half of the documents, and the other halves, which it never saw."""
    samples = read_table(spark, FOLDER, "lang_samples")
    documents = read_table(spark, FOLDER, "documents").select("doc_id", "text", label_code(F.col("lang")).alias("label"))
    half = lambda c: F.pmod(F.xxhash64(c), F.lit(2)) == 0
    model = fit(samples.where(F.col("sample_no") % 2 == 0), documents.where(half("text")))
    return model, samples.where(F.col("sample_no") % 2 == 1), documents.where(~half("text"))


def test_unseen_samples(unseen):
    model, samples, _ = unseen
    parts = [(r.lang, s) for r in samples.collect() for s in sentences(r.text)]
    predicted = model.logits([s for _, s in parts]).argmax(axis=1)
    assert len(parts) > 20 and np.mean([model.languages[p] == lang for p, (lang, _) in zip(predicted, parts)]) > 0.97


def test_unseen_documents_and_their_confidence(unseen):
    """Accuracy on documents (by text) that took no part, and the mean gap between confidence and accuracy over bins of equal size.

    About one label in twelve is wrong on purpose, so only documents whose label a
    second model agrees with would be certain; the gap is measured on fragments of
    three words, whose language is that of their whole document.
    """
    model, _, documents = unseen
    rows = label_documents(documents.where("label IS NOT NULL"), ["doc_id", "label", "text"], "text", model).where("n_segments = 1").collect()
    right = [r for r in rows if r.lang == r.label]
    assert len(rows) > 200 and len(right) / len(rows) > 0.88 and np.mean([r.confidence for r in right]) > 0.97
    short = [(model.languages.index(r.lang), f) for r in right for x in langid.fragments(sentences(r.text)) for f in x]
    p = langid.softmax(model.logits([f for _, f in short]) / model.temperature)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    hit = best == np.array([x for x, _ in short])
    bins = np.array_split(np.argsort(sure), 10)
    gap = np.mean([abs(sure[b].mean() - hit[b].mean()) for b in bins])
    assert hit.mean() > 0.85 and gap < 0.05, (hit.mean(), gap)


def test_mixed_documents(spark, model):
    text = "The page is empty. We are back on Monday and someone will help you before the evening. Die Seite ist leer. Wir lesen jede Datei nur einmal und melden jede Zeile.\n\nThank you for your order, we hope to see you again soon."
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "   ", "x"), (5, "12345 {}", "x"), (6, "Die Seite ist heute leer. " * 4000, "x"), (7, "THE PAGE IS EMPTY TODAY AND NOBODY KNOWS THE REASON.", "x"), (1, text, "x")], "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.segment_no, r.lang, r.n_segments) for r in label_documents(df, ["doc_id"], "text", model).collect())
    once = [(1, 0, "en", 3), (1, 1, "de", 3), (1, 2, "en", 3)]
    assert got == sorted([*once, *once, (6, 0, "de", 1), (7, 0, "en", 1)])
    assert label_documents(df.limit(0), ["doc_id"], "text", model).count() == 0


def test_a_weak_sentence_follows_its_neighbours():
    strong, weak = [0.0, -9.0], [-1.0, -0.5]
    assert stretches(np.array([strong, weak, strong])) == [(0, 0, 3)]
    assert stretches(np.array([strong, [-9.0, 0.0], strong])) == [(0, 0, 1), (1, 1, 2), (0, 2, 3)]
    assert stretches(np.zeros((0, 2))) == []
    assert langid.softmax(np.zeros((1, 4)))[0, 0] == 0.25
