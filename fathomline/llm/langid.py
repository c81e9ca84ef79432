"""Languages of documents and of the stretches of mixed documents.

Model: sparse multinomial logistic regression on TF-IDF weighted character
n-grams (1 to 4, hashed; of other scripts also the block of each sign), trained by follow-the-regularised-leader with an
elastic-net penalty (L1 makes it sparse), with the temperature of its
probabilities calibrated on held-out sentences.

Training: correctly labelled sample sentences first; then sentences of a
bounded sample of labelled documents (``docs_per_label``), of which only those
count whose label the model so far confirms, so wrong labels drop out. The
sample is drawn by a hash of the document id. Only this sample is bounded;
every document is labelled.

Documents: a text is cut into sentences; names, numbers, code, markup,
directives and short quoted phrases are taken out of them; the most likely
sequence of languages is found with a cost for every change, so a weak sentence
follows its neighbours. A stretch is a longest run of sentences of one language.

Scale: labelling is a narrow map over Arrow batches with the model (some MB,
size fixed by ``HASH_BITS`` and the number of languages) as a broadcast value.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import ensure_workers_import

HASH_BITS = 18
MAX_N = 4
CHANGE_COST = 4.0
BATCH_CHARS = 400_000
#: Longer documents are labelled like all others, but take no part in the training sample.
SAMPLE_CHARS = 20_000

#: Other forms of language labels, by two-letter code.
LABEL_FORMS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "it": ("ita", "italian", "italiano"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "ro": ("ron", "rum", "romanian", "română", "romana"),
    "pl": ("pol", "polish", "polski"),
    "ru": ("rus", "russian", "русский"),
    "ja": ("jpn", "japanese", "日本語"),
}


def label_code(label: Column) -> Column:
    """The two-letter code of a label in any form; null for missing, placeholder and foreign labels."""
    table = {form: code for code, forms in LABEL_FORMS.items() for form in (code, *forms)}
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    plain = F.lower(F.btrim(label, F.lit(" \t\r\n ")))
    return F.coalesce(F.try_element_at(lookup, plain), F.try_element_at(lookup, F.element_at(F.split(plain, "[-_ ]"), 1)))


# --- sentences -------------------------------------------------------------------

_BLOCK = re.compile(r"<(script|style|pre|code)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,2000}>")
_END = re.compile(r"(?<=[.!?…])[\"'”“»)\]]*\s+|(?<=[。！？])|[\r\n]+|\s+-{3,}\s+")
_QUOTED = re.compile(r"[(\[]?(?:\"[^\"\n]{1,60}\"|“[^”\n]{1,60}”|„[^“”\n]{1,60}[“”]|«[^»\n]{1,60}»|「[^」\n]{1,40}」|『[^』\n]{1,40}』)[)\]]?")
_CODE = re.compile(
    r"\{[^{}\n]{0,2000}\}|(?<![\w-])(?:if|for|while)\s*\([^()\n]{0,200}\)|[\w.$]{1,80}\([^()\n]{0,200}\);?|(?<!\S)/\S+/[a-z]*(?!\S)"
    r"|\b(?:GET|POST|HEAD|PUT)\s+/\S*(?:\s+[\d.]+(?:\s*[kMG]?B\b)?)*|\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\s+[\d:]+(?:\s+[+\d,.]+\s*[kMG]?B\b)?"
    r"|(?<!\S)[A-Za-z][\w-]*:\s+\S*[/\d]\S*(?:\s*;\s*\w+=\S+)?|\bsha\d+:[0-9a-f]+",
    re.I,
)
#: Runs without a blank that are longer than any word, and blanks that repeat; both go first, so that no pattern runs over them again and again.
_LONG_RUN = re.compile(r"[!-~À-ɏ]{160,}")
_BLANKS = re.compile(r"[^\S\r\n]{2,}")
_SIGNS = re.compile(r"[{}<>\\|=]")
#: Host names and addresses by their form (labels joined by dots, the last of letters), words with digits or signs of paths, compound names, file names.
_NEUTRAL = re.compile(r"(?<![!-~])[!-~]*(?<![A-Za-z0-9-])[a-z0-9-]{2,}(?:\.[a-z0-9-]{2,})*\.[a-z]{2,24}(?![A-Za-z0-9.-]*[A-Z])(?![a-z0-9-])[!-~]*|[!-~À-ɏ]*[0-9_/\\@][!-~À-ɏ]*|\b[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)+\b|[!-~À-ɏ]+\.(?:js|io|css|html|png)\b")
_WORD = re.compile(r"[^\W\d_]+")
_JAPANESE = re.compile(r"[぀-ヿ一-鿿]")
_MOJIBAKE = re.compile(r"[ÃÂÄÅÐÑãÈâ][\u0080-¿Œ-™]")
_LATIN_BYTES = {bytes([b]).decode("cp1252"): b for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {chr(b): b for b in range(256)}


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte encoding, where that gives valid text."""
    if not _MOJIBAKE.search(text):
        return text
    try:
        return bytes([_LATIN_BYTES[c] for c in text]).decode()
    except (KeyError, UnicodeDecodeError):
        pass

    def one(found: re.Match) -> str:
        try:
            return bytes([_LATIN_BYTES[c] for c in found.group()]).decode()
        except (KeyError, UnicodeDecodeError):
            return found.group()

    return re.sub(r"(?:[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-™]{1,3})+", one, text)


def sentences(text: str) -> list[str]:
    """The words of each sentence that can have a language; sentences without any are left out."""
    text = _BLANKS.sub(" ", _LONG_RUN.sub(" ", repair(_TAG.sub("\n", _BLOCK.sub("\n", text)))))
    found = []
    for raw in _END.split(text):
        if not raw or raw.isspace():
            continue
        plain = _QUOTED.sub(" ", _CODE.sub(" ", raw))
        if len(_SIGNS.findall(plain)) > 1:
            continue
        plain = unicodedata.normalize("NFKC", _NEUTRAL.sub(" ", plain))
        words = _WORD.findall(plain)
        ended = raw.rstrip("\"'”“»)]」』 ")[-1:] in set(".!?…。！？")
        if _JAPANESE.search(plain):
            if len(_JAPANESE.findall(plain)) < 3:
                continue
        elif len(words) < (2 if ended else 4) or sum(map(len, words)) < 7:
            continue
        found.append(" ".join(words).lower())
    return found


def fragments(texts: list[str], size: int = 3) -> list[list[str]]:
    """Runs of ``size`` words (of as many signs for Japanese) of each sentence: hard cases to calibrate on."""
    out = []
    for t in texts:
        units = list(t.replace(" ", "")) if _JAPANESE.search(t) else t.split()
        glue = "" if _JAPANESE.search(t) else " "
        out.append([glue.join(units[i : i + size]) for i in range(0, max(1, len(units) - size + 1), size)])
    return out


def blurred(texts: list[str], rng: np.random.Generator) -> list[str]:
    """The sentences as careless typists write them: no diacritics, two letters swapped or one left out."""
    out = []
    for t in texts:
        plain = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
        plain = unicodedata.normalize("NFC", t if _JAPANESE.search(t) or "а" <= t[:1] <= "я" else plain.replace("ł", "l").replace("ß", "ss"))
        for _ in range(len(plain) // 40):
            at = int(rng.integers(0, max(1, len(plain) - 1)))
            plain = plain[:at] + plain[at + 1 : at + 2] + plain[at : at + 1] * int(rng.random() < 0.6) + plain[at + 2 :]
        out.append(plain)
    return out


# --- features and model -----------------------------------------------------------


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after another, and where each text starts."""
    joined = " " + "  ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) + 2 for t in texts])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    owner = np.repeat(np.arange(len(texts)), lengths)
    space = points == 32
    codes, owners = [], []
    rolling = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        rolling = rolling[:size] * np.uint64(0x9E3779B1) + points[n - 1 :] + np.uint64(n)
        inside = owner[:size] == owner[n - 1 :]
        if n == 1:
            inside = ~space
        mixed = rolling * np.uint64(0xD6E8FEB86659FD93)
        codes.append((mixed >> np.uint64(64 - HASH_BITS))[inside].astype(np.int32))
        owners.append(owner[:size][inside])
    # Signs beyond the Latin scripts also count as members of their block of 256: a rare sign still shows its script.
    far = points >= 0x250
    codes.append(((((points[far] >> np.uint64(8)) + np.uint64(1 << 24)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    owners.append(owner[far])
    code, who = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    del starts
    return code[order], np.searchsorted(who[order], np.arange(len(texts)))


@dataclass
class Model:
    """languages, idf per n-gram, weights per n-gram and language, bias, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """Scores of each language, before calibration."""
        if not texts:
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        out = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) < BATCH_CHARS // 4):
                size += len(texts[end])
                end += 1
            code, first = grams(texts[start:end])
            idf = self.idf[code]
            norm = np.sqrt(np.add.reduceat(idf * idf, first))
            sums = np.add.reduceat(self.scaled[code], first, axis=0)
            out.append(sums / norm[:, None] + self.bias)
            start = end
        return np.concatenate(out)

    @property
    def scaled(self) -> np.ndarray:
        if not hasattr(self, "_scaled"):
            self._scaled = (self.weights * self.idf[:, None]).astype(np.float32)
        return self._scaled

    def packed(self) -> dict:
        """Sparse form for the broadcast."""
        rows = np.flatnonzero(self.weights.any(axis=1))
        return {"languages": self.languages, "idf": self.idf.astype(np.float32), "rows": rows.astype(np.int32), "weights": self.weights[rows].astype(np.float32), "bias": self.bias, "temperature": self.temperature}

    @staticmethod
    def unpack(packed: dict) -> Model:
        weights = np.zeros((1 << HASH_BITS, len(packed["languages"])), dtype=np.float32)
        weights[packed["rows"]] = packed["weights"]
        return Model(packed["languages"], packed["idf"], weights, packed["bias"], packed["temperature"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, languages: list[str], epochs: int = 2, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, batch: int = 64, seed: int = 3) -> Model:
    """FTRL-proximal with an elastic net on mini-batches; the same input gives the same model."""
    n_languages, size = len(languages), 1 << HASH_BITS
    code, first = grams(texts)
    ends = np.r_[first[1:], len(code)]
    who = np.repeat(np.arange(len(texts)), ends - first)
    pairs = np.unique(who.astype(np.int64) << HASH_BITS | code)
    df = np.bincount(pairs & (size - 1), minlength=size)
    idf = (np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32)
    z = np.zeros((size, n_languages), dtype=np.float32)
    n = np.zeros((size, n_languages), dtype=np.float32)
    bias = np.zeros(n_languages, dtype=np.float32)
    rng = np.random.default_rng(seed)

    def weight(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)).astype(np.float32)

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(texts), batch):
            chosen = order[start : start + batch]
            spans = [np.arange(first[i], ends[i]) for i in chosen]
            sizes = np.array([len(s) for s in spans])
            x = code[np.concatenate(spans)]
            value = idf[x]
            offsets = np.r_[0, np.cumsum(sizes)[:-1]]
            value = value / np.repeat(np.sqrt(np.add.reduceat(value * value, offsets)), sizes)
            rows, at = np.unique(x, return_inverse=True)
            w = weight(z[rows], n[rows])
            scores = np.add.reduceat(w[at] * value[:, None], offsets, axis=0) + bias
            error = softmax(scores)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            by_row = np.argsort(at, kind="stable")
            row_first = np.searchsorted(at[by_row], np.arange(len(rows)))
            gradient = np.add.reduceat((np.repeat(error, sizes, axis=0) * value[:, None])[by_row], row_first, axis=0).astype(np.float32)
            grown = n[rows] + gradient * gradient
            z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n[rows])) / alpha * w
            n[rows] = grown
            bias -= 0.05 * error.mean(axis=0).astype(np.float32)
    return Model(languages, idf, weight(z, n), bias)


def calibrate(model: Model, texts: list[str], labels: np.ndarray) -> float:
    """The temperature that gives the held-out labels the highest likelihood."""
    scores = model.logits(texts)
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 80))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _confirmed(model: Model, every: list[str], pool: list[tuple[int, int, bool, list[str]]]) -> np.ndarray:
    """Sentences of documents that the model sees in one language, the one of their label."""
    scores = model.logits(every)
    scores = scores - np.logaddexp.reduce(scores, axis=1, keepdims=True)
    out, at = np.zeros(len(every), dtype=bool), 0
    for label, size, _, _ in pool:
        runs = stretches(scores[at : at + size], 2.0)
        out[at : at + size] = len(runs) == 1 and runs[0][0] == label
        at += size
    return out


def fit(samples: DataFrame, documents: DataFrame, docs_per_label: int = 250, seed: int = 11) -> Model:
    """Train on ``samples`` (lang, text; right) and a bounded sample of ``documents`` (doc_id, text, label).

    label: two-letter code or null. Of each label at most ``docs_per_label``
    documents are taken, with their whole texts, among those of up to
    ``SAMPLE_CHARS`` characters; what reaches the driver is bounded by both.
    """
    right = samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").collect()
    languages = sorted({r.lang for r in right})
    number = {x: i for i, x in enumerate(languages)}
    texts, labels = [], []
    for r in sorted(right, key=lambda r: (r.lang, r.text)):
        for s in sentences(r.text):
            texts.append(s)
            labels.append(number[r.lang])
    rng = np.random.default_rng(seed)
    texts += blurred(texts, rng)
    labels += labels
    first = train(texts, np.array(labels), languages, epochs=20, batch=16)
    known = documents.where(F.col("label").isin(languages) & F.length("text").between(1, SAMPLE_CHARS))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return first
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*[F.lit(x) for label, n in sorted(counts.items()) for x in (label, min(1.0, 1.5 * docs_per_label / n))])
    drawn = known.where(draw < F.element_at(share, F.col("label"))).select("doc_id", "label", "text", draw.alias("draw"))
    taken: dict[str, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.draw, r.doc_id)):
        if len(taken.setdefault(r.label, [])) < docs_per_label:
            taken[r.label].append(r)
    pool: list[tuple[int, int, bool, list[str]]] = []
    for label in sorted(taken):
        for at, r in enumerate(taken[label]):
            if found := sentences(r.text):
                pool.append((number[label], len(found), at % 5 == 0, found))
    if not pool:
        return first
    every = [t for *_, found in pool for t in found]
    label_of = np.repeat([p[0] for p in pool], [p[1] for p in pool])
    held = np.repeat([p[2] for p in pool], [p[1] for p in pool])
    model = first
    for _ in range(2):
        agreed = _confirmed(model, every, pool)
        clean = list(dict.fromkeys((every[i], int(label_of[i])) for i in np.flatnonzero(agreed & ~held)))
        more = [t for t, _ in clean]
        more_labels = np.array([x for _, x in clean], dtype=np.int64)
        model = train([*texts, *more, *blurred(more, rng)], np.r_[np.array(labels), more_labels, more_labels], languages)
    check = np.flatnonzero(_confirmed(model, every, pool) & held)
    if len(check):
        # Whole sentences are hardly ever mistaken, so the probabilities are calibrated on fragments of them.
        short = fragments([every[i] for i in check])
        model.temperature = calibrate(model, [f for x in short for f in x], np.repeat(label_of[check], [len(x) for x in short]))
    return model


# --- documents --------------------------------------------------------------------


def stretches(scores: np.ndarray, change_cost: float = CHANGE_COST) -> list[tuple[int, int, int]]:
    """(language, first sentence, end) of the most likely sequence with a cost per change."""
    if not len(scores):
        return []
    best = scores[0].astype(float)
    back = np.zeros(scores.shape, dtype=np.int32)
    for i in range(1, len(scores)):
        top = int(best.argmax())
        switch = best[top] - change_cost
        stay = best >= switch
        back[i] = np.where(stay, np.arange(scores.shape[1]), top)
        best = np.where(stay, best, switch) + scores[i]
    path = [int(best.argmax())]
    for i in range(len(scores) - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    out, start = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[start]:
            out.append((path[start], start, i))
            start = i
    return out


def label_documents(df: DataFrame, keys: list[str], text: Column | str, model: Model, change_cost: float = CHANGE_COST) -> DataFrame:
    """keys, segment_no, n_segments, lang, confidence: one row per stretch of every document.

    Defined cases: null, empty and blank texts and texts without any sentence
    that can have a language give no rows. A sentence can have one if it holds
    at least two words and seven letters (four words where it does not end in a
    full stop; three signs in Japanese) beside names, numbers, code and quotes:
    shorter pieces are headings, names and commands as often as not, and a text
    of only those has no language to be right or wrong about. Repeated rows give
    repeated results; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ensure_workers_import(spark)
    shared = spark.sparkContext.broadcast(model.packed())
    column = F.col(text) if isinstance(text, str) else text
    slim = df.select(*keys, column.alias("_text")).where(F.col("_text").isNotNull())
    types = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpack(shared.value)
        for batch in batches:
            all_sentences, sizes = [], []
            for t in batch.column("_text").to_pylist():
                found = sentences(t)
                all_sentences += found
                sizes.append(len(found))
            scores = own.logits(all_sentences) / own.temperature
            scores = scores - np.logaddexp.reduce(scores, axis=1, keepdims=True) if len(scores) else scores
            rows, numbers, totals, languages, confidences = [], [], [], [], []
            at = 0
            for row, size in enumerate(sizes):
                part = np.maximum(scores[at : at + size], -12.0)
                at += size
                runs = stretches(part, change_cost)
                for number, (language, start, end) in enumerate(runs):
                    mean = part[start:end].sum(axis=0) / np.sqrt(end - start)
                    p = np.exp(mean - np.logaddexp.reduce(mean))
                    rows.append(row)
                    numbers.append(number)
                    totals.append(len(runs))
                    languages.append(own.languages[language])
                    confidences.append(float(p[language]))
            picked = batch.select(keys).take(pa.array(rows, pa.int64()))
            extra = [pa.array(numbers, pa.int32()), pa.array(totals, pa.int32()), pa.array(languages, pa.string()), pa.array(confidences, pa.float64())]
            yield pa.RecordBatch.from_arrays([*picked.columns, *extra], names=[*keys, "segment_no", "n_segments", "lang", "confidence"])

    return slim.mapInArrow(run, f"{types}, segment_no int, n_segments int, lang string, confidence double")
