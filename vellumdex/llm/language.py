"""The language of documents and of the paragraphs of mixed ones, whatever their labels say.

A word is the average of its hashed subwords' vectors, a text the average of its words, a linear softmax tells
the language; both are trained together by stochastic gradient descent in numpy. Confidence is calibrated on
held-out texts, and texts as unsure as words of shuffled letters are rejected: they have no language. The shorter a
text, the surer the model must be.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumdex.llm.encode import in_parts, texts_of
from vellumdex.llm.labelled import fitted_once, labelled_sample
from vellumdex.llm.language_text import paragraphs_of, words_of

BUCKET_BITS = 16
SUBWORD_BUCKETS = 1 << BUCKET_BITS
WHOLE_BASE, SUBWORD_BASE = np.uint64(0x100000001B3), np.uint64(0x10FFFF)
DIMENSIONS = 24
SUBWORDS = (2, 3, 4)
#: Bounds of training: labelled documents of each language, characters of one, and reference texts.
TRAINING_DOCUMENTS, TRAINING_CHARS, REFERENCE_TEXTS = 150, 20_000, 5000
CACHED_WORDS = 300_000
#: Numbers of words for which confidence, and the least of it, is calibrated: each holds up to the next.
SIZES = (1, 2, 3, 6)
#: Paragraphs from so many words on can teach words that the first model doesn't know.
CLEAR_WORDS = 12
#: A confidence above this is never rejected.
MOST_REJECTED = 0.9

# How Cyrillic letters are written in Latin ones.
CYRILLIC = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
        "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "),
        strict=True,
    )
)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bucket of each hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their subwords, one word after another, and how many each word has.

    Words are put between < and >. All of them are hashed at once: a subword by its characters as the digits of
    a number, a whole word likewise with another base.
    """
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters from here to the word's end
    place = np.arange(len(codes)) - starts[owner]
    powers = np.cumprod(np.full(int(lengths.max()), WHOLE_BASE, np.uint64))
    owners, hashes = [np.arange(len(words))], [np.add.reduceat(codes * powers[place], starts)]
    for n in SUBWORDS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * SUBWORD_BASE + codes[at + j]
        owners.append(owner[at])
        hashes.append(h)
    of = np.concatenate(owners)
    return mixed(np.concatenate(hashes))[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def plain_letters(words: list[str]) -> list[str]:
    """Without marks, as some pages are written, and Cyrillic in Latin letters."""
    loose = {"ł": "l", "ß": "ss", "ø": "o", "æ": "ae", "đ": "d"}
    joined = "".join(CYRILLIC.get(c, c) for c in " ".join(words))
    return "".join(loose.get(c, c) for c in unicodedata.normalize("NFD", joined) if not unicodedata.combining(c)).split()


class Texts:
    """Training texts as one long list of buckets with a weight each, such that a text's vector is their weighted sum."""

    def __init__(self, texts: list[list[str]]):
        words = list(dict.fromkeys(w for t in texts for w in t))
        buckets, counts = buckets_of(words)
        known = dict(zip(words, np.split(buckets, np.cumsum(counts)[:-1]), strict=True))
        self.buckets, self.weights = [], []
        for words in texts:
            of = [known[w] for w in words]
            self.buckets.append(np.concatenate(of))
            self.weights.append(np.concatenate([np.full(len(o), 1 / (len(o) * len(of)), np.float32) for o in of]))

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        picked = [self.buckets[r] for r in rows]
        starts = np.cumsum([0, *(len(p) for p in picked[:-1])])
        return np.concatenate(picked), np.concatenate([self.weights[r] for r in rows]), starts


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Classifier:
    """`scores` has what each bucket says for each class: its vector times the softmax's weights."""

    def __init__(self, classes: list[str], scores: np.ndarray, bias: np.ndarray, sharpness: tuple[float, ...] = (1.0,) * len(SIZES), least: tuple[float, ...] = (0.0,) * len(SIZES)):
        self.classes, self.scores, self.bias, self.sharpness, self.least = classes, scores, bias, sharpness, least
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(classes)), np.float32)
        self.lengths = np.zeros(1024, np.int32)

    def __getstate__(self) -> dict:
        return {"classes": self.classes, "scores": self.scores, "bias": self.bias, "sharpness": self.sharpness, "least": self.least}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def rows(self, words: list[str]) -> np.ndarray:
        """Place of each word in `table` (what it says for each class) and `lengths`."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = list(set(words).difference(known))
        if new:
            first, most = len(known), len(known) + len(new)
            if most > len(self.table):
                size = max(most, 2 * len(self.table))
                self.table = np.vstack([self.table, np.zeros((size - len(self.table), self.table.shape[1]), np.float32)])
                self.lengths = np.resize(self.lengths, size)
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                buckets, counts = buckets_of(part)
                at = first + k + np.arange(len(part))
                self.table[at] = np.add.reduceat(self.scores[buckets], np.cumsum(counts) - counts, axis=0) / counts[:, None]
                self.lengths[at] = [len(w) for w in part]
            known.update(zip(new, range(first, most), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def log_odds(self, texts: list[list[str]]) -> np.ndarray:
        """Per text and class, before softmax; texts mustn't be empty of words."""
        return self.log_odds_and_letters(texts)[0]

    def log_odds_and_letters(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """`log_odds`, and letters that count, of each text.

        Letters don't count of words for which the model, by the word alone, gives the text's language less than an
        even chance among all classes, as it mostly does for names.
        """
        rows = self.rows([w for t in texts for w in t])
        counts = np.array([len(t) for t in texts])
        starts = np.cumsum(counts) - counts
        odds = (np.add.reduceat(self.table[rows], starts, axis=0) / counts[:, None] + self.bias) * self.by_size(self.sharpness, counts)[:, None]
        words, at = np.unique(rows, return_inverse=True)
        alone = softmax((self.table[words] + self.bias) * self.sharpness[0]) >= 1 / len(self.classes)
        counted = alone[at, np.repeat(odds.argmax(axis=1), counts)]
        return odds, np.add.reduceat(self.lengths[rows] * counted, starts).astype(float)

    def by_size(self, values: tuple[float, ...], counts: np.ndarray) -> np.ndarray:
        """The sharpness, or the confidence below which to reject, of texts of so many words."""
        return np.array(values, np.float32)[np.searchsorted(SIZES, counts, side="right") - 1]

    def predict(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Class number, -1 where rejected, and confidence of each text."""
        best, sure = np.full(len(texts), -1), np.zeros(len(texts))
        full = [k for k, t in enumerate(texts) if t]
        if full:
            p = softmax(self.log_odds([texts[k] for k in full]))
            best[full], sure[full] = p.argmax(axis=1), p.max(axis=1)
            least = self.by_size(self.least, np.array([len(texts[k]) for k in full]))
            best[np.array(full)[sure[full] < least]] = -1
        return best, sure


def train(texts: list[list[str]], labels: np.ndarray, classes: list[str], epochs: int, seed: int = 7, rate: float = 0.5, held_out: float = 0.1) -> Classifier:
    """Train on texts that have words. Classes weigh alike however many texts they have."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    n_held = int(len(texts) * held_out)
    held, used = order[:n_held], order[n_held:]
    data = Texts(texts)
    n = len(classes)
    vectors = (rng.uniform(-1, 1, (SUBWORD_BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    weights, bias = np.zeros((n, DIMENSIONS)), np.zeros(n)
    balance = 1 / np.maximum(1, np.bincount(labels[used], minlength=n))
    balance *= len(used) / np.maximum(1e-9, balance[labels[used]].sum())
    steps, size = 0, 32
    total = epochs * -(-len(used) // size)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // size)):
            lr = rate * (1 - steps / total)
            steps += 1
            buckets, share, starts = data.batch(rows)
            hidden = np.add.reduceat(vectors[buckets] * share[:, None], starts, axis=0)
            error = softmax(hidden @ weights.T + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= balance[labels[rows]][:, None] / len(rows)
            back = error @ weights
            weights -= lr * 8 * error.T @ hidden
            bias -= lr * error.sum(axis=0)
            lengths = np.diff(np.r_[starts, len(buckets)])
            # a text's vector is a weighted sum of some hundred vectors; the step makes up for their small shares
            order = np.argsort(buckets, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0])
            owner = np.repeat(np.arange(len(rows)), lengths)[order]
            vectors[buckets[order[at]]] -= lr * 400 * np.add.reduceat(back[owner] * share[order][:, None], at, axis=0)
    model = Classifier(classes, (vectors @ weights.T).astype(np.float32), bias.astype(np.float32))
    calibrate(model, [texts[k] for k in (held if n_held else used)], labels[held if n_held else used], rng)
    return model


def calibrate(model: Classifier, texts: list[list[str]], labels: np.ndarray, rng: np.random.Generator, passed: float = 0.02, lost: float = 0.002) -> None:
    """For each of SIZES, as paragraphs can be short: sharpness that fits held-out pieces best, and the least confidence.

    A single word tells less than six do, so it gets less sharpness. Words of shuffled letters are to be rejected:
    of these the part `passed` may be accepted, but no more than the part `lost` of the held-out pieces rejected.
    """
    sharpness, least = [], []
    for size in SIZES:
        short = [t[k : k + size] for t in texts for k in range(0, len(t), size)]
        of = np.concatenate([np.full(-(-len(t) // size), c) for t, c in zip(texts, labels, strict=True)])
        noise = [["".join(rng.permutation(list(w))) for w in t] for t in short]
        raw, shuffled = model.log_odds(short), model.log_odds(noise)
        loss = [(-np.log(softmax(raw * s)[np.arange(len(of)), of] + 1e-12).mean(), s) for s in np.geomspace(0.1, 20, 60)]
        sharpness.append(float(min(loss)[1]))
        p = softmax(raw * sharpness[-1])
        sure = p.max(axis=1)[p.argmax(axis=1) == of]
        least.append(float(min(MOST_REJECTED, np.quantile(softmax(shuffled * sharpness[-1]).max(axis=1), 1 - passed), np.quantile(sure, lost))))
    model.sharpness, model.least = tuple(sharpness), tuple(least)


def pieces(words: list[str], size: int = 6) -> list[list[str]]:
    return [words[k : k + size] for k in range(0, len(words), size)]


def fit(reference: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> Classifier:
    """Train on reference texts, then once more with those labelled documents that the first model agrees with.

    Of a document's paragraphs, those count that the first model gives its language, and longer ones that it
    doesn't surely give another: a short one of another language would teach its few words wrongly. Each
    text is used as it is and in plain letters. `reference` and `labelled` are pairs of language and text.
    """
    classes = sorted({lang for lang, _ in reference})
    texts, labels = [], []

    def add(words: list[str], lang: str) -> None:
        for part in pieces(words):
            texts.append(part)
            texts.append(plain_letters(part) or part)
            labels.extend([classes.index(lang)] * 2)

    for lang, text in reference:
        add(words_of(text), lang)
    first = train(texts, np.array(labels), classes, epochs=12)
    kept = 0
    for lang, text in labelled:
        parts = [w for w in map(words_of, paragraphs_of(text)) if w]
        if not parts or lang not in classes:
            continue
        own = classes.index(lang)
        p = softmax(first.log_odds(parts))
        votes = np.array([len(w) for w in parts]) @ p
        if votes.argmax() != own or votes[own] < 0.6 * votes.sum():
            continue
        kept += 1
        for words, each in zip(parts, p, strict=True):
            if each.argmax() == own or (each[own] >= 0.2 and len(words) >= CLEAR_WORDS):
                add(words, lang)
    return train(texts, np.array(labels), classes, epochs=4, seed=8) if kept else first


def judge(model: Classifier, documents: list[list[list[str]]]) -> tuple[list[list[str | None]], list[list[float]], list[str | None], list[float]]:
    """Of each document, given as paragraphs of words: languages and confidences of the paragraphs, its own language and confidence.

    What the other paragraphs say is a paragraph's prior, such that a few ambiguous words don't make a document
    a mixed one. The document has the language of most letters of its paragraphs.
    """
    n, k = len(documents), len(model.classes)
    lang = [[None] * len(d) for d in documents]
    sure = [[0.0] * len(d) for d in documents]
    own: list[str | None] = [None] * n
    own_sure = [0.0] * n
    where = [(i, j) for i, d in enumerate(documents) for j, words in enumerate(d) if words]
    if not where:
        return lang, sure, own, own_sure
    counts = np.array([len(documents[i][j]) for i, j in where])
    odds, letters = model.log_odds_and_letters([documents[i][j] for i, j in where])
    doc = np.array([i for i, _ in where])
    # evidence grows with the number of words, up to a bound
    strength = np.clip(counts / 6, 1, 4)[:, None]
    alone = softmax(odds)
    mass = alone * letters[:, None]
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    place = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    others = np.maximum(0, np.add.reduceat(mass, starts, axis=0)[place] - mass)
    prior = 0.3 / k + 0.7 * (others + 1 / k) / (others.sum(axis=1, keepdims=True) + 1)
    post = softmax(odds * strength + np.log(prior))
    best, confidence = post.argmax(axis=1), post.max(axis=1)
    told = np.maximum(confidence, alone.max(axis=1)) >= model.by_size(model.least, counts)
    votes = np.zeros((len(letters), k))
    votes[np.arange(len(letters)), best] = letters * told
    total = np.add.reduceat(votes, starts, axis=0)
    top = total.argmax(axis=1)
    for_top = votes[np.arange(len(letters)), top[place]]
    mean = np.add.reduceat(for_top * confidence, starts) / np.maximum(1e-9, np.add.reduceat(for_top, starts))
    for r in np.flatnonzero(told):
        i, j = where[r]
        lang[i][j], sure[i][j] = model.classes[best[r]], float(confidence[r])
    for g in np.flatnonzero(total.max(axis=1) > 0):
        own[doc[starts[g]]], own_sure[doc[starts[g]]] = model.classes[top[g]], float(mean[g])
    return lang, sure, own, own_sure


def _judged(model_file):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_file.value
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in in_parts(texts):
                judgement = judge(model, [[words_of(p) for p in paragraphs_of(t)] for t in texts[a:b]])
                rows, segment, lang, sure = [], [], [], []
                for k, of, how, whole, confidence in zip(range(a, b), *judgement, strict=True):
                    rows.append(k)
                    segment.append(-1)
                    lang.append(whole)
                    sure.append(confidence)
                    if len(set(of) - {None}) > 1:
                        rows += [k] * len(of)
                        segment += range(len(of))
                        lang += of
                        sure += how
                at = pa.array(rows, pa.int64())
                columns = [batch.column("doc_id").take(at), batch.column("label").take(at), pa.array(segment, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "segment", "lang", "confidence"])

    return judged


def delivered_label() -> Column:
    """The label as delivered: trimmed, lower case, cut at the first - or _."""
    return F.regexp_extract(F.lower(F.trim("lang")), "^[^-_]*", 0)


def fit_on(documents: DataFrame, lang_reference: DataFrame) -> Classifier:
    """Train on the reference and on a bounded sample of labelled documents, the first by hash of each label.

    The driver keeps the model, so only a changed sample is trained on again.
    """
    reference = lang_reference.where("lang IS NOT NULL AND sample_text IS NOT NULL").select("sample_id", F.lower(F.trim("lang")).alias("lang"), "sample_text")
    reference = [(r["lang"], r["sample_text"]) for r in reference.orderBy("sample_id", "lang", "sample_text").limit(REFERENCE_TEXTS).collect()]
    codes = sorted({lang for lang, text in reference if words_of(text)})
    if not codes:
        raise ValueError("lang_reference has no text with words")
    some = documents.select("doc_id", "text", delivered_label().alias("label")).where(F.col("label").isin(codes))
    labelled = labelled_sample(some, TRAINING_DOCUMENTS, TRAINING_CHARS)
    reference = [(lang, text) for lang, text in reference if words_of(text)]
    return fitted_once("language", [*reference, (), *labelled], lambda: fit(reference, labelled))


def languages(documents: DataFrame, lang_reference: DataFrame) -> DataFrame:
    """(doc_id, segment, lang, confidence, label, right): the language of every document and mixed paragraph.

    Segment -1 is the document, one row for each row of `documents`; lang is null, with confidence 0, where the
    text is null or has no words or what words it has are of no known language. A document whose paragraphs are
    in more than one language also has a row for each paragraph, from 0 on, null for one without language.
    label is the delivered one, null if it isn't a code of `lang_reference`; right says whether it equals the
    document's language. No shuffle; the model, of fixed size, is trained on the driver and broadcast.
    """
    model = fit_on(documents, lang_reference)
    kind = documents.schema["doc_id"].dataType.simpleString()
    known = F.when(delivered_label().isin(model.classes), delivered_label()).alias("label")
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"), known)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    judged = rows.mapInArrow(_judged(shared), f"doc_id {kind}, label string, segment int, lang string, confidence double")
    return judged.select("doc_id", "segment", "lang", "confidence", "label", F.coalesce(F.col("lang") == F.col("label"), F.lit(False)).alias("right"))


def language_cases(documents: DataFrame, lang_reference: DataFrame) -> DataFrame:
    """(doc_id, segment, lang): documents whose label is missing or wrong, and paragraphs of mixed documents."""
    found = languages(documents, lang_reference)
    return found.where("lang IS NOT NULL AND (segment >= 0 OR NOT right)").select("doc_id", "segment", "lang")
