"""Language identification by averaged hashed subword embeddings and a linear softmax.

Features of a text are the hashes of the 2-, 3- and 4-character pieces of its lower-cased words, a
blank standing for the word's border; a text's vector is the mean of their embeddings. Embeddings
and softmax are trained together by stochastic gradient descent in numpy on the driver. A
temperature, fitted on examples that were not trained on, calibrates the scores. Short texts score
lower, so rejection goes by length: each length in ``EXAMPLE_WORDS`` has a threshold, and a text is
held against that of the greatest such length it has. For the greatest it is the ``REJECTED``
quantile of the scores of all whole documents that were not trained on and are predicted right, so
documents with passages in other languages count as they are. For shorter ones, and where there are
under ``LEAST_CALIBRATED`` such documents, it lies halfway between an even guess and that quantile
for stretches of that length.

Training reads about ``DOCS_PER_LANGUAGE`` documents of each language (all if there are fewer),
chosen by the hash of their id, and of each at most ``EXAMPLES_PER_DOC`` stretches of up to 40 words
(of up to 100 characters) spread over the whole text: a documented bound of the sample. The threshold
of long texts rests on all other labelled documents outside the held-out fold. Equal rows count once.
Prediction reads whole texts.

A text that is null or has no letter (``str.isalpha``) is ``und`` with score 0 and always rejected.
If no labelled row is left to learn from, every text is ``und``. A row whose doc_id is null is not
held out and not learned from. Repeated rows get equal predictions. Other columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize

UNDETERMINED = "und"
DOCS_PER_LANGUAGE = 600
EXAMPLES_PER_DOC = 8
EXAMPLE_WORDS = (1, 4, 12, 40)
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 4
RATE = 0.5
SEED = 3
HELD_OUT_SHARE = 0.1
REJECTED = 0.0005
LEAST_CALIBRATED = 500
LONG_TEXT = 6000
BROADCAST_LANGUAGES = 10_000
PIECES = (2, 3, 4)

#: Word characters that are letters, or numerals such as superscripts and fractions.
NEAR_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in NEAR_LETTER.finditer(text))


def length_class(text: str) -> int:
    """Place in ``EXAMPLE_WORDS`` of the greatest length that the text has, 0 for an empty one."""
    return max(0, bisect_right(EXAMPLE_WORDS, len(text.split(None, EXAMPLE_WORDS[-1]))) - 1)


def features(text: str) -> np.ndarray:
    """Bucket of every piece of 2 to 4 characters that has a blank at its ends only."""
    clean = " " + " ".join(text.lower().split()) + " "
    x = np.frombuffer(clean.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = x == 32
    out = []
    inner = np.zeros(len(x) - 1, bool)
    h = x[:-1] * np.uint64(0x9E3779B1) + x[1:]
    for n in PIECES:
        if n > 2:
            if len(x) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B1) + x[n - 1 :]
            inner = inner[:-1] | blank[n - 2 : -1]
        keep = h[~inner]
        keep = keep * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
        out.append(((keep ^ (keep >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49))
    return np.concatenate(out).astype(np.int32)


@dataclass
class Model:
    """Per-bucket scores of each language: embedding times softmax weights, folded into one table."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    thresholds: list[float]

    def logits(self, text: str) -> np.ndarray:
        ids = features(text)
        if len(ids) > LONG_TEXT:
            total = np.bincount(ids, minlength=BUCKETS).astype(np.float64) @ self.table
        else:
            total = self.table[ids].sum(axis=0)
        return total / len(ids) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether it is rejected)."""
        lang, score = self.predict(text)
        return lang, score, lang == UNDETERMINED or score < self.thresholds[length_class(text)]


def _softmax(z):
    p = np.exp(z - z.max())
    return p / p.sum()


def train(examples: list[tuple[str, str]], seed: int = SEED) -> Model:
    """``examples``: (text, language) pairs."""
    examples = sorted((t, lang) for t, lang in examples if has_letter(t))
    languages = sorted({lang for _, lang in examples})
    if not examples:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, [1.0] * len(EXAMPLE_WORDS))
    rng = np.random.default_rng(seed)
    index = {lang: k for k, lang in enumerate(languages)}
    x = [features(t) for t, _ in examples]
    y = np.array([index[lang] for _, lang in examples])
    held = rng.random(len(x)) < HELD_OUT_SHARE
    fit = np.flatnonzero(~held)
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    w = np.zeros((DIMENSIONS, len(languages)))
    b = np.zeros(len(languages))
    share = len(fit) / (len(languages) * np.maximum(np.bincount(y[fit], minlength=len(languages)), 1))
    steps, total = 0, EPOCHS * max(len(fit), 1)
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = RATE * (1 - steps / total)
            steps += 1
            ids = x[i]
            hidden = e[ids].mean(axis=0)
            error = _softmax(hidden @ w + b)
            error[y[i]] -= 1
            error *= rate * min(share[y[i]], 10.0)
            back = w @ error
            w -= np.outer(hidden, error)
            b -= error
            np.subtract.at(e, ids, back / len(ids))
    table = e @ w
    z = np.stack([table[ids].mean(axis=0) + b for ids in x])
    check = np.flatnonzero(held) if held.any() else fit
    cost = lambda t: -np.mean([np.log(_softmax(z[i] / t)[y[i]] + 1e-300) for i in check])
    temperature = float(min((2.0**k for k in np.arange(-4, 3.1, 0.25)), key=cost))
    right = [[] for _ in EXAMPLE_WORDS]
    for i in check:
        scores = _softmax(z[i] / temperature)
        if scores.argmax() == y[i]:
            right[length_class(examples[i][0])].append(scores[y[i]])
    pooled = [x for r in right for x in r]
    chance = 1 / len(languages)
    thresholds = [(chance + float(np.quantile(r or pooled, REJECTED))) / 2 if pooled else 0.0 for r in right]
    return Model(languages, table, b, temperature, thresholds)


def _stretches(batches):
    for batch in batches:
        texts, langs = [], []
        for seed, text, lang in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            words = text.split()
            rng = np.random.default_rng(seed & (2**63 - 1))
            for k in range(min(EXAMPLES_PER_DOC, max(1, len(words) // EXAMPLE_WORDS[0]))):
                n = min(EXAMPLE_WORDS[k % len(EXAMPLE_WORDS)], len(words))
                at = int(rng.integers(0, len(words) - n + 1)) if words else 0
                texts.append(" ".join(w[:100] for w in words[at : at + n]))
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(langs, pa.string())], names=["text", "lang"])


def held_out_fold(doc_id="doc_id"):
    """True for the fifth of documents that no model learns from; null ids are outside."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learns from labelled rows outside the held-out fold."""
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(
        "lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL"
    ).filter(~held_out_fold())
    once = labelled.select("lang", "doc_id", F.xxhash64("text").alias("h")).distinct()
    counts = materialize(once.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if counts.count() <= BROADCAST_LANGUAGES:  # else the texts are shuffled by language
        counts = F.broadcast(counts)
    share = F.shiftrightunsigned("pick", 33) / float(1 << 31) * F.col("n")
    drawn = labelled.withColumn("pick", F.xxhash64("doc_id", F.lit(SEED))).join(counts, "lang").withColumn("place", share)
    chosen = drawn.filter(F.col("place") < docs_per_language).select("pick", "text", "lang").distinct()
    rows = chosen.mapInArrow(_stretches, "text string, lang string").collect()
    model = train([(r.text, r.lang) for r in rows])
    calibrate(model, drawn.filter(F.col("place") >= docs_per_language).select("doc_id", "text", "lang"))
    return model


def calibrate(model: Model, docs: DataFrame) -> None:
    """Sets the threshold of long texts by those of ``docs(doc_id, text, lang)`` that are predicted right, equal rows once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, one column a language

    def run(batches):
        own = shared.value
        for batch in batches:
            rows, scores = [], []
            for k, (text, lang) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                found, score = own.predict(text)
                if found == lang and length_class(text) == len(EXAMPLE_WORDS) - 1:
                    rows.append(k)
                    scores.append(score)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(scores, pa.float64())], names=["doc_id", "h", "score"])

    rows = docs.select("doc_id", F.xxhash64("text", "lang").alias("h"), "text", "lang").mapInArrow(run, "doc_id long, h long, score double").distinct()
    scores = rows.agg(F.count("*").alias("n"), F.percentile_approx("score", REJECTED, 100_000).alias("least")).first()
    if scores["n"] >= LEAST_CALIBRATED:
        model.thresholds[-1] = scores["least"]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` are reduced to ``doc_id, lang_pred, score, rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, one column a language

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.judge(t.as_py() if t.is_valid else None) for t in batch.column(1)]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            keep = [not own.judge(t.as_py() if t.is_valid else None)[2] for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
