"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features are n-grams of one to three characters (letters in lower case, a run of anything
else as one boundary), hashed to ``2**BITS`` columns.  Document frequencies are counted over every
learning row.  The weights are trained with follow-the-regularised-leader
(FTRL-proximal) steps under an elastic net, on a bounded sample; a temperature
fitted on a part of the sample kept out of training calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.bpe import char_classes
from tiffin.llm.common import fold_of, id_text, slices
from tiffin.llm.sampling import sampled_texts

BITS = 15
BUCKETS = 1 << BITS
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def letters_in_lower_case() -> np.ndarray:
    """Each code point as a letter in lower case, or 0 if it is no letter."""
    table = np.where(char_classes() == 1, np.arange(0x110000, dtype=np.uint32), 0).astype(np.uint32)
    for c in np.flatnonzero(table).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def columns_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed n-grams of a slice, the n+1 offsets of the documents into
    them, and how many letters each document has."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, offsets)
    chars = letters_in_lower_case()[points]
    ink = np.concatenate([[0], np.cumsum(chars > 0)])
    n_letters = ink[at[1:]] - ink[at[:-1]]
    keep = chars > 0
    keep[1:] |= chars[:-1] > 0  # the first of a run of other characters is the boundary
    first = np.zeros(len(chars) + 1, bool)
    first[at] = True
    keep |= first[:-1]
    where = np.concatenate([[0], np.cumsum(keep)])[at]
    chars, first = chars[keep], first[:-1][keep]
    one = chars.astype(np.uint64) + np.uint64(1)
    grams = np.empty((len(one), 3), np.uint16)
    shift = np.uint64(64 - BITS)
    before1, before2 = np.zeros_like(one), np.zeros_like(one)
    before1[1:] = np.where(first[1:], 0, one[:-1])
    before2[1:] = np.where(first[1:], 0, before1[:-1])
    mult = np.uint64(0x9E3779B97F4A7C15)
    grams[:, 0] = (one * mult) >> shift
    grams[:, 1] = ((before1 << np.uint64(21) | one) * mult) >> shift
    grams[:, 2] = ((before2 << np.uint64(42) | before1 << np.uint64(21) | one) * mult) >> shift
    return grams.ravel(), 3 * where, n_letters


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int]]:
    """For each document its batch and row, its n-gram counts and letters."""
    for batch, data, offsets in slices(batches, limit=1 << 20):
        grams, at, n_letters = columns_of(data, offsets)
        for row in range(batch.num_rows):
            yield batch, row, np.bincount(grams[at[row] : at[row + 1]], minlength=BUCKETS), int(n_letters[row])


def inverse_document_frequency(texts: DataFrame) -> np.ndarray:
    """ln((1 + rows) / (1 + rows with the column)) + 1 over all rows; Spark
    adds up one vector per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for _, _, tf, _ in counts_of(batches):
            seen += tf > 0
            rows += 1
        if rows:
            columns = np.append(np.arange(BUCKETS), -1)
            yield pa.record_batch([pa.array(columns), pa.array(np.append(seen, rows))], names=["gram", "n"])

    total = texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = {r["gram"]: r["n"] for r in total.collect()}  # BUCKETS + 1 rows at most
    seen = np.array([table.get(g, 0) for g in range(BUCKETS)], np.float64)
    return np.log((1 + table.get(-1, 0)) / (1 + seen)) + 1


def train(
    texts: DataFrame,
    per_language: int = 600,
    max_languages: int = 500,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
) -> LanguageModel:
    """Fit on ``texts(doc_id, text, lang)``; null languages are left out.
    At most ``per_language`` different rows of each language are fitted on; more
    than ``max_languages`` languages are an error; document frequencies are over all rows."""
    known = texts.where("lang is not null")
    chosen, languages = sampled_texts(known.select("doc_id", "text", "lang"), "lang", per_language, max_languages)
    idf = inverse_document_frequency(known.select("doc_id", "text"))
    k = len(languages)
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, k)), np.zeros(k), 1.0)
    if k < 2:
        return model

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, tf, _ in counts_of(batches):
            own = batch.slice(row, 1)
            grams = np.flatnonzero(tf)
            columns = [own.column("doc_id").cast(pa.string()), own.column("lang"), pa.array([grams.astype(np.int32)]), pa.array([tf[grams].astype(np.int32)])]
            yield pa.record_batch(columns, names=["doc_id", "lang", "grams", "tf"])

    # per_language rows for each of at most max_languages languages
    rows = chosen.select("doc_id", "text", "lang").mapInArrow(features, "doc_id string, lang string, grams array<int>, tf array<int>").collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["lang"], r["grams"], r["tf"]))
    data = [(np.array(r["grams"], np.int64), np.array(r["tf"], np.float64), languages.index(r["lang"])) for r in rows]
    data = [(g, unit(tf * idf[g]), y) for g, tf, y in data if len(g)]
    order = np.random.default_rng(7).permutation(len(data))
    held = len(data) // 5
    kept_out, fitted = order[:held], order[held:]
    fit_ftrl(model, [data[i] for i in fitted], epochs, alpha, beta, l1, l2)
    calibrate(model, [data[i] for i in kept_out])
    return model


def unit(x: np.ndarray) -> np.ndarray:
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(model: LanguageModel, data: list, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
    """FTRL-proximal: weights follow in closed form from the gradient sums,
    and are zero where these stay within l1."""
    k = len(model.languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def leader(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(data)):
            grams, x, y = data[i]
            at, x = np.append(grams, BUCKETS), np.append(x, 1.0)
            w = leader(at)
            error = softmax(x @ w)
            error[y] -= 1
            gradient = x[:, None] * error
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    w = leader(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:-1], w[-1]


def calibrate(model: LanguageModel, data: list) -> None:
    """The temperature with the least log loss on rows kept out of training."""
    if not data:
        return
    logits = [(x @ model.weights[g] + model.bias, y) for g, x, y in data]

    def loss(t: float) -> float:
        return -sum(float(np.log(max(1e-300, softmax(z / t)[y]))) for z, y in logits)

    model.temperature = min(np.geomspace(0.05, 5.0, 60).tolist(), key=loss)


def predict(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``texts(doc_id, text)``.
    Texts without a letter, and any text if nothing was learned, are ``und``
    with score 0."""
    # the model's size is fixed: BUCKETS columns for each language
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, offsets in slices(batches, limit=1 << 20):
            grams, at, n_letters = columns_of(data, offsets)
            names, scores = [], []
            for row in range(batch.num_rows):
                if not n_letters[row] or not m.languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                tf = np.bincount(grams[at[row] : at[row + 1]], minlength=BUCKETS)
                own = np.flatnonzero(tf)
                p = softmax((unit(tf[own] * m.idf[own]) @ m.weights[own] + m.bias) / m.temperature)
                names.append(m.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_out_fold: int = 2,
    per_language: int = 600,
    max_languages: int = 500,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Learns from the rows outside the held-out fold of crc32(id).  Null, empty
    and letterless texts are ``und``; equal probabilities go to the first
    language in order; null ids fall in the fold of ''; rows may repeat, and a language is
    learned however often its rows do.  ``per_language`` and ``max_languages`` bound
    the sample that the driver fits on; every language of the learning rows is learned.
    """
    rows = id_text(docs, id_col, text_col).select("doc_id", "text")
    labelled = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), docs[lang_col].alias("lang"))
    held = fold_of(F.col("doc_id"), folds) == held_out_fold
    model = train(labelled.where(~held), per_language, max_languages)
    found = predict(rows, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
