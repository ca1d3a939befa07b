"""Quality by attention-based multiple-instance learning.

A document is a bag of passages; only the bag has a label.  Every passage is encoded by a
learned layer from its words (each of which has a learned embedding by its hash) and
from its characters (shares of each sign and kind of character, lengths,
repeats); gated attention (Ilse et al. 2018),
softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages, and a logistic
output scores the weighted representation.  All layers are trained together
from document labels on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import fold_of, fresh, id_text, lower_ascii, prefix_hash, slices, span_hash, word_spans
from tiffin.llm.sampling import labelled_sample

PASSAGE_WORDS = 64
HIDDEN, GATE = 16, 8
#: Rows of the embedding: words with the same hash share one.
WORDS = 256
#: Passages that the fit takes of a sampled document, at even steps over a longer one.
FIT_PASSAGES = 64

#: Byte kinds: each ASCII sign for itself, then lower, upper, digit, space, line end, control, other.
SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
KINDS = len(SIGNS) + 7


def byte_kinds() -> np.ndarray:
    kind = np.full(256, len(SIGNS) + 6, np.uint8)
    kind[:32] = len(SIGNS) + 5
    kind[10] = len(SIGNS) + 4
    kind[[9, 11, 12, 13, 32]] = len(SIGNS) + 3
    kind[48:58] = len(SIGNS) + 2
    kind[65:91] = len(SIGNS) + 1
    kind[97:123] = len(SIGNS)
    kind[SIGNS] = range(len(SIGNS))
    return kind


_KIND = byte_kinds()
PLAIN = KINDS + 7
FEATURES = PLAIN + WORDS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (PASSAGE_WORDS words each; one at least per
    document), and the n+1 offsets of the documents into them."""
    starts, ends, words = word_spans(data, offsets)
    per_doc = np.maximum(1, -(-np.diff(words) // PASSAGE_WORDS))
    at = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(at[-1])
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    place = np.arange(n) - at[doc]
    first_word = words[doc] + place * PASSAGE_WORDS
    begin = np.where(place == 0, offsets[doc], 0)
    later = place > 0
    begin[later] = starts[first_word[later]]
    sizes = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(n, dtype=np.int64), sizes)
    counts = np.bincount(of_byte * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :KINDS] = np.sqrt(counts / np.maximum(1, sizes)[:, None])

    n_words = np.minimum(words[doc + 1], first_word + PASSAGE_WORDS) - first_word
    of_word = np.repeat(np.arange(n), n_words)
    some = np.maximum(1, n_words)
    lengths = (ends - starts).astype(np.float64)
    out[:, KINDS] = np.log1p(n_words)
    out[:, KINDS + 1] = np.bincount(of_word, lengths, n) / some / 10
    out[:, KINDS + 2] = np.sqrt(np.bincount(of_word, lengths**2, n) / some) / 10
    keys = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
    embedded = np.bincount(of_word * WORDS + (keys % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, PLAIN:] = np.sqrt(embedded / some[:, None])
    order = np.lexsort((keys, of_word))
    sorted_keys, sorted_of = keys[order], of_word[order]
    again = np.zeros(len(keys), bool)
    again[1:] = (sorted_keys[1:] == sorted_keys[:-1]) & (sorted_of[1:] == sorted_of[:-1])
    out[:, KINDS + 3] = np.bincount(sorted_of, again, n) / some
    beside = np.zeros(len(keys), bool)
    beside[1:] = (keys[1:] == keys[:-1]) & (of_word[1:] == of_word[:-1])
    out[:, KINDS + 4] = np.bincount(of_word, beside, n) / some
    heads = data[starts] if len(starts) else np.empty(0, np.uint8)
    tails = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    out[:, KINDS + 5] = np.bincount(of_word, (heads >= 65) & (heads <= 90), n) / some
    out[:, KINDS + 6] = np.bincount(of_word, _KIND[tails] < len(SIGNS), n) / some
    return out, at


@dataclass
class BagModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return np.clip(x, -8, 8, out=x)

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Probabilities of label 1 per bag, and what the gradient needs."""
        return self.forward_scaled(self.scaled(x), at)

    def forward_scaled(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        w = self.weights
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (t * s) @ w["a"]
        bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
        raw = np.exp(raw - np.maximum.reduceat(raw, at[:-1])[bag])
        attention = raw / np.add.reduceat(raw, at[:-1])[bag]
        z = np.add.reduceat(attention[:, None] * h, at[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return p, {"x": x, "h": h, "t": t, "s": s, "attention": attention, "bag": bag, "z": z}

    def gradient(self, p: np.ndarray, y: np.ndarray, share: np.ndarray, at: np.ndarray, k: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        w = self.weights
        d = (p - y) * share
        dz = d[:, None] * w["c"]
        dh = k["attention"][:, None] * dz[k["bag"]]
        da = (k["h"] * dz[k["bag"]]).sum(1)
        mean = np.add.reduceat(k["attention"] * da, at[:-1])
        draw = k["attention"] * (da - mean[k["bag"]])
        dg = draw[:, None] * w["a"]
        dt, ds = dg * k["s"] * (1 - k["t"] ** 2), dg * k["t"] * k["s"] * (1 - k["s"])
        dh = dh + dt @ w["V"].T + ds @ w["U"].T
        de = dh * (1 - k["h"] ** 2)
        return {
            "c": k["z"].T @ d, "b": d.sum(keepdims=True), "a": (k["t"] * k["s"]).T @ draw,
            "V": k["h"].T @ dt, "U": k["h"].T @ ds, "E": k["x"].T @ de, "e": de.sum(0),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, shares: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-3) -> BagModel:
    """Adam on the weighted log loss of all bags; deterministic."""
    x = np.concatenate(bags)
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    rng = np.random.default_rng(11)
    shape = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "b": (1,)}
    weights = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "eb" else np.zeros(s)).astype(x.dtype) for k, s in shape.items()}
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-2
    model = BagModel(mean.astype(x.dtype), scale.astype(x.dtype), weights)
    labels, shares = labels.astype(x.dtype), (shares / shares.sum()).astype(x.dtype)
    x = model.scaled(x)
    m = {k: np.zeros(s, x.dtype) for k, s in shape.items()}
    v = {k: np.zeros(s, x.dtype) for k, s in shape.items()}
    for step in range(1, epochs + 1):
        p, kept = model.forward_scaled(x, at)
        for k, g in model.gradient(p, labels, shares, at, kept).items():
            g = g + decay * weights[k] * (k not in "eb")
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(texts: DataFrame, labels: DataFrame, per_label: int = 1500) -> BagModel | None:
    """Fit on ``texts(doc_id, text)`` with ``labels(doc_id, label 0 or 1)``:
    at most ``per_label`` documents of each label, weighted back to
    the labels' true shares, and of each at most FIT_PASSAGES passages.  None if
    there is nothing to learn from."""
    chosen, sizes = labelled_sample(labels, "label", per_label)
    if not sizes:
        return None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, limit=1 << 20):
            x, at = passages(data, offsets)
            bags = [x[np.unique(np.linspace(a, b - 1, FIT_PASSAGES).astype(np.int64))].tobytes() for a, b in zip(at, at[1:])]
            yield pa.record_batch([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    # the sample's ids: per_label rows for each of the two labels
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = rows.mapInArrow(encode, "doc_id string, label int, bag binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (str(r["doc_id"]), r["label"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    y = np.array([r["label"] for r in rows], np.float64)
    fitted = {label: int((y == label).sum()) for label in sizes}
    shares = np.array([sizes[r["label"]] / fitted[r["label"]] for r in rows])
    return fit(bags, y, shares)


def score(texts: DataFrame, model: BagModel | None) -> DataFrame:
    """``doc_id, score`` for every row: the probability of label 1 (0.5
    without a model)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, offsets in slices(batches, limit=1 << 20):
            p = np.full(batch.num_rows, 0.5)
            if m is not None:
                p = m.forward(*passages(data, offsets))[0]
            yield pa.record_batch([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held_out_fold: int = 2,
    per_label: int = 1500,
) -> BagModel | None:
    """The model from labelled rows outside the held-out fold of crc32(id).
    Labels other than 0 and 1, and null labels or ids, are ignored; a document
    labelled repeatedly takes its largest label."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(fold_of(F.col("doc_id"), folds) != held_out_fold)
    return train(id_text(docs, id_col, text_col), known.groupBy("doc_id").agg(F.max("label").alias("label")), per_label)


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    folds: int = 4,
    held_out_fold: int = 2,
    per_label: int = 1500,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Null texts score as empty ones, which are bags of one passage without
    words.  Without labels every score is 0.5.  Rows may repeat; other columns are not read.
    """
    model = learn(docs, labels, id_col, text_col, label_col, folds, held_out_fold, per_label)
    found = score(id_text(docs, id_col, text_col), model)
    held = fold_of(F.col("doc_id"), folds) == held_out_fold
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: BagModel | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more;
    all rows without a model.  Null texts score as empty ones and stay null."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    plain = fresh("_text", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, plain, limit=1 << 20):
            good = shared.value.forward(*passages(data, offsets))[0] >= threshold
            yield batch.drop_columns([plain]).filter(pa.array(good))

    return docs.withColumn(plain, F.coalesce(docs[text_col].cast("string"), F.lit(""))).mapInArrow(run, fields)
