from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, awkward
from tiffin.llm import quality
from tiffin.llm.langid import LanguageModel, calibrate, columns_of, identify_language
from tiffin.llm.common import prefix_hash, span_hash, text_column
from tiffin.llm.queries import QUERIES
from tiffin.llm.sampling import labelled_sample, sampled_texts

SF01 = "/root/testdata/sf0.01"


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_language_of_held_out_documents(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, SF01).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in unseen]) >= 0.97


def test_language_of_awkward_rows(spark):
    rows = [(i, t, lang) for i, t, lang in AWKWARD] + [(100 + i, f"der hund {i} und die katze", "de") for i in range(20)]
    found = identify_language(awkward(spark, rows)).collect()
    assert len(found) == len(rows)
    und = {r["doc_id"]: r["score"] for r in found if r["lang_pred"] == "und"}
    assert set(und) == {3, 4, 5, 6} and set(und.values()) == {0.0}
    assert {r["lang_pred"] for r in found} <= {"und", "en", "de", "fr"}
    assert identify_language(awkward(spark, [])).collect() == []
    unlabelled = identify_language(awkward(spark, [(1, "some text", None)])).collect()
    assert unlabelled[0]["lang_pred"] == "und"


def test_ngrams_stay_inside_documents():
    import pyarrow as pa

    def grams(texts):
        columns, at, letters = columns_of(*text_column(pa.array(texts, pa.large_string())))
        return [columns[a:b].tolist() for a, b in zip(at, at[1:])], letters.tolist()

    together, letters = grams(["Abc", "", "éd f!", "!!"])
    assert together == [grams([t])[0][0] for t in ["Abc", "", "éd f!", "!!"]] and letters == [3, 0, 3, 0]
    assert grams(["ABC"])[0] == grams(["abc"])[0] and grams(["a  b"])[0] == grams(["a.b"])[0]


def test_temperature_softens_overconfidence():
    model = LanguageModel(["a", "b"], np.ones(4), np.array([[9.0, 0.0], [0.0, 9.0], [0, 0], [0, 0]]), np.zeros(2), 1.0)
    right = [(np.array([0]), np.array([1.0]), 0)] * 7
    calibrate(model, right + [(np.array([0]), np.array([1.0]), 1)] * 3)
    assert model.temperature > 2


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as label")
    chosen, sizes = labelled_sample(rows, "label", 100)
    assert list(labelled_sample(rows, "label", 100, max_labels=1)[1]) == [0]
    first = sorted(map(tuple, chosen.collect()))
    assert sizes == {0: 4500, 1: 500} and len(first) == 200
    assert first == sorted(map(tuple, labelled_sample(rows.repartition(7), "label", 100)[0].collect()))


def test_a_language_of_one_repeated_row_is_learned(spark):
    """A third of all rows are copies of one English row; the others are German."""
    german = [(i, f"der hund {i} und die katze {i % 7}", "de") for i in range(2000)]
    for repeated in (0, 4, 5, 12):
        rows = spark.createDataFrame(german, "doc_id long, text string, lang string")
        copies = spark.range(3000).select(F.lit(repeated).cast("long").alias("doc_id"), F.lit("the dog and the cat").alias("text"), F.lit("en").alias("lang"))
        chosen, languages = sampled_texts(rows.unionByName(copies), "lang", 60, 500)
        found = [tuple(r) for r in chosen.collect()]
        assert languages == ["de", "en"] and [r[0] for r in found if r[2] == "en"] == [repeated]
        assert len(found) == 61 and len(set(found)) == 61


def test_sample_of_many_labels(spark):
    rows = spark.range(6000).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"), (F.col("id") % 600).alias("lang")).toDF("doc_id", "text", "lang")
    chosen, labels = sampled_texts(rows, "lang", 3, 600)
    assert labels == list(range(600)) and {r["count"] for r in chosen.groupBy("lang").count().collect()} == {3}
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6000") == 1  # one scan for all labels
    again = sampled_texts(rows.repartition(5), "lang", 3, 600)[0]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError, match="more than 599"):
        sampled_texts(rows, "lang", 3, 599)
    assert sampled_texts(rows.limit(0), "lang", 3, 5)[1] == []


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op5_quality"](spark, SF01).collect()}
    assert all(r["held_out"] == held_out(i) and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    unseen = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in unseen]) >= 0.95


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 0), (8, None), (9, 5), (None, 1)], "doc_id long, quality int")
    found = quality.classify_quality(awkward(spark), labels).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    blind = quality.classify_quality(awkward(spark), labels.limit(0)).collect()
    assert {r["score"] for r in blind} == {0.5}
    assert quality.classify_quality(awkward(spark, []), labels).collect() == []
    model = quality.learn(awkward(spark), labels, folds=1000)
    kept = quality.keep_good(awkward(spark), model, threshold=0.0)
    assert kept.schema.names == awkward(spark).schema.names and kept.count() == len(AWKWARD)
    assert quality.keep_good(awkward(spark), model, threshold=1.1).count() == 0


def test_gradient_of_the_bag_model():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 2, 5)]
    y, share = np.array([0.0, 1, 1, 0]), np.array([0.1, 0.2, 0.3, 0.4])
    model = quality.fit(bags, y, share, epochs=3)
    x, at = np.concatenate(bags), np.array([0, 1, 4, 6, 11])

    def loss() -> float:
        p = model.forward(x, at)[0]
        return float(-(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    p, kept = model.forward(x, at)
    assert np.allclose(np.add.reduceat(kept["attention"], at[:-1]), 1)
    gradient = model.gradient(p, y, share, at, kept)
    for name, w in model.weights.items():
        place = tuple(rng.integers(0, s) for s in w.shape)
        old, step = w[place], 1e-5
        w[place] = old + step
        up = loss()
        w[place] = old - step
        down = loss()
        w[place] = old
        assert abs((up - down) / (2 * step) - gradient[name][place]) < 1e-6


def test_words_alone_tell_documents_apart(spark):
    """Texts of the same characters, lengths and repeats, whose words differ."""
    rng = np.random.default_rng(2)
    forms = {1: ["stone", "melon", "rates"], 0: ["notes", "lemon", "stare"]}
    rows = [(i, " ".join(rng.permutation(forms[i % 2] * 5)), None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    found = quality.classify_quality(awkward(spark, rows), labels).collect()
    unseen = [r for r in found if r["held_out"]]
    assert len(unseen) > 60 and np.mean([(r["score"] >= 0.5) == r["doc_id"] % 2 for r in unseen]) >= 0.98


def test_one_good_passage_counts_wherever_it_stands(spark):
    """The label is that of one passage in six; attention must find it."""
    rng = np.random.default_rng(4)
    common = [f"w{i}" for i in range(40)]

    def text(label: int) -> str:
        parts = [" ".join(rng.choice(common, quality.PASSAGE_WORDS)) for _ in range(6)]
        parts[rng.integers(6)] = " ".join(rng.choice(["golden", "silver"] if label else ["muddy", "rusty"], quality.PASSAGE_WORDS))
        return " ".join(parts)

    rows = [(i, text(i % 2), None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    found = [r for r in quality.classify_quality(awkward(spark, rows), labels).collect() if r["held_out"]]
    assert np.mean([(r["score"] >= 0.5) == r["doc_id"] % 2 for r in found]) >= 0.95


def test_fit_takes_few_passages_of_a_long_document(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda bags, y, shares: taken.extend(len(b) for b in bags))
    rows = [(1, "word " * (quality.PASSAGE_WORDS * 500), None), (3, "a b", None)]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    quality.learn(awkward(spark, rows), labels, folds=1000)
    assert sorted(taken) == [1, quality.FIT_PASSAGES]


def test_long_documents_are_bags_of_all_their_passages():
    import pyarrow as pa

    texts = ["a b " * 100, "", "x"]
    features, at = quality.passages(*text_column(pa.array(texts, pa.large_string())))
    assert np.diff(at).tolist() == [4, 1, 1] and features.shape == (6, quality.FEATURES)
    assert np.isfinite(features).all()


def plain_features(raw: bytes) -> list[list[float]]:
    """The features of a document's passages, word by word and byte by byte."""
    spaces = b" \t\n\x0b\x0c\r"
    spans, start = [], None
    for i, b in enumerate(raw + b" "):
        if b in spaces and start is not None:
            spans.append((start, i))
            start = None
        elif b not in spaces and start is None:
            start = i
    cuts = list(range(0, len(spans), quality.PASSAGE_WORDS)) or [0]
    rows = []
    for k, cut in enumerate(cuts):
        own = spans[cut : cut + quality.PASSAGE_WORDS]
        begin = spans[cut][0] if k else 0
        end = spans[cuts[k + 1]][0] if k + 1 < len(cuts) else len(raw)
        words, some = [raw[a:b] for a, b in own], max(1, len(own))
        row = [0.0] * quality.FEATURES
        for b in raw[begin:end]:
            row[quality._KIND[b]] += 1
        row[: quality.KINDS] = [(c / max(1, end - begin)) ** 0.5 for c in row[: quality.KINDS]]
        lower = [w.lower() for w in words]
        row[quality.KINDS : quality.PLAIN] = [
            np.log1p(len(own)),
            sum(map(len, words)) / some / 10,
            (sum(len(w) ** 2 for w in words) / some) ** 0.5 / 10,
            (len(lower) - len(set(lower))) / some,
            sum(a == b for a, b in zip(lower, lower[1:])) / some,
            sum(65 <= w[0] <= 90 for w in words) / some,
            sum(w[-1] in quality.SIGNS for w in words) / some,
        ]
        for w in lower:
            data = np.frombuffer(w, np.uint8)
            key = span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0]
            row[quality.PLAIN + int(key % np.uint64(quality.WORDS))] += 1
        row[quality.PLAIN :] = [(c / some) ** 0.5 for c in row[quality.PLAIN :]]
        rows.append(row)
    return rows


def test_features_and_scores_against_a_plain_version():
    import pyarrow as pa

    texts = [t or "" for _, t, _ in AWKWARD][:8] + ["One, two; two THREE.\n" * 40, "  lead and trail \t", "é ü! É ü?", "x " * 64, "x " * 65]
    x, at = quality.passages(*text_column(pa.array(texts, pa.large_string())))
    plain = [plain_features(t.encode()) for t in texts]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    assert np.allclose(x, [row for p in plain for row in p], atol=1e-5)

    model = quality.fit([x[a:b] for a, b in zip(at, at[1:])], np.arange(len(texts)) % 2.0, np.ones(len(texts)), epochs=5)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    for score, p in zip(model.forward(x, at)[0], plain):
        hidden = [np.tanh(np.clip((np.array(row) - model.mean) / model.scale, -8, 8) @ w["E"] + w["e"]) for row in p]
        gates = [float(w["a"] @ (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"]))))) for h in hidden]
        weights = np.exp(gates) / np.exp(gates).sum()
        z = sum(a * h for a, h in zip(weights, hidden))
        assert score == pytest.approx(1 / (1 + np.exp(-float(z @ w["c"] + w["b"][0]))), abs=1e-4)
