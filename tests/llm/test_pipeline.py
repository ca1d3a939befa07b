from __future__ import annotations

import tempfile

import corpus_pipeline as pipeline
from tests.llm.helpers import SF, awkward
from tests.llm.test_packing import check_packing
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_simhash import brute_fingerprint
from tests.llm.helpers import components
from tiffin.llm.quality import learn, score
from tiffin.llm.common import id_text


def written(spark, frame):
    path = tempfile.mkdtemp(prefix="pipeline-test-") + "/rows"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]

    scores = {r["doc_id"]: r["score"] for r in score(id_text(docs, "doc_id", "text"), learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    good = written(spark, stages["quality_classifier"](spark, docs, SF))
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.7}

    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    last = {}
    for i, t in texts.items():
        last[t] = max(last.get(t, i), i)
    single = written(spark, stages["exact_dedup"](spark, good, SF))
    assert {r["doc_id"] for r in single.collect()} == set(last.values())

    ids = sorted(last.values())
    prints = [brute_fingerprint(texts[i]) for i in ids]
    root = components(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, i), i)
    apart = written(spark, stages["simhash_near_dedup"](spark, single, SF))
    assert {r["doc_id"] for r in apart.collect()} == set(least.values())

    clean = written(spark, stages["pii"](spark, apart, SF))
    assert clean.count() == apart.count() and clean.schema.names == docs.schema.names
    for r in clean.collect():
        assert base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if base_spans(texts[r["doc_id"]]) == []:
            assert r["text"] == texts[r["doc_id"]]
    check_packing(stages["best_fit_packing"](spark, clean, SF).collect(), {r["doc_id"]: r["text"] for r in clean.collect()})


def test_run_is_the_stages_in_order(spark):
    rows = pipeline.run(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) > 100 and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_awkward_rows(spark):
    rows = [(1, "a cat", "en"), (1, "a cat", "en"), (None, "a cat", "en"), (None, None, None), (None, "", None), (2, "mail a@b.cd now please", "en"), (2, "one more text with this id", "en")]
    docs = written(spark, awkward(spark, rows))
    stages = dict(pipeline.STAGES)
    single = stages["exact_dedup"](spark, docs, SF)
    assert single.schema.names == docs.schema.names
    got = sorted((str(r["doc_id"]), str(r["text"] or "")) for r in single.collect())
    assert got == [("1", "a cat"), ("2", "mail a@b.cd now please"), ("2", "one more text with this id"), ("None", "")]
    apart = stages["simhash_near_dedup"](spark, docs, SF)
    assert apart.schema.names == docs.schema.names and apart.count() == 4
    clean = stages["pii"](spark, docs, SF)
    assert "mail [EMAIL] now please" in {r["text"] for r in clean.collect()} and clean.count() == len(rows)
    assert stages["best_fit_packing"](spark, docs, SF).count() == len(rows)
    good = stages["quality_classifier"](spark, docs, SF)
    assert good.schema.names == docs.schema.names
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name
