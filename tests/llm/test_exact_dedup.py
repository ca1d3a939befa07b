from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, SF, awkward
from tiffin.llm import exact_dedup as module
from tiffin.llm.exact_dedup import MAX_SPLITS, addressed, chained, directory, exact_dedup, first_depth
from tiffin.llm.queries import QUERIES


def test_awkward_rows(spark):
    found = exact_dedup(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    groups = defaultdict(list)
    for r in found:
        groups[r["text_sha256"]].append(r)
    cats = groups[hashlib.sha256(b"the cat sat on the mat").hexdigest()]
    assert {r["keep_id"] for r in cats} == {2} and {r["group_size"] for r in cats} == {3}
    assert sum(r["kept"] for r in cats) == 1  # one of the repeated rows
    empty = groups[hashlib.sha256(b"").hexdigest()]  # null is empty
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in empty) == [(3, 4, False), (4, 4, True)]
    assert all(sum(r["kept"] for r in g) == 1 for g in groups.values())


def test_null_ids_and_empty_table(spark):
    docs = awkward(spark, [(None, "a", None), (None, "a", None), (None, "b", None)])
    found = exact_dedup(docs).collect()
    assert sorted(r["group_size"] for r in found) == [1, 2, 2] and sum(r["kept"] for r in found) == 2
    assert exact_dedup(awkward(spark, [])).collect() == []


def test_directory_doubles_until_buckets_fit(spark):
    entries = spark.range(4000).select(F.xxhash64("id").alias("key"), F.lit("s").alias("sha"), F.lit(2).alias("n"), F.lit(1).alias("last"))
    start = first_depth(4000, 40)
    index = chained(addressed(entries, directory(entries, start, 40), start))
    sizes = {r["bucket"]: r["count"] for r in index.groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 40
    assert len({b.split("/")[0] for b in sizes}) > 1  # some buckets were split further than others
    depths = directory(entries, 7, 40).agg(F.min("depth"), F.max("depth")).first()
    assert 7 <= depths[0] < depths[1] <= 7 + MAX_SPLITS


def test_chains_hold_texts_that_collide(spark):
    rows = [(5, "b", 2, 1), (5, "a", 3, 2), (9, "c", 2, 3)]
    entries = spark.createDataFrame(rows, "key long, sha string, n long, last long")
    index = chained(addressed(entries, directory(entries, 2, 1), 2))
    links = {(r["key"], r["sha"]): r["link"] for r in index.collect()}
    assert links == {(5, "a"): 0, (5, "b"): 1, (9, "c"): 0}


def rows_of(found) -> list[tuple]:
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found.collect())


def test_colliding_keys_are_told_apart_by_their_bytes(spark, monkeypatch):
    """With three keys for all texts, hot and cold, chains alone keep them apart."""
    rows = [(i, f"text {i % 60}", None) for i in range(3000)] + [(5000, "only one", None)]
    docs = awkward(spark, rows)
    real = F.xxhash64
    expected = rows_of(exact_dedup(docs, bucket_entries=50))
    monkeypatch.setattr(module.F, "xxhash64", lambda c: F.pmod(real(c), F.lit(3)) if c == "text" else real(c))
    assert rows_of(exact_dedup(docs, bucket_entries=50)) == expected
    assert {(r[1], r[2]) for r in expected if r[0] < 60} == {(2940 + i, 50) for i in range(60)}


def test_the_index_decides(spark, monkeypatch):
    """Without the index's entries nothing is a copy; with a wrong address nothing is found."""
    docs = awkward(spark, [(i, f"text {i % 10}", None) for i in range(100)])
    monkeypatch.setattr(module, "chained", lambda entries: entries.withColumn("bucket", F.lit("elsewhere")).withColumn("link", F.lit(0)))
    assert all(r[2] == 1 for r in rows_of(exact_dedup(docs)))


def test_query_has_no_python(spark):
    plan = QUERIES["op3_exact_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
