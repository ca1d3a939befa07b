from __future__ import annotations

import numpy as np
import pytest

from tiffin.llm import ann
from tiffin.llm.ann import Cells, chi_square_bound, leaves_of, nearest
from tiffin.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, vec int, cell string, point int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA).repartition(3)


def brute(ids, x, query, k=5):
    scores = (x * x[query]).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt(x[query] @ x[query])
    order = [i for i in np.lexsort((ids, -scores)).tolist() if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def recall(rows, ids, x, queries):
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in queries:
        best = brute(ids, x, q)
        assert len(got[ids[q]]) == len(best)
        hits += len({i for i, _ in best} & {i for i, _ in got[ids[q]]})
        exact = dict(brute(ids, x, q, len(ids)))
        assert all(abs(s - exact[i]) < 1e-12 for i, s in got[ids[q]])
        assert [s for _, s in got[ids[q]]] == sorted((s for _, s in got[ids[q]]), reverse=True)
    return hits / (5 * len(queries))


def test_query(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = QUERIES["op8_nearest_neighbours"](spark, SF01).collect()
    assert recall(found, ids, x, np.flatnonzero(ids % 50 == 0).tolist()) >= 0.9


def test_many_cells_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 40)
    monkeypatch.setattr(ann, "PART", 16)
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))).astype(np.float32)
    vectors = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    found = nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    assert recall(found, np.arange(600), x.astype(float), range(0, 600, 50)) >= 0.9


def test_queries_are_searched_in_bounded_groups(spark, monkeypatch):
    """All rows are queries, a third of them near one place, and none is lost between the groups."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 8)) + np.where(np.arange(150)[:, None] % 3 == 0, 6.0, 0.0)
    vectors = frame(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)])
    monkeypatch.setattr(ann, "CELL", 40)
    monkeypatch.setattr(ann, "PART", 30)
    monkeypatch.setattr(ann, "POSED", 7)
    found = sorted(map(tuple, nearest(vectors, vectors, confidence=1 - 1e-12).collect()))
    assert len(found) == 750
    assert recall([dict(zip(("query_id", "rank", "vec_id", "score"), r)) for r in found], np.arange(150), x.astype(np.float32).astype(float), range(150)) == 1.0


def test_one_vector_in_many_rows(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(100 + i, [0.0, 1.0, i / 9]) for i in range(9)]
    vectors = frame(spark, rows)
    found = nearest(vectors, vectors.where("vec_id in (3, 30, 104)")).collect()
    of = lambda q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(3) == [0, 1, 2, 4, 5] and of(30) == [0, 1, 2, 3, 4]
    x = np.array([v for _, v in rows])
    assert of(104) == [i for i, _ in brute(np.array([i for i, _ in rows]), x, 44)]


def answers(found):
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("cell", [ann.CELL, 20])
def test_repeated_rows_and_ids(spark, monkeypatch, cell):
    """Every row twice, one ten times, one id with many vectors, and one
    vector with many ids: own rows never take the places of others."""
    monkeypatch.setattr(ann, "CELL", cell)
    monkeypatch.setattr(ann, "PART", 16)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(4, 8))[rng.integers(0, 4, 60)] + 0.2 * rng.normal(size=(60, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(10 if i == 7 else 2)]
    rows += [(5, (x[5] + 0.01 * j).tolist()) for j in range(12)] + [(200 + j, x[9].tolist()) for j in range(8)]
    vectors = frame(spark, rows)
    queries = frame(spark, [(i, x[i].tolist()) for i in (5, 7, 9, 30)] + [(203, x[9].tolist())])
    got = answers(nearest(vectors, queries, confidence=1 - 1e-9).collect())
    ids, full = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    for q in (5, 7, 9, 30, 203):
        own = brute(ids, full, [i for i, _ in rows].index(q))
        assert [(r, i) for r, i, _ in got[q]] == [(r + 1, i) for r, (i, _) in enumerate(own)], q
        assert [s for _, _, s in got[q]] == pytest.approx([s for _, s in own])


def test_one_id_asked_with_two_vectors(spark):
    vectors = frame(spark, [(i, [1.0, i / 9]) for i in range(10)])
    queries = frame(spark, [(50, [1.0, 0.0]), (50, [1.0, 1.0])])
    found = nearest(vectors, queries, k=2).collect()
    assert sorted(r["vec_id"] for r in found) == [0, 1, 8, 9]


def test_queries_of_mixed_widths(spark):
    """Most queries have another width than the table."""
    vectors = frame(spark, [(i, [1.0, i / 9]) for i in range(10)])
    queries = frame(spark, [(0, [1.0, 0.0]), (60, [1.0]), (61, [2.0]), (62, [1.0, 1.0, 1.0])])
    assert [(q, i) for q, own in answers(nearest(vectors, queries, k=2).collect()).items() for _, i, _ in own] == [(0, 1), (0, 2)]


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (51, [0.0, 1.0]), (52, None), (53, [0.0, 0.0]), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [1.0]), (None, [1.0, 1.0]), (250, [1.0, None])]
    vectors = frame(spark, rows)
    found = nearest(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]
    assert found[0]["score"] == pytest.approx(1.0)
    none = frame(spark, [(0, [0.0]), (50, None)])
    assert nearest(none, none).collect() == []
    empty = vectors.limit(0)
    assert nearest(empty, empty).collect() == [] and nearest(vectors, empty).collect() == []
    one = frame(spark, [(0, [1.0])])
    assert nearest(one, one).collect() == []


def test_chi_square_bound():
    assert chi_square_bound(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    draws = np.random.default_rng(1).chisquare(8, 200_000)
    assert (draws <= chi_square_bound(0.9, 8)).mean() == pytest.approx(0.9, abs=0.005)


def test_trees_hold_every_point():
    points = np.random.default_rng(2).normal(size=(1000, ann.DIMENSIONS))
    points[:400] = points[0]
    assert sorted(np.concatenate(leaves_of(points)).tolist()) == list(range(1000))
    cells = Cells.fit(points, 4).of(points)
    assert cells.min() >= 0 and cells.max() < 16 and len(set(cells[:400].tolist())) == 1
