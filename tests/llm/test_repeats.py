from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, SF, awkward, documents
from tiffin.llm.queries import QUERIES
from tiffin.llm.repeats import common_prefixes, longest_previous, repeated_passages, runs_of, sliding_least


def brute(rows: list[tuple], length: int, keep_first: bool) -> list[tuple]:
    """For rows in text order: id, spans and kept bytes."""
    seen = defaultdict(list)
    for d, (_, t) in enumerate(rows):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((d, i))
    out = []
    for d, (doc, t) in enumerate(rows):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            at = seen[t[i : i + length]]
            if at[0] != (d, i) if keep_first else len(at) > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((doc, spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def check(spark, texts: list[str], length: int, keep_first: bool, **more) -> None:
    docs = awkward(spark, [(i, t, None) for i, t in enumerate(texts)])
    found = repeated_passages(docs, length=length, keep_first=keep_first, with_kept=True, **more).orderBy("doc_id").collect()
    expected = brute([(i, t.encode()) for i, t in enumerate(texts)], length, keep_first)
    assert len(found) == len(expected)
    for r, (doc, spans, kept) in zip(found, expected):
        assert (r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) == (doc, spans, kept)
        assert r["n_removed"] == sum(b - a for a, b in spans) and r["n_bytes"] == len(texts[doc].encode())
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def planted(seed: int, n: int = 40) -> list[str]:
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefghij é") for _ in range(k))
    shared = [noise(k) for k in (99, 100, 101, 130, 300)]
    texts = [noise(rng.randint(0, 200)) + rng.choice(shared)[rng.randint(0, 3) :] + noise(rng.randint(0, 200)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1][5:], "ab" * 200, "b" * 350, "x" * 99, "x" * 100, "xyz" * 90 + noise(30) + "xyz" * 90]
    return texts


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("class_limit", [1000, 3, 0])
def test_planted_passages(spark, keep_first, class_limit):
    """A limit of 3, and of 0, sends anchors through stretches and single windows."""
    check(spark, planted(class_limit), 100, keep_first, class_limit=class_limit)


def test_query(spark):
    docs = documents(spark)
    expected = {d: (s, k) for d, s, k in brute([(i, t.encode()) for i, t in docs.items()], 400, False)}
    for r in QUERIES["op10_repeated_passages"](spark, SF).collect():
        spans, kept = expected[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(docs[r["doc_id"]].encode()), sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_awkward_rows(spark):
    for keep_first in (False, True):
        found = repeated_passages(awkward(spark), keep_first=keep_first, with_kept=True).collect()
        assert len(found) == len(AWKWARD)
        long = next(r for r in found if r["doc_id"] == 7)
        assert long["n_bytes"] == 24000 and long["n_removed"] == (24000 if not keep_first else 24000 - 8)
        assert all(r["n_removed"] == 0 and r["spans"] == [] for r in found if r["doc_id"] != 7)
        assert repeated_passages(awkward(spark, []), keep_first=keep_first).collect() == []
    twice = awkward(spark, [(None, "q" * 50 + "r" * 400, None), (None, "q" * 50 + "r" * 400, None)])
    assert sorted(r["n_removed"] for r in repeated_passages(twice).collect()) == [0, 450]
    with pytest.raises(ValueError):
        repeated_passages(twice, length=20)


def shared(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("text", [b"a", b"aaaaaaa", b"abab" * 6, b"mississippi", bytes(random.Random(3).choices(b"ab", k=200))])
@pytest.mark.parametrize("cap", [1, 3, 50])
def test_factors_are_the_longest_earlier_and_later_matches(text, cap):
    n = len(text)
    padded = text + bytes(200 + i % 50 for i in range(cap))  # suffixes end in bytes of their own
    at = np.arange(n)
    prefix = [padded[i : i + cap] for i in range(n)]
    order = np.array(sorted(range(n), key=prefix.__getitem__))
    common = common_prefixes(np.frombuffer(padded, np.uint8), at[order], cap, block=7)
    assert common.tolist() == [0, *(shared(prefix[a], prefix[b]) for a, b in zip(order, order[1:]))]
    earlier = [max((shared(prefix[i], prefix[j]) for j in range(i)), default=0) for i in range(n)]
    later = [max((shared(prefix[i], prefix[j]) for j in range(i + 1, n)), default=0) for i in range(n)]
    assert longest_previous(order, common).tolist() == earlier
    assert longest_previous(n - 1 - order, common)[::-1].tolist() == later


def test_no_table_is_left_behind(spark, monkeypatch):
    before = spark.catalog.listTables()
    repeated_passages(awkward(spark)).collect()
    assert spark.catalog.listTables() == before
    monkeypatch.setattr("tiffin.llm.repeats.marks_of", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        repeated_passages(awkward(spark))
    assert spark.catalog.listTables() == before


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[1000:2500] = 97
    offsets = np.array([0, 0, 30, 900, 900, 4000, 5000])
    r = runs_of(data, offsets, 100)
    windows = sorted((d, s + i) for d, s, n in zip(r["doc"], r["start"], r["starts"]) for i in range(n))
    expected = [(d, i) for d, (a, b) in enumerate(zip(offsets, offsets[1:])) for i in range(b - a - 99)]
    assert windows == expected
    assert (r["anchor"] >= r["starts"] - 1).all()
    values = rng.integers(0, 2**64, 333, dtype=np.uint64)
    assert sliding_least(values, 37).tolist() == [values[i : i + 37].min() for i in range(333 - 36)]
