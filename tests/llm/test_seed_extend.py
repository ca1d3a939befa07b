from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, SF, awkward
from tiffin.llm.queries import QUERIES
from tiffin.llm.seed_extend import agreed, repeated_substrings, winnowed


def split(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def order(doc_id) -> tuple:
    return (doc_id is not None, doc_id or 0)


def brute(rows: list[tuple], length: int) -> list[tuple]:
    """Per row: id, number of words, removed words, spans, kept text."""
    first: dict = {}
    texts = [(i, split(t)) for i, t in rows]
    for i, words in texts:
        for a in range(len(words) - length + 1):
            key = tuple(words[a : a + length])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, words in texts:
        gone = np.zeros(len(words), bool)
        for a in range(len(words) - length + 1):
            if first[tuple(words[a : a + length])] < order(i):
                gone[a : a + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((i, len(words), int(gone.sum()), spans, " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def check(spark, rows: list[tuple], length: int, **more) -> None:
    docs = awkward(spark, [(i, t, None) for i, t in rows])
    found = repeated_substrings(docs, length=length, with_kept=True, **more).collect()
    got = [(r["doc_id"], r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept"]) for r in found]
    expected = brute(rows, length)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest() for r in found)


def planted(seed: int, length: int) -> list[tuple]:
    rng = random.Random(seed)
    noise = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyzé") + rng.choice("xyz") for _ in range(k)]
    shared = [noise(k) for k in (length - 1, length, length + 1, 2 * length, 5 * length)]
    texts = [noise(rng.randint(0, length)) + rng.choice(shared)[rng.randint(0, 3) :] + noise(rng.randint(0, length)) for _ in range(60)]
    # branches: a common stretch that goes on in two ways on either side, each way in several documents
    core, ways = noise(length // 2), [noise(length) for _ in range(4)]
    texts += [rng.choice(ways) + core + rng.choice(ways) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1][3:], ["ab"] * 3 * length, ["ab"] * 2 * length, (["ab", "cd"] * length)[: 2 * length], noise(length - 1)]
    texts += [["long" * 40 + str(i % 2)] + shared[3][: length + i] for i in range(4)]
    rng.shuffle(texts)
    rows = [(i, "\t \n".join(t) if i % 5 else " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(None, rows[3][1]), (None, rows[3][1]), (rows[7][0], rows[7][1]), (rows[8][0], rows[9][1] + " z")]


@pytest.mark.parametrize("length,gram", [(12, None), (12, 1), (12, 12), (50, None)])
def test_planted_passages(spark, length, gram):
    check(spark, planted(length + (gram or 0), length), length, gram=gram)


def test_hot_passage_and_copies(spark):
    """A third of all rows are one text, another third share a passage."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    one, passage = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(55))
    rows = [(i, one) for i in range(0, 600, 3)]
    rows += [(i, f"{word()} {word()} {passage} {word()} {i % 7}") for i in range(1, 600, 3)]
    rows += [(i, " ".join(word() for _ in range(70))) for i in range(2, 600, 3)]
    check(spark, rows, 50)


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = {r[0]: r for r in brute(docs, 50)}
    found = QUERIES["op13_substring_dedup"](spark, SF).collect()
    assert len(found) == len(docs) == len(expected)
    for r in found:
        _, n, gone, spans, kept = expected[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]]) == (n, gone, spans)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r["n_removed"] > 0 for r in found) > 5


def test_awkward_rows(spark):
    check(spark, [(i, t) for i, t, _ in AWKWARD], 50)
    check(spark, [(i, t) for i, t, _ in AWKWARD], 3)
    assert repeated_substrings(awkward(spark, [])).collect() == []
    names = spark.createDataFrame([("a", "x y z"), ("b", "x y z w")], "name string, body string")
    found = {r["doc_id"]: r["n_removed"] for r in repeated_substrings(names, "name", "body", length=3).collect()}
    assert found == {"a": 0, "b": 3}
    with pytest.raises(ValueError):
        repeated_substrings(awkward(spark), length=5, gram=6)


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 6, 4000).astype(np.uint64)
    words[500:900] = 3
    docs_at = np.array([0, 0, 30, 800, 800, 3000, 4000])
    r = winnowed(words, docs_at, 20, 6)
    windows = sorted(b + i for b, n in zip(r["begin"], r["starts"]) for i in range(n))
    assert windows == [w for a, b in zip(docs_at, docs_at[1:]) for w in range(a, b - 19)]
    assert (r["off"] >= r["starts"] - 1).all() and (r["off"] <= 14).all()


def test_agreement_goes_both_ways():
    own, leader = list("uvabcdxy"), list("wvabcdx")
    split_own, split_leader = [w.encode() for w in own], [w.encode() for w in leader]
    assert agreed(split_own, 2, split_leader, 2) == (1, 5)
    assert agreed(split_own, 3, split_leader, 2) == (0, 0)
