from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tests.llm.helpers import AWKWARD, SF, awkward, documents
from tiffin.llm.periodic import periodic_runs, shortest_prefix
from tiffin.llm.queries import QUERIES


def split(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(words: list[str], exponent: int, least: int) -> list[tuple[int, int, int]]:
    """For every period, the maximal stretches of words equal q apart; those
    whose smallest period is q, by start, then period."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.append((i, j + q - i, q))
            i = j
    smallest = [(s, k, q) for s, k, q in found if not any(p < q and b <= s and s + k <= b + m for b, m, p in found)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def contract(doc_id: int, text: str) -> tuple:
    words, h = split(text), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 4, 6)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed(words, runs))]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_query_against_brute_force(spark):
    docs = {d: t for d, t in documents(spark).items() if len(t) < 20000}
    found = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(found) >= len(docs) > 100
    for d, t in docs.items():
        assert found[d] == contract(d, t), d
    assert sum(r[1] > 0 for r in found.values()) > 10


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 12), (2, 9)])
def test_random_words(spark, exponent, least):
    rng = random.Random(exponent * 100 + least)
    texts = []
    for _ in range(120):
        letters = "ab" if rng.random() < 0.5 else "abcdef"
        texts.append(" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
    for _ in range(80):  # runs within runs, next to each other, at both ends
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        words = (unit * 12)[: rng.randint(1, 60)]
        inner = words + [rng.choice("abcd")] * rng.randint(0, 9)
        texts.append(" ".join([rng.choice("abcd") for _ in range(rng.randint(0, 5))] + inner * rng.randint(1, 5) + words))
    rows = [(i, t, None) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in periodic_runs(awkward(spark, rows), exponent=exponent, least=least).collect()}
    for i, t in enumerate(texts):
        runs = brute(split(t), exponent, least)
        assert [tuple(r) for r in found[i]["runs"]] == runs, t
        assert found[i]["collapsed"] == collapsed(split(t), runs) and found[i]["n_words"] == len(split(t))


def test_awkward_rows(spark):
    found = periodic_runs(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in found}
    assert tuple(by_id[7]["best"]) == (0, 6000, 2) and by_id[7]["collapsed"] == "the cat"
    assert all(r["runs"] == [] and r["best"] is None for r in found if r["doc_id"] != 7)
    assert by_id[8]["collapsed"] == dict((i, t) for i, t, _ in AWKWARD)[8] and by_id[5]["collapsed"] == ""
    assert periodic_runs(awkward(spark, [])).collect() == []
    assert "collapsed" not in periodic_runs(awkward(spark), with_text=False).columns
    with pytest.raises(ValueError):
        periodic_runs(awkward(spark), exponent=1)


def test_shortest_prefix():
    for exponent in (2, 3, 4, 7):
        for least in (1, 2, 6, 12, 40):
            assert shortest_prefix(exponent, least) == min(max(least, exponent * q) - q for q in range(1, 200))
