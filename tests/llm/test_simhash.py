from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import AWKWARD, SF, awkward, components, documents
from tiffin.llm.common import Scratch
from tiffin.llm.queries import QUERIES
from tiffin.llm.simhash import fingerprints, index_links, simhash_components


def brute_fingerprint(text: str | None) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    found = fingerprints(awkward(spark)).collect()
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in found)
    assert got == sorted((str(i), brute_fingerprint(t)) for i, t, _ in AWKWARD)


def test_query_against_brute_force(spark):
    docs = documents(spark)
    ids = list(docs)
    prints = [brute_fingerprint(docs[i]) for i in ids]
    root = components(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, i), i)
    expected = {i: (f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, root)}
    found = QUERIES["op6_simhash_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == expected


@pytest.mark.parametrize("limit", [4, 64, 4096])
def test_links_of_crowded_lists(spark, limit):
    """Clusters around centres: lists over the limit are refined and blocked,
    and no link between components is lost or made up."""
    rng = np.random.default_rng(limit)
    prints = set()
    for centre in rng.integers(0, 2**64, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    edges = index_links(frame, 3, limit, Scratch(spark, "test")).collect()
    place = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    assert all((prints[place[e["a"]]] ^ prints[place[e["b"]]]).bit_count() <= 64 for e in edges)
    expected = components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    pairs = {frozenset((place[e["a"]], place[e["b"]])) for e in edges}
    got = components(len(prints), lambda a, b: frozenset((a, b)) in pairs)
    same = lambda c: {frozenset(i for i in range(len(c)) if c[i] == r) for r in set(c)}
    assert same(got) == same(expected)


def test_awkward_rows(spark):
    found = simhash_components(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    blank = {r["doc_id"]: r for r in found if r["fingerprint"] == "0" * 16}
    assert set(blank) == {3, 4, 5} and {r["component_id"] for r in blank.values()} == {3}
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert simhash_components(awkward(spark, [])).collect() == []
    alone = simhash_components(awkward(spark, [(None, "a b c d", None), (None, "q r s t u", None)])).collect()
    assert len({r["component"] for r in alone}) == 2 and {r["component_id"] for r in alone} == {None}
