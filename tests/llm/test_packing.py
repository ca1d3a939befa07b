from __future__ import annotations

import itertools
import random
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, SF, awkward, documents
from tiffin.llm.packing import best_fit, candidates, cut_pieces, fillings, lower_bound, pack_pieces, place_rows, plan_bins
from tiffin.llm.queries import QUERIES, vocabulary_path


def check_plan(plan, counts, capacity):
    used = defaultdict(int)
    for times, filling in plan:
        assert times > 0 and sum(filling) <= capacity
        for x in filling:
            used[x] += times
    assert dict(used) == {x: n for x, n in counts.items() if n}


def fewest(items: list[int], capacity: int) -> int:
    best = len(items)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1 :])
        go(i + 1, bins + [items[i]])

    go(0, [])
    return best


def test_plans_are_whole_and_near_the_optimum():
    random.seed(6)
    over = 0
    for _ in range(150):
        capacity = random.choice([10, 20, 50])
        items = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 9))), reverse=True)
        counts = {x: items.count(x) for x in items}
        plan = plan_bins(counts, capacity)
        check_plan(plan, counts, capacity)
        check_plan(best_fit(counts, capacity), counts, capacity)
        optimum, bins = fewest(items, capacity), sum(t for t, _ in plan)
        assert lower_bound(counts, capacity) <= optimum <= bins <= sum(t for t, _ in best_fit(counts, capacity))
        over += bins - optimum
    assert over == 0


def test_fillings_are_undominated():
    counts = {5: 1, 4: 2, 3: 1, 2: 1}
    found = fillings(counts, 9, 9, 100)
    assert found[0] == (5, 4) and all(sum(f) <= 9 for f in found)
    for f in found:
        rest = dict(counts)
        for x in f:
            rest[x] -= 1
        assert not any(n and x <= 9 - sum(f) for x, n in rest.items())
    sums = {sum(c) for k in range(5) for c in itertools.combinations([5, 4, 4, 3, 2], k)}
    assert {sum(f) for f in found} <= sums


def test_candidates_are_all_fillings():
    random.seed(8)
    for _ in range(40):
        items = [random.randint(1, 12) for _ in range(random.randint(0, 8))]
        counts, space, allowed = {x: items.count(x) for x in items}, random.randint(0, 20), random.randint(0, 5)
        looked = list(candidates(counts, space, allowed))
        subsets = {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
        fitting = [f for f in subsets if space - allowed <= sum(f) <= space]
        assert len(looked) == len(fitting)  # each once, the dominated ones as None
        own = [f for f in looked if f is not None]
        assert len(own) == len(set(own)) and set(own) <= set(fitting)
        assert [space - sum(f) for f in own] == sorted(space - sum(f) for f in own)
        for f in own:
            assert not any(items.count(x) > f.count(x) and x <= space - sum(f) for x in items)


def test_many_lengths_do_not_recurse_deeply():
    counts = {x: 1 for x in range(1, 3001)}
    assert fillings(counts, 3000, 0, 1) == [(3000,)]
    assert next(f for f in candidates({x: 2 for x in range(2, 3001, 2)} | {1: 1}, 2999, 0)) == (2998, 1)
    plan = plan_bins(counts, 3000, nodes=200)
    check_plan(plan, counts, 3000)


def test_ranks_take_every_place_once():
    plan = [(3, (5, 2, 2)), (1, (5,)), (2, (2, 2, 2, 1))]
    at = defaultdict(list)
    for length, low, times, first, offset in place_rows(plan):
        copies = next(f for t, f in plan if t == times).count(length)
        for rank in range(low, low + times * copies):
            after = rank - low
            at[first + after % times].append((offset + after // times * length, length))
    assert sorted(at) == list(range(6))
    assert sorted(tuple(x for _, x in sorted(b)) for b in at.values()) == sorted([(5, 2, 2)] * 3 + [(5,)] + [(2, 2, 2, 1)] * 2)
    for b in at.values():
        assert all(o == sum(x for q, x in b if q < o) for o, _ in b)


def test_one_length_holds_most_pieces(spark):
    """20,000 empty documents beside 60 others: each piece has one place."""
    rows = [(1, "a")] * 20_000 + [(900 + k, "b") for k in range(60)]
    found = pack_pieces(spark.createDataFrame(rows, "length long, name string"), capacity=1024).collect()
    assert sorted((r["length"], r["name"]) for r in found) == sorted(rows)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        ends = [0, *(o + n for o, n in sorted(s))]
        assert ends[:-1] == [o for o, _ in sorted(s)] and ends[-1] <= 1024
    assert len(sequences) == -(-sum(x for x, _ in rows) // 1024)


def test_clashing_names_are_kept(spark):
    names = ["_row", "_part", "_base", "_place", "_seat", "_n", "_first", "_Low", "a.b"]
    docs = spark.createDataFrame([(k % 3 + 5, *[f"{c}{k}" for c in names]) for k in range(30)], ["length", *names])
    found = pack_pieces(docs, capacity=20)
    assert found.columns == [*docs.columns, "sequence_id", "offset"]
    assert sorted(found.select(*[f"`{c}`" for c in docs.columns]).collect()) == sorted(docs.collect())


def check_packing(rows, texts):
    """Gapless sequences, pieces that add up to their document, checksums."""
    tokenizer = Tokenizer.from_file(vocabulary_path())
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [2]
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (k, at)
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
            assert k == 0 or length == 1024
            at += length
        assert at == len(ids) and (len(ids) > 1024 or len(own) == 1)
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 1024) + 2
    return len(sequences)


def test_query(spark):
    check_packing(QUERIES["op2_best_fit_packing"](spark, SF).collect(), documents(spark))


def test_awkward_rows(spark):
    unique = [r for k, r in enumerate(AWKWARD) if k != 2]
    pieces = cut_pieces(awkward(spark, unique), vocabulary_path(), keep_ids=True)
    rows = pack_pieces(pieces).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
    check_packing(rows, {i: t or "" for i, t, _ in unique})
    repeated = pack_pieces(cut_pieces(awkward(spark, [(1, "a", None)] * 5), vocabulary_path())).collect()
    assert sorted(r["offset"] for r in repeated) == [0, 2, 4, 6, 8]
    assert pack_pieces(cut_pieces(awkward(spark, []), vocabulary_path())).collect() == []


def test_bad_input(spark):
    with pytest.raises(ValueError):
        pack_pieces(spark.createDataFrame([(2000,)], "length long"))
    with pytest.raises(ValueError):
        pack_pieces(spark.createDataFrame([(20, 1)], "length long, offset long"))
