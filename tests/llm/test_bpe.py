from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, SF, awkward, documents
from tiffin.llm.bpe import decode, encode, encode_slice, merge_by_heap, vocabulary
from tiffin.llm.common import prefix_hash, span_hash, text_column
from tiffin.llm.queries import QUERIES, vocabulary_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def ours(texts: list[str]) -> list[list[int]]:
    ids, spread = encode_slice(vocabulary(vocabulary_path()), *text_column(pa.array(texts, pa.large_string())))
    return [ids[a:b].tolist() for a, b in zip(spread, spread[1:])]


def test_random_texts(tokenizer):
    random.seed(4)
    texts = ["", " ", "  \n x", "it's 'tis ''s don't're", "a <|endoftext|> b<|endof", "!" * 700, "ab" * 600, "x" * 5000, "\x1c \x85 　y"]
    texts += ["".join(random.choice("aets'! \n\t1é日<|endoftext|>rvml") for _ in range(random.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(chr(random.choice([random.randint(0, 0xD7FF), random.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(300)]
    assert ours(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_texts_do_not_touch(tokenizer):
    texts = ["the", "the", " the", "<|endof", "text|>", "it", "'s"]
    assert ours(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_certain_cuts_are_inside_no_token():
    v = vocabulary(vocabulary_path())
    assert not v.joined.all() and v.joined[ord("t"), ord("h")] and not v.joined[ord("a"), ord(" ")]
    for token in v.tokens:
        assert all(v.joined[a, b] for a, b in zip(token, token[1:]))


def test_heap_merges_like_the_library(tokenizer):
    random.seed(5)
    v = vocabulary(vocabulary_path())
    for _ in range(30):
        word = "".join(random.choice("abcdeh") for _ in range(random.randint(1, 400)))
        assert merge_by_heap(v, [int(v.of_byte[b]) for b in word.encode()]) == tokenizer.encode(word).ids


def test_query_and_round_trip(spark, tokenizer):
    import hashlib

    docs = documents(spark)
    for r in QUERIES["op7_bpe"](spark, SF).collect():
        ids = tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_awkward_rows(spark, tokenizer):
    found = decode(encode(awkward(spark), vocabulary_path()), vocabulary_path()).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in found) == sorted((str(i), t or "") for i, t, _ in AWKWARD)
    assert encode(awkward(spark, []), vocabulary_path()).collect() == []
    broken = spark.createDataFrame([(1, [447]), (2, None), (3, [])], "doc_id long, ids array<int>")
    texts = {r["doc_id"]: r["decoded"] for r in decode(broken, vocabulary_path()).collect()}
    assert texts == {1: tokenizer.decode([447], skip_special_tokens=False), 2: "", 3: ""}
    with pytest.raises(ValueError):
        decode(broken, vocabulary_path(), into="ids")


def thue_morse(n: int) -> tuple[str, str]:
    """A word of n letters and its complement: equal under polynomial hashes modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_with_equal_hashes_keep_their_own_ids(spark, tokenizer, n):
    one, other = thue_morse(n)
    data = np.frombuffer((one + other).encode(), np.uint8)
    hashes = span_hash(prefix_hash(data), np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] == hashes[1]  # the case is real
    texts = [one, other, one, f"{other} {one} {other}", "", "a"]
    assert ours(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    docs = awkward(spark, [(i, t, None) for i, t in enumerate(texts)]).coalesce(1)
    found = decode(encode(docs, vocabulary_path()), vocabulary_path()).collect()
    assert {r["doc_id"]: r["decoded"] for r in found} == dict(enumerate(texts))
