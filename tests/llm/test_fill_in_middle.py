from __future__ import annotations

import hashlib
import random

import pytest

from tests.llm.helpers import AWKWARD, SF, awkward, documents
from tests.oracle_check import compare, duck
from tiffin.llm.fill_in_middle import Scanner, choice, fill_in_middle, restore
from tiffin.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text: str | None) -> tuple:
    """The contract, written down directly."""
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text), text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha(out := "<S>" + s + "<P>" + p + "<M>" + m), sha(text), out)
    return (doc_id, n, "psm", a, b - a, sha(out := "<P>" + p + "<S>" + s + "<M>" + m), sha(text), out)


def test_query_against_the_plain_rule(spark):
    expected = {d: plainly(d, t)[:7] for d, t in documents(spark).items()}
    found = [tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, SF).collect()]
    assert {r[0]: r for r in found} == expected and len(found) == len(expected)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_query_against_sql(spark):
    ok, message = compare(spark, duck(SF01), "op12_fill_in_middle", SF01)
    assert ok, message


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_awkward_rows_and_chunks(spark, chunk):
    rows = AWKWARD + [(100 + i, t, None) for i, t in enumerate(["a<P>b", "<", "<<P", "x<S", "P>", ">", "<M", "é<P" * 9])]
    rows += [(7 + 50 * i, "the <P <S <M> " * 3, None) for i in range(3)] + [(11, "same text", None)] * 20
    rows = [(i, t if t is None or chunk > 9 else t[:200], lang) for i, t, lang in rows]
    found = fill_in_middle(awkward(spark, rows), chunk=chunk, with_output=True).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted((plainly(i, t) for i, t, _ in rows), key=key)
    for r in found:
        assert sha(restore(r["output"], r["form"])) == r["restored_sha256"]


def test_empty_table_and_other_ids(spark):
    assert fill_in_middle(awkward(spark, [])).collect() == []
    docs = spark.createDataFrame([("k", "words", 1), (None, None, 2)], "name string, body string, n int")
    found = {r["doc_id"]: r for r in fill_in_middle(docs, "name", "body", percent=100).collect()}
    assert found["k"]["form"] in ("psm", "spm") and found[None]["form"] == "plain"


def test_pieces_of_a_row_are_shuffled_once(spark):
    """The second sort keeps the partitioner of the first."""
    found = fill_in_middle(awkward(spark))
    lineage = found.rdd.toDebugString().decode()
    assert lineage.count("PairwiseRDD") == 1


def test_scanner_at_any_cut():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("<PSM>é ") for _ in range(rng.randint(1, 30)))
        if any(s in text for s in ("<P>", "<S>", "<M>")):
            continue
        _, low, high = choice(rng.random(), len(text))
        output = f"<S>{text[high:]}<P>{text[:low]}<M>{text[low:high]}".encode()
        scanner, parts, at = Scanner(False), {"P": b"", "M": b"", "S": b"", "T": b""}, 0
        while at < len(output):
            to = at + rng.randint(1, 4)
            for part, data in scanner.feed(output[at:to]):
                parts[part] += data
            at = to
        for part, data in scanner.close():
            parts[part] += data
        assert (parts["P"] + parts["M"] + parts["S"]).decode() == text and not parts["T"]
