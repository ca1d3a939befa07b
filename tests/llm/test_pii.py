from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from tests.llm.helpers import AWKWARD, SF, awkward, documents
from tiffin.llm.pii import KINDS, find_pii, luhn, normalise, redact_pii, redacted, spans_of
from tiffin.llm.queries import QUERIES


def brute(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@pytest.mark.parametrize("alphabet", ["ab@.-+ 1", "0123456789 -", "1250.. ", "+12 ().-3456789@a.b"])
def test_base_spans_on_random_texts(alphabet):
    random.seed(8)
    for _ in range(8000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
        assert spans_of(text)[0] == brute(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("john [at] mail.example.com", "email", "john [at] mail.example.com"),
        ("john dot doe at example dot co dot uk today", "email", "john dot doe at example dot co dot uk"),
        ("ana arroba correo punto es", "email", "ana arroba correo punto es"),
        ("jоhn@ехample.com", "email", "jоhn@ехample.com"),
        ("x foo＠bar.com", "email", "foo＠bar.com"),
        ("user@exam​ple.com", "email", "user@exam​ple.com"),
        ("ip 192[.]168[.]1[.]20 ok", "ip", "192[.]168[.]1[.]20"),
        ("on one nine two dot zero dot two dot one", "ip", "one nine two dot zero dot two dot one"),
        ("call plus one four three seven five five five zero six eight nine now", "phone", "plus one four three seven five five five zero six eight nine"),
        ("Karte ４１１１ １１１１ １１１１ １１１１!", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("four one one one" + " one" * 12 + " end", "card", "four one one one" + " one" * 12),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, added = spans_of(text)
    assert (kind, text.index(found), text.index(found) + len(found)) in added
    assert f"[{kind.upper()}]" in redacted(text)


@pytest.mark.parametrize("text", ["look at foo.bar and at the dot", "a@b.com point de vue", "the cat at dot", "un deux trois", "6 (at) night", "été à 5.5.5"])
def test_plain_texts_gain_nothing(text):
    assert spans_of(text) == (brute(text), [])


def test_offsets_of_the_copy_are_monotone():
    for text in ["а (at) b (dot) cо 1​2 three four five x", "one two three, four 5 six seven"]:
        copy, starts, ends = normalise(text)
        assert len(copy) == len(starts) == len(ends)
        assert all(0 <= a < b <= len(text) for a, b in zip(starts, ends)) and starts == sorted(starts)


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ["a" * 300_000, "1" * 300_000, "-1" * 100_000, "(" * 100_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "one " * 50_000]:
        spans_of(text)
    assert time.time() - began < 30


def test_query(spark):
    docs = documents(spark)
    for r in QUERIES["op9_pii"](spark, SF).collect():
        expected = brute(docs[r["doc_id"]])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in expected) for k in KINDS]
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_awkward_rows(spark):
    found = find_pii(awkward(spark)).collect()
    assert len(found) == len(AWKWARD) and all(r["spans"] == [] for r in found)
    assert find_pii(awkward(spark, [])).collect() == []
    docs = awkward(spark, [(1, "at a.b@c.de, 10.0.0.1", "en"), (1, "at a.b@c.de, 10.0.0.1", "en"), (None, None, None)])
    out = redact_pii(docs)
    assert out.schema.names == docs.schema.names
    assert sorted((str(r["text"]), r["n_chars"]) for r in out.collect()) == [("None", -1), ("at [EMAIL], [IP]", 16), ("at [EMAIL], [IP]", 16)]
