"""Personal data with offset-preserving deobfuscation.

Identifiers are found twice: in the text as it stands (the *base* spans), and
in a normalised copy that transducers make of it.  The first transducer
rewrites characters (homoglyphs, full-width and other digits, invisible characters); the
second rewrites disguises (``name (at) host (dot) org``, ``192[.]0[.]2[.]1``,
digits spelled as words).  Both keep, for every character they write, the span
of source characters it came from, so what is found in the copy is mapped
back to source offsets.

Every pattern runs in linear time: quantifiers are possessive or bounded, and
the part of an address before its ``@`` is found by walking back from it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tiffin.llm.common import id_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like the ASCII letter below them.
LOOKALIKES = (
    "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρτυιкԚԜӏɑɡɩʏᴏᴜᴠᴡᴢ",
    "ABCEHIJKMOPSTXYaceijopsxyhdqwABEZHIKMNOPTYXoavptuikQWlagiyouvwz",
)
# Signs that stand for an ASCII sign.
SIGNS = {"@": "﹫", ".": "。．․｡﹒·", "-": "‐‑‒–—―−﹣", " ": "              　", "+": "﹢➕"}
# Characters that are not seen.
UNSEEN = "­​‌‍⁠﻿"
# Digits as words, by language, from 0 to 9.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
# How the signs of an address are read out.
AT_WORDS = "at arroba arobase arrobase"
DOT_WORDS = "dot punkt punto point"

DIGIT_OF = {w: str(i) for words in DIGIT_WORDS for i, w in enumerate(words.split())}
_at, _dot = "|".join(AT_WORDS.split()), "|".join(DOT_WORDS.split())
_word = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
_gap, _some = r"\s{0,3}", r"\s{1,3}"
CLOSED_AT = rf"{_gap}[(\[{{<]{_gap}(?:{_at}|@){_gap}[)\]}}>]{_gap}"
CLOSED_DOT = rf"{_gap}[(\[{{<]{_gap}(?:{_dot}|\.){_gap}[)\]}}>]{_gap}"
OPEN_AT, OPEN_DOT = rf"{_some}(?:{_at}){_some}", rf"{_some}(?:{_dot}){_some}"
_part, _label = r"[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
_hidden = rf"(?:{CLOSED_DOT}|{OPEN_DOT})"
_before = rf"(?<![A-Za-z0-9._%+-]){_part}(?:{_hidden}{_part}){{0,4}}"
DISGUISE = re.compile(
    rf"{_before}{CLOSED_AT}{_label}(?:(?:\.|{_hidden}){_label}){{1,6}}"
    rf"|{_before}{OPEN_AT}{_label}{_hidden}{_label}(?:(?:\.|{_hidden}){_label}){{0,5}}"
    rf"|{_before}@{_label}{_hidden}{_label}(?:{_hidden}{_label}){{0,5}}"
    rf"|(?<![0-9])[0-9]{{1,3}}(?:{_hidden}[0-9]{{1,3}}){{3}}(?![0-9])",
    re.IGNORECASE,
)
SIGN_IN_DISGUISE = re.compile(rf"(?P<at>{CLOSED_AT}|{OPEN_AT})|(?P<dot>{CLOSED_DOT}|{OPEN_DOT})", re.IGNORECASE)
SPELLED = re.compile(
    rf"\b(?:plus[\s,-]{{1,3}})?(?:{_word})(?:[\s,-]{{1,3}}(?:{_word}|{_dot}|[0-9]{{1,4}}(?![0-9]))){{2,}}\b", re.IGNORECASE
)
SPELLED_ITEM = re.compile(rf"(?P<plus>plus)|(?P<digit>{_word})|(?P<dot>{_dot})|(?P<number>[0-9]+)|(?P<gap>[\s,-]+)", re.IGNORECASE)
CLOSED = re.compile(rf"[(\[{{<]{_gap}(?:{_at}|{_dot}|[@.]){_gap}[)\]}}>]", re.IGNORECASE)

# Quick tests on the bytes of a text, which spare most texts the patterns above.
#: ASCII letters in lower case, digits and other bytes as they are, all else a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
NO_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_shapes = {w.encode() for word in DIGIT_OF for w in (word, *(word.replace(c, c.upper()) for c in word if not c.isascii()))}
DOTS = frozenset(DOT_WORDS.encode().split())


def hints(raw: bytes) -> tuple[bool, bool]:
    """Whether the bytes may hold a disguise, and whether they may hold
    three neighbouring digit words (dot words and numbers may follow the first)."""
    words = raw.translate(PLAIN).split()
    disguise = not DOTS.isdisjoint(words)
    if _shapes.isdisjoint(words):
        return disguise, False
    run = 0
    for w in words:
        if w in _shapes:
            run += 1
        elif run and (w in DOTS or w.isdigit()):
            run += 1
        else:
            run = 0
        if run >= 3:
            return disguise, True
    return disguise, False


@lru_cache(maxsize=1)
def rewritten() -> tuple[dict[int, str], frozenset[str], bytes]:
    """The character transducer, the characters it changes, and the bytes
    that begin none of these."""
    table = dict(zip(map(ord, LOOKALIKES[0]), LOOKALIKES[1]))
    for sign, others in SIGNS.items():
        table |= {ord(c): sign for c in others}
    for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474)]:
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isascii():
            table[c] = plain
    for c in range(0x660, 0x11000):
        digit = unicodedata.decimal(chr(c), None)
        if digit is not None:
            table[c] = str(digit)
    table |= {ord(c): "" for c in UNSEEN}
    leads = {chr(c).encode()[0] for c in table}
    return table, frozenset(map(chr, table)), bytes(b for b in range(256) if b not in leads)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done = 0
    if "@" not in text:
        return
    for m in HOST.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            done = m.end()


def addresses(text: str) -> Iterator[Span]:
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def found_in(text: str) -> list[Span]:
    n_digits = len(text.encode("utf-8", "replace").translate(None, NO_DIGIT))
    found = [*emails(text)]
    if n_digits >= 4:
        found += addresses(text)
    if n_digits >= 10:
        found += [*cards(text), *phones(text)]
    return found


def normalise(text: str) -> tuple[str, list[int], list[int]] | None:
    """The normalised copy with the source start and end of each of its
    characters, or None if no transducer changes anything."""
    table, changed, others = rewritten()
    copy, starts, ends = text, None, None
    if not text.isascii() and text.encode("utf-8", "replace").translate(None, others) and not changed.isdisjoint(text):
        out, starts = [], []
        for i, c in enumerate(text):
            to = table.get(ord(c), c)
            if to:
                out.append(to)
                starts.append(i)
        copy = "".join(out)
        ends = [i + 1 for i in starts]
    disguise, digits = hints(copy.encode("utf-8", "replace"))
    if not disguise and any(c in copy for c in "([{<"):
        disguise = CLOSED.search(copy) is not None
    matches = list(DISGUISE.finditer(copy)) if disguise else []
    if digits:
        matches += SPELLED.finditer(copy)
    if not matches:
        return (copy, starts, ends) if starts is not None else None
    starts = list(range(len(copy))) if starts is None else starts
    ends = [i + 1 for i in starts] if ends is None else ends
    out, from_, to_, at = [], [], [], 0

    def write(piece: str, a: int, b: int) -> None:
        """``piece`` stands for copy[a:b]; of equal length, character by character."""
        out.append(piece)
        if len(piece) == b - a:
            from_.extend(starts[a:b])
            to_.extend(ends[a:b])
        else:
            from_.extend([starts[a]] * len(piece))
            to_.extend([ends[b - 1]] * len(piece))

    for m in sorted(matches, key=lambda m: m.start()):
        if m.start() < at:
            continue
        write(copy[at : m.start()], at, m.start())
        at = m.start()
        if m.re is DISGUISE:
            for sign in SIGN_IN_DISGUISE.finditer(copy, m.start(), m.end()):
                write(copy[at : sign.start()], at, sign.start())
                write("@" if sign["at"] else ".", sign.start(), sign.end())
                at = sign.end()
        else:
            for piece, a, b in spelled(copy, m.start(), m.end()):
                write(piece, a, b)
                at = b
        write(copy[at : m.end()], at, m.end())
        at = m.end()
    write(copy[at:], at, len(copy))
    return "".join(out), from_, to_


def spelled(copy: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Digits for their words; gaps go, unless a number stands beside them."""
    items = list(SPELLED_ITEM.finditer(copy, start, end))
    for i, m in enumerate(items):
        if m["gap"]:
            beside = items[i - 1 : i + 2 : 2]
            yield (" " if any(x["number"] for x in beside) else ""), m.start(), m.end()
        elif m["plus"]:
            yield "+", m.start(), m.end()
        elif m["dot"]:
            yield ".", m.start(), m.end()
        else:
            yield (m["number"] or DIGIT_OF[m["digit"].lower()]), m.start(), m.end()


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the normalised copy shows; both by
    start, then kind, then end, as source code points with exclusive ends."""
    base = found_in(text)
    added: list[Span] = []
    seen = normalise(text)
    if seen:
        copy, starts, ends = seen
        for kind, a, b in found_in(copy):
            span = (kind, starts[a], max(ends[a:b]))
            if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in base):
                added.append(span)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(set(added), key=order)


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: spans with kind, start, end (code
    points) and whether the base patterns alone find them, in order.

    Null and empty texts have no spans.  Ids may be null or repeated; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = spans_of(text)
                both = [(*s, True) for s in base] + [(*s, False) for s in added]
                both.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append([dict(zip(("kind", "start", "end", "base"), s)) for s in both])
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, _SPANS_ARROW)], names=["doc_id", "spans"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str) -> str:
    """The text with each span, overlapping ones together, as ``[KIND]``."""
    out, at, upto, name = [], 0, -1, ""
    base, added = spans_of(text)
    for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if start < upto:
            upto = max(upto, end)
            continue
        if upto >= 0:
            out.append(f"[{name}]")
            at = upto
        out.append(text[at:start])
        upto, name = end, kind.upper()
    if upto >= 0:
        out.append(f"[{name}]")
        at = upto
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, personal data in ``text_col``
    replaced by the name of its kind, and ``length_col``, if the input has
    it, set to the new length in code points where the text changed.  Null
    texts stay null."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            old = columns[text_col].to_pylist()
            new = [None if t is None else redacted(t) for t in old]
            columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
            if length_col in columns:
                lengths = columns[length_col].to_pylist()
                fresh = [n if a == b else len(b) for a, b, n in zip(old, new, lengths)]
                columns[length_col] = pa.array(fresh, batch.schema.field(length_col).type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, fields)
