"""Fill-in-the-middle transformation by secondary sort.

A document is cut in three (prefix, middle, suffix, in code points) and written
with a sentinel before each part, in one of two orders: prefix, suffix, middle
(``psm``) or suffix, prefix, middle (``spm``); some documents stay ``plain``.

No task ever reorders a document as a whole.  The reading tasks emit pieces of at most
``chunk`` code points under the key (row, place in the output);
``repartitionAndSortWithinPartitions`` brings the pieces of a row to one
partition in output order, where they stream into an incremental digest.
Restoration reads that output as a stream: a scanner finds the sentinels, the
pieces get the key (row, place in the original), and they are sorted again in the same
partition (the partitioner is the same, so nothing is shuffled twice).
Sorting spills to disk, so a task holds pieces, not documents.

Rows are numbered where they are read, so copies of a text and rows of one id
are spread over all partitions.  The numbers need an input that reads the same when a
lost task is repeated, as tables do; write other inputs to a table first.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiffin.llm.common import id_text

#: The sentinels, and the order of the parts in each form.
SENTINELS = {"P": "<P>", "S": "<S>", "M": "<M>"}
FORMS = {"psm": "PSM", "spm": "SPM"}

#: Text that one partition assembles, however the input is cut.
PART_BYTES = 64 << 20

#: Order of the parts in the original text (T: a plain text).
_PLACE = {"T": 0, "P": 0, "M": 1, "S": 2}
_MARK = re.compile(b"<([PSM])>")
_END = 9


def has_sentinel(text: str) -> bool:
    return any(s in text for s in SENTINELS.values())


def choice(doc_id: object, n: int, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> tuple[str, int, int]:
    """Form and the two cuts of a text of n code points, from the SHA-256 of
    ``seed:doc_id`` (a null id counts as ''): the same on every run."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h3 % 100 >= percent:
        return "plain", low, high
    return ("spm" if h4 % 100 < spm_percent else "psm"), low, high


def packed(text: str) -> bytes:
    """A piece as compressed UTF-8: pieces are what is shuffled."""
    return zlib.compress(text.encode(), 1)


def pieces_of(text: str, form: str, low: int, high: int, chunk: int) -> Iterator[tuple[str, str]]:
    """The output in order, as (part, at most ``chunk`` code points); every
    part has a piece, an empty one if need be."""
    n = len(text)
    spans = {"P": (0, low), "M": (low, high), "S": (high, n), "T": (0, n)}
    for part in FORMS.get(form, "T"):
        start, end = spans[part]
        for at in range(start, max(end, start + 1), chunk):
            yield part, text[at : min(end, at + chunk)]


class Scanner:
    """Splits a stream of output bytes at the sentinels, wherever the stream
    is cut: up to two bytes that may begin a sentinel wait for the next piece."""

    def __init__(self, plain: bool):
        self.part, self.rest, self.plain = "T", b"", plain

    def feed(self, data: bytes) -> Iterator[tuple[str, bytes]]:
        if self.plain:
            yield "T", data
            return
        data, at = self.rest + data, 0
        for found in _MARK.finditer(data):
            if found.start() > at:
                yield self.part, data[at : found.start()]
            self.part, at = found.group(1).decode(), found.end()
        tail = data[at:]
        wait = 2 if tail[-2:] in (b"<P", b"<S", b"<M") else int(tail.endswith(b"<"))
        self.rest = tail[len(tail) - wait :]
        if len(tail) > wait:
            yield self.part, tail[: len(tail) - wait]

    def close(self) -> Iterator[tuple[str, bytes]]:
        if self.rest:
            yield self.part, self.rest


def restore(output: str, form: str) -> str:
    """The text that an output of the given form was made of."""
    scanner, parts = Scanner(form == "plain"), {p: b"" for p in _PLACE}
    for part, data in [*scanner.feed(output.encode()), *scanner.close()]:
        parts[part] += data
    return b"".join(parts[p] for p in "TPMS").decode()


def by_row(key: tuple) -> int:
    return key[0]


def assembled(pieces: Iterator, with_output: bool) -> Iterator:
    """From pieces in output order: the pieces to restore, keyed by their
    place in the original, and one closing record per row."""
    row = head = digest = scanner = None
    kept, seen = [], 0

    def restored(found: Iterator[tuple[str, bytes]]) -> Iterator:
        nonlocal seen
        for part, data in found:
            seen += 1
            yield (row, _PLACE[part], seen), zlib.compress(data, 1)

    def closing() -> Iterator:
        yield from restored(scanner.close())
        yield (row, _END, 0), (*head, digest.hexdigest(), b"".join(kept).decode() if with_output else None)

    for (number, place), (part, first, body, about) in pieces:
        if number != row:
            if row is not None:
                yield from closing()
            row, head, digest, scanner, kept, seen = number, about, hashlib.sha256(), Scanner(about[2] == "plain"), [], 0
        data = (SENTINELS[part].encode() if first and part != "T" else b"") + zlib.decompress(body)
        digest.update(data)
        if with_output:
            kept.append(data)
        yield from restored(scanner.feed(data))
    if row is not None:
        yield from closing()


def finished(pieces: Iterator) -> Iterator[tuple]:
    """From pieces in original order: one result per row."""
    digest = hashlib.sha256()
    for key, value in pieces:
        if key[1] != _END:
            digest.update(zlib.decompress(value))
            continue
        doc_id, n, form, prefix, middle, output_sha, output = value
        yield doc_id, n, form, prefix, middle, output_sha, digest.hexdigest(), output
        digest = hashlib.sha256()


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    percent: int = 90,
    spm_percent: int = 20,
    chunk: int = 1 << 16,
    with_output: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, n`` (code points), ``form, prefix_chars,
    middle_chars`` (null if plain), ``output_sha256``, ``restored_sha256``
    and, with ``with_output``, ``output``.

    A text is plain if it is empty (null counts as empty), holds a sentinel,
    or falls to the ``100 - percent`` that are left as they are; of the others
    ``spm_percent`` have the suffix first.  The choice depends on the id alone, so
    rows of one id share their draws (a null id counts as ''); every row is
    a document of its own, however often it is repeated.  Other columns are not read.
    """
    spark = docs.sparkSession
    read = id_text(docs, id_col, text_col)
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = read.rdd

    def emit(index: int, part: Iterator) -> Iterator:
        for i, (doc_id, text) in enumerate(part):
            n = len(text)
            form, low, high = choice(doc_id, n, seed, percent, spm_percent)
            if not n or has_sentinel(text):
                form = "plain"
            about = (doc_id, n, form, *((None, None) if form == "plain" else (low, high - low)))
            last = None
            for place, (name, piece) in enumerate(pieces_of(text, form, low, high, chunk)):
                yield ((index << 33) + i, place), (name, name != last, packed(piece), None if place else about)
                last = name

    parts = max(size // PART_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order: RDD = rows.mapPartitionsWithIndex(emit).repartitionAndSortWithinPartitions(parts, by_row)
    outputs = in_order.mapPartitions(lambda p: assembled(p, with_output), preservesPartitioning=True)
    results = outputs.repartitionAndSortWithinPartitions(parts, by_row).mapPartitions(finished)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("restored_sha256", T.StringType()),
        T.StructField("output", T.StringType()),
    ])
    found = spark.createDataFrame(results, schema, verifySchema=False)
    return found if with_output else found.drop("output")
