"""Repeated substrings of words by seed and extend.

A window of ``length`` words is removed from a document if it also stands in one with a
smaller id.  Seeds are winnowed anchors: of the grams in a window the one with
the least hash (the leftmost of equal ones), so equal windows have equal anchors.

1. Neighbouring windows with one anchor form a run (at most ``length`` windows, so
   fewer than ``2 * length`` words); runs are grouped by anchor and 128-bit digest of their
   words.  A class of equal runs is known by its smallest document: all its other
   documents repeat it whole.
2. Anchors that runs of different documents share join each class to the *leader* of
   the anchor, the class of the smallest document (a star, never all pairs), and the
   words are compared outwards from the anchor, both ways.  Windows inside the
   common stretch are repeats of the leader.
3. What a class has beyond the stretch cannot repeat the leader, but may repeat another class:
   one that also has the first differing word.  Classes are grouped by the words from that
   word to the anchor, on either side; only in groups with several documents are the
   remaining windows looked up, each by its own digest.
4. Matches go back from classes to runs and from runs to documents; overlapping and
   adjacent ones become maximal spans.

Grams are hashed with 64 bits, which only chooses and groups; what is called equal
has equal words or equal 128-bit digests (BLAKE2).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiffin.llm.common import Scratch, id_text, mix, powers, prefix_hash, salted_left_join, slices, span_hash, spaced_words, word_spans
from tiffin.llm.repeats import intervals_of, sliding_least

#: Bits of a word's position in the ordering value of a gram.
PLACE = np.uint64(28)
#: A longer word is compared by its digest.
LONG_WORD = 32

SPANS = "array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUN = pa.struct([("key", pa.int64()), ("h", pa.binary()), ("start", pa.int64()), ("starts", pa.int64()), ("off", pa.int64())])
RUNS = "array<struct<key: long, h: binary, start: long, starts: long, off: long>>"
_SIDES = pa.list_(pa.struct([("side", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())]))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are shuffled twice."""
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        body = pa.array([zlib.compress(t.encode(), 1) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.record_batch([batch.column("row_no"), batch.column("doc_id"), body], names=["row_no", "doc_id", "packed"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts again, at most 256 compressed rows or 1 MB (one row at least) at a time."""
    for batch in batches:
        sizes = np.cumsum([len(b) for b in batch.column("packed").to_pylist()])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20), "right"))
            part = batch.slice(at, min(max(at + 1, to), at + 256) - at)
            at += part.num_rows
            text = pa.array([zlib.decompress(b).decode() for b in part.column("packed").to_pylist()], pa.string())
            names = [c for c in part.schema.names if c != "packed"]
            yield pa.record_batch([*[part.column(c) for c in names], text], names=[*names, "text"])


def winnowed(words: np.ndarray, docs_at: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of a slice: document, first window (a word number of the slice), number of windows,
    place of the anchor after the first window, hash of the anchor.  ``words`` are hashes."""
    n = len(words)
    if n < length:
        return {k: np.empty(0, np.int64) for k in ("doc", "begin", "starts", "off", "key")}
    if n >= 1 << int(PLACE):
        raise ValueError("a text of 2^28 words or more: cut it into documents first")
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    grams = np.arange(n - gram + 1)
    hashes = mix((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    least = sliding_least((hashes >> PLACE << PLACE) | grams.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    window = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(docs_at) - 1), np.diff(docs_at))[: len(anchor)]
    whole = window + length <= docs_at[1:][doc]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(fresh)
    starts = np.diff(np.append(begin, len(anchor)))
    begin, starts = begin[whole[begin]], starts[whole[begin]]
    return {"doc": doc[begin], "begin": begin, "starts": starts, "off": anchor[begin] - begin, "key": hashes[anchor[begin]].view(np.int64)}


def seeded(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per row: its words, the digest of the whole text, and its runs."""
    for batch, data, offsets in slices(unpacked(batches), limit=1 << 20):
        starts, ends, docs_at = word_spans(data, offsets)
        hashes = span_hash(prefix_hash(data), starts, ends)
        text, at = spaced_words(data, starts, ends)
        raw = memoryview(text)
        r = winnowed(hashes, docs_at, length, gram)
        first, last = at[r["begin"]], at[r["begin"] + r["starts"] + length - 1] - 1
        h = pa.array([digest(raw[a:b]) for a, b in zip(first.tolist(), last.tolist())], pa.binary())
        runs = pa.StructArray.from_arrays(
            [pa.array(r["key"]), h, pa.array(r["begin"] - docs_at[r["doc"]]), pa.array(r["starts"]), pa.array(r["off"])], fields=list(_RUN)
        )
        cuts = np.searchsorted(r["doc"], np.arange(len(docs_at)))
        whole = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[docs_at[:-1]].tolist(), at[docs_at[1:]].tolist())]
        columns = [batch.column("row_no"), batch.column("doc_id"), pa.array(np.diff(docs_at)), pa.array(whole, pa.string())]
        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs))
        yield pa.record_batch(columns, names=["row_no", "doc_id", "n_words", "whole_sha256", "runs"])


def bodies_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words of the runs in ``parts``, joined by a space, long ones as a tab and
    their digest (no word begins with a tab)."""
    for batch, data, offsets in slices(unpacked(batches), limit=1 << 20):
        starts, ends, docs_at = word_spans(data, offsets)
        text, at = spaced_words(data, starts, ends)
        raw = memoryview(text)
        lists = batch.column("parts")
        own = pa.RecordBatch.from_struct_array(lists.flatten())
        begin = np.repeat(docs_at[:-1], lists.value_lengths().to_numpy()) + own.column("start").to_numpy()
        last = at[begin + own.column("starts").to_numpy() + length - 1] - 1
        bodies = []
        for a, b in zip(at[begin].tolist(), last.tolist()):
            words = bytes(raw[a:b]).split(b" ")
            bodies.append(b" ".join(w if len(w) <= LONG_WORD else b"\t" + digest(w).hex().encode() for w in words))
        yield pa.record_batch([*own.columns, pa.array(bodies, pa.binary())], names=[*own.schema.names, "body"])


def agreed(own: list[bytes], off: int, leader: list[bytes], leader_off: int) -> tuple[int, int]:
    """Equal words before the anchor's start, and from it on."""
    left = 0
    for a, b in zip(reversed(own[:off]), reversed(leader[:leader_off])):
        if a != b:
            break
        left += 1
    right = 0
    for a, b in zip(own[off:], leader[leader_off:]):
        if a != b:
            break
        right += 1
    return left, right


def extended(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per class: the windows ``lo..hi`` that repeat the leader (null: none), and
    the ranges of the others by the words they need on either side."""
    names = ["class_no", "lo", "hi", "sides"]
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("class_no", "starts", "off", "body", "leader_off", "leader_body", "later")]
        for number, starts, off, body, leader_off, leader_body, later in zip(*columns):
            own = body.split(b" ")
            left, right = agreed(own, off, leader_body.split(b" "), leader_off)
            first, last = off - left, min(off + right - length, starts - 1)
            sides = []
            if first > 0:
                sides.append({"side": digest(b"L " + b" ".join(own[first - 1 : off + gram])), "lo": 0, "hi": min(first, starts) - 1})
            begin = max(first, last + 1, 0)
            if begin < starts:
                sides.append({"side": digest(b"R " + b" ".join(own[off : off + max(right + 1, gram)])), "lo": begin, "hi": starts - 1})
            repeats = later and last >= first
            out.append((number, first if repeats else None, last if repeats else None, sides))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), _SIDES))], names=names)


def windows_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The digests of the windows ``lo..hi`` of each class."""
    for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
        digests, place, source = [], [], []
        for i, (body, lo, hi) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("body", "lo", "hi")))):
            words = body.split(b" ")
            digests += [digest(b" ".join(words[w : w + length])) for w in range(lo, hi + 1)]
            place += range(lo, hi + 1)
            source += [i] * (hi + 1 - lo)
        own = pa.array(source, pa.int64())
        columns = [pa.array(digests, pa.binary()), batch.column("class_no").take(own), batch.column("doc").take(own), pa.array(place, pa.int64())]
        yield pa.record_batch(columns, names=["window", "class_no", "doc", "place"])


def cleaned_texts(batches: Iterator[pa.RecordBatch], length: int, with_kept: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the words that the marked windows cover."""
    for batch, data, offsets in slices(unpacked(batches), limit=1 << 20):
        starts, ends, docs_at = word_spans(data, offsets)
        lists = batch.column("marks").fill_null([])
        marked = lists.flatten()
        base = np.repeat(docs_at[:-1], lists.value_lengths().to_numpy())
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, base + marked.field("lo").to_numpy(), 1)
        np.add.at(change, base + marked.field("hi").to_numpy() + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        text, at = spaced_words(data, starts[~gone], ends[~gone])
        raw = memoryview(text)
        left = np.concatenate([[0], np.cumsum(~gone)])[docs_at]
        kept = [bytes(raw[a : max(a, b - 1)]) for a, b in zip(at[left[:-1]].tolist(), at[left[1:]].tolist())]
        spans = [[{"start": s["lo"], "end": s["hi"] + 1} for s in intervals_of(gone[a:b])] for a, b in zip(docs_at[:-1].tolist(), docs_at[1:].tolist())]
        columns = [batch.column("row_no"), pa.array(np.diff(docs_at) - np.diff(left)), pa.array(spans, _SPANS)]
        columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
        columns.append(pa.array([k.decode() if with_kept else None for k in kept], pa.string()))
        yield pa.record_batch(columns, names=["row_no", "n_removed", "spans", "kept_sha256", "kept"])


def repeated_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    gram: int | None = None,
    with_kept: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, spans`` (maximal
    runs of removed words, from 0, end exclusive), ``kept_sha256`` (of the kept words joined by
    one space) and, on request, ``kept``, that text.

    Removed are the words covered by ``length`` consecutive words that also
    start in a document with a smaller id, judged on the input.  Words are runs
    of bytes that are no ASCII white space; null text has none.  A null id is
    smaller than any other; rows of one id (two null ids as well) are one document in
    this order and remove nothing from each other.  Other columns are not read.
    ``gram``: words of an anchor, a third of ``length`` by default.
    """
    gram = gram or max(1, length // 3)
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substrings")
    id_type = docs.schema[id_col].dataType
    doc_type = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("id", id_type)])

    def doc(column: str = "doc_id") -> Column:
        return F.struct(F.col(column).isNotNull().alias("known"), F.col(column).alias("id"))

    # the rows, numbered for good; later steps find their texts by the number
    numbered = id_text(docs, id_col, text_col).withColumn("row_no", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("doc_id", id_type), T.StructField("packed", T.BinaryType())])
    texts = scratch.write(numbered.mapInArrow(packed, schema), "texts")
    schema = T.StructType([
        T.StructField("row_no", T.LongType()),
        T.StructField("doc_id", id_type),
        T.StructField("n_words", T.LongType()),
        T.StructField("whole_sha256", T.StringType()),
        T.StructField("runs", T.DataType.fromDDL(RUNS)),
    ])
    rows = scratch.write(texts.mapInArrow(lambda b: seeded(b, length, gram), schema), "rows")
    runs = rows.select("row_no", doc().alias("doc"), F.explode("runs").alias("run")).select("row_no", "doc", "run.*")

    # 1. anchors that several documents have, and classes of equal runs
    total = max(1, rows.agg(F.sum(F.size("runs"))).first()[0] or 0)
    keys = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    keys = scratch.write(keys.where("least < most").select("key", "n"), "keys")
    runs = salted_left_join(runs, keys, ["key"], "n", "row_no", total).where("n is not null").drop("n")
    runs = scratch.write(runs, "runs")
    first = F.min(F.struct("doc", "row_no", "start", "starts", "off")).alias("first")
    classes = runs.groupBy("key", "h").agg(F.count("*").alias("size"), first, F.max("doc").alias("latest"))
    classes = scratch.write(classes, "classes")

    # 2. leaders, and the words of the classes of their anchors
    leader = F.min(F.struct("first.doc", "h")).alias("leader")
    anchors = classes.groupBy("key").agg(F.count("*").alias("members"), leader, F.max("first.doc").alias("last_doc"))
    anchors = anchors.where("leader.doc < last_doc").select("key", "members", "leader")
    shared = classes.join(anchors, "key")
    involved = shared.select("key", "members", (F.col("h") == F.col("leader.h")).alias("leads"), (F.col("first.doc") > F.col("leader.doc")).alias("later"), "h", "first.*")
    involved = scratch.write(involved.withColumn("class_no", F.monotonically_increasing_id()), "involved")
    part = F.struct("class_no", "key", "members", "leads", "later", "doc", "start", "starts", "off")
    wanted = involved.groupBy("row_no").agg(F.collect_list(part).alias("parts"))
    schema = T.StructType([
        *[T.StructField(c, T.LongType()) for c in ("class_no", "key", "members")],
        *[T.StructField(c, T.BooleanType()) for c in ("leads", "later")],
        T.StructField("doc", doc_type),
        *[T.StructField(c, T.LongType()) for c in ("start", "starts", "off")],
        T.StructField("body", T.BinaryType()),
    ])
    fetched = texts.select("row_no", "packed").join(wanted, "row_no").select("packed", "parts")
    bodies = scratch.write(fetched.mapInArrow(lambda b: bodies_of(b, length), schema), "bodies")

    # each class meets its leader
    leaders = bodies.where("leads").select("key", "members", F.col("off").alias("leader_off"), F.col("body").alias("leader_body"))
    others = bodies.where("not leads").select("class_no", "key", "later", "starts", "off", "body")
    met = salted_left_join(others, leaders, ["key"], "members", "class_no", total).drop("key", "members")
    grown = met.mapInArrow(lambda b: extended(b, length, gram), "class_no long, lo long, hi long, sides array<struct<side: binary, lo: long, hi: long>>")
    grown = scratch.write(grown, "grown")

    # 3. what is left, where another class has the next word too
    open_ends = grown.select("class_no", F.explode("sides").alias("end")).select("class_no", "end.*").join(bodies.select("class_no", "doc"), "class_no")
    open_ends = scratch.write(open_ends, "open_ends")
    sides = open_ends.groupBy("side").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    sides = sides.where("least < most").select("side", "n")
    opened = salted_left_join(open_ends, sides, ["side"], "n", "class_no", total).where("n is not null").select("class_no", "lo", "hi")
    schema = T.StructType([
        T.StructField("window", T.BinaryType()),
        T.StructField("class_no", T.LongType()),
        T.StructField("doc", doc_type),
        T.StructField("place", T.LongType()),
    ])
    looked_up = bodies.select("class_no", "doc", "body").join(opened, "class_no")
    windows = scratch.write(looked_up.mapInArrow(lambda b: windows_of(b, length), schema), "windows")
    earliest = windows.groupBy("window").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    earliest = earliest.where("least < most").select("window", "n", "least")
    single = salted_left_join(windows, earliest, ["window"], "n", "class_no", max(1, total)).where("doc > least")

    # 4. matches of classes, of runs, of documents
    found = grown.where("lo is not null").select("class_no", "lo", "hi")
    found = found.unionByName(single.select("class_no", F.col("place").alias("lo"), F.col("place").alias("hi")))
    marks = found.groupBy("class_no").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    marks = involved.select("class_no", "key", "h").join(marks, "class_no").drop("class_no")
    marks = classes.select("key", "h", "size", F.col("first.doc").alias("least"), "latest").join(marks, ["key", "h"], "left")
    marks = scratch.write(marks.where("least < latest or marks is not null").drop("latest"), "marks")
    held = salted_left_join(runs.drop("off"), marks, ["key", "h"], "size", "row_no", total)
    start = F.col("start")
    whole = F.array(F.struct(start.alias("lo"), (start + F.col("starts") - 1).alias("hi")))
    own = F.transform("marks", lambda m: F.struct((m["lo"] + start).alias("lo"), (m["hi"] + start).alias("hi")))
    held = held.where("least is not null").select("row_no", F.when(F.col("doc") > F.col("least"), whole).otherwise(own).alias("marks"))
    covered = held.where("size(marks) > 0").groupBy("row_no").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    touched = texts.select("row_no", "packed").join(covered, "row_no", "left" if with_kept else "inner")
    schema = f"row_no long, n_removed long, spans {SPANS}, kept_sha256 string, kept string"
    touched = touched.mapInArrow(lambda b: cleaned_texts(b, length, with_kept), schema)
    touched = scratch.write(touched, "touched")
    scratch.drop("texts", "keys", "runs", "classes", "involved", "bodies", "grown", "open_ends", "windows", "marks")

    result = rows.select("row_no", "doc_id", "n_words", "whole_sha256").join(touched, "row_no", "left")
    return result.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.from_json(F.lit("[]"), SPANS)).alias("spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        *["kept"] * with_kept,
    )
