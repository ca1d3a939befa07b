"""Repeated passages by longest-previous-factor arrays.

A byte is part of a repeat if a window of ``length`` bytes that covers it
also starts elsewhere.  The suffix array of all texts is worked out in parts
that can share such windows:

1. Equal texts count once, with their number.
2. Every window is named after its anchor, the GRAM-byte string in it with the least
   hash (the leftmost of equal ones), so equal windows have the same anchor.
   Neighbouring windows with one anchor form a run; runs with the same anchor and
   bytes (by BLAKE2) form a class, which is aggregated before anything is shuffled as text.
   Anchors that occur once need no suffix: their windows are unique.
3. For all classes of an anchor, the suffixes at their window starts are put
   in order, with the common prefixes of neighbours; both look at ``length`` bytes at most.
   A suffix whose first ``length`` bytes hash to a value of its own has no factor of that
   length and is left out beforehand; this changes no other suffix's factor of that length.
4. One pass over that order finds the previous and the next smaller position of every
   suffix; the longer common prefix with one of them is its longest previous
   factor.  Where it reaches ``length``, the window has an earlier match.  The same pass
   with the positions mirrored gives later matches.
5. Matches go back to the runs of their class, runs to their text, and texts to
   their documents.

An anchor with more than ``class_limit`` classes (a passage that very many
documents quote in different surroundings) is split by content: its runs are
cut into stretches of STEP windows aligned to the anchor and named after the
bytes common to the stretch, and stretches that are still too many into single windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import Scratch, id_text, mix, prefix_hash, salted_left_join, seg_sum, slices, span_hash

GRAM, STEP, RUN = 64, 16, 512
#: Bits of a slice position in the ordering value of a gram.
PLACE = np.uint64(28)
#: Classes whose windows one task orders together.
GROUP = 1000

INTERVALS = "array<struct<lo: long, hi: long>>"
_INTERVALS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, by blockwise running minima."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    onward = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], onward[width - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The runs of a slice: document, first window, number of windows, place
    of the anchor after the first window, its hash, and the hash of the run's bytes."""
    n, width = len(data), length - GRAM + 1
    none = {k: np.empty(0, np.int64) for k in ("doc", "start", "starts", "anchor", "key", "h")}
    if n < length:
        return none
    if n >= 1 << int(PLACE):
        raise ValueError("a text of 256 MB or more: cut it into documents first")
    sums = prefix_hash(data)
    grams = np.arange(n - GRAM + 1)
    hashes = span_hash(sums, grams, grams + GRAM)
    least = sliding_least((hashes >> PLACE << PLACE) | grams.astype(np.uint64), width)
    anchor = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    del least, grams
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    place = np.arange(len(anchor))
    whole = place + length <= offsets[1:][doc]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(fresh)
    if (np.diff(np.append(begin, len(anchor))) > RUN).any():
        since = place - np.maximum.accumulate(np.where(fresh, place, 0))
        fresh |= since % RUN == 0
        begin = np.flatnonzero(fresh)
    sizes = np.diff(np.append(begin, len(anchor)))
    own = whole[begin]
    begin, sizes = begin[own], sizes[own]
    return {
        "doc": doc[begin],
        "start": begin - offsets[:-1][doc[begin]],
        "starts": sizes,
        "anchor": anchor[begin] - begin,
        "key": hashes[anchor[begin]].view(np.int64),
        "h": names_of(memoryview(data), begin, begin + sizes + length - 1),
    }


def names_of(raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2 of each byte span.  They name a class only beside the hash of its anchor."""
    spans = zip(starts.tolist(), ends.tolist())
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in spans]), np.int64)


def intervals_of(flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of true values, as first and last index."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def longest_previous(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each position: ``order`` has the positions
    in suffix order, ``common`` the prefix that each shares with the one before.
    The stack holds smaller positions on the left, with what each shares with
    the one below it; whatever takes an entry off is its next smaller position."""
    factors = [0] * len(order)
    stack: list[tuple[int, int]] = []
    for position, shared in zip([*order.tolist(), -1], [*common.tolist(), 0]):
        while stack and position < stack[-1][0]:
            top, left = stack.pop()
            factors[top] = max(left, shared)
            shared = min(left, shared)
        stack.append((position, shared))
    return np.array(factors, np.int64)


def common_prefixes(text: np.ndarray, at: np.ndarray, length: int, block: int = 2048) -> np.ndarray:
    """How many of the first ``length`` bytes at each place are those of the place before it."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    common = np.zeros(len(at), np.int64)
    for i in range(1, len(at), block):
        part = windows[at[i - 1 : i + block]]
        unlike = part[1:] != part[:-1]
        common[i : i + block] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), length)
    return common


def matches(classes: pd.DataFrame, length: int, keep_first: bool) -> list[np.ndarray]:
    """For each class, which of its windows match another one: an earlier one
    with ``keep_first``, else any.  ``classes`` are in text order."""
    bodies, starts, weights = list(classes["body"]), classes["starts"].to_numpy(), classes["w"].to_numpy()
    text = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    base = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(bodies)), starts)
    first = np.cumsum(starts) - starts
    at = base[of] + np.arange(len(of)) - first[of]
    found = (weights >= 2)[of] if not keep_first else np.zeros(len(of), bool)
    # a window whose hash is its own is equal to none
    hashes = span_hash(prefix_hash(text), at, at + length)
    _, same, times = np.unique(hashes, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[same] > 1)
    if len(maybe):
        # positions in text order: windows of overlapping classes of one text by their place
        docs, place = classes["doc_rank"].to_numpy()[of[maybe]], classes["start"].to_numpy()[of[maybe]] + (at - base[of])[maybe]
        maybe = maybe[np.lexsort((place, docs))]
        raw = text.tobytes()
        prefix = [raw[a : a + length] for a in at[maybe].tolist()]
        order = np.array(sorted(range(len(prefix)), key=prefix.__getitem__))
        common = common_prefixes(text, at[maybe[order]], length)
        found[maybe[longest_previous(order, common) >= length]] = True
        if not keep_first:
            mirrored = longest_previous(len(order) - 1 - order, common)[::-1]
            found[maybe[mirrored >= length]] = True
    return [found[a : a + n] for a, n in zip(first.tolist(), starts.tolist())]


def marks_of(classes: DataFrame, length: int, keep_first: bool, n_classes: int) -> DataFrame:
    """``key, h, marks``: intervals of matching windows of every class."""
    groups = max(1, n_classes // GROUP)

    def order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_rank", "start"], kind="stable")
        flags = matches(group, length, keep_first)
        return pd.DataFrame({"key": group["key"], "h": group["h"], "marks": [intervals_of(f) for f in flags]})

    grouped = classes.groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"))
    return grouped.applyInPandas(order, f"key long, h long, marks {INTERVALS}").where("size(marks) > 0")


def stretches(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """Classes cut into stretches of ``step`` windows aligned to the anchor,
    named after the bytes that all windows of such a stretch share."""
    names = ["up_key", "up_h", "rel", "key", "h", "w", "doc_rank", "start", "starts", "anchor", "body"]
    for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
        cut = []
        for r in batch.to_pylist():
            body, anchor = r["body"], r["anchor"]
            data = np.frombuffer(body, np.uint8)
            sums = prefix_hash(data)
            i = np.arange(r["starts"])
            q = (anchor - i) // step
            begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            n = np.diff(np.append(begin, len(i)))
            core = anchor - q[begin] * step
            key = mix(span_hash(sums, core, core - step + 1 + length) + q[begin].astype(np.uint64) + np.uint64(step))
            h = names_of(memoryview(body), begin, begin + n + length - 1)
            m = len(begin)
            columns = [
                pa.array([r["key"]] * m, pa.int64()), pa.array([r["h"]] * m, pa.int64()), pa.array(begin, pa.int64()),
                pa.array(key.view(np.int64)), pa.array(h), pa.array([r["w"]] * m, pa.int64()),
                pa.array([r["doc_rank"]] * m, pa.int64()), pa.array(r["start"] + begin, pa.int64()), pa.array(n, pa.int64()),
                pa.array(anchor - begin, pa.int64()), pa.array([body[a : a + k + length - 1] for a, k in zip(begin.tolist(), n.tolist())], pa.binary()),
            ]
            cut.append(pa.record_batch(columns, names=names))
        yield from pa.Table.from_batches(cut).combine_chunks().to_batches()


def handed_up(members: DataFrame, marks: DataFrame, up: list[str], keep_first: bool, total: int) -> DataFrame:
    """Marks of classes as marks of what their members are part of.  With
    ``keep_first`` a member that is not the first of its class matches as a whole."""
    held = salted_left_join(members, marks, ["key", "h"], "size", "rel", max(1, total))
    own = F.transform("marks", lambda m: F.struct((m["lo"] + F.col("rel")).alias("lo"), (m["hi"] + F.col("rel")).alias("hi")))
    whole = F.array(F.struct(F.col("rel").alias("lo"), (F.col("rel") + F.col("starts") - 1).alias("hi")))
    if keep_first:
        copy = F.col("first").isNotNull() & (F.struct("doc_rank", "start") != F.col("first"))
        own = F.when(copy, whole).otherwise(own)
    held = held.select(*up, own.alias("marks")).where("size(marks) > 0")
    return held.groupBy(*up).agg(F.flatten(F.collect_list("marks")).alias("marks"))


def classed(runs: DataFrame, carried: list[str]) -> DataFrame:
    """Classes of runs: their weight, size, first member, and what it carries."""
    first = F.min(F.struct("doc_rank", "start", *carried))
    return runs.groupBy("key", "h").agg(F.sum("w").alias("w"), F.count("*").alias("size"), first.alias("rep"))


def with_members(classes: DataFrame) -> DataFrame:
    """The classes of anchors that occur more than once, with the number of
    classes of their anchor."""
    anchors = classes.groupBy("key").agg(F.sum("w").alias("total"), F.count("*").alias("members")).where("total > 1")
    return classes.join(anchors.drop("total"), "key")


def marks_below(classes: DataFrame, step: int, length: int, keep_first: bool, class_limit: int, scratch: Scratch) -> DataFrame:
    """Marks of classes whose anchors have too many, by way of stretches."""
    members = classes.mapInArrow(
        lambda batches: stretches(batches, length, step),
        "up_key long, up_h long, rel long, key long, h long, w long, doc_rank long, start long, starts long, anchor long, body binary",
    )
    members = scratch.write(members, f"stretches-{step}")
    below = scratch.write(with_members(classed(members, ["starts", "anchor", "body"])), f"stretch-classes-{step}")
    parts = below.select("key", "h", "w", "size", "members", "rep.*")
    n = parts.count()
    few = parts.where(F.col("members") <= class_limit) if step > 1 else parts
    marks = marks_of(few, length, keep_first, n)
    if step > 1:
        many = parts.where(F.col("members") > class_limit)
        if not many.isEmpty():
            marks = marks.union(marks_below(many, 1, length, keep_first, class_limit, scratch))
    marks = below.select("key", "h", "size", F.struct("rep.doc_rank", "rep.start").alias("first")).join(marks, ["key", "h"], "left")
    up = handed_up(members.drop("body"), marks, ["up_key", "up_h"], keep_first, members.count())
    return up.select(F.col("up_key").alias("key"), F.col("up_h").alias("h"), "marks")


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    keep_first: bool = True,
    with_kept: bool = False,
    class_limit: int = 1000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, spans,
    kept_sha256`` (and ``kept``, the remaining UTF-8 bytes, on request).

    ``spans`` are the maximal removed runs of bytes: those covered by a string
    of ``length`` bytes that also starts earlier (``keep_first``; documents in
    the order of their ids, null first) or anywhere else (otherwise).
    Occurrences may overlap, also within a document; strings never cross
    documents and are judged on the input.  Null text is empty; shorter texts
    than ``length`` keep all bytes; of rows repeated with one id and text the
    copies count as documents of their own.
    """
    if length < GRAM + STEP:
        raise ValueError(f"length must be at least {GRAM + STEP}")
    spark = docs.sparkSession
    name = f"tiffin_texts_{uuid.uuid4().hex}"
    try:
        return passages_through(name, id_text(docs, id_col, text_col), length, keep_first, with_kept, class_limit, scratch or Scratch(spark, "repeats"))
    finally:
        spark.sql(f"drop table if exists {name}")


def passages_through(name: str, texts: DataFrame, length: int, keep_first: bool, with_kept: bool, class_limit: int, scratch: Scratch) -> DataFrame:
    """As ``repeated_passages``, for ``texts(doc_id, text)``, by way of a bucketed
    table of that name, which the result does not read."""
    spark = texts.sparkSession
    read = texts.withColumn("row_no", F.monotonically_increasing_id())
    read = read.withColumn("sha", F.unhex(F.sha2("text", 256)))
    rows = scratch.write(read.select("doc_id", "row_no", "sha"), "rows")
    total = rows.count()

    # one row per distinct text, bucketed by it: later joins move no text
    least = F.min(F.struct("doc_id", "row_no")).alias("first")
    distinct = read.groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("w"), least)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = distinct.repartition(buckets, "sha").write.bucketBy(buckets, "sha").option("compression", "zstd")
    writer.option("path", scratch.path("texts")).saveAsTable(name)
    texts = spark.table(name)

    # texts in the order of their first document, as a number: ids may be of any kind
    ranked = texts.select("sha", "w", "first")
    if keep_first:
        ranks = dense_order(ranked, scratch)
        texts = texts.join(ranks, "sha")
    else:
        texts = texts.withColumn("doc_rank", F.xxhash64("sha"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, limit=2 << 20):
            r = runs_of(data, offsets, length)
            own = pa.array(r["doc"])
            columns = [batch.column(c).take(own) for c in ("sha", "w", "doc_rank")] + [pa.array(r[k]) for k in ("start", "starts", "anchor", "key", "h")]
            yield pa.record_batch(columns, names=["sha", "w", "doc_rank", "start", "starts", "anchor", "key", "h"])

    schema = "sha binary, w long, doc_rank long, start long, starts long, anchor long, key long, h long"
    runs = scratch.write(texts.select("sha", "w", "doc_rank", "text").mapInArrow(cut, schema), "runs")
    classes = scratch.write(with_members(classed(runs, ["sha", "starts", "anchor"])), "classes")

    def fetch(chosen: DataFrame) -> DataFrame:
        """The bytes of the classes' first runs."""
        parts = chosen.select("rep.sha", F.struct("key", "h", "w", "rep.doc_rank", "rep.start", "rep.starts", "rep.anchor").alias("part"))
        wanted = parts.groupBy("sha").agg(F.collect_list("part").alias("parts"))

        def slice_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in slices(batches, limit=1 << 20):
                lists = batch.column("parts")
                own = pa.RecordBatch.from_struct_array(lists.flatten())
                base = np.repeat(offsets[:-1], lists.value_lengths().to_numpy())
                at = base + own.column("start").to_numpy()
                to = at + own.column("starts").to_numpy() + length - 1
                raw = memoryview(data)
                body = pa.array([bytes(raw[a:b]) for a, b in zip(at.tolist(), to.tolist())], pa.binary())
                yield pa.record_batch([*own.columns, body], names=[*own.schema.names, "body"])

        joined = spark.table(name).select("sha", "text").join(wanted, "sha").select("text", "parts")
        return joined.mapInArrow(slice_out, "key long, h long, w long, doc_rank long, start long, starts long, anchor long, body binary")

    few = classes.where(F.col("members") <= class_limit)
    marks = marks_of(fetch(few), length, keep_first, few.count())
    many = classes.where(F.col("members") > class_limit)
    if not many.isEmpty():
        bodies = scratch.write(fetch(many), "crowded")
        marks = marks.union(marks_below(bodies, STEP, length, keep_first, class_limit, scratch))
    marks = scratch.write(marks, "marks")
    placed = classes.select("key", "h", "size", F.struct("rep.doc_rank", "rep.start").alias("first")).join(marks, ["key", "h"], "left")
    n_runs = runs.count()
    members = runs.withColumn("rel", F.col("start")).drop("anchor", "w")
    covered = handed_up(members, placed, ["sha"], keep_first, n_runs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, limit=1 << 20):
            lists = batch.column("marks").fill_null([])
            marked = lists.flatten()
            base = np.repeat(offsets[:-1], lists.value_lengths().to_numpy())
            gone = np.zeros(len(data) + 1, np.int32)
            np.add.at(gone, base + marked.field("lo").to_numpy(), 1)
            np.add.at(gone, base + marked.field("hi").to_numpy() + length, -1)
            flags = np.cumsum(gone[:-1]) > 0
            n_removed, spans, digests, kept = seg_sum(flags.astype(np.int64), offsets), [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = flags[a:b]
                spans.append([{"start": s["lo"], "end": s["hi"] + 1} for s in intervals_of(own)])
                left = data[a:b][~own].tobytes()
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_kept else None)
            columns = [batch.column("sha"), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(spans, _SPANS)]
            columns += [pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, names=["sha", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    joined = spark.table(name).select("sha", "text").join(covered, "sha", "left")
    cleaned = joined.mapInArrow(remove, f"sha binary, n_bytes long, n_removed long, spans {SPANS}, kept_sha256 string, kept binary")
    cleaned = scratch.write(cleaned.join(spark.table(name).select("sha", "w", "first"), "sha"), "cleaned")

    found = salted_left_join(rows, cleaned, ["sha"], "w", "row_no", max(1, total))
    if keep_first:
        copy = (F.col("first.row_no") != F.col("row_no")) & (F.col("n_bytes") >= length)
        all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        found = found.withColumn("spans", F.when(copy, all_of).otherwise(F.col("spans")))
        found = found.withColumn("n_removed", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")))
        found = found.withColumn("kept_sha256", F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")))
        found = found.withColumn("kept", F.when(copy & F.lit(with_kept), F.lit(b"")).otherwise(F.col("kept")))
    return found.select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", *["kept"] * with_kept)


SPANS = "array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def dense_order(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``sha, doc_rank``: an increasing number in the order of ``first``.  A
    range partitioning puts the texts in order; a row's number is its
    partition's and its place there, taken from the written files."""
    ordered = texts.select("sha", "first").repartitionByRange("first").sortWithinPartitions("first")
    return scratch.write(ordered.select("sha", F.monotonically_increasing_id().alias("doc_rank")), "order")
