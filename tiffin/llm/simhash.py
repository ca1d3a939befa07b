"""SimHash near-duplicates by a byte-position inverted index.

A 64-bit fingerprint has eight positional bytes.  Two fingerprints that differ
in at most ``max_bits`` (3) bits differ in at most 3 bytes, so they share at
least 5 of the 8: the guaranteed minimum.  The index posts each distinct
fingerprint under the triples of positions inside its first half and inside
its second half: of any five shared positions three fall in one half, so every
linked pair meets in a posting list.  In a list the shared positional bytes of
each pair are tallied, pairs below the minimum are dropped, and the bits of
the rest are counted.

A list over ``list_limit`` is refined, not cut: pairs in it share two more
of the other five positions, so its members are posted again under each of the ten
pairs of these; a refined list that is still too long is compared block
against block.  A list leaves as a spanning forest of its links, never as all
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import Scratch, id_text, lower_ascii, min_label_components, salted_left_join, slices, word_spans

POSITIONS = 8
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, mark: bool = False) -> DataFrame:
    """``doc_id, fp`` (signed long), with ``mark`` also ``text_sha256``: a bit is set if it is set in over half of
    the XXH64 values (seed 42) of the word shingles, repeats included.  A text
    with fewer words is one shingle; one without words has fingerprint 0."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            low = lower_ascii(data)
            starts, ends, words = word_spans(low, offsets)
            joined, at, to = single_spaced(low, starts, ends)
            out = np.zeros(batch.num_rows, np.uint64)
            for row in range(batch.num_rows):
                first, last = int(words[row]), int(words[row + 1])
                if last > first:
                    out[row] = majority(joined, at[first:last], to[first:last], shingle)
            own = [name for name in batch.schema.names if name != "text"]
            yield pa.record_batch([*(batch.column(c) for c in own), pa.array(out.view(np.int64))], names=[*own, "fp"])

    rows = id_text(docs, id_col, text_col)
    if mark:
        rows = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, " + "text_sha256 string, " * mark + "fp long")


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends."""
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - 1
    at = to - lengths
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at, lengths) + step] = data[np.repeat(starts, lengths) + step]
    return out.tobytes(), at, to


def majority(joined: bytes, at: np.ndarray, to: np.ndarray, shingle: int) -> int:
    n = max(1, len(at) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(at[:n].tolist(), to[len(to) - n :].tolist())
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    for part in range(0, n, 1 << 16):
        block = hashes[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 3,
    list_limit: int = 2048,
    mark: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id`` (smallest
    id reachable over links of at most ``max_bits`` <= 3 differing bits), and
    ``component``, a number that tells components apart even if all their ids are null
    (with ``mark`` also ``text_sha256``).

    Null text is empty; texts without words share the fingerprint zero, which links
    like any other.  A null id is never a component's id unless all its ids
    are null.  Repeated rows each give a row.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees links of at most 3 bits")
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    signed = scratch.write(fingerprints(docs, id_col, text_col, shingle, mark), "fingerprints")
    distinct = scratch.write(
        signed.groupBy("fp").agg(F.min("doc_id").alias("label"), F.count("*").alias("n")), "distinct"
    )
    links = index_links(distinct.select("fp"), max_bits, list_limit, scratch)
    labels = min_label_components(scratch, distinct.select(F.col("fp").alias("node"), "label"), links)
    labels = distinct.select("fp", "n").join(labels.withColumnRenamed("node", "fp"), "fp")
    signed = signed.withColumn("row_no", F.monotonically_increasing_id())
    found = salted_left_join(signed, labels, ["fp"], "n", "row_no", max(1, signed.count()))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("label").alias("component_id"),
        F.col("root").alias("component"),
        *["text_sha256"] * mark,
    )


def positional(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * (POSITIONS - 1 - position)).bitwiseAND(F.lit(255))


def posting(positions: tuple[int, ...]) -> Column:
    """A list's name: its positions and the bytes there."""
    key = F.lit(sum(1 << p for p in positions)).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(positional(p))
    return key


def index_links(prints: DataFrame, max_bits: int, list_limit: int, scratch: Scratch) -> DataFrame:
    """``a, b``: a spanning forest of the links in every posting list."""
    posted = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("triple"), posting(t).alias("list")) for i, t in enumerate(TRIPLES)])).alias("p"))
    posted = posted.select("fp", "p.triple", "p.list")
    sizes = posted.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    posted = scratch.write(posted.join(sizes, "list"), "postings")

    short = posted.where(F.col("size") <= list_limit).select("list", F.lit(0).alias("block_a"), F.lit(0).alias("block_b"), "fp")
    deeper = refined(posted.where(F.col("size") > list_limit))
    again = deeper.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    deeper = scratch.write(deeper.join(again, "list"), "refined")
    grid = in_blocks(deeper, list_limit)
    lists = short.union(grid)
    dealt = lists.repartition("list", "block_a", "block_b").sortWithinPartitions("list", "block_a", "block_b")
    return dealt.mapInArrow(lambda batches: forests(batches, max_bits), "a long, b long")


def refined(posted: DataFrame) -> DataFrame:
    """Members of long lists under two more positions each."""
    choices = F.lit(None)
    for i, triple in enumerate(TRIPLES):
        rest = [p for p in range(POSITIONS) if p not in triple]
        names = F.array(*[posting(tuple(sorted((*triple, *pair)))) for pair in combinations(rest, 2)])
        choices = F.when(F.col("triple") == i, names).otherwise(choices)
    return posted.select("fp", F.explode(choices).alias("list")).distinct()


def in_blocks(posted: DataFrame, list_limit: int) -> DataFrame:
    """Lists cut into blocks of half the limit; each pair of blocks is one
    group, so that every pair of members still meets."""
    half = max(1, list_limit // 2)
    blocks = F.ceil(F.col("size") / half).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    others = posted.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return others.select("list", F.least("mine", "other").alias("block_a"), F.greatest("mine", "other").alias("block_b"), "fp")


def forests(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of a sorted partition; the last group of a
    batch is carried over until it is known to be whole."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = forest(np.unique(keys, axis=0, return_inverse=True)[1].ravel(), fps, max_bits)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
        fps = batch.column(3).to_numpy().view(np.uint64)
        if held:
            keys = np.concatenate([held[0][0], keys])
            fps = np.concatenate([held[0][1], fps])
        last = (keys != keys[-1]).any(axis=1)
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield linked(keys[:cut], fps[:cut])
        held = [(keys[cut:], fps[cut:])]
    if held:
        yield linked(*held[0])


def forest(groups: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links within each run of equal ``groups``."""
    n = len(fps)
    label = np.arange(n)
    near_a, near_b = [], []
    at = np.arange(n)
    shift = 1
    while len(at):
        at = at[at + shift < n]
        at = at[groups[at] == groups[at + shift]]
        differ = fps[at] ^ fps[at + shift]
        shared = np.zeros(len(at), np.int64)
        for p in range(POSITIONS):
            shared += ((differ >> np.uint64(8 * p)) & np.uint64(255)) == 0
        counted = shared >= POSITIONS - max_bits
        close = at[counted][np.bitwise_count(differ[counted]) <= max_bits]
        near_a.append(close)
        near_b.append(close + shift)
        shift += 1
    a, b = np.concatenate(near_a or [at]), np.concatenate(near_b or [at])
    while True:
        low = label.copy()
        both = np.minimum(label[a], label[b])
        np.minimum.at(low, a, both)
        np.minimum.at(low, b, both)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]
