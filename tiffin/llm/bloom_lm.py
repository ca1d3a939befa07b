"""A bigram language model in a log-frequency Bloom filter.

Counts are quantised to the levels of a geometric scale (1, 2, 3, 4, 6, 8,
11, 16, ...).  An n-gram of level q is put into the filter q times, with each of
1..q; its count is read back by probing level 1, 2, ... until a probe fails
(Talbot and Osborne 2007).  The filter is cut into segments by the leading
bits of the n-gram's hash, so that the task that adds up a range of n-grams
also writes the segment of that range, and only segments reach the driver.

Probabilities are smoothed with a Dirichlet prior of strength ``mu`` on the
unigrams: P(w | h) = (c(h w) + mu P(w)) / (c(h) + mu).  Every count comes from
the filter.  A bigram is probed only if its words are present, and its count is
held to theirs, which keeps most false positives out.

Size: ``bits_per_entry`` bits for every (n-gram, level), however many there
are.  A filter that is certain to stay within ``max_bytes`` is broadcast.  A
larger one never leaves its ranges: the distinct n-grams of every slice, those to be
learned and those to be scored alike, go to the range of their segment, are
probed there, and their levels come back to the slice.  Both ways read the same
segments, so the scores are the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiffin.llm.common import Scratch, fold_of, id_text, lower_ascii, mix, slices, spaced_words, text_column, word_numbers, word_spans

TEXT_BYTES = 2 << 20
#: Text bytes of a slice whose n-grams are probed in their ranges.
PROBE_BYTES = 4 << 20
#: Words with at least 1/HEAD of all training tokens, at most HEAD of them, are
#: broadcast with their counts; the others are counted by a shuffle.
HEAD = 1 << 20

END, BEGIN = np.uint64(0x5A17B3C94D2E8F61), np.uint64(0xC3E1A5F27B96D048)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def levels() -> np.ndarray:
    """The least count of each level: the distinct ceilings of sqrt(2)^i."""
    return np.unique(np.ceil(2 ** (np.arange(0, 80) / 2) - 1e-9))


LEVELS = levels()
#: The count that a level stands for: the middle of its range (exact below 5).
VALUES = np.append(0.0, np.append((LEVELS[:-1] + LEVELS[1:] - 1) / 2, LEVELS[-1]))


def pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * _ODD + (word ^ (word >> np.uint64(29))))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2 of every word, worked out once for each distinct one:
    unlike a polynomial hash it has no words with equal values by their structure."""
    text, at = spaced_words(data, starts, ends)
    raw = memoryview(text)
    numbers = word_numbers(data, starts, ends)
    first = np.empty(numbers.max(initial=-1) + 1, np.int64)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    spans = zip(at[first].tolist(), (at[first + 1] - 1).tolist())
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in spans)
    return np.frombuffer(digests, np.uint64)[numbers]


@dataclass
class Tokens:
    """The tokens of a slice: words' hashes with an end after each document."""

    keys: np.ndarray
    offsets: np.ndarray

    def histories(self) -> np.ndarray:
        before = np.empty_like(self.keys)
        before[1:] = self.keys[:-1]
        before[self.offsets[:-1]] = BEGIN
        return before


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low = lower_ascii(data)
    starts, ends, words = word_spans(low, offsets)
    hashes = word_hashes(low, starts, ends)
    n = len(offsets) - 1
    at = words + np.arange(n + 1)
    keys = np.empty(len(hashes) + n, np.uint64)
    stop = at[1:] - 1
    inner = np.ones(len(keys), bool)
    inner[stop] = False
    keys[inner] = hashes
    keys[stop] = END
    return Tokens(keys, at)


def tokens_in(text: np.ndarray, ends: np.ndarray) -> Tokens:
    """The tokens of a large slice, from runs of whole rows: hashing a run
    takes several times its bytes."""
    keys, n, at = [], [np.zeros(1, np.int64)], 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT_BYTES, "right")) - 1)
        run = tokens_of(text[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        keys.append(run.keys)
        n.append(np.diff(run.offsets))
        at = to
    return Tokens(np.concatenate(keys), np.cumsum(np.concatenate(n)))


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Runs of sorted keys with the same leading bits."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    for b, (lo, hi) in enumerate(zip(edges, np.append(edges[1:], len(keys)))):
        if hi > lo:
            yield b, int(lo), int(hi)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the byte planes of their differences; the upper planes
    are nearly all zeros, which the shuffle's compression takes out."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def probes(keys: np.ndarray, level: np.ndarray | int, k: int) -> Iterator[np.ndarray]:
    """k hashes of (n-gram, level)."""
    h = mix(keys + np.asarray(level, np.uint64) * np.uint64(0xD1B54A32D192ED03))
    step = mix(h) | np.uint64(1)
    for _ in range(k):
        yield h >> np.uint64(32)
        h = h + step


@dataclass
class BloomCounts:
    """Segments of bits, addressed by the leading ``bits`` bits of a key."""

    bits: int
    k: int
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    n_tokens: int
    n_types: int
    mu: float

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts."""
        return VALUES[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels, one after the other until a probe fails."""
        level = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        segment = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        for q in range(1, len(LEVELS) + 1):
            own = segment[live]
            base, size = self.starts[own], self.sizes[own].astype(np.uint64)
            present = size > 0
            live, base, size = live[present], base[present], size[present]
            hit = np.ones(len(live), bool)
            for h in probes(keys[live], q, self.k):
                bit = (h * size) >> np.uint64(32)
                hit &= (self.data[base + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            live = live[hit]
            if not len(live):
                break
            level[live] = q
        return level

    def log_probabilities(self, tokens: Tokens) -> np.ndarray:
        """log10 P of every token."""
        distinct, same = np.unique(np.concatenate([tokens.keys, np.array([BEGIN])]), return_inverse=True)
        counts = self.count(distinct)
        c_w = counts[same[:-1]]
        c_h = after(c_w, tokens.offsets, counts[same[-1]])
        joint = np.zeros_like(c_w)
        seen = np.flatnonzero((c_w > 0) & (c_h > 0))
        joint[seen] = self.count(pair(tokens.histories()[seen], tokens.keys[seen]))
        return smoothed(c_w, c_h, joint, self.n_tokens, self.n_types, self.mu)


def after(values: np.ndarray, offsets: np.ndarray, first: float) -> np.ndarray:
    """Each token's predecessor's value, ``first`` at the start of a document."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[offsets[:-1]] = first
    return out


def smoothed(c_w: np.ndarray, c_h: np.ndarray, joint: np.ndarray, n_tokens: int, n_types: int, mu: float) -> np.ndarray:
    """log10 P from the counts of words, histories and bigrams."""
    unigram = (c_w + 1) / (n_tokens + n_types + 1)
    joint = np.minimum(joint, np.minimum(c_w, c_h))
    return np.log10(np.minimum(1.0, (joint + mu * unigram) / (c_h + mu)))


def segment_of(keys: np.ndarray, counts: np.ndarray, k: int, bits_per_entry: float, max_bits: int = 1 << 32) -> np.ndarray:
    """The filter segment of a range of n-grams.  Bits are addressed by 32-bit
    hashes; a segment that would need more fails rather than fill up."""
    top = np.searchsorted(LEVELS, counts, "right")
    n = int(top.sum())
    size = max(64, 8 * math.ceil(n * bits_per_entry / 8))
    if size > max_bits:
        raise ValueError(f"a segment of {size} bits is above {max_bits}: cut the filter into more segments")
    out = np.zeros(size, bool)
    for q in range(1, int(top.max(initial=0)) + 1):
        for h in probes(keys[top >= q], q, k):
            out[((h * np.uint64(size)) >> np.uint64(32)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def segment_bits(texts: DataFrame) -> int:
    return min(16, max(8, (4 * max(1, texts.rdd.getNumPartitions()) - 1).bit_length()))


def most_bytes(texts: DataFrame, bits: int, bits_per_entry: float) -> float:
    """What the filter of ``texts(text)`` takes at most: a word needs two bytes
    with its space, a document has an end and a begin, and no n-gram has more levels than
    occurrences."""
    size, n = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return ((size or 0) + 4 * n) * bits_per_entry / 8 + 9 * (1 << bits)


def train(
    texts: DataFrame,
    scratch: Scratch,
    mu: float,
    k: int,
    bits_per_entry: float,
    bits: int,
) -> tuple[BloomCounts, DataFrame]:
    """The model of ``texts(text)``, and the exact counts of the words as a
    table of packed ranges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, limit=TEXT_BYTES):
            tokens = tokens_of(data, offsets)
            begins = np.full(batch.num_rows, BEGIN)
            rows: list[tuple] = []
            for kind, keys in ((0, tokens.keys), (1, pair(tokens.histories(), tokens.keys)), (2, begins)):
                keys, counts = np.unique(keys, return_counts=True)
                counts = counts.astype(np.uint32)
                rows += [(b, kind, keys[lo:hi].tobytes(), counts[lo:hi].tobytes()) for b, lo, hi in by_bucket(keys, bits)]
            columns = list(zip(*rows))
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], names=["bucket", "kind", "keys", "counts"])

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for kind in (0, 1, 2):
            own = group[group["kind"] == kind]
            keys = np.frombuffer(b"".join(own["keys"]), np.uint64)
            counts = np.frombuffer(b"".join(own["counts"]), np.uint32).astype(np.int64)
            found[kind] = added(keys, counts)
        keys, counts = (np.concatenate([found[kind][i] for kind in (0, 1, 2)]) for i in (0, 1))
        words, n = found[0]
        row = {"bucket": [int(group["bucket"].iloc[0])], "bits": [segment_of(keys, counts, k, bits_per_entry).tobytes()]}
        row |= {"words": [words.tobytes()], "counts": [n.tobytes()], "n_types": [len(words)], "n_tokens": [int(n.sum())]}
        return pd.DataFrame(row)

    packed = texts.select("text").mapInArrow(count, "bucket int, kind int, keys binary, counts binary")
    merged = packed.groupBy("bucket").applyInPandas(reduce, "bucket int, bits binary, words binary, counts binary, n_types long, n_tokens long")
    merged = scratch.write(merged, "ranges")
    # only called where most_bytes bounds the segments together
    parts = sorted(merged.select("bucket", "bits", "n_types", "n_tokens").collect())
    sizes = np.zeros(1 << bits, np.int64)
    for r in parts:
        sizes[r["bucket"]] = 8 * len(r["bits"])
    starts = (np.cumsum(sizes) - sizes) // 8
    data = np.frombuffer(b"".join(bytes(r["bits"]) for r in parts), np.uint8)
    n_tokens, n_types = sum(r["n_tokens"] for r in parts), sum(r["n_types"] for r in parts)
    return BloomCounts(bits, k, data, starts, sizes, n_tokens, n_types, mu), merged.select("bucket", "words", "counts")


def head_words(ranges: DataFrame, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with n_tokens / HEAD occurrences or more: at most HEAD of them."""
    least = max(1, n_tokens / HEAD)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                n = np.frombuffer(counts, np.int64)
                top = n >= least
                yield pa.record_batch([pa.array([np.frombuffer(words, np.uint64)[top].tobytes()], pa.binary()), pa.array([n[top].tobytes()], pa.binary())], names=["words", "counts"])

    rows = ranges.mapInArrow(frequent, "words binary, counts binary").collect()
    words = np.frombuffer(b"".join(bytes(r["words"]) for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), np.int64)
    order = np.argsort(words)
    return words[order], counts[order]


def look_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of sorted ``table`` for ``keys``; -1 where there is none."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], -1)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_out_fold: int = 2,
    mu: float = 500.0,
    k: int = 3,
    bits_per_entry: float = 8.0,
    max_bytes: int = 64 << 20,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.

    Tokens are words (ASCII letters in lower case) and one end.  The counts come from all rows
    outside the held-out fold of crc32(id).  ``base_score`` uses exact
    add-one unigram counts, ``score`` the filter's smoothed bigrams; both are
    sums of log10 over the tokens.  ``max_bytes`` only decides whether the
    filter is broadcast or probed in its ranges, not its size.  Null text is empty: one token, the end.
    Without training rows every token is unknown.  Null ids fall in the fold of ''; rows may repeat.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    id_type = docs.schema[id_col].dataType
    # integers travel as text: pandas would make them doubles beside a null
    kind = "string" if isinstance(id_type, T.IntegralType) else id_type.simpleString()
    rows = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = rows.withColumn("held_out", fold_of(F.col("doc_id"), folds) == held_out_fold)
    learned = rows.where("not held_out")
    bits = segment_bits(learned)
    if most_bytes(learned, bits, bits_per_entry) > max_bytes:
        found, n_tokens = score_in_ranges(rows, kind, scratch, mu, k, bits_per_entry, bits)
    else:
        found, n_tokens = score_by_broadcast(rows, kind, scratch, mu, k, bits_per_entry, bits)
    held = fold_of(F.col("doc_id"), folds) == held_out_fold
    return found.select(F.col("doc_id").cast(id_type), held.alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_in_ranges(rows: DataFrame, kind: str, scratch: Scratch, mu: float, k: int, bits_per_entry: float, bits: int) -> tuple[DataFrame, int]:
    """Scores of ``rows(doc_id, text, held_out)`` with every n-gram counted and
    probed in the range of its segment, and the number of learned tokens.
    Nothing but two sums reaches the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows numbered, with the number of their slice."""
        task, n = TaskContext.get().partitionId() << 32, 0
        for number, (batch, _, _) in enumerate(slices(batches, limit=PROBE_BYTES)):
            columns = [pa.array(np.full(batch.num_rows, task + number)), pa.array(task + n + np.arange(batch.num_rows)), *batch.columns]
            yield pa.record_batch(columns, names=["slice", "row_no", *batch.schema.names])
            n += batch.num_rows

    cuts = scratch.write(rows.select("doc_id", "text", "held_out").mapInArrow(cut, f"slice long, row_no long, doc_id {kind}, text string, held_out boolean"), "slices")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct n-grams of each slice with their learned occurrences;
        those only to be scored have 0.  A slice that is read in parts is counted by
        parts, each named after its first row."""
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            number, row_no = batch.column("slice").to_numpy(), batch.column("row_no").to_numpy()
            edges = np.flatnonzero(np.diff(number, prepend=number[:1] - 1, append=number[-1:] + 1)).tolist()
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                tokens = tokens_in(*text_column(part.column("text")))
                docs = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                learn = np.repeat(docs, np.diff(tokens.offsets))
                for sort in (0, 1, 2):  # one after the other: each takes several times its keys
                    keys = tokens.keys if sort == 0 else pair(tokens.histories(), tokens.keys) if sort == 1 else np.full(len(docs), BEGIN)
                    keys, same = np.unique(keys, return_inverse=True)
                    counts = np.bincount(same[docs if sort == 2 else learn], minlength=len(keys)).astype(np.uint32)
                    del same
                    name = int(number[a]), int(row_no[a])
                    out = [(*name, b, sort, packed_keys(keys[lo:hi]), counts[lo:hi].tobytes()) for b, lo, hi in by_bucket(keys, bits)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["slice", "part", "bucket", "kind", "keys", "counts"])

    def probe(group: pd.DataFrame) -> pd.DataFrame:
        """Builds the segment of a range and answers the slices: levels of all
        n-grams, and exact counts of the words.  One more row has the range's sums."""
        bucket = int(group["bucket"].iloc[0])
        asked = [unpacked_keys(x) for x in group["keys"]]
        sorts = group["kind"].to_numpy()
        found = {}
        for sort in (0, 1, 2):
            own = np.flatnonzero(sorts == sort).tolist()
            counts = [np.frombuffer(group["counts"].iloc[i], np.uint32).astype(np.int64) for i in own]
            found[sort] = added(np.concatenate([asked[i] for i in own] or [np.empty(0, np.uint64)]), np.concatenate(counts or [np.empty(0, np.int64)]))
        keys, counts = (np.concatenate([found[sort][i] for sort in (0, 1, 2)]) for i in (0, 1))
        data = segment_of(keys[counts > 0], counts[counts > 0], k, bits_per_entry)
        sizes = np.zeros(1 << bits, np.int64)
        sizes[bucket] = 8 * len(data)
        segment = BloomCounts(bits, k, data, np.zeros(1 << bits, np.int64), sizes, 0, 0, mu)
        levels = {sort: segment.levels(found[sort][0]).astype(np.uint8) for sort in found}
        out = []
        for i, (number, part, sort) in enumerate(zip(group["slice"].tolist(), group["part"].tolist(), sorts.tolist())):
            at = np.searchsorted(found[sort][0], asked[i])
            out.append((number, part, bucket, sort, levels[sort][at].tobytes(), found[0][1][at].tobytes() if sort == 0 else None, 0, 0))
        n = found[0][1]
        out.append((-1, -1, bucket, -1, None, None, int((n > 0).sum()), int(n.sum())))
        return pd.DataFrame(out, columns=["slice", "part", "bucket", "kind", "levels", "counts", "n_types", "n_tokens"])

    asked = cuts.select("slice", "row_no", "text", "held_out").mapInArrow(count, "slice long, part long, bucket int, kind int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(probe, "slice long, part long, bucket int, kind int, levels binary, counts binary, n_types long, n_tokens long")
    answers = scratch.write(answers, "answers")
    n_types, n_tokens = (x or 0 for x in answers.agg(F.sum("n_types"), F.sum("n_tokens")).first())
    total = n_tokens + n_types + 1

    def finish(whole: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        whole = whole.sort_values("row_no")
        firsts = np.unique(told["part"])
        cuts = [*np.searchsorted(whole["row_no"], firsts).tolist(), len(whole)]
        return pd.concat([finish_part(whole.iloc[a:b], told[told["part"] == first]) for first, a, b in zip(firsts, cuts, cuts[1:])])

    def finish_part(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        tokens = tokens_in(*text_column(pa.array(own["text"], pa.large_string())))
        told = told.sort_values("bucket")  # ranges in order are distinct keys in order
        level = {sort: VALUES[np.frombuffer(b"".join(told.loc[told["kind"] == sort, "levels"]), np.uint8)] for sort in (0, 1, 2)}
        exact = np.frombuffer(b"".join(told.loc[told["kind"] == 0, "counts"]), np.int64)
        n = np.diff(tokens.offsets)
        doc = np.repeat(np.arange(len(n)), n)
        _, same = np.unique(tokens.keys, return_inverse=True)
        c_w = level[0][same]
        known = np.bincount(doc, (exact > 0)[same], len(n)).astype(np.int64)
        base = np.bincount(doc, np.log10(exact + 1.0)[same], len(n)) - n * math.log10(total)
        c_h = after(c_w, tokens.offsets, level[2][0])
        _, same = np.unique(pair(tokens.histories(), tokens.keys), return_inverse=True)
        joint = np.where((c_w > 0) & (c_h > 0), level[1][same], 0.0)
        score = np.bincount(doc, smoothed(c_w, c_h, joint, n_tokens, n_types, mu), len(n))
        return pd.DataFrame({"doc_id": own["doc_id"].tolist(), "n_tokens": n, "n_known": known, "base_score": base, "score": score})

    told = answers.where("kind >= 0").select("slice", "part", "bucket", "kind", "levels", "counts")
    parts = cuts.select("slice", "row_no", "doc_id", "text").groupBy("slice").cogroup(told.groupBy("slice"))
    return parts.applyInPandas(finish, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"), n_tokens


def score_by_broadcast(rows: DataFrame, kind: str, scratch: Scratch, mu: float, k: int, bits_per_entry: float, bits: int) -> tuple[DataFrame, int]:
    """As ``score_in_ranges``, with the filter broadcast."""
    spark = rows.sparkSession
    model, ranges = train(rows.where("not held_out"), scratch, mu, k, bits_per_entry, bits)
    total = model.n_tokens + model.n_types + 1
    # a filter of at most max_bytes, and at most HEAD words
    shared = spark.sparkContext.broadcast((model, head_words(ranges, model.n_tokens)))
    wide = bits - 3  # the tail goes to an eighth as many ranges

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, (words, counts) = shared.value
        slice_no = TaskContext.get().partitionId() << 32
        for batch, data, offsets in slices(batches, limit=TEXT_BYTES):
            tokens = tokens_of(data, offsets)
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(tokens.offsets))
            lm_score = np.bincount(doc, lm.log_probabilities(tokens), batch.num_rows)
            distinct, same = np.unique(tokens.keys, return_inverse=True)
            n = look_up(distinct, words, counts)
            rest = n < 0
            base = np.bincount(doc, np.log10(np.maximum(n, 0) + 1.0)[same], batch.num_rows)
            known = np.bincount(doc, (n > 0)[same], batch.num_rows).astype(np.int64)
            out: list[tuple] = []
            tail = np.flatnonzero(rest[same])
            order = tail[np.argsort(tokens.keys[tail], kind="stable")]
            keys, at = tokens.keys[order], doc[order]
            for b, lo, hi in by_bucket(keys, wide):
                out.append((b, slice_no, keys[lo:hi].tobytes(), at[lo:hi].tobytes(), None, None, None, None, None))
            out.append((
                (1 << wide) + slice_no % (1 << wide), slice_no, None, None, base.tobytes(), known.tobytes(),
                lm_score.tobytes(), np.diff(tokens.offsets).tobytes(), batch.slice(0).column("doc_id").to_pylist(),
            ))
            columns = list(zip(*out))
            types = [pa.int32(), pa.int64()] + [pa.binary()] * 6 + [pa.list_(batch.schema.field("doc_id").type)]
            names = ["bucket", "slice", "keys", "docs", "base", "known", "score", "n_tokens", "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            slice_no += 1

    schema = f"bucket int, slice long, keys binary, docs binary, base binary, known binary, score binary, n_tokens binary, ids array<{kind}>"

    def count_tail(group: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        """Counts of the tail words of a range, as sums per slice and document."""
        if not len(group):
            return group
        own = group["keys"].notna()
        words = np.frombuffer(b"".join(table["words"]), np.uint64)
        counts = np.frombuffer(b"".join(table["counts"]), np.int64)
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        for i in group.index[own]:
            at = np.frombuffer(group.at[i, "docs"], np.int32)
            n = np.maximum(look_up(np.frombuffer(group.at[i, "keys"], np.uint64), words, counts), 0)
            docs, place = np.unique(at, return_inverse=True)
            group.at[i, "keys"] = None
            group.at[i, "docs"] = docs.tobytes()
            group.at[i, "base"] = np.bincount(place, np.log10(n + 1.0), len(docs)).tobytes()
            group.at[i, "known"] = np.bincount(place, n > 0, len(docs)).astype(np.int64).tobytes()
        return group

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        """The sums of a slice, as one row per document."""
        whole = group[group["docs"].isna()].iloc[0]
        base = np.frombuffer(whole["base"], np.float64).copy()
        known = np.frombuffer(whole["known"], np.int64).copy()
        n = np.frombuffer(whole["n_tokens"], np.int64)
        for part in group[group["docs"].notna()].sort_values("bucket").itertuples():
            at = np.frombuffer(part.docs, np.int32)
            base[at] += np.frombuffer(part.base, np.float64)
            known[at] += np.frombuffer(part.known, np.int64)
        out = {"doc_id": list(whole["ids"]), "n_tokens": n, "n_known": known}
        out |= {"base_score": base - n * math.log10(total), "score": np.frombuffer(whole["score"], np.float64)}
        return pd.DataFrame(out)

    tails = rows.select("doc_id", "text").mapInArrow(score, schema)
    exact = ranges.withColumn("bucket", F.shiftright("bucket", 3))
    counted = tails.groupBy("bucket").cogroup(exact.groupBy("bucket")).applyInPandas(count_tail, schema)
    found = counted.groupBy("slice").applyInPandas(finish, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found, model.n_tokens
