"""Byte-pair encoding with forced-boundary splitting, and decoding.

A merge can only join bytes that stand side by side inside some token.  A byte
pair that occurs inside no token of the vocabulary therefore marks a certain
cut: no encoding ever joins its two bytes, so the fragments between cuts are
encoded independently and concatenated.  Text is first split by the
byte-level pre-tokeniser's pattern, worked out here on whole arrays of code points;
equal pieces of a slice are encoded once, and the merges run on
all fragments of the slice at once, one rank per fragment and round.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiffin.llm.common import id_text, prefix_hash, slices, span_hash

#: Text bytes encoded at once, and the fragment length from which a heap is
#: used instead of rounds over the whole fragment.
ENCODE_BYTES = 1 << 20
COMPARE_BYTES = 1 << 16
DECODE_ROWS = 256
LONG_FRAGMENT = 192

# Code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe as a contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

NONE = np.int32(np.iinfo(np.int32).max)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """For each code point 0 other, 1 letter, 2 number, 3 white space."""
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            classes[c] = 1
        elif kind == "N":
            classes[c] = 2
    classes[WHITE_SPACE] = 3
    return classes


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and certain cuts of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.tokens: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.special = {}
        for added in spec.get("added_tokens", []):
            i, content = added["id"], added["content"].encode()
            self.tokens += [b""] * (i + 1 - len(self.tokens))
            self.tokens[i] = content
            self.special[content] = i
        self.of_byte = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.joined = np.zeros((256, 256), bool)
        for token in self.tokens:
            t = np.frombuffer(token, np.uint8)
            self.joined[t[:-1], t[1:]] = True
        self._table()
        self.packed = pa.array(self.tokens, pa.large_binary())
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def _table(self) -> None:
        """Open addressing over the merge pairs."""
        bits = max(4, (4 * len(self.merges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        for (a, b), (rank, made) in self.merges.items():
            key = a << 32 | b
            slot = ((key * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, made

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged token of each pair; rank NONE where there is none."""
        keys = a.astype(np.int64) << 32 | b
        slots = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.keys[slots]
        lost = np.flatnonzero((held != keys) & (held >= 0))
        while len(lost):
            slots[lost] = (slots[lost] + 1) & self.mask
            held = self.keys[slots[lost]]
            lost = lost[(held != keys[lost]) & (held >= 0)]
        found = self.keys[slots] == keys
        return np.where(found, self.ranks[slots], NONE), self.made[slots]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def special_bounds(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Segment starts (documents, and special tokens and what follows them),
    and the starts of special tokens."""
    raw, extra, marks = None, [], []
    for content in special:
        raw = data.tobytes() if raw is None else raw
        at = raw.find(content)
        while at >= 0:
            document = int(np.searchsorted(offsets, at, "right"))
            if at + len(content) <= offsets[document]:
                marks.append(at)
                extra += [at, at + len(content)]
            at = raw.find(content, at + len(content))
    bounds = np.unique(np.concatenate([offsets, np.array(extra, np.int64)]))
    return bounds, np.array(sorted(marks), np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]) -> np.ndarray:
    """Byte starts of the pre-tokeniser's pieces; none crosses a document."""
    if not len(data):
        return np.empty(0, np.int64)
    bounds, marks = special_bounds(data, offsets, special)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)  # byte where each code point begins
    kind = char_classes()[points]
    n = len(points)
    edge = np.zeros(n + 1, bool)  # a segment begins here
    edge[np.searchsorted(lead, bounds)] = True
    edge[n] = True

    run = np.empty(n + 1, bool)  # a run of one class begins here
    run[0] = run[n] = True
    run[1:n] = kind[1:] != kind[:-1]
    run |= edge
    start = run.copy()
    white = kind == 3
    blank = points == 32
    # the last white space of a run that is followed by ink stands apart; a space goes with the ink
    tail = np.flatnonzero(white & run[1:] & ~edge[1:])
    start[tail] = True
    start[tail[blank[tail]] + 1] = False
    # contractions
    alone = np.flatnonzero((points == 39) & run[:-1] & run[1:] & ~edge[1:])
    after_space = (alone > 0) & blank[alone - 1] & ~edge[alone]
    for at in alone[~after_space].tolist():
        ahead = points[at + 1 : at + 3]
        for ending in CONTRACTIONS:
            k = len(ending)
            if k <= len(ahead) and all(int(ahead[i]) == ord(ending[i]) for i in range(k)) and not edge[at + 1 : at + 1 + k].any():
                start[at + 1] = False
                start[at + 1 + k] = True
                break
    begin = np.flatnonzero(start[:n])
    found = lead[begin].astype(np.int64)
    if len(marks):
        length = {m: next(len(c) for c in special if data[m : m + len(c)].tobytes() == c) for m in marks.tolist()}
        inside = np.zeros(len(data), bool)
        for m, k in length.items():
            inside[m + 1 : m + k] = True
        found = np.union1d(found[~inside[found]], marks)
    return found


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each kind, and the kind of every piece.  Pieces are brought
    together by a hash and compared byte by byte with the one that stands for
    them; one that differs (equal hashes can be made on purpose) stands for itself."""
    _, first, same = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    lengths, model = ends - starts, first[same]
    differs = lengths != lengths[model]
    copies = np.flatnonzero((model != np.arange(len(starts))) & ~differs & (lengths > 0))
    upto = np.cumsum(lengths[copies])
    block = upto // COMPARE_BYTES  # pieces are compared in blocks of about so many bytes
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
        own = copies[lo:hi]
        sizes = lengths[own]
        base = np.cumsum(sizes) - sizes
        step = np.arange(int(sizes.sum()))
        unequal = np.flatnonzero(data[step + np.repeat(starts[own] - base, sizes)] != data[step + np.repeat(starts[model[own]] - base, sizes)])
        differs[own[np.searchsorted(base, unequal, "right") - 1]] = True
    alone = np.flatnonzero(differs)
    same[alone] = len(first) + np.arange(len(alone))
    return np.append(first, alone), same


def encode_slice(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents of a slice, and the n+1 offsets into them."""
    starts = pieces(data, offsets, vocab.special)
    if not len(starts):
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    ends = np.append(starts[1:], len(data))
    first, same = distinct_pieces(data, starts, ends)
    ids, spread = encode_pieces(vocab, data, starts[first], ends[first])
    lengths = np.diff(spread)[same]
    into = np.cumsum(lengths)
    take = np.arange(int(into[-1]), dtype=np.int32) + np.repeat((spread[:-1][same] - (into - lengths)).astype(np.int32), lengths)
    piece_of = np.searchsorted(starts, offsets)
    return ids[take], np.concatenate([[0], into])[piece_of]


def encode_pieces(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces, piece after piece, and their n+1 offsets."""
    lengths = ends - starts
    total = int(lengths.sum())
    base = np.cumsum(lengths) - lengths
    raw = data[np.repeat(starts - base, lengths) + np.arange(total)]
    # certain cuts: ends of pieces, and byte pairs inside no token
    last = np.empty(total, bool)
    last[:-1] = ~vocab.joined[raw[:-1], raw[1:]]
    last[base[1:] - 1] = True
    last[-1] = True
    special = {}
    for content, i in vocab.special.items():
        for p in np.flatnonzero(lengths == len(content)).tolist():
            if raw[base[p] : base[p] + len(content)].tobytes() == content:
                special[p] = i
                last[base[p] : base[p] + len(content)] = True
    cuts = np.flatnonzero(last)
    begins = np.concatenate([[0], cuts[:-1] + 1])
    ids, counts = encode_fragments(vocab, raw, begins, cuts + 1)
    per_piece = np.add.reduceat(counts, np.searchsorted(begins, base)) if len(base) else counts
    spread = np.concatenate([[0], np.cumsum(per_piece)])
    if special:
        parts = []
        for p in range(len(per_piece)):
            own = ids[spread[p] : spread[p + 1]]
            parts.append(np.array([special[p]], np.int32) if p in special else own)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return ids, spread


def encode_fragments(vocab: Vocabulary, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of fragments, in order, and how many each has."""
    sizes = ends - begins
    owner = np.repeat(np.arange(len(begins), dtype=np.int32), sizes)
    ids = vocab.of_byte[raw]
    done_owner, done_ids = [], []
    for f in np.flatnonzero(sizes > LONG_FRAGMENT).tolist():
        merged = merge_by_heap(vocab, ids[begins[f] : ends[f]].tolist())
        done_owner.append(np.full(len(merged), f, np.int32))
        done_ids.append(np.array(merged, np.int32))
    rest = (sizes <= LONG_FRAGMENT)[owner]
    owner, ids = owner[rest], ids[rest]
    while len(ids):
        new = np.empty(len(ids), bool)
        new[0] = True
        np.not_equal(owner[1:], owner[:-1], out=new[1:])
        rank = np.full(len(ids), NONE)
        made = np.zeros(len(ids), np.int32)
        inner = np.flatnonzero(~new[1:])
        rank[inner], made[inner] = vocab.look_up(ids[inner], ids[inner + 1])
        heads = np.flatnonzero(new)
        best = np.minimum.reduceat(rank, heads)
        span = np.diff(np.append(heads, len(ids)))
        wanted = np.repeat(best, span)
        over = wanted == NONE
        done_owner.append(owner[over])
        done_ids.append(ids[over])
        hit = np.flatnonzero((rank == wanted) & ~over)
        if not len(hit):
            break
        # of overlapping equal pairs (x x x) every other one, from the left
        fresh = np.empty(len(hit), bool)
        fresh[0] = True
        np.not_equal(hit[1:], hit[:-1] + 1, out=fresh[1:])
        from_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        hit = hit[from_run % 2 == 0]
        ids[hit] = made[hit]
        stay = ~over
        stay[hit + 1] = False
        owner, ids = owner[stay], ids[stay]
    owners = np.concatenate(done_owner) if done_owner else owner
    order = np.argsort(owners, kind="stable")
    return np.concatenate(done_ids)[order] if done_ids else ids, np.bincount(owners, minlength=len(begins))


def merge_by_heap(vocab: Vocabulary, ids: list[int]) -> list[int]:
    """A long fragment: merges in order of (rank, place) from a heap."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(vocab.merges[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in vocab.merges]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = vocab.merges[a, b][1]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n:
                pair = (ids[left], ids[after[left]])
                if pair in vocab.merges:
                    heapq.heappush(heap, (vocab.merges[pair][0], left, *pair))
    return [x for x, live in zip(ids, alive) if live]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row, in one pass without a
    shuffle.  Null and empty texts have no ids; special tokens' strings in a
    text become their ids; ids may be null or repeated; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch, data, offsets in slices(batches, limit=ENCODE_BYTES):
            ids, spread = encode_slice(vocab, data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(spread, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = id_text(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The input's columns and the text of the ids (special tokens stay; bytes
    that are no UTF-8 become U+FFFD; null ids are an empty text)."""
    if into in encoded.columns:
        raise ValueError(f"the input has a column {into!r} already")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in (b.slice(i, DECODE_ROWS) for b in batches for i in range(0, b.num_rows, DECODE_ROWS)):
            lists = batch.column(ids_col).fill_null([])
            ids, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            joined = vocab.packed.take(ids)
            raw = joined.buffers()[2].to_pybytes() if len(ids) else b""
            at = np.concatenate([[0], np.cumsum(vocab.lengths[ids.to_numpy()])])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return encoded.mapInArrow(run, f"{fields}, `{into}` string")
