"""Periodic runs of words by Kruskal's algorithm in order of descending LCP.

A run is a maximal stretch of words with smallest period q that is at least
``exponent`` periods and ``least`` words long.  If it starts at s, the suffixes at s and
s + q have in common exactly ``length - q`` words, and no suffix between them has as
many in common with both.  So, per document:

1. suffixes are put in order by prefix doubling (all documents of a slice at once;
   suffixes whose first words are unique in their document drop out early);
2. the neighbours in that order are edges weighted by their common prefix, and the
   edges are taken in descending order, uniting classes of suffixes (union-find).
   Each class keeps its positions in order; the smaller class goes into the larger;
3. two positions that become neighbours at a distance d within the common prefix seed a
   run of period d; once all edges of that prefix are in, those that are still
   neighbours, and that the word before does not extend, are the runs.

Edges too short to seed a run of the wanted length are left out; the others are
never sampled or capped.  Words are told apart by their bytes.  A document is one
row and is worked on by one task; its memory grows with its words alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiffin.llm.common import id_text, joined_words, slices, text_array, word_numbers, word_spans

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def shortest_prefix(exponent: int, least: int) -> int:
    """The least common prefix of two suffixes that may seed a run."""
    return min(max(least, exponent * q) - q for q in range(1, max(2, -(-least // exponent) + 1)))


def suffix_order(symbols: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Positions in suffix order, of the suffixes that share their first words
    (at least half of ``least``, rounded down to a power of two) with another one.
    ``ends``: the end of each position's document; documents have no symbol in common."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    active = order[np.repeat(sizes > 1, sizes)]
    width, shared = 1, active
    while len(active):
        after = active + width
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        group = np.append(True, first[1:] != first[:-1])
        fresh = group | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(active))
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(active)))
        since = np.repeat(heads, sizes) - np.maximum.accumulate(np.where(group, place, 0))
        rank[active] = first + since
        active = active[np.repeat(sizes > 1, sizes)]
        width *= 2
        if width <= least:
            shared = active
    return shared[np.argsort(rank[shared], kind="stable")]


def common_prefixes(words: list, order: list, ends: list, least: int) -> list:
    """The words that each suffix of ``order`` has in common with the one
    before, 0 across documents and possibly below ``least``.  In text order a suffix has
    at most one less in common than the suffix before it, so words are not compared again."""
    before = dict(zip(order[1:], order[:-1]))
    found, length, last = {}, 0, -2
    for i in sorted(order):
        length = length - 1 if i == last + 1 and length > least else 0
        j, end = before.get(i, -1), ends[i]
        if j < 0 or ends[j] != end:
            length = 0
        else:
            stop = end - max(i, j)
            while length < stop and words[i + length] == words[j + length]:
                length += 1
        found[i], last = length, i
    return [found[i] for i in order]


def runs_of(words: list, begin: int, order: list, prefixes: list, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one document, by start, then period.
    ``order``: its shared suffixes in order, ``prefixes``: in common with the one before."""
    n = len(order)
    root = list(range(n))
    held = [[p] for p in order]
    node = {p: i for i, p in enumerate(order)}
    shortest = shortest_prefix(exponent, least)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    runs, seeds = [], []

    def settle() -> None:
        """Of the seeds of one prefix length, those that are still neighbours."""
        for i, d, prefix in seeds:
            own = held[find(node[i])]
            if own[bisect_left(own, i) + 1] == i + d:
                runs.append((i - begin, d + prefix, d))
        seeds.clear()

    def meet(i: int, j: int, prefix: int) -> None:
        d = j - i
        if (exponent - 1) * d <= prefix and d + prefix >= least and (i == begin or words[i - 1] != words[j - 1]):
            seeds.append((i, d, prefix))

    level = 0
    for prefix, at in sorted(((p, i) for i, p in enumerate(prefixes) if i and p >= shortest), key=lambda e: -e[0]):
        if prefix != level and seeds:
            settle()
        level = prefix
        a, b = find(at - 1), find(at)
        big, small = (held[a], held[b]) if len(held[a]) >= len(held[b]) else (held[b], held[a])
        if small[0] > big[-1]:
            meet(big[-1], small[0], prefix)
            big.extend(small)
        else:
            last = -1
            for x in small:
                place = bisect_left(big, x)
                if place and big[place - 1] != last:
                    meet(big[place - 1], x, prefix)
                if place < len(big):
                    meet(x, big[place], prefix)
                big.insert(place, x)
                last = x
        root[b], held[a], held[b] = a, big, None
    if seeds:
        settle()
    return sorted(runs, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Greatest length / period, exactly; of ties the first, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    exponent: int = 4,
    least: int = 6,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs`` (by start, then period;
    word numbers from 0), ``best`` (greatest length/period; null without a run) and,
    ``with_text``, ``collapsed``: the words, joined by one space, without those that a run
    contains after its first period.

    Words are runs of bytes that are no ASCII white space.  Null text has no
    words; repeated rows each have their result; other columns are not read.
    ``exponent`` is 2 or more.
    """
    if exponent < 2:
        raise ValueError("exponent must be at least 2")
    shortest = shortest_prefix(exponent, least)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, limit=1 << 20):
            starts, ends, docs_at = word_spans(data, offsets)
            numbers = word_numbers(data, starts, ends)
            counts = np.diff(docs_at)
            owner = np.repeat(np.arange(len(counts)), counts)
            symbols = owner * (numbers.max(initial=0) + 1) + numbers
            stop = docs_at[1:][owner]
            order = suffix_order(symbols, stop, shortest)
            words, own_stop = numbers.tolist(), stop.tolist()
            prefixes = common_prefixes(words, order.tolist(), own_stop, shortest)
            cuts = np.searchsorted(owner[order], np.arange(len(counts) + 1))
            found, best, gone = [], [], np.zeros(len(words) + 1, np.int64)
            for doc, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                begin = int(docs_at[doc])
                runs = runs_of(words, begin, order[a:b].tolist(), prefixes[a:b], exponent, least) if b > a else []
                for s, length, q in runs:
                    gone[begin + s + q] += 1
                    gone[begin + s + length] -= 1
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                top = best_run(runs)
                best.append(dict(zip(("start", "length", "period"), top)) if top else None)
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN)]
            names = ["doc_id", "n_words", "runs", "best"]
            if with_text:
                columns.append(text_array(*joined_words(data, starts, ends, docs_at, np.cumsum(gone[:-1]) == 0)).cast(pa.string()))
                names.append("collapsed")
            yield pa.record_batch(columns, names=names)

    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(run)),
        T.StructField("best", run),
        *[T.StructField("collapsed", T.StringType())] * with_text,
    ])
    return id_text(docs, id_col, text_col).mapInArrow(search, schema)


def planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of every document, a tenth of them (by the CRC of the id)
    with a periodic end, as the query's contract has it: with h the CRC and
    g = h div 10, the words from a = g mod n on give way to the first
    1 + (n - a) div (3 + g mod 8) of them on repeat."""
    read = id_text(docs, id_col, text_col)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    read = read.withColumn("words", F.when(h % 10 == 0, words)).withColumn("g", F.floor(h / 10))
    read = read.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    period = (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int")
    again = F.array_repeat(F.slice("words", F.col("a") + 1, period), F.ceil(left / period).cast("int"))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(again), F.lit(1), left))
    return read.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
