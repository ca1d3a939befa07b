"""Best-fit packing of documents into token sequences by bin completion.

Only the lengths decide a packing, and there are at most ``capacity`` of them.
So Spark counts the pieces of each length, bin completion works on those
at most ``capacity`` counts, and Spark deals the pieces, ranked within
their length, to the places of the plan.  Nothing that grows with the documents
reaches the driver, and the packing is one over all documents, not one per
partition.

Bin completion (Korf 2003): around the largest remaining length, enumerate the
fillings that no other filling dominates, least waste first, and branch over
them; a branch ends when its waste exceeds what the incumbent leaves.  The
first incumbent is best-fit decreasing.  A chosen filling is used as often as
the counts allow (a later one with waste once), so a plan has few distinct bins
however many documents there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.llm.bpe import ENCODE_BYTES, encode_slice, vocabulary
from tiffin.llm.common import Scratch, fresh, id_text, slices

#: Ranks within a length are counted in parts, at least so many and one for
#: PART_ROWS pieces, so that a length that a third of all pieces have is ranked in parts too.
RANK_PARTS, PART_ROWS = 256, 1 << 18

#: A filling: how often it is used, and its lengths from the largest on.
Plan = list[tuple[int, tuple[int, ...]]]


def cut_pieces(
    docs: DataFrame,
    vocab_path: str,
    end_id: int = 2,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if kept).  A
    document is its ids and ``end_id``; only one longer than ``capacity`` is
    cut, into full pieces after a first one that takes the rest."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch, data, offsets in slices(batches, limit=ENCODE_BYTES):
            ids, spread = encode_slice(vocab, data, offsets)
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row in range(batch.num_rows):
                whole = np.append(ids[spread[row] : spread[row + 1]], end_id).astype("<u4")
                n = len(whole)
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                raw = memoryview(whole.tobytes())
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if keep_ids:
                        kept.append(whole[a:b].astype(np.int32))
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int32())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 1024, nodes: int = 6000, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` (any columns; ``length`` from 1 to ``capacity``) with
    ``sequence_id`` and ``offset``: sequences are gapless from offset 0.

    Pieces of the same length change places freely (ties go by the hash of the
    row); repeated rows are pieces of their own; an empty table gives none.
    """
    scratch = scratch or Scratch(pieces.sparkSession, "packing")
    held = pieces.columns
    clash = {"sequence_id", "offset"} & {c.lower() for c in held}
    if clash:
        raise ValueError(f"the input has columns {sorted(clash)} already")
    row, part, base, place, seat = (fresh(f"_{c}", held) for c in ("row", "part", "base", "place", "seat"))
    pieces = scratch.write(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    n_parts = max(RANK_PARTS, pieces.count() // PART_ROWS)
    pieces = pieces.withColumn(part, F.pmod(F.xxhash64(row), F.lit(n_parts)).cast("int"))

    n = fresh("_n", ["length", part])
    parts = scratch.write(pieces.groupBy("length", part).agg(F.count("*").alias(n)), "counts")
    counts = {r["length"]: r[n] for r in parts.groupBy("length").agg(F.sum(n).alias(n)).collect()}
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    plan = plan_bins(counts, capacity, nodes)

    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    own = Window.partitionBy("length", part).orderBy(row)
    # the window and the join share one exchange of the pieces
    ranked = pieces.withColumn(place, F.row_number().over(own)).join(bases, ["length", part])
    found = ranked.withColumn(seat, seats(plan, counts)(F.col("length"), F.col(base) + F.col(place) - 1))
    return found.select(*[F.col(f"`{c}`") for c in held], F.col(seat)["sequence_id"].alias("sequence_id"), F.col(seat)["offset"].alias("offset"))


def seats(plan: Plan, counts: dict[int, int]) -> Callable[[Column, Column], Column]:
    """The sequence and offset of the piece with a length and a rank among the
    pieces of that length, by binary search in the plan.  The plan that tasks get has an
    entry for each filling and different length in it: a bound from ``capacity``
    and ``nodes`` that does not grow with the pieces."""
    first = np.zeros(max(counts, default=0) + 1, np.int64)  # ranks over all lengths, one length after the other
    lengths = sorted(counts)
    first[lengths] = np.cumsum([0, *(counts[x] for x in lengths)])[:-1]
    entries = sorted((int(first[length]) + low, *rest) for length, low, *rest in place_rows(plan))
    low, times, sequence, offset = np.array(entries, np.int64).reshape(-1, 4).T

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        own = length.to_numpy(np.int64)
        rank = first[own] + rank.to_numpy(np.int64)
        at = np.searchsorted(low, rank, "right") - 1
        after = rank - low[at]
        return pd.DataFrame({"sequence_id": sequence[at] + after % times[at], "offset": offset[at] + after // times[at] * own})

    return seat


def place_rows(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """For each filling and each different length in it: the length, the first rank
    that it takes, the filling's number of sequences, the first of these, and the
    offset.  Ranks go round the sequences, once for each copy of the length."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for times, filling in plan:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            copies = filling.count(length)
            low = used.get(length, 0)
            rows.append((length, low, times, first, offset))
            used[length] = low + times * copies
            offset += length * copies
        first += times
    return rows


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: the larger of the volume bound and, for each
    threshold, items over capacity - k, items over half, and what must follow."""
    best = math.ceil(sum(x * n for x, n in counts.items()) / capacity)
    for k in sorted(x for x in counts if x <= capacity // 2):
        big = sum(n for x, n in counts.items() if x > capacity - k)
        middle = [(x, n) for x, n in counts.items() if capacity / 2 < x <= capacity - k]
        rest = sum(x * n for x, n in counts.items() if k <= x <= capacity / 2)
        spare = sum((capacity - x) * n for x, n in middle)
        best = max(best, big + sum(n for _, n in middle) + max(0, math.ceil((rest - spare) / capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: bins by free space, fullest first; the items of
    one length go to the fullest bins that still hold them, then to new ones."""
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(s for s in free if s >= length):
            while left and free.get(space):
                times, filling = free[space].pop()
                # a bin takes the length as often as it fits before the next bin is opened
                fit = min(space // length, left)
                bins = min(times, left // fit)
                left -= fit * bins
                free.setdefault(space - fit * length, []).append((bins, filling + (length,) * fit))
                if times > bins:
                    free[space].append((times - bins, filling))
                    if fit > left:
                        continue
            if not left:
                break
        fit = capacity // length
        if left // fit:
            free.setdefault(capacity - fit * length, []).append((left // fit, (length,) * fit))
        if left % fit:
            free.setdefault(capacity - left % fit * length, []).append((1, (length,) * (left % fit)))
    return [b for bins in free.values() for b in bins if b[0]]


def candidates(counts: dict[int, int], space: int, allowed: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings of ``space`` with a waste of at most ``allowed``, least waste
    first and larger items first; None in place of a dominated one.  A filling
    that leaves room for a remaining item, or in which one item could be exchanged for a
    larger remaining one that still fits, is dominated."""
    lengths = sorted((x for x in counts if x <= space), reverse=True)
    # sums[i]: bit s is set if lengths[i:] can add up to s (repeats up to the counts)
    sums = [1]
    mask = (1 << (space + 1)) - 1
    for x in reversed(lengths):
        reach, n, step = sums[-1], min(counts[x], space // x), 1
        while n:
            take = min(step, n)
            reach |= (reach << (take * x)) & mask
            n -= take
            step *= 2
        sums.append(reach)
    sums.reverse()

    def fill(i: int, room: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if room == 0:
            yield chosen
            return
        while i < len(lengths) and sums[i] >> room & 1:
            x = lengths[i]
            for k in range(min(counts[x], room // x), 0, -1):
                if sums[i + 1] >> (room - k * x) & 1:
                    yield from fill(i + 1, room - k * x, chosen + (x,) * k)
            i += 1

    for waste in range(0, min(allowed, space) + 1):
        if sums[0] >> (space - waste) & 1:
            for filling in fill(0, space - waste, ()):
                yield filling if undominated(filling, counts, waste) else None


def fillings(counts: dict[int, int], space: int, allowed: int, limit: int) -> list[tuple[int, ...]]:
    """The first ``limit`` undominated fillings."""
    return list(islice((f for f in candidates(counts, space, allowed) if f is not None), limit))


def undominated(filling: tuple[int, ...], counts: dict[int, int], waste: int) -> bool:
    if not waste:
        return True
    for x in counts:
        spare = counts[x] - filling.count(x)
        if spare > 0 and (x <= waste or any(y < x <= y + waste for y in filling)):
            return False
    return True


#: A branch with more lengths than this is enumerated anew when the search
#: comes back to it, instead of being kept.
KEPT_LENGTHS = 128


@dataclass
class Branch:
    """A place in the search: how many candidates were looked at, how many of
    them used, and the further ones."""

    looked: int = 0
    used: int = 0
    more: Iterator[tuple[int, ...] | None] | None = None


def plan_bins(counts: dict[int, int], capacity: int, nodes: int = 6000) -> Plan:
    """The best plan found by looking at ``nodes`` fillings; deterministic.  The
    search goes depth first over all undominated fillings of the bin with the largest
    remaining length, and comes back to the last choice first."""
    left = {x: n for x, n in counts.items() if n > 0}
    if not left:
        return []
    best = best_fit(left, capacity)
    best_bins = sum(t for t, _ in best)
    bound = lower_bound(left, capacity)
    volume = sum(x * n for x, n in left.items())
    chosen: Plan = []
    bins = wasted = 0
    branches = [Branch()]
    while branches and nodes > 0:
        here = branches[-1]
        # a better plan wastes at least one bin less than the incumbent
        allowed = (best_bins - 1) * capacity - volume - wasted
        filling = None
        if not left:
            if bins < best_bins:
                best, best_bins = list(chosen), bins
                if best_bins <= bound:
                    break
        elif allowed >= 0 and best_bins > bound:
            x = max(left)
            if here.more is None:
                rest = {y: n - (y == x) for y, n in left.items() if n - (y == x)}
                here.more = islice(candidates(rest, capacity - x, allowed), here.looked, None)
            for other in here.more:
                here.looked += 1
                nodes -= 1
                if other is not None and capacity - x - sum(other) <= allowed:
                    filling = (x, *other)
                if other is not None or nodes <= 0:
                    break
        if filling is None:
            branches.pop()
            if chosen:
                times, last = chosen.pop()
                bins, wasted = bins - times, wasted - times * (capacity - sum(last))
                for y in last:
                    left[y] = left.get(y, 0) + times
            continue
        if len(left) > KEPT_LENGTHS:
            here.more = None
        waste = capacity - sum(filling)
        times = min(left[y] // filling.count(y) for y in set(filling))
        if here.used and waste:
            times = 1
        here.used += 1
        for y in set(filling):
            left[y] -= times * filling.count(y)
            if not left[y]:
                del left[y]
        chosen.append((times, filling))
        bins, wasted = bins + times, wasted + times * waste
        branches.append(Branch())
    return best
