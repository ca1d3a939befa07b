"""Nearest neighbours by cosine with stable projections and a kd-tree.

Unit vectors are projected to DIMENSIONS Gaussian (2-stable) directions.  For
a pair at distance r the squared projected distance is r^2 times a chi-square
variable with DIMENSIONS degrees of freedom.  So a search may stop once the
next projected distance d satisfies P(chi2 <= d^2 / r_k^2) >= confidence, r_k
being the distance of the k-th neighbour found so far (Sun et al. 2014).

The upper levels of the kd-tree cut the projected space into cells, fitted on
a bounded sample; every vector is indexed in its cell.  A query first searches
its own cell, which gives r_k, then all other cells whose box passes the same
test; in a cell the leaves of its own kd-tree are visited in the order of their projected
distance until the test holds.  Equal vectors are indexed once with their smallest ids, and
equal queries searched once, so a vector that many rows hold costs as much as any other.

Equal queries may have different ids, and each leaves out the rows of its own.  So a search keeps
the shortest list of best rows that has k rows without those of any one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.llm.common import Scratch, salted_left_join

DIMENSIONS = 8
LEAF = 256
#: What rounding may move a projected distance or a score by.
SLACK = 1e-9
#: Vectors in a cell on average, cells at most, and vectors of a cell that one task searches.
CELL, MAX_CELLS, PART = 4096, 4096, 1 << 16
#: Queries that one task searches a part of a cell for.
POSED = 4096
#: Vectors of the sample on which cells are fitted.
SAMPLE = 20_000


def chi_square_bound(confidence: float, degrees: int = DIMENSIONS) -> float:
    """x with P(chi2 <= x) = confidence, for even degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term, tail = np.exp(-x / 2), 0.0
        for i in range(degrees // 2):
            tail += term
            term *= x / 2 / (i + 1)
        low, high = (x, high) if 1 - tail < confidence else (low, x)
    return high


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(20).normal(size=(width, DIMENSIONS))


def matrix(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> tuple[DataFrame, str, int]:
    """``id, vec`` (bytes) of the vectors that take part, their number type,
    and their width: the most frequent one (of equally frequent ones the larger)
    if it is not given."""
    kind = "<f8" if "double" in vectors.schema[vector_col].dataType.simpleString() else "<f4"
    v = vectors[vector_col]
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    if width is None:
        widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
        width = widths["width"] if widths else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1) + 0.0
            raw = [r.tobytes() for r in x.astype(kind)]
            yield pa.record_batch([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "vec"])

    return rows.where(F.size("v") == width).mapInArrow(pack, "id long, vec binary"), kind, width


@dataclass
class Cells:
    """The upper levels of the tree: node i splits on ``axis[i]`` at
    ``value[i]``; its children are 2i+1 and 2i+2."""

    depth: int
    axis: np.ndarray
    value: np.ndarray

    @staticmethod
    def fit(points: np.ndarray, depth: int) -> Cells:
        n = (1 << depth) - 1
        cells = Cells(depth, np.zeros(n, np.int64), np.zeros(n))
        groups = [points]
        for i in range(n):
            own = groups[i]
            if len(own):
                cells.axis[i] = int(own.var(axis=0).argmax())
                cells.value[i] = float(np.median(own[:, cells.axis[i]]))
            left = own[:, cells.axis[i]] < cells.value[i]
            groups += [own[left], own[~left]]
        return cells

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.value[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def leaves_of(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree: row numbers, split at the median of the widest
    axis; points that all agree stay in one leaf."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        own = points[rows]
        spread = own.max(axis=0) - own.min(axis=0)
        axis = int(spread.argmax())
        if len(rows) <= LEAF or spread[axis] == 0:
            out.append(rows)
            continue
        order = rows[np.argsort(own[:, axis], kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def shortest(ranked: list[tuple[float, int]], k: int) -> tuple[list[tuple[float, int]], bool]:
    """The first of the ranked (-score, id) until k are left without those of
    any one id, and whether that is reached.  Of an id no more than k count."""
    out, counts, most = [], {}, 0
    for entry in ranked:
        n = counts.get(entry[1], 0) + 1
        if n > k:
            continue
        counts[entry[1]] = n
        out.append(entry)
        most = max(most, n)
        if len(out) - most >= k:
            return out, True
    return out, False


class CellIndex:
    """A cell's own kd-tree over projected points, with the original vectors;
    the rows of a leaf lie side by side."""

    def __init__(self, raw: np.ndarray, ids: list[list[int]], project: np.ndarray):
        points = units(raw) @ project
        leaves = leaves_of(points)
        order = np.concatenate(leaves)
        self.raw, self.points, self.ids = raw[order], points[order], [ids[i] for i in order.tolist()]
        self.norms = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.squares = (self.points * self.points).sum(axis=1)
        self.edges = np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).tolist()
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def search(self, q: np.ndarray, p: np.ndarray, k: int, bound: float, radius2: float) -> list[tuple[float, int]]:
        """The ``shortest`` list of best (score, id) for k; ``radius2`` is the
        squared distance of the last of such a list known so far."""
        gap = np.maximum(0, np.maximum(self.low - p, p - self.high))
        far = (gap * gap).sum(axis=1)
        norm, square = float(np.sqrt(q @ q)), float(p @ p)
        best: list[tuple[float, int]] = []  # (-score, id), best first
        full = False
        for leaf in np.argsort(far, kind="stable").tolist():
            if far[leaf] > bound * radius2 + SLACK:
                break
            rows = slice(self.edges[leaf], self.edges[leaf + 1])
            near = self.squares[rows] - 2 * (self.points[rows] @ p) + square
            scores = np.where(near <= bound * radius2 + SLACK, (self.raw[rows] @ q) / (self.norms[rows] * norm), -np.inf)
            some = np.flatnonzero(scores >= -best[-1][0] - SLACK if full else scores > -np.inf)
            for at in some[np.argsort(-scores[some], kind="stable")].tolist():
                if full and scores[at] < -best[-1][0] - SLACK:
                    break
                row = rows.start + at
                # summed in the order of the components, whatever rows stand beside it
                score = float((self.raw[row] * q).sum() / (self.norms[row] * norm))
                best, full = shortest(sorted(best + [(-score, i) for i in self.ids[row]]), k)
            if full:
                radius2 = min(radius2, max(0.0, 2 + 2 * best[-1][0]))
        return [(-s, i) for s, i in best]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    confidence: float = 0.95,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` (same
    columns) the k nearest rows of ``vectors`` other than that of its own id;
    ties go to the smaller id.

    Vectors that are null, zero, hold null or non-finite components or differ in
    width from the most frequent width of ``vectors`` take no part, nor do null ids.  Of rows
    repeated with the same id and vector each may be a candidate.  Fewer than
    k candidates give fewer ranks; none give none.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    base, kind, width = usable(vectors, id_col, vector_col)
    asked, _, _ = usable(queries, id_col, vector_col, width)
    project, bound = directions(max(1, width)), chi_square_bound(confidence)

    # equal vectors tie for every query, so only the smallest k + 1 ids of each can be among the
    # nearest, one of which may be the query's own; an id has its copies, k of them at most
    by_id = Window.partitionBy("vec").orderBy("id")
    rows = base.groupBy("vec", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    few = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    few = few.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("id", "copies"))).alias("few"))
    ids = F.slice(F.flatten(F.transform("few", lambda x: F.array_repeat(x["id"], x["copies"]))), 1, 2 * k)
    classes = scratch.write(few.select("vec", ids.alias("ids")), "classes")
    n_classes = classes.count()
    depth = int(np.clip(np.ceil(np.log2(max(1, n_classes) / CELL)), 0, np.log2(MAX_CELLS)))
    sample = classes.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).collect() if depth else []
    points = units(matrix([bytes(r["vec"]) for r in sample], kind)) @ project if sample else np.zeros((0, DIMENSIONS))
    cells = Cells.fit(points, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = units(matrix(batch.column("vec").to_pylist(), kind)) @ project
                extra = [pa.array(cells.of(p), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.record_batch([*batch.columns, *extra], names=[*batch.schema.names, "cell", "point"])

    index = scratch.write(classes.mapInArrow(place, "vec binary, ids array<long>, cell int, point array<double>"), "index")
    edges = [f(F.col("point")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    boxes = index.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").collect()  # MAX_CELLS rows at most
    parts = {r["cell"]: -(-r["n"] // PART) for r in boxes}
    box_cells = np.array([r["cell"] for r in boxes], np.int64)
    low = np.array([[r[f"low{i}"] for i in range(DIMENSIONS)] for r in boxes]).reshape(-1, DIMENSIONS)
    high = np.array([[r[f"high{i}"] for i in range(DIMENSIONS)] for r in boxes]).reshape(-1, DIMENSIONS)

    # equal queries are searched once
    asked = scratch.write(asked, "queries")
    distinct = asked.groupBy("vec").agg(F.count("*").alias("n")).select("vec", F.monotonically_increasing_id().alias("query"), "n")
    placed = scratch.write(distinct.mapInArrow(place, "vec binary, query long, n long, cell int, point array<double>"), "placed")

    searched = "query long, score double, id long"

    def search(keys: tuple, own: pd.DataFrame, posed: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(own) and len(posed):
            cell = CellIndex(matrix(list(own["vec"]), kind), [list(x) for x in own["ids"]], project)
            for q in posed.itertuples():
                p = np.asarray(q.point)
                found = cell.search(matrix([q.vec], kind)[0], p, k, bound, q.radius2)
                rows += [(q.query, s, i) for s, i in found]
        return pd.DataFrame(rows, columns=["query", "score", "id"]).astype({"query": "int64", "score": "float64", "id": "int64"})

    def by_cell(numbers: dict[int, int]) -> Column:
        """A number for each of the at most MAX_CELLS cells."""
        return F.create_map(*[F.lit(x) for c, n in numbers.items() for x in (c, n)])[F.col("cell")] if numbers else F.lit(None).cast("int")

    def run(posed: DataFrame) -> DataFrame:
        """The hits of queries posed to cells.  A group has at most about PART vectors of a
        cell and POSED of its queries: both sides are dealt, and meet once in every pairing."""
        turns = {r["cell"]: -(-r["count"] // POSED) for r in posed.groupBy("cell").count().collect()}
        turns = {c: n for c, n in turns.items() if c in parts}
        last = (by_cell(turns) - 1).cast("int")
        own = index.where(last.isNotNull()).withColumn("part", F.pmod(F.xxhash64("vec"), by_cell(parts)).cast("int"))
        own = own.withColumn("turn", F.explode(F.sequence(F.lit(0), last)))
        posed = posed.where(last.isNotNull()).withColumn("turn", F.pmod(F.xxhash64("query"), by_cell(turns)).cast("int"))
        posed = posed.withColumn("part", F.explode(F.sequence(F.lit(0), (by_cell(parts) - 1).cast("int"))))
        keys = ["cell", "part", "turn"]
        return own.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInPandas(search, searched)

    four = F.lit(4.0)  # no two unit vectors are farther apart
    home = scratch.write(run(placed.select("query", "vec", "cell", "point", four.alias("radius2"))), "home")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    same_id = Window.partitionBy("query", "id").orderBy(F.desc("score"))

    def shortest_of(hits: DataFrame) -> DataFrame:
        """As ``shortest``, for each query: ``r`` is the place and ``copy`` counts the rows of an id."""
        hits = hits.repartition("query").withColumn("copy", F.row_number().over(same_id)).where(F.col("copy") <= k)
        hits = hits.withColumn("r", F.row_number().over(best))
        most = F.coalesce(F.max("copy").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return hits.withColumn("before", F.col("r") - 1 - most).where(F.col("before") < k)

    reach = shortest_of(home).groupBy("query").agg(F.min("score").alias("least"), (F.count("*") - F.max("copy")).alias("found"))
    radius = F.when(F.col("found") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).otherwise(four)
    posed = placed.join(reach.withColumnRenamed("query", "of"), F.col("query") == F.col("of"), "left")
    posed = posed.select("query", "vec", "cell", "point", F.coalesce(radius, four).alias("radius2"))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other cell whose box passes the test."""
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            p = np.array(batch.column("point").to_pylist()).reshape(-1, 1, DIMENSIONS)
            gap = np.maximum(0, np.maximum(low - p, p - high))
            go = (gap * gap).sum(axis=2) <= bound * batch.column("radius2").to_numpy()[:, None] + SLACK
            rows, to = np.nonzero(go & (box_cells != batch.column("cell").to_numpy()[:, None]))
            own = batch.select(["query", "vec", "point", "radius2"]).take(pa.array(rows))
            yield pa.record_batch([*own.columns, pa.array(box_cells[to], pa.int32())], names=["query", "vec", "point", "radius2", "cell"])

    others = posed.mapInArrow(onward, "query long, vec binary, point array<double>, radius2 double, cell int")
    away = run(scratch.write(others.select("query", "vec", "cell", "point", "radius2"), "posed"))
    found = shortest_of(home.union(away))
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    answers = placed.select("vec", "query", "n").join(lists, "query").select("vec", "n", "near")
    each = salted_left_join(asked, answers, ["vec"], "n", "id", max(1, asked.count()))
    others_only = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    each = each.select(F.col("id").alias("query_id"), F.posexplode(others_only).alias("place", "hit"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
