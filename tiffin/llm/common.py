"""Helpers shared by the operators: scratch tables in the shared folder,
joins on hot keys, components, and text buffers as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A class or key with more than 1/HOT_SHARE of all rows is salted; at most
#: HOT_SHARE keys can be that large, which bounds their broadcast list.
HOT_SHARE = 1000

#: Text bytes that an Arrow function turns into arrays at once.
SLICE_BYTES = 4 << 20


class Scratch:
    """Tables written under the cluster's shared folder.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset (tests on one machine) a temporary folder is used.  ``write`` cuts
    the lineage: readers see a finished table, so a lost executor costs a
    re-read of files, never a recomputation.  ``remove`` deletes the tables
    once their results are no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.conf.get("spark.master", "local")
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            root = tempfile.gettempdir()
        self.spark = spark
        self.root = f"{root.rstrip('/')}/tiffin-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(self.path(name))

    def remove(self) -> None:
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, under fixed names, null text as empty: other
    columns of the input, whatever their names, stay outside."""
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as '')."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds


def salted_left_join(big: DataFrame, small: DataFrame, on: list[str], size: str, salt_by: str, total: int) -> DataFrame:
    """``big`` left join ``small`` (unique in ``on``), where ``small[size]``
    is the number of big rows of the key.  Keys above ``total / HOT_SHARE``
    rows (at most HOT_SHARE of them, hence the broadcast) are dealt to as many
    salts as they have such shares; every other key has one salt."""
    share = max(1, total // HOT_SHARE)
    hot = small.where(F.col(size) > share).select(*on, F.ceil(F.col(size) / share).cast("int").alias("_fan"))
    fanned = big.join(F.broadcast(hot), on, "left")
    fan = F.coalesce(F.col("_fan"), F.lit(1))
    fanned = fanned.withColumn("_salt", F.pmod(F.xxhash64(salt_by), fan).cast("int")).drop("_fan")
    copies = F.when(F.col(size) > share, F.ceil(F.col(size) / share)).otherwise(1).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return fanned.join(spread, [*on, "_salt"], "left").drop("_salt")


def min_label_components(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``nodes(node, label)`` with
    ``edges(a, b)``; returns ``(node, label, root)``: the smallest label
    of the component and its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014) over
    the edges only, in a logarithmic number of rounds; each round is written
    to the shared folder.  The driver sees one count and checksum per round.
    Nodes without an edge keep their own label.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = scratch.write(pairs, "edges-0")
    seen, turn = _fingerprint(state), 0
    while seen[0]:
        turn += 1
        total = 2 * seen[0]
        # large star: every larger neighbour of a node points to the smallest around it
        around = state.union(state.select("v", "u")).toDF("u", "v")
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = least.select("u", F.least("u", "m").alias("m"), "n")
        large = salted_left_join(around, least, ["u"], "n", "v", total).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_left_join(large, low, ["u"], "n", "v", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = scratch.write(small, f"edges-{turn}")
        before, seen = seen, _fingerprint(state)
        if seen == before:
            break
    return nodes_with_roots(nodes, state)


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mixed).first())


def nodes_with_roots(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """The smallest label of each star, given to all its members, and its
    smallest node as ``root``."""
    rooted = nodes.join(stars.toDF("node", "root"), "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("label").alias("low"), F.count("*").alias("n"))
    joined = salted_left_join(rooted, lowest, ["root"], "n", "node", max(1, nodes.count()))
    return joined.select("node", F.col("low").alias("label"), "root")


def fresh(name: str, columns: list[str]) -> str:
    """A column name that the input does not have."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- text buffers ---------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _MULT) | np.uint64(1)


_BYTES = byte_table()
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any byte span."""
    up, _ = powers(max(1, len(data)))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the bytes stand."""
    _, down = powers(len(sums))
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _MULT)


def text_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and its n+1 offsets."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if len(array) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch cut into runs of whole rows of about ``limit`` text bytes
    (one row at least), with the text bytes and offsets of the run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_column(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            part = batch.slice(at, to - at)
            yield (part, *text_column(part.column(text)))
            at = to


def seg_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments given by n+1 offsets (empty ones are 0)."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ascii_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no ASCII white space, cut at document
    ends): starts, ends, and per document the n+1 offsets into them."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    ink = ~ascii_space(data)
    first = np.zeros(len(data) + 1, bool)
    inner = offsets[1:-1]
    first[inner] = True
    before = np.concatenate([[False], ink[:-1]])
    begin = ink & (~before | first[:-1])
    after = np.concatenate([ink[1:], [False]])
    end = ink & (~after | first[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with ``keep``, joined by one space within each document: bytes
    and n+1 offsets.  ``words`` are the documents' n+1 offsets into the words."""
    count = np.concatenate([[0], np.cumsum(keep)])[words]
    starts, ends = starts[keep], ends[keep]
    lengths, space = ends - starts, np.ones(len(starts), np.int64)
    space[count[1:][count[1:] > count[:-1]] - 1] = 0  # none after a document's last word
    after = np.concatenate([[0], np.cumsum(lengths + space)])
    inked = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(after[-1], 32, np.uint8)
    step = np.arange(inked[-1])
    out[step + np.repeat(after[:-1] - inked[:-1], lengths)] = data[step + np.repeat(starts - inked[:-1], lengths)]
    return out, after[count]


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The opposite of ``text_column``."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def spaced_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, and their n+1 offsets."""
    lengths = ends - starts
    inked = np.concatenate([[0], np.cumsum(lengths)])
    after = inked + np.arange(len(inked))
    out = np.full(after[-1], 32, np.uint8)
    step = np.arange(inked[-1])
    out[step + np.repeat(after[:-1] - inked[:-1], lengths)] = data[step + np.repeat(starts - inked[:-1], lengths)]
    return out, after


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal where the bytes are equal (compared, not hashed)."""
    if not len(starts):
        return np.empty(0, np.int64)
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    step = np.arange(offsets[-1])
    ink = data[step + np.repeat(starts - offsets[:-1], lengths)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(ink)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)
