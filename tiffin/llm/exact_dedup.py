"""Exact deduplication through an extendible-hash index on shared files.

DataFrame functions only.  Four steps:

1. *Keys.*  Every row gets the 64-bit XXH64 key of its text; rows are counted per
   key.  A key that more than 1/HOT_SHARE of all rows have is hot.
2. *Directory.*  Keys are addressed by their leading bits.  The directory
   starts at the depth at which an average bucket fits; a bucket that gets more
   than ``bucket_entries`` entries doubles it: its entries are split by one
   more bit, and again, until they fit or ``MAX_SPLITS`` bits are used.
3. *Owners.*  Texts travel once, to the task that owns the bucket of their key; the texts
   of hot keys are combined in each task before.  The owner compares whole texts:
   the different ones that collide on one key form a chain (``link`` 0, 1, ...).
4. *Lookup.*  Rows go through the directory to their bucket, and there by key and
   SHA-256 to their chain element; elements with many rows are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffin.llm.common import HOT_SHARE, Scratch, id_text, salted_left_join

#: Doublings past the starting depth.  Keys are hashes, so a bucket that is
#: still overfull holds a handful more entries than the limit; it stays whole.
MAX_SPLITS = 6

#: The directory starts with at most 2^15 pages, so that its split slots, at most
#: 2^(15 + MAX_SPLITS) pairs of numbers, may be broadcast; beyond that buckets grow.
MOST_BITS = 15


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_entries: int = 2_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``; of equal texts the row with the largest id stays.

    Null text equals the empty text.  A null id is the smallest id.  Of rows
    repeated with the same id and text one is kept; each still gets its own
    result row.  An empty table gives an empty result.  Other columns of the
    input are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact")
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row_no"), F.xxhash64("text").alias("key"), "text"
    )
    signed = scratch.write(
        rows.select("doc_id", "row_no", "key", F.sha2("text", 256).alias("sha")), "rows"
    )
    total = signed.count()

    keys = scratch.write(signed.groupBy("key").agg(F.count("*").alias("n")), "keys")
    often = F.col("n") > max(1, total // HOT_SHARE)
    start = first_depth(total, bucket_entries)
    fits = max(bucket_entries, total >> MOST_BITS)
    slots = scratch.write(directory(keys, start, fits, F.when(often, 1).otherwise(F.col("n"))), "directory")

    # at most HOT_SHARE keys can be hot
    hot = F.broadcast(keys.where(often).select("key"))
    one = F.struct("doc_id", "row_no").alias("last")
    cold = rows.join(hot, "key", "left_anti").select("key", "text", F.lit(1).cast("long").alias("n"), one)
    combined = rows.join(hot, "key", "left_semi").groupBy("key", "text").agg(F.count("*").alias("n"), F.max(one).alias("last"))
    owned = addressed(cold.unionByName(combined), slots, start).repartition("bucket")
    texts = owned.groupBy("key", "bucket", "text").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    entries = texts.where("n > 1").select("bucket", "key", F.sha2("text", 256).alias("sha"), "n", "last")
    index = scratch.write(chained(entries), "index")

    sought = addressed(signed, slots, start)
    found = salted_left_join(sought, index.drop("link"), ["bucket", "key", "sha"], "n", "row_no", total)
    kept = F.col("last").isNull() | (F.col("last.row_no") == F.col("row_no"))
    return found.select(
        "doc_id",
        F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def first_depth(n_entries: int, bucket_entries: int) -> int:
    """The bits at which an average bucket fits, at most MOST_BITS."""
    return min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n_entries / bucket_entries)))))


def leading(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, start: int, bucket_entries: int, weight: Column | None = None) -> DataFrame:
    """``slot, depth``: the local depth of the bucket that owns each slot of
    the directory at its largest depth, ``start + MAX_SPLITS`` bits.  An entry counts
    as ``weight`` (1)."""
    deepest = start + MAX_SPLITS
    filled = F.sum(F.lit(1) if weight is None else weight).alias("filled")
    slots = entries.groupBy(leading(F.col("key"), deepest).alias("slot")).agg(filled)
    slots = slots.withColumn("root", F.shiftright("slot", MAX_SPLITS))
    depth = F.lit(deepest)
    for bits in range(deepest - 1, start - 1, -1):
        page = Window.partitionBy("root", F.shiftright("slot", deepest - bits))
        slots = slots.withColumn(f"at_{bits}", F.sum("filled").over(page))
        depth = F.when(F.col(f"at_{bits}") <= bucket_entries, F.lit(bits)).otherwise(depth)
    return slots.select("slot", depth.alias("depth"))


def addressed(keyed: DataFrame, slots: DataFrame, start: int) -> DataFrame:
    """Rows with a ``key``, and the ``bucket`` (depth and leading bits) that the
    directory gives it.  Pages that were never split need no entry."""
    deepest = start + MAX_SPLITS
    split = slots.where(F.col("depth") > start)
    found = keyed.withColumn("slot", leading(F.col("key"), deepest)).join(F.broadcast(split), "slot", "left")
    depth = F.coalesce("depth", F.lit(start))
    prefix = F.shiftright("slot", MAX_SPLITS)
    for bits in range(start + 1, deepest + 1):
        prefix = F.when(depth == bits, F.shiftright("slot", deepest - bits)).otherwise(prefix)
    return found.withColumn("bucket", F.concat_ws("/", depth, prefix)).drop("slot", "depth")


def chained(entries: DataFrame) -> DataFrame:
    """The index: entries of a bucket with their place in the chain of their key."""
    chain = Window.partitionBy("bucket", "key").orderBy("sha")
    return entries.withColumn("link", F.row_number().over(chain) - 1)
