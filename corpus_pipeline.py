"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of ``documents``.  Further columns of ``docs`` are
kept, whatever their names.  A row is known by its doc_id and the SHA-256 of
its text: doc_ids may be null or repeated, and a row repeated with the same id
and text counts once after the exact stage.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.llm.common import Scratch, fresh, table
from tiffin.llm.exact_dedup import exact_dedup
from tiffin.llm.packing import cut_pieces, pack_pieces
from tiffin.llm.pii import redact_pii
from tiffin.llm.quality import keep_good, learn
from tiffin.llm.queries import vocabulary_path
from tiffin.llm.simhash import simhash_components


def row_key(doc_id: Column, sha: Column) -> Column:
    """A row's name: its text's SHA-256 and its id, a null id unlike any other."""
    return F.concat_ws(":", sha, doc_id.cast("string"))


def kept_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``doc_id, text_sha256`` of ``kept``.  The
    join and the removal of repeated rows share one exchange of ``docs``."""
    key = fresh("_key", docs.columns)
    marked = docs.withColumn(key, row_key(docs["doc_id"], F.sha2(F.coalesce("text", F.lit("")), 256)))
    names = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(key))
    return marked.join(names, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  It learns from the
    labels of ``docs`` outside the held-out fold."""
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return kept_rows(docs, exact_dedup(docs).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (three-word shingles, at most 3 bits)
    the document with the smallest doc_id stays."""
    found = simhash_components(docs, shingle=3, max_bits=3, mark=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")).alias("least")
    return kept_rows(docs, found.groupBy("component").agg(least).select("least.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return redact_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in sequences of at most 1024 tokens."""
    return pack_pieces(cut_pieces(docs, vocabulary_path(), end_id=2, capacity=1024), capacity=1024)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot express the learned and the packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
