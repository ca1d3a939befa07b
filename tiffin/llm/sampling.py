"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Labels learned at most, the most frequent ones; a bound of the fit, like the
#: rows per label.
MAX_LABELS = 500


def labelled_sample(rows: DataFrame, label: str, per_label: int, max_labels: int = MAX_LABELS) -> tuple[DataFrame, dict]:
    """``rows(doc_id, label)`` thinned to ``per_label`` rows of each label, and
    the number of rows of each label.

    Rows are taken by the hash of their id, so the sample is the same in every
    run; at most ``per_label`` per label stay (labels with fewer rows stay whole).  The
    result goes to the driver's model fit: it has per_label rows for each
    of at most max_labels labels, however large the table is.
    """
    counted = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(max_labels)
    sizes = {r[label]: r["n"] for r in counted.collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    chosen = None
    for value, n in sizes.items():
        # thinned a little above the bound before the exact cut, so that only few rows are ordered
        some = rows.where(F.col(label) == F.lit(value)).withColumn("_draw", draw)
        some = some.where(F.col("_draw") < min(1.0, 2.0 * per_label / n + 50.0 / n))
        some = some.orderBy("_draw", "doc_id").limit(per_label).drop("_draw")
        chosen = some if chosen is None else chosen.union(some)
    return (rows.limit(0) if chosen is None else chosen), sizes


def sampled_texts(rows: DataFrame, label: str, per_label: int, max_labels: int) -> tuple[DataFrame, list]:
    """At most ``per_label`` different rows of ``rows(doc_id, text, label)``
    for each label, and all labels in order.

    What is drawn, by its hash, is a pair of id and text: a label whose rows are copies of a
    few is learned from these few, and each of them counts once however often it is repeated.
    One aggregation finds the labels with their (estimated) number of different rows; one pass thins
    the rows to a little above the bound before they are numbered.  More than ``max_labels``
    labels are an error: none is left out in silence.
    """
    named = rows.withColumn("_name", F.xxhash64("doc_id", "text"))
    sizes = named.groupBy(label).agg(F.approx_count_distinct("_name").alias("_n")).orderBy(label).limit(max_labels + 1)
    sizes = [(r[label], max(1, r["_n"])) for r in sizes.collect()]
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} values of {label}: raise the bound of the fit")
    if not sizes:
        return rows.limit(0), []
    cuts = [(value, min(1.0, (2.0 * per_label + 50.0) / n)) for value, n in sizes]
    kind = rows.schema[label].dataType.simpleString()
    # at most max_labels rows
    cuts = F.broadcast(rows.sparkSession.createDataFrame(cuts, f"`{label}` {kind}, _cut double"))
    draw = F.pmod(F.xxhash64("_name", F.lit("sample")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    some = named.withColumn("_draw", draw).join(cuts, label).where(F.col("_draw") < F.col("_cut"))
    some = some.select("_name", "_draw", label, "doc_id", "text").dropDuplicates([label, "_name"])
    place = F.row_number().over(Window.partitionBy(label).orderBy("_draw", "_name"))
    chosen = some.withColumn("_place", place).where(F.col("_place") <= per_label)
    return chosen.select("doc_id", "text", label), [value for value, _ in sizes]
