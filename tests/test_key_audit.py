"""Primary-key audits by bitmaps equal those by keys, and move less."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01, collect
from tiffin.operators import bitmaps_pay, key_audit
from tiffin.plans import checks
from tiffin.sources import from_tpch


def violations(df, bitmaps: bool) -> int:
    return key_audit(df, "k", "t", bitmaps=bitmaps).first()["violations"]


@pytest.mark.parametrize("seed", range(4))
def test_bitmaps_equal_the_keys(spark, seed):
    rng = random.Random(seed)
    pool = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**40, -(2**40), 2**63 - 1, -(2**63) + 1, 2**31]
    keys = [None] * rng.randint(0, 3) + [rng.choice(pool + list(range(100, 200))) for _ in range(rng.randint(0, 150))]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    known = [k for k in keys if k is not None]
    expected = sum(known.count(k) > 1 for k in set(known)) + keys.count(None)
    assert violations(df, True) == violations(df, False) == expected


def test_bitmaps_of_integers(spark):
    df = spark.range(5).select(F.col("id").cast("int").alias("k")).unionByName(spark.createDataFrame([(3,)], "k int"))
    assert violations(df, True) == 1


def test_many_ranges_with_repeats(spark):
    df = spark.range(200_000).select((F.col("id") * 31).alias("k"))
    again = df.where("k % 1000 = 0").unionByName(df)
    assert violations(df, True) == 0 and violations(again, True) == violations(again, False) == 200


def test_bitmaps_pay_for_serial_numbers_only(spark):
    serial = spark.range(1_000_000).toDF("k")
    spread = spark.range(100_000).select((F.col("id") * 1_000_003).alias("k"))
    text = serial.select(F.col("k").cast("string"))
    twice = serial.limit(200_000).union(serial.limit(200_000))
    found = bitmaps_pay([(serial, "k"), (spread, "k"), (text, "k"), (serial.limit(0), "k"), (twice, "k")])
    assert found == [True, False, False, False, False]


def test_no_key_moves_without_repeats(spark):
    """With unique keys the audit shuffles bitmaps alone; the second scan reads nothing."""
    df = spark.range(0, 1_000_000, 1, 4).toDF("k")
    report = key_audit(df, "k", "t", bitmaps=True)
    assert report.first()["violations"] == 0
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and re.search(r"partial_bitmap_construct_agg", plan)


def test_pk_audit_on_all_tables(spark):
    t = from_tpch(spark, SF01)
    by_keys = [key_audit(getattr(t, table), key, table).first() for table, key in checks.PRIMARY_KEYS]
    assert sorted(collect(checks.pk_audit(t))) == sorted(map(tuple, by_keys))
