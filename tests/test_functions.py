from __future__ import annotations

import datetime as dt
import decimal
import itertools
import pathlib
import random
import struct

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import tiffin
from tests.conftest import D, T
from tiffin.functions import (
    money_sums, money_value, rounded_ratio, seconds_of_day, slot_label, sums_again, wrapped_seconds, years_before,
)
from tiffin.functions.bits import order_bits
from tiffin.operators import keep_top_ranks, not_in, order_key, ranking


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0].v


@pytest.mark.parametrize("seconds,label", [
    (0, "00:00 - 02:00"), (T(1, 59, 59), "00:00 - 02:00"), (T(2), "02:00 - 04:00"),
    (T(13, 30), "12:00 - 14:00"), (T(22), "22:00 - 00:00"), (T(23, 59, 59), "22:00 - 00:00"),
    (86400, None), (-1, None),
])
def test_slot_label(spark, seconds, label):
    assert one(spark, slot_label(F.lit(seconds))) == label


def test_slot_label_other_width(spark):
    assert one(spark, slot_label(F.lit(T(7)), hours=6)) == "06:00 - 12:00"
    assert one(spark, slot_label(F.lit(T(19)), hours=6)) == "18:00 - 00:00"
    with pytest.raises(ValueError):
        slot_label(F.lit(0), hours=5)


@pytest.mark.parametrize("num,den,mult,expected", [
    (1, 3, 100, 33.33), (2, 3, 100, 66.67), (1, 32, 100, 3.13), (-1, 32, 100, -3.13),
    (1, 8, 100, 12.5), (0, 5, 100, 0.0), (1067, 60, 1, 17.78), (5, 0, 100, None),
    (201, 20000, 100, 1.01), (-201, 20000, 100, -1.01),
])
def test_rounded_ratio(spark, num, den, mult, expected):
    assert one(spark, rounded_ratio(F.lit(num), F.lit(den), multiplier=mult)) == expected


def test_rounded_ratio_large_exact(spark):
    # 10**15 + 5 over 10**3 * 100 at 2 decimals: exact even beyond 2**53
    n = 10 ** 13 + 5
    assert one(spark, rounded_ratio(F.lit(n), F.lit(1000), multiplier=1)) == pytest.approx(10 ** 10 + 0.01)


def test_wrapped_seconds(spark):
    assert one(spark, wrapped_seconds(F.lit(T(0, 10)), F.lit(T(23, 50)))) == 1200
    assert one(spark, wrapped_seconds(F.lit(T(12)), F.lit(T(12)))) == 0


def test_years_before_leap_day(spark):
    assert one(spark, years_before(D(2024, 2, 29), 1)) == D(2023, 2, 28)
    assert one(spark, years_before("2001-08-01", 7)) == D(1994, 8, 1)


SETS = {
    "empty": [],
    "matching": [1, 2],
    "disjoint": [7],
    "with_null": [1, None],
    "all_null": [None],
}
LEFTS = {"no_null": [1, 2, 3], "with_null": [1, None, 3]}


@pytest.mark.parametrize("left_name,right_name", list(itertools.product(LEFTS, SETS)))
def test_not_in_matches_sql_semantics(spark, left_name, right_name):
    left = spark.createDataFrame([(v,) for v in LEFTS[left_name]], "x long")
    right = spark.createDataFrame([(v,) for v in SETS[right_name]], "k long")
    ours = sorted((r.x for r in not_in(left, "x", right, "k").collect()), key=str)
    left.createOrReplaceTempView("l_in")
    right.createOrReplaceTempView("r_in")
    sql = spark.sql("SELECT x FROM l_in WHERE x NOT IN (SELECT k FROM r_in)")
    assert ours == sorted((r.x for r in sql.collect()), key=str)


def test_cluster_conf_sizes_partitions():
    from tiffin.session import cluster_conf

    conf = cluster_conf(largest_shuffle_bytes=4 * 1024**4, total_cores=8000)
    parts = int(conf["spark.sql.shuffle.partitions"])
    assert parts % 8000 == 0 and parts >= 4 * 1024**4 // (256 * 1024**2)
    assert conf["spark.sql.adaptive.enabled"] == "true"


RANKERS = {"dense": F.dense_rank, "rank": F.rank}


def ranked_rows(n: int, seed: int) -> list[tuple]:
    """Groups and values with NULLs, NaN and ties: a third of the rows tie."""
    rng = random.Random(seed)
    values = [None, 1.0, 2.0, -2.5, 3.0, 5.0, 8.0, float("nan"), float("inf")]
    return [(rng.choice(["a", "a", "a", "b", None]), 2.0 if i % 3 == 0 else rng.choice(values), i) for i in range(n)]


def by_window(df, groups, method, descending):
    window = Window.partitionBy(*groups).orderBy(order_key("v", descending))
    return df.withColumn("r", RANKERS[method]().over(window).cast("bigint"))


@pytest.mark.parametrize("method", ["dense", "rank"])
@pytest.mark.parametrize("k", [1, 2, 4, None])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_equal_the_window(spark, method, k, descending):
    df = spark.createDataFrame(ranked_rows(300, k or 0), "g string, v double, id long")
    got = keep_top_ranks(df, ["g"], "v", k, method, "r", descending)
    want = by_window(df, ["g"], method, descending)
    if k:
        want = want.filter(F.col("r") <= k)
    assert sorted(tuple(r) for r in got.select("id", "r").collect()) == sorted(tuple(r) for r in want.select("id", "r").collect())


@pytest.mark.parametrize("method", ["dense", "rank"])
@pytest.mark.parametrize("digit", [1, 3, 21])
@pytest.mark.parametrize("descending", [True, False])
def test_radix_ranks_equal_the_window(spark, monkeypatch, method, digit, descending):
    """With few bits a digit every level of the histogram has work to do."""
    monkeypatch.setattr(ranking, "DIGIT_BITS", digit)
    close = [(rng_group, 1.0 + i * 2.0**-52, i) for i in range(90) for rng_group in ("a", None)]
    df = spark.createDataFrame(ranked_rows(200, digit) + close, "g string, v double, id long")
    values = df.groupBy("g", "v").agg(F.count("*").alias("__rank_rows"))
    got = ranking.ranked_by_radix(values, ["g"], "v", method, "r", descending).select("g", "v", "r")
    want = by_window(df, ["g"], method, descending).select("g", "v", "r").distinct()
    key = lambda r: (str(r["g"]), repr(r["v"]), r["r"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_full_ranking_plans_no_job_and_scans_no_bounds(spark):
    """Building the plan runs nothing, and the plan holds no list of bounds."""
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.sqrt("id").alias("v"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    ranked = keep_top_ranks(df, ["g"], "v", None, "dense", "r")
    assert len(tracker.getJobIdsForGroup(None)) == before
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "percentile" not in plan


def money_sum(spark, amounts, parts=1):
    df = spark.createDataFrame([(a,) for a in amounts], "a double").repartition(parts)
    once = df.groupBy(F.spark_partition_id().alias("p")).agg(*[c.alias(n) for n, c in money_sums(F.col("a"), "m").items()])
    again = once.agg(*[c.alias(n) for n, c in sums_again("m").items()])
    return again.select(money_value("m").alias("v")).first()["v"]


def test_sums_keep_digits_past_the_sixth(spark):
    assert money_sum(spark, [4e-7] * 1000, 3) == 4e-4
    assert money_sum(spark, [5e-7, -4e-7]) == 1e-7 and money_sum(spark, [1e-20] * 7) == 7e-20
    assert money_sum(spark, [0.1] * 10) == 1.0 and money_sum(spark, [12345.67, 1e-9]) == 12345.670000001
    assert money_sum(spark, [None, None]) is None and money_sum(spark, []) is None
    long = decimal.Decimal("1e12") + decimal.Decimal(repr(123456789.123456789))
    assert money_sum(spark, [1e12, 123456789.123456789]) == float(long)


def test_sums_equal_the_sum_of_the_printed_decimals(spark):
    rng = random.Random(4)
    for spread in (range(-8, 0), range(-4, 11), range(4, 17), range(17, 25)):
        amounts = [rng.choice([1, -1]) * round(rng.random(), rng.choice([2, 9, 17])) * 10.0 ** rng.choice(spread) for _ in range(300)]
        exact = sum(decimal.Decimal(repr(a)) for a in amounts)
        got = money_sum(spark, amounts, 4)
        assert got == pytest.approx(float(exact), rel=1e-15, abs=1e-21), spread


def test_large_sums_do_not_depend_on_the_order(spark):
    amounts = [1e18, -1e18, 3e18 + 1024, 7.25, 1e25, -1e25, 2.0**57, 0.1, 4e-7] * 40
    found = set()
    for seed in range(4):
        random.Random(seed).shuffle(amounts)
        found.add(money_sum(spark, amounts, seed + 1))
    assert found == {float(sum(decimal.Decimal(repr(a)) for a in amounts))}
    for odd in (float("nan"), float("inf"), 1e300):
        got = money_sum(spark, [odd, 1e18, 0.1])
        assert got == odd or got != got and odd != odd


DOUBLES = [
    0.0, -0.0, 5e-324, 1e-323, 2.0**-1022, 2.0**-1022 - 5e-324, 1e-300, 2.0**-52, 0.1, 1 - 2.0**-53, 1.0, 1 + 2.0**-52,
    2 - 2.0**-52, 2.0, 3.0, 1e15, 2.0**53, 2.0**53 + 2, 1e22, 2.0**1023, 1.7976931348623157e308, float("inf"),
]


def test_order_bits_are_the_bits(spark):
    rng = random.Random(8)
    values = DOUBLES + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63) % (2047 << 52)))[0] for _ in range(3000)]
    values += [m * 2.0**e for e in range(-1060, 1020, 7) for m in (1.0, 2 - 2.0**-52)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values + [float("nan"), None]], "v double")
    for r in df.select("v", order_bits(F.col("v")).alias("b")).collect():
        if r["v"] is None or r["v"] != r["v"]:
            assert r["b"] == (None if r["v"] is None else (2047 << 52) + 1)
        else:
            bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
            assert r["b"] == (-bits if r["v"] < 0 else bits), r["v"]


def test_a_large_k_is_as_lazy_as_a_small_one(spark, tmp_path):
    df = spark.createDataFrame([(v,) for v in [5, 3, 3, None, 1, 5]], "v long")
    got = [(r.v, r.r) for r in keep_top_ranks(df, [], "v", 1001, "dense", "r").collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (5, 2), (5, 2), (3, 3), (3, 3), (1, 4)], key=str)
    with pytest.raises(ValueError):
        keep_top_ranks(df, [], "v", 1, "row_number")


def test_no_checkpoint_in_the_query_path():
    root = pathlib.Path(tiffin.__file__).parent
    for path in (*root.glob("operators/*.py"), *root.glob("plans/*.py"), *root.glob("functions/*.py")):
        assert "checkpoint(" not in path.read_text(), path


def one_time(spark, value, kind):
    row = spark.createDataFrame([(value,)], f"t {kind}")
    return row.select(seconds_of_day(F.col("t"), row.schema["t"].dataType, "t").alias("s")).first()["s"]


@pytest.mark.parametrize(("value", "kind", "seconds"), [
    ("12:30:00", "string", T(12, 30)), (" 7:05 ", "string", T(7, 5)), ("24:00:00", "string", 86400),
    ("23:59:59.000", "string", T(23, 59, 59)), (None, "string", None), (45000, "int", 45000), (45000, "bigint", 45000),
    (45000.0, "double", 45000), (None, "double", None), (dt.datetime(2024, 5, 6, 12, 30, 1), "timestamp", T(12, 30, 1)),
    (dt.datetime(2024, 5, 6, 0, 0, 1), "timestamp_ntz", 1), (None, "timestamp", None),
])
def test_times_of_day(spark, value, kind, seconds):
    assert one_time(spark, value, kind) == seconds


@pytest.mark.parametrize(("value", "kind"), [
    ("12:30:00.5", "string"), ("25:00", "string"), ("24:00:01", "string"), ("12:60", "string"), ("noon", "string"),
    ("", "string"), (1.5, "double"), (dt.datetime(2024, 5, 6, 12, 30, 1, 500000), "timestamp"),
])
def test_a_time_that_would_lose_something_is_an_error(spark, value, kind):
    with pytest.raises(Exception, match="not a time of day"):
        one_time(spark, value, kind)


def test_spark_time_type(spark):
    old = spark.conf.get("spark.sql.timeType.enabled")
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        row = spark.sql("SELECT TIME'12:30:00' AS t, TIME'12:30:00.25' AS f")
        found = row.select(seconds_of_day(F.col("t"), row.schema["t"].dataType)).first()[0]
        assert found == T(12, 30)
        with pytest.raises(Exception, match="not a time of day"):
            row.select(seconds_of_day(F.col("f"), row.schema["f"].dataType)).collect()
    finally:
        spark.conf.set("spark.sql.timeType.enabled", old)


def test_slot_label_equals_the_twelve_branch_case_for_every_second(spark):
    # The original buckets EXTRACT(HOUR) with twelve BETWEEN branches and no
    # ELSE; compare with the integer-division form for 00:00:00 .. 24:00:00.
    branches = " ".join(
        f"WHEN floor(s / 3600) BETWEEN {h} AND {h + 1} THEN '{h:02d}:00 - {(h + 2) % 24:02d}:00'"
        for h in range(0, 24, 2)
    )
    df = spark.range(0, 86401).withColumnRenamed("id", "s")
    df = df.select(slot_label(F.col("s")).alias("ours"), F.expr(f"CASE {branches} END").alias("case"))
    assert df.filter(~F.col("ours").eqNullSafe(F.col("case"))).count() == 0


def test_rounded_ratio_matches_decimal_half_away_from_zero(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(7)
    cases = [(rng.randrange(-10**9, 10**9), rng.randrange(1, 10**7)) for _ in range(2000)]
    cases += [(n, d) for d in (8, 16, 32, 40, 80, 160, 200, 20000) for n in range(-50, 51)]
    df = spark.createDataFrame(cases, "n long, d long")
    got = {(r.n, r.d): r.v for r in
           df.select("n", "d", rounded_ratio(F.col("n"), F.col("d"), multiplier=100).alias("v")).collect()}
    for n, d in cases:
        want = float((Decimal(n) * 100 / Decimal(d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
        assert got[(n, d)] == want, (n, d)


@pytest.mark.parametrize("left_name,right_name", list(itertools.product(LEFTS, SETS)))
def test_q08_matches_sql_not_in(spark, make_tables, left_name, right_name):
    from tiffin.plans import questions as Q

    orders = [(i, c, 1, "x", D(2023, 3, 1), T(12), "F", 1.0) for i, c in enumerate(LEFTS[left_name])]
    orders += [(100 + i, c, 1, "x", D(2024, 3, 1), T(12), "F", 1.0) for i, c in enumerate(SETS[right_name])]
    t = make_tables(orders=orders)
    ours = sorted((r.customer_id for r in Q.q08_lapsed_customers(t, 2023, 2024).collect()), key=str)
    t.orders.createOrReplaceTempView("q8_orders")
    sql = spark.sql("""SELECT DISTINCT customer_id FROM q8_orders WHERE year(order_date) = 2023
                       AND customer_id NOT IN (SELECT customer_id FROM q8_orders WHERE year(order_date) = 2024)""")
    assert ours == sorted((r.customer_id for r in sql.collect()), key=str)
