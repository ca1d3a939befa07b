from __future__ import annotations

import datetime as dt
import io
import os
import re
import tempfile
from contextlib import redirect_stdout

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import D, SF001, T, collect
from tiffin.plans import questions as Q
from tiffin.plans.catalog import TEST_AS_OF
from tiffin.sources import SCHEMAS, from_tpch, read_tables, register_views, write_tables


def test_write_then_read_round_trip(spark):
    t = from_tpch(spark, SF001)
    root = os.path.join(tempfile.mkdtemp(prefix="tiffin-tables-"), "marketplace")
    write_tables(t, root)
    back = read_tables(spark, root)
    for name, schema in SCHEMAS.items():
        df = getattr(back, name)
        assert df.schema.fieldNames() == schema.fieldNames()
        assert sorted(collect(df), key=str) == sorted(collect(getattr(t, name)), key=str), name
    # same answers from the written tables, and the date bound reaches the scan
    q6 = Q.q06_top_restaurant_by_city(back, as_of=TEST_AS_OF)
    assert sorted(collect(q6)) == sorted(collect(Q.q06_top_restaurant_by_city(t, as_of=TEST_AS_OF)))
    buf = io.StringIO()
    with redirect_stdout(buf):
        q6.explain()
    assert "GreaterThanOrEqual(order_date,2000-08-01)" in buf.getvalue()


def test_read_tables_widens_int_keys(spark):
    root = tempfile.mkdtemp(prefix="tiffin-int-keys-")
    spark.createDataFrame([(1, "A", None)], "customer_id int, customer_name string, reg_date date") \
        .write.parquet(os.path.join(root, "customers"))
    df = read_tables(spark, root).customers
    assert df.schema["customer_id"].dataType.simpleString() == "bigint"


def test_cli_runs_a_job_and_writes(spark, capsys):
    from tiffin.__main__ import main

    out = os.path.join(tempfile.mkdtemp(prefix="tiffin-cli-"), "q02")
    assert main(["run", "q02_time_slots", "--tpch", SF001, "--out", out], spark=spark) == 0
    assert sum(r.order_count for r in spark.read.parquet(out).collect()) == 1500
    assert main(["list"]) == 0
    assert "q13_rider_earnings share=0.08" in capsys.readouterr().out


def test_register_views_for_sql(spark):
    from tiffin.sources import register_views

    register_views(from_tpch(spark, SF001), prefix="t_")
    n = spark.sql("SELECT COUNT(*) AS n FROM t_orders o JOIN t_deliveries d USING (order_id)").first().n
    assert n == 6000


def test_cli_report_writes_every_question(spark):
    from tiffin.__main__ import main

    out = tempfile.mkdtemp(prefix="tiffin-cli-report-")
    args = ["report", "--tpch", SF001, "--out", out, "--param", "as_of=2001-08-01",
            "--param", "customer_name=Customer#000000005", "--param", "previous_year=2000",
            "--param", "current_year=2001"]
    assert main(args, spark=spark) == 0
    written = sorted(os.listdir(out))
    assert "q13_rider_earnings" in written and "q05_undelivered" in written and len(written) == 19
    assert spark.read.parquet(os.path.join(out, "q09_cancellation_rate")).count() == 10


def test_cli_explain(spark, capsys):
    from tiffin.__main__ import main

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert main(["explain", "q13_rider_earnings", "--tpch", SF001, "--at-scale"], spark=spark) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    out = capsys.readouterr().out
    assert "SortMergeJoin" in out and "hashpartitioning(order_id" in out


def test_write_tables_spreads_a_hot_date(spark, make_tables):
    from tests.conftest import T

    hot = dt.date(2024, 1, 1)
    orders = [(i, 1, 1, "x", hot if i % 3 else dt.date(2024, 1, 1 + i % 28), T(12), "F", 1.0)
              for i in range(3000)]
    root = os.path.join(tempfile.mkdtemp(prefix="tiffin-hot-date-"), "m")
    # (AQE would merge these tiny partitions into one; at scale it only
    # merges small ones, so switch coalescing off to see the range split.)
    conf = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        write_tables(make_tables(orders=orders), root)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = [f for f in os.listdir(os.path.join(root, "orders")) if f.endswith(".parquet")]
    sizes = sorted(spark.read.parquet(os.path.join(root, "orders", f)).count() for f in files)
    assert sum(sizes) == 3000 and len(sizes) >= 3 and sizes[-1] < 3000 * 2 // 3


def test_cli_reads_parameters_by_their_type():
    from tiffin.plans.catalog import parse_params

    got = parse_params({"customer_name": "12", "years": "3", "as_of": "2024-06-30", "keep_rank": "None", "min_total": "5",
                        "share": "0.08", "cols": "a,b"})
    assert got == {"customer_name": "12", "years": 3, "as_of": dt.date(2024, 6, 30), "keep_rank": None, "min_total": 5.0,
                   "share": "0.08", "cols": ["a", "b"]}
    with pytest.raises(ValueError):
        parse_params({"year": "3"})


def worksheet_rows(make_tables):
    """Tables on which the worksheet's literals select something."""
    customers = [(1, "Arjun Mehta", None), (2, "12", None)]
    restaurants = [(1, "R1", "C1", None), (2, "R2", "C1", None)]
    today = dt.date.today()
    dates = [dt.date(2023, 5, 1), dt.date(2024, 5, 1), today]
    orders = [(i, 1 if i % 9 else 2, 1 + i % 2, "dish", dates[i % 3] if i % 9 else dates[0], 3600, "F", 150.25) for i in range(1000)]
    deliveries = [(i, i, "Delivered", 7200, 1) for i in range(0, 1000, 2)]
    return make_tables(customers=customers, restaurants=restaurants, orders=orders, riders=[(1, "r", None)], deliveries=deliveries)


def test_cli_runs_with_the_worksheet_literals(spark, make_tables, capsys):
    """``run`` without parameters and ``report`` answer the same on real tables."""
    from tiffin.__main__ import main

    root = os.path.join(tempfile.mkdtemp(prefix="tiffin-literals-"), "m")
    write_tables(worksheet_rows(make_tables), root)
    out = tempfile.mkdtemp(prefix="tiffin-literals-out-")
    assert main(["report", "--tables", root, "--out", os.path.join(out, "report")], spark=spark) == 0
    for key in ("q01_top_dishes", "q03_avg_order_value", "q04_high_spenders", "q06_top_restaurant_by_city",
                "q08_lapsed_customers", "q09_cancellation_rate"):
        assert main(["run", key, "--tables", root, "--out", os.path.join(out, key)], spark=spark) == 0
        rows = sorted(map(tuple, spark.read.parquet(os.path.join(out, key)).collect()))
        assert rows and rows == sorted(map(tuple, spark.read.parquet(os.path.join(out, "report", key)).collect())), key
    assert main(["run", "q01_top_dishes", "--tables", root, "--param", "customer_name=12"], spark=spark) == 0
    capsys.readouterr()
    main(["list"])
    listed = capsys.readouterr().out
    assert "min_orders=750" in listed and "min_total=100000" in listed and "customer_name=Arjun Mehta" in listed


@pytest.mark.parametrize("kind", ["string", "timestamp", "int"])
def test_tables_with_time_columns(spark, kind):
    """Q2 and Q10 from times as text, timestamps or numbers are the same."""
    t = from_tpch(spark, SF001)
    root = tempfile.mkdtemp(prefix=f"tiffin-time-{kind}-")
    for name in ("orders", "deliveries"):
        df = getattr(t, name)
        column = "order_time" if name == "orders" else "delivery_time"
        seconds = F.col(column)
        if kind == "string":
            other = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
            other = F.when(seconds.isNotNull(), other)
        elif kind == "timestamp":
            other = F.timestamp_seconds(seconds)
        else:
            other = seconds.cast("int")
        df.withColumn(column, other).write.parquet(os.path.join(root, name))
    back = read_tables(spark, root)
    for job in (Q.q02_time_slots, Q.q10_delivery_minutes):
        assert sorted(collect(job(back)), key=str) == sorted(collect(job(t)), key=str)


def test_read_tables_finds_single_files(spark):
    root = tempfile.mkdtemp(prefix="tiffin-files-")
    spark.createDataFrame([(1, "r", None)], "rider_id long, rider_name string, sign_up date").write.parquet(os.path.join(root, "riders.parquet"))
    assert collect(read_tables(spark, root).riders) == [(1, "r", None)]


def test_intermediates_go_with_their_context(spark):
    from tiffin.sources import Intermediates

    with Intermediates(spark) as work:
        assert work.write(spark.range(3), "three").count() == 3
        root = work.root.removeprefix("file:")
        assert os.path.isdir(root)
    assert not os.path.exists(root)


class StubContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder

    def getConf(self):
        return {}


class StubConf(dict):
    def set(self, key, value):
        self[key] = value


class StubSession:
    def __init__(self, *args):
        self.sparkContext, self.conf = StubContext(*args), StubConf()


def test_checkpoint_folder():
    from tiffin.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(StubSession("yarn", "hdfs://ck/1")) == "hdfs://ck/1"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(StubSession(master))
    local = StubSession("local[2]")
    assert os.path.isdir(ensure_checkpoint_dir(local)) and local.sparkContext.folder


# --- partitions by month, names in any case, intervals ---------------------


@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("by_month"))
    write_tables(from_tpch(spark, SF001), root, partition_orders_by_month=True)
    return root


@pytest.mark.parametrize("key", ["q01_top_dishes", "q06_top_restaurant_by_city", "q08_lapsed_customers", "q09_cancellation_rate"])
def test_dates_prune_monthly_partitions(spark, by_month, key):
    from tiffin.plans.catalog import test_job

    job, params = test_job(key)
    df = job(read_tables(spark, by_month), **params)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "order_month" in f]
    assert filters and all(">=" in f and ("<" in f or key[:3] in ("q01", "q06")) for f in filters), plan
    assert sorted(collect(df), key=str) == sorted(collect(job(from_tpch(spark, SF001), **params)), key=str)


def test_monthly_partitions_are_not_seen_by_the_jobs(spark, by_month):
    t = read_tables(spark, by_month)
    assert t.orders.columns == SCHEMAS["orders"].fieldNames()
    assert sorted(collect(t.orders), key=str) == sorted(collect(from_tpch(spark, SF001).orders), key=str)
    folders = [n for n in os.listdir(os.path.join(by_month, "orders")) if n.startswith("order_month=")]
    assert len(folders) > 12


def test_orders_without_a_date_keep_their_own_partition(spark, make_tables, tmp_path):
    orders = [(1, 1, 1, "x", None, None, "F", 1.0), (2, 1, 1, "x", D(2024, 2, 29), None, "F", 1.0)]
    write_tables(make_tables(orders=orders), str(tmp_path / "m"), partition_orders_by_month=True)
    t = read_tables(spark, str(tmp_path / "m"))
    assert t.orders.count() == 2
    low, high = F.lit(D(2024, 2, 29)), F.lit(D(2024, 3, 1))
    assert [r.order_id for r in t.orders_in((low, high)).collect()] == [2] == [r.order_id for r in t.orders_in((low, None)).collect()]
    assert t.orders_in((None, low)).count() == 0 and t.orders_in((None, low), (low, None)).count() == 1


def test_table_names_in_any_case(spark, make_tables, tmp_path):
    t = make_tables(orders=[(1, 1, 1, "x", None, None, "F", 1.0)], riders=[(1, "r", None)])
    t.orders.write.parquet(str(tmp_path / "Orders"))
    t.riders.write.parquet(str(tmp_path / "RIDERS.parquet"))
    t.customers.write.parquet(str(tmp_path / "customers"))
    t.customers.write.parquet(str(tmp_path / "Customers"))
    found = read_tables(spark, str(tmp_path))
    assert found.orders.count() == 1 and found.riders.count() == 1 and found.customers.count() == 0
    t.restaurants.write.parquet(str(tmp_path / "Restaurants"))
    t.restaurants.write.parquet(str(tmp_path / "RESTAURANTS"))
    with pytest.raises(ValueError, match="several tables named restaurants"):
        found.restaurants  # noqa: B018
    with pytest.raises(AnalysisException):
        found.deliveries  # noqa: B018
    register_views(t)
    assert spark.sql("SELECT * FROM Orders").count() == spark.sql("select * from ORDERS").count() == 1


def test_time_difference_as_interval(spark, make_tables):
    from tiffin.plans import questions as Q
    from tiffin.plans.catalog import parse_params

    orders = [(1, 1, 1, "x", None, T(23, 50), "F", 1.0), (2, 1, 1, "x", None, T(12), "F", 1.0), (3, 1, 1, "x", None, None, "F", 1.0)]
    deliveries = [(1, 1, "Delivered", T(0, 10), 1), (2, 2, "Delivered", 86400, 1), (3, 3, "Delivered", 5, 1), (4, 2, "Delivered", T(12), 1)]
    t = make_tables(orders=orders, deliveries=deliveries)
    df = Q.q10_delivery_minutes(t, **parse_params({"as_interval": "true"}))
    assert df.schema["time_difference"].dataType.simpleString() == "interval day to second"
    found = {(r.order_id, r.delivery_time): (r.time_difference, r.time_difference_minutes) for r in df.collect()}
    assert found == {
        (1, T(0, 10)): (dt.timedelta(seconds=T(0, 10) - T(23, 50)), 20.0),
        (2, 86400): (dt.timedelta(hours=12), 720.0),
        (2, T(12)): (dt.timedelta(0), 0.0),
        (3, 5): (None, None),
    }


def test_report_keeps_the_order_of_its_results(spark, make_tables, tmp_path):
    """ORDER BY survives the write: read in file order, rows are sorted."""
    from tiffin.plans.report import write_report

    rows = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("n"))
    write_report({"ordered": rows.orderBy(F.desc("n"))}, str(tmp_path))
    parts = sorted(n for n in os.listdir(tmp_path / "ordered") if n.endswith(".parquet"))
    read = [r.n for part in parts for r in spark.read.parquet(str(tmp_path / "ordered" / part)).collect()]
    assert read == sorted(read, reverse=True)
