from __future__ import annotations

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["city", "restaurant_name", "revenue", "rank1"]
    rows = df.collect()
    assert len(rows) == 10  # FIXTURES section 3: 10 rows at sf0.001
    assert all(r.rank1 == 1 for r in rows)


def test_expected_row_counts_sf0001(spark):
    # Row counts from FIXTURES section 3 (sf0.001 column).
    expected = {
        "scan_customers": 150, "scan_restaurants": 10, "scan_orders": 1500, "scan_riders": 25,
        "scan_deliveries": 6000, "null_rows_orders": 43, "drop_null_orders": 1485,
        "q01_top_dishes": 1, "q01_top_dishes_3y": 2, "q01_top_dishes_7y": 1,
        "q02_time_slots": 13, "q03_avg_order_value": 6, "q04_high_spenders": 9,
        "q05_undelivered": 9, "q06_top_restaurant_by_city": 10, "q07_top_dish_by_city": 17,
        "q08_lapsed_customers": 51, "q09_cancellation_rate": 10, "q10_delivery_minutes": 4032,
        "q11_monthly_growth": 649, "q12_segments": 1, "q12_segments_10x": 2,
        "q13_rider_earnings": 794, "pk_audit": 5, "fk_audit": 4, "length_audit": 8,
    }
    qs = E.queries()
    for key, n in expected.items():
        assert qs[key](spark, "/root/testdata/sf0.001").count() == n, key


def test_derived_tables_have_the_declared_schemas(spark):
    from tiffin.sources import SCHEMAS, from_tpch

    t = from_tpch(spark, "/root/testdata/sf0.001")
    for name, schema in SCHEMAS.items():
        got = getattr(t, name).schema
        assert [(f.name, f.dataType) for f in got.fields] == [(f.name, f.dataType) for f in schema.fields], name


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_RUNS="1",
               BENCH_QUERIES="scan_riders,q02_time_slots", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], env=env, cwd=root,
                         capture_output=True, text=True, timeout=600)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stdout
    report = json.loads(lines[0])
    assert report["unit"] == "sec" and set(report["queries"]) == {"scan_riders", "q02_time_slots"}
    assert report["sf"] == "0.001" and report["value"] > 0
