"""Summarise the physical plan of every registered query.

    python tools/plan_summary.py [sf_dir] > PLANS.md

Plans are taken with size-estimated broadcasts switched off
(``spark.sql.autoBroadcastJoinThreshold=-1``), which is the shape they have
when every table is far above the threshold, as at 100 TB.  Three tables are
printed: with the checked lookups small (explicit, checked broadcasts
remain), with them large (shuffle plans), and for the order_id questions on
orders and deliveries co-bucketed by ``order_id``.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def physical(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def summarise(text: str) -> dict[str, str]:
    hash_ex = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", text)
    keys = [re.sub(r"#\d+L?", "", h) for h in hash_ex]
    joins = re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)"
                       r"[^\n]*?(Inner|LeftOuter|LeftAnti|LeftSemi|Cross|RightOuter|FullOuter)", text)
    wgl = re.findall(r"WindowGroupLimit [^\n]*?(Partial|Final)", text)
    return {
        "hash exchanges": "; ".join(keys) or "-",
        "range exchanges": str(len(re.findall(r"Exchange rangepartitioning", text))),
        "single-partition exchanges": str(len(re.findall(r"Exchange SinglePartition", text))),
        "broadcasts": str(len(re.findall(r"BroadcastExchange", text))),
        "joins": ", ".join(f"{a} {b}" for a, b in joins) or "-",
        "rank limits": ", ".join(wgl) or "-",
    }


# Parameters forcing the plans taken when the checked sides are large.
LARGE_LOOKUPS = {
    "q01_top_dishes": {"target_max_rows": 0},
    "q01_top_dishes_3y": {"target_max_rows": 0},
    "q01_top_dishes_7y": {"target_max_rows": 0},
    "q03_avg_order_value": {"lookup_rows": 0},
    "q04_high_spenders": {"lookup_rows": 0},
    "q06_top_restaurant_by_city": {"lookup_rows": 0},
    "q07_top_dish_by_city": {"lookup_rows": 0},
}


ORDER_JOIN_KEYS = ["q05_undelivered", "q09_cancellation_rate", "q10_delivery_minutes",
                   "q11_monthly_growth", "q13_rider_earnings"]


def table(spark, sf_dir: str, overrides: dict[str, dict], tables=None) -> None:
    from tiffin.plans.catalog import CATALOG, test_job
    from tiffin.sources import from_tpch

    print("| query | hash exchanges (keys) | range | single | broadcasts | joins | rank limits |")
    print("| --- | --- | ---: | ---: | ---: | --- | --- |")
    for key in CATALOG:
        if overrides and key not in overrides:
            continue
        job, params = test_job(key)
        df = job(tables or from_tpch(spark, sf_dir), **{**params, **overrides.get(key, {})})
        s = summarise(physical(df))
        print(f"| {key} | {s['hash exchanges']} | {s['range exchanges']} | "
              f"{s['single-partition exchanges']} | {s['broadcasts']} | {s['joins']} | {s['rank limits']} |")


def main() -> None:
    from tiffin.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, extra_conf={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    print("### Checked lookups small (customers named in Q1, customers, restaurants)\n")
    table(spark, sf_dir, {})
    print("\n### Checked lookups large (shuffle plans)\n")
    table(spark, sf_dir, LARGE_LOOKUPS)
    from tiffin.sources import from_tpch, read_catalog_tables, write_catalog_tables

    write_catalog_tables(from_tpch(spark, sf_dir), "plan_summary", buckets=8)
    print("\n### Orders and deliveries co-bucketed by order_id (`sources/catalog.py`)\n")
    table(spark, sf_dir, {k: {} for k in ORDER_JOIN_KEYS}, read_catalog_tables(spark, "plan_summary"))
    spark.stop()


if __name__ == "__main__":
    main()
