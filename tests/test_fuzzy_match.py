"""Registered title matching against brute force over all orders."""

import datetime
import difflib

from colloquy.plans.queries import QUERIES


def test_all_orders_are_matched(spark, tmp_path):
    orders = [(i, 100 + i * 37 % 11, datetime.datetime(1994 + i % 4, 3, 1 + i % 2)) for i in range(1, 61)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.order_id: r.source_id for r in QUERIES["fuzzy_date_match"](spark, str(tmp_path)).collect()}
    alike = lambda a, b: difflib.SequenceMatcher(None, f"callwith{a}", f"callw{b}").ratio()
    want = {}
    for key, who, day in orders:
        score, pos = max((alike(who, w), -k) for k, w, d in orders if d == day)
        want[key] = str(-pos) if score >= 0.55 else ""
    assert got == want
