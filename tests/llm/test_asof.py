"""Tolerant as-of join against a plain loop over all orders."""

import math
import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.llm import asof

HOUR = asof.HOUR


def best(event, orders, tolerance):
    k, t = event
    near = [o for o in orders if k is not None and t is not None and o[0] == k and o[1] is not None and 0 <= t - o[1] <= tolerance]
    if not near:
        return None
    at = max(o[1] for o in near)
    tied = [o for o in near if o[1] == at]
    won = min(tied, key=lambda o: (o[2] is None, o[2] or 0, o[3] is None, -(o[3] or 0)))
    return at, len(tied), won[3]


@pytest.mark.parametrize("tolerance", [0, 1, 7, 95, 96, 97, 1000, 10**7])
def test_against_all_orders(spark, tolerance):
    r = random.Random(tolerance)
    reach = max(20, tolerance * 3)
    key = lambda: r.choice((1, 1, 1, 1, 2, 3, None))
    time = lambda: None if r.random() < 0.05 else r.randrange(-reach, reach)
    orders = [(key(), time(), r.choice((None, 1, 2)), r.choice((None, *range(50)))) for _ in range(300)]
    orders += orders[:30]
    events = [(i % 290, key(), r.choice([time(), r.choice(orders)[1]]), "clash") for i in range(300)]
    e = spark.createDataFrame(events, "id long, k long, t long, kind string")
    o = spark.createDataFrame(orders, "k long, t long, priority int, sale long")
    got = asof.latest_within(e, o, tolerance, "k", "t", [F.col("priority"), F.bitwise_not("sale")], ["sale"]).collect()
    assert len(got) == len(events) and got[0].__fields__ == ["id", "k", "t", "kind", "hit"]
    want = [(x, best(x[1:3], orders, tolerance)) for x in events]
    order = lambda x: repr(x)
    assert sorted(((tuple(g)[:4], g.hit and tuple(g.hit)) for g in got), key=order) == sorted(want, key=order)


def test_empty_tables(spark):
    e = spark.createDataFrame([(1, 1, 5)], "id long, k long, t long")
    o = spark.createDataFrame([], "k long, t long, p int")
    assert [g.hit for g in asof.latest_within(e, o, 10, "k", "t", [F.col("p")], ["p"]).collect()] == [None]
    assert asof.latest_within(e.limit(0), o, 10, "k", "t", [F.col("p")], ["p"]).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_query(spark, tmp_path, zone):
    """Whole query on rows with copies, nulls and ties; the session's zone changes nothing."""
    r = random.Random(5)
    start = datetime(2024, 3, 9, 20)  # a night in which New York leaves out an hour
    when = lambda: None if r.random() < 0.04 else start + timedelta(microseconds=r.randrange(0, 400 * HOUR) // r.choice((1, HOUR)) * 1)
    clicks = [(i, when(), r.choice((1, 1, 1, 2, None))) for i in range(300)]
    clicks += clicks[:40] + [(None, start, 1)]
    sales = [(i, r.choice((1, 1, 2, None)), r.choice((None, 1.005, 2.675, -0.125, 0.0, float("nan"))), when(), r.choice((None, 1, 2, 3, 4, 5))) for i in range(200)]
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long").write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int").write.parquet(f"{tmp_path}/sales.parquet")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = sorted(map(tuple, asof.op12_asof_orders(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)

    def used(i, ts):
        us = None if ts is None else (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        return us if us is None or zlib.crc32(str(i).encode()) % 2 == 0 else us - us % HOUR

    orders = []
    for i, c, total, at, p in sales:
        cents = None if total is None or total != total else int(math.floor(100 * total + 0.5))
        orders.append((c, used(i, at), p, i, cents))
        if zlib.crc32(str(i).encode()) % 3:
            orders.append((c, used(i, at), None if p is None else 6 - p, -1 - i, cents))
    want = []
    for i, ts, c in sorted(set(x for x in clicks if x[0] is not None), key=lambda x: x[0]):
        us = used(i, ts)
        hit = best((c, us), orders, 240 * HOUR)
        if hit is None:
            want.append((i, c, us, None, None, None, 0))
        else:
            at, n, sale = hit
            cents = next(o[4] for o in orders if o[3] == sale)
            want.append((i, c, us, sale, us - at, cents, n))
    assert got == want
    assert any(w[6] > 1 for w in want) and any(w[3] is not None and w[3] < 0 for w in want)
