"""Tolerant as-of join: the latest order at or before each event, if it isn't too old.

Orders are collapsed to one row for each key and time, the winner with the
count of all that are tied there, and events to their distinct times. Both
are put into one table, and in a window over a key's rows sorted by time,
orders first, the last non-null order is what an event finds. What lies further
back than the tolerance isn't a match.

A key may hold a third of all rows, so its time is cut into slots of a
PARTS-th of the tolerance, and the window runs inside one slot. The last order
before a slot comes from a second window, which has one row a slot at most,
inside spans as long as the tolerance; the last order of the span before is
one more row there. Nothing older can match. So no window holds more than a slot's
distinct times or a span's PARTS slots, whatever a key holds in all, and
many orders or events at one time are summed up before they are shuffled. Events
take what was found for their time by an equi join, which adaptive execution can split
where very many events share one time; events that can't match are dealt out evenly.

Defined cases: an event without key or time matches nothing, an order without
either is matched by nothing; repeated events are each a row, repeated orders
count as ties; all preferences equal, the least carried values win; empty tables
give unmatched rows or none; columns of the events are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spare, table

#: Slots of one tolerance.
PARTS = 96
HOUR = 3_600_000_000


def latest_within(events: DataFrame, orders: DataFrame, tolerance: int, by: str, at: str, prefer: Sequence[Column], carry: Sequence[str], into: str = "hit") -> DataFrame:
    """events with ``into``: a struct of at, n_tied and the columns to carry of the order matched, or null.

    Both tables have the columns by and at (a long). Of orders at one time the
    one with the least values of ``prefer`` wins, where null loses.
    """
    width = max(1, -(-tolerance // PARTS))
    parts = max(1, -(-tolerance // width))
    key, time = F.col(f"`{by}`").alias("k"), F.col(f"`{at}`").cast("long").alias("t")

    there = F.col("k").isNotNull() & F.col("t").isNotNull()
    wins = F.struct(*[F.struct(p.isNull(), p).alias(f"p{i}") for i, p in enumerate(prefer)], F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry"))
    won = orders.select(key, time, wins.alias("w")).where(there).groupBy("k", "t").agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n"))
    found = won.select("k", "t", F.lit(0).alias("kind"), F.struct(F.col("t").alias("at"), F.col("n").alias("n_tied"), "w.carry.*").alias("o"))
    moments = events.select(key, time).where(there).distinct().select("k", "t", F.lit(1).alias("kind"), F.lit(None).cast(found.schema["o"].dataType).alias("o"))

    def part(x: str, size: int) -> Column:
        """x over size, rounded down, exact."""
        return F.expr(f"{x} div {size} - if({x} < 0 and {x} % {size} <> 0, 1, 0)")

    rows = found.unionByName(moments).withColumn("slot", part("t", width))
    sorted_slot = Window.partitionBy("k", "slot").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("o", F.last("o", ignorenulls=True).over(sorted_slot)).where("kind = 1")

    # one row a slot and, to start a span with, the last order of the span before
    slots = rows.groupBy("k", "slot").agg(F.max("o").alias("o")).withColumn("span", part("slot", parts))  # structs start with their time
    spans = found.withColumn("slot", part("t", width)).groupBy("k", part("slot", parts).alias("span")).agg(F.max("o").alias("o"))
    spans = spans.select("k", F.lit(None).cast("long").alias("slot"), "o", (F.col("span") + 1).alias("span"))
    sorted_span = Window.partitionBy("k", "span").orderBy(F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.unionByName(spans).withColumn("before", F.last("o", ignorenulls=True).over(sorted_span)).where("slot IS NOT NULL AND before IS NOT NULL")
    carried = carried.select(F.col("k").alias("ck"), F.col("slot").alias("cs"), "before")

    hit = F.coalesce("o", "before")
    hits = inside.join(carried, (F.col("k") == F.col("ck")) & (F.col("slot") == F.col("cs")), "left").select("k", "t", hit.alias("o"))
    hits = hits.where(F.col("o").isNotNull() & (F.col("t") - F.col("o.at") <= tolerance))

    # null keys meet nothing: dealt by a hash of their rows, so that they don't meet in one task either
    k, t, z, o, apart = (spare(events, x) for x in "ktzo-")
    hits = hits.select(F.col("k").alias(k), F.col("t").alias(t), F.lit(0).cast("long").alias(z), F.col("o").alias(o))
    hashable = [F.col(f"`{f.name}`") for f in events.schema.fields if f.dataType.typeName() in ("long", "integer", "string", "timestamp", "timestamp_ntz")]
    lost = F.col(f"`{by}`").isNull() | F.col(f"`{at}`").isNull()
    dealt = events.withColumn(apart, F.when(lost, F.xxhash64(*hashable) if hashable else F.lit(1)).otherwise(F.lit(0)))
    met = dealt.join(hits, (F.col(f"`{by}`") == F.col(k)) & (F.col(f"`{at}`") == F.col(t)) & (F.col(f"`{apart}`") == F.col(z)), "left")
    return met.select(*[F.col(f"`{c}`") for c in events.columns], F.col(o).alias(into))


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_micros(c)
    c = c.cast("timestamp_ntz")
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def crc(id_col: str) -> Column:
    """Unsigned crc32 of an id's decimal digits."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))


def odd_to_hours(id_col: str, us: Column) -> Column:
    """us, floored to the hour where the id's crc is odd."""
    return F.when(crc(id_col) % 2 == 1, us - F.pmod(us, F.lit(HOUR))).otherwise(us)


def orders_of(sales: DataFrame) -> DataFrame:
    """client_id, us, sale_id, priority and total_cents of each order; where the crc of sale_id isn't divisible by 3, twice."""
    total = F.col("total")
    cents = F.when(F.isnan(total) | (F.abs(total) == float("inf")), None).otherwise(F.floor(total * 100 + 0.5).cast("long"))
    one = sales.select("client_id", odd_to_hours("sale_id", micros(sales, "sold_at")).alias("us"), "sale_id", F.col("priority").cast("int").alias("priority"), cents.alias("total_cents"))
    other = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    same = F.struct("sale_id", "priority")
    both = F.when(crc("sale_id") % 3 != 0, F.array(same, other)).otherwise(F.array(same))
    return one.select("client_id", "us", "total_cents", F.explode(both).alias("x")).select("client_id", "us", "x.sale_id", "x.priority", "total_cents")


def op12_asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click's latest order in the 240 hours up to it.

    Rows without click_id are left out; copies of a click with different values count once, with the earliest time and the least client.
    """
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")
    events = clicks.where("click_id IS NOT NULL").select("click_id", "client_id", micros(clicks, "ts").alias("us"))
    events = events.groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("us").alias("us"))
    events = events.select("click_id", "client_id", odd_to_hours("click_id", F.col("us")).alias("ts_us"))
    orders = orders_of(sales).withColumnRenamed("us", "ts_us")
    prefer = [F.col("priority"), F.bitwise_not("sale_id")]  # the larger sale_id has the smaller complement
    matched = latest_within(events, orders, 240 * HOUR, "client_id", "ts_us", prefer, ["sale_id", "total_cents"])
    return matched.select(
        "click_id", "client_id", "ts_us", "hit.sale_id", (F.col("ts_us") - F.col("hit.at")).alias("lag_us"), "hit.total_cents", F.coalesce("hit.n_tied", F.lit(0)).cast("long").alias("n_tied"),
    )


def crc_sql(digits: str) -> str:
    """DuckDB's crc32 of a text of ASCII characters."""
    step = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({digits}, ''), lambda z: ascii(z)::BIGINT), lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP12_SQL = f"""
WITH c0 AS (
  SELECT click_id, min(client_id) AS client_id, min(epoch_us(ts)) AS us FROM clicks WHERE click_id IS NOT NULL GROUP BY 1),
c AS (
  SELECT click_id, client_id, CASE WHEN {crc_sql("click_id::VARCHAR")} % 2 = 1 THEN us - ((us % {HOUR}) + {HOUR}) % {HOUR} ELSE us END AS ts_us FROM c0),
s0 AS (
  SELECT client_id, sale_id, priority, CASE WHEN isfinite(total) THEN CAST(floor(100 * total + 0.5) AS BIGINT) END AS total_cents,
    epoch_us(sold_at) AS us, {crc_sql("sale_id::VARCHAR")} AS h FROM sales),
s1 AS (
  SELECT * REPLACE (CASE WHEN h % 2 = 1 THEN us - ((us % {HOUR}) + {HOUR}) % {HOUR} ELSE us END AS us) FROM s0),
s2 AS (
  SELECT client_id, us, sale_id, priority, total_cents FROM s1
  UNION ALL SELECT client_id, us, -1 - sale_id, 6 - priority, total_cents FROM s1 WHERE h % 3 <> 0),
s3 AS (
  SELECT *, count(*) OVER (PARTITION BY client_id, us) AS n_tied,
    row_number() OVER (PARTITION BY client_id, us ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST, total_cents NULLS FIRST) AS place
  FROM s2 WHERE client_id IS NOT NULL AND us IS NOT NULL),
w AS (SELECT * FROM s3 WHERE place = 1),
m AS (
  SELECT c.click_id, c.client_id, c.ts_us, w.sale_id, c.ts_us - w.us AS lag_us, w.total_cents, w.n_tied, w.us AS found
  FROM c ASOF LEFT JOIN w ON c.client_id = w.client_id AND c.ts_us >= w.us)
SELECT click_id, client_id, ts_us,
  CASE WHEN lag_us <= {240 * HOUR} THEN sale_id END AS sale_id,
  CASE WHEN lag_us <= {240 * HOUR} THEN lag_us END AS lag_us,
  CASE WHEN lag_us <= {240 * HOUR} THEN total_cents END AS total_cents,
  CASE WHEN lag_us <= {240 * HOUR} THEN CAST(n_tied AS BIGINT) ELSE 0 END AS n_tied
FROM m
"""
