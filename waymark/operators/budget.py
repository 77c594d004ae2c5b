"""Call budgets: usage by day and month, and the replay of reservations under both limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage(calls: DataFrame, provider: str, ts: str, cost: Column) -> DataFrame:
    """(provider, day, daily_calls, daily_cost, monthly_calls, monthly_cost); days are those of the time stamp, in UTC."""
    daily = calls.groupBy(F.col(provider).alias("provider"), F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("daily_calls"), F.sum(cost).alias("daily_cost"))
    monthly = daily.groupBy("provider", F.date_trunc("month", "day").cast("date").alias("month")).agg(F.sum("daily_calls").alias("monthly_calls"), F.sum("daily_cost").alias("monthly_cost"))
    return daily.withColumn("month", F.date_trunc("month", "day").cast("date")).join(monthly, ["provider", "month"])


def admit(requests: DataFrame, daily_limit: int, monthly_limit: int, provider: str = "provider", ts: str = "ts", calls: str = "calls", order: str = "seq") -> DataFrame:
    """requests with ``admitted``: whether they fit into the day and the month, in order.

    A refused request spends nothing, so this is a fold and no running sum. A
    task streams the requests of a provider's month in order, batch by batch,
    and keeps totals only, so a month of any size takes no memory.
    """
    marked = requests.select(F.col(order).cast("long").alias("o"), F.col(provider).cast("string").alias("p"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "yyyy-MM").alias("month"), F.col(calls).cast("long").alias("n"))

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, by_day, total = None, {}, 0
        for pdf in batches:
            out = []
            for p, month, day, n in zip(pdf["p"], pdf["month"], pdf["day"], pdf["n"]):
                if (p, month) != current:
                    current, by_day, total = (p, month), {}, 0
                fits = bool(n >= 0 and by_day.get(day, 0) + n <= daily_limit and total + n <= monthly_limit)
                if fits:
                    by_day[day] = by_day.get(day, 0) + n
                    total += n
                out.append(fits)
            yield pd.DataFrame({"o": pdf["o"].to_numpy(), "admitted": out})

    ordered = marked.repartition("p", "month").sortWithinPartitions("p", "month", "o")
    decided = ordered.mapInPandas(replay, "o long, admitted boolean")
    return requests.join(decided, F.col(order) == F.col("o")).drop("o")


def admit_units(requests: DataFrame, daily_limit: int, monthly_limit: int, provider: str = "provider", ts: str = "ts", order: str = "seq") -> DataFrame:
    """The same for single calls, as window functions: equal requests are refused from the limit on, so ranks decide."""
    from pyspark.sql import Window

    day = Window.partitionBy(provider, F.to_date(ts)).orderBy(order)
    ranked = requests.withColumn("day_rank", F.row_number().over(day))
    month = Window.partitionBy(provider, F.date_trunc("month", F.col(ts))).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (F.col("day_rank") <= daily_limit).cast("int")
    return ranked.withColumn("month_rank", F.sum(fits).over(month)).withColumn("admitted", (fits == 1) & (F.col("month_rank") <= monthly_limit)).drop("day_rank", "month_rank")
