"""Order-dependent folds as window and aggregate expressions; every table carries its order in a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, numbered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def numbered(df: DataFrame, order: Sequence[str], position: str = "position") -> DataFrame:
    """df with each row's place from 1 in a total order of columns, without one task that sees all rows.

    Rows are sorted by range and written with their place in their range; the
    ranges' row counts, one each, are summed up on the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the partition above and the place in it below bit 33
    dealt = written(ranged.withColumn("__id", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__id", 33))
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("__range").agg(F.count(F.lit(1))).collect())
    before, total = [], 0
    for at, n in sizes:
        before += [F.lit(at), F.lit(total)]
        total += n
    first = F.create_map(*before)[F.col("__range")] if before else F.lit(0)
    return dealt.withColumn(position, (first + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("__id", "__range")


def in_order(value: Column, order: Column) -> Column:
    """Aggregate: an array of the values by order, nulls left out."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def union_in_order(arrays: Column, order: Column) -> Column:
    """Aggregate: distinct elements of arrays, first occurrence first."""
    return F.array_distinct(F.flatten(in_order(arrays, order)))


def first_present(value: Column, order: Column, is_present: Column) -> Column:
    """Aggregate: the value of the first row that has one."""
    return F.min_by(F.when(is_present, value), F.when(is_present, order))


def best(value: Column, *ranks: Column) -> Column:
    """Aggregate: the value with the greatest ranks."""
    return F.max_by(value, F.struct(*ranks))


def round_robin(df: DataFrame, family: str, order: str, family_rank: Column, limit: int) -> DataFrame:
    """Rows of families in turn: the first of each, then the second of each, up to limit rows, numbered in ``position``."""
    turn = F.row_number().over(Window.partitionBy(family).orderBy(order))
    dealt = df.withColumn("__turn", turn).withColumn("__fam", family_rank).orderBy("__turn", "__fam").limit(limit)
    return dealt.withColumn("position", F.row_number().over(Window.orderBy("__turn", "__fam"))).drop("__turn", "__fam")


def take_while_room(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: Column, room: int) -> DataFrame:
    """Rows of each key while the running total of amounts stays within the room."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(amount).over(w)).where(F.col("running") <= room)


def fill_members(counts: DataFrame, members: DataFrame, key: str, count: str) -> DataFrame:
    """Counts for every member of a domain, zero where none were counted."""
    return members.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def quota_sample(df: DataFrame, kind: str, order: str, quotas: dict[str, int], limit: int) -> DataFrame:
    """Up to a quota of each kind, first seen first, then filled up in order to limit rows."""
    quota = F.coalesce(*[F.when(F.col(kind) == k, q) for k, q in quotas.items()], F.lit(0))
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    marked = df.withColumn("__late", (turn > quota).cast("int"))
    return marked.orderBy("__late", order).limit(limit).drop("__late")
