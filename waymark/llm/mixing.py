"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear
between knots. Its share of the stream at t is its weight over the sum of all
weights; the integral of that share is its demand. A source whose demand is
above ``max_repeats`` times its size is held there and the excess is reshared
by weight. Inside a source, documents stand in a seeded hash order; pass after
pass they fill the source's cumulative demand, and the inverse of that demand
gives each copy its position in training. Copies are range-sorted by position.

Running sums never put one source into one task: they run inside
(source, hash bucket) cells and a small per-source sum over cells gives the
offsets, so a source that holds a third of all rows is spread evenly.

Defined cases: null text has size 0; null sources form one source of their
own, last in order; rows with equal ids and sizes are separate rows; an empty
table gives an empty result; columns other than id, text and source are not
read, or kept where rows are returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialize, n_words, spare, table, text_of

#: Hash cells of one source; a cell of a source with 10^10 rows has 2.4 million.
CELLS = 4096
Schedule = Sequence[tuple[float, float]]


def _mean(xs) -> Column:
    """Mean of an array, exact where all elements are equal."""
    return F.get(xs, F.lit(0)) + F.aggregate(xs, F.lit(0.0), lambda t, x: t + (x - F.get(xs, F.lit(0)))) / F.size(xs)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "0", keep: Sequence[str] = ()) -> DataFrame:
    """(id, source, size, order key, cell) of every document, and the columns to keep."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    return (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("src"), n_words(text_of(text_col)).alias("size"), key.alias("okey"), *[F.col(f"`{c}`") for c in keep])
        .withColumn("cell", F.conv(F.substring("okey", 1, 3), 16, 10).cast("int"))
    )


def cells_of(sized: DataFrame) -> DataFrame:
    """Words and rows of each (source, cell), with the source's words before the cell and in all."""
    per_cell = sized.groupBy("src", "cell").agg(F.sum("size").alias("cell_size"))
    in_source = Window.partitionBy("src")
    before = in_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return per_cell.select(
        "src", "cell",
        F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("before"),
        F.sum("cell_size").over(in_source).alias("source_size"),
    )


def _mean_share(schedules: Sequence[Schedule], steps: int) -> list[list[float]]:
    """For each schedule its weight at the middle of each step."""

    def at(knots: Schedule, t: float) -> float:
        if t <= knots[0][0]:
            return knots[0][1]
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0) if t1 > t0 else w1
        return knots[-1][1]

    return [[at(k, (i + 0.5) / steps) for i in range(steps)] for k in schedules]


def source_targets(cells: DataFrame, schedules: Sequence[Schedule], max_repeats: int = 3, steps: int = 64) -> DataFrame:
    """(src, source_size, target, curve): words each source gives, and its cumulative demand after each step as a share of its target.

    Sources by code point, null last, take the schedules in turn. One row per
    source is sorted here, already summed up; no document row is. The words
    given at a level are the least over all choices of full sources, so the
    level sought is the greatest over prefixes of the sources in the order in
    which they fill up.
    """
    if not schedules or any(not k for k in schedules):
        raise ValueError("at least one schedule with a knot is needed")
    grid = _mean_share(schedules, steps)
    if any(w < 0 for k in grid for w in k):
        raise ValueError("weights must not be negative")
    sources = cells.groupBy("src").agg(F.max("source_size").alias("source_size"))
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in k]) for k in grid])
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(weights, (F.col("rank") % len(grid) + 1).cast("int")))
    whole = Window.partitionBy()
    # a source's demand rate at each step is its share of all weights there, in units of the mean weight of all sources
    sums = F.array(*[F.sum(F.element_at("w", i + 1)).over(whole) for i in range(steps)])
    ranked = ranked.withColumn("sums", sums).withColumn("level_weight", _mean(F.col("sums")))
    ranked = ranked.withColumn("share", F.zip_with("w", "sums", lambda a, b: F.when(b > 0, a * (F.col("level_weight") / b)).otherwise(F.lit(0.0))))
    total_weight = _mean(F.col("share"))  # its integral over training time
    ranked = ranked.withColumn("weight", total_weight).withColumn("cap", F.col("source_size") * max_repeats)
    by_fill = Window.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col("rank"))
    here = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumn(
        "level",
        F.try_divide(F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(here), F.lit(0)), F.sum("weight").over(onward)),
    )
    level = F.max("level").over(whole)
    target = F.when(F.col("weight") > 0, F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))).otherwise(F.lit(0.0))
    share_sum = F.aggregate("share", F.lit(0.0), lambda a, b: a + b)
    curve = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.when(F.col("share_sum") > 0, F.aggregate(F.slice("share", F.lit(1), i), F.lit(0.0), lambda a, b: a + b) / F.col("share_sum")).otherwise(i / F.lit(float(steps))))
    return filled.withColumn("target", target).withColumn("share_sum", share_sum).select("src", "source_size", "target", curve.alias("curve"))


def plan(docs: DataFrame, schedules: Sequence[Schedule], max_repeats: int = 3, steps: int = 64, seed: str = "0", keep: Sequence[str] = (), **cols: str) -> DataFrame:
    """One row per document, with the columns to keep: size, source_size, target, first_word (its place in the source's order), taken, curve.

    taken is exact: whole passes over the source, then documents in order until
    the target, the last of them in part. A source's taken words are its target
    rounded down, and no document is taken more than max_repeats times.
    """
    sized = materialize(sizes(docs, seed=seed, keep=keep, **cols), "sizes")  # texts are read once
    cells = cells_of(sized)
    targets = source_targets(cells, schedules, max_repeats, steps)
    # small tables: one row per source, one per (source, cell); the join with documents is on the cell, so no source is one key
    cells = cells.select(F.col("src").alias("c_src"), F.col("cell").alias("c_cell"), "before")
    targets = targets.withColumnRenamed("src", "t_src")
    placed = cells.join(targets, F.col("c_src").eqNullSafe(F.col("t_src")), "inner").drop("t_src")
    in_cell = Window.partitionBy("src", "cell").orderBy("okey", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = sized.withColumn("upto", F.sum("size").over(in_cell))
    rows = ordered.join(placed, F.col("src").eqNullSafe(F.col("c_src")) & (F.col("cell") == F.col("c_cell")), "inner")
    budget = F.floor(F.col("target")).cast("long")
    first = F.col("before") + F.col("upto") - F.col("size")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("first_word", first).withColumn("passes", passes).withColumn("left", budget - passes * F.col("source_size"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("first_word")))
    return rows.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).alias("taken"), "first_word", "curve", *[F.col(f"`{c}`") for c in keep])


def with_copies(planned: DataFrame) -> DataFrame:
    """planned with ``copies``: array of (copy, words, position in [0, 1]) that the mix takes of the document.

    A copy's middle word is the source's demand at its position: cumulative
    demand is inverted by linear interpolation between steps.
    """
    curve = F.concat(F.array(F.lit(0.0)), F.col("curve"))
    number = F.when((F.col("taken") > 0) & (F.col("size") > 0), F.ceil(F.col("taken") / F.greatest(F.lit(1), "size")).cast("int")).otherwise(0)

    def words(i: Column) -> Column:
        return F.least(F.col("size"), F.col("taken") - i * F.col("size"))

    def inverse(share: Column) -> Column:
        step = F.greatest(F.lit(1), F.least(F.size("curve"), F.size(F.filter(curve, lambda x: x < share))))
        low, high = F.get(curve, step - 1), F.get(curve, step)
        return (step - 1 + F.when(high > low, (share - low) / (high - low)).otherwise(F.lit(0.0))) / F.size("curve")

    def one(i: Column) -> Column:
        share = F.least(F.lit(1.0), (i * F.col("source_size") + F.col("first_word") + words(i) / 2) / F.col("target"))
        return F.struct(i.alias("copy"), words(i).alias("words"), let(share, inverse).alias("position"))

    none = F.array().cast("array<struct<copy:int,words:bigint,position:double>>")
    return planned.withColumn("copies", F.when(number > 0, F.transform(F.sequence(F.lit(0), number - 1), one)).otherwise(none))


def stream(planned: DataFrame) -> DataFrame:
    """One row per copy of a document that the mix takes: copy number, words and position in [0, 1]."""
    extra = [F.col(f"`{c}`") for c in planned.columns if c not in ("doc_id", "source", "size", "source_size", "target", "taken", "first_word", "curve")]
    copies = with_copies(planned).select("doc_id", "source", F.explode("copies").alias("c"), *extra)
    return copies.select("doc_id", "source", "c.copy", "c.words", "c.position", *extra)


def in_training_order(copies: DataFrame) -> DataFrame:
    """Copies range-sorted by position."""
    return copies.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def mix_documents(docs: DataFrame, schedules: Sequence[Schedule], max_repeats: int = 3, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row once for each copy, in order of training position, with its own columns.

    Copies are whole: a row of which the mix takes a part is there once for it.
    Rows that the mix doesn't take, as their source has more than its share,
    and rows without words fall away. Rows are numbered in a written table, so
    rows with equal or null ids each have their own copies.
    """
    row, copy, at = (spare(docs, x) for x in ("row", "copy", "position"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    planned = plan(numbered, schedules, max_repeats, seed=seed, keep=(row,), id_col=id_col, text_col=text_col, source_col=source_col)
    placed = stream(planned).select(F.col(row), F.col("copy").alias(copy), F.col("position").alias(at))
    rows = numbered.join(placed, row)
    return rows.repartitionByRange(at, row, copy).sortWithinPartitions(at, row, copy).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Production schedules: sources weigh 5, 2, 1 in turn, alike at all times.
FIXED_WEIGHTS: tuple[Schedule, ...] = (((0.0, 5.0),), ((0.0, 2.0),), ((0.0, 1.0),))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in order of the training position of its first copy: what its copies in the mix take, and where; rows that aren't taken last."""
    rows = with_copies(plan(table(spark, sf_dir, "documents"), FIXED_WEIGHTS))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda t, c: t + c["words"])
    first = F.get("copies", F.lit(0))["position"]
    out = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").cast("long").alias("n_copies"), F.coalesce(first, F.lit(2.0)).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").drop("position")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS okey
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
r AS (SELECT *, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM r),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w),
t AS (SELECT *, least(cap::DOUBLE, coalesce(max(lvl) OVER () * weight, cap::DOUBLE)) AS target FROM l),
o AS (
  SELECT d.*, CAST(sum(size) OVER (PARTITION BY src ORDER BY okey, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS first_word
  FROM d)
SELECT o.doc_id, o.size, t.source_size, t.target,
       CAST(CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END * o.size
         + greatest(0, least(o.size, CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT % t.source_size ELSE 0 END - o.first_word)) AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN (taken + o.size - 1) // o.size ELSE 0 END AS n_copies
FROM o JOIN t ON o.src IS NOT DISTINCT FROM t.src
"""
