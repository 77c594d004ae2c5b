"""Links and components of near vectors by an epsilon grid order join.

Cosine t of two vectors is distance eps = sqrt(2 - 2 t) of their unit vectors. Unit vectors are
projected on the leading principal directions of a bounded sample, which can
only bring them nearer to each other; cells of side eps on these directions
give the epsilon grid order, in which all vectors are range-sorted. Runs of the
sorted sequence are blocks, runs of blocks are intervals, level by level, each
with the box of its projections and the ball around its unit vectors.

The join descends pairs of intervals, one level at a time, as a table of pairs: a pair
whose boxes or balls lie more than eps apart is skipped; one whose balls lie so
near that every pair of vectors must link is settled as a whole, with counts and one
edge, so that a third of all rows in copies or near copies isn't multiplied
out; what is left at the lowest level goes to tasks of a few blocks, where the
descent goes on inside the blocks down to leaves that one product compares.
Tasks return a row for each vector that has links, with their number and the
least vector it is connected with, never pairs.

The sample only directs the sort: any directions give the same links. Vectors
without structure, such as random ones, let nothing be skipped and cost a product of all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components
link with nothing and are rows with 0 links; vectors of unequal length are filled up
with zeros; rows without an id are left out; rows with equal ids are separate vectors of
one id; an empty table gives an empty result; columns beside id and vector aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import materialize, table
from .components import connected_components

#: Leading directions of the grid; rows, and numbers in all, of the sample that gives them.
DIRECTIONS, SAMPLE, SAMPLE_NUMBERS = 8, 4096, 2**22
#: Bytes and rows of a block at most, rows of a leaf, blocks of an interval and of each side of a task, intervals of the highest level at most.
BLOCK_BYTES, BLOCK, LEAF, FAN, SIDE, TOP = 2**19, 2048, 256, 8, 4, 16
#: Rounding allowed for when pairs are skipped or settled; nearer products are worked out again from the vectors as they are.
SLACK = 1e-9
#: A vector is its block's number times this plus its place.
PLACES = 2**20


def unit_rows(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision scaled by powers of two to about 1, which changes no cosine, and their unit vectors."""
    x = raw.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(vectors: pa.Array, width: int, kind: str) -> np.ndarray:
    out = np.zeros((len(vectors), width), kind)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    if len(ends) and (ends == width).all():
        return flat.reshape(len(ends), width).astype(kind)
    at = 0
    for i, n in enumerate(ends):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _directions(sample: list, width: int) -> np.ndarray:
    """Leading principal directions of sampled vectors, as columns."""
    x = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    u = unit_rows(x)[1]
    return np.linalg.svd(u - u.mean(axis=0), full_matrices=len(sample) <= width)[2][:DIRECTIONS].T.copy()


def in_grid_order(points: DataFrame, basis: np.ndarray, eps: float, width: int, kind: str, parts: int) -> DataFrame:
    """(id, raw): vectors as bytes, range-sorted by cell, then projection."""

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _matrix(batch.column(1), width, kind)
            p = unit_rows(raw)[1] @ basis
            cells = np.floor(p / eps).astype(np.int32)
            rows = [pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(p.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], names=["id", "raw", "cells", "p"])

    dealt = points.select("id", "v").mapInArrow(projected, "id long, raw binary, cells array<int>, p array<double>")
    return dealt.repartitionByRange(parts, "cells", "p", "id").sortWithinPartitions("cells", "p", "id").select("id", "raw")


def _blocks(basis: np.ndarray, width: int, kind: str, size: int):
    """Runs of sorted vectors as blocks with box and ball."""
    names = ["part", "at", "n", "ids", "raw", "low", "high", "center", "radius"]

    def made(part: int, at: int, ids: list, raw: list) -> pa.RecordBatch:
        joined = b"".join(raw)
        u = unit_rows(np.frombuffer(joined, kind).reshape(len(ids), width))[1]
        p, center = u @ basis, u.mean(axis=0)
        radius = float(np.sqrt(((u - center) ** 2).sum(axis=1)).max())
        one = [part, at, len(ids), np.array(ids, np.int64).tobytes(), joined, p.min(axis=0).tolist(), p.max(axis=0).tolist(), center.tolist(), radius]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in one], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, at, part = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            ids += batch.column(0).to_pylist()
            raw += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield made(part, at, ids[:size], raw[:size])
                ids, raw, at = ids[size:], raw[size:], at + 1
        if ids:
            yield made(part, at, ids, raw)

    return run


def _merged(fan: int):
    """Box and ball of an interval of up to fan others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centers, n = np.array(pdf["center"].tolist()), pdf["n"].to_numpy()
        center = (centers * n[:, None]).sum(axis=0) / n.sum()
        radius = float((np.sqrt(((centers - center) ** 2).sum(axis=1)) + pdf["radius"].to_numpy()).max())
        low, high = np.array(pdf["low"].tolist()).min(axis=0), np.array(pdf["high"].tolist()).max(axis=0)
        return pd.DataFrame({"no": [int(pdf["no"].iloc[0]) // fan], "n": [int(n.sum())], "low": [low.tolist()], "high": [high.tolist()], "center": [center.tolist()], "radius": [radius]})

    return run


def _judged(pairs: DataFrame, info: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of intervals that may hold links, with their sizes; whole: all their vectors link."""

    def side(x: str) -> DataFrame:
        return info.select(F.col("no").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "low", "high", "center", "radius")])

    def length(parts: Column) -> Column:
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda t, d: t + d * d))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = F.zip_with(F.arrays_zip("a_low", "a_high"), F.arrays_zip("b_low", "b_high"), lambda x, y: F.greatest(F.lit(0.0), y["b_low"] - x["a_high"], x["a_low"] - y["b_high"]))
    between = length(F.zip_with("a_center", "b_center", lambda x, y: x - y))
    both = both.withColumn("apart", length(overlap)).withColumn("between", between).withColumn("reach", F.col("a_radius") + F.col("b_radius"))
    near = (F.col("apart") <= eps + SLACK) & (F.col("between") - F.col("reach") <= eps + SLACK)
    return both.where(near).select("a", "b", "a_n", "b_n", (F.col("between") + F.col("reach") <= eps - SLACK).alias("whole"))


class Tile:
    """Links among the blocks of one task."""

    def __init__(self, blocks: dict[int, np.ndarray], basis: np.ndarray, least: float, leaf: int = LEAF):
        self.leaf, self.least, self.eps = leaf, least, math.sqrt(max(0.0, 2 - 2 * least))
        self.start, at = {}, 0
        for no in sorted(blocks):
            self.start[no] = at
            at += len(blocks[no])
        self.size = {no: len(x) for no, x in blocks.items()}
        rows = [unit_rows(blocks[no]) for no in sorted(blocks)]
        self.x, self.u = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        self.p = self.u @ basis
        self.point = np.concatenate([no * PLACES + np.arange(self.size[no]) for no in sorted(blocks)])
        self.links, self.label = np.zeros(at, np.int64), np.arange(at)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.compared = 0

    def box(self, s: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if s not in self.boxes:
            part = self.p[s[0] : s[1]]
            self.boxes[s] = part.min(axis=0), part.max(axis=0)
        return self.boxes[s]

    def join(self, a: int, b: int) -> None:
        """Compares two blocks, or a block with itself."""
        self.visit(*((self.start[x], self.start[x] + self.size[x]) for x in (a, b)))

    def visit(self, s: tuple[int, int], t: tuple[int, int]) -> None:
        if s != t:
            (low, high), (low2, high2) = self.box(s), self.box(t)
            gap = np.maximum(0.0, np.maximum(low2 - high, low - high2))
            if math.sqrt(float(gap @ gap)) > self.eps + SLACK:
                return
        if max(s[1] - s[0], t[1] - t[0]) <= self.leaf:
            self.compare(s, t)
            return

        def halves(i: tuple[int, int]) -> list[tuple[int, int]]:
            middle = (i[0] + i[1]) // 2
            return [i] if i[1] - i[0] <= self.leaf else [(i[0], middle), (middle, i[1])]

        for k, x in enumerate(halves(s)):
            for j, y in enumerate(halves(t)):
                if s != t or k <= j:
                    self.visit(x, y)

    def compare(self, s: tuple[int, int], t: tuple[int, int]) -> None:
        product = self.u[s[0] : s[1]] @ self.u[t[0] : t[1]].T
        self.compared += product.size
        i, j = np.nonzero(product >= self.least - SLACK)
        if s == t:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        close = np.flatnonzero(product[i, j] < self.least + SLACK)
        i, j = i + s[0], j + t[0]
        if len(close):
            x, y = self.x[i[close]], self.x[j[close]]
            cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            kept = np.ones(len(i), bool)
            kept[close] = cosine >= self.least
            i, j = i[kept], j[kept]
        self.links += np.bincount(i, minlength=len(self.links)) + np.bincount(j, minlength=len(self.links))
        label = self.label
        while True:
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            if not open_.any():
                return
            np.minimum.at(label, high[open_], low[open_])
            while True:
                further = label[label]
                if (further == label).all():
                    break
                label[:] = further


def near_links(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) of every row with an id."""
    spark, eps = rows.sparkSession, math.sqrt(max(0.0, 2 - 2 * least))
    vector = F.col(f"`{vector_col}`")
    small = rows.schema[vector_col].dataType.elementType.typeName() == "float"
    kind, each = ("float32", "float") if small else ("float64", "double")
    given = rows.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(vector, lambda x: x.cast(each)).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    points, alone = given.where(fine), given.where(~fine).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return alone

    asked = max(1, min(SAMPLE, SAMPLE_NUMBERS // width))
    basis = _directions([r["v"] for r in points.orderBy(F.xxhash64("id", "v"), "id").limit(asked).collect()], width)
    size = max(1, min(BLOCK, BLOCK_BYTES // (width * np.dtype(kind).itemsize)))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / size)))
    schema = "part long, at long, n long, ids binary, raw binary, low array<double>, high array<double>, center array<double>, radius double"
    ordered = in_grid_order(points, basis, eps, width, kind, parts)
    blocks = materialize(ordered.mapInArrow(_blocks(basis, width, kind, size), schema), "blocks")

    # blocks are numbered through all partitions of the sort; one row a partition here
    counted = blocks.groupBy("part").agg(F.max("at").alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("part", before.alias("before"))
    blocks = blocks.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("at")).alias("no"), *[c for c in blocks.columns if c not in ("part", "at")])

    levels = [materialize(blocks.select("no", "n", "low", "high", "center", "radius"), "intervals")]
    counts = [levels[0].count()]
    while counts[-1] > TOP:
        merged = levels[-1].groupBy(F.expr(f"no div {FAN}")).applyInPandas(_merged(FAN), levels[0].schema)
        levels.append(materialize(merged, "intervals"))
        counts.append(math.ceil(counts[-1] / FAN))

    settled: list[DataFrame] = []
    top = counts[-1]
    pairs = spark.range(top * top).select(F.expr(f"id div {top}").alias("a"), (F.col("id") % top).alias("b")).where("a <= b")
    for level in reversed(range(len(levels))):
        judged = materialize(_judged(pairs, levels[level], eps), "pairs")
        settled.append(judged.where("whole").select("a", "b", "a_n", "b_n", F.lit(FAN**level).alias("span")))
        pairs = judged.where("NOT whole").select("a", "b")
        if level:
            under, most = F.sequence(F.lit(0), F.lit(FAN - 1)), counts[level - 1]
            pairs = pairs.withColumn("i", F.explode(under)).withColumn("j", F.explode(under)).select((F.col("a") * FAN + F.col("i")).alias("a"), (F.col("b") * FAN + F.col("j")).alias("b")).where((F.col("a") <= F.col("b")) & (F.col("b") < most))
    wholes = settled[0]
    for x in settled[1:]:
        wholes = wholes.unionByName(x)

    # what is open goes to tasks of up to SIDE blocks a side
    tiled = pairs.select("a", "b", F.expr(f"a div {SIDE}").alias("left"), F.expr(f"b div {SIDE}").alias("right"))
    needed = tiled.select("left", "right", F.explode(F.array("a", "b")).alias("no")).distinct()
    loads = needed.join(blocks.select("no", "raw"), "no").select(F.col("left").alias("l"), F.col("right").alias("r"), "no", "raw")

    leaf = LEAF

    def match(wanted: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({"point": [], "links": [], "root": []}).astype("int64")
        tile = Tile({int(no): np.frombuffer(raw, kind).reshape(-1, width) for no, raw in zip(there["no"], there["raw"])}, basis, least, leaf)
        for a, b in sorted(zip(wanted["a"], wanted["b"])):
            tile.join(int(a), int(b))
        some = np.flatnonzero(tile.links)
        return pd.DataFrame({"point": tile.point[some], "links": tile.links[some], "root": tile.point[tile.label[some]]})

    found = tiled.groupBy("left", "right").cogroup(loads.groupBy("l", "r")).applyInPandas(match, "point long, links long, root long")
    found = materialize(found, "links")

    # settled pairs: each side's vectors get the other side's number; their first vectors are joined by an edge
    own = (F.col("a") == F.col("b")).cast("long")
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b_n").alias("y_n"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a_n").alias("y_n"), F.col("a").alias("y"))))
    sides = wholes.where("a <> b").select("span", ends.alias("e")).select("span", "e.*").unionByName(wholes.where("a = b").select("span", F.col("a").alias("x"), (F.col("a_n") - own).alias("y_n"), F.col("a").alias("y")))
    first = F.least(F.col("x"), F.col("y")) * F.col("span") * PLACES
    sides = sides.groupBy("span", "x").agg(F.sum("y_n").alias("more"), F.min(first).alias("root"))
    by_block = sides.select("more", "root", F.explode(F.sequence(F.col("x") * F.col("span"), F.least((F.col("x") + 1) * F.col("span"), F.lit(counts[0])) - 1)).alias("no"))
    by_block = materialize(by_block.groupBy("no").agg(F.sum("more").alias("more"), F.min("root").alias("root"), F.collect_set("root").alias("roots")), "settled")  # as many roots as levels at most

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, more, root, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(raw, np.int64)
                point = no * PLACES + np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(ids), pa.array(np.full(len(ids), more)), pa.array([root] * len(ids), pa.int64())], names=["point", "vec_id", "more", "fan"])

    listed = blocks.select("no", "ids").join(by_block.select("no", "more", "root"), "no", "left").select("no", F.coalesce("more", F.lit(0)).alias("more"), "root", "ids")
    vectors = materialize(listed.mapInArrow(ids_of, "point long, vec_id long, more long, fan long"), "vectors")

    edges = found.where("point <> root").select(F.col("point").alias("a"), F.col("root").alias("b"))
    edges = edges.unionByName(vectors.where("fan IS NOT NULL").select(F.col("point").alias("a"), F.col("fan").alias("b")))
    edges = edges.unionByName(by_block.select((F.col("no") * PLACES).alias("a"), F.explode("roots").alias("b")))
    edges = edges.unionByName(wholes.where("a <> b").select((F.col("a") * F.col("span") * PLACES).alias("a"), (F.col("b") * F.col("span") * PLACES).alias("b")))
    labels = connected_components(edges)

    linked = found.groupBy("point").agg(F.sum("links").alias("links"))
    joined = vectors.join(linked, "point", "left").join(labels, vectors.point == labels.node, "left")
    joined = joined.select("vec_id", (F.col("more") + F.coalesce("links", F.lit(0))).alias("n_links"), "label")
    least_of = vectors.join(labels, vectors.point == labels.node).groupBy("label").agg(F.min("vec_id").alias("least")).withColumnRenamed("label", "l")
    out = joined.join(least_of, joined.label == least_of.l, "left").select("vec_id", "n_links", F.coalesce("least", "vec_id").alias("component_id"))
    return out.unionByName(alone)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links at a cosine of 0.9 and components."""
    return near_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP11_SQL = """
WITH RECURSIVE g AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL),
p AS (
  SELECT r, vec_id, v, list_sum(list_transform(v, lambda x: x * x)) AS vv FROM g
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM p AS a JOIN p AS b
    ON a.r <> b.r AND list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) / sqrt(a.vv * b.vv) >= 0.9),
t AS (
  SELECT r, r AS s FROM p UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.s),
c AS (SELECT t.r, min(p.vec_id) AS component_id FROM t JOIN p ON p.r = t.s GROUP BY t.r),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT g.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, g.vec_id) AS component_id, g.vec_id = coalesce(c.component_id, g.vec_id) AS kept
FROM g LEFT JOIN n ON n.a = g.r LEFT JOIN c ON c.r = g.r
"""
