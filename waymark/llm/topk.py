"""Exact top-k inner-product search with two cover trees.

Vectors, queries and data alike, are dealt to the nearest of a bounded sample
of pivots, and each pivot's share into blocks of a fixed size, so that a block
lies close together where the data allow it. A task builds a cover tree over each
block it compares: a node's children are centres no nearer to each other than half its
covering radius, and every point below a node lies within its radius.

The largest inner product between points below two nodes is at most the
centres' product plus radii times norms. A query starts from its kth score
in a bounded sample of the rows, and a pair of nodes is pruned where its
bound is under the worst kth score of the query group: first pairs of whole
blocks, of which then nothing moves, then pairs of nodes inside a task, which
takes one query block and a few data blocks, the most promising first. Each
task returns k rows a query, and a window over them gives the result.

What isn't pruned costs a move of the data block once per query block (as many
as queries over QUERY_BLOCK), which is what a stated query set against all rows
costs; vectors without clusters, such as random ones, let nothing be pruned.
Equal vectors are one point with few ids: no other copy can be among the first
k of any query. Surplus copies are left out before the shuffle, batch by
batch, so a very common vector costs no more than a rare one.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; vectors of unequal length are filled up with
zeros, empty ones too; repeated ids are separate candidates, none of which
answers a query with that id; fewer than k candidates give fewer rows; no
queries or an empty table give an empty result. Scores are exact integers; a
component of 2^63 or more after scaling, or a compared score of 2^63, fails.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

DATA_BLOCK, QUERY_BLOCK, BLOCKS_A_TASK, LEAF = 2048, 1024, 4, 64
#: So many rows, the first in order of a hash, give the queries their first bound; one for each ROWS_A_PIVOT is a pivot.
SAMPLE, ROWS_A_PIVOT = 256, 512
#: Points below pruned pairs' survivors that are scored in one product.
BATCH = 2048
#: Stands for no score.
NOTHING = -(2**63)


@dataclass
class Node:
    center: np.ndarray
    norm: float
    radius: float
    points: np.ndarray  # numbers of the points below
    children: list["Node"]


def build(x: np.ndarray, ids: np.ndarray | None = None) -> Node | None:
    """Cover tree over the rows of x."""
    if not len(x):
        return None
    points = np.arange(len(x)) if ids is None else ids

    def node(center: int, members: np.ndarray, far: np.ndarray) -> Node:
        radius = float(far.max())
        made = Node(x[center], float(np.linalg.norm(x[center])), radius, members, [])
        if len(members) <= LEAF or radius == 0.0:
            return made
        # greedy net of half the radius: the farthest point without a centre becomes one
        owner, nearest = np.zeros(len(members), int), far.copy()
        centers = [center]
        while nearest.max() > radius / 2:
            new = int(members[int(nearest.argmax())])
            gap = np.linalg.norm(x[members] - x[new], axis=1)
            closer = gap < nearest
            owner[closer], nearest[closer] = len(centers), gap[closer]
            centers.append(new)
        for i, c in enumerate(centers):
            mine = owner == i
            made.children.append(node(c, members[mine], nearest[mine]))
        return made

    return node(int(points[0]), points, np.linalg.norm(x[points] - x[points[0]], axis=1))


class Best:
    """The k best (score, id) of each query so far; floor: a score that k other rows are known to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n, NOTHING) if floor is None else floor
        self.score = np.full((n, k), NOTHING)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates as parallel arrays."""
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, self.k), row])
        score = np.concatenate([self.score[rows].ravel(), score])
        ids = np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((ids, ~score, row))  # ~ turns the order without overflow
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.k
        self.score[row[first], place[first]] = score[first]
        self.id[row[first], place[first]] = ids[first]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point while all sums stay under 2^53, of Python's integers where they could leave 63 bits."""
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if len(a) and len(b) else 0.0
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**61:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    if max(wide.max(), -wide.min()) >= 2**63:
        raise OverflowError("a score of 2^63 or more")
    return wide.astype(np.int64)


def search(q: np.ndarray, q_ids: np.ndarray, q_tree: Node, x: np.ndarray, copies: list[np.ndarray], x_tree: Node, best: Best) -> int:
    """Walks pairs of nodes of both trees, offers what isn't pruned and returns how many products that took. copies: ids of each row of x.

    Sibling nodes are taken together: one matrix holds the bounds of all pairs
    of two sets of siblings. Data nodes are opened in the order of their bounds.
    """
    counts = np.array([len(c) for c in copies])
    alone = np.array([c[0] for c in copies])
    lone = np.array([(c == c[0]).all() for c in copies])

    scored = 0

    def score(rows: np.ndarray, points: np.ndarray) -> None:
        nonlocal scored
        scored += len(rows) * len(points)
        for at in range(0, len(points), BATCH):
            part = points[at : at + BATCH]
            s = _product(q[rows], x[part])
            s[(q_ids[rows][:, None] == alone[part][None, :]) & lone[part][None, :]] = NOTHING
            least = best.worst(rows)
            if len(part) > best.k:  # a point is a candidate at least, so k points bound the kth score
                least = np.maximum(least, np.partition(s, len(part) - best.k, axis=1)[:, len(part) - best.k])
            r, p = np.nonzero((s >= least[:, None]) & (s > NOTHING))
            if not len(r):
                continue
            row = np.repeat(rows[r], counts[part[p]])
            ids = np.concatenate([copies[i] for i in part[p]])
            value = np.repeat(s[r, p], counts[part[p]])
            other = q_ids[row] != ids
            if other.any():
                best.offer(row[other], value[other], ids[other])

    def bounds(a: list[Node], b: list[Node]) -> np.ndarray:
        ca, cb = np.array([n.center for n in a]), np.array([n.center for n in b])
        na, nb = np.array([n.norm for n in a])[:, None], np.array([n.norm for n in b])
        ra, rb = np.array([n.radius for n in a])[:, None], np.array([n.radius for n in b])
        return ca @ cb.T + na * rb + ra * nb + ra * rb + 1e-9 * (1 + (na + ra) * (nb + rb))

    def visit(qs: list[Node], xs: list[Node]) -> None:
        if not qs or not xs:
            return
        worst = np.array([best.worst(n.points).min() for n in qs])
        live = bounds(qs, xs) >= worst[:, None]
        inner = np.array([bool(n.children) for n in xs])
        q_inner = np.array([bool(n.children) for n in qs])
        some = live & ~inner[None, :]
        rows = np.flatnonzero(some.any(axis=1) & ~q_inner)
        if len(rows):
            cols = np.flatnonzero(some[rows].any(axis=0))
            score(np.concatenate([qs[i].points for i in rows]), np.concatenate([xs[j].points for j in cols]))
        for i in np.flatnonzero(some.any(axis=1) & q_inner):
            visit(qs[i].children, [xs[j] for j in np.flatnonzero(some[i])])
        opened = np.flatnonzero(inner & live.any(axis=0))
        if len(opened):
            top = np.where(live, bounds(qs, xs), -np.inf).max(axis=0)
            for j in opened[np.argsort(-top[opened], kind="stable")]:
                visit([qs[i] for i in np.flatnonzero(live[:, j])], xs[j].children)

    visit(q_tree.children or [q_tree], [x_tree])
    return scored


def components(vector: Column, scale: float = 256.0) -> Column:
    """Integer components; null where the vector takes no part."""
    floats = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(floats, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v: Column) -> Column:
        large = (F.abs(v * scale) >= 2.0**63) & (F.abs(v) < float("inf"))
        return F.when(large, F.raise_error(F.lit("a vector component too large for 64 bits")).cast("long")).otherwise(F.floor(v * scale).cast("long"))

    return F.when(F.coalesce(fine, F.lit(False)), F.transform(floats, whole))


def _matrix(rows: list) -> np.ndarray:
    width = max(map(len, rows), default=0) or 1
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a


def _narrow(m: np.ndarray) -> np.ndarray:
    """The matrix in the shortest integers that hold it."""
    return m.astype(np.min_scalar_type(min(-1, m.min(initial=0), ~m.max(initial=0))))


def _place(*keys: np.ndarray) -> np.ndarray:
    """Number of each row among the rows before it with equal keys; equal keys stand together."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _few_copies(m: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without needless copies: of a vector k rows an id, then the 2 k smallest ids; so k rows of other ids are left for any query."""
    _, vector = np.unique(m, axis=0, return_inverse=True)
    vector = vector.ravel()
    order = np.lexsort((ids, vector))
    order = order[_place(vector[order], ids[order]) < k]
    return np.sort(order[_place(vector[order]) < 2 * k])


def _nearest(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Number of the nearest pivot of each row."""
    width = max(m.shape[1], pivots.shape[1])
    a, b = _fit(m, width).astype(np.float64), _fit(pivots, width).astype(np.float64)
    return ((b * b).sum(axis=1) - 2 * (a @ b.T)).argmin(axis=1).astype(np.int32)


def _blocks(counts: dict[int, int], pivots: int, size: int, packed: bool) -> tuple[list[int], list[int], int]:
    """First block and number of blocks of each pivot, and blocks in all; packed: pivots with few rows share a block."""
    first, many, blocks, room = [], [], 0, 0
    for p in range(pivots):
        n = counts.get(p, 0)
        if packed and n <= room:
            first.append(blocks - 1)
            many.append(1)
            room -= n
            continue
        first.append(blocks)
        many.append(max(1, math.ceil(n / size)))
        blocks += many[-1]
        room = size - n if n <= size else 0
    return first, many, blocks


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k best other rows."""
    points = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), components(F.col(f"`{vector_col}`")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    n, nq = points.agg(F.count(F.lit(1)), F.count_if("q")).first()
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    if not n or not nq:
        return spark.createDataFrame([], schema)
    sample = points.select("id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    known, known_ids = _matrix([r["v"] for r in sample]), np.array([r["id"] for r in sample], np.int64)
    pivots = known[: math.ceil(n / ROWS_A_PIVOT)]

    def dealt(queries: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vectors = batch.column(0).to_numpy(), batch.column(1)
                m = _matrix(vectors.to_pylist())
                kept = np.arange(len(ids)) if queries else _few_copies(m, ids, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), vectors.take(pa.array(kept)), pa.array(_nearest(m[kept], pivots))], names=["id", "v", "pivot"])

        source = points.where("q") if queries else points
        return materialize(source.select("id", "v").mapInArrow(run, "id long, v array<long>, pivot int"), "dealt")

    def blocked(dealt_: DataFrame, size: int, packed: bool) -> DataFrame:
        counts = {r["pivot"]: r["n"] for r in dealt_.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as pivots
        first, many, _ = _blocks(counts, len(pivots), size, packed)
        at = F.col("pivot") + 1
        block = F.element_at(F.array(*map(F.lit, first)), at) + F.pmod(F.xxhash64("id", "v"), F.element_at(F.array(*map(F.lit, many)), at))
        return dealt_.select("id", "v", block.cast("int").alias("block"))

    def pack(queries: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m, ids = _matrix(list(pdf["v"])), pdf["id"].to_numpy(np.int64)
            if queries:
                floor = _floor(m, ids, known, known_ids, k)
                content, x, least = (_narrow(m), ids, floor), m, float(floor.min())
            else:
                few = _few_copies(m, ids, k)
                unique, inverse = np.unique(m[few], axis=0, return_inverse=True)
                order = np.argsort(inverse.ravel(), kind="stable")
                copies = np.split(ids[few][order], np.cumsum(np.bincount(inverse.ravel()))[:-1])
                content, x, least = (_narrow(unique), copies), unique, 0.0
            x = x.astype(np.float64)
            center = x.mean(axis=0)
            radius = float(np.linalg.norm(x - center, axis=1).max())
            return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "center": [center.tolist()], "radius": [radius], "least": [least], "payload": [pickle.dumps(content)]})

        return run

    packed = "block int, center array<double>, radius double, least double, payload binary"
    data = materialize(blocked(dealt(False), DATA_BLOCK, False).groupBy("block").applyInPandas(pack(False), packed), "data-blocks")
    queries = materialize(blocked(dealt(True), QUERY_BLOCK, True).groupBy("block").applyInPandas(pack(True), packed), "query-blocks")
    groups = math.ceil(data.count() / BLOCKS_A_TASK)
    n_query = queries.agg(F.max("block")).first()[0] + 1

    def norm(x: str) -> Column:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, y: t + y * y))

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda t, z: t + z)

    # each data block with each query block, by their balls alone
    balls = data.select("block", "center", "radius", norm("center").alias("norm"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))
    asked = queries.select(F.col("block").alias("qb"), F.col("center").alias("q_center"), F.col("radius").alias("q_radius"), norm("center").alias("q_norm"), "least")
    bound = dot("center", "q_center") + F.col("norm") * F.col("q_radius") + F.col("q_norm") * F.col("radius") + F.col("radius") * F.col("q_radius")
    slack = (F.lit(1.0) + (F.col("norm") + F.col("radius")) * (F.col("q_norm") + F.col("q_radius"))) * 1e-9
    live = balls.join(asked, "qb").withColumn("bound", bound).where(F.col("bound") + slack >= F.col("least")).select("qb", "block", (F.col("block") % groups).alias("grp"), "bound")
    live = materialize(live, "block-pairs")
    right = live.join(data.select("block", "payload"), "block").select("qb", "grp", "bound", "payload")
    left = live.select(F.col("qb").alias("l_qb"), F.col("grp").alias("l_grp")).distinct().join(queries.select(F.col("block").alias("l_qb"), "payload"), "l_qb")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        right = right.sort_values("bound", ascending=False, kind="stable") if len(right) else right
        for q_payload in left["payload"]:
            q, q_ids, floor = pickle.loads(q_payload)
            best = Best(len(q), k, floor)
            for x_payload in right["payload"]:
                x, copies = pickle.loads(x_payload)
                width = max(q.shape[1], x.shape[1])
                a, b = _fit(q, width).astype(np.int64), _fit(x, width).astype(np.int64)
                search(a, q_ids, build(a.astype(np.float64)), b, copies, build(b.astype(np.float64)), best)
            there = best.score > NOTHING
            out.append(pd.DataFrame({"query_id": np.repeat(q_ids, k)[there.ravel()], "vec_id": best.id[there], "score": best.score[there]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = left.groupBy("l_qb", "l_grp").cogroup(right.groupBy("qb", "grp")).applyInPandas(match, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(q: np.ndarray, q_ids: np.ndarray, known: np.ndarray, known_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth score among known rows, NOTHING where fewer than k are others."""
    if len(known) < k:
        return np.full(len(q), NOTHING)
    width = max(q.shape[1], known.shape[1])
    s = _product(_fit(q, width), _fit(known, width))
    s[q_ids[:, None] == known_ids[None, :]] = NOTHING
    return np.partition(s, len(known) - k, axis=1)[:, len(known) - k]


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows of every row whose id is divisible by 50."""
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.c, v.c), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
