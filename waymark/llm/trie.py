"""Prefix trie of conversations in preorder-interval encoding.

A node is a distinct sequence of first turns. A turn's key is a 128-bit digest of
role and text, so that texts move nowhere but to their digest; a conversation is
the sequence of its keys, and equal conversations are one sequence with a
count. The distinct sequences are ranked by a range sort of their keys, in
which those below a node stand next to each other. A node gets the ranks of the
first and the last sequence below it; in order of (first rank, depth) the nodes
are in preorder, and a subtree ends where the nodes of its last rank end. Leaves
and savings of a subtree are then differences of prefix sums over that order,
taken inside each partition of the sort and moved on by the sums of the partitions before.

No node's members meet in one task: counts are summed up before the shuffle,
and the digest of the conversations that end at a node is taken from pieces of
a range sort, streamed piece by piece. What one task must hold is one
conversation's list of turn keys (32 characters a turn, texts not among them).

Defined cases: null role or text is empty, a null turn is first; turns with equal
numbers stand in order of role, then key; rows without a conversation are left
out; a conversation without turns ends at the root; repeated rows are repeated turns;
extra columns aren't read; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .asof import crc, crc_sql
from .common import materialize, n_words, table, text_of

#: Hexadecimal characters of a turn's key, and bytes of a node's.
KEY, NODE = 32, 16
#: Characters of a piece of a list of conversations, rows of a batch.
PIECE, ROWS = 4096, 32_768
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, keys, words): each conversation's turns in order, as keys and numbers of words."""
    named, said = text_of(role), text_of(text)
    key = F.substring(F.sha2(F.concat(F.length(named).cast("string"), F.lit(":"), named, said).cast("binary"), 256), 1, KEY)
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), named.alias("role"), key.alias("key"), n_words(said).alias("words")).where("c IS NOT NULL")
    lists = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "words"))).alias("x"))
    return lists.select("c", F.col("x.key").alias("keys"), F.col("x.words").alias("words"))


def with_heads_of(lists: DataFrame, base: Column, h: Column, most: int = 3) -> DataFrame:
    """Each list with its first h turns (``most`` at most) replaced by the first h of the list named by base (those there are). lists is read three times."""
    own = lists.select("c", "keys", "words", base.alias("base"), F.least(h, F.lit(most)).cast("int").alias("h"))
    heads = lists.select(F.col("c").alias("b"), F.slice("keys", 1, most).alias("b_keys"), F.slice("words", 1, most).alias("b_words")).join(own.select(F.col("base").alias("b")).distinct(), "b", "left_semi")

    def put(head: str, rest: str) -> Column:
        first = F.slice(F.coalesce(head, F.array().cast(own.schema[rest].dataType)), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(rest, F.col("h") + 1, F.size(rest))).alias(rest)

    return own.join(heads, own.base == heads.b, "left").select("c", put("b_keys", "keys"), put("b_words", "words"))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each sequence, its node the digest of the keys so far."""
    names = ["id", "parent", "depth", "words", "rank", "n", "conv", "ends"]
    out: list[tuple] = []

    def packed() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        for rank, n, conv, path, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
            state, raw, above = hashlib.sha256(), path.encode(), None
            for d in range(len(words) + 1):
                if d:
                    state.update(raw[(d - 1) * KEY : d * KEY])
                here = state.copy().digest()[:NODE]
                out.append((here, above, d, words[d - 1] if d else 0, rank, n, conv, int(d == len(words))))
                above = here
                if len(out) == ROWS:
                    yield packed()
                    out.clear()
    if out:
        yield packed()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their partition, place and running sums of leaf and saved inside it."""
    at, leaves, saved, part = 0, 0, 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        columns = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
        one = leaves + np.cumsum(columns["leaf"].to_numpy())
        two = saved + np.cumsum(columns["saved"].to_numpy())
        columns |= {"part": pa.array(np.full(n, part, np.int64)), "at": pa.array(np.arange(at + 1, at + n + 1)), "leaves_to": pa.array(one), "saved_to": pa.array(two)}
        yield pa.RecordBatch.from_pydict(columns)
        if n:
            at, leaves, saved = at + n, int(one[-1]), int(two[-1])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, conv) as pieces of text: id, first conv, numbers joined by commas."""
    out: list[tuple] = []
    node, first, run, length = None, None, [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["id", "first", "piece"])

    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i != node or length > PIECE:
                if run:
                    out.append((node, first, ",".join(run)))
                node, first, run, length = i, c, [], 0
            run.append(str(c))
            length += len(run[-1]) + 1
        if len(out) >= 1024:
            yield packed()
            out.clear()
    if run:
        out.append((node, first, ",".join(run)))
    if out:
        yield packed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each id's pieces, which come one after the other."""
    node, state = None, None
    for batch in batches:
        done = []
        for i, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = i, hashlib.sha256()
            state.update(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=pa.schema([("end", pa.binary()), ("digest", pa.string())]))
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["end", "digest"])


def prefix_trie(lists: DataFrame) -> DataFrame:
    """All nodes of the trie of (c, keys, words), in preorder by (start, end).

    id and parent (digests of their keys), depth, conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and start and end: the node's
    place in preorder and that of the last node below it.
    """
    spark = lists.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.array_join("keys", "")
    members = lists.select("c", path.alias("path"), "words").withColumn("end", F.unhex(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 2 * NODE)))
    members = materialize(members, "conversations")

    distinct = members.groupBy("end").agg(F.first(F.struct("path", "words")).alias("x"), F.count(F.lit(1)).alias("n"), F.min("c").alias("conv"))
    ranked = distinct.select("n", "conv", "x.path", "x.words").repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id())
    prefixes = ranked.select("rank", "n", "conv", "path", "words").mapInArrow(_nodes, "id binary, parent binary, depth long, words long, rank long, n long, conv long, ends long")
    nodes = prefixes.groupBy("id", "parent", "depth", "words").agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    nodes = materialize(nodes, "nodes")

    # the digests of the conversations that end at a node
    sorted_ends = members.select("end", "c").repartitionByRange(parts, "end", "c").sortWithinPartitions("end", "c").mapInArrow(_pieces, "id binary, first long, piece string")
    ends = sorted_ends.repartition(parts, "id").sortWithinPartitions("id", "first").select("id", "piece").mapInArrow(_digests, "end binary, digest string")

    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("above")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, nodes.id == children.above, "left").join(ends, nodes.id == ends.end, "left").select(
        "id", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first", "last",
        F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ).withColumn("leaf", (F.col("n_children") == 0).cast("long"))

    in_order = known.repartitionByRange(parts, "first", "depth").sortWithinPartitions("first", "depth")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields)
    local = materialize(in_order.mapInArrow(_summed, f"{fields}, part long, at long, leaves_to long, saved_to long"), "preorder")

    # one row a partition of the sort: as many as shuffle partitions
    sums = ("at", "leaves_to", "saved_to")
    totals = local.groupBy("part").agg(*[F.max(x).alias(x) for x in sums])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in sums])
    placed = local.join(F.broadcast(offsets), "part").select(*known.columns, *[(F.col(x) + F.col(f"{x}_before")).alias(x) for x in sums])

    close = placed.groupBy(F.col("first").alias("rank")).agg(*[F.max(x).alias(f"{x}_end") for x in sums])
    above = nodes.select(F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    spans = placed.join(close, placed["last"] == close["rank"]).join(above, placed["parent"] == above["above"], "left")
    return spans.select(
        "id", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_to_end") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_to_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        "ends_sha256", F.col("at").alias("start"), F.col("at_end").alias("end"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each with its first 0 to 3 turns taken from the first of its twenty."""
    lists = materialize(turn_lists(table(spark, sf_dir, "conversations")), "turn-lists")
    rebuilt = with_heads_of(lists, F.col("c") - F.col("c") % 20, crc("c") % 4)
    return prefix_trie(rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = rf"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, left(sha256(length(role)::VARCHAR || ':' || role || text), {KEY})) AS turns,
    {crc_sql("any_value(c)::VARCHAR")} % 4 AS h FROM t GROUP BY c),
r AS (
  SELECT s.c, list_concat(CASE WHEN s.h > 0 THEN list_slice(coalesce(b.turns, []), 1, s.h) ELSE [] END, list_slice(s.turns, s.h + 1, len(s.turns))) AS turns
  FROM s LEFT JOIN s AS b ON b.c = s.c - s.c % 20),
e AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
p AS (SELECT c, depth, CASE WHEN depth > 0 THEN list_slice(turns, 1, depth) ELSE [] END AS node, turns[depth].text AS text, depth = len(turns) AS ends FROM e),
n AS (
  SELECT node, depth, count(*) AS n_convs, min(c) AS conv_id,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')), 0) AS saved
  FROM p GROUP BY node, depth),
u AS (SELECT *, CASE WHEN depth > 1 THEN list_slice(node, 1, depth - 1) WHEN depth = 1 THEN [] END AS above FROM n),
k AS (
  SELECT u.*, q.conv_id AS parent_conv_id, coalesce(d.n_children, 0) AS n_children FROM u
  LEFT JOIN n AS q ON q.node = u.above
  LEFT JOIN (SELECT above, count(*) AS n_children FROM u WHERE above IS NOT NULL GROUP BY above) AS d ON d.above = u.node),
x AS (SELECT node, saved, n_children, unnest(range(0, depth + 1)) AS up FROM k),
y AS (
  SELECT CASE WHEN up > 0 THEN list_slice(node, 1, up) ELSE [] END AS top, count_if(n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM x GROUP BY top)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM k JOIN y ON y.top = k.node
"""
