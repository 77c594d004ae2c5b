"""Exact n-gram Jaccard join by parity sketches.

A document is the set of hashes of its word n-grams. Two sets of sizes a and b
have a Jaccard similarity of at least num/den exactly when they differ in at
most D(a, b) = (a + b) * (den - num) / (den + num) elements. A parity sketch
has one bit per hash value, flipped by each element, so the Hamming distance of
two sketches is at most the difference of the sets. The bits are dealt into
D + 1 parts and some more; of two linked documents at least one part agrees
whole. Each part is kept as the XOR of its elements' hashes, a hash of its bits.

Sizes are cut into bands. A document sketches for its own band, and for the
next one where it is large enough to be linked into it; D is that of the band's
largest pair. Parts with few elements are left out where enough others agree
without them, parts without any always, as their keys would say nothing: a set
with elements in too few parts is dealt again with another hash. So the
candidates hold every linked pair: nothing is sampled or capped.

A set that shares fewer keys with others than any link of it takes is left out:
of two linked sets so many parts agree that some of them are always sent.
Candidates are verified on the sets themselves, and never as all pairs of a
group: first each member of a group with the group's most central member; then,
where a group still spans several components, blocks of at most BLOCK members
are compared inside a task by short dense parity sketches, and only pairs whose
Hamming distance allows a link leave it. Documents with equal sets are one set.

Defined cases: null and empty texts have no n-grams and are linked with
nothing; texts with fewer words than n are one n-gram; repeated rows are linked
to each other; columns beside id and text are kept or not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, spare, table
from .components import connected_components

BAND, BLOCK, THIN = 1.3, 1024, 2
#: About so many members of blocks are compared in one task.
TASK_ROWS = 8192
#: Up to so many pairs, hence twice so many ids of 16 bytes, the ids are broadcast.
FEW_PAIRS = 250_000
SHORT = 8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's distinct word n-grams; words are split at ASCII white space, A-Z in lower case."""

    def __init__(self, n: int):
        self.n = n
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.seen) > 200_000:
            self.seen.clear()
        seen, digest = self.seen, xxhash.xxh64_intdigest
        h = np.fromiter((seen.get(w) or seen.setdefault(w, digest(w)) for w in words), np.uint64, len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            s = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                s = _mix(s) * _M1 + h[k : len(h) - n + 1 + k]
            return np.unique(_mix(s + np.uint64(n)))


def band_starts(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def _levels(n: int, num: int, den: int, starts: list[int]) -> list[int]:
    """Bands for which a set of n elements sketches."""
    own = bisect_right(starts, n) - 1
    return [own] if n * den < starts[own + 1] * num else [own, own + 1]


def _most_different(level: int, num: int, den: int, starts: list[int]) -> int:
    """Elements in which two linked sets of a band differ at most."""
    return 2 * (starts[level + 1] - 1) * (den - num) // (den + num)


def _dealt(s: np.ndarray, d: int, salt: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(parts, part of each element, parts that are sent, parts with elements) of one dealing."""
    parts = d + 1 + 2 + d // 4
    h = s if salt == 0 else _mix(s + np.uint64(salt) * _M3)
    part = ((h >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)
    count = np.bincount(part, minlength=parts)
    held = np.flatnonzero(count)
    full = np.flatnonzero(count >= THIN)
    return parts, part, full if len(full) > d else held, held


def sketch_keys(s: np.ndarray, num: int, den: int, starts: list[int]) -> np.ndarray:
    """One key for each part of the set's sketches that others could agree with; no key is of a part without elements.

    Two linked sets disagree in d parts at most, so a set with elements in more
    parts agrees with any link of it in one of those. A set whose elements
    lie in fewer is dealt again with another salt, until they don't, and sends the keys
    of all its dealings; of two sets the one that is done first is done in a dealing of both.
    """
    if not len(s):
        return np.zeros(0, np.uint64)
    made = [np.zeros(0, np.uint64)]
    for level in _levels(len(s), num, den, starts):
        d = _most_different(level, num, den, starts)
        if not d:
            continue  # only equal sets are linked
        salt, held = 0, np.zeros(0)
        while len(held) <= d:
            parts, part, sent, held = _dealt(s, d, salt)
            order = np.argsort(part, kind="stable")
            run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(s[order])])
            end = np.cumsum(np.bincount(part, minlength=parts))
            word = run[end] ^ run[np.concatenate([[0], end[:-1]])]
            with np.errstate(over="ignore"):
                made.append(_mix(word[sent] + _mix(sent.astype(np.uint64) * _M1 + np.uint64(level) + np.uint64(salt) * _M2)))
            salt += 1
    return np.concatenate(made)


def keys_needed(s: np.ndarray, num: int, den: int, starts: list[int]) -> int:
    """The least number of keys that a set shares with any set it is linked to.

    Of the parts that it sends as many disagree as the two sets differ in elements at most.
    A part that agrees holds the same elements on both sides, so a thin one is
    thin on both, and a set that leaves thin ones out has more than d others.
    """
    needed = []
    for level in _levels(len(s), num, den, starts) if len(s) else ():
        d = _most_different(level, num, den, starts)
        if not d:
            continue
        largest = min(starts[level + 1] - 1, len(s) * den // num)
        differ = min(d, (len(s) + largest) * (den - num) // (den + num))
        _, part, sent, held = _dealt(s, d, 0)
        if len(held) <= d:
            needed.append(1)
        elif len(sent) < len(held):
            needed.append(len(sent) - differ)
        else:
            needed.append(min(len(held), d + 1) - differ)
    return min(needed, default=0)


def dense_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements' hashes in a power of two of longs, two bits an element at least; a wide sketch folds into a narrow one by XOR of its halves."""
    longs = max(4, 1 << (max(1, len(s) // 32) - 1).bit_length())
    out = np.zeros(longs, np.uint64)
    at = _mix(s ^ _M3)
    np.bitwise_xor.at(out, (at % np.uint64(longs)).astype(np.int64), np.uint64(1) << (at >> np.uint64(58)))
    return out


def _set_id(s: np.ndarray) -> int | None:
    """A hash of the set as a whole, null for the empty one."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return int((_mix(np.bitwise_xor.reduce(s) + np.uint64(len(s))) ^ np.add.reduce(_mix(s ^ _M1))).astype(np.int64))


def _folded(sketch: np.ndarray, width: int) -> np.ndarray:
    while len(sketch) > width:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def set_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, sid, n, need, dense, short) of documents (doc_id, text): the set's id, its size, the keys it shares with any link, its dense sketch and that sketch folded to SHORT longs.

    Within a batch only the first of equal sets carries sketches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, starts = Shingler(n), band_starts()
        longs = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sids, sizes, needs, dense, short, seen = [], [], [], [], [], set()
                for text in part.column(1):
                    s = shingle(text.as_py())
                    sid = _set_id(s)
                    new = sid is not None and sid not in seen
                    seen.add(sid)
                    sketch = dense_sketch(s) if new else None
                    sids.append(sid)
                    sizes.append(len(s))
                    needs.append(keys_needed(s, num, den, starts) if new else None)
                    dense.append(sketch.view(np.int64) if new else None)
                    short.append(_folded(sketch, SHORT).view(np.int64) if new else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(needs, pa.int32()), pa.array(dense, longs), pa.array(short, longs)], names=["doc_id", "sid", "n", "need", "dense", "short"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sid long, n long, need int, dense array<long>, short array<long>")


def key_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, sid): the keys of each document's set; of equal sets in a task only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, starts = Shingler(n), band_starts()
        seen: set[int] = set()  # of a task's copies one sends its keys
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, sids = [], []
                for text in batch.column(0).slice(at, 500):
                    s = shingle(text.as_py())
                    sid = _set_id(s)
                    if sid is not None and sid not in seen:
                        seen.add(sid)
                        k = sketch_keys(s, num, den, starts).view(np.int64)
                        keys.append(k)
                        sids.append(np.full(len(k), sid))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sids))], names=["key", "sid"])

    return docs.select("text").mapInArrow(run, "key long, sid long")


def _bound(a: Column, b: Column, num: int, den: int) -> Column:
    return F.floor((a + b) * (den - num) / (den + num))


def _may_link(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets that sizes and dense sketches don't rule out."""
    out = pairs
    for side in "ab":
        out = out.join(sets.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}")), side)
    na, nb = F.col("na"), F.col("nb")
    out = out.where(F.least(na, nb) * den >= F.greatest(na, nb) * num)

    def folded(x: str, y: str) -> Column:  # linked sizes differ by less than two, so one fold is enough
        w = F.size(y)
        return F.when(F.size(x) > w, F.zip_with(F.slice(x, F.lit(1), w), F.slice(x, w + 1, w), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    for sketch in ("short", "dense"):  # the short ones rule out most pairs
        for side in "ab":
            out = out.join(sets.select(F.col("sid").alias(side), F.col(sketch).alias(f"d{side}")), side)
        far = F.aggregate(F.zip_with(folded("da", "db"), folded("db", "da"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        out = out.where(far <= _bound(na, nb, num, den)).select("a", "b", "na", "nb")
    return out.select("a", "b")


def _verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets that are linked, checked on their n-grams."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps, "sid").select("sid", "rep")
    # few ids travel to the texts, so that only the texts needed are shuffled; many are shuffled with them
    held = texts.join(F.broadcast(ids) if pairs.count() <= FEW_PAIRS else ids, F.col("rep") == F.col("t_id")).select("sid", "text")
    both = pairs.join(held.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                keep = []
                for i in range(len(a)):
                    for sid, col in ((a[i], 2), (b[i], 3)):
                        if sid not in last:
                            if len(last) > 400:
                                last.clear()
                            last[sid] = shingle(part.column(col)[i].as_py())
                    x, y = last.get(a[i]), last.get(b[i])
                    x = shingle(part.column(2)[i].as_py()) if x is None else x
                    both_ = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both_ >= num * (len(x) + len(y) - both_):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _within_block(sid: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, dense: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components of a block that sizes and dense sketches allow."""
    width = min(len(d) for d in dense)
    sketch = np.empty((len(dense), width), np.uint64)
    for i, d in enumerate(dense):
        while len(d) > width:
            d = d[: len(d) // 2] ^ d[len(d) // 2 :]
        sketch[i] = d
    a, b = [], []
    for i in range(len(sid) - 1):
        low, high = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
        fits = (low * den >= high * num) & (label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))
        rest = i + 1 + np.flatnonzero(fits)
        far = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1)
        rest = rest[far <= (n[rest] + n[i]) * (den - num) // (den + num)]
        a.append(np.full(len(rest), sid[i]))
        b.append(sid[rest])
    return np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)


def _blocks(members: DataFrame, rows: int, num: int, den: int) -> DataFrame:
    """Candidate pairs of groups (grp, sid, n, dense, label, size) with so many rows of blocks, each pair of blocks of a group in one task.

    A pair of blocks has at most 2 * BLOCK members; tasks take so many of them
    as hold about TASK_ROWS members.
    """
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("m", count).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int"))
    # a block meets each block of the group once: (i, j) with i <= j; side 2 is a block by itself
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("own") == F.col("i"), 0).otherwise(1))
    dealt = dealt.withColumn("block", F.xxhash64("grp", "i", "j")).select("block", "sid", "n", "dense", "label", "side")
    buckets = max(1, -(-rows // TASK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        block, sid, n, label, side = (pdf[c].to_numpy() for c in ("block", "sid", "n", "label", "side"))
        dense = [np.asarray(d).view(np.uint64) for d in pdf["dense"]]
        cut = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else [0]
        found = [_within_block(sid[x:y], n[x:y], label[x:y], side[x:y], dense[x:y], num, den) for x, y in zip(cut, cut[1:])]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return dealt.groupBy(F.pmod("block", F.lit(buckets)).alias("bucket")).applyInPandas(run, "a long, b long").distinct()


def link_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the least id reachable by links.

    The similarity num / den must be 1 / BAND at least, so that linked sets lie in neighbouring bands.
    """
    if not den <= num * BAND <= den * BAND:
        raise ValueError(f"a similarity from {1 / BAND:.2f} to 1 is needed")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = base.withColumnRenamed("doc_id", "t_id")
    made = materialize(set_table(base, n, num, den), "sets")
    reps = made.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    # keys that two sets share; copies needn't send theirs again if they are few enough to be told
    copies = materialize(made.join(reps, "sid").where("doc_id <> rep").select("doc_id").distinct().join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "copies")
    alone = base.join(F.broadcast(copies), "doc_id", "left_anti") if copies.count() <= 2 * FEW_PAIRS else base
    by_key = Window.partitionBy("key")
    keyed = key_table(alone, n, num, den)
    shared = keyed.withColumns({"lo": F.min("sid").over(by_key), "hi": F.max("sid").over(by_key), "size": F.count(F.lit(1)).over(by_key)})
    shared = materialize(shared.where("lo <> hi").select("key", "sid", "size").distinct(), "shared")
    # sets with fewer shared keys than a link takes have no link
    counted = shared.groupBy("sid").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("size").alias("weight"))
    known = made.where("dense IS NOT NULL").groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "need", "dense", "short")])
    sets = materialize(counted.join(known, "sid").where("n_keys >= need"), "shared-sets")
    # each member with the most central member of its group; one shuffle, as joining aggregates back would move the members twice
    central = by_key.orderBy(F.desc("weight"), "sid")
    grouped = shared.select("key", "sid").join(_few(sets.select("sid", "weight")), "sid")
    grouped = grouped.withColumns({"pivot": F.first("sid").over(central), "lo": F.min("sid").over(by_key), "hi": F.max("sid").over(by_key), "size": F.count(F.lit(1)).over(by_key)})
    grouped = materialize(grouped.where("lo <> hi").select("key", "sid", "pivot", "size"), "grouped")
    stars = grouped.where("sid <> pivot").select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()
    links = materialize(_verify(_may_link(stars, sets, num, den), reps, texts, n, num, den), "links")
    labels = connected_components(links)
    # groups that span components; the pivot has been compared with all
    rest = grouped.where("size > 2 AND sid <> pivot").join(_few(labels.withColumnRenamed("node", "sid")), "sid", "left").select("key", "sid", F.coalesce("label", "sid").alias("label"))
    spanning = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("sid").alias("grp")).where("low <> high").select("key", "grp")
    spanning = materialize(spanning, "spanning")
    # a cluster shares many keys: groups of one least member are one group, so that a pair is compared once and not once per key
    members = materialize(rest.join(spanning, "key").select("grp", "sid", "label").distinct(), "members")
    several = materialize(members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "several")
    rows = several.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()[0] or 0
    members = members.join(several, "grp").join(sets.select("sid", "n", "dense"), "sid")
    rest = materialize(_blocks(members, rows, num, den), "candidates")
    more = materialize(_verify(rest, reps, texts, n, num, den), "links")
    labels = connected_components(links.unionByName(more))
    # least document of each component
    sets_of = reps.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = sets_of.groupBy("label").agg(F.min("rep").alias("component_id"))
    component = sets_of.join(least, "label").select("sid", "component_id")
    return made.join(component, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _few(df: DataFrame) -> DataFrame:
    """A written table of ids with a broadcast hint if it is small, counted first; as it is otherwise."""
    return F.broadcast(df) if df.count() <= 2 * FEW_PAIRS else df


def keep_one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are linked to a row with a smaller id; rows with equal ids share one fate, rows without an id stay."""
    linked = link_documents(docs, n, num, den, id_col, text_col)
    name = spare(docs, "id")
    first = linked.where("n_shingles = 0 OR doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, F.col(f"`{id_col}`") == F.col(name), "left_semi")
    return kept.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked from a Jaccard similarity of 85 percent of their 4-word shingles."""
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, 100)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN c USING (g)),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM f AS a JOIN f AS b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE 100 * i >= 85 * (na + nb - i) UNION SELECT y, x FROM p WHERE 100 * i >= 85 * (na + nb - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(sh)
"""
