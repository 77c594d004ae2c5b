"""Removal of repeated passages by longest previous factors in sparse suffix arrays.

A passage of ``min_len`` bytes that starts at two places is a repeat. Matches
never cross documents and are judged on the input.

1. Anchors. In each stretch of min_len bytes the k-gram with the least hash is
   an anchor, so equal stretches have equal anchors at equal offsets, about one
   in min_len / 2 bytes. An anchor's context is all stretches that hold it.
2. Anchors are grouped by their k-gram. Equal contexts of a group are one, with
   the number of its copies: a context found twice is repeated as a whole, as
   its copies are each other's previous and following factors. An anchor alone
   in its group takes part in no repeat. Counts, least copies and contexts are
   partial aggregates, and rows meet them by joins that adaptive execution can
   split, so a passage in very many documents isn't sorted in one task.
3. What is left are contexts at the edges of repeats: equal k-gram, context of
   their own. Those of a group, and one copy of each repeated context in it, form
   one text. Its suffixes are sorted by their first min_len bytes, ties by
   position, by doubling prefixes. Previous and next smaller positions in that
   order, found by pointer jumping, are where a suffix's longest previous factor
   starts; previous and next larger ones give its longest following factor.
   Factors count as far as they reach min_len, which equal ranks tell.
4. A group with more than ``most`` contexts is split before it meets in a task:
   an equal stretch of min_len bytes that holds the known part reaches at least
   half of what is missing to the left or to the right, so each context goes to
   the group of its longer part on either side, until groups are small or the
   part is the stretch itself.
5. Intervals are gathered per document, merged and cut out.

keep="none" removes every copy; keep="first" keeps the copy that is first by id
and position (ids must then be unique).

Defined cases: null text is empty; texts shorter than min_len stay; repeated
rows are copies of each other; a null id is an id; columns beside id and text
are not read. Documents are told apart by a 64-bit hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

GRAM = 32
#: Bytes of contexts sorted by one task, and groups up to which their ids are broadcast.
TASK_BYTES, FEW_GROUPS = 8_000_000, 250_000
_M = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: bytes, k: int) -> np.ndarray:
    """A hash of the k bytes from each place; k is a power of two."""
    h = _BYTES[np.frombuffer(data, np.uint8)]
    with np.errstate(over="ignore"):
        power, width = _M, 1
        while width < k:
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of width elements."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1]) if done < width else out


def anchors(data: bytes, min_len: int, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and the hashes of their k-grams."""
    if len(data) < min_len:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, k)
    width = min_len - k + 1
    least = _slide(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_slide(padded, width, np.maximum) == h)
    return at, h[at]


def suffix_order(segments: list[bytes], group: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the joined text, ranks, segment of each) of suffixes with min_len bytes left in their segment, in order of these bytes and then of place; equal ranks are equal stretches of one group."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), np.uint8)
    owner = np.repeat(np.arange(len(segments)), sizes)
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(len(text))
    rank = group[owner].astype(np.int64) * 256 + text
    width = 1
    places = np.arange(len(text))
    while width < min_len:
        step = min(width, min_len - width)
        places = np.flatnonzero(left >= width + step)
        first, second = rank[places], rank[places + step]
        pair = first * (int(rank.max(initial=0)) + 1) + second if width == 1 else (first << 32) | second
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(order) else order
        rank = np.zeros(len(text), np.int64)
        rank[places[order]] = new
        width += step
    order = places[np.argsort(rank[places], kind="stable")]
    return order, rank[order], owner[order]


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each element of distinct numbers where the nearest smaller one before it stands, -1 without any; by pointer jumping."""
    at = np.arange(-1, len(x) - 1)
    open_ = np.arange(1, len(x))
    open_ = open_[x[open_ - 1] > x[open_]]
    while len(open_):
        at[open_] = at[at[open_]]  # all between an element and what it points to are larger than it
        open_ = open_[at[open_] >= 0]
        open_ = open_[x[at[open_]] > x[open_]]
    return at


def reaches(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which suffixes, in suffix order, have a longest previous factor of the whole sorted length: their previous or next smaller position has an equal rank."""
    n = len(order)
    before = previous_smaller(order)
    after = n - 1 - previous_smaller(order[::-1])[::-1]
    hit = (before >= 0) & (rank[np.maximum(before, 0)] == rank)
    return hit | ((after < n) & (rank[np.minimum(after, n - 1)] == rank)) if n else hit


def _merged(pdf: pd.DataFrame) -> tuple[list[bytes], pd.DataFrame]:
    """Contexts of one group and document that overlap, made one segment; so each place stands once in a group."""
    pdf = pdf.sort_values(["h", "key", "start"], kind="stable")
    texts: list[bytes] = []
    rows: list[tuple] = []
    own_spans: list[list[tuple[int, int]]] = []
    for h, key, start, data, own in zip(pdf["h"], pdf["key"], pdf["start"], pdf["data"], pdf["own"]):
        if rows and rows[-1][0] == h and rows[-1][1] == key and start <= rows[-1][2] + len(texts[-1]):
            texts[-1] = texts[-1][: start - rows[-1][2]] + data if start + len(data) > rows[-1][2] + len(texts[-1]) else texts[-1]
        else:
            rows.append((h, key, start))
            texts.append(data)
            own_spans.append([])
        own_spans[-1].append(bool(own))
    frame = pd.DataFrame(rows, columns=["h", "key", "start"])
    frame["own"] = [any(x) for x in own_spans]
    return texts, frame


def _runs(key: np.ndarray, start: np.ndarray, min_len: int) -> pd.DataFrame:
    """Intervals of bytes covered by stretches that start at the given places."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    if not len(key):
        return pd.DataFrame({"key": key, "s": start, "e": start})
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + min_len)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(key) - 1]])
    return pd.DataFrame({"key": key[new], "s": start[new], "e": start[last] + min_len})


def _reach(texts: list[bytes], group: np.ndarray) -> np.ndarray:
    """How many first bytes each text shares with any other one of its group, from its neighbours in sorted order."""
    order = sorted(range(len(texts)), key=lambda i: (group[i], texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    width = int(sizes.max(initial=0))
    out = np.zeros(len(texts), np.int64)
    for at in range(0, len(order), 4096):  # one row of overlap, so that all neighbours meet
        part = order[max(0, at - 1) : at + 4096]
        grid = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
        differ = grid[1:] != grid[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(part) - 1, np.int64)
        n = np.array([len(texts[i]) for i in part])
        same = np.minimum(same, np.minimum(n[1:], n[:-1]))
        same[group[part[1:]] != group[part[:-1]]] = 0
        np.maximum.at(out, np.array(part[1:], np.int64), same)
        np.maximum.at(out, np.array(part[:-1], np.int64), same)
    return out


def _trimmed(pdf: pd.DataFrame, min_len: int) -> pd.DataFrame:
    """Contexts cut to what they share with any other of their group on either side of the anchor; those that share too little are left out."""
    pdf = pdf.drop_duplicates(["h", "key", "start", "left"])
    group, _ = pd.factorize(pdf["h"])
    data, left = list(pdf["data"]), pdf["left"].to_numpy()
    after = _reach([d[k:] for d, k in zip(data, left)], group)
    before = _reach([d[:k][::-1] for d, k in zip(data, left)], group)
    keep = before + after >= min_len
    pdf = pdf[keep].copy()
    pdf["data"] = [d[k - b : k + a] for d, k, b, a, ok in zip(data, left, before, after, keep) if ok]
    pdf["start"] = (pdf["start"].to_numpy() + left[keep] - before[keep]).astype(np.int64)
    return pdf


def _repeats(pdf: pd.DataFrame, min_len: int, keep: str) -> pd.DataFrame:
    """Intervals (key, s, e) of the repeats among contexts (h, key, start, data, own)."""
    out = []
    pdf = pdf.sort_values("h", kind="stable")
    codes, _ = pd.factorize(pdf["h"])
    total = pdf["data"].map(len).cumsum().to_numpy()
    cut = [0]
    for i in range(1, len(pdf)):  # whole groups, about four megabytes at a time
        if codes[i] != codes[i - 1] and total[i] - total[cut[-1]] > 4_000_000:
            cut.append(i)
    for a, b in zip(cut, [*cut[1:], len(pdf)]):
        part = _trimmed(pdf.iloc[a:b], min_len)
        if not len(part):
            continue
        texts, frame = _merged(part)
        group, _ = pd.factorize(frame["h"])
        # the frame is in order of group, key and start, so places in the joined text are in order of position
        order, rank, segment = suffix_order(texts, group, min_len)
        sizes = np.array([len(t) for t in texts])
        offset = order - (np.cumsum(sizes) - sizes)[segment]
        key, place = frame["key"].to_numpy()[segment], frame["start"].to_numpy()[segment] + offset
        hit = reaches(order, rank)
        if keep == "none":
            hit |= reaches(-order, rank)  # the following factor: positions the other way round
        hit &= frame["own"].to_numpy()[segment]
        out.append(_runs(key[hit], place[hit], min_len))
    return pd.concat(out) if out else pd.DataFrame({"key": [], "s": [], "e": []}).astype("int64")


def repeated_intervals(docs: DataFrame, min_len: int, keep: str, most: int) -> DataFrame:
    """(key, spans: array of (s, e)) of documents (key, doc_id, text) with repeats; ends may lie beyond the text."""
    back = min_len - GRAM

    def runs_of(data: bytes) -> list[tuple[int, int, int, int, int]]:
        """(gram hash, context hash, first anchor, last anchor, number) of anchors; equal contexts whose stretches touch are one row."""
        at, h = anchors(data, min_len)
        rows: list[list[int]] = []
        last: dict[tuple[int, int], list[int]] = {}
        for a, g in zip(at.tolist(), h.view(np.int64).tolist()):
            c = xxhash.xxh64_intdigest(data[max(0, a - back) : a + min_len], min(a, back)) - 2**63
            row = last.get((g, c))
            if keep == "none" and row is not None and a - back <= row[3] + min_len:
                row[3], row[4] = a, row[4] + 1
            else:
                last[g, c] = row = [g, c, a, a, 1]
                rows.append(row)
        return rows

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "key", "a", "b", "w"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                keys = part.column(0).to_pylist()
                copies: dict[int, int] = {}
                for key in keys:
                    copies[key] = copies.get(key, 0) + 1
                rows = []
                for key, value in zip(keys, part.column(1)):
                    n = copies.pop(key, 0) if keep == "none" else 1
                    if n:  # copies in a batch count, but send one row
                        rows.extend((h, c, key, a, b, w * n) for h, c, a, b, w in runs_of(value.as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    members = docs.select("key", "text").mapInArrow(find, "h long, c long, key long, a int, b int, w long")
    # sides of a join are written, as adaptive execution splits a hot key only between two plain exchanges
    grams = members.groupBy("h").agg(F.sum("w").alias("all"), (F.min("c") < F.max("c")).alias("mixed")).where("all > 1").select("h", "mixed")
    shared = materialize(members.join(materialize(grams, "grams"), "h"), "anchors")
    of_context = shared.groupBy("h", "c").agg(F.sum("w").alias("n"), F.min(F.struct("key", "a")).alias("first"))
    is_first = F.struct("key", "a") == F.col("first")
    whole = ~is_first if keep == "first" else F.col("n") > 1
    flagged = shared.join(materialize(of_context, "counted"), ["h", "c"]).select("h", "key", "a", "b", whole.alias("whole"), (is_first & F.col("mixed")).alias("wanted")).where("whole OR wanted")
    flagged = materialize(flagged, "flagged")

    edges = flagged.where("wanted").groupBy("key").agg(F.collect_set(F.struct("h", "a", (~F.col("whole")).alias("own"))).alias("list"))
    firsts = docs.select("key", "doc_id").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    listed = edges.join(firsts, "key")
    texts = docs.select("key", "doc_id", "text").join(listed, "key").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("key", "text", "list")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                part = batch.slice(i, 50)
                rows = []
                for key, text, wanted_ in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                    data = text.as_buffer().to_pybytes()
                    for x in wanted_:
                        start = max(0, x["a"] - back)
                        rows.append((x["h"], key, start, data[start : x["a"] + min_len], x["a"] - start, x["own"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.bool_()))], names=["h", "key", "start", "data", "left", "own"])

    contexts = texts.mapInArrow(cut, "h long, key long, start int, data binary, left int, own boolean")
    contexts = materialize(contexts, "contexts")
    small, stretches = _split(contexts, min_len, keep, most)
    small = materialize(small, "groups")
    size = small.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(1, -(-size // TASK_BYTES))
    found = small.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).applyInPandas(lambda pdf: _repeats(pdf, min_len, keep), "key long, s int, e int")

    full = flagged.where("whole").select("key", F.greatest(F.lit(0), F.col("a") - back).alias("s"), (F.col("b") + min_len).alias("e"))
    return full.unionByName(found).unionByName(stretches).groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _split(contexts: DataFrame, min_len: int, keep: str, most: int) -> tuple[DataFrame, DataFrame]:
    """contexts in groups ``h`` of at most ``most``, each context in every group in which it may meet an equal stretch; and (key, s, e) of stretches that were split down to their whole length."""
    current = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(GRAM)})
    done: DataFrame | None = None
    ends = contexts.select("key", F.col("start").alias("s"), F.lit(0).alias("e")).limit(0)
    while True:
        counts = current.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", F.col("start") + F.col("left") + F.col("lo"))).alias("first"))
        large = materialize(counts.where(F.col("n") > most), "large")  # at most one group for each ``most`` rows
        if large.isEmpty():
            done = current if done is None else done.unionByName(current)
            return done.drop("lo", "hi"), ends
        rest = current.join(large.select("h"), "h", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        big = current.join(F.broadcast(large) if large.count() <= FEW_GROUPS else large, "h")
        whole = F.col("hi") - F.col("lo") >= min_len
        place = F.col("start") + F.col("left") + F.col("lo")
        hit = F.col("own") & (F.struct("key", place) != F.col("first") if keep == "first" else F.lit(True))
        ends = ends.unionByName(big.where(whole & hit).select("key", place.cast("int").alias("s"), (place + min_len).cast("int").alias("e")))
        half = F.ceil((F.lit(min_len) - F.col("hi") + F.col("lo")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo").alias("lo"), (F.col("hi") + half).alias("hi")), F.struct((F.col("lo") - half).alias("lo"), F.col("hi").alias("hi")))
        parts = F.filter(parts, lambda x: (F.col("left") + x["lo"] >= 0) & (F.col("left") + x["hi"] <= F.length("data")))
        longer = big.where(~whole).select("h", "key", "start", "data", "left", "own", F.explode(parts).alias("p"))
        known = F.substring("data", F.col("left") + F.col("p.lo") + 1, F.col("p.hi") - F.col("p.lo"))
        current = materialize(longer.select(F.xxhash64("h", "p.lo", "p.hi", known).alias("h"), "key", "start", "data", "left", "own", "p.lo", "p.hi"), "split")


def _cut_out(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    if not spans:
        return data, 0
    out, at, runs = [], 0, 0
    reached = -1
    for s, e in sorted((x["s"], min(x["e"], len(data))) for x in spans):
        if s > reached:
            runs += 1
            out.append(data[at:s])
        reached = max(reached, e)
        at = reached
    out.append(data[at:])
    return b"".join(out), runs


def dedup_passages(docs: DataFrame, min_len: int = 200, keep: str = "none", most: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary, kept_sha256) of every row."""
    if keep not in ("none", "first") or min_len < 2 * GRAM:
        raise ValueError("keep is 'none' or 'first', and min_len 64 at least")
    text: Column = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids = F.col(f"`{id_col}`").cast("long")
    base = docs.select(ids.alias("doc_id"), text.alias("text"))
    base = base.withColumn("key", F.col("doc_id") if keep == "first" else F.xxhash64("text"))
    spans = repeated_intervals(base, min_len, keep, most)
    joined = base.select("key", "doc_id", "text").join(spans, "key", "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                sizes, kept, runs = [], [], []
                for value, found in zip(part.column(1), part.column(2).to_pylist()):
                    data = value.as_buffer().to_pybytes()
                    rest, n = _cut_out(data, found)
                    sizes.append(len(data))
                    kept.append(rest)
                    runs.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array([a - len(b) for a, b in zip(sizes, kept)], pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(b).hexdigest() for b in kept], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op3_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses by removing all 200-byte passages that start elsewhere too."""
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
