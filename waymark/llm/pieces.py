"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

The lattice of a text has an edge for every vocabulary piece at every place,
and a byte edge where a character is no piece. Forward filtering sums the
weights of all segmentations up to each place; backward sampling draws a
segmentation from the end, each edge with its share of the sum. Draws come
from a hash of (seed, row key, chunk, step), so a row's segmentation depends on
its key and text alone, wherever and however often it is computed.

The vocabulary is a byte-fallback model file; it is read on the driver, sent
to executors and not trained. Its scores are negative merge ranks and no
probabilities, so a piece of score s gets the weight 1 / (3 - s), raised to
``sharpness``. As no piece holds a space after another character, the lattice
falls apart at each space that follows one: chunks are filtered once per
distinct chunk of a slice, and all chunks are sampled together. Long chunks
(texts without spaces) are filtered by themselves, with sums scaled by powers
of two, which changes no digit: both ways give the same draws.

Encoding adds one space in front, decoding takes it away, and the space
character of the vocabulary stands for a real space only (its own character is
spelled in bytes): decoding gives back the text exactly.

Defined cases: null text has null ids; the empty text has none; equal keys and
texts get equal ids; a null key counts as a key of its own; texts of any length
are encoded whole, in slices of bounded size; columns beside key and text are
kept if asked for.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare, table

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CHUNK = re.compile(" *[^ ]+| +")
BOUNDARY = re.compile("[^ ](?= )")
#: Characters of a chunk that are filtered with others, if no sum can get too small; longer ones go one by one.
LONG = 48
#: Sums under 2^-SCALE are scaled up by 2^SCALE.
SCALE = 400
#: Characters of text filtered and sampled together.
SLICE = 1_000_000
BYTE_WEIGHT = 1e-6
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 19


class Vocabulary:
    """Pieces, their weights, and a hash table of all their prefixes."""

    def __init__(self, model_bytes: bytes, sharpness: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        n = model.get_piece_size()
        self.size = n
        self.bytes: list[bytes] = [b""] * n
        self.ids: dict[str, int] = {}
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece holds a space after another character")
                text = piece.replace(SPACE, " ")
                self.ids[text], self.bytes[i] = i, text.encode()
        self.weight = np.zeros(n)
        for i in self.ids.values():
            self.weight[i] = max(3.0, 3.0 - model.get_score(i)) ** -sharpness
        self.weight /= self.weight.sum()
        least = min([BYTE_WEIGHT, *(self.weight[i] for t, i in self.ids.items() if len(t) == 1)])
        self.short = max(1, min(LONG, int(-250 / np.log10(least))))
        self.longest = max(map(len, self.ids), default=1)
        table: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for text, i in self.ids.items():
                h = np.uint64(0)
                for k, c in enumerate(text):
                    h = h * BASE + np.uint64(ord(c) + 1)
                    if k == len(text) - 1:
                        table[int(h)] = i
                    else:
                        table.setdefault(int(h), -1)
        self.keys = np.zeros(1 << SLOTS, np.uint64)
        self.values = np.full(1 << SLOTS, -2, np.int32)  # -2: free, -1: a prefix only
        self.probes = 1
        for h, i in table.items():
            slot, k = int(self.slot(np.uint64(h))), 1
            while self.values[slot] != -2:
                slot, k = (slot + 1) % (1 << SLOTS), k + 1
            self.keys[slot], self.values[slot] = h, i
            self.probes = max(self.probes, k)

    @staticmethod
    def slot(h):
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SLOTS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a prefix of pieces, -2 for neither."""
        slot = self.slot(h).astype(np.int64)
        out = self.values[slot]
        wrong = np.flatnonzero((out != -2) & (self.keys[slot] != h))
        for _ in range(self.probes - 1):
            if not len(wrong):
                return out
            slot[wrong] = (slot[wrong] + 1) & ((1 << SLOTS) - 1)
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(out[wrong] != -2) & (self.keys[slot[wrong]] != h[wrong])]
        out[wrong] = -2
        return out


@functools.lru_cache(maxsize=2)
def vocabulary_of(model_bytes: bytes, sharpness: float = 1.0) -> Vocabulary:
    return Vocabulary(model_bytes, sharpness)


def vocabulary(path: str, sharpness: float = 1.0) -> Vocabulary:
    return vocabulary_of(Path(path).read_bytes(), sharpness)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _draws(state: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for (row, chunk) states."""
    with np.errstate(over="ignore"):
        return (_mix(state + BASE * np.uint64(step + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """Filtered edges of distinct chunks; states are characters, edges end in them, the shorter first."""

    def __init__(self, v: Vocabulary, chunks: Sequence[str]):
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        chars = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(chars)
        place = np.arange(n) - np.repeat(self.first[:-1], sizes)
        room = np.repeat(sizes, sizes) - place  # characters from here to the chunk's end
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            for length in range(1, v.longest + 1):
                h = h * BASE + chars[alive + (length - 1)] + np.uint64(1)
                got = v.find(h)
                if length == 1:
                    byte = np.flatnonzero(got < 0)
                    piece = got.copy()
                    piece[byte] = -1 - chars[byte].astype(np.int64)  # spelled in bytes
                    edges.append((alive, piece.astype(np.int32)))
                else:
                    hit = got >= 0
                    edges.append((alive[hit], got[hit]))
                on = (got >= -1) & (room[alive] > length)
                alive, h = alive[on], h[on]
                if not len(alive):
                    break
        ends = np.zeros(n + 1, np.int64)
        for k, (start, _) in enumerate(edges):
            ends[1 + start + k] += 1
        self.offset = np.cumsum(ends)
        total = int(self.offset[-1])
        self.piece, self.length = np.empty(total, np.int32), np.empty(total, np.int64)
        start_of, weight, filled = np.empty(total, np.int64), np.empty(total), np.zeros(n, np.int64)
        for k, (start, piece) in enumerate(edges):
            end = start + k
            at = self.offset[end] + filled[end]
            filled[end] += 1
            self.piece[at], self.length[at], start_of[at] = piece, k + 1, start
            weight[at] = np.where(piece >= 0, v.weight[np.maximum(piece, 0)], BYTE_WEIGHT)
        end_of = start_of + self.length - 1
        # alpha of a character is the sum over segmentations of its chunk up to and with it, times 2^shift
        if len(chunks) == 1 and n > v.short:
            alpha, shift = _sums_of_long(n, start_of, end_of, weight, v.longest)
        else:
            alpha, shift = _sums_side_by_side(n, place, start_of, end_of, weight), np.zeros(n, np.int64)
        opens = place[start_of] == 0
        before = np.where(opens, 0, start_of - 1)
        mass = np.where(opens, 1.0, alpha[before])
        if shift.any():
            mass = np.ldexp(mass, np.where(opens, shift[end_of], shift[end_of] - shift[before]))
        share = mass * weight / alpha[end_of]
        # running sums inside each state, so that nothing depends on other chunks
        at, last = self.offset[:-1] + 1, self.offset[1:]
        while len(at):
            on = at < last
            at, last = at[on], last[on]
            share[at] += share[at - 1]
            at = at + 1
        self.upto = share

    def sample(self, chunk: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all given chunks, in order, and the number of each."""
        m = len(chunk)
        at = self.first[chunk + 1] - 1
        low = self.first[chunk]
        who = np.arange(m)
        counts = np.zeros(m, np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(who):
            u = _draws(state, step)
            edge = self.offset[at]
            last = self.offset[at + 1] - 1
            more = np.flatnonzero((self.upto[edge] <= u) & (edge < last))
            while len(more):
                edge[more] += 1
                more = more[(self.upto[edge[more]] <= u[more]) & (edge[more] < last[more])]
            drawn.append((who, self.piece[edge]))
            counts[who] += 1
            at = at - self.length[edge]
            on = at >= low
            who, at, low, state = who[on], at[on], low[on], state[on]
            step += 1
        end = np.cumsum(counts)
        out = np.empty(int(end[-1]) if m else 0, np.int32)
        for k, (w, p) in enumerate(drawn):
            out[end[w] - 1 - k] = p
        return out, counts

    def sample_only(self, state: np.uint64) -> np.ndarray:
        """The same pieces of the only chunk, drawn one by one."""
        with np.errstate(over="ignore"):
            draws = _draws(state + BASE * np.arange(self.first[-1], dtype=np.uint64), 0).tolist()
        offset, upto, length = self.offset.tolist(), self.upto.tolist(), self.length.tolist()
        out, at = [], int(self.first[-1]) - 1
        while at >= 0:
            edge, last, u = offset[at], offset[at + 1] - 1, draws[len(out)]
            while edge < last and upto[edge] <= u:
                edge += 1
            out.append(edge)
            at -= length[edge]
        return self.piece[np.array(out[::-1], np.int64)]


def _sums_side_by_side(n: int, place: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of chunks that are short enough for no sum to get too small."""
    alpha = np.zeros(n)
    from_ = place[start].astype(np.uint8)  # short chunks, and short numbers sort faster
    order = np.argsort(from_, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(from_, minlength=int(place.max(initial=-1)) + 1))])
    for p in range(len(cuts) - 1):
        e = order[cuts[p] : cuts[p + 1]]
        alpha[end[e]] += weight[e] if p == 0 else alpha[start[e] - 1] * weight[e]  # no two edges of one place have one end
    return alpha


def _sums_of_long(n: int, start: np.ndarray, end: np.ndarray, weight: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of one chunk of any length, in the same order, scaled by powers of two where sums get small."""
    order = np.lexsort((end, start))
    alpha, shift, s, a, last = [0.0] * n, [0] * n, 0, 1.0, 0
    for p, e, w in zip(start[order].tolist(), end[order].tolist(), weight[order].tolist()):
        if p != last:
            last, a = p, alpha[p - 1]
            if a < 2.0**-SCALE:
                for j in range(p - 1, min(n, p + longest)):
                    alpha[j] *= 2.0**SCALE
                s, a = s + SCALE, alpha[p - 1]
            shift[p - 1] = s
        alpha[e] += a * w
    shift[n - 1] = s
    return np.array(alpha), np.array(shift, np.int64)


def _salt(seed: int, key: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{'' if key is None else '=' + key}".encode(), digest_size=8).digest(), "little")


def encode_slice(v: Vocabulary, keys: Sequence[str | None], texts: Sequence[str], seed: int = 0) -> list[np.ndarray]:
    """Ids of each text."""
    bodies = [" " + t if t else "" for t in texts]
    return [ids for ids, _ in _encode(v, [_salt(seed, k) for k in keys], bodies, [0] * len(bodies))]


def encode_long(v: Vocabulary, key: str | None, text: str, seed: int = 0, most: int = SLICE) -> np.ndarray:
    """The same ids for one text of any length, in parts that end before a space that follows another character."""
    body, at, first, out, salt = " " + text, 0, 0, [], _salt(seed, key)
    while at < len(body):
        end = BOUNDARY.search(body, at + most)
        cut = end.start() + 1 if end else len(body)
        (ids, n), = _encode(v, [salt], [body[at:cut]], [first])
        out.append(ids)
        at, first = cut, first + n
    return np.concatenate(out)


def _encode(v: Vocabulary, salts: Sequence[int], bodies: Sequence[str], firsts: Sequence[int]) -> list[tuple[np.ndarray, int]]:
    """Ids and number of chunks of each body; firsts: numbers of their first chunks."""
    numbers: dict[str, int] = {}
    which: list[int] = []
    per_text = []
    number = numbers.setdefault
    for t in bodies:
        found = CHUNK.findall(t)
        which.extend([number(c, len(numbers)) for c in found])
        per_text.append(len(found))
    chunk, per = np.array(which, np.int64), np.array(per_text, np.int64)
    begin = np.concatenate([[0], np.cumsum(per)])
    index = (np.arange(len(chunk)) - np.repeat(begin[:-1] - np.array(firsts, np.int64), per)).astype(np.uint64)
    with np.errstate(over="ignore"):
        state = _mix(np.repeat(np.array(salts, np.uint64), per) + index * np.uint64(0xD1342543DE82EF95))
    distinct = list(numbers)
    short = np.fromiter((len(c) <= v.short for c in distinct), bool, len(distinct))
    renumber = np.cumsum(short) - 1
    lattice = Lattice(v, [c for c in distinct if len(c) <= v.short])
    is_short = short[chunk] if len(chunk) else np.zeros(0, bool)
    pieces, counts = lattice.sample(renumber[chunk[is_short]] if len(chunk) else chunk, state[is_short])
    if not is_short.all():
        pieces, counts = _with_long(v, distinct, chunk, state, is_short, pieces, counts)
    cut = np.concatenate([[0], np.cumsum(counts)])[begin]
    ids, ends = _spell(v, pieces)
    cut = np.concatenate([[0], ends])[cut]
    return [(ids[cut[i] : cut[i + 1]], int(per[i])) for i in range(len(bodies))]


def _with_long(v, distinct, chunk, state, is_short, pieces, counts):
    """Puts the pieces of long chunks between those of short ones."""
    all_counts = np.zeros(len(chunk), np.int64)
    all_counts[is_short] = counts
    made: dict[int, np.ndarray] = {}
    places = np.flatnonzero(~is_short)
    for i in places[np.argsort(chunk[places], kind="stable")]:  # equal chunks are filtered once
        if not made or chunk[i] != which:
            which, lattice = chunk[i], Lattice(v, [distinct[chunk[i]]])
        made[int(i)] = lattice.sample_only(state[i])
    for i, p in made.items():
        all_counts[i] = len(p)
    out = np.empty(int(all_counts.sum()), np.int32)
    out[np.repeat(is_short, all_counts)] = pieces
    begin = np.cumsum(all_counts) - all_counts
    for i, p in made.items():
        out[begin[i] : begin[i] + len(p)] = p
    return out, all_counts


def _spell(v: Vocabulary, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces, with characters that are no piece spelled in bytes, and where each piece ends among them."""
    bare = pieces < 0
    code = -1 - pieces[bare].astype(np.int64)
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    n = np.ones(len(pieces), np.int64)
    n[bare] = size
    ends = np.cumsum(n)
    if not len(code):
        return pieces, ends
    out, begin = np.empty(int(ends[-1]), np.int32), ends - n
    out[begin[~bare]] = pieces[~bare]
    begin = begin[bare]
    for k, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):  # UTF-8 of one to four bytes
        of = size == k
        for j in range(k):
            byte = code[of] >> (6 * (k - 1 - j))
            out[begin[of] + j] = v.byte_id[byte | lead if j == 0 else byte & 0x3F | 0x80]
    return out, ends


def decode_ids(v: Vocabulary, ids: Sequence[int]) -> str:
    """The text that the ids were sampled from."""
    return b"".join(map(v.bytes.__getitem__, ids)).decode()[1:]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to SLICE bytes of text; a longer text is a run of its own."""
    sizes = pc.coalesce(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > SLICE:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), model_path: str = DEFAULT_MODEL, seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """key, the columns to keep, and ids: array of int."""
    kept = [key_col, *keep]
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())  # a file of the vocabulary's size; executors need none
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{key_col}`").cast("string").alias(spare(docs, "key")), F.col(f"`{text_col}`").cast("string").alias(spare(docs, "text")))
    schema = source.select(*[f"`{c}`" for c in kept]).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(model.value, sharpness)
        for batch in batches:
            for a, b in _slices(batch, len(kept) + 1):
                part = batch.slice(a, b - a)
                texts = part.column(len(kept) + 1).to_pylist()
                there = [i for i, t in enumerate(texts) if t is not None]
                keys = part.column(len(kept)).to_pylist()
                if len(there) == 1 and len(texts[there[0]]) > SLICE:  # a longer text is a slice by itself
                    got = [encode_long(v, keys[there[0]], texts[there[0]], seed)]
                else:
                    got = encode_slice(v, [keys[i] for i in there], [texts[i] for i in there], seed)
                sizes = np.zeros(len(texts), np.int64)
                sizes[there] = [len(g) for g in got]
                mask = np.ones(len(texts) + 1, bool)
                mask[there] = False
                mask[-1] = False
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=mask)
                values = pa.array(np.concatenate(got) if got else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.ListArray.from_arrays(offsets, values)], names=[*kept, "ids"])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """encoded with the text of its ids; null ids give a null text."""
    names = [c for c in encoded.columns if c != text_col]
    source = encoded.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(ids_col)
    model = encoded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    schema = T.StructType([*source.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(at)
                flat = column.flatten().to_numpy(zero_copy_only=False)  # holds no rows that are null
                sizes = pc.coalesce(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                end = np.cumsum(sizes)
                there = column.is_valid().to_pylist()
                texts = [decode_ids(v, flat[e - n : e].tolist()) if ok else None for e, n, ok in zip(end.tolist(), sizes.tolist(), there)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    return source.mapInArrow(run, schema)


def op2_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digest and length of the text decoded from the ids, of every document."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(encoded).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
