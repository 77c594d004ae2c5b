"""Places of pattern matches in texts, with built-in functions only.

Matches are wrapped in a mark, the text is split at the mark, and places are
running lengths of the pieces. The mark is a private-use character; where a
text holds it already, it is first changed to its neighbour, which no pattern
here matches and which has the same length. Places are code points, ends
exclusive.

Patterns must not match the empty string and must not hold groups that are
referred to by number from outside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Pieces summed in one go.
RUN = 256
MARK, STAND_IN = "", ""
SPAN = "struct<kind:string,rank:int,start:int,end:int,text:string>"
NONE = f"array<{SPAN}>"
CONTEXT_SPANS = NONE.replace("text:string", "text:string,before:string,after:string")


def clean(text: Column) -> Column:
    """The text as find() needs it."""
    return F.translate(text, MARK, STAND_IN)


def _starts(pieces: Column) -> Column:
    """Characters before each piece: running sums inside runs of RUN pieces, and over the runs."""

    def running(sizes: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def of(sizes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda i: F.slice(sizes, i * RUN + 1, F.lit(RUN)))
        return let(runs, lambda r: let(running(F.transform(r, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))), lambda base: F.flatten(F.transform(r, lambda x, i: F.transform(running(x), lambda y: y + F.get(base, i))))))

    return let(F.transform(pieces, lambda p: F.length(p)), of)


def find(text: Column, pattern: str, kind: str, rank: int, needs: Column | None = None, context: int = 0) -> Column:
    """Array of spans of the leftmost non-overlapping matches in a clean text, in time near linear in their number.

    needs: a cheap condition without which there is no match. context: so many
    characters on either side, up to the next match, are kept as before and after.
    """
    none = F.array().cast(CONTEXT_SPANS if context else NONE)

    def spans(pieces: Column) -> Column:
        # even pieces lie between matches, odd ones are matches
        pairs = F.floor((F.size(pieces) - 1) / 2).cast("int")

        def span(i: Column, starts: Column) -> Column:
            a, match = F.get(starts, i * 2 + 1), F.get(pieces, i * 2 + 1)
            around = [F.right(F.get(pieces, i * 2), F.lit(context)).alias("before"), F.left(F.get(pieces, i * 2 + 2), F.lit(context)).alias("after")] if context else []
            return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), a.alias("start"), (a + F.length(match)).alias("end"), match.alias("text"), *around)

        made = let(_starts(pieces), lambda starts: F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: span(i, starts)))
        return F.when(pairs > 0, made).otherwise(none)

    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
    found = let(F.split(marked, MARK), spans)
    there = text.rlike(pattern) if needs is None else needs
    return F.when(there, found).otherwise(none)


def coverage(spans: Column) -> Column:
    """Bytes 1 for characters in one of the spans, which stand in order and don't overlap, and 0 before; read with overlaps()."""

    def run(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.repeat(F.lit("0"), s["start"] - before), F.repeat(F.lit("1"), s["end"] - s["start"]))

    return F.array_join(F.transform(spans, run), "").cast("binary")


def overlaps(covered: Column, s: Column) -> Column:
    """Whether a span overlaps one of those covered; in time of its own length, as places in bytes need no count of characters."""
    return F.contains(F.substring(covered, s["start"] + 1, s["end"] - s["start"]).cast("string"), F.lit("1"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column, by_kind_first: bool) -> Column:
    """By kind as listed, then start; or by start, then kind as listed."""
    key = (lambda s: F.struct(s["rank"].alias("a"), s["start"].alias("b"), s["end"].alias("c"), s["kind"].alias("d"), s.alias("s"))) if by_kind_first else (lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("c"), s["kind"].alias("d"), s.alias("s")))
    return F.transform(F.sort_array(F.transform(spans, key)), lambda x: x["s"])
