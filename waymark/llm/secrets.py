r"""Secret scans driven by a trigram index.

From each rule's pattern a Boolean query over trigrams is derived: the regex is
parsed, and a literal run of three or more characters that every match must
hold gives an AND of its trigrams; alternatives give an OR. The inverted index
is a written table of postings, (trigram, document) rows for the trigrams that
some query asks for, where a document stands for all rows of equal text by a
64-bit hash. A rule's candidates are the documents whose postings, met by
document, satisfy its query; a rule without mandatory trigrams scans every
document. Candidates go to the texts (as a broadcast if counted few, else by a
join), and only there the rule's pattern verifies them: two texts of one hash
cost a needless look, never a wrong span.

Built-in column functions only. Defined cases: null text is empty; an empty
text has no spans; overlapping spans of different rules are all reported;
repeated rows get equal results; columns beside the text are kept, whatever
their names; a column named as the result gives way.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, spare, table, text_of
from .spans import NONE, clean, find, joined, ordered


@dataclass(frozen=True)
class Rule:
    """pattern: as defined; scan: the same matches in Java's syntax without backtracking; least: characters of the match, or of its value, below which it is dropped."""

    kind: str
    pattern: str
    scan: str = ""
    value: str = ""
    least: int = 0


_KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
RULES = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _KEYWORD + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""", value=_KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]++", least=20),
    Rule("hex", r"[0-9a-f]+", r"(?<![0-9a-f])[0-9a-f]{24,}+", least=24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,255}", r"gh[pousr]_[A-Za-z0-9]{36,255}+"),
    Rule("chat_bot", r"xox[abpors]-[A-Za-z0-9-]{10,250}", r"xox[abpors]-[A-Za-z0-9-]{10,250}+"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
)
BASE = ("assign", "access", "hex")
#: Up to so many candidates, rows of a key and a few numbers, are broadcast.
FEW_CANDIDATES = 250_000

#: A query: None (everything), a trigram, or ("and" | "or", queries).
Query = None | str | tuple[str, tuple["Query", ...]]


def _combine(op: str, parts: Sequence[Query]) -> Query:
    if op == "and":
        kept = tuple(dict.fromkeys(p for p in parts if p is not None))
        return None if not kept else kept[0] if len(kept) == 1 else ("and", kept)
    if any(p is None for p in parts):
        return None
    kept = tuple(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", kept)


def trigram_query(pattern: str) -> Query:
    """The Boolean query that every text with a match satisfies; trigrams are in lower case and asked of the text in lower case.

    A pattern is read as a tree. Runs of fixed characters (a class whose members
    are one letter in both cases counts as fixed) are cut into trigrams;
    optional and repeated parts end a run, and a part repeated at least once
    adds its own query.
    """

    def single(op, arg) -> str | None:
        if op is rc.LITERAL:
            return chr(arg).lower() if arg < 128 else None
        if op is rc.IN and all(o is rc.LITERAL and v < 128 for o, v in arg):
            folded = {chr(v).lower() for _, v in arg}
            return folded.pop() if len(folded) == 1 else None
        return None

    def flat(items):
        for op, arg in items:
            if op is rc.SUBPATTERN:
                yield from flat(arg[3])
            else:
                yield op, arg

    def walk(items) -> Query:
        parts: list[Query] = []
        run = ""

        def cut() -> None:
            nonlocal run
            parts.extend(run[i : i + 3] for i in range(len(run) - 2))
            run = ""

        for op, arg in flat(items):
            ch = single(op, arg)
            if ch is not None:
                run += ch
                continue
            if op is rc.MAX_REPEAT or op is rc.MIN_REPEAT:
                least, most, sub = arg
                body = list(flat(sub))
                ch = single(*body[0]) if len(body) == 1 else None
                if ch is not None and least:
                    run += ch * least
                    if most == least:
                        continue
                cut()
                if least:
                    parts.append(walk(sub))
                    if ch is not None:
                        run = ch * least
                continue
            cut()
            if op is rc.BRANCH:
                parts.append(_combine("or", [walk(x) for x in arg[1]]))
        cut()
        return _combine("and", parts)

    return walk(rp.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def key_of(text: Column) -> Column:
    """What a text is called in the index."""
    return F.xxhash64(text)


def postings(docs: DataFrame, trigrams: Sequence[str], text_col: str = "text") -> DataFrame:
    """(trigram, doc) of the given trigrams that each text holds, case folded; doc is the text's key."""
    text = docs.select(text_of(text_col).alias("text")).select(F.lower("text").alias("low"), key_of(F.col("text")).alias("doc"))
    hits = [F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]
    return text.select(F.explode(F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")).alias("trigram"), "doc")


def holds(query: Query, found: Column) -> Column:
    """Whether an array of trigrams satisfies the query."""
    if query is None:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(found, query)
    return reduce(lambda a, b: (a & b) if query[0] == "and" else (a | b), [holds(q, found) for q in query[1]])


def candidates(index: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(doc, rules): the numbers of the queries that a document's postings satisfy, of those with trigrams; documents with none are left out."""
    met = index.where(F.col("trigram").isin(sorted(set().union(*map(trigrams_of, queries))))).groupBy("doc").agg(F.collect_set("trigram").alias("found"))
    rules = F.array_compact(F.array(*[F.when(holds(q, F.col("found")), F.lit(i)) for i, q in enumerate(queries) if q is not None]))
    return met.select("doc", rules.alias("rules")).where(F.size("rules") > 0)


def _passes(rule: Rule):
    if rule.value:
        return lambda s: F.length(F.regexp_extract(s["text"], rule.value, 1)) >= rule.least
    return lambda s: s["end"] - s["start"] >= rule.least


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """docs with an array of spans (kind, rank, start, end, text), by start, then kind as listed; a column of that name gives way."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_of, queries)))
    body, doc, likely, *found = (spare(docs, x) for x in ("clean", "doc", "rules", *(f"rule{i}" for i in range(len(rules)))))
    out = docs.withColumn(body, text_of(text_col))
    if trigrams:
        met = materialize(candidates(materialize(postings(docs, trigrams, text_col), "postings"), queries), "candidates")
        met = met.select(F.col("doc").alias(doc), F.col("rules").alias(likely))
        out = out.withColumn(doc, key_of(F.col(body))).join(F.broadcast(met) if met.count() <= FEW_CANDIDATES else met, doc, "left")
    out = out.withColumn(body, clean(F.col(body)))
    for i, (r, q) in enumerate(zip(rules, queries)):
        may = None if q is None else F.coalesce(F.array_contains(likely, i), F.lit(False))
        spans = find(F.col(body), r.scan or r.pattern, r.kind, i, may)
        out = out.withColumn(found[i], F.filter(spans, _passes(r)) if r.least else spans)
    every = F.concat(*map(F.col, found)) if found else F.array().cast(NONE)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    return out.select(*kept, ordered(every, False).alias(out_col))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """docs with each stretch of overlapping spans replaced by ``[SECRET]``; other rows and columns stay as they are."""
    name = spare(docs, "secrets")
    spans, text = F.col(name), F.col(f"`{text_col}`")
    zero = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["upto"].alias("a"), s["start"].alias("b"))
        gaps = F.when(s["start"] >= acc["upto"], F.array_append(acc["gaps"], gap)).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), gaps.alias("gaps"))

    def rest(wide: Column) -> Column:
        # four bytes a character, so that a place is found without counting
        part = lambda g: F.decode(F.substring(wide, g["a"] * 4 + 1, (g["b"] - g["a"]) * 4), "UTF-32")
        end = lambda acc: F.array_append(acc["gaps"], F.struct(acc["upto"].alias("a"), F.length(text).alias("b")))
        return F.array_join(F.transform(F.aggregate(spans, zero, step, end), part), "[SECRET]")

    found = scan(docs, rules, text_col, name)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), rest)).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    counts = [count_of("secrets", k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _sql(rules: Sequence[Rule]) -> str:
    """The same scan in DuckDB: mark matches, split, and sum up lengths."""
    ctes, parts = [], []
    for i, r in enumerate(rules):
        pattern = (r.pattern if r.kind != "hex" else "[0-9a-f]{24,}").replace("'", "''")
        ctes.append(f"""r{i} AS (
  SELECT doc_id, row, '{r.kind}' AS kind, {i} AS rank, k, pieces[k] AS m, len(array_to_string(pieces[1:k - 1], '')) AS s
  FROM (SELECT doc_id, row, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS pieces FROM d),
       LATERAL (SELECT unnest(range(2, len(pieces), 2)) AS k))""")
        keep = f"length(regexp_extract(m, '{r.value.replace(chr(39), chr(39) * 2)}', 1)) >= {r.least}" if r.value else f"length(m) >= {r.least}"
        parts.append(f"SELECT doc_id, row, kind, rank, s, s + length(m) AS e FROM r{i} WHERE {keep}")
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
{','.join(ctes)},
a AS ({' UNION ALL '.join(parts)}),
g AS (
  SELECT row, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (WHERE kind IN ({base})) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans
  FROM a GROUP BY row)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


OP7_SQL = _sql(RULES)
