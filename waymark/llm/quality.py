"""Quality rules combined by weak supervision.

Each rule votes good, votes bad or abstains on a document. The counts of vote
patterns over all documents (at most 3 to the number of rules, however many
documents) go to the driver, where expectation-maximisation estimates how
often each rule votes bad in each hidden class. The posterior probability of
good quality, from one term per rule and class, replaces all-must-pass filtering.

Everything on executors is built-in column functions. Defined cases: null text
has no words and fails the base rule; repeated rows get equal results; an
empty table gives an empty result; columns beside the text are kept or not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, let, materialize, table, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
GOOD, BAD, ABSTAIN = 1, -1, 0
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_ends", "n_shouts")
RULES = ("symbols", "upper", "shouts", "repeats", "lines", "variety", "sentences", "word_length")
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def words_of(text: Column) -> Column:
    """Array of a non-null text's words."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]++"))


def _chars_in(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of words found at least twice in the text."""

    def from_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))

    def covered(w: Column) -> Column:
        places = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(places, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        widths = let(starts, lambda q: F.transform(q, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(q, k + 1) - p, F.lit(window)))))
        return F.aggregate(widths, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) >= window, let(F.transform(words, lambda x: F.xxhash64(x)), from_hashes)).otherwise(F.lit(0))


def _values(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    made = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, WS_CHARS, "")),
        "n_symbols": _chars_in(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(words),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_lines": F.size(lines),
        "n_upper": _chars_in(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_ends": _chars_in(text, ".?"),
        "n_shouts": _chars_in(text, "!"),
    }
    return {k: v.cast("long") for k, v in made.items()}


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")


def features(text: Column) -> Column:
    """All features of a non-null text as one struct, computed once wherever it is used."""
    return let(words_of(text), lambda w: let(lines_of(text), lambda l: F.struct(*[v.alias(k) for k, v in _values(text, w, l).items()])))


def free_prefix(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    prefix = "__wm_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "__wm_") -> DataFrame:
    """docs with the features of FEATURES under the prefix, which its columns must not have."""
    out = docs.withColumn(f"{prefix}text", text_of(text_col))
    text = F.col(f"{prefix}text")
    out = out.withColumn(f"{prefix}words", words_of(text)).withColumn(f"{prefix}lines", lines_of(text))
    values = _values(text, F.col(f"{prefix}words"), F.col(f"{prefix}lines"))
    return out.select("*", *[values[k].alias(f"{prefix}{k}") for k in FEATURES]).drop(f"{prefix}text", f"{prefix}words", f"{prefix}lines")


def _named(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in FEATURES}


def votes(f: dict[str, Column]) -> dict[str, Column]:
    """Each rule's vote on features: good, bad, or abstaining between its two bounds or on texts too short for it."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    n, chars = f["n_words"], f["word_chars"]
    return {
        "symbols": vote(f["n_symbols"] * 5 > n, f["n_symbols"] * 50 <= n),
        "upper": vote(f["n_upper"] * 4 > chars, f["n_upper"] * 10 <= chars),
        "shouts": vote(f["n_shouts"] * 3 > n, f["n_shouts"] * 20 <= n),
        "repeats": vote(f["n_repeat_words"] * 5 > n, f["n_repeat_words"] * 50 <= n),
        "lines": vote((f["n_lines"] >= 3) & (f["n_dup_lines"] * 3 > f["n_lines"]), f["n_dup_lines"] * 20 <= f["n_lines"]),
        "variety": vote((n >= 50) & (f["n_distinct"] * 5 < n), (f["n_distinct"] * 2 >= n)),
        "sentences": vote((n >= 50) & (f["n_ends"] * 100 < n), (f["n_ends"] * 40 >= n) & (f["n_ends"] * 2 <= n)),
        "word_length": vote((chars * 2 < n * 5) | (chars > n * 12), (chars >= n * 4) & (chars <= n * 7)),
    }


def pattern_counts(voted: DataFrame, cols: Sequence[str]) -> dict[tuple[int, ...], int]:
    """Documents by vote pattern; the number of patterns is bounded by 3 to the number of rules."""
    return {tuple(r[c] for c in cols): r["n"] for r in voted.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()}


Model = list[tuple[float, list[tuple[float, float]]]]


def fit_label_model(counts: dict[tuple[int, ...], int], rounds: int = 40) -> Model:
    """Log weights of the hidden classes: (log share, per rule (log rate of good votes, log rate of bad votes)).

    Class 0 is good quality; the bad side has one class per rule, its kind of
    junk, as junk of one kind passes most other rules and a single bad class
    would see only the kind that most rules agree on. A row without bad votes
    starts as good, one with a single bad vote as bad in four of five cases, one with more as bad.
    """
    patterns = sorted(counts)
    if not patterns:
        return [(0.0, [])]
    k = len(patterns[0])
    belief = []
    for p in patterns:
        bad = [j for j in range(k) if p[j] == BAD]
        good = 0.99 if not bad else 0.2 if len(bad) == 1 else 0.02
        belief.append([good] + [(1 - good) / len(bad) if p[j] == BAD else 0.0 if bad else (1 - good) / k for j in range(k)])
    total = sum(counts.values())
    model: Model = []
    for _ in range(rounds):
        model = []
        for c in range(k + 1):
            rows = sum(counts[p] * b[c] for p, b in zip(patterns, belief))
            rates = []
            for j in range(k):
                bads = sum(counts[p] * b[c] for p, b in zip(patterns, belief) if p[j] == BAD)
                voted = sum(counts[p] * b[c] for p, b in zip(patterns, belief) if p[j] != ABSTAIN)
                rate = (bads + 0.1) / (voted + 20) if c == 0 else (bads + (2 if j == c - 1 else 0.1)) / (voted + (2.1 if j == c - 1 else 2))
                rates.append((math.log(1 - rate), math.log(rate)))
            model.append((math.log((rows + 0.5) / (total + 0.5 + 0.5 * k)), rates))
        for i, p in enumerate(patterns):
            logs = [share + sum(r[0] if v == GOOD else r[1] if v == BAD else 0.0 for v, r in zip(p, rates)) for share, rates in model]
            top = max(logs)
            odds = [math.exp(x - top) for x in logs]
            belief[i] = [x / sum(odds) for x in odds]
    return model


def posterior(model: Model, vote_cols: Sequence[Column]) -> Column:
    """Probability of good quality."""
    logs = []
    for share, rates in model:
        log: Column = F.lit(float(share))
        for v, (g, b) in zip(vote_cols, rates):
            log = log + F.when(v == GOOD, F.lit(float(g))).when(v == BAD, F.lit(float(b))).otherwise(F.lit(0.0))
        logs.append(log)
    return let(F.array(*logs), lambda x: F.exp(F.get(x, F.lit(0)) - F.array_max(x)) / F.aggregate(F.transform(x, lambda y: F.exp(y - F.array_max(x))), F.lit(0.0), lambda a, y: a + y))


def base_failed(f: dict[str, Column]) -> Column:
    n, r = f["n_words"], f["n_repeat_words"]
    return (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)


def fit(featured: DataFrame, prefix: str = "__wm_") -> Model:
    """The label model over all rows of a table with features."""
    voted = featured.select(*[v.alias(k) for k, v in votes(_named(prefix)).items()])
    return fit_label_model(pattern_counts(voted, RULES))


def judge(featured: DataFrame, model: Model, threshold: float = 0.5, prefix: str = "__wm_") -> DataFrame:
    """featured with base_failed, posterior and kept under the prefix."""
    p = posterior(model, list(votes(_named(prefix)).values()))
    return featured.withColumns({f"{prefix}base_failed": base_failed(_named(prefix)), f"{prefix}posterior": p}).withColumn(
        f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}posterior") >= threshold)
    )


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their own columns.

    Features are worked out for the model and again for the verdict: a table
    that keeps them with the texts would take the corpus's size on disk.
    """
    model = fit(with_features(docs.select(text_of(text_col).alias("text"))))

    def verdict(x: Column) -> Column:
        f = {k: x[k] for k in FEATURES}
        return ~base_failed(f) & (posterior(model, list(votes(f).values())) >= threshold)

    # one expression, so that pushing the filter down doesn't copy the features
    return docs.where(let(features(text_of(text_col)), verdict))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    featured = materialize(with_features(docs).drop("text"), "quality")
    out = judge(featured, fit(featured))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return out.select("doc_id", *[F.col(f"__wm_{c}").alias(c) for c in cols])
