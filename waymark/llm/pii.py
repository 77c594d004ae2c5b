r"""Personal data: candidates from high-recall generators, boosted trees, calibrated thresholds.

Four kinds with exact definitions (email, ip, card, phone) are always redacted.
Looser generators propose spans that may overlap them and each other: spelled-out
mail addresses, bank account numbers, card numbers that fail the check digit,
national numbers and phone numbers without a country code. Boosted trees score
these by format and context features; a span is taken where its calibrated
probability reaches the threshold that gave its kind the asked precision on
held-out rows, one half at least. Taken spans that overlap an exact span, or a taken one
of a kind listed before, fall away.

The trees are fitted on the driver on TRAINING_ROWS generated sentences (a fixed
bound); features of training and production rows come from the same column
expressions. Built-in column functions only. Defined cases: null text is
empty; empty texts have no spans; repeated rows get equal results; columns
beside id and text are not read.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import let, spare, table, text_of
from .spans import CONTEXT_SPANS, NONE, clean, coverage, find, joined, ordered, overlaps

BASE = ("email", "ip", "card", "phone")
#: Loose kinds, the most specific format first: where taken spans overlap, the first listed stays.
LOOSE = ("email_words", "bank_account", "card_like", "national_id", "phone_local")
#: Sentences that the trees are fitted on.
TRAINING_ROWS = 4000
CONTEXT = 28
_BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
GOOD_CONTEXT = r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|contact|reach|text|ssn|social security|insurance|iban|account|bank|mail|e-mail|write|transfer)\b"
BAD_CONTEXT = r"(?i)\b(?:isbn|issn|order|invoice|version|part|serial|pages?|id|no|model|ref|reference|range|ticket|sku|item|chapter|results?|score|build|lot)\b"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), doubled) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four exact kinds in a clean text."""
    email = find(text, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "email", 0, F.contains(text, F.lit("@")))
    ip = find(text, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip", 1)
    ip = F.filter(ip, lambda s: s["text"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    card = find(text, r"[0-9](?:[\x20-]?[0-9])++", "card", 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"))
    card = F.filter(card, lambda s: let(_digits(s["text"]), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))))
    phone = find(text, r"\+[0-9][\x20().0-9-]+[0-9]", "phone", 3, F.contains(text, F.lit("+")))
    phone = F.filter(phone, lambda s: F.length(_digits(s["text"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def loose_spans(text: Column) -> Column:
    """Candidates of the looser kinds in a clean text."""
    at = F.contains(text, F.lit("[at]")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit(" at "))
    words = find(text, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++", "email_words", 4, at, CONTEXT)
    bank = find(text, r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])", "bank_account", 5, context=CONTEXT)
    card = find(text, r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])", "card_like", 6, context=CONTEXT)
    national = find(text, r"(?<![0-9])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9])", "national_id", 7, context=CONTEXT)
    local = find(text, r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", "phone_local", 8, context=CONTEXT)
    return F.concat(words, bank, card, national, local)


N_FEATURES = 20


def features_of(s: Column) -> Column:
    """Array of N_FEATURES format and context features of a candidate."""
    return let(_digits(s["text"]), lambda digits: let(F.split(s["text"], "[^A-Za-z0-9]++"), lambda parts: F.array(*_features(s, digits, parts))))


def _features(s: Column, digits: Column, parts: Column) -> list[Column]:
    before, after = s["before"], s["after"]
    separators = F.regexp_replace(s["text"], "[A-Za-z0-9]", "")
    groups = F.transform(parts, lambda g: F.length(g))
    return [
        s["rank"].cast("double"), F.length(s["text"]).cast("double"), F.length(digits).cast("double"),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double"), F.length(separators).cast("double"),
        F.size(F.array_distinct(F.split(separators, ""))).cast("double"), F.contains(s["text"], F.lit("(")).cast("double"),
        F.startswith(digits, F.lit("0")).cast("double"), before.rlike(r"[A-Za-z0-9_/.:$-]$").cast("double"), after.rlike(r"^(?:[A-Za-z0-9_/%-]|[.,][0-9])").cast("double"),
        before.rlike(GOOD_CONTEXT).cast("double"), before.rlike(BAD_CONTEXT).cast("double"), F.regexp_count(s["text"], F.lit("[A-Z]")).cast("double"),
        F.size(groups).cast("double"), F.array_max(groups).cast("double"), F.array_min(groups).cast("double"),
        F.regexp_count(F.concat(before, F.lit(" "), after), F.lit("[0-9]")).cast("double"), before.rlike(r"[#:=]\x20?$").cast("double"),
        s["text"].rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)").cast("double"), s["text"].rlike(r"(?i)[.\])\x20](?:com|org|net|edu|info|co|io|de|fr|es|uk|in)(?:$|[^a-z])").cast("double"),
    ]


#: Words around values in generated sentences: (kind: words before personal values, in several languages), and before others.
CUES = {
    "email_words": ("mail", "write to", "contact", "schreib an", "escribe a", "reach"),
    "bank_account": ("IBAN", "transfer to account", "bank", "Konto", "cuenta", "pay into"),
    "card_like": ("card", "Karte", "paid with", "carte", "tarjeta", "Visa"),
    "national_id": ("SSN", "social security number", "insurance", "Ausweis", "id card"),
    "phone_local": ("call me at", "phone", "tel.", "my mobile is", "contact us on", "Telefon", "fax"),
}
OTHER_CUES = ("ISBN", "order", "invoice", "version", "part", "serial", "pages", "ref", "range", "ticket", "item", "results", "lot", "tracking", "Bestellung", "sku", "build")


def training_rows(n: int = TRAINING_ROWS, seed: int = 7, cues: dict = CUES, other_cues: tuple = OTHER_CUES) -> list[tuple[str, float]]:
    """Generated sentences with one candidate each, and whether it is personal.

    About half of either class stands in neutral words, so that formats are
    learned, too; each kind has negatives: other numbers of the same look.
    """
    r = random.Random(seed)
    letters = "etaoinshrdluçéüñ"

    def filler(k: int) -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 9))) + r.choice(("", "", "", ",", ".")) for _ in range(k))

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def local() -> str:
        sep = r.choice(" .-")
        return r.choice([f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"({digits(3)}) {digits(3)}{sep}{digits(4)}", f"0{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"])

    def words() -> str:
        name = "".join(r.choice("abcdefghijklmnoprstuvwyz._") for _ in range(r.randrange(3, 10))).strip("._") or "x"
        host = "".join(r.choice("abcdefghijklmnoprstuvwyz") for _ in range(r.randrange(3, 10)))
        a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("(at)", "."), ("[at]", "."), (" at ", " dot ")])
        gap = "" if a == " at " else r.choice(["", " "])
        return f"{name}{gap}{a}{gap}{host}{gap if d != '.' else ''}{d}{gap if d != '.' else ''}{r.choice(['com', 'org', 'net', 'de', 'co', 'io'])}"

    def no_words() -> str:
        a, b, c = (filler(1).strip(".,").encode("ascii", "ignore").decode() or "it" for _ in range(3))
        return r.choice([f"{a} at {b}. {c}", f"{a}(at) {b}.{c}", f"{a} [at] {b}. {c}", f"{a} at {digits(1)}.{digits(2)}", f"{a}[at] {b} (dot) {c}"])

    def bank() -> str:
        return f"{r.choice(['DE', 'FR', 'GB', 'ES', 'NL', 'IT'])}{digits(2)}" + r.choice((" ", "")) + " ".join(digits(4) for _ in range(r.choice([4, 5]))) + r.choice(["", f" {digits(2)}"])

    def code() -> str:
        return f"{r.choice('ABXZ')}{r.choice('ABXZ')}{digits(2)} " + " ".join("".join(r.choice("ABCDEFGHKLMNPQRSTUVWXYZ0123456789") for _ in range(4)) for _ in range(3))

    def card() -> str:
        return r.choice([digits(16), digits(16), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", digits(15)])

    def no_card() -> str:
        return r.choice([f"1{digits(12)}", f"978{digits(10)}", digits(1) * 16, f"0.{digits(16)}", f"2024{digits(10)}", f"{digits(2)} {digits(3)} {digits(4)} {digits(5)}", f"{r.choice('ABCK')}{digits(16)}", digits(18)])

    def no_local() -> str:
        return r.choice([f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"19{digits(2)} 20{digits(2)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(4)}.{digits(3)}.{digits(4)}/{digits(2)}"])

    def national() -> str:
        return f"{digits(3)}-{digits(2)}-{digits(4)}"

    def no_national() -> str:
        return r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}-{digits(2)}", f"{digits(3)} {digits(2)} {digits(4)} {digits(3)}", f"{r.choice('ABX')}{national()}", f"{digits(3)} {digits(2)} 20{digits(2)}"])

    made = {"email_words": (words, no_words), "bank_account": (bank, code), "card_like": (card, no_card), "national_id": (national, no_national), "phone_local": (local, no_local)}
    out = []
    for i in range(n):
        kind = LOOSE[i % len(LOOSE)]
        good, bad = made[kind]
        if r.random() < 0.5:
            before = f"{r.choice(cues[kind])} " if r.random() < 0.5 else ""
            out.append((f"{filler(6)} {before}{good()}{r.choice(('', '.', ',', '!!', '###'))} {filler(3)}", 1.0))
        elif r.random() < 0.35 and kind != "email_words":  # the same format behind another cue
            out.append((f"{filler(6)} {r.choice(other_cues)}{r.choice((' ', ': ', ' #'))}{good()}{r.choice(('', '-A', '/2'))} {filler(3)}", 0.0))
        else:
            before = f"{r.choice(other_cues)} " if r.random() < 0.3 else ""
            out.append((f"{filler(6)} {before}{bad()}{r.choice(('', '-A', '/2', '%', ''))} {filler(3)}", 0.0))
    return out


@dataclass
class Detector:
    """thresholds: of each loose kind, in the order of LOOSE."""

    model: boosting.Boosted
    thresholds: tuple[float, ...]

    def takes(self, s: Column) -> Column:
        """Whether a candidate's calibrated probability reaches its kind's threshold."""
        least = F.element_at(F.array(*map(F.lit, self.thresholds)), s["rank"] - len(BASE) + 1)
        return let(features_of(s), lambda f: self.model.column([F.get(f, F.lit(i)) for i in range(N_FEATURES)])) >= least


def fit_detector(spark: SparkSession, rows: int = TRAINING_ROWS, precision: float = 0.9) -> Detector:
    """Trees, calibration and thresholds from a bounded number of generated rows."""
    made = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(training_rows(rows))], "i int, text string, y double")
    spans = made.select("i", "y", F.explode(loose_spans(clean(F.col("text")))).alias("s"))
    got = sorted(spans.select("i", "y", features_of(F.col("s")).alias("x")).collect(), key=lambda r: (r["i"], r["x"]))
    x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)
    model = boosting.fit(x, y)
    kinds = [x[:, 0] == len(BASE) + i for i in range(len(LOOSE))]
    return Detector(model, tuple(max(0.5, boosting.threshold(model, x, y, precision, k)) for k in kinds))


def detect(docs: DataFrame, detector: Detector, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with an array of spans (kind, rank, start, end, text), by kind as listed, then start; a column of that name gives way."""
    names = {k: spare(docs, k) for k in ("clean", "base", "loose", "likely")}
    body, base, loose, likely = (F.col(names[k]) for k in ("clean", "base", "loose", "likely"))
    out = docs.withColumn(names["clean"], clean(text_of(text_col)))
    may = body.rlike(r"[0-9]{2}|[\[(]at[\])]|\x20at\x20")
    out = out.withColumn(names["base"], base_spans(body)).withColumn(names["loose"], F.when(may, loose_spans(body)).otherwise(F.array().cast(CONTEXT_SPANS)))

    bare = lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "rank", "start", "end", "text")])
    out = out.withColumn(names["likely"], F.when(F.size(loose) > 0, F.transform(F.filter(loose, detector.takes), bare)))

    def of(spans: Column, kind: str) -> Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    def free(kinds: tuple[str, ...], covered: list[Column], kept: Column) -> Column:
        """Taken spans of the kinds, in turn, that overlap no exact span and none of a kind before."""
        if not kinds:
            return kept
        stay = F.filter(of(likely, kinds[0]), lambda s: ~reduce(lambda a, b: a | b, [overlaps(c, s) for c in covered]))
        return let(stay, lambda x: let(coverage(x), lambda c: free(kinds[1:], [*covered, c], F.concat(kept, x))))

    def from_base(kinds: tuple[str, ...], covered: list[Column]) -> Column:
        if not kinds:
            return free(LOOSE, covered, F.array().cast(NONE))
        return let(coverage(of(base, kinds[0])), lambda c: from_base(kinds[1:], [*covered, c]))

    added = F.when(F.size(likely) > 0, from_base(BASE, []))
    found = F.concat(base, F.coalesce(added, F.array().cast(NONE)))
    return out.withColumn(out_col, ordered(found, True)).drop(*names.values())


def op6_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in every document; n_found counts all spans, n_added those of the method."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), fit_detector(spark))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    added = F.size(F.filter("pii", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_added")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_found"), added)
