"""Language-model qualification: whom to ask, what to send, and what of an answer to believe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, present, whole_word

# --- fixed values: fields of an answer and their domains ----------------------
BOOLEAN_FIELDS = ("is_business",)
TEXT_FIELDS = ("business_name", "city", "observed_price_range", "style_fit")
ENUMS = {
    "business_type": ("BOUTIQUE", "DESIGNER", "BRAND", "RETAILER", "MULTI_DESIGNER", "MARKETPLACE", "UNKNOWN"),
    "women_fashion": ("HIGH", "MEDIUM", "LOW", "UNKNOWN"), "physical_store": ("YES", "NO", "UNKNOWN"), "carries_other_brands": ("YES", "NO", "UNKNOWN"),
    "designer_positioning": ("MULTI_BRAND", "OWN_LABEL", "MIXED", "UNKNOWN"), "sustainability_focus": ("YES", "NO", "UNKNOWN"),
    "price_positioning": ("LUXURY", "PREMIUM", "MID", "BUDGET", "UNKNOWN"), "potential_stockist": ("YES", "NO", "UNKNOWN"), "confidence": ("HIGH", "MEDIUM", "LOW"),
}
LIST_FIELDS = ("evidence",)
PRICE = r"(?i)(?:₹|\$|€|\brs\.?|\binr)\s*[0-9]"
CALL_RESULT = "seq long, raw string, failure_kind string, elapsed double"


def ambiguity() -> Column:
    """Why a row needs a model, null if the rules are sure (name, business_type, fashion_relevance, physical_store, confidence)."""
    return (
        F.when(~present(F.col("name")), "identity_missing")
        .when(F.col("business_type") == UNKNOWN, "type_unknown")
        .when(F.col("fashion_relevance") == UNKNOWN, "fashion_unknown")
        .when(F.col("physical_store") == UNKNOWN, "store_unknown")
        .when(F.col("confidence") == "LOW", "low_confidence")
    )


def payload(text_chars: int = 1500) -> Column:
    """The compact evidence as JSON (name, url, title, text, headings, signals)."""
    return F.to_json(F.struct("name", "url", "title", F.substring("text", 1, text_chars).alias("text"), F.slice("headings", 1, 8).alias("headings"), F.slice("signals", 1, 8).alias("signals")))


def call(rows: DataFrame, client: Callable[[str], str] | None) -> DataFrame:
    """Raw answers to rows (seq, payload). Failures become a kind and never an exception; without a client all rows are skipped."""
    if client is None:
        return rows.select("seq", F.lit(None).cast("string").alias("raw"), F.lit("disabled").alias("failure_kind"), F.lit(0.0).alias("elapsed"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            out = []
            for seq, text in zip(pdf["seq"], pdf["payload"]):
                start = time.time()
                try:
                    raw, failure = client(text), None
                except TimeoutError:
                    raw, failure = None, "timeout"
                except Exception:  # the kind is the result; one answer must not end the job
                    raw, failure = None, "model"
                out.append((seq, raw, failure, time.time() - start))
            yield pd.DataFrame(out, columns=["seq", "raw", "failure_kind", "elapsed"])

    return rows.select("seq", "payload").mapInPandas(ask, CALL_RESULT)


def schema_errors(raw: Column) -> Column:
    """What is wrong with an answer's fields; an unreadable one has the one error ``json``."""
    return _errors(F.try_parse_json(raw))


def _errors(v: Column) -> Column:
    def shape(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))

    checks = [F.when(v.isNull(), "json")]
    for f in BOOLEAN_FIELDS:
        checks.append(F.when(v.isNotNull() & (F.coalesce(shape(f), F.lit("")) != "BOOLEAN"), f"{f}:boolean"))
    for f in TEXT_FIELDS:
        checks.append(F.when(v.isNotNull() & (F.coalesce(shape(f), F.lit("")) != "STRING"), f"{f}:string"))
    for f, values in ENUMS.items():
        checks.append(F.when(v.isNotNull() & ~F.coalesce(F.upper(F.try_variant_get(v, f"$.{f}", "string")).isin(*values), F.lit(False)), f"{f}:enum"))
    for f in LIST_FIELDS:
        checks.append(F.when(v.isNotNull() & ~F.coalesce(shape(f).startswith("ARRAY"), F.lit(False)), f"{f}:array"))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(answers: DataFrame) -> DataFrame:
    """answers (raw, page_text) with the validated fields and the codes of rejected claims.

    A claim that the page doesn't support becomes UNKNOWN: a name or city that
    isn't in the text, a price without a currency amount, a store without an
    address or visit phrase, a stockist without a multi-brand phrase.
    """
    v = F.col("__v")
    out = answers.withColumns({"__v": F.try_parse_json("raw"), "__text": F.lower(F.coalesce("page_text", F.lit("")))})  # each once a row: columns of their own
    out = out.withColumns({"schema_errors": _errors(v)} | {f"ai_{f}": F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit(UNKNOWN)) for f in (*TEXT_FIELDS, *ENUMS)})
    text = F.col("__text")
    claims = (
        ("unsupported_name", "ai_business_name", present(F.col("ai_business_name")) & ~F.contains(text, F.lower("ai_business_name"))),
        ("unsupported_city", "ai_city", present(F.col("ai_city")) & ~F.contains(text, F.lower("ai_city"))),
        ("invented_price", "ai_observed_price_range", present(F.col("ai_observed_price_range")) & ~text.rlike(PRICE)),
        ("unsupported_store", "ai_physical_store", (F.col("ai_physical_store") == "YES") & ~text.rlike(r"\b(?:visit us|our store|showroom|opening hours|[1-9][0-9]{5})\b")),
        ("unsupported_stockist", "ai_potential_stockist", (F.col("ai_potential_stockist") == "YES") & ~text.rlike(r"\b(?:multi[\s-]?brand|multi[\s-]?designer|designers? we (?:carry|stock)|brands we (?:carry|stock)|curated|independent designers?)\b")),
        ("unsupported_sustainability", "ai_sustainability_focus", (F.col("ai_sustainability_focus") == "YES") & ~text.rlike(whole_word("sustainable")) & ~text.rlike(r"\b(?:handloom|organic|natural|slow fashion)\b")),
    )
    out = out.withColumn("rejected", F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, _, test in claims]), lambda x: x.isNotNull()))
    return out.withColumns({column: F.when(F.array_contains("rejected", code), UNKNOWN).otherwise(F.col(column)) for code, column, _ in claims}).drop("__v", "__text")


def fill_unknown(rows: DataFrame, pairs: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """rows whose rule fields are UNKNOWN take the model's value if it is in the field's domain; others stay."""
    return rows.withColumns({rule: F.when((F.col(rule) == UNKNOWN) & F.col(ai).isin(*domain), F.col(ai)).otherwise(F.col(rule)) for rule, (ai, domain) in pairs.items()})
