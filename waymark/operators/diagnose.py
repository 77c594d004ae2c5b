"""Why a model's answer came out as it did, and counts over the answers to valid businesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: language that tells of several brands, of an own label, of fashion ---
# --- fixed values: phrases and limits of the diagnosis ------------------------
CURATED = r"(?i)\b(?:concept\s+store|curated|multi[\s\-]?brand|multi[\s\-]?designer|independent\s+(?:designers?|brands?|labels?))\b"
OWN_LABEL = r"(?i)\b(?:own[\s\-]?label|own[\s\-]?brand|our own collection|designer studio|we design)\b"
FASHION = r"(?i)\b(?:boutique|fashion|clothing|womenswear|women'?s\s+wear|apparel)\b"
NO_PAGE = ("insufficient_page_evidence", "roundup_without_page_text")
LITTLE_TEXT = 80


def _upper(name: str) -> Column:
    return F.upper(F.coalesce(name, F.lit("")))


def sufficiency(text: Column, shown: Column) -> Column:
    """YES, PARTIAL or NO: whether what was sent could carry an answer; shown: whether it has stockist language."""
    return F.when(shown, "YES").when(text.rlike(CURATED) | text.rlike(FASHION), "PARTIAL").when(F.length(F.btrim(text)) < LITTLE_TEXT, "NO").otherwise("PARTIAL")


def diagnosis() -> Column:
    """A saw enough, B saw too little, C text is incomplete, D no stockist indeed, or intended.

    Reads attempted, skipped_reason, ai_stockist, positioning, carries, text
    (all that was sent), excerpt and shown.
    """
    text = F.coalesce("text", F.lit(""))
    own = (_upper("positioning") == "OWN_LABEL") | (_upper("carries") == "NO") | text.rlike(OWN_LABEL)
    return (
        F.when(~F.coalesce("attempted", F.lit(False)), F.when(F.col("skipped_reason").isin(*NO_PAGE), "C").otherwise("B"))
        .when(_upper("ai_stockist") == "YES", "intended").when(own, "D").when(F.col("shown") | text.rlike(CURATED), "A")
        .when(F.coalesce("excerpt", F.lit("")) == "", "C").when((F.length(F.btrim(text)) < LITTLE_TEXT) | ~text.rlike(FASHION), "B").otherwise("C")
    )


def reason() -> Column:
    """The diagnosis in words; reads the same columns and ai_type."""
    text, carries = F.coalesce("text", F.lit("")), _upper("carries")
    return (
        F.when(~F.coalesce("attempted", F.lit(False)), F.concat(F.lit("not_sent:"), F.coalesce("skipped_reason", F.lit("unknown"))))
        .when(_upper("positioning") == "OWN_LABEL", "own-label only").when(text.rlike(OWN_LABEL) & (carries != "YES"), "designer studio / own-label language")
        .when(carries == "NO", "insufficient multi-brand evidence").when(_upper("ai_type").isin("DESIGNER", "BRAND") & (carries != "YES"), "ambiguous business type")
        .when(~text.rlike(FASHION), "insufficient fashion evidence").when(~F.col("shown"), "insufficient multi-brand evidence").otherwise("answered NO/UNKNOWN despite stockist-style language")
    )


def inspect(rows: DataFrame) -> DataFrame:
    """rows with diagnosis, concrete_reason and evidence_sufficient."""
    text = F.coalesce("text", F.lit(""))
    return rows.withColumns({"diagnosis": diagnosis(), "concrete_reason": reason(), "evidence_sufficient": sufficiency(text, F.col("shown"))})


def answer_counts(rows: DataFrame) -> DataFrame:
    """One row: valid own businesses in the right place (relationship, is_business, geography), and their answers YES, NO and anything else."""
    valid = rows.where("relationship = 'SELF' AND is_business = 'YES' AND geography = 'YES'")
    yes, no = _upper("ai_stockist") == "YES", _upper("ai_stockist") == "NO"
    return valid.agg(F.count(F.lit(1)).alias("valid"), F.count_if(yes).alias("n_yes"), F.count_if(no).alias("n_no"), F.count_if(~yes & ~no).alias("n_unknown"))
