"""The lead gate, why rows fail it, and the groups that reports use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present

# --- fixed values: retail types and phrases -----------------------------------
RETAIL_TYPES = ("BOUTIQUE", "MULTI_DESIGNER", "MULTI_BRAND", "CONCEPT_STORE", "RETAILER", "FASHION_RETAILER")
RELEVANT = (
    r"(?i)\b(?:fashion\s+boutique|clothing\s+boutique|designer\s+boutique|women'?s\s+boutique|boutique|concept\s+store|curated\s+store|"
    r"curated\s+(?:lifestyle\s+)?(?:fashion\s+)?(?:collections?|selection)|multi[\s\-]?brand|multi[\s\-]?designer|independent\s+designers|"
    r"fashion\s+retailer|clothing\s+store|fashion\s+store|lifestyle\s+store|fashion\s+collections?|women'?s\s+clothing|luxury\s+clothing)\b"
)
NOT_RETAIL = r"(?i)\b(?:manufacturer|wholesaler|wholesale\s+only|fashion\s+school|photography|photographer|stylist|personal\s+shopper|marketplace|fashion\s+blog|magazine)\b"
OWN_LABEL = r"(?i)\b(?:own[\s\-]?label|own[\s\-]?brand|our own collection|designer studio|we design|only our (?:own )?brand|women designer store|designer store|designer wear)\b"
CONTACTS = ("website", "instagram", "facebook", "email", "phone", "maps_url")
LISTING_SIGNALS = ("roundup_page", "publisher_not_boutique", "media_page")


def assess(df: DataFrame) -> DataFrame:
    """df with stockist_lead YES, NO or UNKNOWN, its reasons, and manual_review.

    Reads text, business_name, business_type, source_type, signals, positioning,
    carries_other_brands, relationship, geography, excluded, exclude_reason,
    address and the contacts. The first rule that applies decides.
    """
    text = F.col("text")
    contact = reduce(lambda a, b: a | b, [present(F.col(c)) for c in CONTACTS])
    relevant_text = F.coalesce(text.rlike(RELEVANT), F.lit(False))
    carries, position = F.upper(F.coalesce("carries_other_brands", F.lit(""))), F.upper(F.coalesce("positioning", F.lit("")))
    own = F.when(carries == "YES", False).when(relevant_text & (position != "OWN_LABEL"), False).otherwise((position == "OWN_LABEL") | F.coalesce(text.rlike(OWN_LABEL), F.lit(False)))
    page = F.col("relationship").isin("ARTICLE", "MEDIA", "DIRECTORY", "SOCIAL_POST")
    listing = F.col("source_type").isin("DIRECTORY", "ARTICLE") | F.arrays_overlap("signals", F.array(*map(F.lit, LISTING_SIGNALS[:2])))
    named = present(F.col("business_name"))
    relevant = relevant_text | F.col("business_type").isin(*RETAIL_TYPES)
    found = F.filter(
        F.array(
            F.when(relevant_text, "fashion_retail_page_evidence"), F.when(present(F.col("website")), "official_website"),
            F.when(reduce(lambda a, b: a | b, [present(F.col(c)) for c in CONTACTS[1:]]), "contactable"), F.when(~present(F.col("address")), "address_not_required"),
        ),
        lambda x: x.isNotNull(),
    )

    def verdict(lead: Column | str, reasons: Column) -> Column:
        return F.struct((F.lit(lead) if isinstance(lead, str) else lead).alias("lead"), reasons.alias("reasons"))

    def one(reason: str) -> Column:
        return F.array(F.lit(reason))

    gate = F.when(page | (F.col("geography") == "NO"), "NO").otherwise("UNKNOWN")
    choice = (
        F.when(F.col("excluded"), verdict(gate, F.array(F.coalesce("exclude_reason", F.lit("entity_quality_gate")))))
        .when(listing, verdict("NO", one("discovery_page_not_lead")))
        .when((F.col("business_type") == "MARKETPLACE") | F.coalesce(text.rlike(NOT_RETAIL), F.lit(False)), verdict("NO", one("not_a_retail_prospect")))
        .when(own, verdict("NO", one("own_label_not_lead")))
        .when(~named & ~contact, verdict("UNKNOWN", one("identity_insufficient")))
        .when(~F.coalesce(relevant, F.lit(False)), verdict("UNKNOWN", one("fashion_retail_evidence_missing")))
        .when(~contact, verdict("UNKNOWN", one("no_usable_contact_path")))
        .otherwise(verdict("YES", found))
    )
    out = df.withColumn("__v", choice)
    return out.withColumns({"stockist_lead": F.col("__v.lead"), "stockist_lead_reasons": F.col("__v.reasons"), "manual_review": F.col("__v.lead") == "YES"}).drop("__v")


def failure_class(df: DataFrame) -> Column:
    """A, B, C or D: evidence missing, never identified, a listing taken for a business, contact missing; null if none."""
    listing = F.col("relationship").isin("ARTICLE", "MEDIA", "DIRECTORY") | F.col("source_type").isin("DIRECTORY", "ARTICLE", "VIDEO") | F.arrays_overlap("signals", F.array(*map(F.lit, LISTING_SIGNALS)))
    named = present(F.col("business_name"))
    identified = ((F.col("is_business") == "YES") & (F.col("relationship") == "SELF")) | (named & ~listing)
    unknown = F.col("stockist_lead") == "UNKNOWN"
    return (
        F.when(listing & named & (F.col("business_type") != "UNKNOWN"), "C_listing_mistaken_for_business")
        .when(listing, F.lit(None))
        .when(~identified, "B_never_identified")
        .when(unknown & F.array_contains("stockist_lead_reasons", "no_usable_contact_path"), "D_identified_contact_missing")
        .when(unknown, "A_found_insufficient_evidence")
    )


def reporting_bucket() -> Column:
    """A to F by source, stockist answer and type (source_type, signals, ai_stockist, business_type, positioning)."""
    article = (F.col("source_type") == "ARTICLE") | F.arrays_overlap("signals", F.array(*map(F.lit, LISTING_SIGNALS[:2])))
    return (
        F.when(F.col("source_type") == "DIRECTORY", "D_directory").when(article, "E_article_or_editorial").when(F.col("ai_stockist") == "YES", "A_multi_brand_or_curated_stockist")
        .when(F.col("business_type").isin("DESIGNER", "BRAND") | (F.col("positioning") == "OWN_LABEL"), "B_own_label_designer_or_brand")
        .when(F.col("business_type").isin("BOUTIQUE", "RETAILER", "MULTI_DESIGNER"), "C_generic_clothing_retailer").otherwise("F_other_or_unrelated")
    )
