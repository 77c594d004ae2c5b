"""Business classification from evidence: type, relevance, store, city, confidence, relationship and quality.

Flags are computed in one projection and decisions read them, so each pattern
runs once per row and the plan has no Python in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import rules, urls
from ..functions.text import UNKNOWN, mentions, present

FLAG = "__is_"


def _word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?i)\b{word}\b")


def _f(name: str) -> Column:
    return F.col(FLAG + name)


def flags(df: DataFrame, haystack: str = "haystack") -> DataFrame:
    """df (haystack, name, addresses, page_roles, fact_fields, fact_sources) with the flags that the decisions read."""
    h = F.col(haystack)
    tests = {
        "boutique": h.rlike(P.BOUTIQUE), "store": h.rlike(P.STORE), "multi": h.rlike(P.MULTI_DESIGNER) | h.rlike(P.MULTI_BRAND), "market": h.rlike(P.MARKETPLACE),
        "non_target": h.rlike(P.NON_TARGET), "designer": h.rlike(P.DESIGNER) | _word(h, "designer"), "designer_word": _word(h, "designer"), "women": h.rlike(P.WOMEN_STRONG),
        "visit": h.rlike(P.STORE_LANGUAGE), "online": h.rlike(P.ONLINE_ONLY), "category": h.rlike(P.FASHION_CATEGORY), "retail": h.rlike(P.RETAIL), "brand": h.rlike(P.BRAND),
        "brand_word": _word(h, "brand"), "shop_online": h.rlike(P.ECOMMERCE), "craft": h.rlike(r"(?i)\b(?:collection|atelier|studio|couture|bespoke)\b"),
        "women_negative": h.rlike(P.WOMEN_NEGATIVE), "address": (F.size("addresses") > 0) | F.array_contains("fact_fields", "address"),
        "pin": F.exists("addresses", lambda a: a.rlike(P.PIN_CODE)), "store_page": F.array_contains("page_roles", "location"),
        "local": F.array_contains("fact_sources", "jsonld_localbusiness") | F.array_contains("fact_fields", "physical_store"),
        "postal": F.array_contains("fact_sources", "jsonld_postaladdress") | F.arrays_overlap("fact_fields", F.array(F.lit("address"), F.lit("addressLocality"))),
        "named": present(F.col("name")),
    }
    hits = {"n_boutique": F.regexp_count(h, F.lit(P.BOUTIQUE)), "n_store": F.regexp_count(h, F.lit(P.STORE)), "n_fashion": F.regexp_count(h, F.lit(r"(?i)\bfashion\b"))}
    return df.withColumns({FLAG + k: F.coalesce(v, F.lit(False)) for k, v in tests.items()} | {FLAG + k: v for k, v in hits.items()})


def business_type() -> Column:
    """BOUTIQUE, DESIGNER, MULTI_DESIGNER, RETAILER, BRAND, MARKETPLACE or UNKNOWN; the first rule that applies."""
    kinds = ("women", "address", "store_page", "local", "visit", "category")
    support = sum((_f(k).cast("int") for k in kinds), F.lit(1))
    return (
        F.when(_f("non_target") & ~_f("boutique"), UNKNOWN)
        .when(_f("market"), "MARKETPLACE")
        .when(_f("boutique") & (support >= 3), "BOUTIQUE")
        .when(_f("boutique") & _f("named") & (_f("women") | _f("address") | _f("local") | _f("visit")), "BOUTIQUE")
        .when(_f("multi") & (_f("boutique") | _f("store")), "MULTI_DESIGNER")
        .when((_f("n_boutique") >= 2) | (_f("boutique") & (_f("store") | _f("designer_word"))) | ((_f("n_boutique") == 1) & _f("named")), "BOUTIQUE")
        .when(_f("designer") & (_f("store") | _f("category") | _f("craft")), "DESIGNER")
        .when(_f("retail") & (_f("address") | _f("store_page") | _f("store")) | (_f("n_store") >= 2), "RETAILER")
        .when((_f("brand") | (_f("brand_word") & (_f("store") | _f("shop_online")))) & (_f("category") | _f("shop_online") | _f("designer")), "BRAND")
        .when(_f("brand_word") & _f("store"), "BRAND")
        .otherwise(UNKNOWN)
    )


def fashion_relevance(kind: Column) -> Column:
    return F.when(kind.isin("BOUTIQUE", "DESIGNER", "MULTI_DESIGNER") | _f("boutique"), "HIGH").when(_f("store") | ((_f("n_fashion") >= 3) & _f("category")), "MEDIUM").otherwise(UNKNOWN)


def women_relevance() -> Column:
    return F.when(_f("women"), "HIGH").when(_f("women_negative"), "LOW").when(_f("category") & _f("boutique"), "MEDIUM").otherwise(UNKNOWN)


def physical_store() -> Column:
    """struct(value, evidence, confidence); UNKNOWN without evidence."""

    def made(value: str, evidence: str, confidence: str) -> Column:
        return F.struct(F.lit(value).alias("value"), F.lit(evidence).alias("evidence"), F.lit(confidence).alias("confidence"))

    return (
        F.when(_f("online"), made("NO", "online-only language", "HIGH"))
        .when(_f("local"), made("YES", "local business", "HIGH"))
        .when(_f("postal") & (_f("pin") | _f("visit") | _f("store_page")), made("YES", "postal address", "HIGH"))
        .when(_f("address") & _f("pin"), made("YES", "address with postal code", "HIGH"))
        .when(_f("visit") & _f("address"), made("YES", "visit language with address", "HIGH"))
        .when(_f("store_page") & _f("address"), made("YES", "store page with address", "MEDIUM"))
        .otherwise(made(UNKNOWN, "", ""))
    )


def city(df_localities: str = "localities", addresses: str = "addresses", title: str = "title", store: str = "physical_store") -> Column:
    """The one structured locality, else the one city of the addresses, else the one of the title of a physical store; conflicts are UNKNOWN."""
    local = F.array_distinct(F.filter(df_localities, lambda x: x != ""))
    in_addresses = F.array_distinct(mentions(F.array_join(addresses, " . "), rules.CITY_NAMES))
    in_title = mentions(F.coalesce(F.col(title), F.lit("")), rules.CITY_NAMES)
    return (
        F.when(F.size(local) == 1, F.element_at(local, 1))
        .when(F.size(in_addresses) == 1, F.element_at(in_addresses, 1))
        .when(F.size(addresses) > 0, UNKNOWN)
        .when((F.size(in_title) == 1) & (F.col(store) == "YES"), F.element_at(in_title, 1))
        .otherwise(UNKNOWN)
    )


def confidence(kind: Column, fashion: Column, contact: Column, store: Column, website: Column) -> Column:
    typed, shown = kind != UNKNOWN, contact | (store == "YES")
    return F.when(_f("named") & typed & shown, "HIGH").when(_f("named"), "MEDIUM").otherwise("LOW")


def classify(df: DataFrame) -> DataFrame:
    """df with business_type, fashion_relevance, women_fashion_relevance, physical_store, store_evidence, city and confidence.

    Columns read: haystack, name, title, addresses, page_roles, fact_fields, fact_sources, localities, has_contact, website.
    """
    out = flags(df).withColumn("business_type", business_type()).withColumn("__store", physical_store())
    out = out.withColumns({"fashion_relevance": fashion_relevance(F.col("business_type")), "women_fashion_relevance": women_relevance(), "physical_store": F.col("__store.value"), "store_evidence": F.col("__store.evidence")})
    out = out.withColumn("city", city())
    out = out.withColumn("confidence", confidence(F.col("business_type"), F.col("fashion_relevance"), F.col("has_contact"), F.col("physical_store"), present(F.col("website"))))
    return out.drop("__store", *[c for c in out.columns if c.startswith(FLAG)])


def is_media_or_listicle() -> Column:
    """Whether a row (url, title, text, source_type, signals) is a publisher's page or a list of shops; videos never are."""
    head = F.concat_ws(" ", "title", F.substring("text", 1, 400))
    listed = F.arrays_overlap("signals", F.array(*map(F.lit, P.MEDIA_SIGNALS))) | (urls.classify(F.col("url")) == "ARTICLE") | urls.domain(F.col("url")).rlike(P.MEDIA_HOST) | head.rlike(P.LISTICLE_TITLE)
    return F.when(F.col("source_type") == "VIDEO", F.lit(False)).when(F.col("source_type").isin("DIRECTORY", "ARTICLE"), F.lit(True)).otherwise(F.coalesce(listed, F.lit(False)))


def entity_quality(df: DataFrame) -> DataFrame:
    """df with relationship, business_context, is_business, entity_quality, excluded and exclude_reason.

    Columns read: url, title, text, source_type, signals, name, website, instagram, business_type, geography.
    """
    named = present(F.col("name"))
    out = df.withColumns({"__media": is_media_or_listicle(), "__post": urls.is_social_post(F.col("url")), "__hotel": F.concat_ws(" ", "url", "title", F.substring("text", 1, 800)).rlike(P.HOTEL)})
    relationship = (
        F.when(F.col("__post"), "SOCIAL_POST")
        .when((F.col("source_type") == "DIRECTORY") | F.array_contains("signals", "directory"), "DIRECTORY")
        .when(F.arrays_overlap("signals", F.array(*map(F.lit, P.MENTION_SIGNALS))), "MENTIONED_BUSINESS")
        .when(F.col("__media") & ((F.col("source_type") == "ARTICLE") | urls.domain(F.col("url")).rlike(P.MEDIA_HOST)), "MEDIA")
        .when(F.col("__media"), "ARTICLE")
        .when(named, "SELF")
        .otherwise(UNKNOWN)
    )
    out = out.withColumn("relationship", relationship)
    r, kind, geo = F.col("relationship"), F.upper(F.coalesce("business_type", F.lit(""))), F.col("geography")
    page = r.isin("ARTICLE", "MEDIA", "DIRECTORY", "SOCIAL_POST")
    official = (r == "SELF") & (present(F.col("website")) | (urls.key_instagram(F.col("instagram")).isNotNull() & ~urls.is_social_post(F.col("instagram"))))
    context = (
        F.when(r.isin("ARTICLE", "MEDIA"), "MEDIA").when(r == "DIRECTORY", "DIRECTORY").when(F.col("__hotel"), "HOTEL_RESORT_BOUTIQUE").when(kind.isin("MARKETPLACE", "DESIGNER", "BRAND"), kind)
        .when(kind.isin("BOUTIQUE", "MULTI_DESIGNER", "MULTI_BRAND", "CONCEPT_STORE"), "INDEPENDENT_RETAIL").otherwise(UNKNOWN)
    )
    business = F.when(r.isin("SELF", "MENTIONED_BUSINESS") & named, "YES").otherwise("NO")
    quality = F.when((business == "NO") | page | (geo == "NO"), "REJECTED").when((r == "SELF") & official & (geo == "YES"), "HIGH").when((r == "SELF") & official, "MEDIUM").when(r == "SELF", "WEAK").otherwise("LOW")
    kept = (r == "SELF") & (business == "YES") & (geo == "YES") & official
    reason = F.when(kept, F.lit(None)).when(page, F.concat(F.lit("not_self_business:"), r)).when(geo == "NO", "wrong_geography").when(~official, "official_identity_weak").otherwise("entity_quality_insufficient")
    return out.withColumns({"business_context": context, "is_business": business, "entity_quality": quality, "excluded": ~F.coalesce(kept, F.lit(False)), "exclude_reason": reason}).drop("__media", "__post", "__hotel")
