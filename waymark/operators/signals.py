"""Contact signals, best names and best facts of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions import text as T
from ..functions.text import let, ordered_distinct
from .ordered import best

# --- fixed values: how far sources of names and facts are trusted -------------
NAME_RANKS = (
    ("jsonld_organization", 100, "HIGH"), ("jsonld_localbusiness", 95, "HIGH"), ("jsonld_website", 90, "HIGH"), ("og_site_name", 80, "HIGH"),
    ("meta_brand", 75, "MEDIUM"), ("homepage_h1", 60, "MEDIUM"), ("about_page_heading", 58, "MEDIUM"), ("about_page_title", 55, "MEDIUM"),
    ("homepage_title", 50, "MEDIUM"), ("page_title", 48, "MEDIUM"), ("heading", 45, "MEDIUM"), ("contact_page_heading", 40, "LOW"),
    ("store_page_heading", 40, "LOW"), ("contact_page_title", 35, "LOW"), ("store_page_title", 35, "LOW"), ("search_title", 20, "LOW"),
)
FACT_RANKS = (
    ("jsonld_localbusiness", 100), ("jsonld_organization", 95), ("jsonld_website", 90), ("jsonld_postaladdress", 88), ("jsonld_contactpoint", 86),
    ("og_site_name", 80), ("meta_brand", 78), ("contact_page", 70), ("location_page", 70), ("about_page", 65), ("homepage_text", 50),
    ("homepage_h1", 48), ("homepage_title", 40), ("search_title", 20), ("search_snippet", 18),
)
CONFIDENCE_RANKS = (("HIGH", 3), ("MEDIUM", 2), ("LOW", 1))
PAGE_SOURCES = {"homepage": ("homepage_h1", "homepage_title"), "about": ("about_page_heading", "about_page_title"), "contact": ("contact_page_heading", "contact_page_title"), "location": ("store_page_heading", "store_page_title")}
SOCIAL_URL = r"(?i)https?://(?:www\.)?(?:instagram|facebook|fb)\.com/[^\s<>\"']+"
WHATSAPP_URL = r"(?i)https?://(?:wa\.me|api\.whatsapp\.com|www\.whatsapp\.com)/[^\s<>\"']+"
STREET = r"(?i)\b[0-9]{1,4}[^.]{0,50}\b(?:road|rd|street|st|marg|lane|nagar)\b[^.]{0,30}"
HANDLES_SKIPPED = ("p", "reel", "reels", "stories", "explore", "watch", "share", "sharer", "posts", "photos", "videos", "story", "pages", "people", "groups", "login", "signup")


def _rank(source: Column, ranks) -> Column:
    return F.coalesce(*[F.when(source == r[0], r[1]) for r in ranks], F.lit(0))


def _found_urls(text: Column, pattern: str) -> Column:
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))
    return F.filter(F.transform(trimmed, urls.normalize), lambda u: u.isNotNull())


def business_signals(pages: DataFrame, limit: int = rules.MAX_SIGNALS) -> DataFrame:
    """pages (text, links) with six arrays: emails, phones, social_urls, whatsapp_urls, address_candidates, city_mentions."""
    targets = F.transform("links", lambda l: l["url"])
    social = F.filter(targets, lambda u: urls.in_catalog(urls.domain(u), rules.SOCIAL_DOMAINS))
    whatsapp = F.filter(targets, lambda u: F.contains(F.lower(u), F.lit("wa.me")) | F.contains(F.lower(u), F.lit("whatsapp")))
    text = F.col("text")
    return pages.withColumns(
        {
            "emails": ordered_distinct(T.emails(text), limit), "phones": ordered_distinct(T.phones(text), limit),
            "social_urls": ordered_distinct(F.concat(F.transform(social, urls.normalize), _found_urls(text, SOCIAL_URL)), limit),
            "whatsapp_urls": ordered_distinct(F.concat(whatsapp, _found_urls(text, WHATSAPP_URL)), limit),
            "address_candidates": ordered_distinct(T.addresses(text), limit), "city_mentions": T.mentions(text, rules.CITY_NAMES),
        }
    )


def social_handle(url: Column) -> Column:
    """First path segment of a profile URL, null for posts and site pages."""
    first = F.regexp_extract(urls.path(url), "^/([^/]+)", 1)
    return F.when((first != "") & ~F.lower(first).isin(*HANDLES_SKIPPED) & ~F.startswith(F.lower(first), F.lit("profile.php")), first)


def snippet_address(text: Column, pin: str = r"\b[1-9][0-9]{5}\b") -> Column:
    """The street address in a snippet, or up to 40 characters before a postal code; null without either."""
    street = F.regexp_extract(text, f"({STREET})", 1)
    near = F.regexp_extract(text, rf"(?s)(.{{0,40}}{pin})", 1)
    return F.nullif(F.regexp_replace(T.squeeze(F.when(street != "", street).otherwise(near)), r"^[ ,.;]+|[ ,.;]+$", ""), F.lit(""))


def keyword_windows(text: Column, keyword: str, before: int = 160, after: int = 220, most: int = 1500) -> Column:
    """Windows around a keyword's matches, trimmed and joined by dots, until they hold so many characters; the text's start if there is none.

    Matches are wrapped in a private-use mark and their places summed up; the
    pattern must not match the empty string. Windows of matches beyond the
    limit are never cut.
    """
    mark, stand_in = "\ue000", "\ue001"
    clean = F.translate(text, mark, stand_in)

    def excerpt(t: Column, pieces: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            a = acc["at"] + F.length(F.get(pieces, i * 2))
            b = a + F.length(F.get(pieces, i * 2 + 1))
            low = F.greatest(F.lit(0), a - before)
            window = F.regexp_replace(F.substring(t, low + 1, b + after - low), r"^\s+|\s+$", "")
            more = F.struct(b.alias("at"), (acc["total"] + F.length(window) + F.when(F.size(acc["out"]) > 0, 1).otherwise(0)).alias("total"), F.array_append(acc["out"], window).alias("out"))
            return F.when(acc["total"] >= most, acc).otherwise(more)

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("total"), F.array().cast("array<string>").alias("out"))
        pairs = F.floor((F.size(pieces) - 1) / 2).cast("int")
        windows = F.when(pairs > 0, F.aggregate(F.sequence(F.lit(0), pairs - 1), start, step, lambda acc: acc["out"]))
        joined = F.coalesce(F.array_join(windows, " … "), t)
        return let(joined, lambda x: F.substring(F.when((F.length(x) < 400) & (t != ""), F.when(x != "", F.concat_ws("\n", x, t)).otherwise(t)).otherwise(x), 1, most))

    marked = F.regexp_replace(clean, F.lit(f"({keyword})"), F.lit(f"{mark}$1{mark}"))
    return F.when(text.isNotNull(), let(clean, lambda t: let(F.split(marked, mark), lambda pieces: excerpt(t, pieces))))


def contextual_name(raw: Column, role: Column) -> Column:
    """A heading's name without "About" or "Contact us" in front, left of a colon on pages about the business."""
    about = F.regexp_replace(raw, r"(?i)^\s*about(?:\s+us)?\s*[:\-–—]?\s+", "")
    left = F.btrim(F.substring_index(about, ":", 1))
    short = F.when(F.contains(about, F.lit(":")) & (T.n_parts(left) <= 6) & (T.clean_name(left) != T.UNKNOWN), left).otherwise(about)
    contact = F.regexp_replace(raw, r"(?i)^\s*contact(?:\s+us)?\s*[:\-–—]?\s+", "")
    return T.clean_name(F.when(role == "about", short).when(role == "contact", contact).otherwise(raw))


def name_candidates(pages: DataFrame) -> DataFrame:
    """(id, name, source, confidence, rank, ord) of pages (id, role, facts, og_site_name, meta_brand, headings, title, search_title), in order of appearance."""
    role = F.col("role")

    def source(i: int) -> Column:
        return F.coalesce(*[F.when(role == r, s[i]) for r, s in PAGE_SOURCES.items()], F.lit(("heading", "page_title")[i]))

    def given(raw: Column, src: Column) -> Column:
        return F.struct(raw.alias("raw"), src.alias("source"))

    facts = F.transform(F.filter("facts", lambda f: f["field"] == "name"), lambda f: given(f["value"], f["source"]))
    search = F.when(F.coalesce(F.btrim("search_title") != F.btrim(F.coalesce("title", F.lit(""))), F.lit(False)), F.col("search_title"))
    chrome = F.array(given(F.col("og_site_name"), F.lit("og_site_name")), given(F.col("meta_brand"), F.lit("meta_brand")), given(F.get("headings", F.lit(0)), source(0)), given(F.col("title"), source(1)), given(search, F.lit("search_title")))
    rows = pages.select("id", "role", F.posexplode(F.concat(facts, chrome)).alias("ord", "n")).where("n.raw IS NOT NULL")
    named = rows.select("id", "ord", contextual_name(F.col("n.raw"), F.col("role")).alias("name"), F.col("n.source").alias("source")).where(F.col("name") != T.UNKNOWN)
    confidence = F.coalesce(*[F.when(F.col("source") == s, c) for s, _, c in NAME_RANKS], F.lit("LOW"))
    return named.withColumns({"confidence": confidence, "rank": _rank(F.col("source"), NAME_RANKS)})


def choose_name(candidates: DataFrame, id_col: str = "id") -> DataFrame:
    """The most trusted name of each id, the first of equals."""
    ranks = (F.col("rank"), _rank(F.col("confidence"), CONFIDENCE_RANKS), F.startswith("source", F.lit("jsonld_")).cast("int"), -F.col("ord"))
    return candidates.groupBy(id_col).agg(best(F.struct("name", "source", "confidence"), *ranks).alias("b")).select(id_col, "b.*")


def best_facts(facts: DataFrame, id_col: str = "id") -> DataFrame:
    """The strongest fact of each field (id, field, value, source, confidence, ord), the first of equals."""
    ranks = (_rank(F.col("source"), FACT_RANKS), _rank(F.col("confidence"), CONFIDENCE_RANKS), -F.col("ord"))
    return facts.groupBy(id_col, "field").agg(best(F.struct("value", "source", "confidence"), *ranks).alias("b")).select(id_col, "field", "b.*")


#: Fields of facts that count as evidence, and most rows of evidence of a business.
EVIDENCE_FIELDS, MAX_EVIDENCE = ("telephone", "email", "sameAs", "url", "addressLocality", "addressRegion", "physical_store"), 24


def field_evidence(rows: DataFrame) -> DataFrame:
    """(id, place, field, value, source, evidence, confidence): what each field of a business rests on, at most 24 rows.

    rows: id, name, name_source, name_confidence, given (array of evidence of
    chosen fields, may be null) and facts. The name comes first, then given
    evidence, then facts that repeat none of it.
    """
    kind = "struct<field:string,value:string,source:string,evidence:string,confidence:string>"
    none = F.array().cast(f"array<{kind}>")
    named = F.struct(F.lit("name").alias("field"), F.col("name").alias("value"), F.col("name_source").alias("source"), F.col("name").alias("evidence"), F.col("name_confidence").alias("confidence"))
    first = F.concat(F.when(T.present(F.col("name")), F.array(named)).otherwise(none), F.coalesce(F.col("given").cast(f"array<{kind}>"), none))
    facts = F.transform(F.filter(F.coalesce("facts", F.array()), lambda f: f["field"].isin(*EVIDENCE_FIELDS)), lambda f: F.struct(*[f[c].alias(c) for c in ("field", "value", "source", "evidence", "confidence")])).cast(f"array<{kind}>")
    each = rows.select("id", F.size(first).alias("n_first"), F.posexplode(F.concat(first, facts)).alias("at", "e")).select("id", "n_first", "at", "e.*")
    # chosen fields all stay; a fact goes if its field, source and value have been seen
    before = Window.partitionBy("id", "field", "source", "value").orderBy("at")
    new = each.withColumn("n", F.row_number().over(before)).where("at < n_first OR n = 1")
    ranked = new.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    return ranked.where((F.col("place") <= MAX_EVIDENCE) | (F.col("at") < F.col("n_first"))).select("id", "place", "field", "value", "source", "evidence", "confidence")
