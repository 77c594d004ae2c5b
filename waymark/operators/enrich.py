"""Site enrichment over offline page tables: page roles, scores, the few best URLs of each site, combined evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import rules, urls
from ..functions.text import haystack, mentions
from .ordered import top_k
from .signals import choose_name, name_candidates


def _token(text: Column, tokens: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike(r"(?i)(?:^|[^a-z0-9])(?:" + "|".join(tokens) + r")(?:[^a-z0-9]|$)"), F.lit(False))


def page_role(url: Column, root: Column) -> Column:
    """homepage, contact, location, about, business, fashion or other."""
    place = F.concat_ws("?", urls.path(url), urls.part(url, 5))
    home = (urls.normalize(url) == urls.normalize(root)) | (F.regexp_replace(urls.path(url), "/", "").isin("", "index", "index.html", "home") & (urls.domain(url) == urls.domain(root)))
    out = F.when(F.coalesce(home, F.lit(False)), "homepage")
    for role, tokens in P.PAGE_ROLES:
        out = out.when(_token(place, tokens), role)
    return out.otherwise("other")


def usable(url: Column, root: Column, anchor: Column) -> Column:
    """Whether a link may lead to a page about the business: same site, no query, file, shop or account page."""
    segments = F.filter(F.split(F.lower(urls.path(url)), "/"), lambda x: x != "")
    bad = F.arrays_overlap(segments, F.array(*map(F.lit, P.REJECT_SEGMENTS))) | urls.path(url).rlike(P.ASSET) | (urls.part(url, 5) != "") | F.lower(F.btrim(F.coalesce(anchor, F.lit("")))).isin(*P.REJECT_ANCHORS)
    return F.coalesce(urls.same_site(url, root) & ~bad & (F.size(segments) > 0), F.lit(False))


def city_of(url: Column) -> Column:
    """The longest city name in a URL's path, quarters of cities left out; null without any."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(urls.path(url)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    names = sorted((c for c in rules.CITY_NAMES if c not in P.AREAS), key=lambda c: (-len(c), rules.CITY_NAMES.index(c)))
    return F.coalesce(*[F.when(F.contains(spaced, F.lit(f" {c.lower()} ")), c) for c in names])


def page_score(url: Column, root: Column, anchor: Column) -> Column:
    """0 for links not to follow, else how likely they tell about the business.

    Under the page of one city a page of another city isn't followed, nor one of
    a place that names none and is no general list of shops.
    """
    text = F.lower(F.concat_ws(" ", urls.path(url), anchor))
    here, there = city_of(root), city_of(url)
    segments = F.filter(F.split(F.lower(urls.path(url)), "/"), lambda x: x != "")
    general = (F.size(segments) > 0) & F.forall(segments, lambda x: x.isin(*P.LOCATION_PATHS))
    elsewhere = here.isNotNull() & F.when(there.isNotNull(), here != there).otherwise(_token(text, dict(P.PAGE_ROLES)["location"]) & ~general)
    out = F.when(~usable(url, root, anchor) | F.coalesce(elsewhere, F.lit(False)), 0)
    for tokens, points in P.PAGE_SCORES:
        out = out.when(_token(text, tokens), points)
    goods = text.rlike(r"\b(?:dress|dresses|top|tops|sale|new|product)\b")
    return out.when(_token(text, P.PAGE_ROLES[-1][1]) & ~goods, 40).when(text.rlike(r"\bshop\b") & ~goods, 20).otherwise(0)


def select_pages(links: DataFrame, limit: int = P.MAX_PAGES, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Of links (root, url, anchor, source) the best few of each root: wanted roles, high scores, then score, source and URL."""
    scored = links.withColumns({"target": urls.normalize(F.col("url")), "score": page_score(F.col("url"), F.col("root"), F.col("anchor")), "role": page_role(F.col("url"), F.col("root"))})
    rank = F.coalesce(*[F.when(F.col("source") == k, v) for k, v in P.SOURCE_RANKS], F.lit(9))
    good = scored.where("score > 0 AND target IS NOT NULL").withColumn("source_rank", rank)
    best = top_k(good, ["root", "target"], [F.desc("score"), "source_rank"], 1).drop("rank")
    liked = F.col("role").isin(*wanted) if wanted else F.lit(True)
    order = [liked.cast("int").desc(), (F.col("score") >= P.HIGH_PAGE).cast("int").desc(), F.desc("score"), "source_rank", "target"]
    return top_k(best, ["root"], order, limit).select("root", F.col("target").alias("url"), "role", "score", "source", "rank")


NEEDS = ("name_ok", "type_ok", "women_ok", "physical_ok", "city_ok", "contact_ok")


def need(df: DataFrame) -> DataFrame:
    """df (the flags of NEEDS) with tier STRONG, PARTIAL or WEAK, the roles worth fetching, and why."""
    no = {f: ~F.coalesce(F.col(f), F.lit(False)) for f in NEEDS}
    missing = sum((v.cast("int") for v in no.values()), F.lit(0))
    place, identity, kind = no["physical_ok"] | no["city_ok"], no["name_ok"] | no["type_ok"], no["women_ok"] | no["type_ok"]
    wanted = F.array_compact(F.array(F.when(no["contact_ok"], F.lit("contact")), F.when(place, F.lit("location")), F.when(identity | kind, F.lit("about")), F.when(kind, F.lit("fashion"))))
    why = F.array_compact(
        F.array(
            F.when(no["contact_ok"], F.lit("missing_contact")), F.when(no["physical_ok"], F.lit("missing_location")).when(no["city_ok"], F.lit("missing_city")),
            F.when(no["name_ok"], F.lit("missing_identity")).when(no["type_ok"], F.lit("missing_type")), F.when(no["women_ok"], F.lit("missing_women")),
        )
    )
    everything = F.array(*map(F.lit, ("contact", "location", "about", "business", "fashion")))
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "tier": F.when(missing == 0, "STRONG").when(missing >= 3, "WEAK").otherwise("PARTIAL"), "wanted_roles": F.when(missing == 0, none).when(missing >= 3, everything).otherwise(wanted),
            "need_reasons": F.when(missing == 0, F.array(F.lit("complete"))).otherwise(why),
        }
    )


def assess_need(pages: DataFrame) -> DataFrame:
    """need() of homepages, by their evidence and signals.

    pages: id, title, meta_description, og_site_name, meta_brand, headings,
    facts, text, search_title, emails, phones, social_urls, address_candidates,
    city_mentions.
    """
    hay = haystack("title", "meta_description", F.array_join("headings", " "), "text")
    names = choose_name(name_candidates(pages.withColumn("role", F.lit("homepage"))))
    sure = names.where(F.col("confidence").isin("HIGH", "MEDIUM") & (F.col("source") != "search_title")).select(F.col("id").alias("__id"))
    types = F.transform("facts", lambda f: F.lower(F.coalesce(f["schema_type"], F.lit(""))))
    localities = F.array_distinct(F.transform(F.filter("facts", lambda f: f["field"].isin("city", "addressLocality")), lambda f: F.lower(f["value"])))
    in_address = mentions(F.array_join("address_candidates", " "), rules.CITY_NAMES)
    cities = F.when(F.size(in_address) > 0, in_address).otherwise(F.col("city_mentions"))
    has_address = F.size("address_candidates") > 0
    pin = F.exists("address_candidates", lambda a: a.rlike(P.PIN_CODE))
    flags = {
        "name_ok": F.col("__id").isNotNull(),
        "type_ok": hay.rlike(P.BOUTIQUE) | hay.rlike(P.STORE) | F.arrays_overlap(types, F.array(*map(F.lit, P.RETAIL_TYPES))) | F.exists("facts", lambda f: f["source"] == "jsonld_localbusiness"),
        "women_ok": hay.rlike(P.HOME_WOMEN) | (F.regexp_count(hay, F.lit(P.HOME_GOODS)) >= 2),
        "physical_ok": hay.rlike(P.ONLINE_ONLY) | F.arrays_overlap(types, F.array(*map(F.lit, P.STORE_TYPES))) | F.exists("facts", lambda f: f["field"] == "address") | (has_address & (pin | hay.rlike(P.HOME_VISIT))),
        "city_ok": (F.size(localities) == 1) | (F.size(cities) == 1),
        "contact_ok": (F.size("emails") > 0) | (F.size("phones") > 0) | F.exists("social_urls", lambda u: F.contains(F.lower(u), F.lit("instagram.com"))),
    }
    return need(pages.join(sure, F.col("id") == F.col("__id"), "left").withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).drop("__id"))


def combine_pages(pages: DataFrame, text_chars: int = 50_000) -> DataFrame:
    """One row for each root of pages (root, url, role, text, headings): homepage first, then by role; lists united, text cut."""
    ranks = {"homepage": 0, "contact": 1, "location": 2, "about": 3, "business": 4, "fashion": 5}
    rank = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in ranks.items()], F.lit(9))
    row = F.struct(rank.alias("o"), F.col("url").alias("u"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("headings").alias("h"))
    grouped = pages.groupBy("root").agg(F.sort_array(F.collect_list(row)).alias("p"))
    return grouped.select(
        "root", F.transform("p", lambda x: x["u"]).alias("urls"), F.transform("p", lambda x: x["r"]).alias("page_roles"),
        F.substring(F.array_join(F.transform("p", lambda x: x["t"]), " "), 1, text_chars).alias("text"), F.slice(F.array_distinct(F.flatten(F.transform("p", lambda x: x["h"]))), 1, 40).alias("headings"),
    )


def sitemap_locations(docs: DataFrame) -> DataFrame:
    """(site, doc_url, kind, locs) of sitemap documents (site, doc_url, xml), with all that they list; what is no sitemap has kind invalid."""
    body = F.coalesce("xml", F.lit(""))
    kind = F.when(body.rlike(r"(?is)<sitemapindex[\s>].*</sitemapindex>"), "index").when(body.rlike(r"(?is)<urlset[\s>].*</urlset>"), "urlset").otherwise("invalid")
    locs = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return docs.select("site", "doc_url", kind.alias("kind"), F.when(kind == "invalid", F.array().cast("array<string>")).otherwise(F.array_distinct(locs)).alias("locs"))
