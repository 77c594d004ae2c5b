"""Sitemaps: which documents to read, in which order, and the pages of a site they list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .enrich import sitemap_locations
from .ordered import top_k

# --- fixed values: what tells a page about the business, and documents that don't ---
RELEVANT_TOKENS = ("contact", "about", "store", "stores", "location", "locations", "find-us", "findus", "visit", "visit-us", "shop", "boutique", "showroom", "pages", "our-story")
GOODS_PATHS = ("/product", "/collection", "/category", "/item")
SKIPPED_DOCUMENTS = ("product", "collection", "category", "image", "asset", "blog", "post")
LIKED_DOCUMENTS = ("page", "contact", "store", "location", "about", "static")
MAX_SEEDS, MAX_CHILDREN, ENOUGH_RELEVANT, MAX_LOCATIONS = 3, 5, 3, 2000


def _any_in(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def relevant(url: Column) -> Column:
    """Whether a listed page may tell about the business; pages of goods don't."""
    path = F.lower(urls.path(url))
    return F.coalesce(_any_in(path, RELEVANT_TOKENS) & ~_any_in(path, GOODS_PATHS), F.lit(False))


def child_priority(url: Column) -> Column:
    """0 for documents of goods, images and posts, 10 for each word that tells of the business, else 1."""
    low = F.lower(url)
    points = sum((F.when(F.contains(low, F.lit(t)), 10).otherwise(0) for t in LIKED_DOCUMENTS), F.lit(0))
    return F.when(_any_in(low, SKIPPED_DOCUMENTS), 0).when(points > 0, points).otherwise(1)


def seeds_of(robots: DataFrame) -> DataFrame:
    """(site, doc_url, ord) of robots files (site, text): up to three documents of the own site that they name."""
    named = robots.select("site", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)).alias("ord", "doc_url"))
    own = named.where(urls.same_site(F.col("doc_url"), F.col("site"))).withColumn("key", F.coalesce(urls.normalize(F.col("doc_url")), F.col("doc_url")))
    once = top_k(own, ["site", "key"], ["ord"], 1).drop("rank")
    return top_k(once, ["site"], ["ord"], MAX_SEEDS).select("site", "doc_url", "ord")


def children(seeds: DataFrame, parsed: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """The documents to read of the indexes among parsed seeds, by order of index and priority: MAX_CHILDREN a site, less those it has used (site, used) already."""
    listed = seeds.join(parsed.where("kind = 'index'"), ["site", "doc_url"]).select("site", "ord", F.posexplode("locs").alias("pos", "doc_url"))
    ranked = listed.where(urls.same_site(F.col("doc_url"), F.col("site"))).withColumn("priority", child_priority(F.col("doc_url")))
    tried = top_k(ranked, ["site"], ["ord", F.desc("priority"), "pos"], MAX_CHILDREN)
    if used is not None:
        tried = tried.join(used, "site", "left").where(F.col("rank") <= MAX_CHILDREN - F.coalesce("used", F.lit(0))).drop("used")
    return tried


def locations(seeds: DataFrame, documents: DataFrame) -> DataFrame:
    """(site, position, url) of the pages that a site's sitemaps list, distinct by normal form, up to MAX_LOCATIONS a site.

    seeds: (site, doc_url, ord); documents: fetched (site, doc_url, xml). Indexes
    are followed once: their children in order of priority, five a site at most,
    failed ones included; children of low priority only while nothing relevant
    is listed. Reading stops once ENOUGH_RELEVANT relevant pages are listed.
    The stop rule runs over at most eight documents of a site, as running
    counts; no site is one task.
    """
    parsed = sitemap_locations(documents)
    counted = parsed.withColumn("n_relevant", F.size(F.array_distinct(F.filter("locs", relevant))))
    first = seeds.join(counted, ["site", "doc_url"]).where("kind <> 'invalid'")
    plain = first.where("kind = 'urlset'").select("site", F.struct(F.col("ord").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("at"), F.lit(None).cast("int").alias("priority"), "locs", "n_relevant")
    below = children(seeds, parsed).join(counted.where("kind = 'urlset'"), ["site", "doc_url"])
    below = below.select("site", F.struct(F.col("ord").alias("a"), (1000 - F.col("priority")).alias("b"), F.col("pos").alias("c")).alias("at"), "priority", "locs", "n_relevant")
    # at most three seeds and five children of a site: a short list, folded in order
    docs = plain.unionByName(below).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("at", "priority", "locs", "n_relevant"))).alias("docs"))
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<string>").alias("locs"))

    def step(acc: Column, d: Column) -> Column:
        idle = (acc["seen"] >= ENOUGH_RELEVANT) | F.coalesce((d["priority"] <= 1) & (acc["seen"] > 0), F.lit(False))
        return F.when(idle, acc).otherwise(F.struct((acc["seen"] + d["n_relevant"]).alias("seen"), F.concat(acc["locs"], d["locs"]).alias("locs")))

    read = docs.select("site", F.aggregate("docs", start, step, lambda acc: acc["locs"]).alias("locs"))
    own = F.filter("locs", lambda u: urls.same_site(u, F.col("site")))
    normal = F.array_distinct(F.transform(own, lambda u: F.coalesce(urls.normalize(u), F.rtrim(u))))
    return read.select("site", F.posexplode(F.slice(normal, 1, MAX_LOCATIONS)).alias("position", "url"))
