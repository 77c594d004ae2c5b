"""Following links of candidates' sites: a frontier of tables, one wave of requests after the other.

From each website candidate's homepage to at most three more pages of its site:
what the homepage lacks decides which roles are wanted, its links are scored, and
only where they don't cover the wanted roles the site's sitemaps are asked. Each
wave is one table of distinct URLs for all sites at once; ``Visited`` keeps
what has been asked, so that no URL is asked twice however many candidates
lead to it, and every answer is a written table.

A fetcher is a function of a table (url, allow_xml) to a table (url, final_url,
html, error): ``from_table`` answers from stored pages, ``from_web`` asks
politely by host.

Defined cases: candidates that are no websites, or whose URL is null or no
web address, aren't followed; a homepage that can't be had ends its site's
crawl, another page that can't be had or whose redirects leave the site is a row that
says so; pages without links, sitemaps that are none, and empty tables give no more pages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import rules, urls
from ..sources.pages import MAX_HEADINGS, MAX_LINKS, MAX_TEXT, fetch, page_evidence
from . import sitemaps
from .enrich import assess_need, page_role, page_score
from .graph import written
from .ordered import top_k
from .signals import business_signals, choose_name, name_candidates

Fetcher = Callable[[DataFrame], DataFrame]
ANSWER = ("url", "final_url", "html", "error")
#: Roles that a sitemap is asked for.
SOUGHT = ("contact", "location", "about")
#: Order of pages in combined evidence; the homepage's own fields still come first.
ROLE_RANKS = {"contact": 0, "location": 1, "about": 2, "business": 3, "fashion": 4, "homepage": 5, "other": 6}
SIGNALS = ("emails", "phones", "social_urls", "whatsapp_urls", "address_candidates", "city_mentions")
#: Where sitemaps are looked for if the robots file names none, in order.
FALLBACKS = (("/sitemap.xml", "sitemap"), ("/sitemap_index.xml", "sitemap_index"))


def from_table(pages: DataFrame) -> Fetcher:
    """Answers from a table of pages (url, html, and final_url where they were redirected), met by normal URL or, where it has none, as it is."""
    final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    key = F.coalesce(urls.normalize(F.col("url")), F.col("url"))
    known = pages.where("url IS NOT NULL AND html IS NOT NULL").select(key.alias("__key"), final.alias("final_url"), "html", "url")
    known = known.groupBy("__key").agg(F.min_by(F.struct("final_url", "html"), "url").alias("__p"))

    def get(targets: DataFrame) -> DataFrame:
        asked = targets.withColumn("__key", F.coalesce(urls.normalize(F.col("url")), F.col("url")))
        return asked.join(known, "__key", "left").select("url", "__p.final_url", "__p.html", F.when(F.col("__p").isNull(), "not found").alias("error"))

    return get


def from_web(get: Callable[[str], tuple], **options) -> Fetcher:
    """Answers from the web by sources.pages.fetch: robots obeyed, a pause between requests to one host."""

    def ask(targets: DataFrame) -> DataFrame:
        pages = fetch(targets.where("NOT allow_xml"), get, **options).unionByName(fetch(targets.where("allow_xml"), get, **options, allow_xml=True))
        return pages.select(*ANSWER)

    return ask


class Visited:
    """URLs asked so far and their answers."""

    def __init__(self, get: Fetcher):
        self.get, self.waves = get, []

    def ask(self, targets: DataFrame, allow_xml: bool = False) -> DataFrame:
        """Answers for targets (url), of this and all earlier waves; only what is new is asked."""
        new = targets.where("url IS NOT NULL").select("url").distinct()
        for wave in self.waves:
            new = new.join(wave.select("url"), "url", "left_anti")
        self.waves.append(written(self.get(new.withColumn("allow_xml", F.lit(allow_xml))).select(*ANSWER)))
        return self.answers()

    def answers(self) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), self.waves)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def choose_pages(links: DataFrame, limit: int = P.MAX_PAGES) -> DataFrame:
    """(seq, url, role, score, source, place): of links (seq, root, url, anchor, source, ord, wanted, strict) the best few pages of each candidate.

    A page takes the score of its first link that leads anywhere, links of the
    homepage before those of sitemaps. Pages of high score come first, then those of wanted roles,
    then by score, source and URL; a strict candidate takes wanted roles only.
    """
    target = F.coalesce(urls.normalize(F.col("url")), F.rtrim("url", F.lit("/")))
    scored = links.withColumns({"target": target, "score": page_score(F.col("url"), F.col("root"), F.col("anchor"))})
    rank = F.coalesce(*[F.when(F.col("source") == k, v) for k, v in P.SOURCE_RANKS], F.lit(9))
    leads = (F.col("score") > 0) & (F.col("target") != F.coalesce(urls.normalize(F.col("root")), F.lit("")))
    good = scored.where(leads).withColumns({"source_rank": rank, "role": page_role(F.col("target"), F.col("root"))})
    first = top_k(good, ["seq", "target"], [(F.col("source") != "homepage_link").cast("int"), "ord"], 1).drop("rank")
    liked = F.arrays_overlap("wanted", F.array("role"))
    allowed = first.where(liked | ~F.col("strict") | (F.size("wanted") == 0))
    order = [(F.col("score") >= P.HIGH_PAGE).cast("int").desc(), F.coalesce(liked, F.lit(False)).cast("int").desc(), F.desc("score"), "source_rank", "target"]
    return top_k(allowed, ["seq"], order, limit).select("seq", F.col("target").alias("url"), "role", "score", "source", F.col("rank").alias("place"))


def uncovered(sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of sites (seq, wanted, ...) those whose chosen pages leave a wanted role open that a sitemap may fill, or that have none at all."""
    have = chosen.groupBy(F.col("seq").alias("__seq")).agg(F.collect_set("role").alias("__have"))
    needed = F.array_intersect("wanted", F.array(*map(F.lit, SOUGHT)))
    open_ = F.when(F.size(needed) == 0, F.col("__have").isNull()).otherwise(F.size(F.array_except(needed, F.coalesce("__have", F.array().cast("array<string>")))) > 0)
    return sites.join(have, F.col("seq") == F.col("__seq"), "left").where(open_).drop("__seq", "__have")


def site_maps(visited: Visited, sites: DataFrame) -> DataFrame:
    """(site, position, url, source): pages that the sitemaps of sites (site) list, asked as far as needed.

    Documents that the robots file names are asked first, then the usual
    places one after the other, each only for sites that have nothing yet; of an index
    five children a site are asked in all, failing ones included.
    """
    sites = sites.select("site", origin(F.col("site")).alias("origin")).where("origin <> ''").distinct()
    robots = visited.ask(sites.select(F.concat("origin", F.lit("/robots.txt")).alias("url")))
    texts = sites.withColumn("url", F.concat("origin", F.lit("/robots.txt"))).join(robots, "url").select("site", F.col("html").alias("text"))
    named = written(sitemaps.seeds_of(texts))
    left = written(sites)
    used = None  # children asked so far
    out = []
    for seeds, label in [(named, "robots_sitemap"), *[(None, x) for x in FALLBACKS]]:
        if seeds is None:
            path, label = label
            seeds = left.select("site", F.concat("origin", F.lit(path)).alias("doc_url"), F.lit(0).alias("ord"))
        docs = visited.ask(seeds.select(F.col("doc_url").alias("url")), allow_xml=True)
        xml = seeds.join(docs, seeds.doc_url == docs.url).select("site", "doc_url", F.col("html").alias("xml"))
        indexes = sitemaps.sitemap_locations(xml).where("kind = 'index'").select("site", "doc_url")
        tried = sitemaps.children(seeds, sitemaps.sitemap_locations(xml), used)
        tried = written(tried.select("site", "doc_url"))
        below = visited.ask(tried.select(F.col("doc_url").alias("url")), allow_xml=True)
        child = tried.join(below, tried.doc_url == below.url).select("site", "doc_url", F.col("html").alias("xml"))
        found = written(sitemaps.locations(seeds, xml.unionByName(child).where("xml IS NOT NULL")).withColumn("source", F.lit(label)))
        out.append(found)
        used = tried.groupBy("site").agg(F.count(F.lit(1)).alias("used")) if used is None else used.unionByName(tried.groupBy("site").agg(F.count(F.lit(1)).alias("used"))).groupBy("site").agg(F.sum("used").alias("used"))
        ended = found.select("site").distinct()
        if label != "robots_sitemap":  # an index in the usual place is the last document
            ended = ended.unionByName(indexes.select("site")).distinct()
        left = written(left.join(ended, "site", "left_anti"))
    return reduce(lambda a, b: a.unionByName(b), out)


def enrich(found: DataFrame, get: Fetcher) -> dict[str, DataFrame]:
    """The crawl of website candidates found (seq, url, normalized_url, title, result_type).

    sites: one row a candidate followed: seq, root, site (after redirects), ok,
    tier, wanted, need_reasons, sitemap_asked, n_listed, sitemap_source.
    pages: seq, place (0 the homepage), url, final_url, role, source, error.
    evidence: one row a candidate whose homepage was had, of all its pages (see combined()).
    """
    visited = Visited(get)
    root = F.btrim(F.coalesce("normalized_url", "url"))
    web = found.where((F.col("result_type") == "WEBSITE") & root.rlike(r"^https?://[^/]")).select("seq", root.alias("root"), F.col("title").alias("search_title"))
    web = written(web)
    answers = visited.ask(web.select(F.col("root").alias("url")))
    first = web.join(answers, web.root == answers.url, "left").select("seq", "root", "search_title", F.coalesce("final_url", "root").alias("site"), "html", "error")
    first = written(first.withColumn("ok", F.coalesce(F.col("html") != "", F.lit(False))))

    parsed = written(page_evidence(first.where("ok").groupBy(F.col("site").alias("url")).agg(F.min("html").alias("html"))))
    homes = first.where("ok").drop("html").join(parsed.withColumnRenamed("url", "__url"), F.col("site") == F.col("__url")).drop("__url")
    needs = assess_need(business_signals(homes).withColumn("id", F.col("seq")))
    needs = written(needs.select("seq", "site", "tier", F.col("wanted_roles").alias("wanted"), "need_reasons", (F.col("tier") == "PARTIAL").alias("strict"), "links"))

    # what the homepage links to, then, for sites with open roles, what their sitemaps list
    open_ = needs.where("tier <> 'STRONG'")
    links = open_.select("seq", F.col("site").alias("root"), "wanted", "strict", F.posexplode("links").alias("ord", "l"))
    links = links.select("seq", "root", F.col("l.url").alias("url"), F.col("l.anchor_text").alias("anchor"), F.lit("homepage_link").alias("source"), "ord", "wanted", "strict")
    chosen = written(choose_pages(links))
    lacking = written(uncovered(open_.drop("links"), chosen))
    listed = written(site_maps(visited, lacking))
    more = lacking.select("seq", F.col("site").alias("root"), "wanted", "strict").join(listed.withColumnRenamed("site", "root"), "root")
    more = more.select("seq", "root", "url", F.lit("").alias("anchor"), "source", F.col("position").alias("ord"), "wanted", "strict")
    again = choose_pages(links.join(lacking.select("seq"), "seq", "left_semi").unionByName(more))
    chosen = written(chosen.join(lacking.select("seq"), "seq", "left_anti").unionByName(again))

    answers = visited.ask(chosen.select("url"))
    asked = chosen.join(answers, "url", "left").join(needs.select("seq", "site"), "seq")
    strayed = ~F.coalesce(urls.same_site(F.col("site"), F.coalesce("final_url", "url")), F.lit(False))
    error = F.coalesce("error", F.when(F.coalesce(F.col("html") == "", F.lit(True)), "empty").when(strayed, "other site"))
    asked = asked.select("seq", "place", "url", F.coalesce("final_url", "url").alias("final_url"), "role", "source", error.alias("error"), "html")
    homepage = first.select("seq", F.lit(0).alias("place"), F.col("root").alias("url"), F.col("site").alias("final_url"), F.lit("homepage").alias("role"), F.lit("candidate").alias("source"), F.when(~F.col("ok"), F.coalesce("error", F.lit("empty"))).alias("error"), "html")
    pages = written(homepage.unionByName(asked))

    counts = listed.groupBy(F.col("site").alias("__site")).agg(F.count(F.lit(1)).alias("n_listed"), F.min("source").alias("sitemap_source"))
    sites = first.select("seq", "root", "site", "ok").join(needs.drop("site", "links", "strict"), "seq", "left")
    sites = sites.join(lacking.select(F.col("seq").alias("__seq")), F.col("seq") == F.col("__seq"), "left").withColumn("sitemap_asked", F.col("__seq").isNotNull())
    sites = sites.join(counts, F.col("sitemap_asked") & (F.col("site") == F.col("__site")), "left").withColumn("n_listed", F.coalesce("n_listed", F.lit(0))).drop("__seq", "__site")
    had = pages.where("error IS NULL").join(web.select("seq", "root", "search_title"), "seq")
    return {"sites": sites, "pages": pages.drop("html"), "evidence": combined(had, pages)}


def combined(had: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a candidate: the evidence of all its pages had (seq, root, search_title, place, final_url, html), with what was asked.

    Texts and signals stand in order of roles, contact pages first; headings and
    links in order of pages. Brand fields and facts are the homepage's before others'.
    """
    parsed = page_evidence(had.groupBy(F.col("final_url").alias("url")).agg(F.min("html").alias("html")))
    each = had.drop("html").join(business_signals(parsed).withColumnRenamed("url", "__url"), F.col("final_url") == F.col("__url")).drop("__url")
    role = page_role(F.col("final_url"), F.col("root"))
    rank = F.coalesce(*[F.when(F.col("page_role") == k, v) for k, v in ROLE_RANKS.items()], F.lit(5))
    each = written(each.withColumn("page_role", role).withColumn("rank", rank))

    # at most four pages a candidate
    one = ("title", "meta_description", "og_site_name", "meta_brand", "text", "headings", "links", "facts", *SIGNALS)
    page = F.struct("rank", "place", "page_role", "final_url", *one)
    grouped = each.groupBy("seq").agg(F.sort_array(F.collect_list(page)).alias("by_role"), F.any_value("root").alias("root"))
    by_place = F.array_sort("by_role", lambda a, b: a["place"] - b["place"])
    grouped = grouped.withColumn("by_place", by_place).withColumn("home_first", F.concat(F.slice("by_place", 1, 1), F.col("by_role")))

    def first(of: str, field: str) -> Column:
        return F.get(F.filter(F.transform(of, lambda p: p[field]), lambda x: x.isNotNull() & (x != "")), F.lit(0))

    def joined(of: str, field: str) -> Column:
        return F.flatten(F.transform(of, lambda p: p[field]))

    def distinct_by(items: Column, key) -> Column:
        """The first of equal keys, in order."""
        keys = F.transform(items, key)
        return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)

    addresses = F.flatten(F.transform("by_role", lambda p: F.transform(p["address_candidates"], lambda a: F.struct(a.alias("address"), p["final_url"].alias("url"), p["page_role"].alias("role")))))
    out = grouped.select(
        "seq", first("by_role", "title").alias("title"), first("by_role", "meta_description").alias("meta_description"), first("home_first", "og_site_name").alias("og_site_name"), first("home_first", "meta_brand").alias("meta_brand"),
        F.substring(F.array_join(F.filter(F.transform("by_role", lambda p: p["text"]), lambda x: x != ""), "\n\n"), 1, MAX_TEXT * (P.MAX_PAGES + 1)).alias("text"),
        F.slice(joined("by_place", "headings"), 1, MAX_HEADINGS * (P.MAX_PAGES + 1)).alias("headings"),
        F.slice(distinct_by(joined("by_place", "links"), lambda x: F.coalesce(urls.normalize(x["url"]), x["url"])), 1, MAX_LINKS * 2).alias("links"),
        distinct_by(joined("home_first", "facts"), lambda x: F.concat_ws("\n", x["field"], x["source"], x["value"])).alias("facts"),
        *[F.slice(F.array_distinct(joined("by_role", c)), 1, rules.MAX_SIGNALS).alias(c) for c in SIGNALS],
        F.transform("by_place", lambda p: p["page_role"]).alias("page_roles"), addresses.alias("address_sources"),
    )
    named = each.select(F.struct("seq", "place").alias("page"), "seq", "place", "page_role", "facts", "og_site_name", "meta_brand", "headings", "title", F.when(F.col("place") == 0, F.col("search_title")).alias("search_title"))
    found = name_candidates(named.withColumn("id", F.col("page")).withColumn("role", F.when(F.col("place") == 0, "homepage").otherwise(F.col("page_role"))))
    names = choose_name(found.withColumns({"seq": F.col("id.seq"), "ord": F.col("id.place") * 1000 + F.col("ord")}), "seq")
    tried = pages.groupBy("seq").agg(
        F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("place", F.col("final_url").alias("u"))))).alias("had"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("place", F.col("url").alias("u"))))).alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", F.struct("url", "source").alias("u"))))).alias("selected"),
    )
    tried = tried.select(F.col("seq").alias("__t"), *[F.transform(a, lambda x: x["u"]).alias(b) for a, b in (("had", "successful_urls"), ("failed", "failed_urls"), ("selected", "selected_url_sources"))])
    names = names.select(F.col("seq").alias("__n"), "name", F.col("source").alias("name_source"), F.col("confidence").alias("name_confidence"))
    return out.join(names, F.col("seq") == F.col("__n"), "left").join(tried, F.col("seq") == F.col("__t"), "left").drop("__n", "__t")
