"""The run from candidates to scored and merged businesses, and its reports.

candidates -> pages (or empty evidence where a page is blocked) -> further pages
of their sites, if a fetcher is given -> businesses ->
search context -> relationship, lead gate and fit -> merges -> counts. Every
step is a table; shuffles are the join with pages by URL and the merges by key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import UNKNOWN, haystack, present
from ..sources.pages import FACT, LINK, page_evidence
from . import candidates as C
from . import classify, crawl, geo, identify, lead, model_step, score, signals
from .crawl import SIGNALS
from .enrich import page_role
from .graph import written
from .resolve import fold, merge_by_first_key, merge_same_name

EMPTY = {"meta_description": "string", "text": "string", "headings": "array<string>", "links": f"array<{LINK}>", "og_site_name": "string", "meta_brand": "string", "facts": f"array<{FACT}>"}


def inspect(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates (seq, url, normalized_url, title, result_type) with the evidence of their page, met by normal URL.

    A candidate without a page keeps its title and gets empty evidence, and a
    blocked social page keeps its URL as a signal; ``fetched`` tells them apart.
    """
    evidence = page_evidence(pages.where("html IS NOT NULL")).withColumn("__key", urls.normalize(F.col("url"))).where("__key IS NOT NULL")
    one = evidence.groupBy("__key").agg(F.min_by(F.struct("title", *EMPTY), "url").alias("__e"))
    kept = found.withColumnRenamed("title", "search_title")
    joined = kept.join(one, F.col("normalized_url") == F.col("__key"), "left")
    got = F.col("__key").isNotNull()

    def field(name: str, kind: str) -> Column:
        empty = F.lit("") if kind == "string" and name == "text" else F.lit(None).cast("string") if kind == "string" else F.array().cast(kind)
        return F.when(got, F.col(f"__e.{name}")).otherwise(empty).alias(name)

    out = joined.select(*kept.columns, F.coalesce(F.when(got, F.col("__e.title")), F.col("search_title")).alias("title"), got.alias("fetched"), *[field(k, v) for k, v in EMPTY.items()])
    s = signals.business_signals(out)
    whatsapp = F.contains(F.coalesce(urls.domain(F.col("url")), F.lit("")), F.lit("whatsapp"))
    blocked = ~F.col("fetched") & (F.col("result_type") == "SOCIAL")
    own = F.array("normalized_url")
    return s.withColumns({"social_urls": F.when(blocked & ~whatsapp, own).otherwise(F.col("social_urls")), "whatsapp_urls": F.when(blocked & whatsapp, own).otherwise(F.col("whatsapp_urls"))})


def with_site_pages(inspected: DataFrame, crawled: dict[str, DataFrame]) -> DataFrame:
    """inspected with the combined evidence of the pages that crawl.enrich() had of a candidate's site.

    site_name is the best name on those pages, page_roles tells which pages
    there are, and ``enrichment`` what was asked and had; all are null for
    candidates that weren't followed. A candidate whose site was had counts as fetched.
    """
    sites = crawled["sites"].select(F.col("seq").alias("__s"), "tier", "wanted", "sitemap_asked", "n_listed", "sitemap_source")
    fields = ("title", *EMPTY, *SIGNALS)
    e = crawled["evidence"].join(sites, F.col("seq") == F.col("__s")).select(
        F.col("seq").alias("__seq"), F.struct(*fields).alias("__e"), F.when(F.col("name_confidence") != "LOW", F.struct("name", F.col("name_source").alias("source"), F.col("name_confidence").alias("confidence"))).alias("site_name"), "page_roles",
        F.struct("tier", F.col("wanted").alias("wanted_roles"), "successful_urls", "failed_urls", F.slice("selected_url_sources", 1, 8).alias("selected_url_sources"), "sitemap_asked", F.col("n_listed").alias("sitemap_url_count"), "sitemap_source", F.slice("address_sources", 1, 8).alias("address_sources")).alias("enrichment"),
    )
    both = inspected.join(e, F.col("seq") == F.col("__seq"), "left")
    had = F.col("__seq").isNotNull()
    better = {c: F.when(had, F.coalesce(F.col(f"__e.{c}"), F.col(c)) if c == "title" else F.col(f"__e.{c}")).otherwise(F.col(c)) for c in fields}
    return both.withColumns(better | {"fetched": F.col("fetched") | had}).drop("__seq", "__e")


def businesses(inspected: DataFrame) -> DataFrame:
    """Rows of businesses of inspected pages; a listing page's rows give way to those of its expansion, if it has any."""
    rows = identify.identify(inspected)
    listing = inspected.where(F.col("result_type").isin("ARTICLE", "DIRECTORY"))
    expanded = written(identify.expand(listing))
    replaced = rows.join(expanded.select("seq").distinct(), "seq", "left_anti")
    out = replaced.unionByName(expanded)
    if "site_name" not in inspected.columns:
        return out
    # a site's pages together know the owner's name better than its homepage does
    names = inspected.where("site_name IS NOT NULL").select(F.col("seq").alias("__seq"), F.col("site_name").alias("__n"))
    owner = (F.col("source_type") == "WEBSITE") & F.col("__n").isNotNull() & (F.col("name_source") == "site_owner")
    named = out.join(names, F.col("seq") == F.col("__seq"), "left").withColumn("__owner", F.coalesce(owner, F.lit(False)))
    return named.withColumns({"business_name": F.when(F.col("__owner"), F.col("__n.name")).otherwise(F.col("business_name")), "confidence": F.when(F.col("__owner"), F.col("__n.confidence")).otherwise(F.col("confidence"))}).drop("__seq", "__n", "__owner")


def stamp(rows: DataFrame, inspected: DataFrame) -> DataFrame:
    """rows with what found them: discovered_by_queries, expected_city, discovery_sources (type, url, title, query), and their page's text and signals."""
    queries = F.col("discovered_by_queries") if "discovered_by_queries" in inspected.columns else F.array().cast("array<string>")
    expected = F.col("expected_city") if "expected_city" in inspected.columns else F.lit(None).cast("string")
    context = inspected.select(
        F.col("seq").alias("__seq"), F.col("url").alias("page_url"), F.col("normalized_url").alias("page_key"), "title", "text", "headings", "facts", "result_type", "fetched", "emails", "phones", "address_candidates", "social_urls",
        "meta_description", "og_site_name", "city_mentions", queries.alias("discovered_by_queries"), expected.alias("expected_city"), F.coalesce("search_title", F.lit("")).alias("search_title"),
        *[F.col(c).alias(f"site_{c}") for c in ("page_roles", "enrichment") if c in inspected.columns],
    )
    source = F.transform("discovered_by_queries", lambda x: F.struct(F.lit("search").alias("type"), F.col("page_key").alias("url"), F.col("search_title").alias("title"), x.alias("query")))
    return rows.join(context, F.col("seq") == F.col("__seq")).drop("__seq").withColumn("discovery_sources", source)


def qualify(rows: DataFrame) -> DataFrame:
    """Stamped rows with type, relevance, store, city and contacts; rows that a listing only mentions are judged by their own fields."""
    own = F.col("source_type") == "WEBSITE"
    facts = F.when(own, F.col("facts")).otherwise(F.array().cast(f"array<{FACT}>"))
    text = F.when(own, haystack("business_name", "title", "text", F.array_join("headings", " "))).otherwise(haystack("business_name", "address"))
    first = lambda c: F.when(own, F.get(c, F.lit(0)))
    roles = F.when(own, F.col("site_page_roles")) if "site_page_roles" in rows.columns else F.lit(None).cast("array<string>")
    ready = rows.withColumns(
        {
            "haystack": text, "name": F.col("business_name"), "addresses": F.array_compact(F.array(F.coalesce("address", first("address_candidates")))), "page_roles": F.coalesce(roles, F.array(page_role(F.col("page_url"), F.concat(F.lit("https://"), urls.host(F.col("page_url")))))),
            "fact_fields": F.transform(facts, lambda f: f["field"]), "fact_sources": F.transform(facts, lambda f: f["source"]), "localities": F.transform(F.filter(facts, lambda f: f["field"] == "addressLocality"), lambda f: f["value"]),
            "email": first("emails"), "phone": first("phones"), "facebook": first(F.filter("social_urls", lambda u: F.contains(u, F.lit("facebook.com")))), "instagram": F.coalesce("instagram", first(F.filter("social_urls", lambda u: F.contains(u, F.lit("instagram.com"))))),
        }
    )
    contacts = [present(F.col(c)) for c in ("website", "instagram", "facebook", "email", "phone")]
    found = classify.classify(ready.withColumn("has_contact", reduce(lambda a, b: a | b, contacts)))
    return found.withColumn("address", F.get("addresses", F.lit(0)))


def attach(rows: DataFrame) -> DataFrame:
    """rows with relationship, quality, lead verdict and fit; fields of rules and models stay as they are.

    Businesses that a page only mentions are scored by their name, address and
    city, not by the page's text.
    """
    given = {"geography": F.lit(UNKNOWN), "positioning": F.lit(None).cast("string"), "carries_other_brands": F.lit(None).cast("string"), "maps_url": F.lit(None).cast("string")}
    out = rows.withColumns({k: v for k, v in given.items() if k not in rows.columns} | {"name": F.col("business_name"), "url": F.col("source_url")})
    out = lead.assess(classify.entity_quality(out))
    mentioned = haystack("business_name", "address", "city")
    out = out.withColumn("__text", F.col("text")).withColumn("text", F.when(F.col("relationship") == "MENTIONED_BUSINESS", mentioned).otherwise(F.col("text")))
    out = score.assess_fit(out)
    return out.withColumn("explanation", score.explain(out)).withColumn("text", F.col("__text")).drop("__text")


#: More rows than a page can give: names are three characters long at least, and a candidate's text 200,000.
ROWS_A_PAGE = 100_000


def place(seq: Column, ord_: Column) -> Column:
    """One number for a row of a page, in order; too large a seq fails instead of clashing."""
    return F.when(F.abs(seq) > 2**63 // ROWS_A_PAGE - 1, F.raise_error(F.lit("a candidate's number is too large")).cast("long")).otherwise(seq.cast("long") * ROWS_A_PAGE + ord_)


def merge(rows: DataFrame) -> DataFrame:
    """Rows merged by their first key, then by compatible equal names, in order of pages and places on them."""
    once = written(merge_by_first_key(rows.withColumn("row", place(F.col("seq"), F.col("ord"))).drop("seq"), "row"))
    into = merge_same_name(once, "row").withColumnRenamed("row", "__row")
    joined = once.join(into, F.col("row") == F.col("__row")).drop("__row", "n_merged")
    return fold(joined, ["merged_into"], "row").withColumnRenamed("row", "seq")


def evaluate(found: DataFrame, pages: DataFrame, places: DataFrame | None = None, get: crawl.Fetcher | None = None, model: model_step.Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Qualified rows, one for each business on each page, and merged businesses, of candidates over a table of pages.

    places: catalogue for geography; without it no row is told to be elsewhere.
    get: fetcher for further pages of websites; without it candidates are judged by their own page.
    model: asked about rows of websites, once for each distinct evidence; without it the rules decide alone.
    """
    inspected = written(inspect(found, pages))
    if get is not None:
        inspected = written(with_site_pages(inspected, crawl.enrich(found, get)))
    rows = qualify(stamp(businesses(inspected), inspected))
    if places is not None:
        rows = written(rows.withColumn("id", place(F.col("seq"), F.col("ord"))))
        profiles = rows.select("id", F.col("haystack").alias("profile"), "address", "city", "website", "expected_city")
        rows = rows.join(geo.verify(profiles, places).select("id", "geography"), "id").drop("id")
    if model is not None:
        rows = written(model(rows.withColumn("search_query", F.get("discovered_by_queries", F.lit(0)))))
    attached = written(attach(rows))
    return attached, merge(attached)


def is_valid() -> Column:
    """Whether a row is a business of its own: not a discovery page, with a name and a type."""
    return ~F.col("source_type").isin("DIRECTORY", "ARTICLE", "SOCIAL", "VIDEO") & present(F.col("business_name")) & F.coalesce(F.col("business_type") != UNKNOWN, F.lit(False))


def query_metrics(specs: DataFrame, hits: DataFrame, unique: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each asked query (query, limit): raw hits, unique candidates, valid businesses and leads that it found."""
    raw = hits.groupBy("query").agg(F.count(F.lit(1)).alias("raw_results"))
    kept = unique.select(F.explode("discovered_by_queries").alias("query")).groupBy("query").agg(F.count(F.lit(1)).alias("unique_candidates"))
    lead_ = F.coalesce(F.col("stockist_lead") == "YES", F.lit(False))
    made = rows.select(F.explode("discovered_by_queries").alias("query"), is_valid().alias("valid"), lead_.alias("lead")).groupBy("query").agg(F.count_if("valid").alias("businesses"), F.count_if("lead").alias("leads"))
    out = specs.join(raw, "query", "left").join(kept, "query", "left").join(made, "query", "left")
    return out.select("query", "limit", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("raw_results", "unique_candidates", "businesses", "leads")])


def batch_summary(specs: DataFrame, hits: DataFrame, unique: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of totals of a batch."""
    lead_ = F.coalesce(F.col("stockist_lead") == "YES", F.lit(False))
    parts = (
        specs.agg(F.coalesce(F.sum("limit"), F.lit(0)).cast("long").alias("requested")), hits.agg(F.count(F.lit(1)).alias("raw_results")), unique.agg(F.count(F.lit(1)).alias("unique_candidates")),
        rows.agg(F.count_if(is_valid()).alias("businesses"), F.count_if(lead_).alias("leads")),
    )
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def limited(specs: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits (seq, query, url) of each query up to its limit of different URLs, in order."""
    first = Window.partitionBy("query", "url").orderBy("seq")
    once = hits.join(specs.select("query", "limit"), "query").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    ranked = once.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy("seq")))
    return ranked.where("__n <= limit").drop("__n", "limit")


def run_batch(specs: DataFrame, search: Callable[[DataFrame], DataFrame], pages: DataFrame, places: DataFrame | None = None, get: crawl.Fetcher | None = None, model: model_step.Model | None = None) -> dict[str, DataFrame]:
    """A batch of queries to its tables: candidates, rows, businesses, query_metrics, summary. The search is called once and its answer written."""
    hits = written(search(specs))
    unique = written(C.dedupe(C.candidates_from_hits(limited(specs, hits))))
    rows, merged = evaluate(unique, pages, places, get, model)
    return {"candidates": unique, "rows": rows, "businesses": merged, "query_metrics": query_metrics(specs, hits, unique, rows), "summary": batch_summary(specs, hits, unique, rows)} | ({"model_report": model_step.report(rows), "answers": model.answers} if model is not None else {})
