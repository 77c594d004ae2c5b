"""Benchmarks of a run: what the pages behind a site's homepage add to it, and what a city's searches find.

``homepage_or_enriched`` identifies the same candidates twice, by their homepage alone and by
all pages that the crawl had of their sites, out of one crawl, and compares both.
``discover`` and ``city_benchmark`` merge the candidates of many queries, some of which
look for one known business only, and sort what they find into buckets.

Defined cases: a site whose homepage can't be had keeps its row without evidence on both sides;
candidates that are no websites are the same on both sides and not compared; empty tables
give empty tables and counts of zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions.text import UNKNOWN, present
from . import candidates as C
from . import crawl, evaluate, lead, report
from .graph import written
from .ordered import fill_members, first_of_each
from .resolve import CONFIDENCE

# --- fixed values: fields of an owner that are compared, and metrics of a run ---
GAIN_FIELDS = ("business_name", "address", "city", "phone", "email", "instagram", "physical_store", "business_type", "women_fashion_relevance")
METRICS = (
    "candidates", "raw_business_candidates", "deduplicated_candidates", "high_confidence", "physical_store_yes", "city_populated", "address_populated", "phone_populated",
    "email_populated", "instagram_populated", "high_women_fashion", "total_fetches", "failed_fetches",
)
BUCKETS = ("A_multi_brand_or_curated_stockist", "B_own_label_designer_or_brand", "C_generic_clothing_retailer", "D_directory", "E_article_or_editorial", "F_other_or_unrelated")

SNAPSHOT = (*GAIN_FIELDS, "website", "confidence", "source_type", "source_url")
SELECTION = "tier, wanted_roles, successful_urls, failed_urls, selected_url_sources, sitemap_asked, sitemap_url_count, sitemap_source".split(", ")


class Counting:
    """A fetcher that keeps what it was asked and what it answered, wave by wave."""

    def __init__(self, get: crawl.Fetcher):
        self.get, self.waves = get, []

    def __call__(self, targets: DataFrame) -> DataFrame:
        self.waves.append(written(self.get(targets).select(*crawl.ANSWER)))
        return self.waves[-1]

    def requests(self) -> DataFrame:
        """(url, kind, ok) of every request: robots files, sitemaps, pages."""
        return reduce(lambda a, b: a.unionByName(b), self.waves).select("url", request_kind(F.col("url")).alias("kind"), (F.col("error").isNull() & F.col("html").isNotNull()).alias("ok"))


def request_kind(url: Column) -> Column:
    return F.when(F.coalesce(urls.path(F.lower(url)), F.lit("")).endswith("robots.txt"), "robots").when(F.contains(F.lower(url), F.lit("sitemap")), "sitemap").otherwise("html")


def owners(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(seq, fields of SNAPSHOT): of each candidate's rows the one with its own domain, else the first."""
    own = rows.join(found.select("seq", urls.domain(F.col("normalized_url")).alias("__d")), "seq")
    other = ~F.coalesce(urls.domain(F.col("website")) == F.col("__d"), F.lit(False))
    return first_of_each(own.withColumn("__other", other), ["seq"], ["__other", "ord"]).select("seq", *SNAPSHOT)


def compare_owners(before: DataFrame, after: DataFrame) -> DataFrame:
    """(seq, field, before, after, change, worse) for each field of owners on both sides.

    Empty and UNKNOWN values are absent, values that differ only in case or outer
    space are the same. A value lost is worse, as are a store that is no longer
    sure, a new name that is none, and less confidence. ``high_confidence`` is a
    field that only those have whose confidence is high.
    """
    high = lambda: F.when(F.col("confidence") == "HIGH", "HIGH")
    fields = (*GAIN_FIELDS, "confidence", "high_confidence")
    a, b = before.withColumn("high_confidence", high()), after.withColumn("high_confidence", high())
    a = a.select("seq", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"))
    b = b.select("seq", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("before"), F.col(f"b.{f}").alias("after")) for f in fields]))
    long = a.join(b, "seq").select("seq", pairs.alias("c")).select("seq", "c.*")
    was, is_ = present(F.col("before")), present(F.col("after"))
    differs = F.lower(F.btrim("before")) != F.lower(F.btrim("after"))
    change = F.when(~was & ~is_, "absent").when(~was, "gained").when(~is_, "lost").when(differs, "changed").otherwise("same")
    name = F.lower(F.btrim("after"))
    level = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in CONFIDENCE.items()], F.lit(0))
    no_longer = ((F.col("field") == "physical_store") & (F.col("before") == "YES")) | ((F.col("field") == "business_name") & (name.rlike(rules.CHROME_NAME) | name.isin(*rules.GENERIC_NAMES))) | ((F.col("field") == "confidence") & (level("after") < level("before")))
    worse = (F.col("change") == "lost") | ((F.col("change") == "changed") & no_longer)
    # confidence in steps says it all once, a lost HIGH isn't worse twice
    return long.withColumn("change", change).withColumn("worse", F.coalesce(worse & (F.col("field") != "high_confidence"), F.lit(False)))


def gains(compared: DataFrame) -> DataFrame:
    """(field, gained, lost, changed, worse) of every compared field, zeros included."""
    counted = compared.groupBy("field").agg(*[F.count_if(F.col("change") == k).alias(k) for k in ("gained", "lost", "changed")], F.count_if("worse").alias("worse"))
    all_ = report.df_of_names(compared, (*GAIN_FIELDS, "confidence", "high_confidence"), "field").join(counted, "field", "left")
    return all_.select("field", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gained", "lost", "changed", "worse")])


def run_metrics(found: DataFrame, rows: DataFrame, merged: DataFrame, requests: DataFrame) -> DataFrame:
    """(metric, value) of one branch, one row for each of METRICS: counts of candidates, rows, merged rows by what they have, and requests (ok)."""
    has = {f"{c}_populated": present(F.col(c)) for c in ("city", "address", "phone", "email", "instagram")}
    tests = {"high_confidence": F.col("confidence") == "HIGH", "physical_store_yes": F.col("physical_store") == "YES", **has, "high_women_fashion": F.col("women_fashion_relevance") == "HIGH"}
    n = F.count(F.lit(1))
    parts = (
        found.agg(n.alias("candidates")), rows.agg(n.alias("raw_business_candidates")), merged.agg(n.alias("deduplicated_candidates"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in tests.items()]),
        requests.agg(n.alias("total_fetches"), F.count_if(~F.col("ok")).alias("failed_fetches")),
    )
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("value")) for k in METRICS])))


def against(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(metric, before, after, change) of two runs' metrics; without an earlier run only the later one's."""
    if before is None:
        return after.select("metric", F.lit(None).cast("long").alias("before"), F.col("value").alias("after"), F.lit(None).cast("long").alias("change"))
    was = before.select("metric", F.col("value").alias("before"))
    return after.withColumnRenamed("value", "after").join(was, "metric", "left").select("metric", "before", "after", (F.col("after") - F.col("before")).alias("change"))


def crawl_counts(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of counts of a crawl (its sites and pages, see crawl.enrich): sites followed, homepages had, sites strong enough as they are, sitemaps asked and found, pages chosen, had and failed."""
    s = sites.agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if("ok").alias("homepages_had"), F.count_if(F.coalesce(F.col("tier") == "STRONG", F.lit(False))).alias("skipped_strong"),
        F.count_if("sitemap_asked").alias("sitemaps_asked"), F.count_if(F.col("n_listed") > 0).alias("sitemaps_found"), F.coalesce(F.sum("n_listed"), F.lit(0)).cast("long").alias("sitemap_urls"),
    )
    further = pages.where("place > 0")
    p = further.agg(F.count(F.lit(1)).alias("pages_selected"), F.count_if(F.col("error").isNull()).alias("pages_had"), F.count_if(F.col("error").isNotNull()).alias("pages_failed"), F.count_if(F.col("source") != "homepage_link").alias("from_sitemaps"))
    return s.crossJoin(p)  # one row each


def homepage_or_enriched(found: DataFrame, pages: DataFrame, get: crawl.Fetcher, query: str = "", baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both branches of candidates found (seq, url, normalized_url, title, result_type) and their comparison.

    pages: stored pages (url, html) of candidates that are no websites; websites
    are asked for by get, once for both branches. baseline: metrics of an
    earlier run. Tables: before, after (rows), businesses_before, businesses,
    compared, gains, metrics (metric, homepage, enriched, change), crawl,
    requests, requests_report, comparison (with the baseline), suspicious,
    quality_sample, errors.
    """
    counting = Counting(get)
    crawled = crawl.enrich(found, counting)
    site = F.coalesce(F.col("result_type") == "WEBSITE", F.lit(False))
    homepages = counting.waves[0].where("html <> ''").select("url", "html")
    # homepages are met by normal form, whatever form the candidate's URL has
    web = found.where(site).withColumn("normalized_url", F.coalesce(urls.normalize(F.col("normalized_url")), F.col("normalized_url"), urls.normalize(F.col("url"))))
    inspected = written(evaluate.inspect(web, homepages).unionByName(evaluate.inspect(found.where(~site), pages)))
    enriched = written(evaluate.with_site_pages(inspected, crawled))
    before = written(evaluate.qualify(evaluate.stamp(evaluate.businesses(inspected), inspected)))
    after = written(evaluate.qualify(evaluate.stamp(evaluate.businesses(enriched), enriched)))
    merged_before, merged = written(evaluate.merge(before)), written(evaluate.merge(after))

    stored = inspected.where(~site).select("url", F.lit("html").alias("kind"), F.col("fetched").alias("ok"))
    requests = counting.requests().unionByName(stored)
    at_home = inspected.select("url", F.lit("html").alias("kind"), F.col("fetched").alias("ok"))
    metrics_before, metrics = written(run_metrics(found, before, merged_before, at_home)), written(run_metrics(found, after, merged, requests))
    was, is_ = owners(before, found), written(owners(after, found))
    websites = found.where(site).select("seq")
    compared = written(compare_owners(was.join(websites, "seq", "left_semi"), is_))

    changes = compared.groupBy("seq").agg(*[F.array_sort(F.collect_list(F.when(F.col("change") == k, F.col("field")))).alias(k) for k in ("gained", "lost", "changed")])
    sites = enriched.select("seq", *[F.col(f"enrichment.{c}").alias(c) for c in SELECTION])
    pairs = written(is_.join(changes.withColumn("comparable", F.lit(True)), "seq", "left").withColumn("comparable", F.coalesce("comparable", F.lit(False))).join(sites, "seq", "left"))
    ranked = pairs.select("seq", "comparable", F.coalesce(F.size("gained"), F.lit(0)).alias("gained"), (F.col("source_type") == "WEBSITE").cast("int").alias("website_source"), "confidence", "physical_store", "business_name")
    titles = found.select("seq", F.col("title").alias("candidate_title"), F.lit(query).alias("query"))
    doubted = after.join(titles, "seq").withColumn("reasons", report.suspicious_reasons()).where(F.size("reasons") > 0)
    failed = crawled["pages"].where("error IS NOT NULL").select("seq", F.when(F.col("place") == 0, "homepage").otherwise("page").alias("stage"), "url", "error")
    missing = inspected.where(~site & ~F.col("fetched")).select("seq", F.lit("fetch").alias("stage"), "url", F.lit("not found").alias("error"))
    return {
        "before": before, "after": after, "businesses_before": merged_before, "businesses": merged, "pairs": pairs, "compared": compared, "gains": gains(compared),
        "metrics": against(metrics_before, metrics).select("metric", F.col("before").alias("homepage"), F.col("after").alias("enriched"), "change"),
        "crawl": crawl_counts(crawled["sites"], crawled["pages"]), "requests": requests, "requests_report": requests_report(requests, found), "comparison": against(baseline, metrics),
        "suspicious": doubted.select("seq", "ord", *SNAPSHOT, "reasons"), "quality_sample": report.quality_sample(ranked).join(pairs, "seq"), "errors": failed.unionByName(missing),
    }


def requests_report(requests: DataFrame, found: DataFrame) -> DataFrame:
    return report.requests_report(requests, found.count())


# --- many queries, one city ----------------------------------------------------


def named_like(needles: Column) -> Column:
    """Whether a candidate's title, URL or snippet has one of some words."""
    hay = F.lower(F.concat_ws(" ", "title", "url", "snippet"))
    return F.coalesce(F.exists(needles, lambda n: F.contains(hay, F.lower(n))), F.lit(False))


def discover(specs: DataFrame, hits: DataFrame, needles: Sequence[str] = (), fallback: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates of all queries, merged, with every query that found them, and counts by query.

    specs: (query, limit, reference), hits: (seq, query, title, url, snippet,
    source), seq growing with the queries' order. A query's candidates are its
    best URL of each site, up to its limit in order of first hits; a reference
    query looks for the business with the needles alone and keeps no other, without a limit.
    fallback: hits of that business, used if no query found it. A query given
    twice is asked once, with its largest limit, and is no reference query if it is one of the plain ones too.
    candidates as candidates.dedupe() gives them; per_query (query, reference,
    raw, candidates, reference_hits), a query without hits included.
    """
    specs = specs.groupBy("query").agg(F.max("limit").alias("limit"), F.bool_and(F.coalesce("reference", F.lit(False))).alias("reference"))
    found = C.candidates_from_hits(hits.join(specs.select("query"), "query", "left_semi"))
    each = C.dedupe(found.withColumn("asked", F.col("query")), by=("asked",)).drop("group_key")
    like = named_like(F.array(*map(F.lit, needles)).cast("array<string>"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("first_seq"))
    given = specs.select(F.col("query").alias("asked"), "limit", "reference")
    placed = each.join(given, "asked").withColumns({"__n": place, "__like": like})
    kept = written(placed.where(F.when(F.col("reference"), F.col("__like")).otherwise(F.col("__n") <= F.col("limit"))).drop("__n", "limit"))
    raw = hits.groupBy(F.col("query").alias("asked")).agg(F.count(F.lit(1)).alias("raw"))
    made = kept.groupBy("asked").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("__like").alias("reference_hits"))
    counts = given.join(raw, "asked", "left").join(made, "asked", "left")
    per_query = counts.select(F.col("asked").alias("query"), "reference", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("raw", "candidates", "reference_hits")])
    columns = [c for c in found.columns if c in kept.columns]
    together = kept.withColumn("seq", F.col("first_seq")).select(*columns)
    if fallback is not None and not kept.where("__like").limit(1).count():
        seeded = C.candidates_from_hits(fallback).select(*columns)
        last = together.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))  # one row
        together = together.unionByName(seeded.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last") + 1).drop("last"))
    return {"candidates": C.dedupe(together), "per_query": per_query}


def with_answers(rows: DataFrame) -> DataFrame:
    """rows with the model's columns that buckets and inspection read, empty where no model was asked."""
    texts = {c: F.lit(None).cast("string") for c in ("ai_stockist", "ai_business_type", "positioning") if c not in rows.columns}
    lists = {c: F.coalesce(F.col(c) if c in rows.columns else F.lit(None), F.array().cast("array<string>")) for c in ("signals", "ai_evidence", "rejected")}
    return rows.withColumns(texts | lists)


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, n) of rows, every bucket included; the model's own-label types count as such whatever the rules say."""
    own = F.col("ai_business_type").isin("DESIGNER", "OWN_BRAND", "BRAND")
    r = with_answers(rows).withColumn("business_type", F.when(own, "BRAND").otherwise(F.col("business_type")))
    counted = r.groupBy(lead.reporting_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return fill_members(counted, report.df_of_names(rows, BUCKETS, "bucket"), "bucket", "n")


def inspection(rows: DataFrame) -> DataFrame:
    """Rows worth a look, by side, with why: ``yes`` stockists, ``fashion_no`` fashion businesses that are none, and ``unknown`` websites with the evidence they lack."""
    r = with_answers(rows)
    answer = F.coalesce("ai_stockist", F.lit(UNKNOWN))
    fashion = F.col("women_fashion_relevance").isin("HIGH", "MEDIUM") | (F.col("business_type") != UNKNOWN)
    side = F.when(answer == "YES", "yes").when((answer == "NO") & F.coalesce(fashion, F.lit(False)), "fashion_no").when((answer == UNKNOWN) & (F.col("source_type") == "WEBSITE"), "unknown")
    said = F.slice("ai_evidence", 1, 6)
    lacks = {"no validated AI evidence list": F.size(said) == 0, "business_type UNKNOWN": F.col("business_type") == UNKNOWN, "women_fashion UNKNOWN": F.col("women_fashion_relevance") == UNKNOWN}
    lacking = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in lacks.items()]))
    otherwise = lambda first, c: F.when(F.size(first) > 0, first).otherwise(c)
    lacking = otherwise(lacking, F.array(F.lit("page lacked multi-brand/curated language")))
    against_it = otherwise(F.col("rejected"), otherwise(F.slice("ai_evidence", 1, 2), F.array(F.lit("classified NO without a stockist-positive page signal"))))
    why = F.when(F.col("side") == "unknown", lacking).when(F.col("side") == "fashion_no", against_it).otherwise(said)
    out = r.withColumn("side", side).where("side IS NOT NULL")
    return out.select("side", "seq", "ord", "business_name", F.coalesce("website", "source_url").alias("url"), "city", "source_type", "business_type", "women_fashion_relevance", "confidence", why.alias("why"))


def city_benchmark(specs: DataFrame, search: Callable[[DataFrame], DataFrame], pages: DataFrame, needles: Sequence[str] = (), fallback: DataFrame | None = None, **run) -> dict[str, DataFrame]:
    """A city's queries to candidates, businesses, buckets, what to look at, and whether the known business came through.

    The search is called once for all queries and its answer written; run holds the further arguments of evaluate.evaluate().
    """
    hits = written(search(specs))
    out = discover(specs, hits, needles, fallback)
    unique = written(out["candidates"])
    rows, merged = evaluate.evaluate(unique, pages, **run)
    tables = out | {"candidates": unique, "rows": rows, "businesses": merged, "buckets": buckets(rows), "inspection": inspection(rows)}
    if needles:
        examples = rows.sparkSession.createDataFrame([("reference", list(needles), None)], "label string, needles array<string>, expected string")
        answers = with_answers(rows).withColumn("answer", F.coalesce("ai_stockist", F.lit(UNKNOWN)))
        tables["reference"] = report.reference_matches(answers, examples)
    return tables
