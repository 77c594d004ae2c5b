"""Benchmarks: both branches over a small web, comparisons of owners, and candidates of many queries."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import places
from waymark.operators import benchmark, crawl, queries


def page(title, body="", links=()):
    nav = "".join(f'<a href="{u}">{u[1:]}</a>' for u in links)
    return f"<html><head><title>{title}</title></head><body>{nav}<h1>{title}</h1><p>{body}</p></body></html>"


WEB = {
    "https://www.weak.in/": page("Weak House", "Clothes.", ("/contact", "/stores", "/about")),
    "https://weak.in/contact": page("Contact", "Write to hi@weak.in"),
    "https://weak.in/stores": page("Stores", "Visit our store. 12 Hill Road, Mumbai 400050. Call +91 98765 43210."),
    "https://list.justdial.com/x": page("Best boutiques", "Many."),
}
FOUND = [(1, "https://www.weak.in/", "Weak", "WEBSITE"), (2, "https://gone.in/", "Gone", "WEBSITE"), (3, "https://list.justdial.com/x", "List", "DIRECTORY"), (4, "https://instagram.com/none", "None", "SOCIAL")]


@pytest.fixture(scope="module")
def both(spark):
    pages = spark.createDataFrame(list(WEB.items()), "url string, html string")
    found = spark.createDataFrame(FOUND, "seq long, url string, title string, result_type string").withColumn("normalized_url", F.col("url"))
    baseline = spark.createDataFrame([("candidates", 3), ("email_populated", 1)], "metric string, value long")
    out = benchmark.homepage_or_enriched(found, pages, crawl.from_table(pages), "boutiques in Goa", baseline)
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def test_branches(both):
    metrics = {r["metric"]: (r["homepage"], r["enriched"], r["change"]) for r in both["metrics"]}
    assert set(metrics) == set(benchmark.METRICS)
    assert metrics["candidates"] == (4, 4, 0) and metrics["email_populated"] == (0, 1, 1) and metrics["phone_populated"] == (0, 1, 1) and metrics["physical_store_yes"] == (0, 1, 1)
    # four candidates' own pages, two of which are missing; then three pages, of which one is missing
    assert metrics["total_fetches"] == (4, 7, 3) and metrics["failed_fetches"] == (2, 3, 1)
    assert metrics["deduplicated_candidates"][0] == metrics["deduplicated_candidates"][1]
    assert {r["metric"]: r["change"] for r in both["comparison"]}["candidates"] == 1


def test_changes(both):
    by = {(r["seq"], r["field"]): (r["change"], r["worse"]) for r in both["compared"]}
    assert {s for s, _ in by} == {1, 2}
    assert by[1, "email"] == by[1, "phone"] == by[1, "city"] == ("gained", False) and by[1, "business_name"][0] == "same"
    assert all(c == "same" or c == "absent" for (s, _), (c, _) in by.items() if s == 2)
    gains = {r["field"]: r for r in both["gains"]}
    assert set(gains) == {*benchmark.GAIN_FIELDS, "confidence", "high_confidence"} and gains["email"]["gained"] == 1 and gains["email"]["worse"] == 0
    pair = {r["seq"]: r for r in both["pairs"]}
    assert pair[1]["comparable"] and "email" in pair[1]["gained"] and not pair.get(3, {"comparable": False})["comparable"]


def test_reports(both):
    c = both["crawl"][0]
    assert (c["eligible"], c["homepages_had"], c["pages_selected"], c["pages_had"], c["pages_failed"], c["sitemaps_asked"]) == (2, 1, 3, 2, 1, 0)
    assert {(r["seq"], r["stage"]) for r in both["errors"]} == {(1, "page"), (2, "homepage"), (4, "fetch")}
    assert [r["seq"] for r in both["quality_sample"] if r["place"] == 1] == [1]
    assert {r["seq"]: r["reasons"] for r in both["suspicious"]}[1] == ["unrelated_city"]
    assert both["requests_report"][0]["total"] == 7


def test_worse(spark):
    full = ("Ananta", "12 Hill Road", "Goa", "1", "a@b.in", "i", "YES", "BOUTIQUE", "HIGH", "w", "HIGH", "WEBSITE", "u")
    less = ("Home", None, " GOA ", "2", "UNKNOWN", "i", "NO", "BOUTIQUE", "HIGH", "w", "MEDIUM", "WEBSITE", "u")
    schema = "seq long, " + ", ".join(f"{c} string" for c in benchmark.SNAPSHOT)
    got = {r.field: (r.change, r.worse) for r in benchmark.compare_owners(spark.createDataFrame([(1, *full)], schema), spark.createDataFrame([(1, *less)], schema)).collect()}
    assert got["business_name"] == ("changed", True) and got["address"] == got["email"] == ("lost", True) and got["city"] == ("same", False) and got["phone"] == ("changed", False)
    assert got["physical_store"] == ("changed", True) and got["confidence"] == ("changed", True) and got["high_confidence"] == ("lost", False)


HITS = [
    (0, "a", "Shop", "https://one.in/x/y", ""), (1, "a", "Shop", "https://one.in/", ""), (2, "a", "Two", "https://two.in/", ""), (3, "a", "Three", "https://three.in/", ""),
    (4, "b", "Two", "https://two.in/", ""), (5, "b", "Bad", None, ""), (6, "ref", "Ananta House", "https://four.in/", ""), (7, "ref", "Other", "https://five.in/", ""), (8, "ref", None, "https://six.in/", "by ANANTA"),
]


def discovered(spark, needles, fallback=None):
    specs = spark.createDataFrame([("a", 2, False), ("b", 5, False), ("ref", 1, True), ("none", 5, False), ("a", 1, False)], "query string, limit int, reference boolean")
    hits = spark.createDataFrame([(*h, "t") for h in HITS], "seq long, query string, title string, url string, snippet string, source string")
    out = benchmark.discover(specs, hits, needles, fallback)
    return {r.group_key: r for r in out["candidates"].collect()}, {r.query: (r.raw, r.candidates, r.reference_hits) for r in out["per_query"].collect()}


def test_discover(spark):
    found, counts = discovered(spark, ("ananta",))
    assert set(found) == {"WEBSITE|one.in", "WEBSITE|two.in", "WEBSITE|four.in", "WEBSITE|six.in"}
    assert found["WEBSITE|one.in"].url == "https://one.in/" and found["WEBSITE|two.in"].discovered_by_queries == ["a", "b"]
    assert counts == {"a": (4, 2, 0), "b": (2, 1, 0), "ref": (3, 2, 2), "none": (0, 0, 0)}


def test_fallback_only_where_nothing_was_found(spark):
    seed = spark.createDataFrame([(0, "seed", "Ananta", "https://ananta.in/", "", "t")], "seq long, query string, title string, url string, snippet string, source string")
    assert "WEBSITE|ananta.in" not in discovered(spark, ("ananta",), seed)[0]
    found, counts = discovered(spark, ("nowhere",), seed)
    assert found["WEBSITE|ananta.in"].discovered_by_queries == ["seed"] and counts["ref"] == (3, 0, 0)


def test_buckets_and_inspection(spark):
    rows = [
        (1, "WEBSITE", "YES", "BOUTIQUE", "HIGH", None, ["brands"], []), (2, "WEBSITE", "NO", "BOUTIQUE", "UNKNOWN", "OWN_BRAND", [], ["own_label"]), (3, "WEBSITE", "UNKNOWN", "UNKNOWN", "UNKNOWN", None, [], []),
        (4, "DIRECTORY", "YES", "UNKNOWN", "HIGH", None, [], []), (5, "ARTICLE", None, "RETAILER", "HIGH", None, [], []), (6, "WEBSITE", "NO", "RETAILER", "HIGH", None, [], []), (7, "WEBSITE", None, "BOUTIQUE", "HIGH", None, ["x"], []),
    ]
    df = spark.createDataFrame(rows, "seq long, source_type string, ai_stockist string, business_type string, women_fashion_relevance string, ai_business_type string, ai_evidence array<string>, rejected array<string>")
    df = df.selectExpr("*", "0 AS ord", "'N' AS business_name", "'https://x.in/' AS website", "'u' AS source_url", "'Goa' AS city", "'LOW' AS confidence")
    assert {r.bucket[0]: r.n for r in benchmark.buckets(df).collect()} == {"A": 1, "B": 1, "C": 2, "D": 1, "E": 1, "F": 1}
    why = {(r.side, r.seq): r.why for r in benchmark.inspection(df).collect()}
    assert why == {
        ("yes", 1): ["brands"], ("fashion_no", 2): ["own_label"], ("unknown", 3): ["no validated AI evidence list", "business_type UNKNOWN", "women_fashion UNKNOWN"], ("yes", 4): [],
        ("fashion_no", 6): ["classified NO without a stockist-positive page signal"], ("unknown", 7): ["page lacked multi-brand/curated language"],
    }


def test_city_benchmark(spark):
    pages = spark.createDataFrame([("https://four.in/", page("Ananta House", "A boutique."))], "url string, html string")
    specs = spark.createDataFrame([("a", 2, False), ("ref", 1, True)], "query string, limit int, reference boolean")
    asked = []

    def search(plan):
        asked.append(plan.count())
        return spark.createDataFrame([(*h, "t") for h in HITS], "seq long, query string, title string, url string, snippet string, source string")

    out = benchmark.city_benchmark(specs, search, pages, ("ananta",))
    assert asked == [2] and out["candidates"].count() == 4 and out["rows"].count() == 4
    assert sum(r.n for r in out["buckets"].collect()) == 4
    assert {r.side for r in out["inspection"].collect()} == {"unknown"} and out["reference"].first().found


def test_empty(spark):
    empty = spark.createDataFrame([], "seq long, query string, title string, url string, snippet string, source string")
    out = benchmark.discover(spark.createDataFrame([], "query string, limit int, reference boolean"), empty, ("x",))
    assert out["candidates"].count() == out["per_query"].count() == 0


def test_modes_of_queries(spark):
    p = places.places(spark)
    got = [r.query for r in queries.multi_city(p).orderBy("batch_position").collect()]
    assert len(got) == 5 * len(places.FAMILIES) and got[0] == "multi brand fashion store Goa" and got[5] == "multi brand fashion store Mumbai" and got[4] == "fashion boutiques to visit Goa"
    with pytest.raises(KeyError):
        queries.multi_city(p, ("Atlantis",))
    goa = queries.specs(queries.sampled(p), p).where("city = 'Goa'").orderBy("position").collect()
    assert [r.location for r in goa[16:]] == ["North Goa", "South Goa", "Panaji", "Panjim", "Anjuna", "Assagao"] and {r.state for r in goa} == {"Goa"}
    assert [r.family for r in goa[16:19]] == ["physical_retail", "editorial", "physical_retail"]
    assert places.templates(spark, ("contextual",)).first().family == "discovery_language"
