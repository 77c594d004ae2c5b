"""The crawl over a small web of stored pages, with a fetcher that counts."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import crawl

ADDRESS = "12 Hill Road, Mumbai 400050"


def page(title, *links, text="", head=""):
    nav = "".join(f'<a href="{u}">{a}</a>' for u, a in links)
    return f"<html><head><title>{title}</title>{head}</head><body>{nav}<h1>{title}</h1><p>{text}</p></body></html>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


STRONG = page(
    "Ananta", text=f"Women's boutique. Visit our store at {ADDRESS}. Call +91 98765 43210 or hello@strong.in. Kurta, saree and lehenga dresses for women in Mumbai.",
    head='<script type="application/ld+json">{"@type": "ClothingStore", "name": "Ananta", "telephone": "+919876543210", "address": {"streetAddress": "12 Hill Road", "addressLocality": "Mumbai", "postalCode": "400050"}}</script>',
)
WEB = {
    # links to all wanted roles, more than three; one fails, one leaves the site
    "https://weak.in/": page("Weak", ("/contact", "Contact"), ("/stores", "Stores"), ("/about-us", "About"), ("/boutique", "Boutique"), ("/product/x", "X"), ("https://other.in/contact", "Other"), ("/contact", "Write to us"), ("/cart", "Cart")),
    "https://weak.in/contact": page("Contact us", text="Write to hi@weak.in"),
    "https://weak.in/stores": ("https://elsewhere.com/stores", page("Stores", text="other")),
    # no links at all: its sitemap index, of which two children fail
    "https://mapped.in/": page("Mapped"),
    "https://mapped.in/robots.txt": "User-agent: *\nSitemap: https://mapped.in/map.xml\nSitemap: https://foreign.in/map.xml",
    "https://mapped.in/map.xml": "<sitemapindex>" + "".join(f"<sitemap><loc>https://mapped.in/{x}.xml</loc></sitemap>" for x in ("product", "pages", "stores-1", "stores-2", "static", "contact", "about")) + "</sitemapindex>",
    "https://mapped.in/pages.xml": urlset("https://mapped.in/contact-us", "https://mapped.in/our-story", "https://foreign.in/x", "https://mapped.in/product/contact"),
    "https://mapped.in/static.xml": urlset("https://mapped.in/visit-us", "https://mapped.in/showroom"),
    "https://mapped.in/contact-us": page("Contact Mapped", text="mail@mapped.in"),
    "https://mapped.in/our-story": page("About Mapped House", text="Founded long ago."),
    "https://mapped.in/visit-us": page("Visit us", text=f"Store at {ADDRESS}"),
    # nothing in the first usual place, an index in the second
    "https://second.in/": page("Second", ("/about", "About")),
    "https://second.in/about": page("About Second"),
    "https://second.in/sitemap_index.xml": urlset("https://second.in/contact"),
    "https://second.in/contact": page("Contact", text="x@second.in"),
    "https://strong.in/": STRONG,
    "https://moved.in/": ("https://www.moved-shop.in/", page("Moved", ("/contact", "Contact"), ("/about", "About"), ("/locations", "Locations"))),
    "https://www.moved-shop.in/contact": page("Contact", text="y@moved.in"),
    "https://empty.in/": "",
}
FOUND = [
    (1, "https://weak.in/", "Weak shop", "WEBSITE"), (2, "https://mapped.in/", "Mapped", "WEBSITE"), (3, "https://second.in/", None, "WEBSITE"), (4, "https://strong.in/", "Ananta", "WEBSITE"),
    (5, "https://moved.in/", "Moved", "WEBSITE"), (6, "https://gone.in/", "Gone", "WEBSITE"), (7, "https://empty.in/", "Empty", "WEBSITE"), (8, "https://instagram.com/x", "X", "SOCIAL"),
    (9, "https://weak.in/", "Weak again", "WEBSITE"), (10, None, "None", "WEBSITE"), (11, "ftp://weak.in/", "Ftp", "WEBSITE"),
]


@pytest.fixture(scope="module")
def crawled(spark):
    rows = [(u, *(v if isinstance(v, tuple) else (u, v))) for u, v in WEB.items()]
    stored = crawl.from_table(spark.createDataFrame(rows, "url string, final_url string, html string"))
    asked = []

    def get(targets):
        asked.extend(r.url for r in targets.collect())
        return stored(targets)

    found = spark.createDataFrame(FOUND, "seq long, url string, title string, result_type string").withColumn("normalized_url", F.col("url"))
    out = crawl.enrich(found, get)
    return {k: sorted((r.asDict() for r in v.collect()), key=lambda r: (r["seq"], r.get("place", 0))) for k, v in out.items()}, asked


def pages_of(crawled, seq):
    return [(p["place"], p["url"].split("/", 3)[3], p["role"], p["source"], p["error"]) for p in crawled[0]["pages"] if p["seq"] == seq]


def test_no_url_is_asked_twice(crawled):
    assert len(crawled[1]) == len(set(crawled[1]))
    assert not any("foreign.in" in u or "other.in" in u for u in crawled[1])


def test_links_first(crawled):
    assert pages_of(crawled, 1) == [(0, "", "homepage", "candidate", None), (1, "contact", "contact", "homepage_link", None), (2, "stores", "location", "homepage_link", "other site"), (3, "about-us", "about", "homepage_link", "not found")]
    assert pages_of(crawled, 9) == pages_of(crawled, 1)
    site = next(s for s in crawled[0]["sites"] if s["seq"] == 1)
    assert site["tier"] == "WEAK" and not site["sitemap_asked"]
    assert "https://weak.in/robots.txt" not in crawled[1]


def test_sitemaps_only_where_roles_are_open(crawled):
    assert pages_of(crawled, 2) == [(0, "", "homepage", "candidate", None), (1, "contact-us", "contact", "robots_sitemap", None), (2, "showroom", "location", "robots_sitemap", "not found"), (3, "visit-us", "location", "robots_sitemap", None)]
    children = [u for u in crawled[1] if u.startswith("https://mapped.in/") and u.endswith(".xml") and not u.endswith("/map.xml")]
    assert len(children) == 5 and "https://mapped.in/product.xml" not in children
    assert "https://mapped.in/sitemap.xml" not in crawled[1]
    assert pages_of(crawled, 3) == [(0, "", "homepage", "candidate", None), (1, "contact", "contact", "sitemap_index", None), (2, "about", "about", "homepage_link", None)]
    assert [(s["sitemap_source"], s["n_listed"]) for s in crawled[0]["sites"] if s["seq"] in (2, 3)] == [("robots_sitemap", 5), ("sitemap_index", 1)]


def test_ends_of_crawls(crawled):
    assert pages_of(crawled, 4) == [(0, "", "homepage", "candidate", None)]
    assert [s["tier"] for s in crawled[0]["sites"] if s["seq"] == 4] == ["STRONG"]
    assert [(p[1], p[4]) for p in pages_of(crawled, 5)] == [("", None), ("contact", None), ("locations", "not found"), ("about", "not found")]
    assert pages_of(crawled, 6) == [(0, "", "homepage", "candidate", "not found")] and pages_of(crawled, 7) == [(0, "", "homepage", "candidate", "empty")]
    assert not {p["seq"] for p in crawled[0]["pages"]} & {8, 10, 11}


def test_combined_evidence(crawled):
    by = {e["seq"]: e for e in crawled[0]["evidence"]}
    assert set(by) == {1, 2, 3, 4, 5, 9}
    e = by[2]
    assert e["emails"] == ["mail@mapped.in"] and e["headings"][0] == "Mapped" and e["page_roles"] == ["homepage", "contact", "location"]
    assert e["text"].index("mail@mapped.in") < e["text"].index("Hill Road")
    assert any(a["role"] == "location" and a["url"].endswith("/visit-us") for a in e["address_sources"])
    assert e["successful_urls"] == ["https://mapped.in/", "https://mapped.in/contact-us", "https://mapped.in/visit-us"] and e["failed_urls"] == ["https://mapped.in/showroom"]
    assert [x["source"] for x in e["selected_url_sources"]] == ["robots_sitemap"] * 3
    assert by[4]["name"] == "Ananta" and by[4]["name_confidence"] == "HIGH"
    assert by[3]["name"] == "Second"


def test_empty_tables(spark):
    found = spark.createDataFrame([], "seq long, url string, title string, result_type string, normalized_url string")
    out = crawl.enrich(found, crawl.from_table(spark.createDataFrame([], "url string, html string")))
    assert [out[k].count() for k in ("sites", "pages", "evidence")] == [0, 0, 0]


def test_from_web(spark):
    """The polite fetcher as a crawl's: redirects and failures arrive."""
    web = {u.replace("www.", ""): (v if isinstance(v, tuple) else (u, v)) for u, v in WEB.items()}  # normal URLs have no www

    def get(url):
        if url not in web:
            return 404, "text/html", b""
        final, text = web[url]
        return 200, "application/xml" if url.endswith(".xml") else "text/html", text.encode(), final

    found = spark.createDataFrame([FOUND[1], FOUND[4]], "seq long, url string, title string, result_type string").withColumn("normalized_url", F.col("url"))
    out = crawl.enrich(found, crawl.from_web(get, delay=0.0))
    got = sorted((p.seq, p.place, p.url, p.error) for p in out["pages"].collect())
    assert [(s, u.rsplit("/", 1)[1], e) for s, _, u, e in got] == [(2, "", None), (2, "contact-us", None), (2, "showroom", "status 404"), (2, "visit-us", None), (5, "", None), (5, "contact", None), (5, "locations", "status 404"), (5, "about", "status 404")]


def test_run_with_site_pages_and_model(spark):
    """A whole run: candidates, further pages of their sites, the model asked once for each evidence, lead and merge."""
    import json

    from waymark.operators import evaluate, model_step

    rows = [(u, *(v if isinstance(v, tuple) else (u, v))) for u, v in WEB.items()]
    pages = spark.createDataFrame(rows, "url string, final_url string, html string")
    found = spark.createDataFrame([(s, u, t, k, [f"q{s}"]) for s, u, t, k in FOUND[:7]], "seq long, url string, title string, result_type string, discovered_by_queries array<string>").withColumn("normalized_url", F.col("url"))

    def client(payload):
        made = json.loads(payload)
        assert "<p>" not in payload
        return json.dumps({
            "is_business": True, "business_name": "Told Name", "business_type": "BOUTIQUE", "women_fashion": "HIGH", "physical_store": "YES", "city": "Mumbai", "carries_other_brands": "YES", "designer_positioning": "MULTI_BRAND",
            "sustainability_focus": "UNKNOWN", "price_positioning": "UNKNOWN", "observed_price_range": "UNKNOWN", "style_fit": "HIGH", "potential_stockist": "UNKNOWN", "confidence": "HIGH", "evidence": made["enrichment_roles"],
        })

    model = model_step.Model(client)
    attached, merged = evaluate.evaluate(found, pages.select("url", "html"), get=crawl.from_table(pages), model=model)
    got = {r.seq: r for r in attached.collect()}
    assert got[2].site_enrichment.successful_urls == ["https://mapped.in/", "https://mapped.in/contact-us", "https://mapped.in/visit-us"] and got[2].email == "mail@mapped.in"
    assert got[2].ai_evidence == ["homepage", "contact", "location"] and got[2].city == "Mumbai" and got[2].physical_store == "YES"
    assert got[4].business_name == "Ananta" and got[4].rule_business_name == "Ananta" and got[4].ai_business_name == "Told Name"
    assert got[6].site_enrichment is None and got[6].ai_stockist in (None, "UNKNOWN")
    assert model.answers.count() == attached.where("attempted").select("payload_id").distinct().count() > 3
    assert merged.count() <= attached.count()
    plain, _ = evaluate.evaluate(found, pages.select("url", "html"))
    assert {r.seq for r in plain.collect()} == set(got) and "ai_city" not in plain.columns
