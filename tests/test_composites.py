"""Composite operators on hand-made rows, and queries without SQL by brute force."""

import json
import os
import re
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from waymark.operators import candidates, evaluate, export, research, sitemaps
from waymark.plans import CATALOG
from waymark.sources import providers

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def urlset(*locs):
    return "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"


def test_sitemaps_follow_indexes_in_order_of_priority(spark):
    site = "https://a.com"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.com/{x}.xml</loc></sitemap>" for x in ("product-map", "other", "page-map", "blog-map", "store-contact")) + "<sitemap><loc>https://b.com/page.xml</loc></sitemap></sitemapindex>"
    docs = [
        (site, "https://a.com/sitemap.xml", index), (site, "https://a.com/page-map.xml", urlset("https://a.com/about", "https://a.com/about/?utm_source=x", "https://b.com/contact")),
        (site, "https://a.com/store-contact.xml", urlset("https://a.com/contact", "https://a.com/product/shop")), (site, "https://a.com/other.xml", urlset("https://a.com/other")), (site, "https://a.com/product-map.xml", urlset("https://a.com/p1")),
        ("https://c.com", "https://c.com/sitemap.xml", "no xml"), ("https://d.com", "https://d.com/s.xml", urlset("https://d.com/x", "https://d.com/y")),
    ]
    df = spark.createDataFrame(docs, "site string, doc_url string, xml string")
    seeds = spark.createDataFrame([(site, "https://a.com/sitemap.xml", 0), ("https://c.com", "https://c.com/sitemap.xml", 0), ("https://d.com", "https://d.com/s.xml", 0)], "site string, doc_url string, ord int")
    got = {}
    for r in sitemaps.locations(seeds, df).orderBy("site", "position").collect():
        got.setdefault(r.site, []).append(r.url)
    assert got == {site: ["https://a.com/contact", "https://a.com/product/shop", "https://a.com/about"], "https://d.com": ["https://d.com/x", "https://d.com/y"]}
    robots = spark.createDataFrame([(site, "User-agent: *\nSitemap: https://a.com/one.xml\nsitemap: https://b.com/x.xml\nSitemap: https://www.a.com/one.xml\nSitemap: https://a.com/two.xml")], "site string, text string")
    assert [r.doc_url for r in sitemaps.seeds_of(robots).orderBy("ord").collect()] == ["https://a.com/one.xml", "https://a.com/two.xml"]


def test_sitemaps_are_cut_by_normal_forms(spark):
    site, most = "https://a.com", sitemaps.MAX_LOCATIONS
    twice = [f"https://a.com/{i}{end}" for i in range(most + 1) for end in ("", "/")]
    docs = spark.createDataFrame([(site, "https://a.com/s.xml", urlset(*twice))], "site string, doc_url string, xml string")
    got = sitemaps.locations(docs.select("site", "doc_url", F.lit(0).alias("ord")), docs).collect()
    assert [r.url for r in sorted(got, key=lambda r: r.position)] == [f"https://a.com/{i}" for i in range(most)]


def test_budgeted_providers():
    now = [datetime(2024, 1, 31, 23, tzinfo=timezone.utc)]
    budget = providers.CallBudget(2, 3, clock=lambda: now[0])
    made = []

    def search(request):
        made.append(request["q"])
        if request["q"] == "bad":
            raise ValueError("down")
        return [{"title": request["q"]}]

    p = providers.budgeted(providers.Provider("p", lambda r: r["q"] != "odd", search), budget)
    assert p.search({"q": "a"}) == [{"title": "a"}] and p.search({"q": "odd"}) == []
    with pytest.raises(ValueError):
        p.search({"q": "bad"})  # has spent its call
    with pytest.raises(providers.BudgetExceeded):
        p.search({"q": "c"})
    now[0] = datetime(2024, 2, 1, 0, 30, tzinfo=timezone.utc)
    assert p.search({"q": "d"}) and made == ["a", "bad", "d"]
    with pytest.raises(InterruptedError):
        providers.budgeted(providers.Provider("p", lambda r: True, search), budget, aborted=lambda: True).search({"q": "e"})
    assert budget.used["p", "2024-02"] == 1
    budget.reserve("p", 0)
    names = [x.name for x in providers.build_providers({"p": lambda: p, "q": lambda: p}, ["q", "none"], budget)]
    assert names == ["p"]


def test_settings_from_files(tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='two words'\nC\n=x\nD=old\n")
    environ = {"D": "kept"}
    assert providers.load_env(str(tmp_path / ".env"), environ) == {"A": "1", "B": "two words"} and environ["D"] == "kept"
    assert providers.load_env(str(tmp_path / "none"), environ) == {}
    s = providers.model_settings({"MODEL_ENABLED": "Yes", "MODEL_TIMEOUT": "0.1", "MODEL_URL": "http://x/"})
    assert (s.enabled, s.timeout, s.url) == (True, 1.0, "http://x") and providers.model_settings({"MODEL_TIMEOUT": "soon"}).timeout == 90.0
    for n in ("seeds_2024.json", "seeds_2025.json", "zother.json"):
        (tmp_path / n).write_text("{}")
    assert providers.newest_report(str(tmp_path)).name == "seeds_2025.json" and providers.newest_report(str(tmp_path), "no") is None


OWNER = """<html><head><title>Rose House | Designer Boutique</title><meta property="og:site_name" content="Rose House"></head><body><h1>Rose House</h1>
<p>A designer boutique for womenswear with a curated multi-brand collection of independent designers. Visit our store.</p><p>12 Beach Road, Goa 403001.</p>
<a href="https://instagram.com/rosehouse">ig</a><a href="mailto:hi@rose.in">mail</a></body></html>"""
LISTING = """<html><head><title>10 best boutiques in Goa</title></head><body><h1>10 best boutiques in Goa</h1><h2>Paper Moon</h2><a href="https://bluedoor.in/">Blue Door Studio</a><p> 1. Velvet Lane, 4 Market Road, Goa 403002. </p></body></html>"""


def test_run_from_hits_to_businesses(spark):
    hits = [
        (0, "Rose House", "https://rose.in/", "", "s", "boutiques goa"), (1, "Rose", "https://www.rose.in/about", "", "s", "goa shops"), (2, "Best", "https://mag.com/blog/best", "", "s", "boutiques goa"),
        (3, "ig", "https://instagram.com/lonely", "", "s", "goa shops"), (4, "Gone", "https://gone.in/", "", "s", "goa shops"),
    ]
    h = spark.createDataFrame(hits, "seq long, title string, url string, snippet string, source string, query string")
    pages = spark.createDataFrame([("https://rose.in", OWNER), ("https://mag.com/blog/best/", LISTING), ("https://gone.in/", None)], "url string, html string")
    specs = spark.createDataFrame([("boutiques goa", 20), ("goa shops", 2), ("nothing", 5)], "query string, limit int")
    asked = []

    def search(queries):
        asked.append(sorted(r.query for r in queries.select("query").collect()))
        return h

    out = evaluate.run_batch(specs, search, pages)
    assert asked == [["boutiques goa", "goa shops", "nothing"]]
    rows = {r.business_name: r for r in out["rows"].collect()}
    rose = rows["Rose House"]
    assert (rose.business_type, rose.relationship, rose.stockist_lead, rose.city) == ("BOUTIQUE", "SELF", "UNKNOWN", "Goa") or rose.stockist_lead == "YES"
    assert rose.email == "hi@rose.in" and rose.instagram == "https://instagram.com/rosehouse" and rose.physical_store == "YES" and "403001" in rose.address
    assert [s.query for s in rose.discovery_sources] == ["boutiques goa", "goa shops"]
    assert {"Blue Door Studio", "Paper Moon", "Velvet Lane"} <= set(rows) and rows["Paper Moon"].relationship == "MENTIONED_BUSINESS"
    assert "Best" not in rows and rows["Velvet Lane"].fit_score <= rose.fit_score
    social = [r for r in out["rows"].collect() if r.source_type == "SOCIAL"]
    assert not social or social[0].instagram
    assert out["businesses"].where("business_name = 'Rose House'").count() == 1
    metrics = {r.query: (r.raw_results, r.unique_candidates) for r in out["query_metrics"].collect()}
    assert metrics["nothing"] == (0, 0) and metrics["boutiques goa"][0] == 2
    summary = out["summary"].first()
    assert summary.requested == 27 and summary.raw_results == 5
    empty = evaluate.inspect(candidates.candidates_from_hits(h), pages.limit(0)).collect()
    assert all(not r.fetched and r.text == "" for r in empty) and [r.social_urls for r in empty if r.result_type == "SOCIAL"] == [["https://instagram.com/lonely"]]
    assert evaluate.evaluate(candidates.dedupe(candidates.candidates_from_hits(h.limit(0))), pages)[0].count() == 0


def test_need_follows_from_evidence(spark):
    from waymark.operators import enrich, signals
    from waymark.sources import pages

    bare = "<html><head><title>Home</title></head><body><p>Hello.</p></body></html>"
    e = pages.page_evidence(spark.createDataFrame([("https://rose.in/", OWNER), ("https://bare.in/", bare)], "url string, html string")).withColumns({"id": F.col("url"), "search_title": F.lit(None).cast("string")})
    got = {r.id: (r.tier, r.wanted_roles, [r[f] for f in enrich.NEEDS]) for r in enrich.assess_need(signals.business_signals(e)).collect()}
    assert got["https://rose.in/"][0] == "STRONG" and got["https://rose.in/"][2] == [True] * 6
    assert got["https://bare.in/"] == ("WEAK", ["contact", "location", "about", "business", "fashion"], [False] * 6)


def test_pages_of_other_cities_are_not_followed(spark):
    from waymark.operators import enrich

    rows = [("https://a.com/goa", "https://a.com/mumbai/contact", 0), ("https://a.com/goa", "https://a.com/goa/contact", 100), ("https://a.com/", "https://a.com/mumbai/contact", 100), ("https://a.com/goa", "https://a.com/locations", None), ("https://a.com/goa", "https://a.com/locations/panjim-town", 0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "root string, url string")
    for r, (_, _, want) in zip(df.select(enrich.page_score(F.col("url"), F.col("root"), F.lit("")).alias("s")).collect(), rows):
        assert r.s == want if want is not None else r.s > 0


def test_research_asks_each_plan_once(spark):
    schema = "seq long, business_name string, address string, city string, website string, instagram string, facebook string, whatsapp string, phone string, email string, physical_store string, snippet string, source_url string, confidence string"
    calls = []

    def search(plan):
        asked = [r.query for r in plan.select("query").collect()]
        calls.append(len(asked))
        rows = [(len(calls) * 100 + i, f"Shop {q[-3:]}", None, "Goa", f"https://s{hash(q) % 97}.in", None, None, None, None, None, "UNKNOWN", "fashion boutique", "u", "LOW") for i, q in enumerate(asked)]
        return spark.createDataFrame(rows, schema)

    initial = spark.createDataFrame([(i, f"query {i:03d}") for i in range(30)], "seq long, query string")
    gaps = lambda pool: spark.createDataFrame([(900 + i, f"gap {i:03d}") for i in range(3)], "seq long, query string")
    pool, spent = research.research(initial, search, gaps, 40)
    before = len(calls)
    assert pool.count() > 0 and pool.count() == pool.count()
    assert len(calls) == before <= 4 and sum(calls) == spent <= 40


def test_lead_files(spark, tmp_path):
    schema = "business_name string, city string, website string, phone string, confidence string, business_type string, stockist_lead string, relationship string, geography string, source_url string"
    rows = [{"business_name": "Rose", "city": "Goa", "website": "https://rose.in", "confidence": "very high", "business_type": "multi designer", "stockist_lead": "YES", "relationship": "SELF", "geography": "YES"}, {"business_name": "Rose Two", "city": "Goa", "website": "https://www.rose.in/x", "phone": "12"}, {"business_name": "Öl", "website": "https://instagram.com/p/x"}]
    for name, payload in (("a.json", rows), ("b.json", {"business_candidates_llm": rows, "other": 1})):
        (tmp_path / name).write_text(json.dumps(payload))
        got = export.load_records(spark, str(tmp_path / name), schema).orderBy("seq").collect()
        assert [(r.seq, r.business_name, r.confidence, r.business_type) for r in got] == [(0, "Rose", "LOW", "MULTI_DESIGNER"), (1, "Rose Two", "LOW", "UNKNOWN"), (2, "Öl", "LOW", "UNKNOWN")]
    none = F.lit(None).cast("string")
    flags = ("own_label", "listicle", "online_only", "identity_invalid", "unrelated", "identity_weak", "third_party", "usable_contact", "social_only", "social_retail", "retail_evidence", "stockist_evidence")
    full = export.load_records(spark, str(tmp_path / "a.json"), schema).withColumns({c: none for c in ("instagram", "facebook", "whatsapp", "email", "address")} | {c: F.lit(c in ("usable_contact", "retail_evidence", "stockist_evidence")) for c in flags} | {"is_business": F.lit("YES"), "ai_stockist": F.lit("UNKNOWN"), "physical_store": F.lit("UNKNOWN")})
    decided, names = export.export_records(full)
    kept = {r.business_name: r for r in decided.collect()}
    assert set(kept) == {"Rose", "Öl"} and kept["Rose"].n_merged == 2 and kept["Rose"].export_group == "LEAD"
    export.write_exports(decided, str(tmp_path / "out"))
    made = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert made == ["stockist_excluded.csv", "stockist_export_summary.json", "stockist_leads.csv", "stockist_leads.json", "stockist_leads_only.csv", "stockist_review_only.csv"]
    text = next((tmp_path / "out" / "stockist_leads_only.csv").glob("part*")).read_bytes()
    header, first = text.decode("utf-8").splitlines()[:2]
    assert text.startswith(b"\xef\xbb\xbf") and len(header.split(",")) == 39 and first.startswith("Rose,Goa")


def test_polite_fetching(spark):
    from waymark.sources import pages

    calls = spark.sparkContext.accumulator(0)

    def get(url):
        calls.add(1)
        if url.endswith("robots.txt"):
            return (200, "text/plain", b"User-agent: *\nDisallow: /private") if "a.com" in url else (500, "", b"")
        if "slow" in url:
            raise TimeoutError
        return 200, "image/png" if "png" in url else "application/xml" if "xml" in url else "text/html; charset=utf-8", b"x" * 10

    targets = spark.createDataFrame([(f"https://{h}.com/{p}",) for h in "ab" for p in ("ok", "private/1", "slow", "png", "xml")], "url string")
    got = {r.url: (r.error, r.requests) for r in pages.fetch(targets, get, delay=0.0, retries=1, most=4).collect()}
    errors = {k: v[0] for k, v in got.items()}
    assert errors["https://a.com/private/1"] == "robots" and errors["https://b.com/private/1"] is None and errors["https://a.com/slow"] == "TimeoutError"
    assert errors["https://a.com/png"] == "content type image/png" and errors["https://a.com/xml"] == "content type application/xml" and errors["https://a.com/ok"] is None
    assert sum(n for _, n in got.values()) == calls.value == 2 + 4 + 5 + 2  # robots files, pages of either host, and two more tries
    assert pages.fetch(targets.where("url LIKE '%xml'"), get, delay=0.0, allow_xml=True, allowed=lambda u: True).where("error IS NULL AND NOT truncated").count() == 2


def test_links_and_accounts_of_listings(spark):
    from waymark.operators import identify
    from waymark.sources import pages

    html = """<h1>Guide</h1><a href="https://www.b.com/x/?utm_source=q&b=1&a=2">Blue Door</a><a href="http://b.com/x?a=2&b=1#f">again</a><a href="https://instagram.com/moon.shop">Paper Moon</a><a href="https://instagram.com/p/1">A post here</a>
    <p>1. Velvet Lane, 4 Market Road, find it at https://instagram.com/velvet_lane today. 2. Other Place: nothing</p>"""
    e = pages.page_evidence(spark.createDataFrame([("https://mag.com/blog/l", html)], "url string, html string"))
    assert [l.url for l in e.first().links] == ["https://www.b.com/x/?utm_source=q&b=1&a=2", "https://instagram.com/moon.shop", "https://instagram.com/p/1"]
    rows = {r.business_name: r for r in identify.expand(e.withColumn("seq", F.lit(1))).collect()}
    assert rows["Paper Moon"].instagram == "https://instagram.com/moon.shop" and rows["Velvet Lane"].instagram == "https://instagram.com/velvet_lane"
    assert rows["Blue Door"].website.startswith("https://www.b.com/x") and rows["Velvet Lane"].source_type == "ARTICLE" and "A post here" not in rows


# --- queries without SQL ------------------------------------------------------


@tables
def test_keyword_windows_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    seen = 0
    for r in CATALOG["keyword_windows"].run(spark, FOLDER).collect():
        t, windows = texts[r.doc_id], []
        if t is None:
            assert r.excerpt is None
            continue
        for m in re.finditer(r"\bthat\b", t):
            windows.append(re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t[max(0, m.start() - 160) : m.end() + 220]))
            if len(" ".join(windows)) >= 1500:
                break
        seen += bool(windows)
        want = " … ".join(windows) if windows else t
        if len(want) < 400 and t:
            want = f"{want}\n{t}" if want else t
        assert r.excerpt == want[:1500]
    assert seen > 20


@tables
def test_budget_replay_by_brute_force(spark):
    events = sorted(spark.read.parquet(f"{FOLDER}/events.parquet").collect(), key=lambda r: r.event_id)
    day, month, want = {}, {}, {}
    for r in events:
        n, d, m = r.event_id % 4, (r.event_type, r.ts.date()), (r.event_type, r.ts.year, r.ts.month)
        fits = day.get(d, 0) + n <= 40 and month.get(m, 0) + n <= 600
        if fits:
            day[d], month[m] = day.get(d, 0) + n, month.get(m, 0) + n
        want[r.event_id] = fits
    assert {r.seq: r.admitted for r in CATALOG["budget_replay"].run(spark, FOLDER).collect()} == want


@tables
def test_name_merge_by_brute_force(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()
    kept, want = {}, {}
    for r in sorted(pages, key=lambda r: r.page_id):
        i = r.page_id
        site = re.sub(r"^www\.", "", re.match(r"https?://([^/?#:]+)", r.url)[1].lower()) if i % 3 else None
        facts = [site, f"shop{i % 40}" if i % 10 == 0 else None, f"91900000{i % 45:04d}" if i % 9 == 0 else None, "goa" if i % 2 == 0 else None]
        group = kept.setdefault(i % 60, [])
        for k in group:
            if all(a is None or b is None or a == b for a, b in zip(k[1], facts)):
                k[1] = [b if a is None else a for a, b in zip(k[1], facts)]
                want[i] = k[0]
                break
        else:
            group.append([i, facts])
            want[i] = i
    assert {r.seq: r.merged_into for r in CATALOG["name_merge"].run(spark, FOLDER).collect()} == want


@tables
def test_queries_agree_on_names(spark):
    names = {r.page_id: r.name for r in CATALOG["page_names"].run(spark, FOLDER).collect()}
    owners = CATALOG["identified_businesses"].run(spark, FOLDER).where("name_source = 'site_owner'").collect()
    assert owners and all(r.business_name == names[r.seq] for r in owners if names[r.seq] != "UNKNOWN")
    run = {r.seq: r.business_name for r in CATALOG["evaluated_candidates"].run(spark, FOLDER).where("source_type = 'WEBSITE'").collect()}
    known = {r.seq: r.business_name for r in owners}
    assert run and all(known[k] == v for k, v in run.items() if k in known)
    decided = {r.doc_id: r.status for r in CATALOG["fit_decision"].run(spark, FOLDER).collect()}
    for r in CATALOG["fit_explained"].run(spark, FOLDER).collect():
        assert r.status == decided[r.doc_id] and f"FINAL: {r.status}" in r.explanation and f"Reason: {r.reason}" in r.explanation
