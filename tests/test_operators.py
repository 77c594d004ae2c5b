import datetime as dt

import pytest
from pyspark.sql import functions as F

from waymark.functions import places
from waymark.operators import budget, classify, enrich, export, geo, graph, identify, model, ordered, queries, report, research, resolve, score, store
from waymark.sources import pages, search

FIT = "id int, text string, business_name string, city string, address string, website string, instagram string, facebook string, phone string, physical_store string, relationship string, geography string"


def test_fit_decisions(spark):
    lead = "Concept store with women's clothing and independent designers, curated fashion. Visit our store"
    rows = [
        (1, lead, "Shop", "Goa", "12 Road", None, None, None, None, None, "SELF", "YES"), (2, lead + " online-only", "Shop", None, None, None, None, None, None, None, "SELF", "YES"),
        (3, lead, "Shop", None, "12 Road", None, None, None, None, None, "SELF", "NO"), (4, "own-label only, womens fashion", "Shop", None, None, None, None, None, None, None, "SELF", "YES"),
        (5, "text", "Shop", None, None, None, None, None, None, None, "SELF", "UNKNOWN"), (6, "text", None, None, None, None, None, None, None, None, "ARTICLE", "UNKNOWN"),
    ]
    got = {r.id: r for r in score.assess_fit(spark.createDataFrame(rows, FIT)).collect()}
    assert [got[i].status for i in range(1, 7)] == ["LEAD", "EXCLUDED", "EXCLUDED", "EXCLUDED", "REVIEW", "EXCLUDED"]
    assert got[5].multi_brand == "UNKNOWN" and got[4].multi_brand == "NO" and got[2].physical == "NO"


def test_word_boundaries_of_scores_are_ascii(spark):
    rows = [(i, t, None, None, None, None, None, None, None, None, None, "UNKNOWN") for i, t in enumerate(("60 chbeau enschbe, üst", "60 chbeau enschbe, est", "60 chbeau enschbe, st"))]
    assert [r.physical_score for r in score.assess_fit(spark.createDataFrame(rows, FIT)).orderBy("id").collect()] == [5, 0, 5]


def test_equal_labels_add_points(spark):
    df = spark.createDataFrame([("shop no 5, 12 hill road, 403001",)], "t string")
    assert df.select(score.points(F.col("t"), score.rules.PHYSICAL_SIGNALS)).first()[0] == 15


def test_geography(spark):
    rows = [("1", "Panjim shop", "", "", None, "Goa"), ("2", "Mumbai", "", "", None, "Goa"), ("3", "x", "", "", None, "Goa"), ("4", "Goa", "", "", "https://a.co.uk", "Goa"), ("5", "Maharashtra", "", "", None, "Pune"), ("6", "Karnataka", "", "", None, "Bengaluru")]
    df = spark.createDataFrame(rows, "id string, profile string, address string, city string, website string, expected_city string")
    got = {r.id: r.geography for r in geo.verify(df, places.places(spark)).collect()}
    assert got == {"1": "YES", "2": "NO", "3": "UNKNOWN", "4": "NO", "5": "UNKNOWN", "6": "YES"}


RECORD = "seq long, business_name string, website string, instagram string, facebook string, whatsapp string, phone string, email string, address string, city string, source_url string, confidence string"


def records(spark, rows):
    full = [(i, n, w, ig, None, None, p, None, None, c, f"u{i}", "LOW") for i, n, w, ig, p, c in rows]
    return spark.createDataFrame(full, RECORD)


def test_chain_of_keys_is_one_record(spark):
    df = records(spark, [(0, "A", "a.com", None, "111", "Goa"), (1, "B", None, "@b", "111", "UNKNOWN"), (2, "C", None, "@b", None, "UNKNOWN"), (3, "D", None, None, None, "UNKNOWN")])
    merged, ambiguous = resolve.merge_connected(df)
    got = {r.component: r for r in merged.collect()}
    assert set(got) == {0, 3} and got[0].n_merged == 3 and got[0].city == "Goa" and got[0].instagram == "@b"
    assert ambiguous.count() == 0


def test_shared_phone_merges_but_name_with_other_site_does_not(spark):
    df = records(spark, [(0, "A", "a.com", None, "111", "Goa"), (1, "A", "b.com", None, None, "Goa"), (2, "X", "c.com", None, "111", "Pune")])
    merged, ambiguous = resolve.merge_connected(df)
    assert sorted(r.component for r in merged.collect()) == [0, 1]
    assert [(r.left_id, r.right_id) for r in ambiguous.collect()] == [(0, 1)]
    strict, _ = resolve.merge_connected(df, strict=True)
    assert strict.count() == 3


def test_first_key_merge_is_not_transitive(spark):
    df = records(spark, [(0, "A", "a.com", None, "111", None), (1, "B", None, None, "111", None), (2, "C", None, None, "111", None)])
    assert resolve.merge_by_first_key(df).count() == 2


def test_greedy_name_merge(spark):
    df = records(spark, [(0, "Ahi", "a.com", None, None, None), (1, "ahi", None, None, "1", "Goa"), (2, "Ahi", "b.com", None, None, None), (3, "Ahi", None, None, "2", "Goa")])
    got = {r.seq: r.merged_into for r in resolve.merge_same_name(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_known_records(spark):
    known = records(spark, [(0, "A", "a.com", None, None, None)])
    new = records(spark, [(1, "Z", "https://www.a.com/x", None, None, None), (2, "Q", None, None, None, None), (3, "R", None, "@r", None, None)])
    assert sorted(r.seq for r in resolve.new_records(new, known).collect()) == [2, 3]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(edges).select("component").distinct().collect()[0][0] == 0


def test_budget_replay_matches_ranks(spark):
    start = dt.datetime(2024, 1, 30, 23)
    rows = [(i, "p", start + dt.timedelta(minutes=20 * i), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, provider string, ts timestamp_ntz, calls int")
    a = {r.seq: r.admitted for r in budget.admit(df, 5, 12).collect()}
    b = {r.seq: r.admitted for r in budget.admit_units(df, 5, 12).collect()}
    assert a == b and sum(a.values()) == 3 + 5 or a == b


def test_refused_calls_spend_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(0, "p", day, 4), (1, "p", day, 3), (2, "p", day, 1), (3, "p", day, -1), (4, "p", day, 0)], "seq long, provider string, ts timestamp_ntz, calls int")
    assert [r.admitted for r in budget.admit(df, 5, 9).orderBy("seq").collect()] == [True, False, True, False, True]


def test_override_may_be_null(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id long, name string, score double")
    locks = spark.createDataFrame([(1, "name", None), (2, "score", "9"), (2, "id", "7"), (2, "zzz", "1")], "id long, field string, value string")
    got = [tuple(r) for r in store.apply_overrides(rows, locks, "id", ["id", "name", "score"]).orderBy("id").collect()]
    assert got == [(1, None, 2.0), (2, "b", 9.0)]


def test_queries_are_capped_and_city_first(spark):
    got = queries.generate(places.places(spark), places.templates(spark)).where("city = 'Goa'").orderBy("position").collect()
    assert len(got) <= places.MAX_QUERIES and got[0].query == "multi brand fashion store Goa"
    assert len({r.query.lower() for r in got}) == len(got)
    with pytest.raises(KeyError):
        places.templates(spark, ("nope",))


def test_expand_places(spark):
    rows = [("in", "India", "country", "India", []), ("goa", "Goa", "city", "India", ["Baga"]), ("pune", "Pune", "city", "India", []), ("lk", "Lanka", "country", "Lanka", [])]
    got = {(r.key, r.area) for r in geo.expand(spark.createDataFrame(rows, "key string, name string, type string, country string, neighbourhoods array<string>")).collect()}
    assert got == {("in", "Goa"), ("in", "Pune"), ("goa", "Baga"), ("pune", "Pune"), ("lk", "Lanka")}


def test_fold_orders(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (0, "a", ["y", "z"])], "seq long, k string, v array<string>")
    assert df.groupBy("k").agg(ordered.union_in_order(F.col("v"), F.col("seq")).alias("u")).first().u == ["y", "z", "x"]


def test_export_decisions(spark):
    base = {
        "seq": 0, "business_name": "A", "relationship": "SELF", "stockist_lead": "YES", "is_business": "YES", "geography": "YES", "own_label": False, "listicle": False, "ai_stockist": "UNKNOWN", "physical_store": "YES",
        "online_only": False, "identity_invalid": False, "unrelated": False, "ambiguous": False, "identity_weak": False, "third_party": False, "usable_contact": True, "social_only": False, "social_retail": False,
        "retail_evidence": True, "stockist_evidence": True,
    }
    changes = [({}, "LEAD"), ({"geography": "NO"}, "EXCLUDED"), ({"usable_contact": False}, "REVIEW"), ({"relationship": "DIRECTORY"}, "EXCLUDED"), ({"ai_stockist": "NO"}, "REVIEW"), ({"ambiguous": True, "listicle": False}, "REVIEW"), ({"own_label": True}, "EXCLUDED")]
    rows = [base | c | {"seq": i} for i, (c, _) in enumerate(changes)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {'int' if k == 'seq' else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in base.items()))
    got = [r.export_group for r in export.decide(df).orderBy("seq").collect()]
    assert got == [g for _, g in changes]


def test_export_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", "LEAD", ["x", "y"], True, "z" * 600, "w", "s")], "seq int, business_name string, export_group string, l array<string>, f boolean, long string, website string, source_url string")
    export.write_exports(df, str(tmp_path))
    row = spark.read.csv(f"{tmp_path}/lead", header=True).first()
    assert row.l == "x; y" and row.f == "TRUE" and len(row.long) == 500 and row.long.endswith("...")


def test_classification(spark):
    schema = "haystack string, name string, title string, addresses array<string>, page_roles array<string>, fact_fields array<string>, fact_sources array<string>, localities array<string>, has_contact boolean, website string"
    rows = [("Designer boutique. Visit us. womenswear", "A", "A Goa", ["12 Road, Goa 403001"], ["location"], [], [], [], True, "a.com"), ("hotel and spa", "B", "", [], [], [], [], [], False, None), ("online-only apparel", "C", "", [], [], [], [], ["Pune"], False, None)]
    got = classify.classify(spark.createDataFrame(rows, schema)).collect()
    assert [(r.business_type, r.physical_store, r.city) for r in got] == [("BOUTIQUE", "YES", "Goa"), ("UNKNOWN", "UNKNOWN", "UNKNOWN"), ("UNKNOWN", "NO", "Pune")]


def test_page_selection(spark):
    rows = [("https://x.com/", u, "", "homepage_link") for u in ("https://x.com/contact", "https://x.com/products/1", "https://x.com/stores", "https://x.com/about", "https://x.com/contact?x=1", "https://y.com/contact")]
    got = enrich.select_pages(spark.createDataFrame(rows, "root string, url string, anchor string, source string")).orderBy("rank").collect()
    assert [r.role for r in got] == ["contact", "location", "about"]


def test_mentions(spark):
    df = spark.createDataFrame([(1, "https://m.com/x", "1. Ahi House, 12 MG Road 2. Paper Moon - beach 3. Shops")], "seq long, url string, text string")
    got = identify.from_mentions(df).orderBy("ord").collect()
    assert [(r.business_name, r.address) for r in got] == [("Ahi House", "12 MG Road"), ("Paper Moon", None)]


def test_research_caps(spark):
    rows = [(i, f"Shop {i}", None, "Goa", None, None, "UNKNOWN", "fashion", "pending") for i in range(30)]
    pool = spark.createDataFrame(rows, "seq long, business_name string, address string, city string, website string, instagram string, physical_store string, snippet string, status string")
    plan = research.plan_enrichment(pool).collect()
    assert len(plan) == 18 and max(sum(r.seq == i for r in plan) for i in range(30)) == 2


def test_model_failures_are_kinds(spark):
    def client(text):
        if "t" in text:
            raise TimeoutError
        raise ValueError

    rows = spark.createDataFrame([(1, "t"), (2, "x")], "seq long, payload string")
    assert [r.failure_kind for r in model.call(rows, client).orderBy("seq").collect()] == ["timeout", "model"]
    assert {r.failure_kind for r in model.call(rows, None).collect()} == {"disabled"}


def test_model_schema_errors(spark):
    got = spark.createDataFrame([("nope",), ('{"is_business": 1}',)], "raw string").select(model.schema_errors(F.col("raw")).alias("e")).collect()
    assert got[0].e == ["json"] and "is_business:boolean" in got[1].e


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, f string")
    b = spark.createDataFrame([(1, "y"), (2, "n"), (4, "w")], "k long, f string")
    got = {r.k: r.change for r in report.compare(a, b, "k", ["f"]).collect()}
    assert got == {1: "changed", 2: "gained", 3: "lost", 4: "gained"}


def test_page_evidence(spark):
    page = '<html><head><title>T</title><script type="application/ld+json">{"@graph":[{"@type":["Thing","ClothingStore"],"name":"S","address":{"addressLocality":"Goa"}}]}</script><script type="application/ld+json">{bad</script></head><body><h1>H</h1><a href="/about">About</a></body></html>'
    e = pages.page_evidence(spark.createDataFrame([("https://x.com/", page), ("https://y.com", None)], "url string, html string")).collect()
    assert e[0].links[0].url == "https://x.com/about" and {f.field for f in e[0].facts} >= {"name", "addressLocality"} and e[1].text == ""


def test_cut_references_stay_as_they_are(spark):
    page = '<title>Rose &amp; Co &&amp</title><script type="application/ld+json">{"@type":"Store","name":"R & C &amp"}</script><!-- &amp --><h1>&lt;A&gt; &amp</h1><a href="/about?a=1&copy=2&amp;b=3">x</a>'
    e = pages.page_evidence(spark.createDataFrame([("https://x.com/", page)], "url string, html string")).first()
    assert (e.title, e.headings, e.text) == ("Rose & Co &&amp", ["<A> &amp"], "<A> &amp x")
    assert e.links[0].url == "https://x.com/about?a=1&copy=2&b=3" and [f.value for f in e.facts if f.field == "name"] == ["R & C &amp"]


def test_words_of_names_are_parted_by_tags_and_the_first_title_counts():
    e = pages.evidence_of("https://x.com/", '<svg><title>i</title></svg><title>Rose</title><svg><title>icon</title></svg><title>Old</title><h1>Li<b>ly</b><br>Co 2<3</h1><a href="/a">Re<i>ad</i></a>')
    assert (e["title"], e["headings"], [l["anchor_text"] for l in e["links"]], e["text"].split()[0]) == ("Rose", ["Li ly Co 2<3"], ["Re ad"], "Li")
    open_ = pages.evidence_of("https://x.com/", "<title>Rose<h1>Lily<h2>Daisy</h2>text")
    assert (open_["title"], open_["headings"], open_["text"]) == (None, ["Lily Daisy"], "Rose Lily Daisy text")


def test_pages_are_parsed_in_slices(spark):
    n = 2 * pages.AT_ONCE + 1
    some = spark.range(n).coalesce(1).select(F.concat(F.lit("https://x.com/"), "id").alias("url"), F.concat(F.lit("<h1>"), "id", F.lit("</h1>")).alias("html"))
    assert [(r.url, r.headings) for r in pages.page_evidence(some).collect()] == [(f"https://x.com/{i}", [str(i)]) for i in range(n)]


def test_fetch_keeps_failures(spark):
    def get(url):
        if "bad" in url:
            raise OSError
        return (404, "text/html", b"") if "gone" in url else (200, "text/html", b"ok")

    got = {r.url: r for r in pages.fetch(spark.createDataFrame([("https://a.com/1",), ("https://a.com/bad",), ("https://a.com/gone",)], "url string"), get, delay=0.0).collect()}
    assert got["https://a.com/1"].html == "ok" and got["https://a.com/bad"].error == "OSError" and got["https://a.com/gone"].error == "status 404"


def test_payloads(spark):
    df = spark.createDataFrame([(1, "q", '{"results":[{"title":"A","url":"u","engines":["x","y"]},{"engine":"e"}]}'), (2, "q", "no")], "seq int, query string, payload string")
    got = search.parse_payloads(df).collect()
    assert [(r.title, r.source) for r in got] == [("A", "x, y")]


def fake_search(query, limit):
    if query == "bad":
        raise ValueError("down")
    return [{"title": query, "url": f"https://{i}.com"} for i in range(limit + 5)]


def test_search_source(spark):
    spark.dataSource.register(search.SearchSource)
    df = spark.read.format("waymark_search").option("queries", "a\nbad").option("limit", "3").option("client", "test_operators:fake_search").load()
    rows = df.collect()
    assert sum(r.error is None for r in rows) in (0, 3) and any(r.error for r in rows)


LEAD = "seq int, text string, business_name string, business_type string, source_type string, signals array<string>, positioning string, carries_other_brands string, relationship string, geography string, excluded boolean, exclude_reason string, address string, website string, instagram string, facebook string, email string, phone string, maps_url string, is_business string"


def test_lead_gate(spark):
    from waymark.operators import lead

    def row(i, **kw):
        base = dict(seq=i, text="a concept store", business_name="A", business_type="UNKNOWN", source_type="WEBSITE", signals=[], positioning=None, carries_other_brands=None, relationship="SELF", geography="YES", excluded=False, exclude_reason=None, address=None, website="w", instagram=None, facebook=None, email=None, phone=None, maps_url=None, is_business="YES")
        return tuple((base | kw).values())

    rows = [
        row(0), row(1, excluded=True, relationship="ARTICLE", exclude_reason="not_self_business:ARTICLE"), row(2, text="a wholesaler"), row(3, positioning="OWN_LABEL"), row(4, positioning="OWN_LABEL", carries_other_brands="YES"),
        row(5, text="x", business_name=None, website=None), row(6, text="x"), row(7, website=None), row(8, source_type="DIRECTORY"),
    ]
    df = lead.assess(spark.createDataFrame(rows, LEAD))
    got = df.orderBy("seq").select("stockist_lead", lead.failure_class(df).alias("f")).collect()
    assert [r.stockist_lead for r in got] == ["YES", "NO", "NO", "NO", "YES", "UNKNOWN", "UNKNOWN", "UNKNOWN", "NO"]
    assert got[7].f == "D_identified_contact_missing" and got[6].f == "A_found_insufficient_evidence"


def test_names_and_facts(spark):
    from waymark.operators import signals

    fact = "struct<field string, value string, source string, evidence string, confidence string, schema_type string>".replace(" string", ":string")
    schema = f"id int, role string, facts array<{fact}>, og_site_name string, meta_brand string, headings array<string>, title string, search_title string"
    rows = [
        (1, "homepage", [("name", "Org Name", "jsonld_organization", "", "HIGH", "")], "Site", None, ["Head"], "Title", None), (2, "about", [], None, None, ["About us: Rose Studio"], "About", "Rose"),
        (3, "homepage", [], None, None, ["Home"], "10 best shops in Goa", None),
    ]
    got = {r.id: (r.name, r.source) for r in signals.choose_name(signals.name_candidates(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: ("Org Name", "jsonld_organization"), 2: ("Rose Studio", "about_page_heading")}


def test_snippets(spark):
    from waymark.operators import signals

    df = spark.createDataFrame([("Come to 12 Hill Road, Bandra. Now",), ("near the church Panjim 403001 Goa",), ("nothing",)], "t string")
    assert [r.a for r in df.select(signals.snippet_address(F.col("t")).alias("a")).collect()] == ["12 Hill Road, Bandra", "near the church Panjim 403001", None]


def test_seeds(spark):
    from waymark.operators import seeds

    s = spark.createDataFrame([(1, "Paper Boat Collective", "Goa"), (2, "Rangeela", "Goa")], "seed_id int, seed_name string, seed_city string")
    h = spark.createDataFrame([(0, 1, "https://airbnb.com/x", "Paper Boat"), (1, 1, "https://paperboatcollective.com/", "Home"), (2, 2, "https://mag.com/blog/r", "Rangeela and others")], "seq int, seed_id int, url string, title string")
    got = {r.seed_id: (r.website, r.mentioned, r.relation) for r in seeds.resolve(s, h).collect()}
    assert got[1] == ("https://paperboatcollective.com/", True, "OFFICIAL_WEBSITE") and got[2] == (None, True, "UNRESOLVED")


def test_configuration(spark):
    from waymark.sources import config

    assert config.check_places([{"key": "a", "name": "A", "type": "city", "country": "X", "bbox": [1, 2, 0, 3]}, {"key": "a"}])
    p = spark.createDataFrame([("goa", "India", ["en", "xx"]), ("rome", "Italy", ["it"])], "key string, country string, languages array<string>")
    m = spark.createDataFrame([("in", ["India"], ["en"], "INR")], "market string, countries array<string>, languages array<string>, currency string")
    b = spark.createDataFrame([("in", "USD")], "market string, currency string")
    problems = sorted(r.problem for r in config.cross_problems(p, m, b).collect())
    assert problems == ["goa: market in has no words in xx", "market in: price band is in USD, not INR", "rome: no market covers Italy"]
    assert config.robots_allow("User-agent: *\nDisallow: /x", 200, "https://a.com/y") and not config.robots_allow("User-agent: *\nDisallow: /x", 200, "https://a.com/x/1") and config.robots_allow(None, 404, "https://a.com")


def test_expected_places(spark):
    rows = [("Goa, India", None, None, None, None), (None, "Bangalore", None, None, None), (None, None, None, None, "shops in new delhi"), ("Atlantis, Sea", None, None, None, None), (None, None, None, None, "shops")]
    got = geo.expected_places(spark.createDataFrame(rows, "label string, city string, state string, country string, query string"), places.places(spark)).collect()
    found = {(r.label or r.city or r.query): (r.expected_city, r.expected_state, r.expected_country) for r in got}
    assert found["Bangalore"] == ("Bengaluru", "Karnataka", "India") and found["shops in new delhi"][0] == "Delhi" and found["Atlantis, Sea"] == ("Atlantis", "Sea", "India") and found["shops"] == (None, None, None)
    assert found["Goa, India"][:2] == ("Goa", "India")


def test_keyword_windows_reach_past_the_start(spark, tmp_path):
    from waymark.plans import CATALOG

    rows = [(1, "x " * 1500 + "seen only that once " + "y " * 1500), (2, "none " * 600), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.excerpt for r in CATALOG["keyword_windows"].run(spark, str(tmp_path)).collect()}
    assert "seen only that once" in got[1]
    assert got[2] == rows[1][1][:1500] and got[3] is None


def test_few_and_many_terms_are_found_alike(spark, monkeypatch):
    from waymark.operators import geo

    texts = spark.createDataFrame([(1, "North Goa, and goa!"), (2, "gooa north-goa"), (3, None), (4, ""), (5, "New  Delhi / new delhi metro line")], "id int, text string")
    terms = spark.createDataFrame([("Goa", "goa"), ("Goa", "North Goa"), ("Delhi", "new delhi"), ("X", "delhi metro line now"), ("Y", " "), ("Z", "delhi metro line")], "city string, term string")
    few = sorted(map(tuple, geo.term_hits(texts, terms, "id", "text").collect()))
    monkeypatch.setattr(geo, "FEW_TERMS", 2)
    assert few == sorted(map(tuple, geo.term_hits(texts, terms, "id", "text").collect()))
    assert [(r[0], r[2]) for r in few] == [(1, "North Goa"), (1, "goa"), (2, "North Goa"), (2, "goa"), (5, "new delhi"), (5, "delhi metro line")]
