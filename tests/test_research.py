"""Four rounds of research over an offline search that counts what it is asked."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import phrases as P
from waymark.operators import research

HITS = {
    "boutiques in goa": [("Aria Boutique", "https://aria.in/", "A multi brand fashion boutique"), ("Bela Studio", "https://instagram.com/bela", "fashion dresses"), ("Ten best shops", "https://www.tripadvisor.com/x", "list")],
    "designers in goa": [("Aria Boutique", "https://www.aria.in/about", "12 Hill Road, Goa 403001"), ("Cleo", "https://cleo.in", "fashion store")],
    "shops in panjim": [("Dora Fashion", "https://dora.in", "boutique fashion")],
    '"bela studio" goa address': [("Bela Studio Goa", "https://belastudio.in/", "Shop 4, 18 June Road, Panjim 403001")],
    '"cleo" goa address': [("Other", "https://other.in", "Cleo sits at 7 Church Street")],
    '"cleo" goa instagram': [("Cleo (@cleo)", "https://instagram.com/cleo.goa", "")],
    "down": None,
}
GAP = "independent fashion boutique Mapusa"
HITS[GAP.lower()] = [("Aria Boutique", "https://aria.in/mapusa", ""), ("Eve House", "https://eve.in", "fashion"), ("Bela Studio", "https://instagram.com/bela", "")]


@pytest.fixture(scope="module")
def run(spark):
    specs = spark.createDataFrame([(1, "boutiques in Goa", "a", "Goa", "Goa"), (2, "down", "b", "Goa", "Goa"), (3, "designers in Goa", "b", "Goa", "Goa"), (4, "Boutiques in goa", "c", "Goa", "Goa"), (5, "shops in Panjim", "a", "Panjim", "Goa")], "seq long, query string, family string, location string, city string")
    asked = []

    def search(plan):
        rows = []
        for r in plan.orderBy("place").collect():
            asked.append(r.query)
            found = HITS.get(r.query.lower(), [])
            rows += [(r.query, 0, None, None, None, "down")] if found is None else [(r.query, i, *h, None) for i, h in enumerate(found)]
        return plan.sparkSession.createDataFrame(rows, "query string, ord int, title string, url string, snippet string, error string")

    gaps = lambda pool: spark.createDataFrame([("Goa", "mapusa")], "city string, term string")
    out = research.run_rounds(specs, search, gaps, now="2024-05-01")
    return {k: v.collect() for k, v in out.items()}, asked, (specs, search, gaps)


def test_every_query_is_asked_once(run):
    asked = [q.lower() for q in run[1]]
    assert len(asked) == len(set(asked)) == len(run[0]["queries"]) <= P.RESEARCH_CAPS["total"]
    rounds = {r.round for r in run[0]["queries"]}
    assert rounds == {1, 2, 3, 4} and [r.query for r in run[0]["queries"] if r.round == 3] == [GAP]
    assert [(e.round, e.error) for e in run[0]["errors"]] == [(1, "down")]
    assert sum(r.round in (2, 4) for r in run[0]["queries"]) <= P.RESEARCH_CAPS["enrichment"]


def test_state_goes_through_merges(run):
    pool = {r.business_name: r for r in run[0]["pool"]}
    assert set(pool) == {"Aria Boutique", "Bela Studio", "Cleo", "Dora Fashion", "Eve House"}
    aria, bela, cleo, eve = (pool[k] for k in ("Aria Boutique", "Bela Studio", "Cleo", "Eve House"))
    # two hits of round 1 and one of round 3 are one business, which keeps its first id, round, source and what was asked
    assert aria["round"] == 1 and aria.source == "https://aria.in/" and aria.address and aria.status == "enriched" and len(aria.queries) == 2
    assert bela.status == "enriched" and bela.website == "https://belastudio.in/" and "18 June Road" in bela.address and bela.researched_at == "2024-05-01"
    assert cleo.instagram == "https://instagram.com/cleo.goa" and "7 Church Street" in cleo.address
    assert eve["round"] == 3 and eve.status == "enriched" and len(eve.queries) == 2
    ids = [r.research_id for r in run[0]["pool"]]
    assert len(ids) == len(set(ids))
    by_id = {r.research_id: r.business_name for r in run[0]["pool"]}
    assert {by_id[q.research_id] for q in run[0]["queries"] if q.round == 4} == {"Eve House"}
    assert all("Eve House" in q.query for q in run[0]["queries"] if q.round == 4)


def test_caps(run):
    specs, search, gaps = run[2]
    caps = P.RESEARCH_CAPS | {"total": 5, "initial": 2, "enrichment": 2}
    out = research.run_rounds(specs, search, gaps, caps=caps)
    got = [r.round for r in out["queries"].collect()]
    assert sorted(got) == [1, 1, 2, 2, 3]


def test_refreshed(spark):
    rows = [(1, "Aria", "Goa", "https://a.in", "https://instagram.com/a", "12 Hill Road 403001", "YES", "multi brand", "pending"), (2, "Shop Now", None, None, None, None, None, None, "pending"), (3, "Shop Now", None, None, None, None, None, None, "enriched"), (4, "Bela", "Goa", None, None, None, None, None, "pending")]
    df = spark.createDataFrame(rows, "seq long, business_name string, city string, website string, instagram string, address string, physical_store string, snippet string, status string")
    got = {r.seq: (r.status, len(r.missing) > 0) for r in research.refreshed(df.withColumn("brands_known", F.lit(True))).collect()}
    assert got == {1: ("enriched", False), 2: ("skipped", True), 3: ("enriched", True), 4: ("pending", True)}


def test_terms_of_any_length(spark, monkeypatch):
    """A locality of four words is found, few terms or many."""
    from waymark.operators import geo

    terms = spark.createDataFrame([("Hill", 1), ("New Hill Road", 2), ("Upper New Hill Road East", 3), ("sector 12 b", 4), ("--", 5)], "term string, n int")
    texts = spark.createDataFrame([(1, "At upper new hill-road east, now"), (2, "Sector 12, B"), (3, None)], "id long, t string")
    for few in (100, 0):
        monkeypatch.setattr(geo, "FEW_TERMS", few)
        assert sorted((r.id, r.n) for r in geo.term_hits(texts, terms, "id", "t").collect()) == [(1, 1), (1, 2), (1, 3), (2, 4)]
