"""Seeds resolved by hits that don't say whom they were searched for."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import seeds

SEEDS = [
    (1, "Aria Moda", "Goa", ["Casa Aria"], None, None), (2, "The Shop", "Goa", None, None, None), (3, "Rangeela House", "Panjim", None, "https://instagram.com/rgl.official", None),
    (4, "Bela", "Goa", None, None, None), (5, "Villa Mor", "Goa", None, None, None), (6, "Zed Nine Studio", "Goa", None, None, None), (7, "", "Goa", None, None, None), (8, "Aria Moda", "Delhi", None, None, None),
]
HITS = [
    (1, "https://www.tripadvisor.com/aria-moda", "Aria Moda - Tripadvisor", "Goa"), (2, "https://ariamoda.in/shop", "Clothes", ""), (3, "https://instagram.com/ariamoda.goa", "Aria Moda (@ariamoda.goa)", "Anjuna"),
    (4, "https://instagram.com/p/xyz", "Aria Moda Goa", "Goa"), (5, "https://www.google.com/maps/place/Aria", "Casa Aria", "Assagao, Goa"), (6, "https://rangeela.com/", "Rangeela House | Panjim", ""), (7, "https://instagram.com/rgl.official", "Rangeela House", ""),
    (8, "https://facebook.com/belagoa", "Bela", "Goa"), (9, "https://facebook.com/villamor.fans", "Fans", "Villa Mor Vagator"), (10, "https://blog.example.com/news/villa-mor", "Villa Mor, Goa", ""), (11, "https://zednine.in/", "Best shops: Zed Nine Studio", ""),
    (12, "https://theshop.example.com/", "The Shop", "x"), (13, "https://ariamoda.com/", "Aria Moda", "later"), (14, None, None, None), (15, "https://oldhouse.in/about", "Villa Mor", "an old house"),
]


@pytest.fixture(scope="module")
def tables(spark):
    s = spark.createDataFrame(SEEDS, "seed_id long, seed_name string, seed_city string, aliases array<string>, instagram string, facebook string")
    return s, spark.createDataFrame(HITS, "seq long, url string, title string, snippet string")


@pytest.mark.parametrize("few", [200, 0])
def test_identities(tables, monkeypatch, few):
    monkeypatch.setattr(seeds, "FEW_KEYS", few)
    got = {r.seed_id: r for r in seeds.identities(*tables).collect()}
    assert len(got) == len(SEEDS)
    aria = got[1]
    assert (aria.website_url, aria.instagram_url, aria.google_url) == ("https://ariamoda.in/shop", "https://instagram.com/ariamoda.goa", "https://google.com/maps/place/Aria")
    assert aria.identity_sources == ["OFFICIAL_WEBSITE", "OFFICIAL_INSTAGRAM", "GOOGLE_BUSINESS"] and aria.identity_type == "MULTIPLE" and aria.resolution_path == "official_website"
    assert got[3].instagram_url == "https://instagram.com/rgl.official" and got[3].website_url == "https://rangeela.com"
    assert got[4].identity_type == "FACEBOOK" and got[4].resolution_path == "official_facebook"
    assert got[5].identity_type == "FACEBOOK" and got[5].facebook_url == "https://facebook.com/villamor.fans"
    assert (got[6].identity_type, got[6].discovered, got[6].identity_verified) == ("UNRESOLVED", True, False)
    assert got[2].website_url == "https://theshop.example.com" and got[7].identity_type == "UNRESOLVED" and not got[7].discovered


@pytest.mark.parametrize("few", [200, 0])
def test_blocking_loses_no_match(spark, tables, monkeypatch, few):
    """Every pair that any rule accepts is among the pairs that meet."""
    monkeypatch.setattr(seeds, "FEW_KEYS", few)
    s, h = tables
    h = h.withColumn("hay", F.concat_ws(" ", "title", "snippet", "url"))
    met = {tuple(r) for r in seeds.facing(s, h).collect()}
    every = s.crossJoin(h)
    signals = seeds.profile_signals(F.col("seed_name"), F.col("aliases"), F.col("seed_city"), F.col("url"), F.col("hay"), F.lit(False))
    accepted = every.where(seeds.named(F.col("seed_name"), F.col("aliases"), F.col("hay")) | seeds.is_own_site(F.col("seed_name"), F.col("seed_city"), F.col("url"), F.coalesce("title", F.lit(""))) | seeds.is_own_profile(signals))
    pairs = {tuple(r) for r in accepted.where("seed_name <> ''").select("seed_id", "seq").collect()}
    assert pairs and pairs <= met
    assert len(met) < s.count() * h.count() / 3


def test_counts(spark, tables):
    rows = [
        (True, True, "https://a.in", "https://instagram.com/a", None, None, "a@a.in", None, None, False, True, ["OFFICIAL_WEBSITE", "OFFICIAL_INSTAGRAM"], True, "YES", "YES", None, True),
        (True, False, None, None, "https://facebook.com/b", "https://maps", None, "123", "12 Hill Road", True, True, ["GOOGLE_BUSINESS"], False, "UNKNOWN", "UNKNOWN", "rejected", False),
        (False, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "discovered boolean, official_website_verified boolean, website string, instagram string, facebook string, google_maps_url string, email string, phone string, address string, google_business_verified boolean, identity_verified boolean, identity_sources array<string>, model_reached boolean, potential_stockist string, stockist_lead string, validation string, organic_hit boolean")
    got = seeds.seed_counts(df).first().asDict()
    assert len(got) == 24
    assert {k: v for k, v in got.items() if v} == {
        "seeds_total": 3, "seeds_found": 2, "seeds_with_official_website": 1, "seeds_with_official_instagram": 1, "seeds_with_official_facebook": 1, "seeds_with_verified_google_business": 1, "seeds_with_any_verified_identity": 2,
        "seeds_with_multiple_identity_sources": 1, "seeds_reaching_model": 1, "seeds_stockist_yes": 1, "seeds_stockist_unknown": 1, "stockist_leads_yes": 1, "stockist_leads_unknown": 1, "stockist_leads_with_website": 1, "stockist_leads_with_instagram": 1,
        "stockist_leads_with_email": 1, "stockist_leads_without_address": 1, "stockist_leads_with_multiple_contacts": 1, "seeds_validation_rejected": 1, "seeds_without_official_website": 2, "seeds_organic_hits": 1,
    }
