"""Queries over golden cases: every customer gets one of an operator's cases, and the SQL knows what must come out.

Rules with word boundaries or look-ahead can't be put in the oracle's regex
dialect one to one; their cases and expected results can.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places, text, urls
from ..operators import classify, enrich, geo, identify, model, research, score, seeds, signals
from .catalog import q, query, read


def golden(name: str, schema: str, outputs: Sequence[str], cases: Sequence[tuple[tuple, tuple]], apply: Callable[[DataFrame], DataFrame]) -> None:
    """Registers a query. cases: inputs by schema, outputs in order; apply: a table with seq and the inputs to one with seq and the outputs."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else q(v)

    values = ", ".join(f"({i}, {', '.join(map(lit, out))})" for i, (_, out) in enumerate(cases))
    sql = f"SELECT c_custkey AS seq, {', '.join(f'v.{o}' for o in outputs)} FROM customer JOIN (VALUES {values}) AS v(i, {', '.join(outputs)}) ON v.i = c_custkey % {len(cases)}"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        table = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(cases)], f"i int, {schema}")
        rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.pmod("c_custkey", F.lit(len(cases))).cast("int").alias("i")).repartition("seq")  # keys are a few bytes each: without this one task gets all of a small file
        return apply(rows.join(F.broadcast(table), "i").drop("i")).select("seq", *outputs)

    query(name, sql)(run)


def one(f: Callable[[Column], Column], column: str = "v") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("seq", f(F.col(column)).alias("r"))


golden("golden_url_forms", "v string", ["r"], [
    (("HTTP://www.Example.com:80/a/b/?utm_source=x&b=2&a=1#top",), ("https://example.com/a/b?a=1&b=2",)), (("example.com",), ("https://example.com",)), (("https://x.com:8443/p",), ("https://x.com:8443/p",)),
    (("https://x.com:99999/",), (None,)), (("ftp://x.com",), (None,)), (("host:80/p",), (None,)), (("//x.com/p",), (None,)), (("https://x.com/a;v=1?gclid=3",), ("https://x.com/a",)), (("https://u:p@x.com/",), ("https://x.com",)),
], one(urls.normalize))
golden("golden_url_types", "v string", ["r"], [
    (("https://youtu.be/x",), ("VIDEO",)), (("https://www.instagram.com/x",), ("SOCIAL",)), (("https://goo.gl/x",), ("DIRECTORY",)), (("https://www.google.de/maps/p",), ("DIRECTORY",)), (("https://google.com/search?q=1",), ("DIRECTORY",)),
    (("https://sub.medium.com/p",), ("ARTICLE",)), (("https://a.com/blog/x",), ("ARTICLE",)), (("https://notinstagram.com",), ("WEBSITE",)), (("",), ("UNKNOWN",)),
], one(urls.classify))
golden("golden_social_posts", "v string", ["post", "handle"], [
    (("https://instagram.com/p/abc",), (True, None)), (("https://instagram.com/shop.one/",), (False, "shop.one")), (("https://facebook.com/shop/posts/1",), (True, "shop")), (("https://x.com/a",), (False, "a")), (("https://instagram.com/",), (False, None)),
], lambda df: df.select("seq", urls.is_social_post(F.col("v")).alias("post"), signals.social_handle(F.col("v")).alias("handle")))
golden("golden_identity_keys", "website string, instagram string, phone string, business_name string, city string", ["site", "account", "digits", "name_city"], [
    (("https://www.a.com/x", "@Shop.One", "+91 98-76", "Rose  House", "Goa"), ("a.com", "shop.one", "919876", "rose house|goa")), ((None, "https://instagram.com/Shop/", "none", "Rose", "UNKNOWN"), (None, "shop", None, None)),
    (("", "https://notinstagram.com/shop", "", "unknown", "Goa"), (None, None, None, None)), (("shop.a.com", "bare_name", "1", " A ", " B "), ("shop.a.com", "bare_name", "1", "a|b")),
], lambda df: df.select("seq", urls.key_domain(F.col("website")).alias("site"), urls.key_instagram(F.col("instagram")).alias("account"), urls.key_phone(F.col("phone")).alias("digits"), urls.key_name_city(F.col("business_name"), F.col("city")).alias("name_city")))
golden("golden_names", "v string", ["r"], [
    (("Rose Studio | Women's Fashion",), ("Rose Studio",)), (("Home",), ("UNKNOWN",)), (("10 best boutiques in Goa",), ("UNKNOWN",)), (("  Ahi   (@ahi) ",), ("Ahi",)), (("Mira ladies boutique",), ("Mira",)), (("Download the app",), ("UNKNOWN",)),
    (("a",), ("UNKNOWN",)), ((None,), ("UNKNOWN",)), (("one two three four five six seven eight nine",), ("UNKNOWN",)), (("https://x.com",), ("UNKNOWN",)), (("Paper Moon - clothes",), ("Paper Moon",)),
], one(text.clean_name))
golden("golden_contextual_names", "v string, role string", ["r"], [
    (("About us: Rose Studio", "about"), ("Rose Studio",)), (("About Rose Studio: our story", "about"), ("Rose Studio",)), (("Contact Us - Paper Moon", "contact"), ("Paper Moon",)), (("Contact", "contact"), ("UNKNOWN",)), (("Blue Door", "homepage"), ("Blue Door",)),
], lambda df: df.select("seq", signals.contextual_name(F.col("v"), F.col("role")).alias("r")))
golden("golden_mentions", "v string", ["r"], [
    (("Paper Moon",), ("Paper Moon",)), (("Shops",), (None,)), (("AB",), (None,)), (("Rose and Lily and Moon House",), (None,)), (("One Two Three Four Five Six Seven",), (None,)), (("Rose and Lily",), ("Rose and Lily",)),
], one(identify.clean_mention))
golden("golden_addresses", "v string", ["r"], [
    (("Come to 12 Hill Road, Bandra. Now",), ("12 Hill Road, Bandra",)), (("near the church Panjim 403001 Goa",), ("near the church Panjim 403001",)), (("nothing",), (None,)),
], one(signals.snippet_address))
golden("golden_business_types", "haystack string, name string, title string, addresses array<string>, page_roles array<string>, fact_fields array<string>, fact_sources array<string>, localities array<string>, has_contact boolean, website string",
    ["business_type", "fashion_relevance", "physical_store", "city", "confidence"], [
    (("Designer boutique. Visit us", "A", "A Goa", ["12 Road, Goa 403001"], ["location"], [], [], [], True, "a.com"), ("BOUTIQUE", "HIGH", "YES", "Goa", "HIGH")),
    (("hotel and spa", "B", "", [], [], [], [], [], False, None), ("UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "MEDIUM")), (("online-only apparel", "UNKNOWN", "", [], [], [], [], ["Pune"], False, None), ("UNKNOWN", "MEDIUM", "NO", "Pune", "LOW")),
    (("a marketplace", "M", "", [], [], [], [], [], True, None), ("MARKETPLACE", "UNKNOWN", "UNKNOWN", "UNKNOWN", "HIGH")), (("multi-designer fashion store", "D", "", [], [], [], ["jsonld_localbusiness"], [], True, None), ("MULTI_DESIGNER", "HIGH", "YES", "UNKNOWN", "HIGH")),
    (("couture atelier", "E", "", [], [], [], [], ["Goa", "Pune"], False, "e.com"), ("DESIGNER", "HIGH", "UNKNOWN", "UNKNOWN", "MEDIUM")), (("our collection, add to cart", "F", "", [], [], [], [], [], True, None), ("BRAND", "UNKNOWN", "UNKNOWN", "UNKNOWN", "HIGH")),
    (("a retailer", "G", "", ["1 Road Mumbai", "2 Road Delhi"], [], [], [], [], True, None), ("RETAILER", "UNKNOWN", "UNKNOWN", "UNKNOWN", "HIGH")),
], classify.classify)
golden("golden_entity_quality", "url string, title string, text string, source_type string, signals array<string>, name string, website string, instagram string, business_type string, geography string", ["relationship", "business_context", "entity_quality", "excluded"], [
    (("https://x.com/", "t", "text", "WEBSITE", ["a"], "Shop", "https://x.com", None, "BOUTIQUE", "YES"), ("SELF", "INDEPENDENT_RETAIL", "HIGH", False)), (("https://x.com/blog/best", "10 best boutiques in Goa", "t", "WEBSITE", ["a"], None, None, None, None, "UNKNOWN"), ("ARTICLE", "MEDIA", "REJECTED", True)),
    (("https://instagram.com/p/abc", "", "", "SOCIAL", ["a"], "N", None, None, None, "YES"), ("SOCIAL_POST", "UNKNOWN", "REJECTED", True)), (("https://x.com/", "", "", "WEBSITE", ["article_heading"], "N", None, None, "BRAND", "YES"), ("MENTIONED_BUSINESS", "BRAND", "LOW", True)),
    (("https://x.com/", "", "", "WEBSITE", [], "N", "https://x.com", None, None, "NO"), ("SELF", "UNKNOWN", "REJECTED", True)), (("https://x.com/", "", "", "WEBSITE", [], "N", None, "@n", "DESIGNER", "UNKNOWN"), ("SELF", "DESIGNER", "MEDIUM", True)),
    (("https://x.com/", "", "a resort boutique", "WEBSITE", [], "N", None, None, None, "YES"), ("SELF", "HOTEL_RESORT_BOUTIQUE", "WEAK", True)), (("https://x.com/", "best shops", "", "VIDEO", [], None, None, None, None, "YES"), ("UNKNOWN", "UNKNOWN", "REJECTED", True)),
    (("https://a.com/l", "", "", "DIRECTORY", [], "N", None, None, None, "YES"), ("DIRECTORY", "DIRECTORY", "REJECTED", True)), (("https://indiatimes.com/", "", "", "WEBSITE", [], "N", None, None, None, "YES"), ("MEDIA", "MEDIA", "REJECTED", True)),
], classify.entity_quality)
golden("golden_page_scores", "url string, root string, anchor string", ["role", "score"], [
    (("https://x.com/contact-us", "https://x.com/", ""), ("contact", 100)), (("https://x.com/stores", "https://x.com/", ""), ("location", 94)), (("https://x.com/about", "https://x.com/", ""), ("about", 70)), (("https://x.com/products/contact", "https://x.com/", ""), ("contact", 0)),
    (("https://x.com/", "https://x.com/", ""), ("homepage", 0)), (("https://y.com/contact", "https://x.com/", ""), ("contact", 0)), (("https://x.com/a?b=contact", "https://x.com/", ""), ("contact", 0)), (("https://x.com/retail", "https://x.com/", ""), ("business", 55)),
    (("https://x.com/womenswear", "https://x.com/", ""), ("fashion", 40)), (("https://x.com/x", "https://x.com/", "shop"), ("other", 20)), (("https://x.com/visit-us", "https://x.com/", "login"), ("location", 0)), (("https://x.com/contact.pdf", "https://x.com/", ""), ("contact", 0)),
], lambda df: df.select("seq", enrich.page_role(F.col("url"), F.col("root")).alias("role"), enrich.page_score(F.col("url"), F.col("root"), F.col("anchor")).alias("score")))
golden("golden_enrichment_need", ", ".join(f"{f} boolean" for f in enrich.NEEDS), ["tier", "roles", "reasons"], [
    ((True, True, True, True, True, True), ("STRONG", "", "complete")), ((True, True, True, False, True, True), ("PARTIAL", "location", "missing_location")), ((True, False, True, True, False, True), ("PARTIAL", "location,about,fashion", "missing_city,missing_type")),
    ((True, True, False, True, True, False), ("PARTIAL", "contact,about,fashion", "missing_contact,missing_women")), ((False, False, True, False, True, True), ("WEAK", "contact,location,about,business,fashion", "missing_location,missing_identity")), ((None, True, True, True, True, True), ("PARTIAL", "about", "missing_identity")),
], lambda df: enrich.need(df).select("seq", "tier", F.array_join("wanted_roles", ",").alias("roles"), F.array_join("need_reasons", ",").alias("reasons")))
golden("golden_research_priority", "business_name string, address string, city string, website string, instagram string, physical_store string, snippet string, status string", ["priority", "missing"], [
    (("Shop One", "12 Market road", "Goa", None, None, "YES", "fashion curated", "pending"), (18, "instagram,website,brands")), (("Home", None, "Goa", None, None, "UNKNOWN", "", "pending"), (0, "address,instagram,website,store,brands,maps")),
    (("Blue Door", None, None, "b.com", "@b", "UNKNOWN", "", "enriched"), (4, "address,store,brands,maps")), (("Big House", "1 road", "Goa", "b.com", "@b", "YES", "a wholesaler", "pending"), (0, "brands")), (("Moon", "1 road", "Goa", "b.com", "@b", "YES", "brands we carry", "pending"), (0, "")),
], lambda df: research.with_priority(df).select("seq", "priority", F.array_join("missing", ",").alias("missing")))
golden("golden_model_answers", "raw string, page_text string", ["errors", "rejected", "store"], [
    (('{"is_business":true,"business_name":"Shop","city":"Goa","observed_price_range":"100","style_fit":"x","business_type":"BOUTIQUE","women_fashion":"HIGH","physical_store":"YES","carries_other_brands":"YES","designer_positioning":"MIXED","sustainability_focus":"NO","price_positioning":"MID","potential_stockist":"YES","confidence":"HIGH","evidence":["a"]}', "shop in goa"), (0, "invented_price,unsupported_store,unsupported_stockist", "UNKNOWN")),
    (('{"is_business":true,"business_name":"Shop","city":"UNKNOWN","observed_price_range":"UNKNOWN","style_fit":"x","business_type":"BRAND","women_fashion":"LOW","physical_store":"YES","carries_other_brands":"NO","designer_positioning":"MIXED","sustainability_focus":"NO","price_positioning":"MID","potential_stockist":"NO","confidence":"LOW","evidence":[]}', "Shop: visit us"), (0, "", "YES")),
    (("nope", "t"), (1, "", "UNKNOWN")), (('{"is_business":"x","business_name":1}', "t"), (15, "unsupported_name", "UNKNOWN")),
], lambda df: model.validate(df).select("seq", F.size("schema_errors").alias("errors"), F.array_join("rejected", ",").alias("rejected"), F.col("ai_physical_store").alias("store")))
golden("golden_model_gate", "name string, business_type string, fashion_relevance string, physical_store string, confidence string", ["reason"], [
    (("A", "BOUTIQUE", "HIGH", "YES", "HIGH"), (None,)), (("UNKNOWN", "BOUTIQUE", "HIGH", "YES", "HIGH"), ("identity_missing",)), (("A", "UNKNOWN", "HIGH", "YES", "HIGH"), ("type_unknown",)), (("A", "BRAND", "UNKNOWN", "YES", "HIGH"), ("fashion_unknown",)),
    (("A", "BRAND", "HIGH", "UNKNOWN", "HIGH"), ("store_unknown",)), (("A", "BRAND", "HIGH", "NO", "LOW"), ("low_confidence",)),
], lambda df: df.select("seq", model.ambiguity().alias("reason")))
golden("golden_model_fills", "business_type string, physical_store string, ai_type string, ai_store string", ["business_type", "physical_store"], [
    (("UNKNOWN", "UNKNOWN", "BOUTIQUE", "YES"), ("BOUTIQUE", "YES")), (("BRAND", "NO", "BOUTIQUE", "YES"), ("BRAND", "NO")), (("UNKNOWN", "UNKNOWN", "SHOP", None), ("UNKNOWN", "UNKNOWN")),
], lambda df: model.fill_unknown(df, {"business_type": ("ai_type", ("BOUTIQUE", "BRAND")), "physical_store": ("ai_store", ("YES", "NO"))}))
golden("golden_retail_models", "v string", ["model", "exclusions", "points"], [
    (("a multi-brand shop, concept store",), ("multi-brand", "", 4)), (("concept store",), ("concept store", "", 4)), (("online-only, sarees exclusively",), (None, "online-only,saree-only", 0)), (("curated fashion lifestyle store",), ("curated store", "", 5)), (("plain",), (None, "", 0)),
], lambda df: df.select("seq", score.first_label(F.col("v"), score.rules.RETAIL_MODELS).alias("model"), F.array_join(score.labels(F.col("v"), score.rules.EXCLUSION_SIGNALS), ",").alias("exclusions"), score.points(F.col("v"), score.rules.CONCEPT_SIGNALS).alias("points")))
golden("golden_seed_sites", "name string, city string, url string, title string", ["official", "mentioned"], [
    (("Paper Boat Collective", "Goa", "https://paperboatcollective.com/x", "Home"), (True, False)), (("Paper Boat Collective", "Goa", "https://airbnb.com/x", "Paper Boat"), (False, True)), (("Rangeela", "Goa", "https://r.com/", "Rangeela"), (True, True)),
    (("Rangeela", "Goa", "https://r.com/blog/x", "Rangeela"), (False, True)), (("Rangeela", "Goa", "https://r.com/", "10 best shops: Rangeela, top 10"), (False, True)),
], lambda df: df.select("seq", seeds.is_official_site(F.col("name"), F.col("city"), F.col("url"), F.col("title")).alias("official"), seeds.named_in(F.col("name"), F.col("title")).alias("mentioned")))


def _verified(df: DataFrame) -> DataFrame:
    return geo.verify(df.withColumnRenamed("seq", "id"), places.places(df.sparkSession)).withColumnRenamed("id", "seq")


golden("golden_geography", "profile string, address string, city string, website string, expected_city string", ["geography"], [
    (("Shop in Panjim", "", "", None, "Goa"), ("YES",)), (("Shop in Mumbai", "", "", None, "Goa"), ("NO",)), (("nothing", "", "", None, "Goa"), ("UNKNOWN",)), (("Goa shop", "", "", "https://x.co.uk", "Goa"), ("NO",)), (("x", "1 Road, Goa", "", "https://x.co.uk", "Goa"), ("YES",)),
    (("in Maharashtra", "", "", None, "Pune"), ("UNKNOWN",)), (("in Karnataka", "", "", None, "Bengaluru"), ("YES",)), (("a shop in Bandra", "", "", None, None), ("YES",)), (("nowhere", "", "", None, None), ("UNKNOWN",)), (("nowhere", "", "", "https://x.fr", None), ("NO",)), (("Goa and Mumbai", "", "", None, "Goa"), ("YES",)),
], _verified)
