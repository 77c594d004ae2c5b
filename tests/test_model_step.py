"""The model's step: gate, one call for each distinct payload, schema, validation by the page's evidence, fills."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from waymark.operators import model_step
from waymark.plans import CATALOG

GOOD = {
    "is_business": True, "business_name": "Aria House", "business_type": "MULTI_BRAND", "women_fashion": "HIGH", "physical_store": "UNKNOWN", "city": "UNKNOWN", "carries_other_brands": "UNKNOWN",
    "designer_positioning": "UNKNOWN", "sustainability_focus": "UNKNOWN", "price_positioning": "UNKNOWN", "observed_price_range": "UNKNOWN", "style_fit": "HIGH", "potential_stockist": "UNKNOWN", "confidence": "HIGH", "evidence": [],
}
SCHEMA = "seq long, business_name string, business_type string, women_fashion_relevance string, physical_store string, city string, confidence string, source_type string, website string, title string, text string, headings array<string>, address_candidates array<string>, facts array<struct<field:string,value:string,source:string,schema_type:string>>, page_roles array<string>, signals array<string>, raw string, failure_kind string"


def row(seq, answer, text="A clothing shop.", **fields):
    raw = answer if isinstance(answer, (str, type(None))) else json.dumps(GOOD | answer)
    given = {"seq": seq, "business_name": "UNKNOWN", "business_type": "UNKNOWN", "women_fashion_relevance": "UNKNOWN", "physical_store": "UNKNOWN", "city": "UNKNOWN", "confidence": "LOW", "source_type": "WEBSITE", "website": "https://x.in", "text": text, "raw": raw}
    given |= fields
    names = [f.strip().split(" ")[0] for f in SCHEMA.replace("struct<field:string,value:string,source:string,schema_type:string>", "s").split(", ")]
    return tuple(given.get(n) for n in names)


YES = {"potential_stockist": "YES", "evidence": ["Physical boutique presenting multiple labels."]}
STORE = {"physical_store": "YES"}
#: answer, page's text, other fields, codes of rejected claims, (field, value) believed
CASES = [
    ({}, "A clothing shop.", {}, [], ("ai_business_name", "Aria House")),
    ({"is_business": True}, "x", {"source_type": "DIRECTORY"}, ["directory_or_article_not_business"], ("ai_is_business", False)),
    ({}, "x", {"signals": ["roundup_page"]}, ["roundup_or_publisher"], ("ai_is_business", False)),
    ({"business_name": "Shopping Cart"}, "x", {}, [], ("ai_business_name", "UNKNOWN")),  # cleaning leaves no name to reject
    (STORE, "Visit us today", {"physical_store": "NO"}, ["cannot_override_online_only"], ("ai_physical_store", "NO")),
    ({}, "Visit us today", {"physical_store": "NO"}, [], ("ai_physical_store", "NO")),
    (STORE, "We are online only. Visit us!", {}, ["online_only_language"], ("ai_physical_store", "NO")),
    (STORE, "We sell clothes", {}, ["physical_yes_without_storefront"], ("ai_physical_store", "UNKNOWN")),
    (STORE, "Come to our showroom", {}, [], ("ai_physical_store", "YES")),
    (STORE, "x", {"address_candidates": ["12 Hill Road 400050"]}, [], ("ai_physical_store", "YES")),
    (STORE, "x", {"page_roles": ["homepage", "location"]}, [], ("ai_physical_store", "YES")),
    (STORE, "x", {"facts": [("address", "HQ", "jsonld_organization", "Organization")]}, ["physical_yes_without_storefront"], ("ai_physical_store", "UNKNOWN")),
    (STORE, "x", {"facts": [("name", "X", "jsonld", "ClothingStore")]}, [], ("ai_physical_store", "YES")),
    ({"city": "Mumbai"}, "A shop in Mumbai", {}, [], ("ai_city", "Mumbai")),
    ({"city": "Mumbai"}, "A shop", {}, ["city_not_in_evidence"], ("ai_city", "UNKNOWN")),
    ({"city": "Mumbai"}, "A shop", {"facts": [("addressLocality", "Mumbai", "jsonld_postaladdress", "PostalAddress")]}, [], ("ai_city", "Mumbai")),
    ({"city": "Mumbai"}, "Mumbai and Delhi", {"city": "Delhi"}, ["city_mismatch_with_rules"], ("ai_city", "UNKNOWN")),
    ({"sustainability_focus": "HIGH"}, "Clothes", {}, ["sustainability_without_evidence"], ("ai_sustainability_focus", "UNKNOWN")),
    ({"sustainability_focus": "HIGH"}, "Organic cotton", {}, [], ("ai_sustainability_focus", "HIGH")),
    ({"price_positioning": "LUXURY", "observed_price_range": "1000 to 2000"}, "Clothes", {}, ["price_without_evidence"], ("ai_observed_price_range", "UNKNOWN")),
    ({"price_positioning": "LUXURY"}, "Rs. 12,000", {}, [], ("ai_price_positioning", "LUXURY")),
    (YES, "We stock many labels", {"source_type": "ARTICLE"}, ["directory_or_article_not_business", "discovery_page_not_stockist"], ("ai_potential_stockist", "NO")),
    (YES | {"is_business": False}, "We stock many labels", {}, ["not_a_business"], ("ai_potential_stockist", "NO")),
    (YES | {"business_type": "OWN_BRAND"}, "We stock many labels", {}, ["own_label_not_stockist"], ("ai_potential_stockist", "NO")),
    (YES | {"business_type": "OWN_BRAND", "carries_other_brands": "YES"}, "We stock many labels", {}, [], ("ai_potential_stockist", "YES")),
    (YES, "We design our own label", {}, ["own_label_not_stockist"], ("ai_potential_stockist", "NO")),
    (YES | {"evidence": []}, "We stock many labels", {}, ["stockist_yes_without_evidence"], ("ai_potential_stockist", "UNKNOWN")),
    (YES | {"evidence": ["Has dresses", " located in Goa "]}, "We stock many labels", {}, ["stockist_yes_weak_evidence"], ("ai_potential_stockist", "UNKNOWN")),
    (YES, "A multi-designer store", {}, [], ("ai_potential_stockist", "YES")),
    (YES, "Home to over 40 independent designers", {}, [], ("ai_potential_stockist", "YES")),
    (YES, "Designer wear for all", {}, ["designer_store_not_stockist"], ("ai_potential_stockist", "NO")),
    (YES, "A shop by an independent designer", {}, ["stockist_yes_without_official_site_evidence", "stockist_yes_without_page_evidence"], ("ai_potential_stockist", "UNKNOWN")),
    (YES, "We stock many labels", {"source_type": "SOCIAL", "website": None}, ["stockist_yes_without_official_site_evidence", "stockist_yes_without_page_evidence"], ("ai_potential_stockist", "UNKNOWN")),
    (YES, "Our latest collections", {"source_type": "SOCIAL"}, ["stockist_yes_without_official_site_evidence", "designer_store_not_stockist"], ("ai_potential_stockist", "NO")),
    ({"business_type": "multi brand ", "confidence": "high"}, "x", {}, [], ("ai_business_type", "MULTI_BRAND")),
    (None, None, {}, None, ("ai_business_name", None)),
    ("<think>a {b}</think>\n" + json.dumps(GOOD), "x", {}, [], ("ai_business_name", "Aria House")),
]


def test_every_code(spark):
    rows = [row(i, a, t, **f) for i, (a, t, f, _, _) in enumerate(CASES)]
    got = {r.seq: r for r in model_step.believe(model_step.with_inputs(spark.createDataFrame(rows, SCHEMA))).collect()}
    for i, (answer, text, fields, codes, (name, value)) in enumerate(CASES):
        assert (got[i].rejected, got[i][name]) == (codes, value), (answer, text, fields, got[i].rejected, got[i].schema_errors)
    assert {c for x in CASES for c in x[3] or ()} >= {
        "directory_or_article_not_business", "roundup_or_publisher", "cannot_override_online_only", "online_only_language", "physical_yes_without_storefront", "city_not_in_evidence", "city_mismatch_with_rules",
        "sustainability_without_evidence", "price_without_evidence", "discovery_page_not_stockist", "not_a_business", "own_label_not_stockist", "stockist_yes_without_evidence", "stockist_yes_weak_evidence",
        "designer_store_not_stockist", "stockist_yes_without_official_site_evidence", "stockist_yes_without_page_evidence",
    }
    assert got[7].validation_reasons == ["physical_store_evidence_missing", "physical_store_validation_rejected"]
    assert got[4].validation_reasons == ["physical_store_validation_rejected", "physical_store_evidence_confirmed"]


def test_schema_errors(spark):
    bad = GOOD | {"is_business": "yes", "women_fashion": 3, "confidence": "SURE", "evidence": "none"}
    del bad["city"]
    rows = [row(0, json.dumps(bad)), row(1, "no json"), row(2, "[1]"), row(3, {}), row(4, json.dumps(GOOD | {"city": None}))]
    got = {r.seq: r for r in model_step.believe(model_step.with_inputs(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[0].schema_errors == ["missing:city", "is_business_not_bool", "evidence_not_list", "women_fashion_not_string", "invalid_enum:confidence"]
    assert got[1].schema_errors == got[2].schema_errors == ["invalid_json"] and got[3].schema_errors == [] and got[4].schema_errors == ["city_not_string"]
    assert [got[i].failure_kind for i in range(5)] == ["schema", "schema", "schema", None, "schema"]
    assert got[0].ai_potential_stockist is None and got[0].rejected is None


@pytest.fixture
def rows(spark):
    made = [row(i, None, f"Text {i % 5}") for i in range(40)] + [row(40, None, "Text 0", source_type="DIRECTORY"), row(41, None, None), row(42, None, "fails"), row(43, None, "slow"), row(44, None, "odd", business_type="BRAND")]
    return spark.createDataFrame(made, SCHEMA).drop("raw", "failure_kind").repartition(6)


def test_each_payload_is_asked_once(rows, tmp_path):
    folder = str(tmp_path)

    def client(text):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        said = json.loads(text)["text_excerpt"]
        if said == "fails":
            raise ValueError("no model")
        if said == "slow":
            raise TimeoutError
        return json.dumps(GOOD | {"business_type": "BOUTIQUE"}) if said != "odd" else "odd"

    out, answers = model_step.qualify(rows, client)
    got = {r.seq: r for r in out.collect()}
    out.count()  # reading again asks nobody
    asked = [p.read_text() for p in tmp_path.iterdir()]
    assert len(asked) == len(set(asked)) == 8
    assert (got[40].skipped_reason, got[41].skipped_reason, got[0].skipped_reason) == ("source_not_website", "insufficient_page_evidence", None)
    assert (got[42].failure_kind, got[43].failure_kind, got[44].failure_kind) == ("model", "http", "schema")
    assert got[0].business_type == "BOUTIQUE" and got[0].rule_business_type == "UNKNOWN" and got[44].business_type == "BRAND"
    assert got[0].business_name == "Aria House" and got[40].business_name == "UNKNOWN"
    counts = model_step.report(out).first().asDict()
    assert counts == {"n_rows": 45, "n_sent": 43, "n_calls": 8, "n_http_failures": 1, "n_model_failures": 1, "n_schema_failures": 1, "n_rejected": 0, "n_stockist_yes": 0, "n_stockist_no": 0, "n_stockist_unknown": 40, "n_filled": 120}
    # the next run asks again only where no answer came; an answer that broke the schema is an answer
    again, _ = model_step.qualify(rows, client, answers)
    again.collect()
    new = [p.read_text() for p in tmp_path.iterdir()]
    assert len(new) == 10 and sorted(json.loads(x)["text_excerpt"] for x in new).count("fails") == 2


def test_without_a_client_nobody_is_asked(rows):
    out, answers = model_step.qualify(rows, None)
    assert answers is None and {(r.skipped_reason, r.attempted, r.ai_city, r.city) for r in out.collect()} == {("disabled", False, None, "UNKNOWN")}
    assert model_step.qualify(rows.limit(0), lambda x: x)[0].count() == 0


def test_gate_for_official_identities(spark):
    rows = [row(0, None, "t", source_type="SOCIAL"), row(1, None, "t", source_type="ARTICLE"), row(2, None, None, source_type="SOCIAL"), row(3, None, "t", signals=["publisher_not_boutique"]), row(4, None, "", signals=["publisher_not_boutique"], title="T")]
    df = model_step.with_inputs(spark.createDataFrame(rows, SCHEMA))
    got = [tuple(r) for r in df.select("seq", model_step.skip_reason(), model_step.skip_reason(True)).orderBy("seq").collect()]
    assert got == [(0, "source_not_website", None), (1, "source_not_website", "source_not_official_identity"), (2, "source_not_website", "insufficient_page_evidence"), (3, None, "source_not_official_identity"), (4, "roundup_without_page_text", "source_not_official_identity")]


def test_payload_is_compact(spark):
    df = model_step.with_inputs(spark.createDataFrame([row(0, None, "x" * 5000, headings=[f"h{i}" for i in range(30)], facts=[("name", "n", "s", "t")] * 3 + [(f"f{i}", "v" * 500, "s", "t") for i in range(40)])], SCHEMA))
    made = json.loads(df.select(model_step.evidence_payload()).first()[0])
    assert len(made["text_excerpt"]) == 1500 and len(made["headings"]) == 8 and len(made["structured_facts"]) == 20 and len(made["structured_facts"][1]["value"]) == 180
    assert made["rule_result"]["city"] == "UNKNOWN" and made["emails"] == [] and made["search_query"] is None


def test_answers_are_parsed_once_and_dealt_out(spark, tmp_path):
    spark.range(4000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = CATALOG["golden_model_answers"].run(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1 and "RepartitionByExpression" in plan and rows.count() == 4000


def test_checks_of_evidence_and_kinds_are_made_once(spark, tmp_path):
    answer = {"physical_store": "YES", "sustainability_focus": "HIGH", "price_positioning": "LUXURY", "city": "Goa"}
    spark.createDataFrame([row(0, answer, "Organic. Rs. 500. Online only in GOA."), row(1, answer | {"city": "Surat"}, "Goas"), row(2, "no json")], SCHEMA).write.parquet(f"{tmp_path}/rows")
    out = model_step.believe(model_step.with_inputs(spark.read.parquet(f"{tmp_path}/rows")))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [plan.count(p) for p in (model_step.P.ONLINE_ONLY, model_step.SUSTAINABLE, model_step.PRICED)] == [1, 1, 1]
    assert len(model_step.FIELDS) <= plan.count("schemaOfVariant(") <= len(model_step.FIELDS) + 2
    got = {r.seq: (r.rejected, r.ai_city) for r in out.collect()}
    assert got == {0: (["online_only_language"], "Goa"), 1: (["physical_yes_without_storefront", "city_not_in_evidence", "sustainability_without_evidence", "price_without_evidence"], "UNKNOWN"), 2: (None, None)}
