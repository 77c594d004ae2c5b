"""The model's step of a run: who is asked, with what, once for each distinct evidence, and what of an answer is believed.

gate -> payload -> distinct payloads not answered yet -> answers (a written
table, to be kept between runs) -> schema -> validation against the page's own evidence ->
unknown rule fields filled. The client is a function of the payload's JSON to the
answer's text; it runs inside tasks, and what it raises becomes a row.

Defined cases: without a client nobody is asked; null texts and lists are empty;
equal payloads share one answer, failures are asked again by the next run;
an answer that is no JSON object, or breaks the schema, is kept raw and believed in nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import rules, urls
from ..functions.text import UNKNOWN, clean_name, generic_name, let, mentions, present
from .graph import written

# --- fixed values: an answer's fields and their domains -----------------------
TYPES = ("MULTI_BRAND", "MULTI_DESIGNER", "BOUTIQUE", "DESIGNER", "CONCEPT_STORE", "FASHION_RETAILER", "OWN_BRAND", "DEPARTMENT_STORE", "WHOLESALE", "OTHER", "UNKNOWN")
LEVELS, TRI = ("HIGH", "MEDIUM", "LOW", "UNKNOWN"), ("YES", "NO", "UNKNOWN")
PRICES = ("BUDGET", "MID_RANGE", "PREMIUM", "LUXURY", "UNKNOWN")
POSITIONS = ("MULTI_DESIGNER", "DESIGNER_FOCUSED", "MULTI_BRAND", "INDEPENDENT_BOUTIQUE", "GENERAL_FASHION", "OWN_LABEL", "UNKNOWN")
FIELDS = (
    "is_business", "business_name", "business_type", "women_fashion", "physical_store", "city", "carries_other_brands", "designer_positioning",
    "sustainability_focus", "price_positioning", "observed_price_range", "style_fit", "potential_stockist", "confidence", "evidence",
)
DOMAINS = {
    "business_type": TYPES, "women_fashion": LEVELS, "physical_store": TRI, "carries_other_brands": TRI, "designer_positioning": POSITIONS,
    "sustainability_focus": LEVELS, "price_positioning": PRICES, "style_fit": LEVELS, "potential_stockist": TRI, "confidence": ("HIGH", "MEDIUM", "LOW"),
}
#: Rule fields that an answer may fill, with the answer's field and the values taken over.
RULE_TYPES = ("BOUTIQUE", "DESIGNER", "BRAND", "RETAILER", "MULTI_DESIGNER", "MARKETPLACE")
OWN_LABEL_TYPES = ("DESIGNER", "OWN_BRAND", "WHOLESALE")
LOCAL_TYPES = ("localbusiness", "store", "clothingstore", "fashionstore", "shoestore", "jewelrystore")
BANNED_NAMES = ("visit site", "visit website", "click here", "read more", "learn more", "shop now", "view store")
# --- fixed values: phrases that evidence must hold ----------------------------
SUSTAINABLE = r"(?i)\b(?:sustainab|eco[\s\-]?friendly|organic|ethical|upcycled|slow\s+fashion)\b"
PRICED = r"(?i)(?:₹|rs\.?|inr|\$|usd|eur|gbp)\s*[0-9,]+|[0-9,]+\s*(?:₹|rs\.?|inr)|\b(?:price\s+range|starting\s+at|from\s+rs)\b"
STOCKIST = (
    r"(?i)\b(?:multi[\s\-]?brand|multi[\s\-]?designer|several (?:designers?|brands?|labels?)|multiple (?:independent )?(?:fashion )?(?:labels?|designers?|brands?)|"
    r"carrying (?:multiple |other )?(?:brands?|designers?|labels?)|brands? (?:available|carried|sold|listed)|designers? listed|concept store|"
    r"curated (?:multi[\s\-]?brand|selection)|we (?:carry|stock|represent)|stockists? of)\b"
)
OFFICIAL_STOCKIST = (
    r"(?i)\b(?:home to (?:almost |over |more than )?(?:[0-9]+\+?\s+)?independent (?:designers|brands|artisans|makers)|"
    r"(?:almost |over |more than )?[0-9]+\+?\s+independent (?:designers|brands|artisans|makers)|multiple independent (?:designers|brands|labels|artisans|makers)|"
    r"showcases? (?:the )?(?:work|designs) (?:of|from) (?:multiple |several )?(?:indian )?(?:designers|makers|brands)|"
    r"curated (?:selection|collection) of (?:independent )?(?:brands|labels|designers))\b"
)
WEAK_EVIDENCE = r"(?i)^(?:sells women'?s clothes|fashion website|has dresses|located in [\w\s]+|women'?s fashion|fashion business|has clothing)$"
OWN_LABEL = r"(?i)\b(?:own[\s\-]?label|own[\s\-]?brand|our own collection|designer studio|we design|only our (?:own )?brand)\b"
OWN_STORE = r"(?i)\b(?:women designer store|designer store|designer wear|our (?:latest )?collections?)\b"
STORE_VISIT = (
    r"(?i)\b(?:visit\s+us|showroom|store\s+locator|our\s+stores?|physical\s+store|boutique\s+address|walk[\s\-]?in|visit\s+the\s+store|flagship\s+store|"
    r"find\s+us|shop\s+in\s+[A-Za-z]+|book\s+an\s+appointment|store\s+hours|opening\s+hours)\b"
)
LISTING_SIGNALS = ("roundup_page", "publisher_not_boutique")
TEXT_CHARS, HEADINGS, FACTS, SIGNALS = 1500, 8, 20, 8

ANSWER = "payload_id string, raw string, failure_kind string, error string, elapsed double"
#: Columns of evidence and what stands for those that a table lacks.
INPUT = {
    "search_query": "string", "source_type": "string", "source_url": "string", "website": "string", "title": "string", "og_site_name": "string", "meta_description": "string", "headings": "array<string>",
    "facts": "array<struct<field:string,value:string,source:string,schema_type:string>>", "emails": "array<string>", "phones": "array<string>", "social_urls": "array<string>", "address_candidates": "array<string>",
    "city_mentions": "array<string>", "page_roles": "array<string>", "text": "string", "signals": "array<string>", "result_type": "string",
}
RULES = ("business_name", "business_type", "women_fashion_relevance", "physical_store", "city", "confidence")


def _list(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>"))


def _facts() -> Column:
    """The facts' fields that are read here."""
    return F.coalesce(F.transform("facts", lambda f: F.struct(*[f[c].cast("string").alias(c) for c in ("field", "value", "source", "schema_type")])), F.array().cast(INPUT["facts"]))


def with_inputs(rows: DataFrame) -> DataFrame:
    """rows with null columns for the evidence that they lack."""
    return rows.withColumns({k: F.lit(None).cast(v) for k, v in INPUT.items() if k not in rows.columns})


def skip_reason(official_identity: bool = False) -> Column:
    """Why a row isn't sent to the model, null if it is.

    Only pages of websites are sent; with official_identity also profiles and map
    entries of the business itself.
    """
    source = F.coalesce("source_type", "result_type", F.lit(""))
    publisher = F.array_contains(_list("signals"), "publisher_not_boutique")
    evidence = present(F.col("text")) | present(F.col("title")) | (F.size(_facts()) > 0)
    if official_identity:
        own = F.col("result_type").isin("WEBSITE", "SOCIAL") | source.isin("WEBSITE", "SOCIAL") | F.coalesce(urls.is_maps(F.col("source_url")), F.lit(False))
        evidence = evidence | present(F.col("meta_description"))
        return F.when(~F.coalesce(own, F.lit(False)) | (source == "ARTICLE") | publisher, "source_not_official_identity").when(~evidence, "insufficient_page_evidence")
    website = F.coalesce("result_type", F.lit("WEBSITE")) == "WEBSITE"
    return (
        F.when(~website | source.isin("DIRECTORY", "ARTICLE", "SOCIAL", "VIDEO"), "source_not_website")
        .when(publisher & (F.btrim(F.coalesce("text", F.lit(""))) == ""), "roundup_without_page_text")
        .when(~evidence, "insufficient_page_evidence")
    )


def compact_facts() -> Column:
    """Facts of different field, source and value, the first FACTS of them."""
    facts = _facts()
    short = F.transform(facts, lambda f: F.struct(f["field"].alias("field"), F.substring(f["value"], 1, 180).alias("value"), f["source"].alias("source"), f["schema_type"].alias("schema_type")))
    keys = F.transform(facts, lambda f: F.concat_ws("\n", f["field"], f["source"], f["value"]))
    return F.slice(F.filter(short, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1), 1, FACTS)


def evidence_payload() -> Column:
    """The compact evidence of a row as JSON; never a page's markup."""
    cut = lambda c, n: F.slice(_list(c), 1, n)
    rule = F.struct(
        "business_name", "business_type", F.col("women_fashion_relevance").alias("women_fashion"), "physical_store", "city", "confidence", F.slice(_list("signals"), 1, 12).alias("signals")
    )
    return F.to_json(
        F.struct(
            "search_query", "source_type", "source_url", "website", F.col("title").alias("page_title"), "og_site_name", F.nullif(F.substring("meta_description", 1, 300), F.lit("")).alias("meta_description"),
            cut("headings", HEADINGS).alias("headings"), compact_facts().alias("structured_facts"), cut("emails", SIGNALS).alias("emails"), cut("phones", SIGNALS).alias("phones"), cut("social_urls", SIGNALS).alias("social"),
            cut("address_candidates", SIGNALS).alias("addresses"), cut("city_mentions", SIGNALS).alias("city_mentions"), F.array_distinct(_list("page_roles")).alias("enrichment_roles"),
            F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS).alias("text_excerpt"), rule.alias("rule_result"),
        ),
        {"ignoreNullFields": "false"},
    )


def ask_once(payloads: DataFrame, client: Callable[[str], str], known: DataFrame | None = None) -> DataFrame:
    """Answers (payload_id, raw, failure_kind, error, elapsed) to payloads (payload_id, payload), each distinct one asked once; known answers that didn't fail aren't asked for again."""
    new = payloads.groupBy("payload_id").agg(F.any_value("payload").alias("payload"))
    if known is not None:
        kept = known.where("failure_kind IS NULL")
        new = new.join(kept.select("payload_id"), "payload_id", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            out = []
            for key, text in zip(pdf["payload_id"], pdf["payload"]):
                start, raw, kind, error = time.monotonic(), None, None, None
                try:
                    raw = client(text)
                except (TimeoutError, ConnectionError) as e:
                    kind, error = "http", f"{type(e).__name__}: {e}"
                except Exception as e:  # one answer must not end the run
                    kind, error = "model", f"{type(e).__name__}: {e}"
                out.append((key, raw, kind, error, time.monotonic() - start))
            yield pd.DataFrame(out, columns=["payload_id", "raw", "failure_kind", "error", "elapsed"])

    answers = written(new.mapInPandas(ask, ANSWER))  # written at once: a second reader must not ask again
    return answers if known is None else kept.unionByName(answers)


def parsed(raw: Column) -> Column:
    """The JSON object of an answer, thoughts left out; null if it is none."""
    v = F.try_parse_json(F.btrim(F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def _kind(v: Column, field: str) -> Column:
    """The JSON kind of a field, null if the object lacks it."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _enum(value: Column, allowed: Sequence[str], default: Column | None) -> Column:
    made = F.translate(F.upper(F.btrim(F.coalesce(value, F.lit("")))), " -", "__")
    return F.when(made.isin(*allowed), made).otherwise(F.lit(None) if default is None else default)


def answer_errors(v: Column) -> Column:
    """What is wrong with an answer's fields; an answer that is no object has the one error ``invalid_json``."""

    def errors(kinds: Column) -> Column:
        kind = {f: kinds[f] for f in FIELDS}
        checks = [F.when(kind[f].isNull(), f"missing:{f}") for f in FIELDS]
        checks.append(F.when(kind["is_business"] != "BOOLEAN", "is_business_not_bool"))
        checks.append(F.when(~F.startswith(kind["evidence"], F.lit("ARRAY")), "evidence_not_list"))
        texts = [f for f in FIELDS if f not in ("is_business", "evidence")]
        checks += [F.when(kind[f] != "STRING", f"{f}_not_string") for f in texts]
        checks += [F.when((kind[f] == "STRING") & _enum(F.try_variant_get(v, f"$.{f}", "string"), d, None).isNull(), f"invalid_enum:{f}") for f, d in DOMAINS.items()]
        return F.array_compact(F.array(*checks))

    # each field's kind is looked up once
    return F.when(v.isNull(), F.array(F.lit("invalid_json"))).otherwise(let(F.struct(*[_kind(v, f).alias(f) for f in FIELDS]), errors))


def storefront(blob: Column) -> Column:
    """Whether the evidence shows a shop one can visit; the address of an organisation alone doesn't."""
    facts = _facts()
    local = F.exists(facts, lambda f: F.coalesce((f["source"] == "jsonld_localbusiness") | F.lower(f["schema_type"]).isin(*LOCAL_TYPES), F.lit(False)))
    pin = F.exists(_list("address_candidates"), lambda a: a.rlike(P.PIN_CODE))
    return local | F.array_contains(_list("page_roles"), "location") | blob.rlike(STORE_VISIT) | pin


def believe(rows: DataFrame) -> DataFrame:
    """rows (raw, failure_kind, evidence and rule fields) with the answer's fields as ai_*, schema_errors, rejected and validation_reasons.

    A claim that the page's own evidence doesn't hold becomes UNKNOWN, or NO, and
    leaves a code in ``rejected``. Answers that failed or break the schema give no fields.
    """
    rows = rows.withColumn("__v", parsed(F.col("raw")))
    v = F.col("__v")
    asked = F.col("raw").isNotNull()
    rows = rows.withColumn("schema_errors", F.when(asked, answer_errors(v)))
    rows = rows.withColumn("failure_kind", F.coalesce("failure_kind", F.when(F.size("schema_errors") > 0, "schema")))
    good = asked & F.col("failure_kind").isNull()

    def said(field: str) -> Column:
        return F.try_variant_get(v, f"$.{field}", "string")

    def cut(c: str, n: int) -> Column:
        return F.array_join(F.slice(_list(c), 1, n), " ")

    blob = F.concat_ws(" ", F.nullif(F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS), F.lit("")), F.nullif("title", F.lit("")), F.nullif(F.substring("meta_description", 1, 300), F.lit("")), F.nullif(cut("headings", HEADINGS), F.lit("")), F.nullif(cut("address_candidates", SIGNALS), F.lit("")))
    rows = rows.withColumn("__blob", F.when(good, blob))
    blob = F.col("__blob")
    discovery = F.coalesce(F.col("source_type").isin("DIRECTORY", "ARTICLE"), F.lit(False))
    listing = F.arrays_overlap(_list("signals"), F.array(*map(F.lit, LISTING_SIGNALS)))
    enums = {f: _enum(said(f), d, F.lit("LOW" if f == "confidence" else UNKNOWN)) for f, d in DOMAINS.items()}
    places = F.concat_ws(" ", blob, F.array_join(F.transform(F.filter(_facts(), lambda f: f["field"].isin("city", "addressLocality", "address")), lambda f: f["value"]), " "))
    allowed = F.transform(F.concat(F.slice(_list("city_mentions"), 1, SIGNALS), let(places, lambda x: mentions(x, rules.CITY_NAMES))), F.lower)
    rows = rows.withColumns(
        {f"__{f}": e for f, e in enums.items()}
        | {
            "__business": F.when(discovery | listing, False).otherwise(F.try_variant_get(v, "$.is_business", "boolean")), "__name": clean_name(F.coalesce(said("business_name"), F.lit(""))), "__city": F.coalesce(F.nullif(F.btrim(said("city")), F.lit("")), F.lit(UNKNOWN)),
            "__price": F.coalesce(F.nullif(F.btrim(said("observed_price_range")), F.lit("")), F.lit(UNKNOWN)), "__evidence": F.transform(F.slice(F.try_variant_get(v, "$.evidence", "array<string>"), 1, 12), lambda x: F.substring(x, 1, 200)),
            "__store": storefront(blob), "__stockist_text": blob.rlike(STOCKIST) | blob.rlike(OFFICIAL_STOCKIST), "__own_text": blob.rlike(OWN_LABEL),
        }
    )
    stated = F.col("__city") != UNKNOWN
    # the places that the evidence names are looked for only where an answer states one
    rows = rows.withColumns({"__price": F.when(F.upper("__price") == UNKNOWN, UNKNOWN).otherwise(F.col("__price")), "__allowed": F.when(stated, allowed)})
    # each of these reads the whole evidence and is asked for by several codes and fields: once per row
    unsustained = F.col("__sustainability_focus").isin("HIGH", "MEDIUM") & ~blob.rlike(SUSTAINABLE)
    unpriced = ((F.col("__price_positioning") != UNKNOWN) | (F.col("__price") != UNKNOWN)) & ~blob.rlike(PRICED)
    rows = rows.withColumns({"__online": blob.rlike(P.ONLINE_ONLY), "__unsustained": unsustained, "__unpriced": unpriced})
    online, unsustained, unpriced = F.col("__online"), F.col("__unsustained"), F.col("__unpriced")

    # tests by code, in order
    yes = F.col("__physical_store") == "YES"
    never = F.col("physical_store") == "NO"
    generic = present(F.col("__name")) & generic_name(F.col("__name"))
    banned = present(F.col("__name")) & ~generic & F.lower(F.btrim("__name")).isin(*BANNED_NAMES)
    foreign = stated & ~F.array_contains("__allowed", F.lower("__city"))
    other = stated & ~foreign & present(F.col("city")) & (F.lower("__city") != F.lower("city"))
    unseen = yes & ~never & ~online & ~F.col("__store")
    codes = [
        ("directory_or_article_not_business", discovery), ("roundup_or_publisher", listing), ("generic_ai_name", generic), ("banned_ai_name", banned),
        ("cannot_override_online_only", never & yes), ("online_only_language", ~never & online & yes), ("physical_yes_without_storefront", unseen),
        ("city_not_in_evidence", foreign), ("city_mismatch_with_rules", other), ("sustainability_without_evidence", unsustained), ("price_without_evidence", unpriced),
    ]

    # a stockist needs evidence of the business's own site
    claim = F.col("__potential_stockist") == "YES"
    own = F.col("__business_type").isin(*OWN_LABEL_TYPES) | (F.col("__designer_positioning") == "OWN_LABEL") | F.col("__own_text")
    site = (F.col("source_type") == "WEBSITE") & ~listing & present(F.col("website"))
    site = F.coalesce(site, F.lit(False))
    none = F.size("__evidence") == 0
    weak = ~none & F.forall("__evidence", lambda e: F.btrim(e).rlike(WEAK_EVIDENCE))
    own_store = own | blob.rlike(OWN_STORE)
    codes_of = lambda *c: F.array(*map(F.lit, c)) if c else F.array().cast("array<string>")
    off_site = F.when(site, codes_of()).otherwise(codes_of("stockist_yes_without_official_site_evidence"))
    verdicts = [
        (discovery | listing, "NO", F.when(claim, codes_of("discovery_page_not_stockist"))), (F.coalesce(~F.col("__business"), F.lit(False)), "NO", F.when(claim, codes_of("not_a_business"))),
        (own & (F.col("__carries_other_brands") != "YES"), "NO", F.when(claim, codes_of("own_label_not_stockist"))), (~claim, None, codes_of()), (none, UNKNOWN, codes_of("stockist_yes_without_evidence")),
        (weak, UNKNOWN, codes_of("stockist_yes_weak_evidence")), (site & F.col("__stockist_text"), "YES", codes_of()), (own_store, "NO", F.concat(off_site, codes_of("designer_store_not_stockist"))),
        (F.lit(True), UNKNOWN, codes_of("stockist_yes_without_official_site_evidence", "stockist_yes_without_page_evidence")),
    ]
    verdict = None
    for test, value, found in reversed(verdicts):
        made = F.struct((F.col("__potential_stockist") if value is None else F.lit(value)).alias("value"), F.coalesce(found, codes_of()).alias("codes"))
        verdict = made if verdict is None else F.when(test, made).otherwise(verdict)
    rows = rows.withColumn("__verdict", verdict)

    missing = ~never & ~(online & yes) & ~F.col("__store")
    confirmed = never | (online & yes) | F.col("__store")
    reasons = [
        ("physical_store_validation_rejected", ((never | online) & yes)), ("physical_store_evidence_confirmed", confirmed), ("physical_store_evidence_missing", missing),
        ("physical_store_validation_rejected", unseen), ("stockist_yes_with_official_site_evidence", F.col("__verdict.value") == "YES"),
    ]
    pick = lambda pairs: F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in pairs]))
    values = {
        "ai_is_business": F.col("__business"), "ai_business_name": F.when(generic | banned, UNKNOWN).otherwise(F.col("__name")), "ai_city": F.when(foreign | other, UNKNOWN).otherwise(F.col("__city")),
        "ai_physical_store": F.when(never | (online & yes), "NO").when(unseen, UNKNOWN).otherwise(F.col("__physical_store")), "ai_sustainability_focus": F.when(unsustained, UNKNOWN).otherwise(F.col("__sustainability_focus")),
        "ai_price_positioning": F.when(unpriced, UNKNOWN).otherwise(F.col("__price_positioning")), "ai_observed_price_range": F.when(unpriced, UNKNOWN).otherwise(F.col("__price")),
        "ai_potential_stockist": F.col("__verdict.value"), "ai_evidence": F.col("__evidence"), "rejected": F.concat(pick(codes), F.col("__verdict.codes")), "validation_reasons": F.array_distinct(pick(reasons)),
    } | {f"ai_{f}": F.col(f"__{f}") for f in DOMAINS if f not in ("physical_store", "sustainability_focus", "price_positioning", "potential_stockist")}
    out = rows.withColumns({k: F.when(good, x) for k, x in values.items()})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def fill(rows: DataFrame) -> DataFrame:
    """rows whose unknown rule fields take the believed answer; known ones stay, and labels that the rules don't have are never bent to theirs. What the rules said stays as rule_*."""
    kept = {f"rule_{c}": F.col(c) for c in RULES}
    pairs = {"business_type": ("ai_business_type", RULE_TYPES), "women_fashion_relevance": ("ai_women_fashion", LEVELS[:3]), "physical_store": ("ai_physical_store", TRI[:2])}
    filled = {rule: F.when(~present(F.col(rule)) & F.coalesce(F.col(ai).isin(*domain), F.lit(False)), F.col(ai)).otherwise(F.col(rule)) for rule, (ai, domain) in pairs.items()}
    filled |= {rule: F.when(~present(F.col(rule)) & present(F.col(ai)), F.col(ai)).otherwise(F.col(rule)) for rule, ai in (("business_name", "ai_business_name"), ("city", "ai_city"))}
    return rows.withColumns(kept).withColumns(filled)


def qualify(rows: DataFrame, client: Callable[[str], str] | None, known: DataFrame | None = None, official_identity: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """rows with the model's believed answers and filled fields, and all answers to keep for the next run."""
    ready = with_inputs(rows).withColumns({"skipped_reason": F.lit("disabled") if client is None else skip_reason(official_identity), "payload": evidence_payload()})
    ready = ready.withColumn("payload_id", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("attempted", F.col("skipped_reason").isNull())
    if client is None:
        empty = ready.withColumns({"raw": F.lit(None).cast("string"), "failure_kind": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "elapsed": F.lit(0.0)})
        return fill(believe(empty)), known
    ready = written(ready)
    answers = ask_once(ready.where("attempted").select("payload_id", "payload"), client, known)
    told = answers.groupBy(F.col("payload_id").alias("__id")).agg(*[F.any_value(c).alias(c) for c in ("raw", "failure_kind", "error", "elapsed")])
    joined = ready.join(told, F.col("attempted") & (F.col("payload_id") == F.col("__id")), "left").drop("__id")
    return fill(believe(joined)), answers


class Model:
    """A client for a run, with the answers known before; after it ``answers`` holds those to keep."""

    def __init__(self, client: Callable[[str], str] | None, known: DataFrame | None = None):
        self.client, self.known, self.answers = client, known, known

    def __call__(self, rows: DataFrame) -> DataFrame:
        """rows with believed answers and filled fields, and what later steps read of them."""
        told, self.answers = qualify(rows, self.client, self.known)
        later = {"positioning": "ai_designer_positioning", "carries_other_brands": "ai_carries_other_brands", "ai_stockist": "ai_potential_stockist"}
        return told.withColumns({k: F.col(v) for k, v in later.items()}).drop("payload", "raw")


def report(rows: DataFrame) -> DataFrame:
    """One row of counts of a qualified table: rows, sent, distinct payloads, failures by kind, rejections, stockists, fields filled."""
    def changed(c: str) -> Column:
        return (~present(F.col(f"rule_{c}")) & present(F.col(c))).cast("long")

    n_filled = sum((changed(c) for c in RULES if c != "confidence"), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("attempted").alias("n_sent"), F.countDistinct(F.when(F.col("attempted"), F.col("payload_id"))).alias("n_calls"),
        *[F.count_if(F.col("failure_kind") == k).alias(f"n_{k}_failures") for k in ("http", "model", "schema")], F.count_if(F.size("rejected") > 0).alias("n_rejected"),
        *[F.count_if(F.col("ai_potential_stockist") == s).alias(f"n_stockist_{s.lower()}") for s in TRI], F.coalesce(F.sum(n_filled), F.lit(0)).cast("long").alias("n_filled"),
    )
