"""Export: contradictions, lead / review / excluded, order, and the flat rows of the files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import UNKNOWN, present
from .classify import is_media_or_listicle
from .graph import written
from .resolve import ambiguous_names, merge_connected

GROUPS = ("LEAD", "REVIEW", "EXCLUDED")
#: Kinds of contradiction that exclude a record.
HARD = ("lead_yes_but_article_or_directory", "lead_yes_but_not_self", "lead_yes_but_not_business", "lead_yes_but_wrong_geo", "lead_yes_but_own_label", "self_but_listicle_evidence")
EVIDENCE_CHARS = 500
RETAIL_KINDS = ("BOUTIQUE", "RETAILER", "MULTI_DESIGNER", "MARKETPLACE")


def contradictions() -> Column:
    """Kinds of conflict between fields of a record (stockist_lead, relationship, is_business, geography, own_label, listicle, ai_stockist, physical_store, online_only)."""
    lead = F.col("stockist_lead") == "YES"
    kinds = [
        ("lead_yes_but_article_or_directory", lead & F.col("relationship").isin("ARTICLE", "MEDIA", "DIRECTORY")),
        ("lead_yes_but_not_self", lead & ~F.col("relationship").isin("SELF", "ARTICLE", "MEDIA", "DIRECTORY")),
        ("lead_yes_but_not_business", lead & (F.col("is_business") == "NO")),
        ("lead_yes_but_wrong_geo", lead & (F.col("geography") == "NO")),
        ("lead_yes_but_own_label", lead & F.col("own_label")),
        ("self_but_listicle_evidence", (F.col("relationship") == "SELF") & F.col("listicle")),
        ("lead_yes_but_model_no", lead & (F.col("ai_stockist") == "NO")),
        ("lead_no_but_model_yes", (F.col("stockist_lead") == "NO") & (F.col("ai_stockist") == "YES")),
        ("store_yes_but_online_only", (F.col("physical_store") == "YES") & F.col("online_only")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds]), lambda x: x.isNotNull())


def decide(records: DataFrame) -> DataFrame:
    """records with export_group, export_reason and conflicts; the first rule that applies decides.

    Beside the fields of contradictions(): business_name, identity_invalid,
    unrelated, ambiguous, identity_weak, third_party, usable_contact,
    social_only, social_retail, retail_evidence, stockist_evidence.
    """
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("identity_invalid", "own_label", "unrelated", "ambiguous", "identity_weak", "third_party", "usable_contact", "social_only", "social_retail", "retail_evidence", "stockist_evidence", "listicle")}
    relationship = F.coalesce("relationship", F.lit(UNKNOWN))
    hard = F.arrays_overlap("conflicts", F.array(*map(F.lit, HARD)))
    soft = F.size("conflicts") > 0
    mentioned = relationship == "MENTIONED_BUSINESS"
    rules: Sequence[tuple[Column, str, str]] = (
        (relationship.isin("ARTICLE", "MEDIA", "DIRECTORY", "SOCIAL_POST") | (flag["listicle"] & ~mentioned), "EXCLUDED", "article_or_directory_not_business"),
        (flag["identity_invalid"], "EXCLUDED", "identity_demonstrably_invalid"),
        (F.col("geography") == "NO", "EXCLUDED", "wrong_geography"),
        (flag["own_label"], "EXCLUDED", "own_label_not_external_stockist"),
        (flag["unrelated"], "EXCLUDED", "unrelated_or_non_retail_business"),
        (mentioned & flag["retail_evidence"] & flag["usable_contact"], "REVIEW", "mentioned_business_not_self"),
        (mentioned, "REVIEW", "mentioned_business_needs_verification"),
        (relationship != "SELF", "REVIEW", "entity_relationship_not_self"),
        (flag["ambiguous"], "REVIEW", "ambiguous_identity_keep_separate"),
        (hard, "EXCLUDED", "contradictory_classification_excluded"),
        (soft, "REVIEW", "contradictory_classification"),
        (~present(F.col("business_name")), "REVIEW", "identity_incomplete"),
        (F.col("geography") == UNKNOWN, "REVIEW", "geography_unconfirmed"),
        (flag["identity_weak"], "REVIEW", "official_identity_weak"),
        (flag["third_party"], "REVIEW", "third_party_listing_identity"),
        (~flag["usable_contact"], "REVIEW", "no_usable_contact_path"),
        (flag["social_only"] & ~flag["social_retail"], "REVIEW", "social_identity_insufficient_retail_evidence"),
        (~flag["retail_evidence"], "REVIEW", "fashion_retail_evidence_missing"),
        (~flag["stockist_evidence"], "REVIEW", "multi_brand_status_unknown"),
        (F.col("ai_stockist") == "NO", "REVIEW", "potential_stockist_no_without_hard_exclusion"),
        (F.col("stockist_lead") == "YES", "LEAD", "consistent_self_business_with_contact_and_retail_evidence"),
        (F.col("ai_stockist") == "YES", "LEAD", "model_yes_with_official_identity"),
    )
    choice = F.struct(F.lit("LEAD").alias("g"), F.lit("plausible_retail_business_with_usable_contact").alias("r"))
    for test, group, reason in reversed(rules):
        choice = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(group).alias("g"), F.lit(reason).alias("r"))).otherwise(choice)
    # an ambiguous record whose fields contradict each other hard is excluded all the same
    out = records.withColumn("conflicts", contradictions()).withColumn("__d", choice)
    clash = (F.col("__d.r") == "ambiguous_identity_keep_separate") & hard
    out = out.withColumn("export_group", F.when(clash, "EXCLUDED").otherwise(F.col("__d.g"))).withColumn("export_reason", F.when(clash, "contradictory_classification_excluded").otherwise(F.col("__d.r")))
    return out.withColumn("manual_review", F.col("export_group") != "EXCLUDED").drop("__d")


def group_rank(group: Column) -> Column:
    return F.coalesce(*[F.when(group == g, i) for i, g in enumerate(GROUPS)], F.lit(len(GROUPS)))


def export_order(df: DataFrame) -> DataFrame:
    """Leads, reviews, excluded; then name in any case, website and source."""
    return df.orderBy(group_rank(F.col("export_group")), F.lower("business_name"), F.coalesce("website", F.lit("")), F.coalesce("source_url", F.lit("")))


def cut(text: Column, most: int = EVIDENCE_CHARS) -> Column:
    """Text of at most so many characters, dots at the end of what is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def flat(df: DataFrame) -> DataFrame:
    """Columns as the files show them: lists joined by ``; ``, booleans TRUE or FALSE, texts cut, nulls empty."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind.startswith("array<string"):
            c = F.array_join(c, "; ")
        elif kind == "boolean":
            c = F.when(c, "TRUE").when(~c, "FALSE")
        elif not kind.startswith(("string", "array", "struct", "map")):
            c = c.cast("string")
        elif kind != "string":
            c = F.to_json(c)
        out.append(F.coalesce(cut(c), F.lit("")).alias(f.name))
    return df.select(*out)


# --- fixed values: columns of the lead files, in order, and the files ---------
LEAD_COLUMNS = (
    "business_name", "city", "address", "website", "instagram", "facebook", "phone", "email", "export_group", "export_reason", "business_type", "women_fashion_relevance", "physical_store",
    "carries_other_brands", "potential_stockist", "stockist_lead", "confidence", "entity_quality", "manual_review", "discovered_by_queries", "source_urls", "export_evidence", "state", "country",
    "physical_store_confidence", "fashion_relevance", "retail_model", "multi_brand_confidence", "fit_score", "geography_confidence", "business_confidence", "discovery_source", "discovery_source_url",
    "discovery_source_type", "evidence_physical_store", "evidence_multi_brand", "evidence_fashion", "evidence_fit", "reason",
)
FILES = {"stockist_leads": None, "stockist_leads_only": "LEAD", "stockist_review_only": "REVIEW", "stockist_excluded": "EXCLUDED"}
ENUMS = {"confidence": ("HIGH", "MEDIUM", "LOW"), "business_type": ("BOUTIQUE", "DESIGNER", "BRAND", "RETAILER", "MULTI_DESIGNER", "MARKETPLACE", UNKNOWN), "physical_store": ("YES", "NO", UNKNOWN), "fashion_relevance": ("HIGH", "MEDIUM", "LOW", UNKNOWN), "women_fashion_relevance": ("HIGH", "MEDIUM", "LOW", UNKNOWN)}
BOM = "\ufeff"


def load_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON file: an array of them, or an object that holds them as business_candidates_llm; numbered by ``seq`` in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    held = F.when(F.btrim("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.from_json("value", f"struct<business_candidates_llm:array<struct<{schema}>>>")["business_candidates_llm"])
    return rehydrate(whole.select(F.posexplode(held).alias("seq", "r")).select("seq", "r.*"))


def rehydrate(df: DataFrame) -> DataFrame:
    """df with its enumerations in capitals and underscores; what is no member becomes UNKNOWN, LOW for confidence."""
    made = {}
    for name, members in ENUMS.items():
        if name in df.columns:
            value = F.upper(F.translate(F.btrim(F.coalesce(name, F.lit(""))), " -", "__"))
            made[name] = F.when(value.isin(*members), value).otherwise("LOW" if name == "confidence" else UNKNOWN)
    return df.withColumns(made)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files: objects line by line, arrays of them, or reports that hold them as business_candidates_llm; all columns as they are, enumerations as rehydrate() makes them."""
    df = spark.read.json(path)
    if "_corrupt_record" in df.columns:
        df = spark.read.json(path, multiLine=True)
    if "business_candidates_llm" in df.columns:
        df = df.select(F.explode("business_candidates_llm").alias("r")).select("r.*")
    df = df if "seq" in df.columns else df.withColumn("seq", F.monotonically_increasing_id())
    return rehydrate(df)


def complete(records: DataFrame) -> DataFrame:
    """records with all columns that the export reads: contacts and verdicts that they lack are unknown, flags follow from the fields there are."""
    texts = ("city", "website", "instagram", "facebook", "whatsapp", "phone", "email", "address", "source_url", "source_type", "own_label_text")
    out = records.withColumns({c: F.lit(None).cast("string") for c in texts if c not in records.columns})
    verdicts = ("business_type", "physical_store", "ai_stockist", "stockist_lead", "relationship", "geography", "is_business", "carries_other_brands", "confidence")
    out = out.withColumns({c: F.lit(UNKNOWN) for c in verdicts if c not in records.columns}).drop("own_label_text")
    contact = reduce(lambda a, b: a | b, [present(F.col(c)) for c in ("website", "instagram", "facebook", "whatsapp", "phone", "email")])
    social = present(F.col("instagram")) | present(F.col("facebook"))
    yes = lambda c: F.coalesce(F.upper(c) == "YES", F.lit(False))
    made = {
        "usable_contact": contact, "social_only": social & ~present(F.col("website")), "retail_evidence": F.coalesce(F.col("business_type").isin(*RETAIL_KINDS), F.lit(False)) | yes("physical_store"),
        "stockist_evidence": yes("stockist_lead") | yes("ai_stockist") | yes("carries_other_brands"), "social_retail": F.coalesce(F.col("business_type").isin(*RETAIL_KINDS), F.lit(False)),
    }
    if "entity_quality" in out.columns:
        made["identity_weak"] = F.coalesce(F.upper("entity_quality").isin("WEAK", "LOW", "REJECTED"), F.lit(False))
    false = ("own_label", "listicle", "online_only", "identity_invalid", "unrelated", "identity_weak", "third_party")
    return out.withColumns({c: v for c, v in made.items() if c not in records.columns} | {c: F.lit(False) for c in false if c not in records.columns and c not in made})


def export_keys() -> dict[str, Column]:
    """Kind to key of a record for the export: stricter than the keys of merges.

    A website counts if it is the business's own: no article, directory, video
    or listicle, nor the domain of the listing that named it. An account counts
    from profiles only, a phone from ten digits on.
    Reads business_name, city, website, instagram, phone, source_url, source_type, title and signals.
    """
    site = urls.key_domain(F.col("website"))
    listed = F.col("source_type").isin("ARTICLE", "DIRECTORY") & F.coalesce(urls.key_domain(F.col("source_url")) == site, F.lit(False))
    foreign = F.coalesce(urls.classify(F.col("website")).isin("ARTICLE", "DIRECTORY", "VIDEO"), F.lit(False)) | F.col("__media") | listed
    digits = urls.key_phone(F.col("phone"))
    post = F.coalesce(urls.is_social_post(F.col("instagram")), F.lit(False)) | F.coalesce(urls.is_social_post(F.col("source_url")), F.lit(False))
    return {"website": F.when(~foreign, site), "instagram": F.when(~post, urls.key_instagram(F.col("instagram"))), "phone": F.when(F.length(digits) >= 10, digits), "name_city": urls.key_name_city(F.col("business_name"), F.col("city"))}


def with_media_flag(records: DataFrame) -> DataFrame:
    """records with what export_keys() reads: whether the website's page is a publisher's or a list."""
    given = {"title": F.col("business_name"), "signals": F.array().cast("array<string>"), "source_type": F.lit("WEBSITE")}
    full = records.withColumns({k: v for k, v in given.items() if k not in records.columns} | {"__seq": F.col("seq")})
    asked = full.select("__seq", F.col("website").alias("url"), F.coalesce("title", "business_name").alias("title"), F.lit("").alias("text"), "source_type", "signals").withColumn("__media", is_media_or_listicle())
    return full.join(asked.select("__seq", "__media"), "__seq").drop("__seq")


def export_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decided rows, one for each business after the merge over all chains of shared keys, and the names that stay ambiguous."""
    ready = written(with_media_flag(records))
    merged, pairs = merge_connected(ready, strict=True, keys=export_keys())
    merged = written(merged)
    names = written(ambiguous_names(merged, pairs, ready))
    given = {c: F.first(c, True).alias(c) for c in ready.columns if c not in merged.columns and c not in ("__media", "seq")}
    # fields that the merge doesn't know are the first member's
    labelled = ready.join(merged.select("seq"), "seq", "left_semi")
    kept = labelled.select("seq", *given) if given else labelled.select("seq")
    wide = merged.join(kept, "seq").join(names.select(F.col("name").alias("__n")), F.lower("business_name") == F.col("__n"), "left")
    wide = wide.withColumn("ambiguous", F.col("__n").isNotNull()).drop("__n")
    return decide(wide), names


def lead_files_view(df: DataFrame) -> DataFrame:
    """The 39 columns of the lead files as text; columns that a table lacks are empty, and the reason falls back on the export's."""
    made = []
    for c in LEAD_COLUMNS:
        source = "merged_source_urls" if c == "source_urls" and "merged_source_urls" in df.columns else c
        made.append((F.col(source) if source in df.columns else F.lit("")).alias(c))
    flat_ = flat(df.select(*made))
    unknown = {c: F.when(F.col(c) == UNKNOWN, "").otherwise(F.col(c)) for c in LEAD_COLUMNS[:8]}
    return flat_.withColumns(unknown | {"reason": F.when(F.col("reason") == "", F.col("export_reason")).otherwise(F.col("reason"))})


def write_exports(df: DataFrame, folder: str) -> None:
    """Six outputs: CSV of all rows and of each group, all rows as JSON, and the summary.

    CSV rows are in the export's order, and every part file starts with a byte
    order mark before its header. A table without a reason wasn't decided here: its
    summary counts groups only, and as it may have other columns than a
    lead's, each group is written with all of them, too, in a folder of its name.
    """
    if "export_reason" not in df.columns:
        every = flat(export_order(df))
        for group in GROUPS:
            every.where(F.col("export_group") == group).write.mode("overwrite").csv(f"{folder}/{group.lower()}", header=True, escape='"')
        df = df.withColumn("export_reason", F.lit(None).cast("string"))
    ordered = written(export_order(df))
    for name, group in FILES.items():
        rows = ordered if group is None else ordered.where(F.col("export_group") == group)
        view = lead_files_view(export_order(rows))
        marked = view.withColumnRenamed(LEAD_COLUMNS[0], BOM + LEAD_COLUMNS[0])
        marked.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True, encoding="UTF-8", quoteAll=False, escape='"')
    ordered.write.mode("overwrite").json(f"{folder}/stockist_leads.json")
    counts, reasons = summary(ordered if "seq" in ordered.columns else ordered.withColumn("seq", F.monotonically_increasing_id()))
    counts.select(F.lit("group").alias("kind"), F.col("export_group").alias("name"), "n").unionByName(reasons.select(F.lit("reason").alias("kind"), F.col("export_reason").alias("name"), "n")).write.mode("overwrite").json(f"{folder}/stockist_export_summary.json")


# --- fixed values: columns of the flat shop list ------------------------------
SHOP_COLUMNS = (
    ("name", "Name"), ("city", "City"), ("address", "Address"), ("phone", "Phone"), ("email", "Email"), ("website", "Website"),
    ("instagram", "Instagram"), ("facebook", "Facebook"), ("source", "Source"), ("notes", "Notes"),
)


def shop_list(df: DataFrame) -> DataFrame:
    """The ten columns of the shop list under their titles; columns that a table lacks are null."""
    return df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(title) for c, title in SHOP_COLUMNS])


def summary(df: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by group with zeros, and the commonest reasons, first seen first among equals."""
    groups = df.sparkSession.createDataFrame([(g,) for g in GROUPS], "export_group string")
    counts = groups.join(df.groupBy("export_group").agg(F.count(F.lit(1)).alias("n")), "export_group", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reasons = df.where("export_reason IS NOT NULL").groupBy("export_reason").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(top).drop("first")
    return counts, reasons
