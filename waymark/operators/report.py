"""Reports: conditional counts, per-group histograms, before-and-after comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions.text import present, roundup_title

# --- fixed values: hints of doubtful rows -------------------------------------
# --- fixed values: paths, publishers, places and ranks of the reports ---------
PRODUCT_PATH = r"(?i)/(?:products?|collections?|item|sku)(?:/|$)"
PUBLISHER = r"(?i)\b(?:times of india|hindustan times|indian express|vogue|elle|lifestyleasia|time\s*out|tripadvisor|yelp|justdial|sulekha|wikipedia|medium\.com)\b"
MUMBAI_FAMILY = ("mumbai", "navi mumbai", "thane", "bandra", "khar", "colaba")
STATUS_RANKS = (("LEAD", 0), ("REVIEW", 1), ("EXCLUDED", 2))


def funnel(df: DataFrame, steps: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows that meet each condition, in one pass."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in steps.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)


def histogram(df: DataFrame, by: str, status: str, values: Sequence[str]) -> DataFrame:
    """One row for each group with a count of each status."""
    return df.groupBy(by).agg(*[F.count_if(F.coalesce(F.col(status) == v, F.lit(False))).alias(f"n_{v.lower()}") for v in values])


def top_reasons(df: DataFrame, reason: str, order: str, k: int) -> DataFrame:
    """The k commonest reasons, first seen first among equals."""
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def compare(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, change) for each field of each key: gained, lost, changed or same; keys of either side."""
    a = before.select(F.col(key).alias("ka"), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = after.select(F.col(key).alias("kb"), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    joined = a.join(b, F.col("ka") == F.col("kb"), "full")
    changes = [F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("x"), F.col(f"b_{f}").alias("y")) for f in fields]
    long = joined.select(F.coalesce("ka", "kb").alias(key), F.explode(F.array(*changes)).alias("c")).select(key, "c.*")
    change = F.when(F.col("x").isNull() & F.col("y").isNull(), "absent").when(F.col("x").isNull(), "gained").when(F.col("y").isNull(), "lost").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return long.select(key, "field", change.alias("change"))


def gains(compared: DataFrame) -> DataFrame:
    """Counts of each change by field."""
    kinds = ("gained", "lost", "changed", "same", "absent")
    return compared.groupBy("field").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])


def suspicious(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def text_table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Lines of a fixed-width table."""
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()]
    return df.select(F.rtrim(F.concat_ws("  ", *cells)).alias("line"))


def suspicious_reasons() -> Column:
    """The eleven hints that a row is doubtful, in order.

    Reads business_name, website, source_url, city, source_type, business_type,
    physical_store, address, confidence, query and candidate_title.
    """
    text = {c: F.coalesce(c, F.lit("")) for c in ("business_name", "website", "source_url", "city", "source_type", "business_type", "physical_store", "confidence", "query")}
    name, kind = text["business_name"], text["business_type"]
    title = F.when(F.coalesce("candidate_title", F.lit("")) != "", F.col("candidate_title")).otherwise(name)
    domain = F.coalesce(urls.domain(F.col("website")), urls.domain(F.col("source_url")), F.lit(""))
    asked = F.lower(text["query"])
    named = F.filter(F.array(*[F.when(F.contains(asked, F.lit(c.lower())), F.lit(c.lower())) for c in rules.CITY_NAMES]), lambda x: x.isNotNull())
    family = F.when(F.contains(asked, F.lit("mumbai")), F.array(*map(F.lit, MUMBAI_FAMILY))).otherwise(named)
    return suspicious(
        {
            "ecommerce_ui_name": F.lower(F.btrim(name)).rlike(rules.CHROME_NAME), "generic_page_title": F.lower(F.btrim(name)).isin(*rules.GENERIC_NAMES),
            "roundup_article": roundup_title(title) | roundup_title(name), "roundup_or_publisher": title.rlike(PUBLISHER) | name.rlike(PUBLISHER) | domain.rlike(PUBLISHER),
            "directory": (text["source_type"] == "DIRECTORY") | urls.in_catalog(domain, rules.DIRECTORY_DOMAINS), "marketplace": kind == "MARKETPLACE",
            "product_page": F.coalesce(urls.path(F.col("website")), F.lit("")).rlike(PRODUCT_PATH),
            "unrelated_city": present(F.col("city")) & (F.size(family) > 0) & ~F.array_contains(family, F.lower(F.btrim(text["city"]))),
            "brand_without_store_evidence": (kind == "BRAND") & (text["physical_store"] != "YES") & ~present(F.col("address")),
            "high_confidence_unknown_type": (kind == "UNKNOWN") & (text["confidence"] == "HIGH"), "article_or_video_source": text["source_type"].isin("ARTICLE", "VIDEO"),
        }
    )


def status_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, r) for s, r in STATUS_RANKS], F.lit(3))


def top_businesses(df: DataFrame, k: int = 20) -> DataFrame:
    """The best k named rows (status, fit_score, business_name, seq) by status, score and name, numbered.

    Excluded rows come after all others, so none is taken once there are k others.
    """
    order = [status_rank(F.col("status")), F.coalesce("fit_score", F.lit(0)).desc(), F.col("business_name"), F.col("seq")]
    best = df.where((F.coalesce("business_name", F.lit("")) != "") & (F.col("business_name") != "UNKNOWN")).orderBy(*order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over k rows


def city_summary(rows: DataFrame, cities: Sequence[str]) -> DataFrame:
    """One row for each city with its statuses and counts of rows (expected_city, city, queries, status, physical, fashion, multi_brand, concept_score, listed).

    A city's rows are those of its expected or own city; a city without any
    takes the rows whose queries name it.
    """
    own = F.lower(F.coalesce(*[F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("expected_city", "city")], F.lit("unknown")))
    asked = F.lower(F.array_join(F.coalesce("queries", F.array().cast("array<string>")), " "))
    names = F.array(*map(F.lit, cities))
    tagged = rows.withColumn("__city", F.explode(F.filter(names, lambda c: (F.lower(c) == own) | F.contains(asked, F.lower(c))))).withColumn("__own", F.lower("__city") == own)

    def tests(by: Column) -> list[Column]:
        t = {
            "businesses": F.lit(True), "from_listings": F.col("listed"), "physical_stores": F.col("physical") == "YES", "fashion_relevant": F.col("fashion").isin("HIGH", "MEDIUM"),
            "multi_brand_or_curated": (F.col("multi_brand") == "YES") | (F.col("concept_score") >= 3), "n_lead": F.col("status") == "LEAD", "n_review": F.col("status") == "REVIEW", "n_excluded": F.col("status") == "EXCLUDED",
        }
        return [F.count_if(by & F.coalesce(v, F.lit(False))).alias(k) for k, v in t.items()]

    both = tagged.groupBy("__city").agg(F.struct(*tests(F.col("__own"))).alias("own"), F.struct(*tests(~F.col("__own"))).alias("asked"))
    chosen = both.select(F.col("__city").alias("city"), F.when(F.col("own.businesses") > 0, F.col("own")).otherwise(F.col("asked")).alias("c"))
    all_ = df_of_names(rows, cities).join(chosen, "city", "left")
    kinds = ("businesses", "from_listings", "physical_stores", "fashion_relevant", "multi_brand_or_curated", "n_lead", "n_review", "n_excluded")
    return all_.select("city", *[F.coalesce(F.col(f"c.{k}"), F.lit(0)).cast("long").alias(k) for k in kinds])


def df_of_names(like: DataFrame, names: Sequence[str], column: str = "city") -> DataFrame:
    return like.sparkSession.createDataFrame([(x,) for x in names], f"{column} string")


def requests_report(requests: DataFrame, n_candidates: int) -> DataFrame:
    """One row: requests (kind, ok) in all, failed, by kind, and a candidate on average, rounded half to even."""
    kinds = ("robots", "sitemap", "html")
    counts = [F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))).alias(f"n_{k}") for k in kinds]
    return requests.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), *counts, F.bround(F.count(F.lit(1)) / max(1, n_candidates), 2).alias("average"))


def quality_sample(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The k best pairs (seq, comparable, gained, website_source, confidence, physical_store, business_name): those that gained first, then named ones, each by gains, website, confidence and store."""
    rich = F.coalesce(F.col("comparable") & (F.col("gained") > 0), F.lit(False))
    usable = pairs.where(rich | present(F.col("business_name")))
    order = [rich.desc(), F.desc("gained"), F.col("website_source").desc(), (F.col("confidence") == "HIGH").desc(), (F.col("physical_store") == "YES").desc(), F.col("seq")]
    return usable.orderBy(*order).limit(k).select("seq", F.row_number().over(Window.orderBy(*order)).alias("place"))


def first_of_confidence(df: DataFrame, k: int = 20) -> DataFrame:
    """(side, place, seq): the first k rows of high confidence, and the first k that are unsure (seq, confidence, business_name, business_type)."""
    sure = df.where("confidence = 'HIGH'").orderBy("seq").limit(k).select(F.lit("high").alias("side"), "seq")
    unsure = df.where("confidence = 'LOW' OR business_name = 'UNKNOWN' OR business_type = 'UNKNOWN'").orderBy("seq").limit(k).select(F.lit("unsure").alias("side"), "seq")
    return sure.unionByName(unsure).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy("seq")))


def reference_matches(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """(label, expected, matches, found, passed) of examples (label, needles, expected) against rows (business_name, website, source_url, answer).

    A few examples, each a row of literals, against all rows: one pass that
    counts, for each example, rows with a needle and those whose answer fits.
    """
    hay = F.lower(F.concat_ws(" ", "business_name", "website", "source_url"))
    met = rows.select(hay.alias("hay"), F.col("answer")).join(F.broadcast(examples), F.expr("exists(needles, n -> contains(hay, n))"))
    counted = met.groupBy("label").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("expected").isNull() | (F.col("answer") == F.col("expected"))).alias("fit"))
    out = examples.select("label", "expected").join(counted, "label", "left").withColumns({"matches": F.coalesce("matches", F.lit(0)), "fit": F.coalesce("fit", F.lit(0))})
    return out.select("label", "expected", F.col("matches").cast("long").alias("matches"), (F.col("matches") > 0).alias("found"), ((F.col("matches") > 0) & (F.col("fit") == F.col("matches"))).alias("passed"))


def answer_changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """df with changed, improved and weakened: what became of a three-state answer.

    An answer out of UNKNOWN improves if it is YES, or NO of an own label or a
    discovery page (business_type, ai_business_type, source_type, signals);
    one out of YES weakens.
    """
    b, a = F.upper(F.coalesce(before, F.lit("UNKNOWN"))), F.upper(F.coalesce(after, F.lit("UNKNOWN")))
    own_label = F.col("business_type").isin("DESIGNER", "BRAND") | F.col("ai_business_type").isin("DESIGNER", "OWN_BRAND", "WHOLESALE")
    found = F.col("source_type").isin("DIRECTORY", "ARTICLE", "SOCIAL", "VIDEO") | F.arrays_overlap("signals", F.array(F.lit("roundup_page"), F.lit("publisher_not_boutique")))
    justified = F.coalesce(own_label, F.lit(False)) | F.coalesce(found, F.lit(False))
    return df.withColumns({"changed": b != a, "improved": (b == "UNKNOWN") & ((a == "YES") | ((a == "NO") & justified)), "weakened": (b == "YES") & (a != "YES")})
