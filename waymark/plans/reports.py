"""Queries of sitemaps, diagnoses and reports over whole tables, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases, rules, urls
from ..operators import benchmark, candidates, crawl, diagnose, enrich, evaluate, export, model_step, paging, report, research, resolve, signals, sitemaps
from .catalog import _SHOWN, SQL_DEDUPE, SQL_EXPORT, SQL_RECORDS, SQL_URL, domain_pattern, export_rows, hits, in_list, page_records, q, query, read, sql_strip


def likes(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in parts) + ")"


def pick(column: Column, names) -> Column:
    """The name at a number modulo their count."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(column, F.lit(len(names))) + 1).cast("int"))


def sql_pick(column: str, names) -> str:
    return f"[{', '.join(map(q, names))}][CAST({column} % {len(names)} AS INTEGER) + 1]"


# --- sitemaps -----------------------------------------------------------------


@query("sitemap_priorities", rf"""WITH {SQL_URL}, p AS (SELECT page_id, lower(path) AS p, lower(url) AS u FROM u)
SELECT page_id, {likes('p', sitemaps.RELEVANT_TOKENS)} AND NOT {likes('p', sitemaps.GOODS_PATHS)} AS relevant,
  CASE WHEN {likes('u', sitemaps.SKIPPED_DOCUMENTS)} THEN 0 ELSE greatest(1, {' + '.join(f"CASE WHEN contains(u, {q(t)}) THEN 10 ELSE 0 END" for t in sitemaps.LIKED_DOCUMENTS)}) END AS priority FROM p""")
def sitemap_priorities(spark, sf):
    return read(spark, sf, "pages").select("page_id", sitemaps.relevant(F.col("url")).alias("relevant"), sitemaps.child_priority(F.col("url")).alias("priority"))


@query("sitemap_locations", rf"""WITH {SQL_URL}, g AS (SELECT host, normalized_url, min(page_id) AS s FROM m GROUP BY ALL)
SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY s) - 1 AS INTEGER) AS position, normalized_url AS url FROM g QUALIFY position < {sitemaps.MAX_LOCATIONS}""")
def sitemap_locations(spark, sf):
    """Each host's pages as its only sitemap."""
    p = read(spark, sf, "pages").withColumn("host", urls.host(F.col("url")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: F.concat(F.lit("<url><loc>"), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")))
    docs = p.groupBy("host").agg(F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.array_join(listed, ""), F.lit("</urlset>")).alias("xml"))
    docs = docs.select(F.concat(F.lit("https://"), "host").alias("site"), F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("doc_url"), "xml")
    found = sitemaps.locations(docs.select("site", "doc_url", F.lit(0).alias("ord")), docs)
    return found.select(F.substring("site", 9, 500).alias("host"), "position", "url")


# --- crawl --------------------------------------------------------------------

#: Paths that a host's second to fourth page stand for, further ones lead nowhere useful.
SITE_PATHS = (("/contact", "contact"), ("/about-us", "about"), ("/stores", "location"))


def site_web(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Each domain of pages as a site: candidates (its homepage), and stored pages (url, final_url, html).

    Its first page's html is the homepage, with links to all of SITE_PATHS on
    even sites and to one of them on odd ones; the next pages' html stands
    behind these paths, which an odd site's sitemap lists. One shop page in seven moved to another site.
    """
    p = read(spark, sf, "pages").select("page_id", "html", urls.domain(F.col("url")).alias("domain")).where("domain <> ''")
    w = Window.partitionBy("domain")
    p = p.withColumns({"k": F.row_number().over(w.orderBy("page_id")) - 1, "n": F.count(F.lit(1)).over(w), "seq": F.min("page_id").over(w)}).withColumn("site", F.concat(F.lit("https://"), "domain"))
    paths = [x for x, _ in SITE_PATHS]
    link = lambda xs: "".join(f'<a href="{x}">{x[1:]}</a>' for x in xs)
    path = F.coalesce(F.get(F.array(F.lit("/"), *map(F.lit, paths)), F.col("k").cast("int")), F.concat(F.lit("/blog/"), F.col("k").cast("string")))
    body = F.when(F.col("k") > 0, F.col("html")).otherwise(F.concat(F.when(F.col("seq") % 2 == 0, link(paths)).otherwise(link(paths[1:2])), "html"))
    moved = (F.col("k") == 3) & (F.col("page_id") % 7 == 0)
    url = F.concat("site", path)
    stored = p.select(url.alias("url"), F.when(moved, "https://moved.invalid/").otherwise(url).alias("final_url"), body.alias("html"))
    listed = F.filter(F.array(*map(F.lit, paths)), lambda x, i: i + 1 < F.col("n"))
    urlset = F.concat(F.lit("<urlset>"), F.array_join(F.transform(listed, lambda x: F.concat(F.lit("<url><loc>"), "site", x, F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    maps = p.where("k = 0 AND seq % 2 = 1").select(F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.concat("site", F.lit("/sitemap.xml")).alias("final_url"), urlset.alias("html"))
    found = p.where("k = 0").select("seq", F.concat("site", F.lit("/")).alias("url"), F.concat("site", F.lit("/")).alias("normalized_url"), F.lit("").alias("title"), F.lit("WEBSITE").alias("result_type"))
    return found, stored.unionByName(maps)


SQL_SITES = rf"""WITH {SQL_URL}, h AS (SELECT domain, page_id, html, row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1 AS k, min(page_id) OVER (PARTITION BY domain) AS seq, count(*) OVER (PARTITION BY domain) AS n FROM m WHERE domain <> ''),
w AS (SELECT s.domain, s.seq, s.n, r.path, r.role, r.k, r.score FROM h AS s, (VALUES ('/contact', 'contact', 1, 100), ('/about-us', 'about', 2, 70), ('/stores', 'location', 3, 94)) AS r(path, role, k, score) WHERE s.k = 0),
z AS (SELECT *, CASE WHEN seq % 2 = 0 OR k = 2 THEN 'homepage_link' WHEN k < n THEN 'sitemap' END AS source FROM w)"""


@query("site_enrichment", rf"""{SQL_SITES}
SELECT seq, 0 AS place, 'https://' || domain || '/' AS url, 'homepage' AS role, 'candidate' AS source, NULL AS error FROM h WHERE k = 0
UNION ALL SELECT z.seq, CAST(row_number() OVER (PARTITION BY z.seq ORDER BY z.score DESC) AS INTEGER), 'https://' || z.domain || z.path, z.role, z.source,
  CASE WHEN z.k >= z.n THEN 'not found' WHEN z.k = 3 AND p.page_id % 7 = 0 THEN 'other site' END
FROM z LEFT JOIN h AS p ON p.domain = z.domain AND p.k = z.k WHERE z.source IS NOT NULL""")
def site_enrichment(spark, sf):
    """What the crawl of every site asked for, and what came of it."""
    found, stored = site_web(spark, sf)
    return crawl.enrich(found, crawl.from_table(stored))["pages"].select("seq", "place", "url", "role", "source", "error")


# --- homepage alone or with the pages behind it -------------------------------

#: What the pages of SITE_PATHS say beside their text; a homepage says nothing of it.
CONTACTS = {
    "/contact": lambda d: F.concat(F.lit("<p>Write to shop@"), d, F.lit("</p>")), "/about-us": lambda d: F.concat(F.lit('<p><a href="https://instagram.com/'), F.regexp_replace(d, "[^a-z0-9]", "_"), F.lit('">Follow</a></p>')),
    "/stores": lambda d: F.lit("<p>Visit our store. 12 Hill Road, Mumbai 400050. Call +91 98765 43210.</p>"),
}
#: Pages asked of each site with whether they were had, and each site's phones: texts hold numbers that read as some, contact pages count first.
SQL_HAD = rf"""{SQL_SITES}, a AS (SELECT z.seq, z.k, z.k < z.n AS there, z.k < z.n AND NOT (z.k = 3 AND p.page_id % 7 = 0) AS had, p.page_id FROM z LEFT JOIN h AS p ON p.domain = z.domain AND p.k = z.k WHERE z.source IS NOT NULL),
x1 AS (SELECT page_id, seq, k, list_transform(regexp_extract_all({sql_strip(_SHOWN)}, {q(rules.PHONE)}), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS raw FROM h WHERE k <= 3),
x2 AS (SELECT page_id, seq, k, list_filter(raw, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND NOT (len(regexp_extract_all(x, '[0-9]+')) >= 5 AND len(list_filter(regexp_extract_all(x, '[0-9]+'), lambda g: length(g) > 2)) = 0))[1] AS phone FROM x1),
x3 AS (SELECT x2.seq, x2.k, CASE WHEN x2.k = 3 THEN coalesce(phone, '+91 98765 43210') ELSE phone END AS phone FROM x2 LEFT JOIN a USING (page_id) WHERE x2.k = 0 OR a.had),
ph AS (SELECT seq, max(CASE WHEN k = 0 THEN phone END) AS was, arg_min(phone, CASE k WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 5 END) AS becomes FROM x3 WHERE phone IS NOT NULL GROUP BY seq)"""


def both_branches(spark, sf) -> dict[str, DataFrame]:
    """The sites of site_web, whose pages carry CONTACTS, by their homepages and enriched."""
    found, stored = site_web(spark, sf)
    host, path = F.regexp_extract("url", "^https://([^/]+)", 1), F.regexp_extract("url", "^https://[^/]+(/.*)$", 1)
    says = F.coalesce(*[F.when(path == k, made(host)) for k, made in CONTACTS.items()], F.lit(""))
    stored = stored.withColumn("html", F.concat("html", says))
    return benchmark.homepage_or_enriched(found, stored.select("url", "html"), crawl.from_table(stored))


@query("enrichment_benchmark", f"""{SQL_HAD}, v AS (SELECT count(*) AS sites, count_if(seq % 2 = 1) AS odd, count_if(seq % 2 = 1 AND n = 1) AS bare FROM h WHERE k = 0),
b7 AS (SELECT count(*) AS asked, count_if(NOT there) AS missing, count_if(had AND k = 1) AS contact, count_if(had AND k = 2) AS about, count_if(had AND k = 3) AS stores FROM a),
o AS (SELECT unnest([{{'metric': 'candidates', 'homepage': sites, 'enriched': sites}}, {{'metric': 'raw_business_candidates', 'homepage': sites, 'enriched': sites}}, {{'metric': 'deduplicated_candidates', 'homepage': sites, 'enriched': sites}},
  {{'metric': 'high_confidence', 'homepage': 0, 'enriched': 0}}, {{'metric': 'high_women_fashion', 'homepage': 0, 'enriched': 0}}, {{'metric': 'physical_store_yes', 'homepage': 0, 'enriched': stores}}, {{'metric': 'city_populated', 'homepage': 0, 'enriched': stores}},
  {{'metric': 'address_populated', 'homepage': 0, 'enriched': stores}}, {{'metric': 'phone_populated', 'homepage': (SELECT count(was) FROM ph), 'enriched': (SELECT count(*) FROM ph)}}, {{'metric': 'email_populated', 'homepage': 0, 'enriched': contact}}, {{'metric': 'instagram_populated', 'homepage': 0, 'enriched': about}},
  {{'metric': 'total_fetches', 'homepage': sites, 'enriched': sites + asked + 2 * odd + bare}}, {{'metric': 'failed_fetches', 'homepage': 0, 'enriched': missing + odd + bare}}]) AS x FROM b7, v)
SELECT x.metric AS metric, CAST(x.homepage AS BIGINT) AS homepage, CAST(x.enriched AS BIGINT) AS enriched, CAST(x.enriched - x.homepage AS BIGINT) AS change FROM o""")
def enrichment_benchmark(spark, sf):
    """Both branches' metrics: an odd site's robots file fails, then its sitemap is asked, and a second one where that lists nothing."""
    return both_branches(spark, sf)["metrics"]


@query("owner_changes", f"""{SQL_HAD}, f AS (SELECT * FROM (VALUES ('email', 1), ('instagram', 2), ('phone', 3), ('address', 3), ('city', 3), ('physical_store', 3)) AS t(field, k))
SELECT h.seq, f.field, CASE WHEN f.field <> 'phone' THEN CASE WHEN a.had THEN 'gained' ELSE 'absent' END WHEN ph.becomes IS NULL THEN 'absent' WHEN ph.was IS NULL THEN 'gained' WHEN ph.was <> ph.becomes THEN 'changed' ELSE 'same' END AS change, false AS worse
FROM h CROSS JOIN f LEFT JOIN a ON a.seq = h.seq AND a.k = f.k LEFT JOIN ph ON ph.seq = h.seq WHERE h.k = 0""")
def owner_changes(spark, sf):
    """What the pages behind its homepage add to each site's owner."""
    fields = ("email", "instagram", "phone", "address", "city", "physical_store")
    return both_branches(spark, sf)["compared"].where(F.col("field").isin(*fields)).select("seq", "field", "change", "worse")


# --- many queries, one city ---------------------------------------------------

SQL_CITY = rf"""{SQL_DEDUPE}, e AS (SELECT *, 'q' || page_id % 7 AS asked, row_number() OVER (PARTITION BY page_id % 7, group_key ORDER BY sc DESC, ln, page_id) AS rn7, min(page_id) OVER (PARTITION BY page_id % 7, group_key) AS fs FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY fs) AS n, contains(lower(url), 'blog.') AS lk FROM e WHERE rn7 = 1),
t AS (SELECT * FROM b WHERE CASE WHEN asked = 'q6' THEN lk ELSE n <= 20 + CAST(right(asked, 1) AS INTEGER) END)"""


def city_queries(spark, sf) -> dict[str, DataFrame]:
    """Six plain queries with limits over pages, and a seventh that looks for blogs only."""
    i = F.col("id")
    specs = spark.range(7).select(F.concat(F.lit("q"), i.cast("string")).alias("query"), (i + 20).cast("int").alias("limit"), (i == 6).alias("reference"))
    return benchmark.discover(specs, hits(spark, sf), ("blog.",))


@query("city_discovery", f"""{SQL_CITY}, r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY sc DESC, ln, fs) AS best FROM t)
SELECT group_key, max(CASE WHEN best = 1 THEN url END) AS url, min(fs) AS first_seq, count(*) AS n_batches, string_agg(asked, ',' ORDER BY fs) AS discovered_by FROM r GROUP BY group_key""")
def city_discovery(spark, sf):
    return city_queries(spark, sf)["candidates"].select("group_key", "url", "first_seq", F.col("n_hits").alias("n_batches"), F.array_join("discovered_by_queries", ",").alias("discovered_by"))


@query("city_query_counts", f"""{SQL_CITY}, w7 AS (SELECT 'q' || page_id % 7 AS query, count(*) AS raw FROM pages GROUP BY ALL), s AS (SELECT 'q' || i AS query FROM range(7) AS g(i))
SELECT s.query, s.query = 'q6' AS reference, coalesce(any_value(w7.raw), 0) AS raw, count(t.page_id) AS candidates, count_if(coalesce(t.lk, false)) AS reference_hits FROM s LEFT JOIN w7 USING (query) LEFT JOIN t ON t.asked = s.query GROUP BY s.query""")
def city_query_counts(spark, sf):
    return city_queries(spark, sf)["per_query"]


# --- the model's step ---------------------------------------------------------

_SAYS = {
    "is_business": True, "business_name": "Aria House", "business_type": "MULTI_BRAND", "women_fashion": "HIGH", "physical_store": "YES", "city": "UNKNOWN", "carries_other_brands": "UNKNOWN", "designer_positioning": "UNKNOWN",
    "sustainability_focus": "HIGH", "price_positioning": "LUXURY", "observed_price_range": "UNKNOWN", "style_fit": "HIGH", "potential_stockist": "YES", "confidence": "HIGH", "evidence": ["Presents several labels."],
}
#: A deterministic model: its answer depends on the search query that the payload holds.
MODEL_ANSWERS = (
    json.dumps(_SAYS), "no answer", json.dumps(_SAYS | {"evidence": []}), json.dumps(_SAYS | {"evidence": ["Has dresses"]}), json.dumps(_SAYS | {"is_business": False}),
    json.dumps(_SAYS | {"business_type": "OWN_BRAND"}), json.dumps({k: v for k, v in _SAYS.items() if k != "city"}), json.dumps(_SAYS | {"physical_store": "NO", "sustainability_focus": "LOW", "price_positioning": "UNKNOWN", "potential_stockist": "NO"}),
)


def model_says(payload: str) -> str:
    return MODEL_ANSWERS[int(json.loads(payload)["search_query"][1:])]


def asked_documents(spark, sf) -> DataFrame:
    """Every document as the page of one website, asked about with one of eight queries; one in nine is a directory's."""
    i, unknown = F.col("doc_id"), F.lit("UNKNOWN")
    d = read(spark, sf, "documents").select(i.alias("seq"), "text", F.concat(F.lit("q"), (i % len(MODEL_ANSWERS)).cast("string")).alias("search_query"), F.when(i % 9 == 0, "DIRECTORY").otherwise("WEBSITE").alias("source_type"))
    return d.withColumns({c: unknown for c in ("business_name", "business_type", "women_fashion_relevance", "physical_store", "city", "confidence")} | {"website": F.lit("https://example.com"), "source_url": F.lit("https://example.com")})


SQL_MODEL = rf"""d AS (SELECT doc_id AS seq, doc_id % 8 AS k, coalesce(doc_id % 9 <> 0 AND text <> '' AND trim(text) <> 'UNKNOWN', false) AS sent, left(coalesce(text, ''), {model_step.TEXT_CHARS}) AS b FROM documents),
t AS (SELECT *, sent AND k NOT IN (1, 6) AS good, regexp_matches(b, {q(model_step.STORE_VISIT)}) AS visit, regexp_matches(b, {q(phrases.ONLINE_ONLY)}) AS online, regexp_matches(b, {q(model_step.SUSTAINABLE)}) AS green, regexp_matches(b, {q(model_step.PRICED)}) AS priced,
  regexp_matches(b, {q(model_step.STOCKIST)}) OR regexp_matches(b, {q(model_step.OFFICIAL_STOCKIST)}) AS stocks, k = 5 OR regexp_matches(b, {q(model_step.OWN_LABEL)}) AS own, regexp_matches(b, {q(model_step.OWN_STORE)}) AS own_store FROM d),
v AS (SELECT *, CASE WHEN k = 4 THEN 'not_a_business' WHEN own AND k <> 7 THEN 'own_label_not_stockist' WHEN k = 7 THEN NULL WHEN k = 2 THEN 'stockist_yes_without_evidence' WHEN k = 3 THEN 'stockist_yes_weak_evidence' WHEN stocks THEN NULL WHEN own_store THEN 'designer_store_not_stockist'
    ELSE 'stockist_yes_without_official_site_evidence;stockist_yes_without_page_evidence' END AS c FROM t),
w AS (SELECT *, CASE WHEN sent AND k IN (1, 6) THEN 'schema' END AS failure_kind,
  CASE WHEN good THEN array_to_string(list_filter([CASE WHEN k <> 7 AND online THEN 'online_only_language' END, CASE WHEN k <> 7 AND NOT online AND NOT visit THEN 'physical_yes_without_storefront' END,
    CASE WHEN k <> 7 AND NOT green THEN 'sustainability_without_evidence' END, CASE WHEN k <> 7 AND NOT priced THEN 'price_without_evidence' END, c], lambda x: x IS NOT NULL), ';') END AS rejected,
  CASE WHEN good THEN CASE WHEN k = 4 OR own OR k = 7 THEN 'NO' WHEN k IN (2, 3) THEN 'UNKNOWN' WHEN stocks THEN 'YES' WHEN own_store THEN 'NO' ELSE 'UNKNOWN' END END AS ai_potential_stockist,
  CASE WHEN good AND (k = 7 OR online) THEN 'NO' WHEN good AND visit THEN 'YES' ELSE 'UNKNOWN' END AS physical_store FROM v)"""


@query("model_answers", f"WITH {SQL_MODEL} SELECT seq, sent AS attempted, failure_kind, rejected, ai_potential_stockist, physical_store FROM w")
def model_answers(spark, sf):
    rows, _ = model_step.qualify(asked_documents(spark, sf), model_says)
    return rows.select("seq", "attempted", "failure_kind", F.array_join("rejected", ";").alias("rejected"), "ai_potential_stockist", "physical_store")


@query("model_report", f"""WITH {SQL_MODEL} SELECT count(*) AS n_rows, count_if(sent) AS n_sent, (SELECT count(*) FROM (SELECT DISTINCT b, k FROM w WHERE sent)) AS n_calls, CAST(0 AS BIGINT) AS n_http_failures, CAST(0 AS BIGINT) AS n_model_failures, count_if(failure_kind = 'schema') AS n_schema_failures,
count_if(rejected <> '') AS n_rejected, count_if(ai_potential_stockist = 'YES') AS n_stockist_yes, count_if(ai_potential_stockist = 'NO') AS n_stockist_no, count_if(ai_potential_stockist = 'UNKNOWN') AS n_stockist_unknown,
CAST(coalesce(sum(CASE WHEN good THEN 2 + CAST(physical_store <> 'UNKNOWN' AS INTEGER) ELSE 0 END), 0) AS BIGINT) AS n_filled FROM w""")
def model_report(spark, sf):
    return model_step.report(model_step.qualify(asked_documents(spark, sf), model_says)[0])


# --- diagnoses ----------------------------------------------------------------

ANSWERS, POSITIONS, SKIPS = ("YES", "NO", "UNKNOWN", ""), ("OWN_LABEL", "MULTI_BRAND", "UNKNOWN"), ("insufficient_page_evidence", "source_not_website", "roundup_without_page_text")
WORDS = ("a curated edit", "our own collection", "a clothing house", "plain words", "Independent designers, multi brand")


def inspected(spark, sf) -> DataFrame:
    """Every document as an inspected answer: its text, with one of WORDS in front."""
    d = read(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("seq"), F.concat_ws(" ", pick(i, WORDS), "text").alias("text"), (i % 9 != 0).alias("attempted"), pick(i, SKIPS).alias("skipped_reason"), pick(i, ANSWERS).alias("ai_stockist"),
        pick(F.floor(i / 4), POSITIONS).alias("positioning"), pick(F.floor(i / 3), ANSWERS).alias("carries"), F.when(i % 8 != 0, F.col("text")).alias("excerpt"), (i % 6 == 0).alias("shown"),
        F.when(i % 5 == 0, "BRAND").otherwise("BOUTIQUE").alias("ai_type"), F.when(i % 4 == 0, "ARTICLE").otherwise("SELF").alias("relationship"), F.when(i % 10 == 0, "NO").otherwise("YES").alias("is_business"), F.when(i % 7 == 0, "UNKNOWN").otherwise("YES").alias("geography"),
    )


SQL_INSPECTED = rf"""WITH i AS (SELECT doc_id AS seq, concat_ws(' ', {sql_pick('doc_id', WORDS)}, text) AS text, doc_id % 9 <> 0 AS attempted, {sql_pick('doc_id', SKIPS)} AS skip, {sql_pick('doc_id', ANSWERS)} AS answer,
  {sql_pick('(doc_id // 4)', POSITIONS)} AS position, {sql_pick('(doc_id // 3)', ANSWERS)} AS carries, CASE WHEN doc_id % 8 <> 0 THEN text END AS excerpt, doc_id % 6 = 0 AS shown, CASE WHEN doc_id % 5 = 0 THEN 'BRAND' ELSE 'BOUTIQUE' END AS ai_type,
  doc_id % 4 <> 0 AND doc_id % 10 <> 0 AND doc_id % 7 <> 0 AS valid FROM documents),
f AS (SELECT *, regexp_matches(text, {q(diagnose.CURATED)}) AS curated, regexp_matches(text, {q(diagnose.OWN_LABEL)}) AS own, regexp_matches(text, {q(diagnose.FASHION)}) AS fashion, length(trim(text, ' ')) < 80 AS little FROM i)"""


@query("answer_diagnoses", rf"""{SQL_INSPECTED} SELECT seq,
CASE WHEN NOT attempted THEN CASE WHEN skip IN {in_list(diagnose.NO_PAGE)} THEN 'C' ELSE 'B' END WHEN answer = 'YES' THEN 'intended' WHEN position = 'OWN_LABEL' OR carries = 'NO' OR own THEN 'D'
  WHEN shown OR curated THEN 'A' WHEN coalesce(excerpt, '') = '' THEN 'C' WHEN little OR NOT fashion THEN 'B' ELSE 'C' END AS diagnosis,
CASE WHEN NOT attempted THEN 'not_sent:' || skip WHEN position = 'OWN_LABEL' THEN 'own-label only' WHEN own AND carries <> 'YES' THEN 'designer studio / own-label language' WHEN carries = 'NO' THEN 'insufficient multi-brand evidence'
  WHEN ai_type = 'BRAND' AND carries <> 'YES' THEN 'ambiguous business type' WHEN NOT fashion THEN 'insufficient fashion evidence' WHEN NOT shown THEN 'insufficient multi-brand evidence' ELSE 'answered NO/UNKNOWN despite stockist-style language' END AS concrete_reason,
CASE WHEN shown THEN 'YES' WHEN curated OR fashion THEN 'PARTIAL' WHEN little THEN 'NO' ELSE 'PARTIAL' END AS evidence_sufficient FROM f""")
def answer_diagnoses(spark, sf):
    return diagnose.inspect(inspected(spark, sf)).select("seq", "diagnosis", "concrete_reason", "evidence_sufficient")


@query("answer_counts", f"{SQL_INSPECTED} SELECT count(*) AS valid, count_if(answer = 'YES') AS n_yes, count_if(answer = 'NO') AS n_no, count_if(answer NOT IN ('YES', 'NO')) AS n_unknown FROM i WHERE valid")
def answer_counts(spark, sf):
    return diagnose.answer_counts(inspected(spark, sf))


SOURCES = ("WEBSITE", "DIRECTORY", "ARTICLE", "SOCIAL", "VIDEO")


@query("answer_changes", f"""WITH a AS (SELECT event_id AS seq, {sql_pick('event_id', ANSWERS[:3])} AS b, {sql_pick('(event_id // 3)', ANSWERS[:3])} AS a, event_id % 4 = 0 OR event_id % 10 = 0 OR {sql_pick('(event_id // 5)', SOURCES)} <> 'WEBSITE' OR event_id % 7 = 0 AS justified FROM events)
SELECT seq, a <> b AS changed, b = 'UNKNOWN' AND (a = 'YES' OR (a = 'NO' AND justified)) AS improved, b = 'YES' AND a <> 'YES' AS weakened FROM a""")
def answer_changes(spark, sf):
    i = F.col("event_id")
    rows = read(spark, sf, "events").select(
        i.alias("seq"), pick(i, ANSWERS[:3]).alias("before"), pick(F.floor(i / 3), ANSWERS[:3]).alias("after"), F.when(i % 4 == 0, "DESIGNER").otherwise("RETAILER").alias("business_type"), F.when(i % 10 == 0, "WHOLESALE").alias("ai_business_type"),
        pick(F.floor(i / 5), SOURCES).alias("source_type"), F.when(i % 7 == 0, F.array(F.lit("roundup_page"))).otherwise(F.array().cast("array<string>")).alias("signals"),
    )
    return report.answer_changes(rows, "before", "after").select("seq", "changed", "improved", "weakened")


# --- reports ------------------------------------------------------------------

NAMES = ("Rose House", "Your Bag", "home", "10 best boutiques in Goa", "Vogue India", "UNKNOWN", "Blue Door")
KINDS = ("BOUTIQUE", "BRAND", "MARKETPLACE", "UNKNOWN")
SITES = ("https://a.com/products/x", "https://www.justdial.com/goa", "https://rose.in/", "https://shop.rose.in/collections")
ASKED = ("boutiques in Mumbai", "goa shops", "designer stores", "pune and goa")
TOWNS = ("Goa", "Bandra", "UNKNOWN", "Pune", "Delhi")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")


def doubtful(spark, sf) -> DataFrame:
    """Every customer as a row with one of the values above in each field."""
    i = F.col("c_custkey")
    none = F.lit(None).cast("string")
    return read(spark, sf, "customer").select(
        i.alias("seq"), pick(i, NAMES).alias("business_name"), pick(F.floor(i / 2), SITES).alias("website"), none.alias("source_url"), pick(F.floor(i / 3), TOWNS).alias("city"), pick(i, SOURCES).alias("source_type"), pick(i, KINDS).alias("business_type"),
        F.when(i % 3 == 0, "YES").otherwise("UNKNOWN").alias("physical_store"), F.when(i % 5 == 0, "1 Road").alias("address"), pick(F.floor(i / 4), CONFIDENCES).alias("confidence"), pick(F.floor(i / 5), ASKED).alias("query"), F.when(i % 11 == 0, "Things on TripAdvisor").alias("candidate_title"),
    )


_CITIES = ", ".join(f"CASE WHEN contains(asked, {q(c.lower())}) THEN {q(c.lower())} END" for c in rules.CITY_NAMES)
SQL_DOUBTFUL = rf"""WITH d AS (SELECT c_custkey AS seq, {sql_pick('c_custkey', NAMES)} AS name, {sql_pick('(c_custkey // 2)', SITES)} AS website, {sql_pick('(c_custkey // 3)', TOWNS)} AS city, {sql_pick('c_custkey', SOURCES)} AS source,
  {sql_pick('c_custkey', KINDS)} AS kind, c_custkey % 3 = 0 AS store, c_custkey % 5 = 0 AS address, {sql_pick('(c_custkey // 4)', CONFIDENCES)} AS confidence, lower({sql_pick('(c_custkey // 5)', ASKED)}) AS asked, c_custkey % 11 = 0 AS titled FROM customer),
e AS (SELECT *, CASE WHEN titled THEN 'Things on TripAdvisor' ELSE name END AS title, regexp_replace(regexp_extract(website, '^https?://([^/]+)', 1), '^www\.', '') AS domain, regexp_extract(website, '^https?://[^/]+(.*)', 1) AS path,
  CASE WHEN contains(asked, 'mumbai') THEN {'[' + ', '.join(map(q, report.MUMBAI_FAMILY)) + ']'} ELSE list_filter([{_CITIES}], lambda x: x IS NOT NULL) END AS family FROM d)"""


@query("suspicious_reasons", rf"""{SQL_DOUBTFUL} SELECT seq, concat_ws(',',
  CASE WHEN regexp_matches(lower(name), {q(rules.CHROME_NAME)}) THEN 'ecommerce_ui_name' END, CASE WHEN lower(name) IN {in_list(rules.GENERIC_NAMES)} THEN 'generic_page_title' END,
  CASE WHEN regexp_matches(title, {q('(?i)' + rules.ROUNDUP_TITLE)}) OR regexp_matches(name, {q('(?i)' + rules.ROUNDUP_TITLE)}) THEN 'roundup_article' END,
  CASE WHEN regexp_matches(title, {q(report.PUBLISHER)}) OR regexp_matches(name, {q(report.PUBLISHER)}) OR regexp_matches(domain, {q(report.PUBLISHER)}) THEN 'roundup_or_publisher' END,
  CASE WHEN source = 'DIRECTORY' OR regexp_matches(domain, {domain_pattern(rules.DIRECTORY_DOMAINS)}) THEN 'directory' END, CASE WHEN kind = 'MARKETPLACE' THEN 'marketplace' END, CASE WHEN regexp_matches(path, {q(report.PRODUCT_PATH)}) THEN 'product_page' END,
  CASE WHEN city <> 'UNKNOWN' AND len(family) > 0 AND NOT list_contains(family, lower(city)) THEN 'unrelated_city' END, CASE WHEN kind = 'BRAND' AND NOT store AND NOT address THEN 'brand_without_store_evidence' END,
  CASE WHEN kind = 'UNKNOWN' AND confidence = 'HIGH' THEN 'high_confidence_unknown_type' END, CASE WHEN source IN ('ARTICLE', 'VIDEO') THEN 'article_or_video_source' END) AS reasons FROM e""")
def suspicious_reasons(spark, sf):
    return doubtful(spark, sf).select("seq", F.array_join(report.suspicious_reasons(), ",").alias("reasons"))


@query("top_businesses", f"""{SQL_DOUBTFUL}, s AS (SELECT seq, name, c_custkey % 13 AS score, {sql_pick('(c_custkey // 6)', ('LEAD', 'REVIEW', 'EXCLUDED', ''))} AS status FROM d JOIN customer ON c_custkey = seq WHERE name <> 'UNKNOWN')
SELECT CAST(row_number() OVER (ORDER BY CASE status WHEN 'LEAD' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'EXCLUDED' THEN 2 ELSE 3 END, score DESC, name, seq) AS INTEGER) AS place, seq FROM s QUALIFY place <= 20""")
def top_businesses(spark, sf):
    rows = doubtful(spark, sf).withColumns({"fit_score": F.col("seq") % 13, "status": pick(F.floor(F.col("seq") / 6), ("LEAD", "REVIEW", "EXCLUDED", ""))})
    return report.top_businesses(rows).select("place", "seq")


CITIES = ("Goa", "Mumbai", "Delhi", "Bengaluru", "Pune")


@query("city_summary", f"""{SQL_DOUBTFUL}, c(city) AS (VALUES {', '.join(f"({q(c)})" for c in CITIES)}),
t AS (SELECT c.city AS town, lower(d.city) = lower(c.city) AS own, d.* FROM d JOIN c ON lower(d.city) = lower(c.city) OR contains(asked, lower(c.city))),
k AS (SELECT town, bool_or(own) AS has FROM t GROUP BY 1), u AS (SELECT t.* FROM t JOIN k USING (town) WHERE own = has)
SELECT c.city, count(seq) AS businesses, count(*) FILTER (WHERE source = 'ARTICLE') AS from_listings, count(*) FILTER (WHERE store) AS physical_stores, count(*) FILTER (WHERE kind = 'BOUTIQUE') AS fashion_relevant, count(*) FILTER (WHERE seq % 4 = 1 OR seq % 5 >= 3) AS multi_brand_or_curated,
  count(*) FILTER (WHERE seq % 3 = 0) AS n_lead, count(*) FILTER (WHERE seq % 3 = 1) AS n_review, count(*) FILTER (WHERE seq % 3 = 2) AS n_excluded FROM c LEFT JOIN u ON u.town = c.city GROUP BY 1""")
def city_summary(spark, sf):
    i = F.col("seq")
    rows = doubtful(spark, sf).select(
        F.lit(None).cast("string").alias("expected_city"), "city", F.array("query").alias("queries"), pick(i, ("LEAD", "REVIEW", "EXCLUDED")).alias("status"), F.col("physical_store").alias("physical"), F.when(F.col("business_type") == "BOUTIQUE", "HIGH").otherwise("LOW").alias("fashion"),
        F.when(i % 4 == 1, "YES").otherwise("UNKNOWN").alias("multi_brand"), (i % 5).alias("concept_score"), (F.col("source_type") == "ARTICLE").alias("listed"),
    )
    return report.city_summary(rows, CITIES)


@query("requests_report", """SELECT count(*) AS total, count_if(event_id % 9 = 0) AS failed, count_if(event_id % 4 = 0) AS n_robots, count_if(event_id % 4 = 1) AS n_sitemap, count_if(event_id % 4 >= 2) AS n_html,
  round_even(count(*) / (SELECT count(DISTINCT user_id) FROM events), 2) AS average FROM events""")
def requests_report(spark, sf):
    e = read(spark, sf, "events")
    requests = e.select(pick(F.col("event_id"), ("robots", "sitemap", "html", "html")).alias("kind"), (F.col("event_id") % 9 != 0).alias("ok"))
    return report.requests_report(requests, e.agg(F.countDistinct("user_id")).first()[0])


@query("quality_sample", f"""{SQL_DOUBTFUL}, g AS (SELECT seq, name, seq % 4 <> 0 AND seq % 6 > 0 AS rich, seq % 6 AS gained, source = 'WEBSITE' AS site, confidence = 'HIGH' AS high, store FROM d)
SELECT seq, CAST(row_number() OVER (ORDER BY rich DESC, gained DESC, site DESC, high DESC, store DESC, seq) AS INTEGER) AS place FROM g WHERE rich OR name <> 'UNKNOWN' QUALIFY place <= 20""")
def quality_sample(spark, sf):
    i = F.col("seq")
    return report.quality_sample(doubtful(spark, sf).withColumns({"comparable": i % 4 != 0, "gained": i % 6, "website_source": F.col("source_type") == "WEBSITE"}))


@query("first_of_confidence", f"""{SQL_DOUBTFUL}, a AS (SELECT 'high' AS side, seq FROM d WHERE confidence = 'HIGH' ORDER BY seq LIMIT 20), b AS (SELECT 'unsure', seq FROM d WHERE confidence = 'LOW' OR name = 'UNKNOWN' OR kind = 'UNKNOWN' ORDER BY seq LIMIT 20)
SELECT side, seq, CAST(row_number() OVER (PARTITION BY side ORDER BY seq) AS INTEGER) AS place FROM (FROM a UNION ALL FROM b)""")
def first_of_confidence(spark, sf):
    return report.first_of_confidence(doubtful(spark, sf))


EXAMPLES = (("door", ("blue door",), "YES"), ("rose", ("rose house", "rose.in"), None), ("none", ("no such needle",), "NO"), ("listing", ("justdial",), "UNKNOWN"))


@query("reference_matches", f"""{SQL_DOUBTFUL}, x(label, needle, expected) AS (VALUES {', '.join(f"({q(a)}, {q(n)}, {'NULL' if e is None else q(e)})" for a, ns, e in EXAMPLES for n in ns)}),
m AS (SELECT DISTINCT label, expected, seq, {sql_pick('seq', ANSWERS[:3])} AS answer FROM x JOIN d ON contains(lower(concat_ws(' ', name, website)), needle))
SELECT x.label, x.expected, count(m.seq) AS matches, count(m.seq) > 0 AS found, count(m.seq) > 0 AND count_if(m.expected IS NULL OR m.answer = m.expected) = count(m.seq) AS passed FROM (SELECT DISTINCT label, expected FROM x) AS x LEFT JOIN m USING (label) GROUP BY ALL""")
def reference_matches(spark, sf):
    examples = spark.createDataFrame([(a, list(n), e) for a, n, e in EXAMPLES], "label string, needles array<string>, expected string")
    return report.reference_matches(doubtful(spark, sf).withColumn("answer", pick(F.col("seq"), ANSWERS[:3])), examples)


# --- research -----------------------------------------------------------------


@query("initial_plan", """WITH s AS (SELECT o_orderkey AS seq, 'q' || o_orderkey AS query, o_orderpriority AS family, o_orderkey % 3 = 0 AS local FROM orders),
f AS (SELECT family, min(seq) AS fs FROM s GROUP BY 1), r AS (SELECT s.*, fs, row_number() OVER (PARTITION BY local, family ORDER BY seq) AS turn FROM s JOIN f USING (family)),
c AS (SELECT seq, query, family, local, row_number() OVER (PARTITION BY local ORDER BY turn, fs) AS p FROM r), k AS (SELECT *, CASE WHEN local THEN 1 ELSE 0 END AS part FROM c WHERE p <= CASE WHEN local THEN 8 ELSE 16 END)
SELECT seq, query, family, CAST(row_number() OVER (ORDER BY part, p) AS INTEGER) AS place FROM k""")
def initial_plan(spark, sf):
    """Orders as query specifications: every third asks for a locality."""
    k = F.col("o_orderkey")
    specs = read(spark, sf, "orders").select(k.alias("seq"), F.concat(F.lit("q"), k.cast("string")).alias("query"), F.col("o_orderpriority").alias("family"), F.when(k % 3 == 0, "Anjuna").otherwise("Goa").alias("location"), F.lit("goa").alias("city"))
    return research.plan_initial(specs, 24)


@query("research_members", """WITH m AS (SELECT user_id AS cluster, event_id AS id, event_id % 4 + 1 AS round, event_type AS source, CASE WHEN event_id % 3 = 0 THEN 'skipped' WHEN event_id % 50 = 1 THEN 'enriched' ELSE 'pending' END AS status,
  CASE WHEN event_id % 20 = 0 THEN ['q' || event_id % 9, 'q' || event_id % 4] ELSE [] END AS queries, 't' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS stamp FROM events),
e AS (SELECT cluster, id, unnest(queries) AS query, generate_subscripts(queries, 1) AS pos FROM m), f AS (SELECT cluster, query, min((id, pos)) AS o FROM e GROUP BY ALL), u AS (SELECT cluster, string_agg(query, ',' ORDER BY o) AS queries FROM f GROUP BY 1)
SELECT m.cluster, arg_min(id, (round, id)) AS research_id, min(round) AS round, arg_min(source, (round, id)) AS source,
  CASE WHEN bool_or(status = 'enriched' OR len(m.queries) > 0) THEN 'enriched' WHEN bool_and(status = 'skipped') THEN 'skipped' ELSE 'pending' END AS status, coalesce(any_value(u.queries), '') AS queries, max(stamp) AS researched_at
FROM m LEFT JOIN u USING (cluster) GROUP BY m.cluster""")
def research_members(spark, sf):
    """Events as members of their user's cluster."""
    i = F.col("event_id")
    made = read(spark, sf, "events").select(
        F.col("user_id").alias("cluster"), i.alias("research_id"), (i % 4 + 1).alias("round"), F.col("event_type").alias("source"), F.when(i % 3 == 0, "skipped").when(i % 50 == 1, "enriched").otherwise("pending").alias("status"),
        F.when(i % 20 == 0, F.array(F.concat(F.lit("q"), (i % 9).cast("string")), F.concat(F.lit("q"), (i % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("queries"), F.concat(F.lit("t"), F.lpad(i.cast("string"), 12, "0")).alias("researched_at"),
    )
    return research.combine_members(made).withColumn("queries", F.array_join("queries", ","))


@query("field_evidence", f"""WITH f AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, {sql_pick('event_id', ('telephone', 'email', 'brand', 'sameAs', 'url'))} AS field, 'v' || event_id % 13 AS value, event_type AS source FROM events),
n AS (SELECT id, 0 AS pos, 'name' AS field, 'U' || id AS value, 'homepage_h1' AS source FROM f WHERE id % 4 <> 0 GROUP BY id UNION ALL SELECT id, 1, 'address', 'A' || id, 'homepage_text' FROM f GROUP BY id
  UNION ALL SELECT id, pos + 1, field, value, source FROM f WHERE field <> 'brand'),
d AS (SELECT *, row_number() OVER (PARTITION BY id, field, source, value ORDER BY pos) AS rn FROM n)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS INTEGER) AS place, field, value, source FROM d WHERE rn = 1 QUALIFY place <= 24""")
def field_evidence(spark, sf):
    """Events as facts about their user."""
    i = F.col("event_id")
    fact = F.struct(i.alias("o"), pick(i, ("telephone", "email", "brand", "sameAs", "url")).alias("field"), F.concat(F.lit("v"), (i % 13).cast("string")).alias("value"), F.col("event_type").alias("source"), F.lit("e").alias("evidence"), F.lit("HIGH").alias("confidence"))
    users = read(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    user = F.col("id").cast("string")
    address = F.struct(F.lit("address").alias("field"), F.concat(F.lit("A"), user).alias("value"), F.lit("homepage_text").alias("source"), F.lit("e").alias("evidence"), F.lit("MEDIUM").alias("confidence"))
    rows = users.select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("U"), user)).alias("name"), F.lit("homepage_h1").alias("name_source"), F.lit("MEDIUM").alias("name_confidence"), F.array(address).alias("given"), "facts")
    return signals.field_evidence(rows).select("id", "place", "field", "value", "source")


# --- export -------------------------------------------------------------------


def listed_records(spark, sf) -> DataFrame:
    """The records of page_records(), every seventh found by a directory."""
    return page_records(spark, sf).withColumns({"source_type": F.when(F.col("seq") % 7 == 0, "DIRECTORY").otherwise("WEBSITE"), "title": F.col("business_name"), "signals": F.array().cast("array<string>")})


@query("export_keys", rf"""{SQL_RECORDS}, t AS (SELECT r.*, c.result_type, r.seq % 7 = 0 AS listed FROM r JOIN (SELECT page_id, normalized_url, {"CASE WHEN regexp_matches(domain, " + domain_pattern(rules.VIDEO_DOMAINS) + ") THEN 'VIDEO' WHEN regexp_matches(domain, " + domain_pattern(rules.DIRECTORY_DOMAINS) + ") THEN 'DIRECTORY' WHEN regexp_matches(domain, " + domain_pattern(rules.ARTICLE_DOMAINS) + ") OR regexp_matches(lower(path), " + q(rules.ARTICLE_PATH) + ") THEN 'ARTICLE' ELSE 'WEBSITE' END"} AS result_type FROM m) AS c ON c.page_id = r.seq)
SELECT seq, 'website' AS kind, site AS key FROM t WHERE site IS NOT NULL AND NOT listed AND result_type = 'WEBSITE' UNION ALL SELECT seq, 'instagram', account FROM t WHERE account IS NOT NULL
UNION ALL SELECT seq, 'phone', regexp_replace(phone, '[^0-9]', '', 'g') FROM t WHERE phone IS NOT NULL UNION ALL SELECT seq, 'name_city', lower(name) || '|goa' FROM t WHERE city IS NOT NULL""")
def export_keys(spark, sf):
    return resolve.keyed(export.with_media_flag(listed_records(spark, sf)), "seq", export.export_keys())


@query("lead_files", f"""{SQL_EXPORT} SELECT CASE WHEN k % 17 <> 0 THEN c_name ELSE '' END AS business_name, c_mktsegment AS website, grp AS export_group, reason AS export_reason, CASE rel WHEN 'SELF' THEN 'TRUE' ELSE 'FALSE' END AS self,
  CASE WHEN grp <> 'EXCLUDED' THEN 'TRUE' ELSE 'FALSE' END AS manual_review, lead AS stockist_lead, reason, 39 AS n_columns, CAST(k AS BIGINT) AS seq FROM h""".replace("CASE rel WHEN 'SELF' THEN 'TRUE' ELSE 'FALSE' END AS self,\n  ", ""))
def lead_files(spark, sf):
    decided = export.decide(export_rows(spark, sf))
    view = export.lead_files_view(decided.withColumn("discovery_source", F.col("seq").cast("string")))
    return view.select("business_name", "website", "export_group", "export_reason", "manual_review", "stockist_lead", "reason", F.lit(len(view.columns)).alias("n_columns"), F.col("discovery_source").cast("long").alias("seq"))


# --- runs ---------------------------------------------------------------------


@query("page_inspection", rf"""WITH {SQL_URL}, k AS (SELECT page_id, normalized_url, result_type, page_id % 4 <> 0 AS there FROM c), p AS (SELECT DISTINCT normalized_url FROM k WHERE there)
SELECT k.page_id AS seq, p.normalized_url IS NOT NULL AS fetched, CASE WHEN p.normalized_url IS NULL AND result_type = 'SOCIAL' THEN 1 ELSE 0 END AS n_social FROM k LEFT JOIN p USING (normalized_url)""")
def page_inspection(spark, sf):
    """Every page as a candidate; three in four pages could be fetched."""
    pages = read(spark, sf, "pages").select("page_id", "url", "html")
    found = pages.select(F.col("page_id").alias("seq"), "url", urls.normalize(F.col("url")).alias("normalized_url"), F.lit("t").alias("title"), urls.classify(F.col("url")).alias("result_type"))
    out = evaluate.inspect(found, pages.where("page_id % 4 <> 0").select("url", "html"))
    return out.select("seq", "fetched", F.when(~F.col("fetched"), F.size("social_urls")).otherwise(0).alias("n_social"))


@query("limited_hits", rf"""WITH {SQL_URL}, h AS (SELECT page_id AS seq, 'q' || page_id % 7 AS query, url FROM pages), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY seq) = 1)
SELECT seq, query FROM o QUALIFY row_number() OVER (PARTITION BY query ORDER BY seq) <= 20 + CAST(right(query, 1) AS INTEGER)""")
def limited_hits(spark, sf):
    specs = spark.range(7).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), (F.col("id") + 20).cast("int").alias("limit"))
    return evaluate.limited(specs, hits(spark, sf)).select("seq", "query")


@query("paged_hits", rf"""{SQL_DEDUPE}, r AS (SELECT page_id, 'q' || page_id % 7 AS query, 10 + page_id % 7 AS lim, url, CAST(ceil(row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) / 10.0) AS INTEGER) AS page FROM pages),
f AS (SELECT r.*, k.group_key, row_number() OVER (PARTITION BY r.query, r.url ORDER BY r.page_id) AS n_url, row_number() OVER (PARTITION BY r.query, k.group_key ORDER BY r.page_id) AS n_key FROM r LEFT JOIN k USING (page_id)),
g AS (SELECT query, lim, page, count_if(n_url = 1) AS n_new, sum(count_if(n_key = 1 AND group_key IS NOT NULL)) OVER (PARTITION BY query ORDER BY page) AS n_made FROM f GROUP BY query, lim, page),
s AS (SELECT query, coalesce(min(page) FILTER (WHERE n_new = 0 OR n_made >= lim), 15) AS stop FROM g GROUP BY query)
SELECT page_id, f.query, f.page FROM f JOIN s USING (query) WHERE n_url = 1 AND f.page <= least(stop, 15)""")
def paged_hits(spark, sf):
    """Seven queries over pages of ten rows of the table, each until its limit, the table's end or the fifteenth page."""
    rows = read(spark, sf, "pages").withColumn("n", F.row_number().over(Window.partitionBy(F.col("page_id") % 7).orderBy("page_id")) - 1)
    rows = rows.select(F.concat(F.lit("q"), (F.col("page_id") % 7).cast("string")).alias("query"), (F.floor(F.col("n") / 10) + 1).cast("int").alias("page"), "page_id", "url", F.col("page_id").cast("string").alias("title"), F.lit("").alias("snippet"), F.lit("table").alias("source"), (F.col("n") % 10).cast("int").alias("ord"))
    specs = spark.range(7).select(F.col("id").alias("seq"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), (F.col("id") + 10).cast("int").alias("limit"))
    found, _ = paging.collect_pages(specs, lambda plan: plan.join(rows, ["query", "page"]).drop("page_id"))
    return found.select(F.col("title").cast("long").alias("page_id"), "query", "page")


@query("batch_metrics", rf"""{SQL_DEDUPE}, w1 AS (SELECT group_key, page_id FROM w WHERE rn = 1), s AS (SELECT 'q' || i AS query, i + 20 AS lim FROM range(7) AS t(i)), x AS (SELECT DISTINCT group_key, 'q' || page_id % 7 AS query FROM k),
v AS (SELECT x.query, w1.page_id FROM x JOIN w1 USING (group_key))
SELECT s.query, CAST(lim AS INTEGER) AS "limit", (SELECT count(*) FROM pages WHERE 'q' || page_id % 7 = s.query) AS raw_results, count(v.page_id) AS unique_candidates, count_if(v.page_id % 3 <> 0 AND v.page_id % 5 <> 0) AS businesses, count_if(v.page_id % 4 = 0) AS leads FROM s LEFT JOIN v USING (query) GROUP BY s.query, lim""")
def batch_metrics(spark, sf):
    """Distinct candidates as rows: one in three has no type, one in five comes from an article."""
    specs = spark.range(7).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), (F.col("id") + 20).cast("int").alias("limit"))
    found = hits(spark, sf)
    unique = candidates.dedupe(candidates.candidates_from_hits(found))
    i = F.col("seq")
    rows = unique.select("discovered_by_queries", F.when(i % 5 == 0, "ARTICLE").otherwise("WEBSITE").alias("source_type"), F.lit("Name").alias("business_name"), F.when(i % 3 == 0, "UNKNOWN").otherwise("BOUTIQUE").alias("business_type"), F.when(i % 4 == 0, "YES").otherwise("NO").alias("stockist_lead"))
    return evaluate.query_metrics(specs, found, unique, rows)


@query("evaluated_candidates")
def evaluated_candidates(spark, sf):
    """All pages through the whole run, as businesses."""
    found = candidates.dedupe(candidates.candidates_from_hits(hits(spark, sf)))
    rows, _ = evaluate.evaluate(found, read(spark, sf, "pages").select("url", "html"))
    return rows.select("seq", "ord", "business_name", "source_type", "business_type", "relationship", "entity_quality", "stockist_lead", "status", "physical", "fashion", "fit_score")


@query("enrichment_need", f"""WITH i AS (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 > 0 AS b, event_id % 5 > 0 AS c, event_id % 7 > 0 AS d, event_id % 11 > 0 AS e, event_id % 13 > 0 AS f FROM events),
m AS (SELECT *, (NOT a)::INT + (NOT b)::INT + (NOT c)::INT + (NOT d)::INT + (NOT e)::INT + (NOT f)::INT AS missing FROM i)
SELECT event_id, CASE WHEN missing = 0 THEN 'STRONG' WHEN missing >= 3 THEN 'WEAK' ELSE 'PARTIAL' END AS tier,
  CASE WHEN missing = 0 THEN '' WHEN missing >= 3 THEN 'contact,location,about,business,fashion' ELSE concat_ws(',', CASE WHEN NOT f THEN 'contact' END, CASE WHEN NOT d OR NOT e THEN 'location' END, CASE WHEN NOT a OR NOT b OR NOT c THEN 'about' END, CASE WHEN NOT b OR NOT c THEN 'fashion' END) END AS roles,
  CASE WHEN missing = 0 THEN 'complete' ELSE concat_ws(',', CASE WHEN NOT f THEN 'missing_contact' END, CASE WHEN NOT d THEN 'missing_location' WHEN NOT e THEN 'missing_city' END, CASE WHEN NOT a THEN 'missing_identity' WHEN NOT b THEN 'missing_type' END, CASE WHEN NOT c THEN 'missing_women' END) END AS reasons FROM m""")
def enrichment_need(spark, sf):
    """Events as pages with all mixes of flags."""
    i = F.col("event_id")
    rows = read(spark, sf, "events").select("event_id", *[(i % n > 0 if n > 2 else i % n == 0).alias(f) for f, n in zip(enrich.NEEDS, (2, 3, 5, 7, 11, 13))])
    return enrich.need(rows).select("event_id", "tier", F.array_join("wanted_roles", ",").alias("roles"), F.array_join("need_reasons", ",").alias("reasons"))
