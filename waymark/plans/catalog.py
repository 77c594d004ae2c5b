"""Every registered query: the operator applied to the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, places, rules, text, urls
from ..operators import budget, candidates, enrich, export, geo, graph, identify, lead, ordered, queries, report, resolve, score, seeds, signals, store
from ..sources import pages as page_source

EDGE = r"[^\p{L}\p{N}_]"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        CATALOG[name] = Query(f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def domain_pattern(domains) -> str:
    return q(r"(^|\.)(" + "|".join(re.escape(d) for d in domains) + ")$")


# --- URLs and candidates ------------------------------------------------------

SQL_URL = rf"""
u AS (
  SELECT *, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS query
  FROM pages),
n AS (
  SELECT *, regexp_replace(host, '^www\.', '') AS domain,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) IN {in_list(rules.TRACKING_PARAMS)} OR starts_with(lower(x), 'utm_')))), '&') AS kept
  FROM u),
m AS (SELECT *, 'https://' || domain || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS normalized_url FROM n),
c AS (
  SELECT *, CASE WHEN domain = '' THEN 'UNKNOWN'
    WHEN regexp_matches(domain, {domain_pattern(rules.VIDEO_DOMAINS)}) THEN 'VIDEO'
    WHEN regexp_matches(domain, {domain_pattern(rules.SOCIAL_DOMAINS)}) THEN 'SOCIAL'
    WHEN regexp_matches(domain, {domain_pattern(rules.DIRECTORY_DOMAINS)}) THEN 'DIRECTORY'
    WHEN regexp_matches(domain, {domain_pattern(rules.ARTICLE_DOMAINS)}) OR regexp_matches(lower(path), {q(rules.ARTICLE_PATH)}) THEN 'ARTICLE'
    ELSE 'WEBSITE' END AS result_type,
    CASE WHEN lower(trim(path, '/')) IN ('', 'index', 'index.html', 'home') THEN 100
      ELSE greatest(0, 40 - 8 * len(list_filter(string_split(path, '/'), lambda x: x <> ''))) - least(length(path), 40)
        + CASE WHEN regexp_matches(lower(path), '/about|/contact|/store|/shop|/boutique') THEN 15 ELSE 0 END END
    - CASE WHEN query <> '' THEN 10 ELSE 0 END + CASE WHEN starts_with(url, 'https') THEN 5 ELSE 0 END AS useful
  FROM m)"""


@query("url_normalize", f"WITH {SQL_URL} SELECT page_id, normalized_url FROM m")
def url_normalize(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized_url"))


@query("url_domain", f"WITH {SQL_URL} SELECT page_id, host, domain FROM m")
def url_domain(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.domain(F.col("url")).alias("domain"))


@query("url_classify", f"WITH {SQL_URL} SELECT page_id, result_type FROM c")
def url_classify(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.classify(F.col("url")).alias("result_type"))


@query("url_usefulness", f"WITH {SQL_URL} SELECT page_id, CAST(useful AS INTEGER) AS usefulness FROM c")
def url_usefulness(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.usefulness(F.col("url")).alias("usefulness"))


@query("url_same_site", rf"""WITH {SQL_URL}, d AS (SELECT domain, count(*) AS n, min(page_id) AS first FROM m GROUP BY domain),
r AS (SELECT a.domain, sum(b.n) - 1 AS others, min(b.first) AS first FROM d AS a JOIN d AS b ON a.domain = b.domain OR ends_with(a.domain, '.' || b.domain) OR ends_with(b.domain, '.' || a.domain) GROUP BY a.domain)
SELECT page_id, domain, CAST(others AS BIGINT) AS n_same_site, first AS first_same_site FROM m JOIN r USING (domain)""")
def url_same_site(spark, sf):
    """Each page with the pages on its site: those of its domain, of parent domains and of subdomains; pages meet as counts of domains, never as pairs."""
    p = read(spark, sf, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))
    d = p.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    up = d.select("domain", F.explode(urls.suffixes(F.col("domain"))).alias("parent")).join(d.select(F.col("domain").alias("parent")), "parent")
    both = up.select(F.col("domain").alias("a"), F.col("parent").alias("b")).unionByName(up.select(F.col("parent").alias("a"), F.col("domain").alias("b"))).distinct()
    site = both.join(d.withColumnRenamed("domain", "b"), "b").groupBy(F.col("a").alias("domain")).agg((F.sum("n") - 1).alias("n_same_site"), F.min("first").alias("first_same_site"))
    return p.join(site, "domain").select("page_id", "domain", "n_same_site", "first_same_site")


def hits(spark, sf) -> DataFrame:
    p = read(spark, sf, "pages")
    return p.select(F.col("page_id").alias("seq"), F.lit("").alias("title"), "url", F.lit("").alias("snippet"), F.lit("table").alias("source"), F.concat(F.lit("q"), (F.col("page_id") % 7).cast("string")).alias("query"))


SQL_DEDUPE = rf"""WITH {SQL_URL},
k AS (SELECT *, CASE WHEN result_type = 'WEBSITE' THEN 'WEBSITE|' || domain ELSE result_type || '|' || normalized_url END AS group_key,
        CASE WHEN result_type = 'WEBSITE' THEN useful ELSE 0 END AS sc, CASE WHEN result_type = 'WEBSITE' THEN length(url) ELSE 0 END AS ln FROM c WHERE domain <> ''),
w AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY sc DESC, ln, page_id) AS rn, min(page_id) OVER (PARTITION BY group_key) AS first_seq, count(*) OVER (PARTITION BY group_key) AS n_hits FROM k)"""


@query("candidate_dedupe", f"{SQL_DEDUPE} SELECT group_key, result_type, page_id AS seq, url, normalized_url, first_seq, n_hits FROM w WHERE rn = 1")
def candidate_dedupe(spark, sf):
    return candidates.dedupe(candidates.candidates_from_hits(hits(spark, sf))).select("group_key", "result_type", "seq", "url", "normalized_url", "first_seq", "n_hits")


@query("candidate_provenance", rf"""{SQL_DEDUPE}, f AS (SELECT group_key, 'q' || page_id % 7 AS query, min(page_id) AS s FROM k GROUP BY ALL)
SELECT group_key, string_agg(query, ',' ORDER BY s) AS discovered_by, count(*) AS n_queries FROM f GROUP BY group_key""")
def candidate_provenance(spark, sf):
    d = candidates.dedupe(candidates.candidates_from_hits(hits(spark, sf)))
    return d.select("group_key", F.array_join("discovered_by_queries", ",").alias("discovered_by"), F.size("discovered_by_queries").cast("long").alias("n_queries"))


@query("candidate_merge_runs", f"{SQL_DEDUPE} SELECT group_key, url, n_hits FROM w WHERE rn = 1")
def candidate_merge_runs(spark, sf):
    c = candidates.candidates_from_hits(hits(spark, sf))
    half = c.agg(F.max("seq")).first()[0] // 2
    return candidates.merge(c.where(F.col("seq") <= half), c.where(F.col("seq") > half).withColumn("seq", F.col("seq") - half - 1)).select("group_key", "url", "n_hits")


# --- pages --------------------------------------------------------------------

_DECODE = "replace(replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def sql_strip(x: str) -> str:
    return "trim(regexp_replace(" + _DECODE.format(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


@query("page_title", f"SELECT page_id, nullif({sql_strip('regexp_extract(html, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1)')}, '') AS title FROM pages")
def page_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("page_headings", f"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda x: {sql_strip('x')}), lambda x: x <> '')[1:40], '|') AS headings FROM pages""")
def page_headings(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(html.headings(F.col("html")), "|").alias("headings"))


@query("page_links", """
WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']', 1), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(mailto|tel|javascript|#)')) AS h FROM pages),
e AS (SELECT page_id, unnest(h) AS link, generate_subscripts(h, 1) AS pos FROM l),
d AS (SELECT page_id, link, min(pos) AS pos FROM e GROUP BY ALL)
SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS position FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 200""".replace("\\\\", "\\"))
def page_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("position", "link")).select("page_id", "link", "position")


_BARE = r"regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "noscript", "svg", "template", "iframe", "nav"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"


@query("page_text", f"SELECT page_id, left({sql_strip(_BARE)}, 50000) AS text FROM pages")
def page_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


def sql_names(rows: str, raw: str = "raw") -> str:
    """CTE ``named``: the rows of a CTE with the business name in a raw title under ``name``."""
    fixed = in_list(sorted({*rules.GENERIC_NAMES, *rules.CATEGORY_NAMES, *rules.NAVIGATION_NAMES}))

    def bad(e: str) -> str:
        low = f"regexp_replace(lower(trim({e})), '[!.]+$', '')"
        tests = [f"{low} IN {fixed}", *(f"regexp_matches({low}, {q(p)})" for p in (rules.CHROME_NAME, rules.ARTICLE_NAME, r"^women'?s fashion$|^women'?s\s+[\w\s-]*clothing\s+online$|^(?:https?://|www\.)")), f"(contains({low}, 'download') AND contains({low}, 'app'))", f"(contains({low}, 'follow') AND contains({low}, 'instagram'))", f"regexp_matches({e}, {q('(?i)' + rules.ROUNDUP_TITLE)})"]
        return "(" + " OR ".join(tests) + ")"

    def fits(e: str) -> str:
        return f"{e} <> '' AND NOT {bad(e)} AND len(string_split({e}, ' ')) <= 6"

    return rf"""
n0 AS (SELECT *, trim(regexp_replace(coalesce({raw}, ''), '\s+', ' ', 'g')) AS x FROM {rows}),
n1 AS (SELECT *, trim(regexp_replace(x, '\s*[-–—|].*$', '')) AS lft FROM n0),
n2 AS (SELECT *, trim(regexp_replace(CASE WHEN {fits('lft')} THEN lft ELSE x END, '\s*[(\[]@[^)\]]+[)\]]', '', 'g')) AS y FROM n1),
n3 AS (SELECT *, trim(regexp_replace(y, '(?i)\s+(?:women''?s|ladies|fashion|clothing)\s+boutique$', '')) AS short FROM n2),
n4 AS (SELECT *, CASE WHEN {fits('short')} THEN short ELSE y END AS z FROM n3),
named AS (SELECT *, CASE WHEN x = '' OR {bad('x')} OR {bad('z')} OR length(z) NOT BETWEEN 2 AND 80 OR len(string_split(z, ' ')) > 8 THEN 'UNKNOWN' ELSE z END AS name FROM n4)"""


SQL_TITLE = f"nullif({sql_strip('regexp_extract(html, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1)')}, '')"
#: What stands around a page's title in turn, so that each rule for names has its cases.
AROUND = (("", ""), ("", " | Women's Fashion"), ("Home - ", ""), ("10 best boutiques in ", ""), ("", " (@shop.one)"), ("", " ladies boutique"), ("Your Bag: ", ""))


@query("page_names", f"""WITH r AS (SELECT page_id, {SQL_TITLE} AS raw FROM pages), {sql_names('r')} SELECT page_id, name FROM named""")
def page_names(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.clean_name(html.title(F.col("html"))).alias("name"))


@query("framed_names", f"""WITH r AS (SELECT page_id, [{', '.join(q(a) for a, _ in AROUND)}][CAST(page_id % {len(AROUND)} AS INTEGER) + 1] || substr({SQL_TITLE}, 1, CAST(5 + page_id % 40 AS INTEGER)) || [{', '.join(q(b) for _, b in AROUND)}][CAST(page_id % {len(AROUND)} AS INTEGER) + 1] AS raw FROM pages), {sql_names('r')} SELECT page_id, name FROM named""")
def framed_names(spark, sf):
    """Titles, cut and framed by what names must lose or not have."""
    p, i = read(spark, sf, "pages"), F.col("page_id")
    before, after = (F.element_at(F.array(*[F.lit(x[k]) for x in AROUND]), (i % len(AROUND) + 1).cast("int")) for k in (0, 1))
    title = F.substring(html.title(F.col("html")), F.lit(1), (i % 40 + 5).cast("int"))
    return p.select("page_id", text.clean_name(F.concat(before, title, after)).alias("name"))


# --- contact signals ----------------------------------------------------------


@query("extract_emails", rf"""
WITH e AS (SELECT doc_id, list_transform(regexp_extract_all(text, {q(rules.EMAIL)}), lambda x: lower(x)) AS emails FROM documents)
SELECT doc_id, array_to_string(emails, ';') AS emails FROM e WHERE len(emails) > 0""")
def extract_emails(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", text.emails(F.col("text")).alias("emails"))
    return d.where(F.size("emails") > 0).select("doc_id", F.array_join("emails", ";").alias("emails"))


@query("extract_phones", rf"""
WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, {q(rules.PHONE)}), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS raw FROM documents),
f AS (SELECT doc_id, list_filter(raw, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15
        AND NOT (len(regexp_extract_all(x, '[0-9]+')) >= 5 AND len(list_filter(regexp_extract_all(x, '[0-9]+'), lambda g: length(g) > 2)) = 0)) AS phones FROM p)
SELECT doc_id, array_to_string(phones, ';') AS phones FROM f WHERE len(phones) > 0""")
def extract_phones(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", text.phones(F.col("text")).alias("phones"))
    return d.where(F.size("phones") > 0).select("doc_id", F.array_join("phones", ";").alias("phones"))


@query("address_candidates", rf"""
WITH c AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS pieces FROM documents),
f AS (SELECT doc_id, list_filter(pieces, lambda x: length(x) BETWEEN 12 AND 180 AND NOT regexp_matches(x, {q(rules.PRICE_NOISE)})
   AND (regexp_matches(x, {q(f'(^|{EDGE}){rules.PIN_CODE}({EDGE}|$)')}) OR (regexp_matches(x, {q(text.any_word(rules.ADDRESS_WORDS))}) AND regexp_matches(x, '[0-9]'))))[1:30] AS found FROM c)
SELECT doc_id, array_to_string(found, ' | ') AS addresses FROM f WHERE len(found) > 0""")
def address_candidates(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", text.addresses(F.col("text")).alias("found"))
    return d.where(F.size("found") > 0).select("doc_id", F.array_join("found", " | ").alias("addresses"))


COMMON = ("the", "que", "und", "para", "la")


@query("term_mentions", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q(text.whole_word(t))}) THEN '{t}' END" for t in COMMON) + "], lambda x: x IS NOT NULL), ',') AS terms FROM documents")
def term_mentions(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.mentions(F.col("text"), COMMON), ",").alias("terms"))


@query("mentions_numbered", r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '([0-9]{1,3})[.)] ?([A-Z][a-z]+)', 1) AS n, regexp_extract_all(text, '([0-9]{1,3})[.)] ?([A-Z][a-z]+)', 2) AS w FROM documents)
SELECT doc_id, CAST(unnest(n) AS INTEGER) AS number, unnest(w) AS name FROM m""")
def mentions_numbered(spark, sf):
    p = F.lit(r"([0-9]{1,3})[.)] ?([A-Z][a-z]+)")
    d = read(spark, sf, "documents").select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", p, 1).alias("n"), F.regexp_extract_all("text", p, 2).alias("w"))).alias("m"))
    return d.select("doc_id", F.col("m.n").cast("int").alias("number"), F.col("m.w").alias("name"))


# --- scores and decisions -----------------------------------------------------

DEMO_SIGNALS = ((text.whole_word("the"), 2, "article"), (text.whole_word("that"), 3, "pointer"), (text.whole_word("und"), 4, "joiner"), (text.whole_word("que"), 1, "pointer"), ("[0-9]{4}", 5, "number"))


def sql_points(signals, x="text") -> str:
    return " + ".join(f"CASE WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN {n} ELSE 0 END" for p, n, _ in signals)


@query("signal_score", f"SELECT doc_id, CAST({sql_points(DEMO_SIGNALS)} AS INTEGER) AS score FROM documents")
def signal_score(spark, sf):
    return read(spark, sf, "documents").select("doc_id", score.points(F.col("text"), DEMO_SIGNALS).alias("score"))


def fit_rows(spark, sf) -> DataFrame:
    """Documents as profiles: every third has a name, every fourth an address, every fifth a phone."""
    d = read(spark, sf, "documents")
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    return d.select(
        "doc_id", "text", F.when(i % 3 == 0, F.concat(F.lit("Shop "), i.cast("string"))).alias("business_name"), F.when(i % 2 == 0, "Designer boutique, curated store, womens fashion, independent designers").alias("city"),
        F.when(i % 4 == 0, "12 Market Road").alias("address"), none.alias("website"), none.alias("instagram"), none.alias("facebook"), F.when(i % 5 == 0, "9876543210").alias("phone"),
        F.when(i % 7 == 0, "YES").alias("physical_store"), F.when(i % 11 == 0, "ARTICLE").alias("relationship"), F.when(i % 13 == 0, "NO").otherwise("UNKNOWN").alias("geography"),
    )


def _sql_fit() -> str:
    labels = ", ".join(f"CASE WHEN regexp_matches(blob, {q('(?i)' + p)}) THEN {q(label)} END" for p, label in rules.EXCLUSION_SIGNALS)
    models = " ".join(f"WHEN regexp_matches(blob, {q('(?i)' + p)}) THEN {q(label)}" for p, label in rules.RETAIL_MODELS)
    return rf"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'Shop ' || doc_id END AS name, CASE WHEN doc_id % 2 = 0 THEN 'Designer boutique, curated store, womens fashion, independent designers' END AS city,
  CASE WHEN doc_id % 4 = 0 THEN '12 Market Road' END AS address, CASE WHEN doc_id % 5 = 0 THEN '9876543210' END AS phone, doc_id % 7 = 0 AS stated,
  CASE WHEN doc_id % 11 = 0 THEN 'ARTICLE' END AS rel, CASE WHEN doc_id % 13 = 0 THEN 'NO' ELSE 'UNKNOWN' END AS geo FROM documents),
b AS (SELECT *, concat_ws(' ', name, address, city, nullif(text, '')) AS blob FROM d),
s AS (SELECT *, list_filter([{labels}], lambda x: x IS NOT NULL) AS ex,
  {sql_points(rules.PHYSICAL_SIGNALS, 'blob')} + CASE WHEN address IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN stated THEN 4 ELSE 0 END AS ps,
  {sql_points(rules.FASHION_SIGNALS, 'blob')} AS fs, {sql_points(rules.MULTI_BRAND_SIGNALS, 'blob')} AS ms, {sql_points(rules.CONCEPT_SIGNALS, 'blob')} AS cs, {sql_points(rules.FIT_SIGNALS, 'blob')} AS ft FROM b),
f AS (SELECT *, CASE WHEN list_contains(ex, 'online-only') THEN 'NO' WHEN ps >= 4 THEN 'YES' ELSE 'UNKNOWN' END AS physical,
  CASE WHEN fs >= 4 THEN 'HIGH' WHEN fs >= 2 THEN 'MEDIUM' WHEN fs > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS fashion,
  CASE WHEN list_contains(ex, 'own-brand-only') THEN 'NO' WHEN ms >= 4 OR cs >= 3 THEN 'YES' ELSE 'UNKNOWN' END AS multi,
  CASE WHEN list_has_any(ex, ['unrelated', 'mass-market', 'wholesale-only']) THEN 'LOW' WHEN ft >= 6 THEN 'HIGH' WHEN ft >= 3 THEN 'MEDIUM' WHEN ft > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS fit,
  CASE {models} WHEN ms >= 4 THEN 'multi-brand' WHEN cs >= 3 THEN 'concept store' ELSE 'unknown' END AS model FROM s)
SELECT doc_id, CAST(ps AS INTEGER) AS physical_score, CAST(fs AS INTEGER) AS fashion_score, CAST(ms AS INTEGER) AS multi_score, CAST(ft AS INTEGER) AS fit_score, physical, fashion, multi AS multi_brand, fit, model AS retail_model,
  CASE WHEN (rel = 'ARTICLE' AND name IS NULL) OR geo = 'NO' OR len(ex) > 0 THEN 'EXCLUDED'
    WHEN physical = 'YES' AND fashion = 'HIGH' AND fit = 'HIGH' AND (multi = 'YES' OR cs >= 3) THEN 'LEAD'
    WHEN (physical = 'YES' AND fashion IN ('HIGH', 'MEDIUM') AND fit IN ('HIGH', 'MEDIUM')) OR name IS NOT NULL THEN 'REVIEW' ELSE 'EXCLUDED' END AS status
FROM f"""


@query("fit_decision", _sql_fit())
def fit_decision(spark, sf):
    out = score.assess_fit(fit_rows(spark, sf))
    return out.select("doc_id", "physical_score", "fashion_score", "multi_score", "fit_score", "physical", "fashion", "multi_brand", "fit", "retail_model", "status")


@query("fit_explained")
def fit_explained(spark, sf):
    out = score.assess_fit(fit_rows(spark, sf))
    return out.select("doc_id", "status", "reason", score.explain(out).alias("explanation"))


@query("weighted_score", """SELECT l_orderkey, l_linenumber, 2.0 * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.0 ELSE 0.5 END + 3.0 * CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 0.0 END AS weighted FROM lineitem""")
def weighted_score(spark, sf):
    li = read(spark, sf, "lineitem")
    tri = li.withColumns({"a": F.when(F.col("l_returnflag") == "A", "YES").when(F.col("l_returnflag") == "R", "NO").otherwise("UNKNOWN"), "b": F.when(F.col("l_linestatus") == "F", "YES").otherwise("NO")})
    return tri.select("l_orderkey", "l_linenumber", score.weighted_score(tri, {"a": 2.0, "b": 3.0}).alias("weighted"))


# --- places and queries -------------------------------------------------------

TERMS = (("Alpha", "the"), ("Alpha", "of the"), ("Beta", "que"), ("Beta", "de la"), ("Gamma", "und"), ("Gamma", "der die"), ("Delta", "para"))


@query("term_match_geo", "WITH t(city, term) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in TERMS) + rf") SELECT doc_id, city, term FROM documents JOIN t ON regexp_matches(lower(text), '(^|{EDGE})' || replace(term, ' ', '{EDGE}+') || '({EDGE}|$)')")
def term_match_geo(spark, sf):
    t = spark.createDataFrame(list(TERMS), "city string, term string")
    return geo.term_hits(read(spark, sf, "documents"), t, "doc_id", "text").select("doc_id", "city", "term")


def areas(spark, sf) -> DataFrame:
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    none = F.array().cast("array<string>")
    country = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("name"), F.lit("country").alias("type"), F.col("r_name").alias("country"), none.alias("neighbourhoods"))
    city = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("name"), F.lit("city").alias("type"), F.col("r_name").alias("country"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat("n_name", F.lit(" North")), F.concat("n_name", F.lit(" South")))).otherwise(none).alias("neighbourhoods"),
    )
    return country.unionByName(city)


@query("place_expand", """
SELECT 'r' || r_regionkey AS key, coalesce(n_name, r_name) AS area, CASE WHEN n_name IS NULL THEN 'country' ELSE 'city' END AS area_type FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT 'n' || n_nationkey, n_name, 'city' FROM nation WHERE n_nationkey % 2 = 1
UNION ALL SELECT 'n' || n_nationkey, n_name || s, 'neighbourhood' FROM nation, (VALUES (' North'), (' South')) AS v(s) WHERE n_nationkey % 2 = 0""")
def place_expand(spark, sf):
    return geo.expand(areas(spark, sf))


@query("place_find", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN n_name END AS place FROM customer JOIN nation ON n_nationkey = c_nationkey")
def place_find(spark, sf):
    n = read(spark, sf, "nation")
    known = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("city"), F.array(F.concat(F.lit("the "), F.lower("n_name"))).alias("aliases"))
    c = read(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), F.upper("n_name"))).otherwise(F.concat(F.lit("THE  "), F.col("n_name"))).alias("name"))
    return geo.find_places(asked, known).select("c_custkey", "place")


_T = [(f, i, t, j) for i, f in enumerate(places.PRODUCTION_FAMILIES) for j, t in enumerate(places.FAMILIES[f])]
_L = [(p[0], i, loc) for p in places.PLACES for i, loc in enumerate(x for x in dict.fromkeys([*p[3], *p[4]]) if x != p[0].lower())]


@query("query_generation", f"""
WITH t(family, fo, template, o) AS (VALUES {', '.join(f'({q(a)}, {b}, {q(c)}, {d})' for a, b, c, d in _T)}),
p(city) AS (VALUES {', '.join(f'({q(x[0])})' for x in places.PLACES)}),
l(city, i, loc) AS (VALUES {', '.join(f'({q(a)}, {b}, {q(c)})' for a, b, c in _L)}),
n AS (SELECT fo, count(*) AS c FROM t GROUP BY fo),
a AS (
  SELECT city, 0 AS kind, fo * 1000 + o AS ord, family, template || ' ' || city AS query FROM p, t
  UNION ALL SELECT l.city, 1, i, t.family, t.template || ' ' || array_to_string(list_transform(string_split(loc, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
  FROM l JOIN n ON n.fo = i % 3 JOIN t ON t.fo = n.fo AND t.o = (i // 3) % n.c),
d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY city, kind, lower(query) ORDER BY ord) = 1)
SELECT city, CAST(row_number() OVER (PARTITION BY city ORDER BY kind, ord) AS INTEGER) AS position, family, query FROM d
QUALIFY row_number() OVER (PARTITION BY city ORDER BY kind, ord) <= {places.MAX_QUERIES}""")
def query_generation(spark, sf):
    return queries.generate(places.places(spark), places.templates(spark)).select("city", "position", "family", "query")


def sql_templates(families, per_family: int | None = None) -> str:
    return ", ".join(f"({q(f)}, {i}, {q(t)}, {j})" for i, f in enumerate(families) for j, t in enumerate(places.FAMILIES[f][:per_family]))


SQL_NATION_PLACES = """c AS (SELECT nation_id, lower(trim(city)) AS loc, min(client_id) AS first FROM clients WHERE trim(city) <> '' GROUP BY ALL),
l AS (SELECT nation_id, loc, row_number() OVER (PARTITION BY nation_id ORDER BY first, loc) - 1 AS i FROM c), p AS (SELECT n_nationkey, n_name AS city FROM nation)"""


def nation_places(spark, sf) -> DataFrame:
    """Nations as places, with the first ten cities of their clients as localities."""
    c = read(spark, sf, "clients").select("nation_id", F.lower(F.btrim("city")).alias("loc"), "client_id").where("loc <> ''")
    first = ordered.top_k(c.groupBy("nation_id", "loc").agg(F.min("client_id").alias("first")), ["nation_id"], ["first", "loc"], 10)
    near = first.groupBy("nation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "loc"))), lambda x: x["loc"]).alias("localities"))
    n = read(spark, sf, "nation").join(near, F.col("n_nationkey") == F.col("nation_id"), "left")
    none = F.array().cast("array<string>")
    return n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("city"), F.col("n_name").alias("state"), F.lit("World").alias("country"), none.alias("aliases"), F.coalesce("localities", none).alias("localities"))


@query("query_sampling", f"""
WITH t(family, fo, template, o) AS (VALUES {sql_templates(places.SAMPLED_FAMILIES)}), {SQL_NATION_PLACES}, n AS (SELECT fo, count(*) AS c FROM t GROUP BY fo),
a AS (SELECT city, 0 AS kind, fo * 1000 + o AS ord, family, city AS location, template || ' ' || city AS query FROM p, t
  UNION ALL SELECT city, 1, i, t.family, upper(loc[1]) || loc[2:], t.template || ' ' || upper(loc[1]) || loc[2:] FROM l JOIN p ON p.n_nationkey = l.nation_id JOIN n ON n.fo = i % 2 JOIN t ON t.fo = n.fo AND t.o = (i // 2) % n.c WHERE i < {places.SAMPLED_LOCALITIES})
SELECT query, 3 AS "limit", family, location, city, city AS state, 'World' AS country, CAST(row_number() OVER (PARTITION BY city ORDER BY kind, ord) AS INTEGER) AS position FROM a QUALIFY position <= {places.MAX_QUERIES}""")
def query_sampling(spark, sf):
    """The sampled mode over nations, as a batch takes it."""
    known = nation_places(spark, sf)
    return queries.specs(queries.sampled(known), known, 3)


@query("query_multi_city", f"""
WITH t(family, fo, template, o) AS (VALUES {sql_templates(places.FAMILIES, 2)}), b AS (SELECT n_nationkey, n_name AS city, count(client_id) AS n FROM nation LEFT JOIN clients ON nation_id = n_nationkey GROUP BY ALL ORDER BY n DESC, n_nationkey LIMIT 5)
SELECT city, family, template || ' ' || city AS query, CAST(row_number() OVER (ORDER BY n DESC, n_nationkey, fo, o) AS INTEGER) AS batch_position FROM b, t""")
def query_multi_city(spark, sf):
    """Two templates of every family for the five nations with most clients, in turn."""
    n = read(spark, sf, "nation").join(read(spark, sf, "clients").groupBy("nation_id").agg(F.count("client_id").alias("n")), F.col("n_nationkey") == F.col("nation_id"), "left")
    most = [r.n_name for r in n.orderBy(F.coalesce("n", F.lit(0)).desc(), "n_nationkey").limit(5).collect()]  # five names
    return queries.multi_city(nation_places(spark, sf), most, 2).select("city", "family", "query", "batch_position")


@query("shared_states", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 1")
def shared_states(spark, sf):
    return read(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("uncovered_terms", "WITH t(city, term) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in (*TERMS, ("Delta", "zzz yyy"))) + rf") SELECT city, term FROM t WHERE NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(lower(text), '(^|{EDGE})' || replace(term, ' ', '{EDGE}+') || '({EDGE}|$)'))")
def uncovered_terms(spark, sf):
    rows = [("Alpha", ["the", "of the"]), ("Beta", ["que", "de la"]), ("Gamma", ["und", "der die"]), ("Delta", ["para", "zzz yyy"])]
    return geo.uncovered(spark.createDataFrame(rows, "city string, localities array<string>"), read(spark, sf, "documents"), "doc_id", "text")


# --- identity and merges ------------------------------------------------------


def party_keys(prefix: str) -> dict:
    return {"segment": F.when(F.col(f"{prefix}nationkey") % 4 == 0, F.concat_ws("|", F.col(f"{prefix}nationkey").cast("string"), F.floor(F.col(f"{prefix}acctbal") / 100).cast("string"))), "digits": urls.key_phone(F.substring(F.col(f"{prefix}name"), -3, 3))}


@query("identity_keys", """SELECT c_custkey, 'segment' AS kind, c_nationkey || '|' || CAST(floor(c_acctbal / 100) AS BIGINT) AS key FROM customer WHERE c_nationkey % 4 = 0
UNION ALL SELECT c_custkey, 'digits', regexp_replace(right(c_name, 3), '[^0-9]', '', 'g') FROM customer WHERE regexp_replace(right(c_name, 3), '[^0-9]', '', 'g') <> ''""")
def identity_keys(spark, sf):
    return resolve.keyed(read(spark, sf, "customer"), "c_custkey", party_keys("c_"))


@query("known_anti_join", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE
  (c_nationkey % 4 = 0 AND s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100)) OR (right(s_name, 3) = right(c_name, 3)))""")
def known_anti_join(spark, sf):
    c = read(spark, sf, "customer")
    known = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_name").alias("c_name"), F.col("s_suppkey").alias("c_custkey"))
    return resolve.new_records(c.select("c_custkey", "c_nationkey", "c_acctbal", "c_name"), known, "c_custkey", party_keys("c_")).select("c_custkey")


def page_records(spark, sf) -> DataFrame:
    p = read(spark, sf, "pages")
    i = F.col("page_id")
    none = F.lit(None).cast("string")
    return p.select(
        i.alias("seq"), F.when(i % 3 != 0, F.col("url")).alias("website"), F.when(i % 10 == 0, F.concat(F.lit("@shop"), (i % 40).cast("string"))).alias("instagram"), none.alias("facebook"), none.alias("whatsapp"),
        F.when(i % 9 == 0, F.concat(F.lit("+91 900000"), F.lpad((i % 45).cast("string"), 4, "0"))).alias("phone"), F.when(i % 8 == 0, F.concat(F.lit("m"), i.cast("string"), F.lit("@x.org"))).alias("email"), none.alias("address"),
        F.when(i % 2 == 0, "Goa").otherwise("UNKNOWN").alias("city"), F.concat(F.lit("Shop "), (i % 60).cast("string")).alias("business_name"), F.col("url").alias("source_url"),
        F.when(i % 5 == 0, "HIGH").when(i % 5 == 1, "MEDIUM").otherwise("LOW").alias("confidence"), F.when(i % 6 == 0, "YES").otherwise("UNKNOWN").alias("physical_store"), F.array(F.concat(F.lit("q"), (i % 7).cast("string"))).alias("discovered_by_queries"),
    )


SQL_RECORDS = rf"""WITH {SQL_URL},
r AS (SELECT page_id AS seq, CASE WHEN page_id % 3 <> 0 THEN url END AS website, CASE WHEN page_id % 3 <> 0 THEN domain END AS site, CASE WHEN page_id % 10 = 0 THEN 'shop' || page_id % 40 END AS account,
  CASE WHEN page_id % 9 = 0 THEN '+91 900000' || lpad(CAST(page_id % 45 AS VARCHAR), 4, '0') END AS phone, CASE WHEN page_id % 2 = 0 THEN 'Goa' END AS city, 'Shop ' || page_id % 60 AS name, url,
  CASE WHEN page_id % 5 = 0 THEN 'HIGH' WHEN page_id % 5 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN page_id % 6 = 0 THEN 'YES' END AS store, 'q' || page_id % 7 AS query FROM m)"""
_KEYS = """k AS (SELECT seq, 'website' AS kind, site AS key FROM r WHERE site IS NOT NULL UNION ALL SELECT seq, 'instagram', account FROM r WHERE account IS NOT NULL
  UNION ALL SELECT seq, 'phone', regexp_replace(phone, '[^0-9]', '', 'g') FROM r WHERE phone IS NOT NULL UNION ALL SELECT seq, 'name_city', lower(name) || '|goa' FROM r WHERE city IS NOT NULL)"""


@query("record_merge", rf"""{SQL_RECORDS},
g AS (SELECT *, coalesce('website:' || site, 'instagram:' || account, 'phone:' || regexp_replace(phone, '[^0-9]', '', 'g'), CASE WHEN city IS NOT NULL THEN 'name_city:' || lower(name) || '|goa' END, 'row:' || seq) AS merge_key FROM r),
ua AS (SELECT merge_key, url, min(seq) AS s FROM g GROUP BY ALL), uu AS (SELECT merge_key, string_agg(url, ' ' ORDER BY s) AS merged FROM ua GROUP BY 1)
SELECT merge_key, min(seq) AS seq, count(*) AS n_merged, arg_min(website, seq) FILTER (WHERE website IS NOT NULL) AS website, arg_min(phone, seq) FILTER (WHERE phone IS NOT NULL) AS phone,
  coalesce(max(city), 'UNKNOWN') AS city, arg_min(name, seq) AS business_name, arg_min(confidence, CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS confidence, coalesce(max(store), 'UNKNOWN') AS physical_store, any_value(merged) AS merged_source_urls
FROM g JOIN uu USING (merge_key) GROUP BY merge_key""")
def record_merge(spark, sf):
    m = resolve.merge_by_first_key(page_records(spark, sf))
    return m.select("merge_key", "seq", "n_merged", "website", "phone", "city", "business_name", "confidence", "physical_store", F.array_join("merged_source_urls", " ").alias("merged_source_urls"))


@query("key_claims", rf"""{SQL_RECORDS}, {_KEYS}, f AS (SELECT *, min(seq) OVER (PARTITION BY kind, key) AS first FROM k)
SELECT f.seq AS id, f.first FROM f JOIN r AS a ON a.seq = f.seq JOIN r AS b ON b.seq = f.first
WHERE f.seq <> f.first AND NOT (kind = 'name_city' AND (coalesce(a.site <> b.site, false) OR coalesce(a.account <> b.account, false)))""")
def key_claims(spark, sf):
    return resolve.claims(page_records(spark, sf))[0]


@query("ambiguous_pairs", rf"""{SQL_RECORDS}, {_KEYS}, f AS (SELECT *, min(seq) OVER (PARTITION BY kind, key) AS first FROM k)
SELECT kind, f.key, f.first AS left_id, f.seq AS right_id FROM f JOIN r AS a ON a.seq = f.seq JOIN r AS b ON b.seq = f.first
WHERE f.seq <> f.first AND kind = 'name_city' AND (coalesce(a.site <> b.site, false) OR coalesce(a.account <> b.account, false))""")
def ambiguous_pairs(spark, sf):
    return resolve.claims(page_records(spark, sf))[1]


@query("connected_records", rf"""WITH RECURSIVE {SQL_RECORDS.removeprefix('WITH ')}, {_KEYS}, f AS (SELECT *, min(seq) OVER (PARTITION BY kind, key) AS first FROM k),
e AS (SELECT f.seq AS a, f.first AS b FROM f JOIN r AS a ON a.seq = f.seq JOIN r AS b ON b.seq = f.first
  WHERE f.seq <> f.first AND NOT (kind = 'name_city' AND (coalesce(a.site <> b.site, false) OR coalesce(a.account <> b.account, false)))),
x(n, c) AS (SELECT seq, seq FROM r UNION SELECT s.y, x.c FROM x JOIN (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e) AS s ON s.x = x.n),
z AS (SELECT n, min(c) AS component FROM x GROUP BY n)
SELECT component, count(*) AS n_merged, min(n) AS seq FROM z GROUP BY component""")
def connected_records(spark, sf):
    return resolve.merge_connected(page_records(spark, sf))[0].select("component", "n_merged", "seq")


@query("name_merge")
def name_merge(spark, sf):
    return resolve.merge_same_name(page_records(spark, sf))


@query("connected_components", """WITH RECURSIVE s AS (SELECT s_suppkey AS n, s_nationkey AS k, CAST(floor(s_acctbal / 50) AS BIGINT) AS v FROM supplier),
e AS (SELECT a.n AS x, b.n AS y FROM s AS a JOIN s AS b ON a.n <> b.n AND (a.v = b.v OR (a.k = b.k AND a.k % 5 = 0))),
r(n, c) AS (SELECT n, n FROM s UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.n)
SELECT n AS node, min(c) AS component FROM r WHERE n IN (SELECT x FROM e) GROUP BY n""")
def connected_components(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), F.array(F.concat(F.lit("v"), F.floor(F.col("s_acctbal") / 50).cast("string")), F.when(F.col("s_nationkey") % 5 == 0, F.concat(F.lit("k"), F.col("s_nationkey").cast("string")))).alias("ks"))
    claimed = s.select("n", F.explode(F.array_compact("ks")).alias("k")).withColumn("first", F.min("n").over(Window.partitionBy("k")))
    return graph.components(claimed.where("n <> first"), "n", "first")


@query("best_fact", """SELECT user_id, max_by(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id""".replace("max_by(event_id, (value, -event_id))", "arg_max(event_id, row(value, -event_id))"))
def best_fact(spark, sf):
    e = read(spark, sf, "events").where("value IS NOT NULL")
    return e.groupBy("user_id").agg(ordered.best(F.col("event_id"), F.col("value"), -F.col("event_id")).alias("event_id"), F.max("value").alias("value"))


# --- ordered folds ------------------------------------------------------------


@query("round_robin", """WITH t AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY turn, o_orderpriority) AS INTEGER) AS position FROM t) SELECT o_orderkey, o_orderpriority, position FROM p WHERE position <= 100""")
def round_robin(spark, sf):
    return ordered.round_robin(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", F.col("o_orderpriority"), 100)


@query("topk_per_key", """SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def topk_per_key(spark, sf):
    return ordered.top_k(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("cap_running", """WITH r AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(running AS BIGINT) AS running FROM r WHERE running <= 80""")
def cap_running(spark, sf):
    li = read(spark, sf, "lineitem")
    kept = ordered.take_while_room(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity").cast("long"), 80)
    return kept.select("l_orderkey", "l_linenumber", "running")


@query("first_claimer", "SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events")
def first_claimer(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", "user_id", F.min("event_id").over(Window.partitionBy("user_id", "event_type")).alias("first_id"))


@query("quota_sample", """WITH t AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events)
SELECT event_id, event_type FROM t ORDER BY CASE WHEN turn > CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 5 ELSE 0 END THEN 1 ELSE 0 END, event_id LIMIT 40""")
def quota_sample(spark, sf):
    return ordered.quota_sample(read(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", {"click": 10, "view": 5}, 40)


# --- budgets ------------------------------------------------------------------


@query("budget_usage", """WITH d AS (SELECT event_type AS provider, CAST(ts AS DATE) AS day, count(*) AS daily_calls FROM events GROUP BY ALL)
SELECT provider, day, daily_calls, daily_calls * 0.25 AS daily_cost, CAST(sum(daily_calls) OVER w AS BIGINT) AS monthly_calls, CAST(sum(daily_calls) OVER w AS BIGINT) * 0.25 AS monthly_cost FROM d WINDOW w AS (PARTITION BY provider, date_trunc('month', day))""".replace("* 0.25", "* 0.25::DOUBLE"))
def budget_usage(spark, sf):
    return budget.usage(read(spark, sf, "events"), "event_type", "ts", F.lit(0.25)).select("provider", "day", "daily_calls", "daily_cost", "monthly_calls", "monthly_cost")


@query("budget_admission", """WITH d AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS dr FROM events),
m AS (SELECT *, sum(CASE WHEN dr <= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, date_trunc('month', ts) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS mr FROM d)
SELECT event_id, dr <= 30 AND mr <= 500 AS admitted FROM m""")
def budget_admission(spark, sf):
    return budget.admit_units(read(spark, sf, "events"), 30, 500, "event_type", "ts", "event_id").select("event_id", "admitted")


@query("budget_replay")
def budget_replay(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("provider"), "ts", (F.col("event_id") % 4).alias("calls"))
    return budget.admit(e, 40, 600).select("seq", "admitted")


# --- overrides, evidence, export ----------------------------------------------


@query("overrides_apply", """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 'LOCKED' END ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN c_custkey % 15 = 0 THEN 7.5 ELSE c_acctbal END AS c_acctbal FROM customer""")
def overrides_apply(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    segment = c.where(k % 10 == 0).select("c_custkey", F.lit("c_mktsegment").alias("field"), F.when(k % 20 != 0, "LOCKED").alias("value"))
    balance = c.where(k % 15 == 0).select("c_custkey", F.lit("c_acctbal").alias("field"), F.lit("7.5").alias("value"))
    unknown = c.where(k % 30 == 0).select("c_custkey", F.lit("no_such_column").alias("field"), F.lit("x").alias("value"))
    return store.apply_overrides(c, segment.unionByName(balance).unionByName(unknown), "c_custkey", ["c_name", "c_mktsegment", "c_acctbal"])


@query("override_latest", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def override_latest(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id")
    return store.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("evidence_list", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS history FROM events GROUP BY user_id")
def evidence_list(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.array_join(ordered.in_order(F.col("event_type"), F.col("event_id")), ",").alias("history"))


@query("constraint_check", """SELECT 'unique(c_name)' AS rule, count(*) AS n FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'domain(c_mktsegment)', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')""")
def constraint_check(spark, sf):
    return store.violations(read(spark, sf, "customer"), [["c_name"]], {"c_mktsegment": ("BUILDING", "AUTOMOBILE")})


@query("orphan_check", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def orphan_check(spark, sf):
    return store.orphans(read(spark, sf, "orders"), read(spark, sf, "customer"), "o_custkey", "c_custkey").select("o_orderkey")


def export_rows(spark, sf) -> DataFrame:
    c = read(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("seq"), F.when(k % 17 != 0, F.col("c_name")).alias("business_name"), F.when(k % 2 == 0, "SELF").when(k % 3 == 0, "MENTIONED_BUSINESS").when(k % 5 == 0, "ARTICLE").otherwise("UNKNOWN").alias("relationship"),
        F.when(k % 4 == 0, "YES").when(k % 4 == 1, "NO").otherwise("UNKNOWN").alias("stockist_lead"), F.lit("YES").alias("is_business"), F.when(k % 6 == 0, "YES").when(k % 19 == 0, "NO").otherwise("UNKNOWN").alias("geography"),
        (k % 23 == 0).alias("own_label"), F.lit(False).alias("listicle"), F.when(k % 8 == 0, "NO").otherwise("UNKNOWN").alias("ai_stockist"), F.lit("UNKNOWN").alias("physical_store"), F.lit(False).alias("online_only"),
        F.lit(False).alias("identity_invalid"), F.lit(False).alias("unrelated"), F.lit(False).alias("ambiguous"), F.lit(False).alias("identity_weak"), F.lit(False).alias("third_party"), (k % 7 != 0).alias("usable_contact"),
        F.lit(False).alias("social_only"), F.lit(False).alias("social_retail"), (k % 9 != 0).alias("retail_evidence"), F.lit(True).alias("stockist_evidence"), F.col("c_mktsegment").alias("website"), F.lit("u").alias("source_url"),
    )


SQL_EXPORT = """WITH e AS (SELECT c_custkey AS k, c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'SELF' WHEN c_custkey % 3 = 0 THEN 'MENTIONED_BUSINESS' WHEN c_custkey % 5 = 0 THEN 'ARTICLE' ELSE 'UNKNOWN' END AS rel,
  CASE WHEN c_custkey % 4 = 0 THEN 'YES' WHEN c_custkey % 4 = 1 THEN 'NO' ELSE 'UNKNOWN' END AS lead, CASE WHEN c_custkey % 6 = 0 THEN 'YES' WHEN c_custkey % 19 = 0 THEN 'NO' ELSE 'UNKNOWN' END AS geo, CASE WHEN c_custkey % 8 = 0 THEN 'NO' ELSE 'UNKNOWN' END AS ai FROM customer),
g AS (SELECT *, CASE WHEN rel = 'ARTICLE' THEN 'article_or_directory_not_business' WHEN geo = 'NO' THEN 'wrong_geography' WHEN k % 23 = 0 THEN 'own_label_not_external_stockist'
  WHEN rel = 'MENTIONED_BUSINESS' AND k % 9 <> 0 AND k % 7 <> 0 THEN 'mentioned_business_not_self' WHEN rel = 'MENTIONED_BUSINESS' THEN 'mentioned_business_needs_verification' WHEN rel <> 'SELF' THEN 'entity_relationship_not_self'
  WHEN lead = 'YES' AND ai = 'NO' THEN 'contradictory_classification' WHEN k % 17 = 0 THEN 'identity_incomplete' WHEN geo = 'UNKNOWN' THEN 'geography_unconfirmed' WHEN k % 7 = 0 THEN 'no_usable_contact_path'
  WHEN k % 9 = 0 THEN 'fashion_retail_evidence_missing' WHEN ai = 'NO' THEN 'potential_stockist_no_without_hard_exclusion' WHEN lead = 'YES' THEN 'consistent_self_business_with_contact_and_retail_evidence'
  ELSE 'plausible_retail_business_with_usable_contact' END AS reason FROM e),
h AS (SELECT *, CASE WHEN reason IN ('article_or_directory_not_business', 'wrong_geography', 'own_label_not_external_stockist') THEN 'EXCLUDED' WHEN reason IN ('consistent_self_business_with_contact_and_retail_evidence', 'plausible_retail_business_with_usable_contact') THEN 'LEAD' ELSE 'REVIEW' END AS grp FROM g)"""


@query("export_group", f"{SQL_EXPORT} SELECT k AS seq, grp AS export_group, reason AS export_reason, grp <> 'EXCLUDED' AS manual_review FROM h")
def export_group(spark, sf):
    return export.decide(export_rows(spark, sf)).select("seq", "export_group", "export_reason", "manual_review")


@query("export_sorted", f"{SQL_EXPORT} SELECT k AS seq, CAST(row_number() OVER (ORDER BY CASE grp WHEN 'LEAD' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END, CASE WHEN k % 17 <> 0 THEN lower(c_name) END NULLS FIRST, c_mktsegment, k) AS BIGINT) AS position FROM h")
def export_sorted(spark, sf):
    """The place of every row in the order of the export, by a range sort."""
    d = export.decide(export_rows(spark, sf)).withColumns({"g": export.group_rank(F.col("export_group")), "name": F.lower("business_name")})
    return ordered.numbered(d.select("seq", "g", "name", "website"), ["g", "name", "website", "seq"]).select("seq", F.col("position").alias("position"))


@query("export_csv_view", f"{SQL_EXPORT} SELECT CAST(k AS VARCHAR) AS seq, CASE WHEN k % 17 <> 0 THEN c_name ELSE '' END AS business_name, CASE WHEN k % 23 = 0 THEN 'TRUE' ELSE 'FALSE' END AS own_label, reason AS export_reason FROM h")
def export_csv_view(spark, sf):
    return export.flat(export.decide(export_rows(spark, sf)).select("seq", "business_name", "own_label", "export_reason"))


@query("export_summary", f"{SQL_EXPORT} SELECT g.grp AS export_group, count(h.k) AS n FROM (VALUES ('LEAD'), ('REVIEW'), ('EXCLUDED')) AS g(grp) LEFT JOIN h ON h.grp = g.grp GROUP BY 1")
def export_summary(spark, sf):
    return export.summary(export.decide(export_rows(spark, sf)))[0]


@query("reason_topn", f"{SQL_EXPORT} SELECT reason AS export_reason, count(*) AS n, min(k) AS first_seen FROM h GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def reason_topn(spark, sf):
    return report.top_reasons(export.decide(export_rows(spark, sf)), "export_reason", "seq", 10)


# --- reports ------------------------------------------------------------------


@query("enum_counts_zero_filled", "SELECT s AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) AS v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def enum_counts_zero_filled(spark, sf):
    counts = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return ordered.fill_members(counts, spark.createDataFrame([("O",), ("F",), ("P",), ("X",)], "o_orderstatus string"), "o_orderstatus", "n")


@query("conditional_funnel", """SELECT l_returnflag, count(*) AS total, count_if(l_quantity > 25) AS large, count_if(l_discount > 0.05) AS discounted, count_if(l_quantity > 25 AND l_discount > 0.05) AS both_ FROM lineitem GROUP BY 1""")
def conditional_funnel(spark, sf):
    large, cheap = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    return report.funnel(read(spark, sf, "lineitem"), {"large": large, "discounted": cheap, "both_": large & cheap}, ["l_returnflag"])


@query("status_pivot", "SELECT o_orderpriority, count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def status_pivot(spark, sf):
    return report.histogram(read(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ("O", "F", "P"))


SQL_COMPARE = """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS p FROM orders WHERE o_orderkey % 9 <> 0),
j AS (SELECT coalesce(a.k, b.k) AS k, a.s AS s1, b.s AS s2, a.p AS p1, b.p AS p2 FROM a FULL JOIN b ON a.k = b.k),
l AS (SELECT k, 'o_orderstatus' AS field, s1 AS x, s2 AS y FROM j UNION ALL SELECT k, 'o_orderpriority', p1, p2 FROM j),
c AS (SELECT k, field, CASE WHEN x IS NULL AND y IS NULL THEN 'absent' WHEN x IS NULL THEN 'gained' WHEN y IS NULL THEN 'lost' WHEN x <> y THEN 'changed' ELSE 'same' END AS change FROM l)"""


def snapshots(spark, sf):
    o, k = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    after = o.where(k % 9 != 0).select("o_orderkey", F.when(k % 7 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return report.compare(o.where(k % 10 != 0), after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("snapshot_compare", f"{SQL_COMPARE} SELECT k AS o_orderkey, field, change FROM c")
def snapshot_compare(spark, sf):
    return snapshots(spark, sf)


@query("field_gains", f"{SQL_COMPARE} SELECT field, count_if(change = 'gained') AS gained, count_if(change = 'lost') AS lost, count_if(change = 'changed') AS changed, count_if(change = 'same') AS same, count_if(change = 'absent') AS absent FROM c GROUP BY field")
def field_gains(spark, sf):
    return report.gains(snapshots(spark, sf))


@query("query_metrics", f"{SQL_DEDUPE} SELECT 'q' || page_id % 7 AS query, count(DISTINCT group_key) AS unique_candidates, count(*) AS hits FROM k GROUP BY 1")
def query_metrics(spark, sf):
    c = candidates.candidates_from_hits(hits(spark, sf))
    found = candidates.dedupe(c).select("group_key", F.explode("discovered_by_queries").alias("query"))
    return found.groupBy("query").agg(F.count(F.lit(1)).alias("unique_candidates")).join(c.groupBy("query").agg(F.count(F.lit(1)).alias("hits")), "query")


@query("suspicious_rows", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 9000 THEN 'high' END, CASE WHEN c_nationkey = 0 THEN 'nation' END) AS flags FROM customer")
def suspicious_rows(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", F.array_join(report.suspicious({"negative": F.col("c_acctbal") < 0, "high": F.col("c_acctbal") > 9000, "nation": F.col("c_nationkey") == 0}), ",").alias("flags"))


@query("text_table", "SELECT rtrim(rpad(CAST(n_nationkey AS VARCHAR), 4, ' ') || '  ' || rpad(n_name, 16, ' ')) AS line FROM nation")
def text_table(spark, sf):
    return report.text_table(read(spark, sf, "nation"), {"n_nationkey": 4, "n_name": 16})


# --- time ---------------------------------------------------------------------


@query("session_runs", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(ts) AS start_ts, max(ts) AS end_ts FROM s GROUP BY user_id, session""")
def session_runs(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 2 HOURS"), 0).otherwise(1))
    s = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("tumbling_usage", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_usage(spark, sf):
    return read(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- relational shapes on the star schema -------------------------------------


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    li = read(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("nation_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
def nation_revenue(spark, sf):
    o = read(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'")
    j = read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("segment_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def segment_rollup(spark, sf):
    return read(spark, sf, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("customers_with_late_orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def customers_with_late_orders(spark, sf):
    c, o = read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return c.join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


# --- pages to businesses ------------------------------------------------------


_SHOWN = _BARE.replace("regexp_replace(html,", "regexp_replace(regexp_replace(html, '(?is)<title[^>]*>.*?</title>', '', 'g'),")


@query("page_evidence", f"""
WITH l AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*href=["'']([^"'']*)["'']', 1), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(mailto|tel|javascript|#)'))) AS h FROM pages)
SELECT url, nullif({sql_strip('regexp_extract(html, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1)')}, '') AS title, CAST(least(len(h), 200) AS INTEGER) AS n_links,
  array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda x: {sql_strip('x')}), lambda x: x <> '')[1:40], '|') AS headings, CAST(least(length({sql_strip(_SHOWN)}), 50000) AS INTEGER) AS n_text
FROM pages JOIN l USING (page_id)""".replace("\\\\", "\\"))
def page_evidence(spark, sf):
    e = page_source.page_evidence(read(spark, sf, "pages"))
    return e.select("url", "title", F.size("links").alias("n_links"), F.array_join("headings", "|").alias("headings"), F.length("text").alias("n_text"))


@query("page_roles", f"""WITH {SQL_URL} SELECT page_id, CASE WHEN regexp_replace(path, '/', '', 'g') IN ('', 'index', 'index.html', 'home') THEN 'homepage' ELSE 'other' END AS role FROM u""")
def page_roles(spark, sf):
    p = read(spark, sf, "pages")
    return p.select("page_id", enrich.page_role(F.col("url"), F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/"))).alias("role"))


def sql_distinct(x: str) -> str:
    """The first spelling of each value in any case, in order, 30 at most."""
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)[1:30]"


@query("business_signals", rf"""
WITH a AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, {q(rules.EMAIL)}), lambda x: lower(x)) AS emails, list_transform(regexp_extract_all(text, {q(rules.PHONE)}), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS raw,
    list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS pieces FROM documents),
b AS (SELECT *, list_filter(raw, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND NOT (len(regexp_extract_all(x, '[0-9]+')) >= 5 AND len(list_filter(regexp_extract_all(x, '[0-9]+'), lambda g: length(g) > 2)) = 0)) AS phones,
    list_filter(pieces, lambda x: length(x) BETWEEN 12 AND 180 AND NOT regexp_matches(x, {q(rules.PRICE_NOISE)})
      AND (regexp_matches(x, {q(f'(^|{EDGE}){rules.PIN_CODE}({EDGE}|$)')}) OR (regexp_matches(x, {q(text.any_word(rules.ADDRESS_WORDS))}) AND regexp_matches(x, '[0-9]'))))[1:30] AS found FROM a)
SELECT doc_id, array_to_string({sql_distinct('emails')}, ';') AS emails, array_to_string({sql_distinct('phones')}, ';') AS phones, CASE WHEN text IS NOT NULL THEN '' END AS social_urls, CASE WHEN text IS NOT NULL THEN '' END AS whatsapp_urls,
  array_to_string({sql_distinct('found')}, ';') AS address_candidates, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, {q(text.whole_word(t))}) THEN {q(t)} END" for t in rules.CITY_NAMES)}], lambda x: x IS NOT NULL), ';') AS city_mentions FROM b""")
def business_signals(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", F.array().cast("array<struct<url:string>>").alias("links"))
    s = signals.business_signals(d)
    return s.select("doc_id", *[F.array_join(c, ";").alias(c) for c in ("emails", "phones", "social_urls", "whatsapp_urls", "address_candidates", "city_mentions")])


@query("identified_businesses", f"""WITH p AS (SELECT min(page_id) OVER (PARTITION BY url) AS seq, url, {SQL_TITLE} AS title, list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda x: {sql_strip('x')}), lambda x: x <> '')[1] AS heading, row_number() OVER () AS row FROM pages),
r AS (SELECT seq, url, row, 0 AS ord, title AS raw FROM p UNION ALL SELECT seq, url, row, 1, heading FROM p), {sql_names('r')}
SELECT any_value(seq) AS seq, coalesce(arg_min(name, ord) FILTER (WHERE name <> 'UNKNOWN'), 'UNKNOWN') AS business_name, any_value(url) AS website, 'WEBSITE' AS source_type, 'site_owner' AS name_source FROM named GROUP BY row""")
def identified_businesses(spark, sf):
    evidence = page_source.page_evidence(read(spark, sf, "pages"), whole=True).drop("text", "facts")
    p = evidence.join(read(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")), "url")
    rows = graph.written(p.withColumns({"seq": F.col("page_id"), "result_type": urls.classify(F.col("url"))}))  # each kind of page reads them, none parses, joins or classifies again
    return identify.identify(rows).select("seq", "business_name", "website", "source_type", "name_source")


NAME_SOURCES = ("og_site_name", "search_title", "homepage_h1", "page_title")


@query("choose_name", "WITH c AS (SELECT user_id, event_id, 'N' || event_id AS name, CASE event_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 20 WHEN 2 THEN 60 ELSE 48 END AS rank FROM events) SELECT user_id, name FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, event_id) = 1")
def choose_name(spark, sf):
    i = F.col("event_id") % 4
    source = F.element_at(F.array(*map(F.lit, NAME_SOURCES)), (i + 1).cast("int"))
    c = read(spark, sf, "events").select("user_id", F.concat(F.lit("N"), F.col("event_id").cast("string")).alias("name"), source.alias("source"), F.col("event_id").alias("ord"))
    ranked = c.withColumns({"rank": F.coalesce(*[F.when(F.col("source") == s, r) for s, r, _ in signals.NAME_RANKS]), "confidence": F.coalesce(*[F.when(F.col("source") == s, k) for s, _, k in signals.NAME_RANKS])})
    return signals.choose_name(ranked, "user_id").select("user_id", "name")


@query("keyword_windows")
def keyword_windows(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", signals.keyword_windows(F.col("text"), r"\bthat\b").alias("excerpt"))


def lead_rows(spark, sf) -> DataFrame:
    c = read(spark, sf, "customer")
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    return c.select(
        k.alias("seq"), F.when(k % 3 == 0, "a designer boutique").when(k % 3 == 1, "a wholesaler").otherwise("plain").alias("text"), F.when(k % 5 != 0, F.col("c_name")).alias("business_name"),
        F.when(k % 4 == 0, "RETAILER").otherwise("UNKNOWN").alias("business_type"), F.when(k % 13 == 0, "ARTICLE").otherwise("WEBSITE").alias("source_type"), F.array().cast("array<string>").alias("signals"),
        F.when(k % 17 == 0, "OWN_LABEL").alias("positioning"), none.alias("carries_other_brands"), F.when(k % 11 == 0, "MEDIA").otherwise("SELF").alias("relationship"), F.lit("YES").alias("geography"),
        (k % 11 == 0).alias("excluded"), F.when(k % 11 == 0, "not_self_business:MEDIA").alias("exclude_reason"), none.alias("address"), F.when(k % 7 != 0, "site").alias("website"), none.alias("instagram"), none.alias("facebook"),
        none.alias("email"), none.alias("phone"), none.alias("maps_url"), F.lit("YES").alias("is_business"), F.when(k % 6 == 0, "YES").otherwise("UNKNOWN").alias("ai_stockist"),
    )


SQL_LEAD = """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'not_self_business:MEDIA' WHEN c_custkey % 13 = 0 THEN 'discovery_page_not_lead' WHEN c_custkey % 3 = 1 THEN 'not_a_retail_prospect'
  WHEN c_custkey % 17 = 0 THEN 'own_label_not_lead' WHEN c_custkey % 5 = 0 AND c_custkey % 7 = 0 THEN 'identity_insufficient' WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN 'fashion_retail_evidence_missing'
  WHEN c_custkey % 7 = 0 THEN 'no_usable_contact_path' WHEN c_custkey % 3 = 0 THEN 'fashion_retail_page_evidence' ELSE 'official_website' END AS reason FROM customer),
l AS (SELECT *, CASE WHEN reason IN ('fashion_retail_page_evidence', 'official_website') THEN 'YES' WHEN reason IN ('identity_insufficient', 'fashion_retail_evidence_missing', 'no_usable_contact_path') THEN 'UNKNOWN' ELSE 'NO' END AS lead FROM r)"""


@query("lead_gate", f"{SQL_LEAD} SELECT k AS seq, lead AS stockist_lead, reason FROM l")
def lead_gate(spark, sf):
    return lead.assess(lead_rows(spark, sf)).select("seq", "stockist_lead", F.get("stockist_lead_reasons", F.lit(0)).alias("reason"))


@query("failure_classes", f"""{SQL_LEAD} SELECT k AS seq, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN CASE WHEN k % 5 <> 0 AND k % 4 = 0 THEN 'C_listing_mistaken_for_business' END
WHEN lead = 'UNKNOWN' AND reason = 'no_usable_contact_path' THEN 'D_identified_contact_missing' WHEN lead = 'UNKNOWN' THEN 'A_found_insufficient_evidence' END AS failure FROM l""")
def failure_classes(spark, sf):
    assessed = lead.assess(lead_rows(spark, sf))
    return assessed.select("seq", lead.failure_class(assessed).alias("failure"))


@query("reporting_buckets", """SELECT c_custkey AS seq, CASE WHEN c_custkey % 13 = 0 THEN 'E_article_or_editorial' WHEN c_custkey % 6 = 0 THEN 'A_multi_brand_or_curated_stockist' WHEN c_custkey % 17 = 0 THEN 'B_own_label_designer_or_brand'
WHEN c_custkey % 4 = 0 THEN 'C_generic_clothing_retailer' ELSE 'F_other_or_unrelated' END AS bucket FROM customer""")
def reporting_buckets(spark, sf):
    return lead_rows(spark, sf).select("seq", lead.reporting_bucket().alias("bucket"))


@query("seed_coverage", """SELECT s_suppkey AS seed_id, EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey = s_suppkey) AS in_leads FROM supplier""")
def seed_coverage(spark, sf):
    """Every supplier as a seed against every customer as a lead; two in three customers have a name of another number."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed_id"), F.concat(F.lit("The Shop "), F.lpad(F.col("s_suppkey").cast("string"), 12, "0")).alias("seed_name"))
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select(F.concat(F.lit("Store "), F.lpad(F.when(k % 3 == 0, k).otherwise(k + 500_000_000_000).cast("string"), 12, "0")).alias("business_name"))
    return seeds.covered(s, c).select("seed_id", "in_leads")


@query("primary_row", """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) = 1""")
def primary_row(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "F").cast("int").alias("other"))
    return ordered.first_of_each(o, ["o_custkey"], ["other", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("last_writer", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_writer(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("expected_places", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'Goa' WHEN n_nationkey % 3 = 1 THEN 'Mumbai' ELSE 'Elsewhere' END AS expected_city,
CASE WHEN n_nationkey % 3 = 0 THEN 'Goa' WHEN n_nationkey % 3 = 1 THEN 'Maharashtra' ELSE 'X' END AS expected_state FROM nation""")
def expected_places(spark, sf):
    i, none = F.col("n_nationkey"), F.lit(None).cast("string")
    rows = read(spark, sf, "nation").select(i.alias("id"), F.when(i % 3 == 2, "Elsewhere, X").alias("label"), F.when(i % 3 == 1, "bombay").alias("city"), none.alias("state"), none.alias("country"), F.when(i % 3 == 0, "boutiques in North Goa").otherwise("q").alias("query"))
    return geo.expected_places(rows, places.places(spark)).select("id", "expected_city", "expected_state")
