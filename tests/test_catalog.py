import os
from collections import Counter

import duckdb
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from waymark.operators import identify
from waymark.plans import CATALOG
from waymark.sources import pages

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, name):
    q = CATALOG[name]
    df = q.run(spark, FOLDER)
    if q.sql:
        same_rows(df, q.sql, FOLDER)
    else:
        assert df.count() >= 0


def test_names_with_cut_references_are_those_of_the_sql(spark, tmp_path):
    titles = ("Rose &amp; Co", "Rose &amp Co", "Rose &copy Co", "Rose && Co")
    pages = [(i, f"https://s{i}.example.org/", f"<html><title>{t}</title><h1>{t}</h1></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.seq: r.business_name for r in CATALOG["identified_businesses"].run(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r[1] for r in c.execute(f"SELECT seq, business_name FROM ({CATALOG['identified_businesses'].sql})").fetchall()}


def test_names_with_tags_and_more_titles_are_those_of_the_sql(spark, tmp_path):
    parts = (
        "<title>Home</title><h1>Rose<br>Lily</h1>", "<title>Home</title><h1>Ro<span>se</span> &amp; Co</h1>", "<title>Home</title><h1>Rose<!-- x -->Lily</h1>", "<title>Ro<b>se</b></title>", "<title>Rose</title><title>Lily</title>",
        "<title>Rose</title><svg><title>icon</title></svg>", "<title></title><title>Rose</title><h1>Lily</h1>", "<title>Rose<h1>Lily</h1>", "<title>Home</title><h1>Rose<h2>Lily</h2>",
    )
    pages = [(i, f"https://s{i}.example.org/", f"<html>{p}</html>") for i, p in enumerate(parts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.seq: r.business_name for r in CATALOG["identified_businesses"].run(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r[1] for r in c.execute(f"SELECT seq, business_name FROM ({CATALOG['identified_businesses'].sql})").fetchall()}


def test_listings_name_all_businesses_they_link_to_or_head(spark, tmp_path):
    """A directory's links, an article's links and headings, beyond 40 and 200, a thousand links and 40 headings."""
    links = "".join(f'<a href="https://s{i}.example.org/">Rose House {i}</a>' for i in range(1_050))
    heads = "".join(f"<h2>Lily Lane {i}</h2>" for i in range(60))
    made = [(1, "https://list.justdial.com/x", f"<title>List</title>{links}"), (2, "https://mag.example.com/blog/x", f"<title>Guide</title>{heads}{links}")]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.seq, r.source_type, r.name_source) for r in CATALOG["identified_businesses"].run(spark, str(tmp_path)).distinct().collect())
    assert got == {(1, "DIRECTORY", "external_business_link"): 1_050, (2, "ARTICLE", "article_business_link"): 1_050, (2, "ARTICLE", "article_heading"): 60}
    article = pages.page_evidence(spark.createDataFrame(made[1:], "seq long, url string, html string"), whole=True).withColumn("seq", F.lit(2))
    assert identify.from_articles(article).select("ord").distinct().count() == 1_110


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
