"""Search pages with a source that counts what it is asked."""

from pyspark.sql import functions as F

from waymark.operators import paging


def test_queries_stop_where_nothing_new_comes(spark):
    pages = {
        "many": [[f"https://s{p}x{i}.in/" for i in range(4)] for p in range(30)],  # never ends: fifteen pages
        "enough": [[f"https://e{p}x{i}.in/" for i in range(4)] for p in range(5)],  # limit 6: two pages
        "one site": [["https://same.in/a", "https://same.in/b"], ["https://same.in/c"], []],  # new URLs, one candidate: until an empty page
        "repeats": [["https://r.in/1", "https://q.in/"], ["https://q.in/", "https://r.in/1"], ["https://never.in/"]],
        "fails": [["https://f.in/"], None, ["https://never.in/"]],
        "nothing": [],
        "no urls": [["", ""], [""], []],
    }
    asked = []

    def search(plan):
        rows = []
        for r in plan.collect():
            asked.append((r.query, r.page))
            known = pages[r.query]
            found = known[r.page - 1] if r.page <= len(known) else []
            rows += [(r.query, r.page, 0, None, None, None, None, "down")] if found is None else [(r.query, r.page, i, f"t{i}", u, "", "x", None) for i, u in enumerate(found)]
        return spark.createDataFrame(rows, "query string, page int, ord int, title string, url string, snippet string, source string, error string")

    specs = spark.createDataFrame([(i, q, {"enough": 6}.get(q, 100)) for i, q in enumerate(pages)] + [(50, "enough", 3)], "seq long, query string, limit int")
    hits, states = paging.collect_pages(specs, search)
    got = {r.query: (r.pages, r.n_hits, r.n_candidates, r.error) for r in states.collect()}
    assert got == {"many": (15, 60, 60, None), "enough": (2, 8, 8, None), "one site": (3, 3, 1, None), "repeats": (2, 2, 2, None), "fails": (2, 1, 1, "down"), "nothing": (1, 0, 0, None), "no urls": (3, 3, 0, None)}
    assert len(asked) == len(set(asked)) == sum(r[0] for r in got.values())
    rows = hits.orderBy("seq").collect()
    assert len({r.seq for r in rows}) == len(rows) and [r.url for r in rows if r.query == "one site"] == ["https://same.in/a", "https://same.in/b", "https://same.in/c"]


def test_no_queries(spark):
    specs = spark.createDataFrame([], "seq long, query string, limit int")
    hits, states = paging.collect_pages(specs, lambda plan: plan.select("query", "page", F.lit(0).alias("ord"), *[F.lit("").alias(c) for c in ("title", "url", "snippet", "source")]))
    assert hits.count() == states.count() == 0
