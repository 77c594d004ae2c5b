"""Result pages of searches, asked for all queries at once, page after page, as long as a query gives something new and needs more.

A query goes on to its next page unless a page fails, is empty, brings only
URLs that the query has shown before, or the candidates built from its hits
reach its limit. Each page number is one table of open queries, one call of the
search and one written table of answers; what is known of a query is kept as
distinct keys, so that a page is compared by joins and no query's hits meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .candidates import candidates_from_hits, group_key
from .graph import written

MAX_PAGES = 15
#: Hits of a query and of a page at most, for their order in one number.
_PAGE, _QUERY = 10_000, 1_000_000


def collect_pages(specs: DataFrame, search: Callable[[DataFrame], DataFrame], most: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """Hits (seq, query, page, title, url, snippet, source) and states (query, pages, n_hits, n_candidates, error) of specs (seq, query, limit).

    search: open queries (query, page) to hits (query, page, ord, title, url,
    snippet, source, and error in a row of its own where a page failed). Hits
    without a URL count by their place; a query given twice is asked once, with its largest limit.
    """
    todo = written(specs.groupBy("query").agg(F.min("seq").alias("spec"), F.max("limit").alias("limit")))
    live = todo
    waves: list[DataFrame] = []
    built: list[DataFrame] = []
    states: list[DataFrame] = []
    for page in range(1, most + 1):
        answers = search(live.select("query", F.lit(page).alias("page")))
        answers = answers if "error" in answers.columns else answers.withColumn("error", F.lit(None).cast("string"))
        got = written(answers.join(live.select("query", "spec"), "query").withColumn("key", F.coalesce(F.nullif("url", F.lit("")), F.concat_ws(":", "title", F.lit(page).cast("string"), F.col("ord").cast("string")))))
        first = Window.partitionBy("query", "key").orderBy("ord")
        new = got.where("error IS NULL").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "error")
        for wave in waves:
            new = new.join(wave.select("query", "key"), ["query", "key"], "left_anti")
        new = written(new.withColumn("seq", F.col("spec") * _QUERY + (page - 1) * _PAGE + F.col("ord")))
        waves.append(new)
        made = candidates_from_hits(new.select("seq", "query", "title", "url", "snippet", "source")).select("query", group_key().alias("group_key")).distinct()
        for earlier in built:
            made = made.join(earlier, ["query", "group_key"], "left_anti")
        built.append(written(made))
        n_new = new.groupBy("query").agg(F.count(F.lit(1)).alias("n_new"))
        n_made = reduce(lambda a, b: a.unionByName(b), built).groupBy("query").agg(F.count(F.lit(1)).alias("n_candidates"))
        failed = got.where("error IS NOT NULL").groupBy("query").agg(F.min("error").alias("error"))
        now = live.join(n_new, "query", "left").join(n_made, "query", "left").join(failed, "query", "left")
        now = written(now.select("query", "spec", "limit", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "error"))
        on = F.col("error").isNull() & (F.col("n_new") > 0) & (F.col("n_candidates") < F.col("limit"))
        last = page == most
        states.append(now.where(F.lit(True) if last else ~on).select("query", F.lit(page).alias("pages"), "n_candidates", "error"))
        live = now.where(on).select("query", "spec", "limit")
        if last or not live.limit(1).count():
            break
    hits = reduce(lambda a, b: a.unionByName(b), waves).select("seq", "query", "page", "title", "url", "snippet", "source")
    n_hits = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"))
    state = reduce(lambda a, b: a.unionByName(b), states).join(n_hits, "query", "left")
    return hits, state.select("query", "pages", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "n_candidates", "error")


def paged(search: Callable[[DataFrame], DataFrame], most: int = MAX_PAGES) -> Callable[[DataFrame], DataFrame]:
    """A search of whole queries, as a batch takes it, out of one of single pages."""
    return lambda specs: collect_pages(specs, search, most)[0]
