"""Search hits to candidates: normalise, classify, keep the best URL of each site, keep all provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def candidates_from_hits(hits: DataFrame) -> DataFrame:
    """Hits (seq, title, url, snippet, source, query) with a usable URL, with its normal form, domain and type."""
    normal = hits.withColumn("normalized_url", urls.normalize(F.col("url")))
    out = normal.withColumn("domain", urls.domain(F.col("normalized_url"))).where("domain IS NOT NULL")
    queries = F.when(F.col("query") != "", F.array("query")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"result_type": urls.classify(F.col("normalized_url")), "discovered_by_queries": queries})


def group_key() -> Column:
    """What makes candidates (result_type, domain, normalized_url) one: the domain of a site, the URL of other types."""
    return F.when(F.col("result_type") == "WEBSITE", F.concat(F.lit("WEBSITE|"), "domain")).otherwise(F.concat_ws("|", "result_type", "normalized_url"))


def dedupe(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each site, or for each URL of other types, with queries of all rows in order; with by, for each value of these columns apart.

    Of a site's URLs the most useful stays, then the shortest, then the first;
    other types keep the first. Rows are aggregated by group and query, then by
    group, so a site with very many hits gathers no more than its distinct queries.
    """
    site = F.col("result_type") == "WEBSITE"
    keyed = candidates.withColumn("group_key", group_key())
    score = F.when(site, urls.usefulness(F.col("url"))).otherwise(0)
    rank = F.struct((-score).alias("a"), F.when(site, F.length("url")).otherwise(0).alias("b"), F.col("seq").alias("c"))
    keep = [c for c in candidates.columns if c not in ("discovered_by_queries", "result_type", *by)]
    group = ("group_key", "result_type", *by)
    asked = keyed.select(*group, "seq", rank.alias("rank"), F.struct(*keep).alias("row"), F.posexplode_outer("discovered_by_queries").alias("pos", "q"))
    by_query = asked.groupBy(*group, "q").agg(
        F.min(F.struct("seq", "pos")).alias("at"), F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank"), F.min("seq").alias("first_seq"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n_hits")
    )
    queries = F.transform(F.array_sort(F.collect_list(F.when(F.col("q").isNotNull(), F.struct("at", "q")))), lambda x: x["q"])
    best = by_query.groupBy(*group).agg(F.min_by("row", "rank").alias("best"), F.min("first_seq").alias("first_seq"), F.sum("n_hits").alias("n_hits"), queries.alias("discovered_by_queries"))
    return best.select(*group, "best.*", "first_seq", "n_hits", "discovered_by_queries")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates of two runs as one; the second run's order follows the first's."""
    last = left.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    moved = right.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last") + 1).drop("last")
    return dedupe(left.unionByName(moved))
