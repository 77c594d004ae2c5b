"""Query generation: every template once with the city, localities with rotated templates, capped, interleaved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places as known
from ..functions.places import MAX_QUERIES


def render(template: Column, location: Column) -> Column:
    """The template with ``{city}`` filled in, or the location after it."""
    return F.when(template.contains("{city}"), F.replace(template, F.lit("{city}"), location)).otherwise(F.concat_ws(" ", template, location))


def generate(places: DataFrame, templates: DataFrame, max_queries: int = MAX_QUERIES, localities: int | None = None) -> DataFrame:
    """(city, position, query, family, location, kind) for each place.

    places and templates are small configuration tables; their product is the
    result. City queries come first, then one template for each locality, the
    family turning fastest; queries equal in any case are asked once.
    """
    n_families = templates.select("family_ord").distinct().count()
    sizes = templates.groupBy("family_ord").agg(F.count(F.lit(1)).alias("n_templates"))
    city = places.crossJoin(templates).select("city", F.col("city").alias("location"), "family", "template", (F.col("family_ord") * 1000 + F.col("template_ord")).alias("o"), F.lit(0).alias("kind"))
    extra = places.select("city", F.posexplode(F.filter(F.array_distinct(F.transform(F.concat("aliases", "localities"), F.lower)), lambda x: x != F.lower("city"))).alias("i", "location"))
    if localities is not None:
        extra = extra.where(F.col("i") < localities)
    extra = extra.withColumn("family_ord", F.pmod("i", F.lit(n_families)).cast("int")).join(sizes, "family_ord")
    extra = extra.withColumn("template_ord", F.pmod(F.floor(F.col("i") / n_families), F.col("n_templates")).cast("int"))
    extra = extra.join(templates, ["family_ord", "template_ord"]).select("city", F.initcap("location").alias("location"), "family", "template", F.col("i").alias("o"), F.lit(1).alias("kind"))
    asked = city.unionByName(extra).withColumn("query", render(F.col("template"), F.col("location")))
    once = Window.partitionBy("city", "kind", F.lower("query")).orderBy("o")
    asked = asked.withColumn("rn", F.row_number().over(once)).where("rn = 1").drop("rn", "template")
    place_order = Window.partitionBy("city").orderBy("kind", "o")
    return asked.withColumn("position", F.row_number().over(place_order)).where(F.col("position") <= max_queries).drop("o")


def sampled(places: DataFrame, localities: int = known.SAMPLED_LOCALITIES, max_queries: int = MAX_QUERIES) -> DataFrame:
    """Queries about physical stores and in guides' words, kept apart from the production batch, with a few localities of each place.

    What they find is a lead at best and proves no store.
    """
    return generate(places, known.templates(places.sparkSession, known.SAMPLED_FAMILIES), max_queries, localities)


def multi_city(places: DataFrame, cities: Sequence[str] = known.SAMPLE_CITIES, per_family: int = 1) -> DataFrame:
    """A small batch over cities: the first templates of every family for each city in turn, no localities, numbered over the batch in ``batch_position``."""
    names = {r[0].lower(): r[0] for r in places.select("city").collect()}  # the catalogue, a few rows
    unknown = [c for c in cities if c.lower() not in names]
    if unknown:
        raise KeyError(f"unknown cities: {unknown}")
    turn = places.sparkSession.createDataFrame([(names[c.lower()], i) for i, c in enumerate(dict.fromkeys(cities))], "city string, turn int")
    few = known.templates(places.sparkSession, tuple(known.FAMILIES)).where(F.col("template_ord") < per_family)
    asked = generate(places.join(turn.select("city"), "city", "left_semi"), few, localities=0).join(turn, "city")
    return asked.withColumn("batch_position", F.row_number().over(Window.orderBy("turn", "position"))).drop("turn")  # a row for each city and template


def specs(asked: DataFrame, places: DataFrame, limit: int = 5) -> DataFrame:
    """Generated queries as a batch takes them: (query, limit, family, location, city, state, country).

    A query's place stays its city, state and country, whatever locality it names.
    """
    return asked.join(places.select("city", "state", "country"), "city").select("query", F.lit(limit).alias("limit"), "family", "location", "city", "state", "country", "position")
