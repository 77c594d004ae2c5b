"""Places: lookup, expansion, terms in texts, and whether a profile lies in the expected place.

Terms meet texts through n-grams of words and an equi join, so the work grows
with the text and not with texts times terms. The place catalogue is a few rows
of configuration; its size is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.urls import foreign_tld

#: Catalogues up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Up to so many terms are looked for one by one.
FEW_TERMS = 64
NO_WORD = r"[^\p{L}\p{N}_]+"


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; counted up to the bound only."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def normal_place(name: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(name, r"\s+", " ")))


def terms(places: DataFrame) -> DataFrame:
    """(city, term) for each name, alias and locality, in lower case."""
    names = F.array_distinct(F.transform(F.concat(F.array("city"), "aliases", "localities"), F.lower))
    return places.select("city", F.explode(names).alias("term"))


def find_places(queries: DataFrame, places: DataFrame, name: str = "name") -> DataFrame:
    """queries with the city whose name or alias equals the name, by catalogue order; no partial matches."""
    known = places.select(F.explode(F.array_distinct(F.transform(F.concat(F.array("city"), "aliases"), normal_place))).alias("__known"), "ord", F.col("city").alias("place"))
    first = known.groupBy("__known").agg(F.min_by("place", "ord").alias("place"))
    return queries.join(small(first), normal_place(F.col(name)) == F.col("__known"), "left").drop("__known")


def expected_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (label, city, state, country, query) with expected_city, expected_state and expected_country.

    Fields given win over the parts of the label "city, state, country"; a known
    city brings its state and country; with neither, a city named in the query.
    """
    part = [F.nullif(F.btrim(F.get(F.split(F.coalesce("label", F.lit("")), ","), F.lit(i))), F.lit("")) for i in range(3)]
    given = rows.withColumns({"__city": F.coalesce("city", part[0]), "__state": F.coalesce("state", part[1]), "__country": F.coalesce("country", part[2])})
    known = places.select(F.explode(F.array_distinct(F.transform(F.concat(F.array("city"), "aliases"), normal_place))).alias("__known"), "ord", F.struct("city", "state", "country").alias("__p"))
    by_name = known.groupBy("__known").agg(F.min_by("__p", "ord").alias("__spec"))
    out = given.join(small(by_name), normal_place(F.col("__city")) == F.col("__known"), "left").drop("__known")
    names = known.select(F.col("__known").alias("term"), "ord", F.col("__p").alias("__named"))
    asked = out.where("__city IS NULL AND __state IS NULL AND query IS NOT NULL").select("query").distinct()
    hits = term_hits(asked, names, "query", "query").groupBy("query").agg(F.min_by("__named", "ord").alias("__named"))
    out = out.join(hits, "query", "left").withColumn("__named", F.when(F.col("__city").isNull() & F.col("__state").isNull(), F.col("__named")))
    stated = F.col("__city").isNotNull()
    made = {
        "expected_city": F.coalesce("__spec.city", "__city", "__named.city"), "expected_state": F.coalesce("__state", "__spec.state", "__named.state", F.when(stated, F.lit(""))),
        "expected_country": F.coalesce("__country", "__spec.country", "__named.country", F.when(stated, F.lit("India"))),
    }
    return out.withColumns(made).select(*rows.columns, *made)


def expand(areas: DataFrame) -> DataFrame:
    """Areas inside each place: of a country its other places, of others their neighbourhoods, else the place itself.

    areas: key, name, type, country, neighbourhoods.
    """
    inner = areas.where("type <> 'country'").select(F.col("country").alias("c"), F.col("name").alias("in_name"), F.col("type").alias("in_type"))
    countries = areas.where("type = 'country'").join(inner, F.col("country") == F.col("c"), "left")
    of_country = countries.select("key", F.coalesce("in_name", "name").alias("area"), F.coalesce("in_type", "type").alias("area_type"))
    others = areas.where("type <> 'country'").withColumn("area", F.explode_outer("neighbourhoods"))
    of_others = others.select("key", F.coalesce("area", "name").alias("area"), F.when(F.col("area").isNull(), F.col("type")).otherwise("neighbourhood").alias("area_type"))
    return of_country.unionByName(of_others)


def term_hits(texts: DataFrame, terms_: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term and its columns) for each term, of any number of words, that occurs in the text as whole words.

    Up to FEW_TERMS terms, counted first, are looked for in each text, and only
    those found leave it; more meet the texts' n-grams, of the lengths that terms have, by an equi join.
    """
    spelled = terms_.withColumn("__gram", F.array_join(F.filter(F.split(F.lower("term"), NO_WORD), lambda w: w != ""), " "))
    spelled = spelled.where("__gram <> ''")
    known = [r[0] for r in spelled.select("__gram").distinct().limit(FEW_TERMS + 1).collect()]
    low = F.lower(F.col(text_col))
    if len(known) <= FEW_TERMS:
        spaced = F.concat(F.lit(" "), F.regexp_replace(low, NO_WORD, " "), F.lit(" "))
        found = let(spaced, lambda t: F.filter(F.array(*map(F.lit, sorted(known))).cast("array<string>"), lambda g: F.contains(t, F.concat(F.lit(" "), g, F.lit(" ")))))
        grams = texts.select(id_col, F.explode(found).alias("__gram"))
    else:
        words = F.filter(F.split(low, NO_WORD), lambda w: w != "")
        lengths = sorted(r[0] for r in spelled.select(F.size(F.split("__gram", " "))).distinct().collect())  # numbers of words of a term
        all_ = F.flatten(F.array(*[_grams(F.col("w"), n) for n in lengths]))
        grams = texts.select(id_col, words.alias("w")).select(id_col, F.explode(F.array_distinct(all_)).alias("__gram"))
    return grams.join(small(spelled), "__gram").drop("__gram")


def _grams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def verify(profiles: DataFrame, places: DataFrame, id_col: str = "id") -> DataFrame:
    """profiles (id, profile, address, city, website, expected_city) with ``geography`` YES, NO or UNKNOWN and its evidence.

    UNKNOWN means that nothing contradicts the expected place; it isn't a mismatch.
    """
    p = profiles.withColumn("__blob", F.concat_ws(" ", "profile", "address", "city"))
    catalogue = terms(places)
    found = term_hits(p, catalogue, id_col, "__blob").select(id_col, F.col("city").alias("hit_city"), "term")
    stated = term_hits(p.withColumn("__own", F.concat_ws(" . ", "address", "city")), catalogue, id_col, "__own").select(id_col, F.col("city").alias("own_city"))
    hits = found.groupBy(id_col).agg(F.collect_set("hit_city").alias("cities"), F.collect_set(F.struct("hit_city", "term")).alias("hit_terms"))
    own = stated.groupBy(id_col).agg(F.collect_set("own_city").alias("own_cities"))
    states = places.groupBy(F.lower("state").alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.collect_set("s").alias("shared"))
    state_of = places.select(F.col("city").alias("expected_city"), F.lower("state").alias("expected_state"))
    none = F.array().cast("array<string>")
    out = p.join(hits, id_col, "left").join(own, id_col, "left").join(small(state_of), "expected_city", "left").crossJoin(F.broadcast(states))
    out = out.withColumns({"cities": F.coalesce("cities", none), "own_cities": F.coalesce("own_cities", none)})
    foreign = foreign_tld(F.col("website"))
    home = F.array_contains("cities", F.col("expected_city"))
    own_home = F.array_contains("own_cities", F.col("expected_city"))
    other = F.array_sort(F.array_remove("cities", F.col("expected_city")))
    names_state = F.coalesce(F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("__blob"), r"[^\p{L}\p{N}_]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("expected_state"), F.lit(" "))), F.lit(False))
    shared = F.coalesce(F.array_contains("shared", F.col("expected_state")), F.lit(False))
    no_place = F.when(foreign, "NO").when(F.size("cities") > 0, "YES").otherwise("UNKNOWN")
    with_place = (
        F.when(foreign & ~own_home, "NO").when((F.size(other) > 0) & ~(home | own_home), "NO").when(home | own_home, "YES").when(names_state & ~shared, "YES").otherwise("UNKNOWN")
    )
    evidence = F.array(
        F.when(foreign, F.lit("foreign_website_tld")), F.when(home, F.lit("location_in_profile")), F.when(own_home, F.lit("address_or_city_matches")),
        F.when(F.size(other) > 0, F.concat(F.lit("other_city:"), F.array_join(other, ","))), F.when(names_state & ~(home | own_home), F.when(shared, F.lit("state_only_shared")).otherwise(F.lit("state_match"))),
    )
    return out.select(*profiles.columns, F.when(F.col("expected_city").isNull(), no_place).otherwise(with_place).alias("geography"), F.filter(evidence, lambda x: x.isNotNull()).alias("geographic_evidence"))


def uncovered(places: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(city, term) of localities that no text mentions."""
    localities = places.select("city", F.explode("localities").alias("term"))
    covered = term_hits(texts, localities, id_col, text_col).select("city", "term").distinct()
    return localities.join(covered, ["city", "term"], "left_anti")
