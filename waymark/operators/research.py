"""Bounded research: what is missing, whom to look at first, and the queries of each round under hard caps.

The driver runs the rounds, as each plan needs the pool that the round before
left; a round's plan and merge are jobs over tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import urls
from ..functions.text import clean_name, present
from .graph import written
from .ordered import round_robin
from .resolve import duplicate_key, fold, merge_by_first_key, merge_same_name
from .signals import snippet_address

#: A profile's URL in a hit.
P_ACCOUNT = r"https?://(?:www\.)?instagram\.com/[A-Za-z0-9_.]+"


def with_priority(pool: DataFrame) -> DataFrame:
    """pool (business_name, address, city, website, instagram, physical_store, snippet, status) with missing fields and priority 0 to 18."""
    parts = [c for c in ("business_name", "address", "city", "website", "instagram", "snippet") if c in pool.columns]  # merged pools have no snippet
    out = pool.withColumn("__blob", F.concat_ws(" ", *parts))
    blob = F.col("__blob")
    known = F.coalesce("brands_known", F.lit(False)) if "brands_known" in pool.columns else F.lit(False)
    has = {"address": present(F.col("address")) | blob.rlike(P.STREET) | blob.rlike(P.PIN_CODE), "instagram": present(F.col("instagram")), "website": present(F.col("website")), "brands": blob.rlike(P.BRANDS_KNOWN) | known}
    out = out.withColumns({f"__{k}": F.coalesce(v, F.lit(False)) for k, v in has.items()}).withColumn("__weak", (F.col("physical_store") != "YES") & ~F.col("__address"))
    lacks = {"address": ~F.col("__address"), "instagram": ~F.col("__instagram"), "website": ~F.col("__website"), "store": F.col("__weak"), "brands": ~F.col("__brands"), "maps": ~F.col("__address")}
    out = out.withColumn("missing", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in lacks.items()]), lambda x: x.isNotNull()))

    def points(test: Column, n: int) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)

    score = 4 + points(F.col("status") != "enriched", 2) + points(present(F.col("city")), 3) + points(blob.rlike(P.FASHION_WORD), 3) + points(~F.col("__weak"), 2) + points(blob.rlike(P.MULTI_WORD), 2) + points(~F.col("__website") | ~F.col("__instagram"), 2)
    idle = (clean_name(F.col("business_name")) == "UNKNOWN") | blob.rlike(P.LOW_VALUE) | (F.size("missing") == 0)
    return out.withColumn("priority", F.when(idle, 0).otherwise(score)).drop("__blob", "__weak", *[f"__{k}" for k in has])


def plan_enrichment(pool: DataFrame, room: int = P.RESEARCH_CAPS["enrichment"], each: int = P.RESEARCH_CAPS["per_candidate"]) -> DataFrame:
    """(seq, field, query): the first missing fields of the most promising candidates, as long as there is room."""
    templates = F.create_map(*[F.lit(x) for pair in P.RESEARCH_FIELDS for x in pair])
    asked = with_priority(pool).where("priority > 0").select("seq", "business_name", "city", "priority", F.posexplode(F.slice("missing", 1, each)).alias("n", "field"))
    query = F.replace(F.replace(templates[F.col("field")], F.lit("{name}"), F.col("business_name")), F.lit("{city}"), F.coalesce("city", F.lit("")))
    ranked = asked.withColumn("query", query).orderBy(F.desc("priority"), F.lower("business_name"), "seq", "n").limit(room)
    return ranked.select("seq", "field", "query")


def plan_gaps(gaps: DataFrame, room: int = P.RESEARCH_CAPS["expansion"]) -> DataFrame:
    """(city, term, query) for places that nothing covers, templates in turn."""
    templates = F.array(*map(F.lit, P.GAP_TEMPLATES))
    few = gaps.orderBy("city", "term").limit(room)  # so the window sees room rows
    return few.withColumn("i", F.row_number().over(Window.orderBy("city", "term")) - 1).select("city", "term", F.concat_ws(" ", F.element_at(templates, (F.col("i") % len(P.GAP_TEMPLATES) + 1).cast("int")), F.initcap("term")).alias("query"))


def plan_initial(specs: DataFrame, limit: int) -> DataFrame:
    """(seq, query, family, place) of round 1 from specs (seq, query, family, location, city).

    A third of the slots goes to localities, as far as there are any; city
    queries, then locality queries are dealt by family in turn, families in
    order of appearance, and the rest is filled up in the order of specs.
    """
    city = F.lower("location") == F.lower("city")
    order = specs.groupBy("family").agg(F.min("seq").alias("family_seq"))
    known = specs.join(order, "family")
    n_local = specs.where(~city).limit(limit // 3).count()
    chosen = round_robin(known.where(city), "family", "seq", F.col("family_seq"), limit - n_local).withColumn("part", F.lit(0))
    chosen = chosen.unionByName(round_robin(known.where(~city), "family", "seq", F.col("family_seq"), n_local).withColumn("part", F.lit(1)))
    rest = known.join(chosen.select(F.lower("query").alias("__q")).distinct(), F.lower("query") == F.col("__q"), "left_anti").withColumns({"part": F.lit(2), "position": F.col("seq").cast("int")})
    once = rest.withColumn("__n", F.row_number().over(Window.partitionBy(F.lower("query")).orderBy("seq"))).where("__n = 1").drop("__n")
    first = chosen.unionByName(once).orderBy("part", "position").limit(max(0, limit))
    return first.withColumn("place", F.row_number().over(Window.orderBy("part", "position"))).select("seq", "query", "family", "place")


def combine_members(members: DataFrame) -> DataFrame:
    """One row for each merged business of its members' research (cluster, research_id, round, source, status, queries, researched_at).

    The member of the earliest round, then least id, gives id, round and
    source; queries are united in order of members; a cluster is enriched if
    any member is or has been asked about, skipped if all are.
    """
    first = F.struct("round", "research_id")
    asked = F.size("queries") > 0
    out = members.groupBy("cluster").agg(
        F.min_by("research_id", first).alias("research_id"), F.min("round").alias("round"), F.min_by("source", first).alias("source"),
        F.max(F.coalesce((F.col("status") == "enriched") | asked, F.lit(False))).alias("__any"), F.min(F.coalesce(F.col("status") == "skipped", F.lit(False))).alias("__all"), F.coalesce(F.max("researched_at"), F.lit("")).alias("researched_at"),
    )
    each = members.select("cluster", "research_id", F.posexplode("queries").alias("pos", "query"))
    seen = each.groupBy("cluster", "query").agg(F.min(F.struct("research_id", "pos")).alias("at"))
    united = seen.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "query"))), lambda x: x["query"]).alias("queries"))
    status = F.when(F.col("__any"), "enriched").when(F.col("__all"), "skipped").otherwise("pending")
    return out.join(united, "cluster", "left").select("cluster", "research_id", "round", "source", status.alias("status"), F.coalesce("queries", F.array().cast("array<string>")).alias("queries"), "researched_at")


def refreshed(pool: DataFrame) -> DataFrame:
    """pool with missing fields and priority worked out anew, and a status: what can't be asked about is skipped unless it has been, what lacks nothing counts as enriched."""
    out = with_priority(pool)
    hopeless = (F.col("priority") == 0) & (F.size("missing") > 0)
    unnamed = clean_name(F.col("business_name")) == "UNKNOWN"
    status = F.when(F.col("status") == "enriched", "enriched").when(hopeless | unnamed, "skipped").when(F.size("missing") == 0, F.when(F.col("status") == "pending", "enriched").otherwise(F.col("status"))).otherwise(F.col("status"))
    return out.withColumn("status", status)


def research(initial: DataFrame, search: Callable[[DataFrame], DataFrame], gaps: Callable[[DataFrame], DataFrame], total: int = P.RESEARCH_CAPS["total"]) -> tuple[DataFrame, int]:
    """The pool after four rounds, and the queries spent.

    Each plan is asked once: plans, answers and pools are written, so that no
    later job calls the search again or sees another answer.

    initial: queries of round 1. search: queries to observations, ordered by
    ``seq``. gaps: the pool to queries of round 3. Rounds 2 and 4 enrich; a
    name that has been enriched is not asked again.
    """
    asked = written(initial.limit(min(P.RESEARCH_CAPS["initial"], total)))
    spent = asked.count()
    pool = written(merge_by_first_key(written(search(asked))).withColumn("status", F.lit("pending")))
    done = None
    for room, kind in ((P.RESEARCH_CAPS["enrichment"], "enrich"), (P.RESEARCH_CAPS["expansion"], "gaps"), (P.RESEARCH_CAPS["enrichment"], "enrich")):
        room = min(room, total - spent)
        if room <= 0:
            break
        fresh = pool if done is None else pool.join(done, "seq", "left_anti")
        plan = written(gaps(pool).limit(room) if kind == "gaps" else plan_enrichment(fresh, room))
        spent += plan.count()
        if kind == "enrich":
            done = plan.select("seq").distinct() if done is None else done.unionByName(plan.select("seq")).distinct()
        observed = pool.select(*[c for c in pool.columns if c != "status"]).unionByName(written(search(plan)), allowMissingColumns=True)
        pool = written(merge_by_first_key(observed).withColumn("status", F.lit("pending")))
    return pool, spent


STATE = ("research_id", "round", "source", "status", "queries", "researched_at")


def from_hits(hits: DataFrame) -> DataFrame:
    """Observed businesses of discovery hits (seq, query, round, city, title, url, snippet): named by the title, with the site or account that the URL is, and an address of the snippet."""
    kind = urls.classify(F.col("url"))
    account = F.regexp_extract(F.concat_ws(" ", "url", "snippet"), f"({P_ACCOUNT})", 1)
    none = F.lit(None).cast("string")
    rows = hits.where(F.coalesce(kind.isin("WEBSITE", "SOCIAL", "MAPS"), F.lit(False)))
    return rows.select(
        "seq", "round", clean_name(F.col("title")).alias("business_name"), F.coalesce("city", F.lit("UNKNOWN")).alias("city"), F.when(kind == "WEBSITE", F.col("url")).alias("website"), F.nullif(account, F.lit("")).alias("instagram"), none.alias("facebook"), none.alias("whatsapp"),
        none.alias("phone"), none.alias("email"), snippet_address(F.concat_ws(" ", "title", "snippet", "url")).alias("address"), *[F.lit("UNKNOWN").alias(c) for c in ("business_type", "fashion_relevance", "women_fashion_relevance", "physical_store")], F.lit("LOW").alias("confidence"),
        F.col("url").alias("source_url"), F.array("query").alias("discovered_by_queries"), F.array().cast("array<string>").alias("signals"), "snippet",
    )


def absorb(pool: DataFrame | None, observed: DataFrame) -> DataFrame:
    """The pool (businesses with their research STATE) after the merge with new observations (seq, round and a business's columns).

    The merge is that of any run: by first key, then by compatible equal names.
    (research_id, cluster) edges carry each member's state through it; members are combined by combine_members().
    """
    new = observed.withColumns({"research_id": F.col("seq"), "source": F.col("source_url"), "status": F.lit("pending"), "queries": F.array().cast("array<string>"), "researched_at": F.lit(""), "brands_known": F.lit(False)})
    rows = written(new if pool is None else pool.unionByName(new, allowMissingColumns=True))
    keyed = rows.withColumn("merge_key", F.coalesce(duplicate_key(), F.concat(F.lit("row:"), F.col("seq").cast("string"))))
    once = written(fold(keyed.drop("round", "source"), ["merge_key"]))
    into = merge_same_name(once).withColumnRenamed("seq", "__seq")
    joined = written(once.join(into, F.col("seq") == F.col("__seq")).drop("__seq"))
    merged = fold(joined.drop("merge_key", "n_merged"), ["merged_into"]).withColumnRenamed("merged_into", "cluster")
    edges = keyed.join(joined.select("merge_key", F.col("merged_into").alias("cluster")), "merge_key")
    state = combine_members(edges.select("cluster", *STATE))
    notes = edges.groupBy("cluster").agg(F.max(F.coalesce("brands_known", F.lit(False))).alias("brands_known"), F.concat_ws(" ", F.array_sort(F.collect_set("snippet"))).alias("snippet"))  # as many snippets as the caps allow
    return refreshed(merged.join(state, "cluster").join(notes, "cluster").drop("cluster", "n_merged", "phones", "emails"))


def harvest(pool: DataFrame, hits: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """pool after its candidates' own queries: asked (research_id, query, place), hits (research_id, seq, title, url, snippet).

    The first account, address and site under the candidate's name that the hits
    show fill what is missing; a candidate that was asked about is enriched, whatever came back.
    """
    names = pool.select(F.col("research_id").alias("__id"), F.lower("business_name").alias("__name"))
    h = hits.join(names, F.col("research_id") == F.col("__id"))
    text = F.concat_ws(" ", "title", "snippet", "url")
    found = {
        "instagram": F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), f"({P_ACCOUNT})", 1), F.lit("")) for c in ("url", "snippet")]), "address": snippet_address(text),
        "website": F.when((F.col("__name") != "") & F.contains(F.lower(F.coalesce("title", F.lit(""))), F.col("__name")) & (urls.classify(F.col("url")) == "WEBSITE"), F.col("url")),
    }
    h = h.withColumns({f"__{k}": v for k, v in found.items()} | {"__brands": F.coalesce(text.rlike(P.BRANDS_KNOWN), F.lit(False))})
    first = [F.min_by(f"__{k}", F.when(F.col(f"__{k}").isNotNull(), F.col("seq"))).alias(f"__{k}") for k in found]
    per = h.groupBy("research_id").agg(*first, F.max("__brands").alias("__brands")).withColumnRenamed("research_id", "__h")
    ran = asked.groupBy("research_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "query"))), lambda x: x["query"]).alias("__ran")).withColumnRenamed("research_id", "__r")
    out = pool.join(per, F.col("research_id") == F.col("__h"), "left").join(ran, F.col("research_id") == F.col("__r"), "left")
    was = F.col("__ran").isNotNull()
    filled = {k: F.when(present(F.col(k)), F.col(k)).otherwise(F.coalesce(f"__{k}", F.col(k))) for k in found}
    state = {"queries": F.when(was, F.concat("queries", "__ran")).otherwise(F.col("queries")), "status": F.when(was, "enriched").otherwise(F.col("status")), "researched_at": F.when(was, now).otherwise(F.col("researched_at")), "brands_known": F.col("brands_known") | F.coalesce("__brands", F.lit(False))}
    return refreshed(out.withColumns(filled | state).drop("__h", "__r", "__ran", "__brands", *[f"__{k}" for k in found]))


def run_rounds(specs: DataFrame, search: Callable[[DataFrame], DataFrame], gaps: Callable[[DataFrame], DataFrame], identify: Callable[[DataFrame], DataFrame] = from_hits, caps: dict[str, int] = P.RESEARCH_CAPS, now: str = "") -> dict[str, DataFrame]:
    """Four rounds with their state: ``pool``, the ``queries`` asked (round, place, query, purpose, research_id) and the ``errors`` of the search.

    specs: production queries (seq, query, family, location, city). search: a
    plan (place, query, round, city) to hits (query, ord, title, url, snippet, and error). gaps: the
    pool to uncovered places (city, term). Round 1 is a slice of specs, round 3
    asks where nothing covers a place, rounds 2 and 4 ask about candidates,
    the latter about names that weren't known before. No query is asked twice in any case,
    all rounds together stay under the caps, and every plan, answer and pool is a written table.
    """
    asked: list[DataFrame] = []
    hits_of: list[DataFrame] = []
    spent = enriched = 0

    def issue(plan: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
        """The plan as far as it is new and there is room, and its hits in order."""
        nonlocal spent
        new = plan.withColumn("__q", F.lower("query"))
        for earlier in asked:
            new = new.join(earlier.select(F.lower("query").alias("__q")), "__q", "left_anti")
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy("__q").orderBy("place"))).where("__n = 1").drop("__q", "__n")
        new = written(new.orderBy("place").limit(max(0, room)))  # caps bound a plan, so these windows see few rows
        spent += new.count()
        asked.append(new)
        found = search(new.select("place", "query", "round", "city"))
        found = found if "error" in found.columns else found.withColumn("error", F.lit(None).cast("string"))
        start = 1_000_000 * len(asked)
        hits = written(found.join(new, "query").withColumn("seq", F.row_number().over(Window.orderBy("place", "ord")) + start))
        hits_of.append(hits)
        return new, hits.where("error IS NULL")

    def left(cap: str, used: int = 0) -> int:
        return min(caps["total"] - spent, caps[cap] - used)

    nobody = F.lit(None).cast("long")
    first = plan_initial(specs, left("initial")).join(specs.select("seq", "city"), "seq")
    _, hits = issue(first.select(F.col("place").cast("long").alias("place"), "query", F.lit(1).alias("round"), "city", F.lit("initial").alias("purpose"), nobody.alias("research_id")), left("initial"))
    pool = written(absorb(None, identify(hits)))

    def ask_about(pool: DataFrame, candidates: DataFrame, number: int) -> DataFrame:
        nonlocal enriched
        room = left("enrichment", enriched)
        if room <= 0:
            return pool
        plan = plan_enrichment(candidates.where(F.size("queries") == 0), room, caps["per_candidate"])
        ids = candidates.select("seq", "research_id", "city", F.col("priority").alias("p"), F.lower("business_name").alias("n"))
        order = F.row_number().over(Window.orderBy(F.desc("p"), "n", "seq", "field"))
        plan = plan.join(ids, "seq").withColumn("place", order.cast("long"))
        plan, hits = issue(plan.select("place", "query", F.lit(number).alias("round"), "city", F.lit("enrichment").alias("purpose"), "research_id"), room)
        enriched += plan.count()
        return written(harvest(pool, hits, plan, now))

    pool = ask_about(pool, pool, 2)
    name = F.lower(F.btrim(F.regexp_replace("business_name", r"\s+", " ")))
    known = written(pool.select(name.alias("__name")).distinct())
    room = left("expansion")
    if room > 0:
        plan = plan_gaps(gaps(pool), room).withColumn("place", F.row_number().over(Window.orderBy("city", "term")).cast("long"))
        _, hits = issue(plan.select("place", "query", F.lit(3).alias("round"), "city", F.lit("expansion").alias("purpose"), nobody.alias("research_id")), room)
        pool = written(absorb(pool, identify(hits)))
    fresh = pool.withColumn("__name", name).join(known, "__name", "left_anti").drop("__name")
    pool = ask_about(pool, fresh, 4)
    union = lambda xs: reduce(lambda a, b: a.unionByName(b), xs)
    return {"pool": pool, "queries": union(asked), "errors": union([h.where("error IS NOT NULL").select("round", "query", "error") for h in hits_of])}
