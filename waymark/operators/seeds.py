"""Known businesses as a benchmark: do hits, profiles and leads belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .geo import small
from .signals import social_handle

# --- fixed values: words that tell nothing about a seed, and listing titles ---
STOP_WORDS = ("goa", "boutique", "shop", "the", "and", "store", "stores", "collective", "keeper", "fashion")
LISTING_TITLE = r"(?i)\b(?:airbnb|shopee|superstock|shutterstock|justdial|tripadvisor|stock photos?|things to do|best shops?|top [0-9]+|directory|listing|for sale|book now|places to stay|holiday home|our favorite|favorite designer|hotels?)\b"
LISTING_PATH = r"(?i)/(?:listings?|hotels?|hotel|blog|blogs|article|articles|news|stories|story|reviews?|places)/"


def tokens(name: Column) -> Column:
    """Telling words of a name: letters and digits, longer than two, no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def named_in(name: Column, hay: Column) -> Column:
    """Whether the whole name, or all its telling words, stand in a text."""
    low, words = F.lower(hay), tokens(name)
    return F.coalesce(F.contains(low, F.lower(name)) | ((F.size(words) > 0) & F.forall(words, lambda t: F.contains(low, t))), F.lit(False))


def is_official_site(name: Column, city: Column, url: Column, title: Column) -> Column:
    """Whether a page is the business and doesn't only mention it: its domain, or a homepage whose title carries the name."""
    host, whole = compact(urls.domain(url)), compact(name)
    words = F.concat(tokens(name), tokens(city))
    by_domain = ((F.length(whole) >= 8) & F.contains(host, whole)) | ((F.size(tokens(name)) > 0) & F.forall(words, lambda t: F.contains(host, t)))
    home = F.regexp_replace(urls.path(url), "/", "").isin("", "index", "index.html", "home")
    usable = (urls.classify(url) == "WEBSITE") & ~F.coalesce(title.rlike(LISTING_TITLE), F.lit(False)) & ~F.concat(urls.path(url), F.lit("/")).rlike(LISTING_PATH)
    return F.coalesce(usable & (by_domain | (home & named_in(name, title))), F.lit(False))


def resolve(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """seeds (seed_id, seed_name, seed_city) with the first hit (seq, url, title, seed_id) that is their site, and whether any names them.

    Hits carry the seed they were searched for, so this is an equi join.
    """
    facing = hits.join(small(seeds), "seed_id")
    official = is_official_site(F.col("seed_name"), F.col("seed_city"), F.col("url"), F.col("title"))
    found = facing.groupBy("seed_id").agg(F.min_by(F.when(official, F.col("url")), F.when(official, F.col("seq"))).alias("website"), F.max(named_in(F.col("seed_name"), F.concat_ws(" ", "title", "url"))).alias("mentioned"))
    out = seeds.join(found, "seed_id", "left")
    relation = F.when(F.col("website").isNotNull(), "OFFICIAL_WEBSITE").otherwise("UNRESOLVED")
    return out.withColumns({"mentioned": F.coalesce("mentioned", F.lit(False)), "relation": relation})


# --- fixed values: places that tell a seed's profile from others of its name --
LOCATION = r"(?i)\b(?:goa|parra|assagao|anjuna|panjim|panaji|mapusa|calangute|vagator|morjim|candolim|saligao)\b"
#: Kinds of identity, the strongest first, and where it was found.
IDENTITIES = (("website", "OFFICIAL_WEBSITE", "official_website"), ("instagram", "OFFICIAL_INSTAGRAM", "official_instagram"), ("facebook", "OFFICIAL_FACEBOOK", "official_facebook"), ("google", "GOOGLE_BUSINESS", "google_business"))
TYPES = (("WEBSITE", "OFFICIAL_WEBSITE"), ("INSTAGRAM", "OFFICIAL_INSTAGRAM"), ("FACEBOOK", "OFFICIAL_FACEBOOK"), ("GOOGLE_MAPS", "GOOGLE_BUSINESS"))
#: First letters of a name that block pairs, and so many keys that are looked for one by one.
KEY_LETTERS, FEW_KEYS = 5, 200


def _all_in(words: Column, text: Column) -> Column:
    return (F.size(words) > 0) & F.forall(words, lambda t: F.contains(text, t))


def _city(city: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(city, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 2)


def named(name: Column, aliases: Column, hay: Column) -> Column:
    """Whether one of a seed's names, or all telling words of the first, stand in a text."""
    low = F.lower(hay)
    names = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.coalesce(F.exists(names, lambda n: (n != "") & F.contains(low, F.lower(n))) | _all_in(tokens(name), low), F.lit(False))


def is_own_site(name: Column, city: Column, url: Column, title: Column) -> Column:
    """Whether a page is the business: its domain has the whole name or all telling words and the city, or it is a homepage whose title does."""
    both = F.concat(tokens(name), _city(city))
    full = (F.size(tokens(name)) > 0) & (F.size(_city(city)) > 0)
    whole = compact(name)

    def strong(text: Column) -> Column:
        return ((F.length(whole) >= 8) & F.contains(compact(text), whole)) | (full & _all_in(both, F.lower(text)))

    host = F.coalesce(urls.domain(url), F.lit(""))
    surface = F.concat_ws(" ", title, host)
    home = F.regexp_replace(urls.path(url), "^/+|/+$", "").isin("", "index", "index.html", "home")
    listing = F.coalesce(title.rlike(LISTING_TITLE), F.lit(False)) | F.concat(urls.path(url), F.lit("/")).rlike(LISTING_PATH)
    by_domain = ((F.length(whole) >= 8) & F.contains(compact(host), whole)) | (full & _all_in(both, compact(host)))
    by_title = home & (strong(surface) | ((name != "") & F.contains(F.lower(surface), F.lower(name))))
    return F.coalesce((urls.classify(url) == "WEBSITE") & ~listing & (by_domain | by_title), F.lit(False))


def profile_signals(name: Column, aliases: Column, city: Column, url: Column, hay: Column, supplied: Column) -> Column:
    """What speaks for a profile being the seed's: struct of name, handle, strong_handle, location and supplied."""
    handle = compact(F.coalesce(social_handle(url), F.lit("")))
    names = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    some = F.exists(names, lambda n: ((compact(n) != "") & F.contains(handle, compact(n))) | _all_in(tokens(n), handle))
    strong = ((compact(name) != "") & F.contains(handle, compact(name))) | ((F.size(tokens(name)) > 0) & (F.size(_city(city)) > 0) & _all_in(F.concat(tokens(name), _city(city)), handle))
    flags = {"name_match": named(name, aliases, hay), "handle_match": some & (handle != ""), "strong_handle_match": strong & (handle != ""), "location_match": hay.rlike(LOCATION), "supplied_official_url": supplied}
    return F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


def is_own_profile(s: Column) -> Column:
    """A supplied profile needs a name; another the seed's full handle with its name or place, or all three of name, place and handle."""
    return (s["supplied_official_url"] & (s["handle_match"] | s["name_match"])) | (s["strong_handle_match"] & (s["name_match"] | s["location_match"])) | (s["name_match"] & s["location_match"] & s["handle_match"])


def facing(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """Pairs of a seed's id and a hit (seq, and a text ``hay``) that may be about each other, without a product of both.

    All ways to match need a telling word, or a name, inside the hit's title,
    snippet or URL, written together without other signs; so the first letters of a name's longest
    word must be there, too. Few different beginnings are looked for in each
    hit; more meet the hits' runs of letters by an equi join.
    """
    names = seeds.select("seed_id", F.explode(F.concat(F.array("seed_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    # all words of the first name, or a whole name: its longest word is in either
    longest = F.get(F.array_sort(tokens(F.col("name")), lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    keys = names.select("seed_id", F.substring(F.coalesce(longest, compact(F.col("name"))), 1, KEY_LETTERS).alias("key")).where("key <> ''").distinct()
    known = [r[0] for r in keys.select("key").distinct().limit(FEW_KEYS + 1).collect()]
    text = compact(F.col("hay"))
    if len(known) <= FEW_KEYS:
        there = F.filter(F.array(*map(F.lit, sorted(known))).cast("array<string>"), lambda k: F.contains(text, k))
    else:
        sizes = sorted(r[0] for r in keys.select(F.length("key")).distinct().collect())  # 1 to KEY_LETTERS

        def runs(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))

        there = F.array_distinct(F.flatten(F.array(*map(runs, sizes))))
    met = hits.select("seq", F.explode(there).alias("key")).join(keys, "key")
    return met.select("seed_id", "seq").distinct()


def identities(seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """seeds (seed_id, seed_name, seed_city, aliases, instagram, facebook: supplied or null) resolved by hits (seq, url, title, snippet) of any search.

    The first hit that is the seed's own site, Instagram profile, Facebook profile or map
    entry gives each of these; identity_sources lists the kinds verified,
    identity_type is the one kind, MULTIPLE or UNRESOLVED, and resolution_path
    tells where it came from. discovered: a hit names the seed at all.
    """
    full = hits.withColumn("hay", F.concat_ws(" ", "title", "snippet", "url"))
    pairs = facing(seeds, full).join(full, "seq").join(seeds, "seed_id")
    url, name, aliases, city = F.col("url"), F.col("seed_name"), F.col("aliases"), F.col("seed_city")
    said = F.concat_ws(" ", "title", "snippet", social_handle(url))
    social = (urls.classify(url) == "SOCIAL") & social_handle(url).isNotNull()
    host = F.coalesce(urls.host(url), F.lit(""))
    given = lambda c: F.coalesce(urls.normalize(F.col(c)) == urls.normalize(url), F.lit(False))
    s = profile_signals(name, aliases, city, url, said, given("instagram") | given("facebook"))
    seen = F.concat_ws(" ", "title", "snippet")
    maps = F.coalesce(urls.is_maps(url), F.lit(False))
    tests = {
        "website": is_own_site(name, city, url, F.coalesce("title", F.lit(""))) & ~maps, "instagram": social & F.contains(host, F.lit("instagram.com")) & is_own_profile(s), "facebook": social & (F.contains(host, F.lit("facebook.com")) | F.contains(host, F.lit("fb.com"))) & is_own_profile(s),
        "google": maps & named(name, aliases, seen) & seen.rlike(LOCATION),
    }
    told = pairs.withColumns({f"is_{k}": F.coalesce(v, F.lit(False)) for k, v in tests.items()} | {"names": named(name, aliases, F.col("hay"))})
    found = told.groupBy(F.col("seed_id").alias("__id")).agg(*[F.min_by(F.when(F.col(f"is_{k}"), F.coalesce(urls.normalize(url), url)), F.when(F.col(f"is_{k}"), F.col("seq"))).alias(f"{k}_url") for k in tests], F.max(F.col("names")).alias("discovered"))
    out = seeds.join(found, F.col("seed_id") == F.col("__id"), "left").drop("__id").withColumn("discovered", F.coalesce("discovered", F.lit(False)))
    sources = F.array_compact(F.array(*[F.when(F.col(f"{k}_url").isNotNull(), label) for k, label, _ in IDENTITIES]))
    path = F.coalesce(*[F.when(F.col(f"{k}_url").isNotNull(), p) for k, _, p in IDENTITIES], F.lit("unresolved"))
    return out.withColumns({"identity_sources": sources, "identity_type": F.when(F.size(sources) > 1, "MULTIPLE").otherwise(F.coalesce(*[F.when(F.array_contains(sources, label), kind) for kind, label in TYPES], F.lit("UNRESOLVED"))), "resolution_path": path, "identity_verified": F.size(sources) > 0})


#: Contacts of a resolved seed that count towards several.
CONTACTS = ("website", "instagram", "facebook", "email", "phone", "google_maps_url")


def seed_counts(resolved: DataFrame) -> DataFrame:
    """One row of the 24 counts of resolved seeds.

    resolved: discovered, official_website_verified, website, instagram,
    facebook, google_maps_url, email, phone, address, google_business_verified,
    identity_verified, identity_sources, model_reached, potential_stockist, stockist_lead, validation, organic_hit.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    lead = F.coalesce(F.col("stockist_lead") == "YES", F.lit(False))
    contacts = sum((has(c).cast("int") for c in CONTACTS), F.lit(0))
    tests = {
        "seeds_found": true("discovered"), "seeds_with_official_website": true("official_website_verified"), "seeds_with_official_instagram": has("instagram"), "seeds_with_official_facebook": has("facebook"),
        "seeds_with_verified_google_business": true("google_business_verified"), "seeds_with_any_verified_identity": true("identity_verified"), "seeds_with_multiple_identity_sources": F.coalesce(F.size("identity_sources") > 1, F.lit(False)), "seeds_reaching_model": true("model_reached"),
        **{f"seeds_stockist_{x.lower()}": F.coalesce(F.col("potential_stockist") == x, F.lit(False)) for x in ("YES", "NO", "UNKNOWN")}, **{f"stockist_leads_{x.lower()}": F.coalesce(F.col("stockist_lead") == x, F.lit(False)) for x in ("YES", "NO", "UNKNOWN")},
        "stockist_leads_with_website": lead & has("website"), "stockist_leads_with_instagram": lead & has("instagram"), "stockist_leads_with_email": lead & has("email"), "stockist_leads_with_phone": lead & has("phone"), "stockist_leads_without_address": lead & ~has("address"),
        "stockist_leads_with_multiple_contacts": lead & (contacts >= 2), "seeds_validation_rejected": F.coalesce(F.col("validation") == "rejected", F.lit(False)), "seeds_without_official_website": ~true("official_website_verified"), "seeds_organic_hits": true("organic_hit"),
    }
    return resolved.agg(F.count(F.lit(1)).alias("seeds_total"), *[F.count_if(t).alias(k) for k, t in tests.items()])


def covered(seeds: DataFrame, leads: DataFrame) -> DataFrame:
    """seeds with whether a lead has their name: the first telling word meets leads by equality, then all words must stand in the name; a seed without telling words meets its own name."""
    keyed = seeds.withColumn("w", F.get(tokens(F.col("seed_name")), F.lit(0)))
    named = leads.select("business_name", F.explode(F.array_distinct(tokens(F.col("business_name")))).alias("w"))
    by_word = keyed.join(named, "w").where(named_in(F.col("seed_name"), F.col("business_name"))).select("seed_id")
    by_name = seeds.select("seed_id", F.lower("seed_name").alias("n")).join(leads.select(F.lower("business_name").alias("n")), "n", "left_semi").select("seed_id")
    hit = by_word.unionByName(by_name).distinct().withColumn("in_leads", F.lit(True))
    return seeds.join(hit, "seed_id", "left").withColumn("in_leads", F.coalesce("in_leads", F.lit(False)))


def metrics(resolved: DataFrame) -> DataFrame:
    """Counts over resolved seeds."""
    return resolved.agg(F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("relation") == "OFFICIAL_WEBSITE").alias("official"), F.count_if("mentioned").alias("mentioned"), F.count_if(F.col("relation") == "UNRESOLVED").alias("unresolved"))
