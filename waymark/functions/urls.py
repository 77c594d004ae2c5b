"""URLs and identity keys as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_PORT = r"0*(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5][0-9]{4}|[0-9]{1,4})"
#: scheme, host, port, path, query; a URL without a scheme has https, and ``name:`` before no ``//`` is another scheme
_SHAPE = rf"(?i)^\s*(?:(https?)://|(?![a-z][a-z0-9+.-]*:|//))(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::({_PORT})?)?(/[^?#;]*)?(?:;[^?#]*)?(?:\?([^#]*?))?(?:#.*)?\s*$"


def part(url: Column, group: int) -> Column:
    """Group of an http URL (1 scheme, 2 host, 3 port, 4 path, 5 query); empty if the URL is none, or lacks the part."""
    return F.regexp_extract(url, _SHAPE, group)


def host(url: Column) -> Column:
    """Host in lower case, null if the URL has none or isn't an http URL."""
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def domain(url: Column) -> Column:
    """Host in lower case without one leading ``www.``; other subdomains stay."""
    return F.nullif(F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return part(url, 4)


def is_tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*rules.TRACKING_PARAMS) | low.startswith(rules.TRACKING_PREFIX)


def _query(url: Column) -> Column:
    """Pairs of the query without tracking ones, sorted, encoded anew."""

    def plain(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    def code(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    def pair(x: Column) -> Column:
        return F.struct(plain(F.substring_index(x, "=", 1)).alias("k"), plain(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v"))

    pairs = F.transform(F.filter(F.split(part(url, 5), "&"), lambda x: x != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p["k"])))
    return F.array_join(F.transform(kept, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")


def normalize(url: Column) -> Column:
    """Comparable form: https, no www, no default port, fragment or tracking parameters, other parameters sorted."""
    port = F.regexp_replace(part(url, 3), "^0+", "")
    shown = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    asked = F.when(part(url, 5) != "", F.regexp_replace(F.concat(F.lit("?"), _query(url)), r"^\?$", "")).otherwise("")
    return F.concat(F.lit("https://"), domain(url), shown, F.regexp_replace(path(url), "/+$", ""), asked)


def suffixes(name: Column) -> Column:
    """A host and all its parent domains."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_catalog(name: Column, catalog: Sequence[str]) -> Column:
    """Whether a host is in the catalog or below one of its domains."""
    return F.coalesce(F.arrays_overlap(suffixes(name), F.array(*map(F.lit, catalog))), F.lit(False))


def same_site(a: Column, b: Column) -> Column:
    x, y = domain(a), domain(b)
    return F.coalesce((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)), F.lit(False))


def is_maps(url: Column) -> Column:
    d, p = domain(url), F.lower(path(url))
    at_maps = p.startswith("/maps")
    return F.coalesce(d.isin("maps.google.com", "maps.google.co.in") | (at_maps & ((d == "goo.gl") | host(url).contains("google."))), F.lit(False))


def classify(url: Column) -> Column:
    """WEBSITE, SOCIAL, DIRECTORY, ARTICLE, VIDEO or UNKNOWN, by host and path."""
    d, p = domain(url), F.lower(path(url))
    return (
        F.when(d.isNull(), "UNKNOWN")
        .when(in_catalog(d, rules.VIDEO_DOMAINS), "VIDEO")
        .when(in_catalog(d, rules.SOCIAL_DOMAINS), "SOCIAL")
        .when(in_catalog(d, rules.DIRECTORY_DOMAINS) | is_maps(url) | ((d == "google.com") & p.startswith("/search")), "DIRECTORY")
        .when(in_catalog(d, rules.ARTICLE_DOMAINS) | p.rlike(rules.ARTICLE_PATH), "ARTICLE")
        .otherwise("WEBSITE")
    )


def usefulness(url: Column) -> Column:
    """Higher for homepages and short paths, then for pages about the shop; less with a query, more with https."""
    p = F.coalesce(path(url), F.lit(""))
    bare = F.lower(F.regexp_replace(p, "^/+|/+$", ""))
    home = bare.isin("", "index", "index.html", "home")
    segments = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    shop = reduce(lambda a, b: a | b, [F.lower(p).contains(t) for t in rules.USEFUL_PATH_TOKENS])
    deep = F.greatest(F.lit(0), F.lit(40) - segments * 8) - F.least(F.length(p), F.lit(40)) + F.when(shop, 15).otherwise(0)
    query = F.when(F.coalesce(part(url, 5), F.lit("")) != "", 10).otherwise(0)
    return (F.when(home, 100).otherwise(deep) - query + F.when(F.lower(part(url, 1)) != "http", 5).otherwise(0)).cast("int")


def is_social_post(url: Column) -> Column:
    d = domain(url)
    return F.coalesce((in_catalog(d, ("instagram.com", "facebook.com", "fb.com"))) & F.concat(F.lower(path(url)), F.lit("/")).rlike(rules.SOCIAL_POST_PATH), F.lit(False))


def foreign_tld(url: Column) -> Column:
    return F.coalesce(host(url).rlike(r"\.(?:" + "|".join(rules.FOREIGN_TLDS) + ")$"), F.lit(False))


# identity keys, each null where the field gives none


def key_domain(website: Column) -> Column:
    return domain(website)


def key_instagram(value: Column) -> Column:
    """User name of ``@name``, a bare name, or a URL of that site alone."""
    v = F.lower(F.btrim(value))
    is_url = v.contains("/") | v.rlike(r"^(?:www\.)?instagram\.com")
    name = F.regexp_extract(F.lower(path(v)), "^/([^/]+)", 1)
    of_site = domain(v) == "instagram.com"
    return F.nullif(F.when(is_url, F.when(of_site, name)).otherwise(F.regexp_replace(v, "^@", "")), F.lit(""))


def key_phone(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value, "[^0-9]", ""), F.lit(""))


def key_name_city(name: Column, city: Column) -> Column:
    from .text import present, squeeze

    return F.when(present(name) & present(city), F.concat_ws("|", F.lower(squeeze(name)), F.lower(squeeze(city))))
