"""Page parts by column expressions: title, headings, links, visible text, linked data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import ordered_distinct, squeeze

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    """The common character references; ``&amp;`` last."""
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(html, r"<[^>]*>", " ")))


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by name or property, null if absent."""
    found = F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    return F.nullif(squeeze(decode_entities(found)), F.lit(""))


def title(html: Column) -> Column:
    """og:title, else the title element."""
    own = F.nullif(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.coalesce(meta(html, "og:title"), own)


def description(html: Column) -> Column:
    return F.coalesce(meta(html, "description"), meta(html, "og:description"))


def brand(html: Column) -> Column:
    return F.coalesce(*[meta(html, n) for n in ("application-name", "apple-mobile-web-app-title", "publisher", "og:brand")])


def headings(html: Column, limit: int = rules.MAX_HEADINGS) -> Column:
    """Texts of h1 to h3, in order."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), 1)
    return F.slice(F.filter(F.transform(raw, strip_tags), lambda x: x != ""), 1, limit)


def hrefs(html: Column, limit: int = rules.MAX_LINKS) -> Column:
    """Distinct link targets in order; mail, phone and script targets left out."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"']"), 1)
    kept = F.filter(raw, lambda x: (x != "") & ~x.rlike(r"(?i)^(?:mailto|tel|javascript|#)"))
    return F.slice(F.array_distinct(kept), 1, limit)


def mail_and_phone_targets(html: Column) -> Column:
    return ordered_distinct(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"'](?:mailto|tel):([^\"'?]*)"), 1))


def visible_text(html: Column, limit: int = rules.MAX_TEXT) -> Column:
    """Text without scripts, styles, navigation and cookie notices."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|svg|template|iframe|nav)\b[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?is)<(\w+)[^>]*(?:id|class)=[\"'][^\"']*(?:cookie|consent)[^\"']*[\"'][^>]*>.*?</\1>", " ")
    return F.substring(strip_tags(bare), 1, limit)


def linked_data(html: Column) -> Column:
    """JSON-LD blocks as VARIANT values; broken ones are left out."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    bare = F.transform(raw, lambda x: F.regexp_replace(x, r"(?s)^\s*(?:<!--|<!\[CDATA\[)|(?:-->|\]\]>)\s*$", ""))
    return F.filter(F.transform(bare, F.try_parse_json), lambda x: x.isNotNull())
