"""Configuration: shapes checked on the driver, references between files by anti joins; robots rules."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE_TYPES = ("city", "region", "country")


class ConfigError(ValueError):
    """What is wrong with a configuration, a line for each problem."""


def read_json(path: str):
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e


def check_places(places: list[dict]) -> list[str]:
    """Problems of place entries: missing keys, unknown types, boxes that aren't south, west, north, east, repeated keys."""
    problems, seen = [], set()
    for i, p in enumerate(places):
        label = p.get("key", f"entry {i}")
        problems += [f"{label}: no {k}" for k in ("key", "name", "type", "country") if not p.get(k)]
        if p.get("type") not in PLACE_TYPES:
            problems.append(f"{label}: type must be one of {', '.join(PLACE_TYPES)}")
        box = p.get("bbox")
        if box is not None and not (len(box) == 4 and -90 <= box[0] < box[2] <= 90 and -180 <= box[1] < box[3] <= 180):
            problems.append(f"{label}: bbox must be south, west, north, east")
        if label in seen:
            problems.append(f"{label}: key is used twice")
        seen.add(label)
    return problems


def cross_problems(places: DataFrame, markets: DataFrame, bands: DataFrame) -> DataFrame:
    """(problem): places whose country no market has, or whose language the market has no words for; markets without a price band in their currency.

    places: key, country, languages. markets: market, countries, languages, currency. bands: market, currency.
    """
    of_country = markets.select("market", F.col("languages").alias("spoken"), F.explode("countries").alias("country"))
    joined = places.join(of_country, "country", "left")
    lost = joined.where("market IS NULL").select(F.concat(F.col("key"), F.lit(": no market covers "), F.col("country")).alias("problem"))
    words = joined.where("market IS NOT NULL").select("key", "market", "spoken", F.explode("languages").alias("language")).where("NOT array_contains(spoken, language)")
    mute = words.select(F.concat(F.col("key"), F.lit(": market "), F.col("market"), F.lit(" has no words in "), F.col("language")).alias("problem"))
    priced = markets.select("market", "currency").join(bands.select("market", F.col("currency").alias("band")), "market", "left")
    unpriced = priced.where("band IS NULL OR band <> currency").select(F.concat(F.lit("market "), F.col("market"), F.when(F.col("band").isNull(), F.lit(": no price band")).otherwise(F.concat(F.lit(": price band is in "), F.col("band"), F.lit(", not "), F.col("currency")))).alias("problem"))
    return lost.unionByName(mute).unionByName(unpriced)


def provider_status(enabled: Column, key_set: Column, needs_key: Column) -> Column:
    """struct(active, reason) of a provider."""
    reason = F.when(~enabled, "disabled in the configuration").when(needs_key & ~key_set, "no key in the environment").otherwise("ready")
    return F.struct((reason == "ready").alias("active"), reason.alias("reason"))


def robots_allow(text: str | None, status: int | None, url: str, agent: str = "waymark") -> bool:
    """Whether robots rules let an agent read a URL; a missing or unreadable file allows everything."""
    if text is None or status is None or status >= 400:
        return True
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser.can_fetch(agent, url)


def http_kind(url: Column) -> Column:
    """robots, sitemap or html."""
    low = F.lower(url)
    return F.when(low.endswith("/robots.txt"), "robots").when(low.rlike(r"sitemap[^/]*\.xml|\.xml(?:\.gz)?$"), "sitemap").otherwise("html")
