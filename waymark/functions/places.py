"""Place catalogue and query vocabulary: configuration, passed to operators as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: places, as (city, state, country, aliases, localities) ----
PLACES = (
    ("Goa", "Goa", "India", ("goa", "north goa", "south goa"), (
        "panaji", "panjim", "anjuna", "assagao", "vagator", "morjim", "mapusa", "margao", "madgaon", "candolim",
        "calangute", "parra", "aldona", "arossim", "cansaulim", "bardez", "siolim", "arpora", "baga", "fontainhas",
        "saligao", "palolem", "benaulim", "colva", "canacona",
    )),
    ("Mumbai", "Maharashtra", "India", ("mumbai", "bombay"), (
        "bandra", "khar", "colaba", "juhu", "worli", "lower parel", "kemp's corner", "kemps corner", "andheri", "powai",
        "bkc", "santacruz", "santa cruz", "versova", "marine drive",
    )),
    ("Delhi", "Delhi", "India", ("delhi", "new delhi"), (
        "hauz khas", "meherchand market", "shahpur jat", "khan market", "connaught place", "defence colony",
        "greater kailash", "gk 1", "gk 2", "lodhi", "mehrauli", "vasant vihar", "saket", "chanakyapuri",
    )),
    ("Bengaluru", "Karnataka", "India", ("bengaluru", "bangalore"), (
        "indiranagar", "koramangala", "ub city", "lavelle road", "jayanagar", "whitefield", "mg road",
        "commercial street", "sadashivanagar",
    )),
    ("Jaipur", "Rajasthan", "India", ("jaipur",), (
        "c-scheme", "c scheme", "malviya nagar", "vaishali nagar", "raja park", "bani park", "pink city", "mi road",
    )),
    ("Hyderabad", "Telangana", "India", ("hyderabad",), ("banjara hills", "jubilee hills", "gachibowli", "hitech city")),
    ("Pune", "Maharashtra", "India", ("pune",), ("koregaon park", "kalyani nagar", "fc road")),
    ("Chennai", "Tamil Nadu", "India", ("chennai", "madras"), ("alwarpet", "nungambakkam", "besant nagar", "adyar")),
    ("Kolkata", "West Bengal", "India", ("kolkata", "calcutta"), ("park street", "hindustan park", "ballygunge", "camac street")),
    ("Ahmedabad", "Gujarat", "India", ("ahmedabad", "amdavad"), ("cg road", "navrangpura", "satellite", "vastrapur")),
)
# --- fixed values: query templates by family ---------------------------------
FAMILIES = {
    "retail_identity": (
        "multi brand fashion store", "multi brand boutique", "multi designer fashion store", "multi designer boutique",
        "independent fashion boutique", "independent clothing store", "curated fashion store", "curated clothing store",
        "designer boutique", "designer fashion store", "concept store fashion", "fashion concept store",
        "designer collective", "fashion collective", "independent designer store", "lifestyle store fashion",
        "resort wear boutique", "fashion showroom",
    ),
    "positioning": (
        "Indian designers fashion store", "emerging Indian designers store", "independent Indian labels store",
        "curated Indian fashion store", "slow fashion store", "sustainable fashion boutique", "conscious fashion store",
        "artisan fashion store", "handcrafted fashion store", "handloom clothing store", "linen clothing store",
        "natural fabric fashion store", "block print clothing store", "resort wear fashion store",
        "independent womenswear store", "contemporary Indian womenswear store",
    ),
    "discovery_language": (
        "where to shop independent Indian designers", "where to shop Indian designer clothing",
        "best independent fashion stores", "best multi brand fashion stores", "best multi designer stores",
        "best curated fashion stores", "best concept stores fashion", "fashion shopping independent designers",
        "indie fashion stores", "independent clothing shops", "unique clothing stores", "curated clothing shops",
        "designer shops", "fashion destinations", "village shops fashion",
    ),
    "physical_retail": (
        '"visit us" fashion store', '"our store" fashion', '"store location" fashion', '"find us" boutique',
        '"opening hours" fashion store', '"physical store" fashion', '"shop address" fashion', '"retail store" fashion',
        '"showroom" fashion boutique',
    ),
    "editorial": (
        "fashion boutiques to visit", "independent fashion stores guide", "designer stores guide",
        "where to shop fashion", "indie boutique guide", "fashion shopping guide", "best shops for Indian designers",
    ),
}
PRODUCTION_FAMILIES = ("retail_identity", "positioning", "discovery_language")
SAMPLED_FAMILIES = ("physical_retail", "editorial")
FAMILY_ALIASES = {"physical_store": "physical_retail", "contextual": "discovery_language"}
MAX_QUERIES, SAMPLED_LOCALITIES = 80, 6
#: Cities of a small batch over several cities, in order.
SAMPLE_CITIES = ("Goa", "Mumbai", "Delhi", "Bengaluru", "Jaipur")


def places(spark: SparkSession) -> DataFrame:
    """One row for each place of the catalogue."""
    rows = [(i, *p[:3], list(p[3]), list(p[4])) for i, p in enumerate(PLACES)]
    return spark.createDataFrame(rows, "ord int, city string, state string, country string, aliases array<string>, localities array<string>")


def templates(spark: SparkSession, families: tuple[str, ...] = PRODUCTION_FAMILIES) -> DataFrame:
    """One row for each template: family (by its name or an older one), its rank, the template and its place in the family."""
    families = tuple(FAMILY_ALIASES.get(f, f) for f in families)
    unknown = [f for f in families if f not in FAMILIES]
    if unknown:
        raise KeyError(f"unknown families: {unknown}")
    rows = [(f, i, t, j) for i, f in enumerate(dict.fromkeys(families)) for j, t in enumerate(FAMILIES[f])]
    return spark.createDataFrame(rows, "family string, family_ord int, template string, template_ord int")
