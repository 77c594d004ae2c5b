"""Phrases that classify businesses, pages and links."""

from __future__ import annotations

# --- fixed values: business types ---------------------------------------------
BOUTIQUE = r"(?i)\b(?:fashion\s+boutique|clothing\s+boutique|designer\s+boutique|women'?s\s+boutique|ladies\s+boutique|boutique)\b"
STORE = r"(?i)\b(?:fashion\s+store|clothing\s+store|designer\s+store|apparel)\b"
MULTI_DESIGNER = r"(?i)\bmulti[\s\-]?designer\b"
MULTI_BRAND = r"(?i)\b(?:multi[\s\-]?brand|concept\s+store|designer\s+collective|stockists? of|brands we carry)\b"
MARKETPLACE = r"(?i)\b(?:marketplace|shop\s+from\s+multiple\s+sellers)\b"
NON_TARGET = r"(?i)\b(?:real\s+estate|hotel|restaurant|salon|spa\b|travel\s+agency|shopping\s+mall|news\s+magazine)\b"
WOMEN_NEGATIVE = r"(?i)\b(?:men'?s\s+only|menswear\s+only|kids\s+only|children'?s\s+clothing|jewellery\s+only|jewelry\s+only|beauty\s+only|home\s+decor)\b"
WOMEN_STRONG = r"(?i)\b(?:women'?s|womens|ladies)\s+(?:\w+\s+){0,2}(?:fashion|clothing|wear|boutique|apparel)\b|\bwomenswear\b"
STORE_LANGUAGE = (
    r"(?i)\b(?:visit\s+us|showroom|store\s+locator|our\s+stores?|physical\s+store|boutique\s+address|walk[\s\-]?in|visit\s+the\s+store|"
    r"flagship\s+store|find\s+us|shop\s+in\s+[A-Za-z]+|book\s+an\s+appointment|store\s+hours|opening\s+hours)\b"
)
ONLINE_ONLY = r"(?i)\b(?:online[\s\-]?only|online[\s\-]?exclusive|no\s+physical\s+store)\b"
DESIGNER = r"(?i)\b(?:fashion\s+designer|designer\s+(?:label|house|brand|collection)|named designer|couture|atelier|bespoke|made[\s\-]?to[\s\-]?measure)\b"
RETAIL = r"(?i)\b(?:retail(?:er)?|department\s+store|chain\s+of\s+stores)\b"
BRAND = r"(?i)\b(?:our\s+(?:label|collection|collections)|own\s+(?:brand|label)|shop\s+the\s+collection)\b"
ECOMMERCE = r"(?i)\b(?:add\s+to\s+cart|buy\s+now|online\s+store|shop\s+now)\b"
FASHION_CATEGORY = r"(?i)\b(?:ready[\s\-]?to[\s\-]?wear|pr[eé]t|ethnic\s+wear|western\s+wear|bridal|sarees?|lehengas?|kurtis?|dresses|womenswear|apparel)\b"
PIN_CODE = r"\b[1-9][0-9]{5}\b"
# --- fixed values: pages and listings -----------------------------------------
LISTICLE_TITLE = (
    r"(?i)\b(?:\d+\s+)?(?:best|top|coolest|cool|stylish)\b.{0,50}\b(?:boutiques?|stores?|shops?)\b|\bboutiques?\s+to\s+visit\b|"
    r"\bshopping\s+(?:in|guide|places)\b|\bdesigners?\s+in\b.{0,40}\bboutiques?\b|\bwhere\s+to\s+shop\b|\bplaces\s+to\s+shop\b|"
    r"\bfashion\s+haven\b|\btravel\s+guide\b|\bshopping\s+advice\b"
)
MEDIA_HOST = r"(?i)(?:times|tribune|news|magazine|digest|vogue|elle|grazia|nodmag)\."
HOTEL = r"(?i)\b(?:hotel|resort|spa\s+resort|heritage\s+village|resort[\s\-&]+spa|hotel[\s\-]?owned|in[\s\-]?house\s+boutique|resort\s+boutique)\b"
MENTION_SIGNALS = ("article_business_link", "article_heading", "external_business_link")
MEDIA_SIGNALS = ("roundup_page", "publisher_not_boutique", "media_page")
# --- fixed values: internal pages, as (role, tokens) in order of precedence ---
PAGE_ROLES = (
    ("contact", ("contact-us", "contact_us", "get-in-touch", "getintouch", "reach-us", "reachus", "contact")),
    ("location", ("store-locator", "storelocator", "showrooms", "showroom", "locations", "location", "visit-us", "visitus", "find-us", "findus", "stores", "store")),
    ("about", ("about-us", "aboutus", "our-story", "ourstory", "who-we-are", "whoweare", "about", "story")),
    ("business", ("boutique", "boutiques", "retail", "stockist", "stockists")),
    ("fashion", ("womenswear", "womens-wear", "ladieswear")),
)
# --- fixed values: page scores, as (tokens, score) ----------------------------
PAGE_SCORES = (
    (("contact-us", "contact_us", "get-in-touch", "getintouch", "reach-us", "reachus", "contact"), 100),
    (("store-locator", "storelocator", "stores", "store"), 94),
    (("locations", "location"), 92),
    (("showrooms", "showroom", "visit-us", "visitus", "find-us", "findus"), 90),
    (("about-us", "aboutus", "our-story", "ourstory", "who-we-are", "whoweare", "about", "story"), 70),
    (("boutique", "boutiques", "retail", "stockist", "stockists"), 55),
)
REJECT_SEGMENTS = (
    "login", "signin", "signup", "register", "cart", "checkout", "account", "wishlist", "search", "privacy", "terms",
    "shipping", "returns", "refund", "products", "product", "collections", "collection", "categories", "category", "item",
    "items", "article", "articles", "blog", "blogs", "p",
)
REJECT_ANCHORS = (
    "home", "homepage", "login", "log in", "sign in", "sign up", "register", "cart", "checkout", "account", "my account",
    "wishlist", "search", "privacy", "privacy policy", "terms", "shipping", "returns", "instagram", "facebook", "youtube",
    "whatsapp", "twitter", "pinterest",
)
ASSET = r"(?i)\.(?:jpe?g|png|gif|svg|webp|pdf|zip|css|js|ico|mp4|woff2?)$"
SOURCE_RANKS = (("homepage_link", 0), ("robots_sitemap", 1), ("sitemap", 2), ("sitemap_index", 2))
HIGH_PAGE, MAX_PAGES = 70, 3
# --- fixed values: research ---------------------------------------------------
RESEARCH_FIELDS = (
    ("address", '"{name}" {city} address'), ("instagram", '"{name}" {city} Instagram'), ("website", '"{name}" {city} website'),
    ("store", '"{name}" {city} store'), ("brands", '"{name}" {city} brands'), ("maps", '"{name}" {city} Google Maps'),
)
GAP_TEMPLATES = ("independent fashion boutique", "multi brand fashion store", "concept store fashion", "resort wear boutique", "independent designers")
RESEARCH_CAPS = {"initial": 24, "enrichment": 18, "expansion": 12, "total": 40, "per_candidate": 2}
LOW_VALUE = r"(?i)\b(?:wholesale|wholesaler|manufacturer|manufacturing|online[\s-]only)\b"
FASHION_WORD = r"(?i)\b(?:fashion|boutique|clothing|apparel|designer|wear|collective)\b"
MULTI_WORD = r"(?i)\b(?:multi[\s-]?brand|multi[\s-]?designer|independent\s+designers?|curated|concept\s+store|collective)\b"
STREET = r"(?i)\b\d{1,4}[^.]{0,50}\b(?:road|rd|street|st|marg|lane|nagar)\b[^.]{0,30}"
BRANDS_KNOWN = r"(?i)\b(?:brands?\s+(?:we\s+)?(?:carry|stock)|designers?\s+we\s+(?:carry|stock)|brand\s+lineup|labels?\s+we\s+stock)\b"
# --- fixed values: what a homepage shows already ------------------------------
HOME_WOMEN = (
    r"(?i)\b(?:women'?s\s+(?:clothing|fashion|wear|boutique|apparel|store)|womenswear|ladies\s+(?:clothing|wear|boutique|garments)|"
    r"women\s+dresses|women\s+tops|women\s+apparel)\b"
)
HOME_GOODS = r"(?i)\b(?:dresses|tops|skirts|sarees|sari|lehengas?|ethnic\s+wear|kurtis?|women'?s\s+collections?)\b"
HOME_VISIT = (
    r"(?i)\b(?:visit\s+us|showroom|store\s+locator|our\s+stores?|physical\s+store|boutique\s+address|walk[\s\-]?in|visit\s+the\s+store|"
    r"flagship\s+store|find\s+us|shop\s+in\s+[A-Z][a-z]+|book\s+an\s+appointment|store\s+hours|opening\s+hours)\b"
)
STORE_TYPES = ("localbusiness", "store", "clothingstore", "fashionstore")
RETAIL_TYPES = (*STORE_TYPES, "shoestore", "jewelrystore")
AREAS = ("Bandra", "Khar", "Colaba")
LOCATION_PATHS = ("pages", "store", "stores", "our-store", "our-stores", "location", "locations", "showroom", "showrooms", "store-locator", "storelocator", "visit-us", "find-us", "reach-us", "reachus")
