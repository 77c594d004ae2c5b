"""Word lists, patterns and points that results depend on.

Operators generate column expressions from these tables; a new market or rule
is a new row here or a table passed to the operator, not new code.
"""

from __future__ import annotations

# --- fixed values: URLs ------------------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = (
    "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "twclid", "yclid", "mc_cid", "mc_eid", "igshid", "igsh", "_ga",
    "_gl", "_hsenc", "_hsmi", "ref", "referrer", "spm", "scm", "si", "ncid", "icid", "mkt_tok",
)
SOCIAL_DOMAINS = (
    "instagram.com", "facebook.com", "fb.com", "fb.me", "twitter.com", "x.com", "linkedin.com", "pinterest.com",
    "pinterest.co.uk", "tiktok.com", "threads.net", "reddit.com",
)
VIDEO_DOMAINS = ("youtube.com", "youtu.be", "m.youtube.com", "vimeo.com", "dailymotion.com")
DIRECTORY_DOMAINS = (
    "justdial.com", "sulekha.com", "indiamart.com", "tradeindia.com", "lbb.in", "wanderlog.com", "tripadvisor.com",
    "tripadvisor.in", "yelp.com", "timeout.com", "magicpin.in", "near.in", "asklaila.com", "yellowpages.com",
    "yellowpages.in", "foursquare.com", "zomato.com", "urbancompany.com", "craftsvilla.com", "nykaa.com", "amazon.in",
    "amazon.com", "flipkart.com", "maps.google.com", "goo.gl", "airbnb.com", "booking.com", "shopee.com", "shopee.in",
    "superstock.com", "shutterstock.com", "gettyimages.com", "unsplash.com", "pexels.com", "alamy.com", "etsy.com",
    "ebay.com", "ebay.in", "myntra.com", "ajio.com", "meesho.com", "bizgoa.com", "bizgoa.in", "makemytrip.com",
    "goibibo.com", "yatra.com", "wheree.com",
)
ARTICLE_DOMAINS = (
    "medium.com", "wikipedia.org", "en.wikipedia.org", "timesofindia.indiatimes.com", "indianexpress.com", "ndtv.com",
    "hindustantimes.com", "vogue.in", "vogue.com", "elle.in", "elle.com", "grazia.co.in", "lifestyleasia.com",
    "architecturaldigest.in", "architecturaldigest.com", "gomantaktimes.com", "cnn.com", "bbc.com", "bbc.co.uk",
    "theguardian.com", "blogspot.com",
)
ARTICLE_PATH = (
    r"/(?:blogs?|articles?|stories|story|travel-guides?)/|shopping-in-|designers?-in-|boutiques?-to-visit|"
    r"places-to-(?:shop|visit)|/my-goa/"
)
FOREIGN_TLDS = ("ie", "uk", "us", "au", "nz", "de", "fr", "it", "es", "ae", "sg", "ca")
SOCIAL_POST_PATH = r"/(?:reel|reels|p|tv|stories|share|posts|photos|watch)/"
USEFUL_PATH_TOKENS = ("/about", "/contact", "/store", "/shop", "/boutique")

# --- fixed values: contact signals -------------------------------------------
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+|00)?(?:91[\s\-()]*)?(?:[0-9][\s\-()]*){9,14}[0-9]"
PIN_CODE = r"[1-9][0-9]{5}"
ADDRESS_WORDS = (
    "road", "rd", "street", "st", "marg", "nagar", "lane", "avenue", "cross", "bazar", "market", "complex", "plaza",
    "floor", "unit", "bandra", "andheri", "colaba", "fort", "pincode",
)
PRICE_NOISE = r"(?i)unit\s+price|regular\s+price|quick\s+view|add(?:ed)?\s+to\s+cart|(?:₹|\$|(?:^|[^A-Za-z])rs\.?)\s*[0-9,]+(?:\.[0-9]{2})?"
CITY_NAMES = (
    "Mumbai", "Delhi", "New Delhi", "Bengaluru", "Bangalore", "Hyderabad", "Chennai", "Kolkata", "Pune", "Ahmedabad",
    "Jaipur", "Surat", "Goa", "Navi Mumbai", "Thane", "Bandra", "Khar", "Colaba",
)
MAX_SIGNALS, MAX_HEADINGS, MAX_LINKS, MAX_TEXT = 30, 40, 200, 50_000

# --- fixed values: fit signals, as (pattern, points, label) ------------------
PHYSICAL_SIGNALS = (
    (r"\b\d{1,4}[,\s]+[A-Za-z].{0,40}\b(?:road|rd|street|st|marg|lane|avenue|nagar)\b", 5, "explicit physical address"),
    (r"\b(?:shop|store)\s+(?:no|number|#)\s*\d+", 5, "explicit physical address"),
    (r"\b[1-9]\d{5}\b", 5, "explicit physical address"),
    (r"\b(?:our\s+store|store\s+location|visit\s+our\s+(?:store|boutique)|find\s+us\s+at)\b", 4, "dedicated store page"),
    (r"\b(?:google\s+maps|maps\.google|goo\.gl/maps)\b", 3, "maps listing"),
    (r"\b(?:opening\s+hours|store\s+hours|open\s+(?:daily|today)|mon(?:day)?\s*[-–]\s*sun)", 2, "opening hours"),
    (r"\b(?:visit\s+us|walk[\s-]in|come\s+visit)\b", 2, "visit us"),
    (r"\b(?:store\s+photographs|inside\s+the\s+(?:store|boutique)|boutique\s+interior)\b", 2, "store photographs"),
    (r"\b(?:\+91[\s-]?)?[6-9]\d{9}\b", 1, "phone number"),
)
MULTI_BRAND_SIGNALS = (
    (r"\b(?:stocks?|carries|carrying|home\s+to)\s+(?:multiple|many|several|\d{2,})\s+(?:designers?|brands?|labels?)", 6, "stocks multiple designers"),
    (r"\b(?:designers?|brands?|labels?)\s+we\s+(?:carry|stock)\b", 4, "designer list"),
    (r"\bcurated\s+(?:selection|edit|collection|store)\b", 3, "curated selection"),
    (r"\bindependent\s+designers?\b", 3, "independent designers"),
    (r"\bmultiple\s+labels?\b", 2, "multiple labels"),
    (r"\bdesigner\s+collective\b", 2, "designer collective"),
    (r"\bconcept[\s-]store\b", 1, "concept store positioning"),
)
CONCEPT_SIGNALS = (
    (r"\bconcept[\s-]store\b", 4, "concept store"),
    (r"\bcurated\s+(?:fashion|lifestyle|store|boutique)\b", 3, "curated store"),
    (r"\bdesigner\s+collective\b", 3, "designer collective"),
    (r"\blifestyle\s+store\b", 2, "lifestyle store"),
)
FIT_SIGNALS = (
    (r"\b(?:women'?s|womens)\s+(?:contemporary|fashion|clothing|wear)\b", 4, "women's contemporary fashion"),
    (r"\bcontemporary\s+(?:women'?s\s+)?(?:fashion|clothing)\b", 4, "women's contemporary fashion"),
    (r"\bindependent\s+designers?\b", 3, "independent designers"),
    (r"\b(?:slow[\s-]fashion|sustainable\s+fashion|conscious\s+fashion)\b", 3, "slow or sustainable fashion"),
    (r"\b(?:linen|natural\s+fabrics?|handloom\s+cotton|organic\s+cotton)\b", 2, "natural fabrics"),
    (r"\b(?:indian\s+craft|craftsmanship|handcrafted|artisanal)\b", 2, "Indian craftsmanship"),
    (r"\bresort(?:\s+and\s+vacation)?\s+fashion\b|\bvacation\s+wear\b", 2, "resort fashion"),
    (r"\b(?:curated|premium)\s+(?:boutique|fashion|edit|positioning|store)\b", 2, "curated premium positioning"),
)
FASHION_SIGNALS = (
    (r"\b(?:women'?s|womens)\s+(?:\w+\s+){0,3}(?:fashion|clothing|wear|boutique)\b", 4, "women's fashion"),
    (r"\b(?:fashion|clothing)\s+boutique\b", 3, "fashion boutique"),
    (r"\b(?:designer\s+(?:wear|clothing|boutique|store)|contemporary\s+fashion)\b", 3, "designer fashion"),
    (r"\b(?:apparel|ready[\s-]to[\s-]wear|rtw)\b", 2, "apparel"),
)
EXCLUSION_SIGNALS = (
    (r"\b(?:online[\s-]only|online[\s-]exclusive|no\s+physical\s+(?:store|shop))\b", "online-only"),
    (r"\b(?:wholesale[\s-]only|wholesaler\s+only|b2b\s+only)\b", "wholesale-only"),
    (r"\b(?:only\s+our\s+(?:own\s+)?(?:brand|label)|own[\s-]label\s+only|mono[\s-]brand|we\s+only\s+sell\s+our\s+own)\b", "own-brand-only"),
    (r"\b(?:bridal[\s-]only|only\s+bridal|wedding\s+lehenga\s+specialist)\b", "bridal-only"),
    (r"\b(?:saree[\s-]only|only\s+sarees|sarees\s+exclusively)\b", "saree-only"),
    (r"\b(?:tailoring[\s-]only|only\s+tailoring|alterations\s+only)\b", "tailoring-only"),
    (r"\b(?:accessories[\s-]only|jewellery\s+only|jewelry\s+only)\b", "accessories-only"),
    (r"\b(?:mass[\s-]market|fast\s+fashion\s+chain)\b", "mass-market"),
    (r"\b(?:real\s+estate|restaurant|salon\s+only|travel\s+agency|not\s+a\s+(?:fashion\s+)?retailer)\b", "unrelated"),
)
RETAIL_MODELS = (
    (r"\bmulti[\s-]brand\b", "multi-brand"),
    (r"\bmulti[\s-]designer\b|\bstocks?\s+(?:multiple|many)\s+designers?\b", "multi-brand"),
    (r"\bconcept[\s-]store\b", "concept store"),
    (r"\bdesigner\s+collective\b", "designer collective"),
    (r"\bcurated\b", "curated store"),
    (r"\blifestyle\s+store\b", "lifestyle store"),
    (r"\bdesigner\s+boutique\b", "designer boutique"),
    (r"\bresort\s+boutique\b|\bhotel\s+boutique\b", "resort boutique"),
    (r"\b(?:only\s+our\s+(?:own\s+)?brand|own[\s-]label\s+only)\b", "own-brand only"),
)
FIT_BANDS = ((6, "HIGH"), (3, "MEDIUM"), (1, "LOW"))
FASHION_BANDS = ((4, "HIGH"), (2, "MEDIUM"), (1, "LOW"))

# --- fixed values: names -----------------------------------------------------
GENERIC_NAMES = (
    "home", "welcome", "shop", "shop now", "store", "stores", "boutique", "boutiques", "fashion", "women's fashion",
    "womens fashion", "clothing", "contact", "about", "about us", "menu", "search", "download the app",
    "download the app!", "get the app", "sign in", "subscribe", "homepage", "contact us", "contact information",
    "get in touch", "locations", "our stores", "order summary", "shopping cart", "country/region",
    "follow on instagram", "media coverage", "franchisee", "shipping", "create free account now", "disclaimer", "cart",
    "checkout", "bag", "your bag", "wishlist", "payment", "thank you", "new arrivals", "best sellers", "sale",
    "collections", "collection", "dresses", "tops", "skirts", "women", "women's", "ladies", "store locator",
    "our story",
)
CATEGORY_NAMES = (
    "new arrivals", "best sellers", "bestseller", "bestsellers", "sale", "shop sale", "dresses", "tops", "skirts",
    "collections", "collection", "women", "women's", "womens", "ladies", "shop women", "shop men's", "shop mens",
)
NAVIGATION_NAMES = (
    "home", "login", "log in", "sign up", "signup", "register", "search", "privacy", "privacy policy", "terms", "menu",
    "more", "read more", "learn more", "view", "website", "map", "maps", "cart", "account", "checkout",
)
CHROME_NAME = (
    r"\b(?:cart|checkout|order summary|shopping cart|item added|added to (?:your )?cart|my account|please login|"
    r"wishlist|order confirmation|login|register|your bag|thank you for (?:your )?order|payment successful)\b"
)
ROUNDUP_TITLE = (
    r"\b(?:\d+\s+)?(?:best|top|coolest|cool|stylish)\b.{0,50}\b(?:boutique|boutiques|stores?|shops?)\b|"
    r"\bboutiques?\s+to\s+visit\b|\bshopping\s+(?:in|guide)\b|\bdesigners?\s+in\b.{0,40}\bboutiques?\b|"
    r"\bwhere\s+to\s+shop\b|\b\d+\s+best\b|\bboutiques?\s+in\s+[A-Za-z]"
)
ARTICLE_NAME = r"^\s*\d+\s+(?:best|top|coolest)\b|\b(?:how to|guide to|things to|places to visit|boutiques? in)\b"
