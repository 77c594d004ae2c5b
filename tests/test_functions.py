from pyspark.sql import functions as F

from waymark.functions import html, text, urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_normalize(spark):
    cases = {
        "HTTP://www.Example.com:80/a/b/?utm_source=x&b=2&a=1#top": "https://example.com/a/b?a=1&b=2",
        "example.com": "https://example.com", "https://shop.example.com/": "https://shop.example.com", "https://x.com:8443/p": "https://x.com:8443/p",
        "https://x.com:99999/": None, "ftp://x.com": None, "": None, "mailto:a@b": None, "//x.com/p": None, "https://x.com/a;v=1?gclid=3": "https://x.com/a", "https://x.com/?q=a+b": "https://x.com?q=a+b",
    }
    for url, want in cases.items():
        assert one(spark, url, urls.normalize) == want, url


def test_normalize_twice(spark):
    for url in ("http://www.a.org/x/?b=%20c&a=~*", "https://a.org/é?x=é"):
        once = one(spark, url, urls.normalize)
        assert one(spark, once, urls.normalize) == once


def test_classify(spark):
    cases = {
        "https://youtu.be/x": "VIDEO", "https://www.instagram.com/x": "SOCIAL", "https://goo.gl/x": "DIRECTORY", "https://www.google.de/maps/place": "DIRECTORY",
        "https://google.com/search?q=1": "DIRECTORY", "https://sub.medium.com/p": "ARTICLE", "https://a.com/blog/x": "ARTICLE", "https://notinstagram.com": "WEBSITE", "": "UNKNOWN",
    }
    for url, want in cases.items():
        assert one(spark, url, urls.classify) == want, url


def test_identity_keys(spark):
    assert one(spark, "@Shop.One", urls.key_instagram) == "shop.one"
    assert one(spark, "https://instagram.com/Shop/", urls.key_instagram) == "shop"
    assert one(spark, "https://notinstagram.com/shop", urls.key_instagram) is None
    assert one(spark, "+91 98-76", urls.key_phone) == "919876"
    assert one(spark, "none", urls.key_phone) is None


def test_usefulness_prefers_homepages(spark):
    values = [one(spark, u, urls.usefulness) for u in ("https://a.com/", "https://a.com/contact", "https://a.com/x/y/z", "http://a.com/x/y/z?q=1")]
    assert values == sorted(values, reverse=True) and values[0] == 105


def test_signals(spark):
    assert one(spark, "Mail A.B@c.Org now", text.emails) == ["a.b@c.org"]
    assert one(spark, "call +91 98765 43210 or 12 34 56 78 90", text.phones) == ["+91 98765 43210"]
    found = one(spark, "Visit 12 Hill Road today. It costs Rs 500 on Hill Road 12. Find us at Goa 403001.", text.addresses)
    assert found == ["Visit 12 Hill Road today.", "Find us at Goa 403001."]
    assert one(spark, "In Goa and mumbai, not goan", lambda c: text.mentions(c, ("Mumbai", "Goa", "Delhi"))) == ["Mumbai", "Goa"]


def test_long_texts_are_not_put_into_upper_case_and_terms_are_met_by_parts_first(spark):
    values = [None, "", "  ", "unknown", " Unknown ", "UNKNOWN!", "UNKNOWN" * 9, "x" * 9, "ŉknown", "ß"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.r for r in df.select(text.present(F.col("v")).alias("r")).collect()] == [False] * 5 + [True] * 5
    plan = df.select(text.present(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(substring(" in plan and "upper(trim(" not in plan
    assert one(spark, "ΟΔΟΣ, São, NAVI MUMBAI, goaé, İgoa", lambda c: text.mentions(c, ("Mumbai", "Goa", "ΟΔΟΣ", "São"))) == ["Mumbai", "ΟΔΟΣ", "São"]
    assert one(spark, None, lambda c: text.mentions(c, ("Goa",))) == []
    found = df.select(text.mentions(F.col("v"), ("Goa",)))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" in found.lower()


def test_clean_name(spark):
    cases = {
        "Rose Studio | Women's Fashion": "Rose Studio", "Home": "UNKNOWN", "10 best boutiques in Goa": "UNKNOWN", "  Ahi   (@ahi) ": "Ahi", "Mira ladies boutique": "Mira",
        "Download the app": "UNKNOWN", "a": "UNKNOWN", None: "UNKNOWN", "one two three four five six seven eight nine": "UNKNOWN",
    }
    for raw, want in cases.items():
        assert one(spark, raw, text.clean_name) == want, raw


def test_word_boundaries_are_ascii(spark):
    names = spark.createDataFrame([("Ver übest mit ladies boutique",), ("Abest mit ladies boutique",), ("Bazar über",)], "v string")
    assert [r.r for r in names.select(text.clean_name(F.col("v")).alias("r")).collect()] == ["UNKNOWN", "Abest mit", "Bazar über"]
    assert one(spark, "Rose élogin", text.clean_name) == "UNKNOWN" and one(spark, "Rose elogin", text.clean_name) == "Rose elogin"


def test_page_parts(spark):
    page = '<html><title>A &amp; B</title><h1> One </h1><nav>x</nav><a href="/c">c</a><a href="mailto:q@r.s">m</a><script>no()</script><p>Two&nbsp;three</p></html>'
    assert one(spark, page, html.title) == "A & B"
    assert one(spark, page, html.headings) == ["One"]
    assert one(spark, page, html.hrefs) == ["/c"]
    assert one(spark, page, html.mail_and_phone_targets) == ["q@r.s"]
    assert "no()" not in one(spark, page, html.visible_text)
