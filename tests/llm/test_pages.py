"""Page text against a brute-force version of the line blocks and against planted articles."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from fixtures import words  # noqa: E402

from waymark.llm import html  # noqa: E402

LONG = "This paragraph is part of the article and is long enough to be over the threshold."


def brute_stretches(weights, window):
    """Line i is in a stretch if a run of windows with text, each starting in sight of the next, covers it."""
    n = len(weights)
    sums = [sum(weights[j] for j in range(i, i + window) if j < n) for i in range(n)]
    out = []
    for a in range(n):
        if weights[a] and not any(weights[max(0, a - window) : a]):
            b = a
            while any(weights[b + 1 : b + 1 + window]):
                b += 1
            b = max(j for j in range(a, b + 1) if weights[j])
            out.append((a, b + 1, max(sums[i] for i in range(max(0, a - window + 1), b + 1))))
    return out


def test_stretches_by_brute_force():
    r = random.Random(4)
    for _ in range(3000):
        weights = [r.choice((0, 0, 0, 5, 30, 80)) for _ in range(r.randrange(0, 30))]
        for window in (1, 2, 3, 5):
            assert html.stretches(weights, window) == brute_stretches(weights, window), (weights, window)


def planted(r: random.Random) -> tuple[str, str]:
    """A page in one of many layouts, and its article."""
    blocks = [words(r, r.randrange(12, 60)).capitalize() + "." for _ in range(r.randrange(3, 12))]
    head = words(r, 6).capitalize()
    short = r.choice(("Short.", "See below.", "İstanbul &amp; more"))
    at = r.randrange(1, len(blocks))
    body = [head, *blocks[:at], short.replace("&amp;", "&"), *blocks[at:]]
    inner = f"<h1>{head}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[:at]) + f"<p>{short}</p>"
    if r.random() < 0.4:
        inner += f'<div class="{r.choice(("ad", "ad-box sponsored", "newsletter"))}">{words(r, 9)}</div>'
    inner += "".join(f"<p>{b.replace(' ', ' <a href=x>', 1).replace(' ', '</a> ', 1) if r.random() < 0.2 else b}</p>" for b in blocks[at:])
    open_, close = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<section class="social studies">', "</section>"), ('<div id="page" class="has-sidebar sidebar-left">', "</div>"), ("<td>", "</td>")))
    article = f"{open_}{inner}{close}"
    menu = "".join(f'<li><a href="/{i}">{words(r, 1)}</a></li>' for i in range(r.randrange(3, 9)))
    before = [f"<nav><ul>{menu}</ul></nav>", f'<header><div class="logo">{words(r, 3)}</div></header>', f'<div class="cookie-notice"><p>{words(r, 20)}</p></div>', f'<div><a href=1>{words(r, 1)}</a> <a href=2>{words(r, 1)}</a> <a href=3>{words(r, 2)}</a></div>', f'<div class="search"><form><label>{words(r, 2)}</label><input></form></div>']
    after = [f"<aside><h3>{words(r, 2)}</h3><p>{words(r, 25)}</p></aside>", f'<div id="comments"><h3>Comments</h3><div class="comment"><p>{words(r, 30)}</p></div></div>', f'<div class="sidebar"><p>{words(r, 15)}</p></div>', f'<form><p>{words(r, 14)}</p><input><button>Go</button></form>', f'<div class="related"><ul>{menu}</ul></div>', f'<div class="share">{words(r, 2)}</div>']
    page = "".join(r.sample(before, r.randrange(1, 5))) + "<script>var x = '</p>';</script>" + article + "".join(r.sample(after, r.randrange(1, 5))) + f"<footer><p>{words(r, 8)}</p></footer>"
    if r.random() < 0.3:
        page = f"<form action=x><header></header>{page}</form>"
    return f"<html><head><title>{head}</title><style>p{{}}</style></head><body class='header-fixed'>{page}</body></html>", "\n".join(body)


def test_planted_articles():
    r = random.Random(12)
    pages = [planted(r) for _ in range(600)]
    whole = sum(html.main_text(page) == article for page, article in pages)
    assert whole >= 0.97 * len(pages)
    for page, article in pages:
        got = html.main_text(page).split("\n")
        assert sum(x in got for x in article.split("\n")) >= 0.9 * len(article.split("\n"))


def test_wrappers_do_not_hide_the_article():
    assert html.main_text("İ" * 40 + "<script>x</script><p>" + LONG + "</p>").endswith(LONG)
    assert html.main_text(f"<form><article><p>{LONG}</p></article></form>") == LONG
    assert html.main_text(f"<form><nav>menu</nav><p>{LONG}</p><footer>f</footer></form>") == LONG
    for name in ("social studies", "side", "share", "legal", "search"):
        assert html.main_text(f'<p>{LONG} One.</p><section class="{name}"><p>{LONG} Two.</p></section><p>{LONG} Three.</p>').count("\n") == 2, name
    for name in ("alert", "related", "notice-board", "sidebar-left"):
        assert html.main_text(f'<div class="{name}"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><p>Tail, short.</p>').startswith("Head\n" + LONG), name
    assert html.main_text("<div class='ad'>An advert that is longer than the whole of the article here.</div><article>Short.</article>") == "Short."
    assert html.main_text(f"<div><a href=1>Home</a> <a href=2>A very long entry of a menu that is not marked as one</a></div><nav>x</nav><nav>x</nav><nav>x</nav><p>{LONG}</p>") == LONG


def test_awkward_pages(spark):
    rows = [(1, None, "t", "a"), (2, "", "t", "b"), (3, "<div>" * 3000 + LONG, "t", "c"), (4, f"<p>{LONG}</p>" * 5000, "t", None), (5, "<p" + " x" * 20000, "t", ""), (6, "<article></article>", "t", ""), (6, "<article></article>", "t", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, __wm_html string")
    out = {r.page_id: r for r in html.extract(df).collect()}
    assert html.extract(df).columns == ["page_id", "__wm_html", "text"]
    assert out[3].text == LONG and out[4].text.count(LONG) == 5000 and out[4].text.count("\n") == 4999
    assert out[1].text == out[2].text == out[6].text == "" and out[1]["__wm_html"] == "a"


def loose(r: random.Random, page: str) -> str:
    """The page as HTML may be written too: end tags left out, misleading attribute values, other quotes."""
    for end in ("</head>", "</p>", "</li>", "</td>", "</body></html>"):
        if r.random() < 0.6:
            page = page.replace(end, "")
    if r.random() < 0.5:
        page = page.replace("<body ", f"<body title='{r.choice(('hidden', 'display:none', 'a > b', 'the <nav>'))}' ", 1)
    for tag in ("<article>", "<main>", '<div class="content">', "<h1>"):
        page = page.replace(tag, tag[:-1] + r.choice((" data-x='the hidden one'", ' title="a hidden gem"', " data-hidden=1", " aria-label='display:none'", " data-y=hidden", " alt='a > b'", "")) + ">")
    return page


def test_planted_articles_in_loose_markup():
    r = random.Random(21)
    pages = [planted(r) for _ in range(600)]
    texts = [html.main_text(loose(r, page)) for page, _ in pages]
    assert sum(t == article for t, (_, article) in zip(texts, pages)) >= 0.97 * len(pages)
    assert all(texts)


def test_optional_ends_and_attributes():
    assert html.main_text(f"<head><title>x</title><body><p>{LONG}") == LONG
    assert html.main_text(f"<html><head><meta a=b><link><p>{LONG}<p>{LONG}") == LONG + "\n" + LONG
    assert html.main_text(f"<head><title>x</title>{LONG}") == LONG
    assert html.main_text(f"<article data-x='the hidden one'><p>{LONG}</article>") == LONG
    assert html.main_text(f"<div title='a hidden gem'><p>{LONG}</div>") == LONG
    assert html.main_text(f"<div data-style='display:none'><p>{LONG}</div>") == LONG
    for gone in ("hidden", "HIDDEN", "hidden=''", "hidden=until-found", "style='color:red; display : none'", "style=display:none", "class=x hidden"):
        assert html.main_text(f"<article><p>{LONG}<div {gone}>Not shown.</div></article>") == LONG, gone
    assert html.main_text(f"<article><p>{LONG}<a href=/x/>Linked</a></p></article>") == LONG + "Linked"
    assert html.main_text(f"<p title='a > b'>{LONG}</p><p title=\"it's\">{LONG}</p>") == LONG + "\n" + LONG
    assert html.main_text(f"<p title='unclosed>{LONG}</p><p>{LONG}</p>").endswith(LONG)


def test_hostile_pages_take_linear_time():
    """A megabyte of each shape in a few seconds."""
    import time

    for shape in ("<script ", "<a '", "<a '>' ", '<a ">" x', "<div class='ad'>x", "</b>", "<b></i>", "<!--", "<p><li>", "<form><main>", "<x y=", "<", "<a b='", "<svg>", "<div hidden ", "&amp", "<a>x", "<textarea", "<p>x</div>"):
        for end in ("", ">", "'>"):
            page = shape * (1_000_000 // len(shape)) + end
            began = time.time()
            html.main_text(page)
            assert time.time() - began < 8, (shape, end, time.time() - began)
