"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element, with white space inside a
line made one space and character references decoded. A line weighs the length
of its text outside of links, a headline all of it. Weights are summed over
sliding windows of lines: a surge point is where the sum rises from zero, a
dive point where it falls back to zero. A stretch between them that reaches the
threshold is kept with all its lines, and so is a short stretch next to a kept
one, such as a headline; lines of a marked article stay in any case.

Some elements take no part, so that their lines weigh nothing and stay out:
menus, headers, footers, sidebars, dialogs and controls by their tags, hidden
ones, forms, reader comments, and elements that a word of class, id or role
names an advert, a notice or the like. As wrappers of whole pages carry such
names too, text outranks them: a named element that holds half of the page's
text outside of links, or one with a weak name ("social", "legal") whose text
is prose and not links, is no such part, nor is a form or a list of comments
around page structure.

One pass per page in time that grows with its length, no shuffle. Defined cases: null or empty html gives an
empty text; stray end tags are passed over, an element without an end goes on to that of the element around it, a head without one to the first element or text of a body, a tag without > is text; a page without any stretch over
the threshold and without marked lines keeps its fullest stretch; repeated rows get equal results;
columns beside html and text are kept.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table

#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never shown as text, with their ends.
RAW = {x: re.compile(rf"</{x}\b[^>]*(?:>|\Z)", re.I) for x in "script style noscript template svg iframe textarea object canvas math".split()}
#: Elements whose lines are never part of an article.
OUTSIDE = frozenset("nav header footer aside head menu dialog button select fieldset label".split())
MARKED = frozenset(("article", "main"))
#: Around one of these, a form or a list of comments is the page's frame; a form around an article, too.
FRAMED = frozenset("main h1 header footer nav".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name parts beside an article; the weak ones name topics, too.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|footer|header|masthead|related|recommend\w*|sharing|toolbar|pagination|pager|copyright|complementary|contentinfo|dialog)(?:$|[\s_-])",
    re.I,
)
WEAK_NAMES = re.compile(r"(?:^|[\s_-])(?:side|share|social|search|login|legal)(?:$|[\s_-])", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])", re.I)
OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Elements of a head; any other ends it.
HEAD_CONTENT = frozenset("base link meta noscript script style template title".split())
SPACE = re.compile(r"\s+")
APART = re.compile(r"[\W_]+")


@dataclass
class Part:
    """An element that may be a part beside the article: kind is out, comments, form, named or weak."""

    kind: str
    around: "Part | None"  # the part it lies in
    frame: bool = False  # holds page structure
    article: bool = False  # holds an article
    prose: int = 0  # characters outside of links
    linked: int = 0
    lines: int = 0
    marked: int = 0  # lines in marked articles
    out: bool = False

    @property
    def apart(self) -> bool:
        framed = self.frame or (self.kind == "form" and self.article)
        return self.kind == "out" or (self.kind in ("comments", "form") and not framed)


@dataclass
class Line:
    text: str
    prose: int  # characters outside of links
    headline: bool
    marked: bool  # inside a marked article
    part: Part | None  # the innermost
    out: bool = False


class Tokens:
    """Markup of a page, one after the other, in time that grows with its length only.

    A tag ends at the first > outside of quotes; where there is none, at the
    first > at all, from there to the page's end.
    """

    def __init__(self, page: str):
        self.page, self.plain = page, False

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next markup from a place on; name is empty for comments and the like."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
                if page.startswith(opening, start):
                    stop = page.find(closing, start + len(opening))
                    return start, len(page) if stop < 0 else stop + len(closing), "", "", ""
            m = OPEN_TAG.match(page, start)
            if m:
                stop = self.tag_end(m.end())
                if stop < 0:
                    return None  # no > is left
                return start, stop + 1, m[1], m[2].lower(), page[m.end() : stop]
            at = start + 1
        return None

    def tag_end(self, at: int) -> int:
        page, first = self.page, self.page.find(">", at)
        if first < 0 or self.plain:
            return first
        while m := STOP.search(page, at):
            if m[0] == ">":
                return m.start()
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
        self.plain = True
        return first


def attributes_of(raw: str) -> dict[str, str]:
    """Attribute names in lower case and their values, the first of each name."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), "".join(values))
    return out


def lines_of(page: str, threshold: int = 40) -> list[Line]:
    """The lines with text, in page order, told which are out."""
    lines: list[Line] = []
    parts: list[Part] = []  # those around come before those inside
    texts: list[str] = []
    linked = 0
    open_: list[tuple[str, Part | None, bool, bool]] = []  # element, and what holds outside of it: part, marked, in a link
    counts: Counter[str] = Counter()
    part: Part | None = None
    marked = link = False
    at, end, tokens = 0, len(page), Tokens(page)

    def flush(headline: bool) -> None:
        nonlocal linked
        if texts:
            text = SPACE.sub(" ", html_lib.unescape("".join(texts))).strip()
            if text:
                prose = max(0, len(APART.sub("", text)) - linked) if linked else len(text)  # between links, bars and spaces are no text
                lines.append(Line(text, prose, headline, marked, part))
            texts.clear()
        linked = 0

    def close(name: str) -> None:
        """Ends the innermost open element of a name and all inside it."""
        nonlocal part, marked, link
        while True:
            tag, part, marked, link = open_.pop()
            counts[tag] -= 1
            if tag == name:
                return

    def add(raw: str) -> None:
        nonlocal linked
        if open_ and open_[-1][0] == "head" and raw.strip():
            close("head")  # text in a head belongs to the body
        texts.append(raw)
        if link:
            linked += len(APART.sub("", html_lib.unescape(raw)))

    while at < end:
        token = tokens.next(at)
        if token is None:
            add(page[at:])
            break
        start, stop, slash, name, raw = token
        if start > at:
            add(page[at:start])
        at = stop
        if not name:
            continue
        if name in BLOCKS:
            flush(any(x[0] in HEADLINES for x in open_[-4:]))
        if slash:
            if counts[name]:
                close(name)
            continue
        closed = raw == "/" or raw.endswith((" /", "\"/", "'/"))
        if counts["head"] and name not in HEAD_CONTENT:
            close("head")
        if name in RAW:
            if not closed:
                found = RAW[name].search(page, at)
                at = found.end() if found else end
            continue
        if name in VOID or closed:
            continue
        if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and counts[name]:
            inner = next((x[0] for x in open_[:-9:-1] if x[0] in BLOCKS), "")
            if inner == name:  # no other block in between, only such as links
                close(name)
        if name == "a" and link:
            continue
        open_.append((name, part, marked, link))
        counts[name] += 1
        link = link or name == "a"
        if part:
            part.frame |= name in FRAMED
            part.article |= name == "article"
        given = attributes_of(raw) if raw and name not in ("html", "body") else {}
        named = [given[x] for x in ("class", "id", "role") if given.get(x)]
        if (name in OUTSIDE and not (name == "header" and marked)) or "hidden" in given or NO_DISPLAY.search(given.get("style", "")):
            kind = "out"
        elif any(COMMENT_NAMES.search(x) for x in named):
            kind = "comments"
        elif name == "form":
            kind = "form"
        elif any(NAMES.search(x) for x in named):
            kind = "named"
        elif any(WEAK_NAMES.search(x) for x in named):
            kind = "weak"
        else:
            kind = ""
        if kind:
            part = Part(kind, part)
            parts.append(part)
        if name in MARKED:
            marked = True
    flush(any(x[0] in HEADLINES for x in open_[-4:]))
    return _judged(lines, parts, threshold)


def _judged(lines: list[Line], parts: list[Part], threshold: int) -> list[Line]:
    """Marks the lines that are out: those of a part that isn't the page's own text.

    Parts are summed from the innermost outwards, and judged the other way.
    """
    for p in reversed(parts):
        if p.around:
            p.around.frame |= p.frame
            p.around.article |= p.article
    for p in parts:
        p.out = p.apart or bool(p.around and p.around.out)
    for x in lines:
        if x.part:
            x.part.lines += 1
            x.part.linked += len(x.text) - x.prose
            if not x.part.out:
                x.part.prose += x.prose
                x.part.marked += x.marked
    for p in reversed(parts):
        if p.around:
            for name in ("lines", "linked", "prose", "marked"):
                setattr(p.around, name, getattr(p.around, name) + getattr(p, name))
    own = [x for x in lines if not (x.part and x.part.out)]
    prose, marked = sum(x.prose for x in own), sum(x.marked for x in own)

    def beside(p: Part) -> bool:
        if p.kind not in ("named", "weak"):
            return p.apart
        if p.prose * 2 >= prose > 0 and p.lines > 1 and p.marked == marked:
            return False
        return p.kind == "named" or p.linked >= p.prose or p.prose < threshold * p.lines

    for p in parts:
        p.out = beside(p) or bool(p.around and p.around.out)
    for x in lines:
        x.out = bool(x.part and x.part.out)
    return lines


def stretches(weights: list[int], window: int = 3) -> list[tuple[int, int, int]]:
    """(first line, line after the last, greatest window sum) from each surge point to its dive point."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        start = i
        while i < n and sums[i]:
            i += 1
        inside = [k for k in range(start, min(n, i + window - 1)) if weights[k]]
        out.append((inside[0], inside[-1] + 1, max(sums[start:i])))
    return out


def main_text(page: str | None, window: int = 3, threshold: int = 40) -> str:
    """The page's main text: marked lines and those between surge and dive points, joined by newlines; without any, the fullest stretch."""
    lines = lines_of(page or "", threshold)
    marked = [k for k, x in enumerate(lines) if x.marked and not x.out]
    rest = [k for k, x in enumerate(lines) if not x.marked]  # marked lines aren't looked for, so an advert inside doesn't part them
    found = stretches([0 if lines[k].out else len(lines[k].text) if lines[k].headline else lines[k].prose for k in rest], window)
    full = [x[2] >= threshold for x in found]
    kept = [x for i, x in enumerate(found) if any(full[max(0, i - 1) : i + 2])]
    if not kept and not marked:
        kept = sorted(found, key=lambda x: -x[2])[:1]
    shown = sorted(marked + [k for a, b, _ in kept for k in rest[a:b] if not lines[k].out])
    return "\n".join(lines[k].text for k in shown)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", window: int = 3, threshold: int = 40) -> DataFrame:
    """pages without its html, with the main text under text_col."""
    keep = [c for c in pages.columns if c not in (html_col, text_col)]
    page = spare(pages, "html")
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias(page))
    schema = source.drop(page).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(x.as_py(), window, threshold) for x in batch.column(batch.num_columns - 1)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*keep, text_col])

    return source.mapInArrow(run, schema)


def op10_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
