"""Main text of web pages by two-pass block rules.

Markup is read once into blocks of text. Places that are never the article (menus, page headers, footers, sidebars, notices,
adverts, forms, comments, hidden parts) are decided by their elements and class names, where a page has such. The first pass
classifies the other blocks by length, link density and stop-word density; what counts as dense follows the long blocks of
the page itself, whose language the stop words may not know. The second pass finds the smallest element that holds most of
the accepted words, rejects blocks outside of it that are no paragraphs, and gives short and undecided blocks the label of
their nearest decided neighbours, those in the same element first. Where the page marks its article, text inside needs no
stop words, as tables and lists have none.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, texts

#: Blocks of fewer words are short; blocks of this many words and enough stop words are decided.
SHORT, LONG = 10, 20
STOP_LOW, STOP_HIGH = 0.15, 0.3
LINKS = 0.5
#: Share of the accepted words that the element of the main text holds at least.
REGION = 0.75

#: Frequent words of English, German, French, Spanish, Italian, Portuguese and Dutch. Fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his i if in is it its more not of on or our "
    "she so that the their there they this to was we were what which who will with would you your "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer es für hat ich ihr "
    "im ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur lui mais ne nous on ou où par pas pour que qui "
    "sa se ses son sont sur un une vous "
    "al como con cuando del desde donde el ella ellos entre era es esta este esto fue hay las lo los más me mi muy no nos "
    "otro para pero por porque sin sobre su sus también te todo una uno y ya "
    "che della di gli non per più sono alla anche come nel "
    "ao com da das do dos ela ele mais na nas nem no nos os pela pelo seu sua são um uma "
    "dat deze dit een en het hij ik maar met naar niet nog ook op te uit van voor wat werd zijn zo".split()
)
#: Elements that part blocks. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or none that is shown.
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg math object canvas video audio xmp".split())
#: Elements that never hold the article.
OUTSIDE = frozenset("aside button dialog footer form head menu nav select".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class names and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disclaimer disqus footer gdpr hidden legal login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets".split()
)
HEADER_MARKS = frozenset(["header"])
_PLAIN_MARKS = frozenset(["has", "no", "with", "without"])
#: An element that opens closes one of these that is still open, up to one of the second.
CLOSES = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
PROSE = frozenset(["p", "pre", "blockquote"])
_RIGHTS = re.compile(r"(?:\u00a9|\(c\)|copyright\b)", re.IGNORECASE)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    words: int
    stops: int
    linked: int
    heading: bool
    outside: bool
    article: bool
    #: Whether it is text of a paragraph, and the elements that it stands in: its own, and the one around that.
    prose: bool = False
    element: int = 0
    around: int = 0
    label: str = ""


@dataclass(frozen=True)
class _Place:
    tag: str
    outside: bool = False
    article: bool = False
    link: bool = False
    heading: bool = False
    header: bool = False
    prose: bool = False
    element: int = 0


def _marked(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's attributes take it out of the article, and whether they name it the article."""
    outside = article = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden":
            outside = True
        elif name == "aria-hidden":
            outside |= value.lower() == "true"
        elif name == "style":
            outside |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        elif name == "role":
            outside |= value.lower() in ROLES and not (inside and value.lower() == "banner")
            article |= value.lower() in ("main", "article")
        elif name == "itemprop":
            article |= value.lower() == "articlebody"
        elif tag not in ("html", "body", "main"):
            for word in value.split():
                parts = [x.lower() for x in _NAME_PARTS.findall(word)]
                if parts and not _PLAIN_MARKS & {*parts}:
                    ends = {parts[0], parts[-1]}
                    outside |= bool(ends & MARKS) if tag != "article" else bool(ends & {"comment", "comments", "reply", "replies"})
                    outside |= bool(ends & HEADER_MARKS) and not inside
    return outside, article


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """All blocks with text, in page order, and for each element, in the order in which they open, the one around it."""
    out: list[Block] = []
    parents = [0]
    stack = [_Place("")]
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag
    parts: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            place, words = stack[-1], text.split(" ")
            stops = sum(_EDGES.sub("", w).lower() in STOP_WORDS for w in words)
            lost = place.outside or (place.header and not place.heading)
            own = place.element
            out.append(Block(text, len(words), stops, min(linked, len(text)), place.heading, lost, place.article, place.prose, own, parents[own]))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    def close(tag: str, until: tuple[str, ...] = ()) -> None:
        """Ends the last open tag and all in it, unless one of until is open inside of it."""
        if places.get(tag) and not any(places.get(u, [])[-1:] > places[tag][-1:] for u in until):
            k = places[tag][-1]
            while len(stack) > k:
                places[stack.pop().tag].pop()

    while (m := _TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:  # a comment, a declaration or the like
            continue
        closing, attributes = (m[1] or m[4] or "") == "/", m[3] or m[6] or ""
        if tag in BLOCKS:
            flush()
        if closing:
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
                close_at = page.find(">", end.start()) if end else -1
                at = close_at + 1 if close_at >= 0 else len(page)
            continue
        if tag in BLOCKS and places.get("p"):
            close("p", ("article", "aside", "div", "form", "main", "nav", "section", "table", "button"))
        if tag in CLOSES:
            close(tag, CLOSES[tag])
        above = stack[-1]
        outside, article = _marked(tag, attributes, above.article) if attributes.strip() else (False, False)
        if tag in BLOCKS:
            parents.append(above.element)
        places.setdefault(tag, []).append(len(stack))
        stack.append(
            _Place(
                tag,
                above.outside or outside or tag in OUTSIDE or (tag == "header" and not above.article),
                above.article or article or tag in ("article", "main"),
                above.link or tag == "a",
                above.heading or tag in HEADINGS,
                above.header or (tag == "header" and above.article),
                tag in PROSE or (above.prose and tag not in BLOCKS),
                len(parents) - 1 if tag in BLOCKS else above.element,
            )
        )
    add(page[at:])
    flush()
    return out, parents


def _decide(found: list[Block], marked: bool) -> None:
    """The first pass: labels good and bad, and for undecided blocks near, unlike and short."""
    usual = sorted(b.stops / b.words for b in found if b.words >= LONG and not b.outside and b.linked <= 0.2 * len(b.text))
    base = usual[len(usual) // 2] if usual else 1.0
    low, high = min(STOP_LOW, base / 2), min(STOP_HIGH, base * 0.6)
    for b in found:
        density, links = b.stops / b.words, b.linked / len(b.text)
        if b.outside or (marked and not b.article) or links > LINKS or (not b.article and b.words < LONG and _RIGHTS.match(b.text)):
            b.label = "bad"
        elif b.words < SHORT:
            b.label = "short"
        elif b.article:
            b.label = "good"
        elif density >= high:
            b.label = "good" if b.words >= LONG else "near"
        else:
            b.label = "bad" if density < low and links > 0 else "near" if density >= low else "unlike"


def _region(found: list[Block], parents: list[int]) -> tuple[int, int]:
    """First and last element of the smallest one that holds REGION of the good words; of the page if there are none."""
    words, last = [0] * len(parents), list(range(len(parents)))
    for b in found:
        words[b.element] += b.words if b.label == "good" else 0
    for e in range(len(parents) - 1, 0, -1):
        words[parents[e]] += words[e]
        last[parents[e]] = max(last[parents[e]], last[e])
    most = max((e for e in range(len(parents)) if words[e] and words[e] >= REGION * words[0]), default=0)
    return most, last[most]


def _near(places: list[int], i: int) -> tuple[int | None, int | None]:
    """The places before and after i."""
    k = bisect(places, i)
    return (places[k - 1] if k else None), (places[k] if k < len(places) else None)


def classify(found: list[Block], parents: list[int]) -> list[Block]:
    """The blocks of the main text, labelled in two passes. A marked article, if it has text, is the only candidate."""
    marked = any(b.article and not b.outside for b in found)
    _decide(found, marked)
    if not marked:
        first, last = _region(found, parents)
        if first:
            for b in found:
                if not first <= b.element <= last and not (b.prose and b.label == "good"):
                    b.label = "bad"
    region = [b for b in found if not b.outside and (b.article or not marked)]
    decided = [i for i, b in enumerate(region) if b.label in ("good", "bad")]
    inside: dict[int, list[int]] = {}
    for i in decided:
        inside.setdefault(region[i].around, []).append(i)
    labels = []
    for i, b in enumerate(region):
        if b.label in ("good", "bad"):
            labels.append(b.label)
            continue
        sides = [k for k in _near(inside.get(b.around, decided), i) if k is not None]
        kinds = {region[k].label for k in sides}
        if len(kinds) == 1:
            labels.append(kinds.pop())
        elif not kinds:
            labels.append("good")  # nothing on the page is decided: what is left after the outside parts is its text
        else:
            left, right = sides
            closer = region[left].label if i - left < right - i else region[right].label if right - i < i - left else ""
            keep = b.article or b.label == "near" or (b.heading and region[right].label == "good") or closer == "good" or (not closer and b.prose)
            labels.append("good" if keep else "bad")
    for b, label in zip(region, labels, strict=True):
        b.label = label
    return [b for b in found if b.label == "good"]


def main_text(page: str) -> str:
    """The main text: its blocks in page order, white space as single spaces. Empty for an empty page."""
    return " ".join(b.text for b in classify(*blocks(page)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [main_text(t.decode("utf-8", "replace")) for t in texts(batch.column("_html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points). Null and empty pages have an empty text, an empty table no rows.

    Pages without closing tags are read to their end, and elements may be open to any depth; time and memory are in proportion
    to a page, however long. Ids and urls may be null or repeated; repeated pages give equal texts; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
