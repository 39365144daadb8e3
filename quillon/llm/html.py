"""Main text of web pages by line-block distribution.

Markup is stripped into one line for each block element.  Menus, headers, footers,
sidebars, notices, adverts, forms, comments of readers, scripts and styles are recognised
by element, role, class or id and leave no line.  The tags where a marked article or main
element begins or ends leave a few empty lines, as markup lines do in this method.  Text
lengths are summed over a sliding window of lines.  The sums rise from nothing, surge, and
dive to nothing again; lines between such points are a region, and the text from the
first region with a surge to the last is kept, lists of links in between too.

Marks break ties only: where the region with the most text lies in a marked article,
regions outside such are not counted among those that surge, and where none surges, what
is marked is kept, or else all that is not links.

Class and id words count by their parts on containers outside a marked article.  Inside
one, and on paragraphs, headings and the like, only whole names of known widgets do, so
that an article's own text is never lost to its styling.

Defined cases: null, empty or text-free html gives an empty text; markup that is not
closed or cut off is read as far as it goes, in time linear in its length; very long pages
are read whole; equal pages give equal texts and repeated rows a row each; an empty table
gives an empty result; only id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm._store import give_back

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

#: Elements whose content is no text of the page (content ends only at their own end tag).
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas xmp noembed noframes".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav footer aside form menu dialog button select option fieldset datalist audio video map head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Parts of class names, ids and roles that mark what surrounds the main text.
_AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebars?|side|aside|widgets?|header|masthead|footer|foot|"
    r"comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|"
    r"share\w*|sharing|social|related|recommend\w*|pagination|pager|toolbar|search\w*|copyright|legal|disclaimer|navigation|contentinfo|complementary|alertdialog|hidden)(?=$|[\s_-])",
    re.I,
)
_MAIN = frozenset(("article", "main"))
#: Elements whose class may name what they hold in parts; all others only by a widget's whole name.
CONTAINERS = frozenset("div section ul ol dl table header figure details center".split())
#: Whole class names, ids and roles of widgets that stand inside articles too.
WIDGETS = frozenset(
    "ad ads advert advertisement adsense ad-slot ad-container ad-banner sponsored sponsor promo banner newsletter newsletter-signup signup-form subscribe-box "
    "cookie-notice cookie-banner cookie-consent consent-banner notice alert popup modal overlay share share-buttons social social-share sharing "
    "comments comment comment-list commentlist comments-section comment-section disqus_thread respond replies reply sidebar widget related-posts related-articles "
    "breadcrumb breadcrumbs pagination pager navigation complementary contentinfo alertdialog".split()
)
#: Those of them that a paragraph, a heading or an item may be.
SMALL_WIDGETS = frozenset("ad ads advert advertisement sponsored cookie-notice newsletter-signup".split())
#: Those that a whole article element may be.
CARDS = frozenset("ad advert advertisement sponsored promo comment comments reply related-posts".split())
#: An end tag reaches out of none of these.
_SCOPES = frozenset(("article", "body", "html"))
WINDOW = 3
#: A surge needs so many characters in a window, as the method's authors set it.
SURGE = 86


def _around(name: str, attributes: str, main: bool) -> bool:
    """Whether an element holds what surrounds the main text."""
    if name in DROPPED:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key not in ("class", "id", "role") or name in ("body", "html", "main"):
            continue
        whole = set(value.lower().split())
        if name in CONTAINERS:
            if whole & WIDGETS or not main and _AROUND.search(value):
                return True
        elif whole & (CARDS if name == "article" else SMALL_WIDGETS):
            return True
    return False


def lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, inside an article) of each block, in page order; empty where an article begins or ends."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, str | None, bool]] = []  # name, element that drops it, main
    scopes: list[dict[str, int]] = [{}]  # open elements by name, in each scope that end tags stay in
    everywhere: dict[str, int] = {}
    cause: str | None = None
    main = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, linked, main))
            parts.clear()
        linked = 0

    def enter(name: str, by: str | None, inside: bool) -> None:
        nonlocal cause
        stack.append((name, by, inside))
        cause = by
        switch(inside)
        scopes[-1][name] = scopes[-1].get(name, 0) + 1
        everywhere[name] = everywhere.get(name, 0) + 1
        if name in _SCOPES:
            scopes.append({})

    def leave() -> None:
        nonlocal cause
        name = stack.pop()[0]
        if name in _SCOPES:
            scopes.pop()
        scopes[-1][name] -= 1
        everywhere[name] -= 1
        cause, inside = stack[-1][1:] if stack else (None, False)
        switch(inside)

    def switch(inside: bool) -> None:
        nonlocal main
        if inside != main:
            flush()
            out.extend([("", 0, False)] * WINDOW)
            main = inside

    at, end = 0, len(html)
    while at < end:
        m = _MARK.search(html, at)
        upto = m.start() if m else end
        if upto > at and cause is None:
            parts.append(html[at:upto])
            if any(x[0] == "a" for x in stack[-4:]):
                linked += upto - at
        if not m:
            break
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if close:
            # An end tag never reaches out of the article it stands in, but those of the page do.
            if scopes[-1].get(name) or name in ("body", "html", "main", "article") and everywhere.get(name):
                while stack[-1][0] != name:
                    leave()
                leave()
            continue
        if name in RAW:
            ended = re.compile(rf"</{re.escape(name)}(?=[\s>/]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = ended.end() if ended else end
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in INLINE and name not in ("div", "p", "article", "section"):
            continue
        if name == "p" or name in ("li", "dt", "dd", "tr", "td", "th"):
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "a", "span", "u") and name == "p":
                leave()
            if stack and stack[-1][0] == name:
                leave()
        inside, by = main, cause
        drops = _around(name, attributes, main) or name == "header" and not main
        if name in _MAIN and not drops:
            # An article ends a menu or form left open before it, but not comments it stands among.
            if by in DROPPED and by not in ("aside", "footer", "dialog"):
                by = None
            inside = by is None
        enter(name, by or (name if drops else None), inside)
    flush()
    return out


def regions(weight: list[int]) -> Iterator[tuple[int, int, bool]]:
    """(first line, line after the last, whether it surges) between the points where window sums rise from and dive to nothing."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    first = None
    for i, total in enumerate([*sums, 0]):
        if total and first is None:
            first = i
        elif not total and first is not None:
            held = [k for k in range(first, i) if weight[k]]
            yield held[0], held[-1] + 1, max(sums[first:i]) > SURGE
            first = None


def main_text(html: str | None) -> str:
    found = lines(html or "")
    # Lines that are mostly links are menus, unless they stand in an article.
    weight = [0 if not main and 2 * linked > len(t) else len(t) for t, linked, main in found]
    each = list(regions(weight))
    kept = [r for r in each if r[2]]
    if kept:
        largest = max(kept, key=lambda r: sum(weight[r[0] : r[1]]))
        if found[largest[0]][2]:
            kept = [r for r in kept if found[r[0]][2]]
    else:
        kept = [r for r in each if found[r[0]][2]] or each
    if not kept:
        return ""
    return " ".join(t for t, _, _ in found[kept[0][0] : kept[-1][1]] if t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])
        give_back()

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
