"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of text blocks in page order. What is never article text (menus,
page headers and footers, side bars, forms, scripts, notices, adverts, reader comments) is taken out. A name alone takes
out neither an article nor what holds most of the text, and inside an article no section or heading by its id. Each block
then passes points for its length and its commas to its ancestors, less with distance, and every ancestor's points are
discounted by its share of link text. The best container is kept with those of its siblings that carry text of their own.

Character references are decoded once, after markup is recognised; white space inside a block, line breaks
included, becomes one space; blocks are joined by one line feed.

A form around most of the page's prose is a page, not a form. Time grows with the page, however it is nested.

Defined results for odd rows: null or empty html, and pages without text of their own, give an empty text; broken
and unfinished markup is read as far as it goes, as browsers do: a tag that never ends is dropped, an unclosed
element ends with its parent, what is nested deeper than 512 is read as part of the element at that depth; attribute
values may have any length; an empty table gives an empty one; columns other than the three are not read; null urls pass through; repeated pages get equal results.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, table

# Names of HTML elements by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg object canvas audio video annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button select option fieldset dialog menu search head label datalist".split())
MAIN = frozenset("article main".split())
# Words of class and id that mark what is not the article, and what is.
NEGATIVE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners breadcrumb breadcrumbs comment comments commentlist comentario commentaires kommentare consent cookie cookies copyright "
    "disqus disclaimer discussion foot footer gdpr hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paging popup promo promoted promotion "
    "recommend recommended recommendations related replies reply respond search share sharing shoutbox sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toc toolbar topbar tracking widget widgets".split()
)
# Names that say reader comments wherever they stand; first parts of names that tell a state or a topic, not a part of the page.
COMMENTS = frozenset("comment comments commentlist disqus disqus_thread respond".split())
STATES = frozenset("no has with without category cat tag format type status".split())
PROSE = 80  # letters of a block that is more than a label
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
POSITIVE = frozenset("article articlebody body content entry hentry main post story text prose".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
DEPTH = 512  # elements nested deeper are read as part of the one at this depth, as browsers do; their text stays
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def _tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """Where the tag whose name ends at ``at`` has its ``>``: behind quoted values of any length; -1 if it never ends. A quote that is
    opened and never closed (``last`` says where each kind stands last) is none."""
    i = at
    while m := _STOP.search(source, i):
        j, c = m.start(), m.group()
        if c == ">":
            return j
        i = j + 1
        if source[at:j].rstrip().endswith("=") if j - at < 200 else source[j - 200 : j].rstrip().endswith("="):
            if j >= last[c]:
                return source.find(">", at)
            i = source.find(c, i) + 1
    return -1


class Page:
    """Elements in page order (parent, tag, attributes) and text blocks (element, text, letters of it in links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["html"], [""]
        self.blocks: list[tuple[int, str, int]] = []
        stack = [0]
        buffer: list[str] = []
        linked = links = deeper = 0
        tags, parents, attrs = self.tag, self.parent, self.attrs
        last = {c: source.rfind(c) for c in "\"'"}

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    k = len(stack) - 1
                    while k > 0 and tags[stack[k]] not in BLOCK:
                        k -= 1
                    self.blocks.append((stack[k], text, min(linked, len(text))))
                buffer.clear()
            linked = 0

        def pop_to(depth: int) -> None:
            nonlocal links
            for x in stack[depth:]:
                links -= tags[x] == "a"
            del stack[depth:]

        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            end = m.start() if m else size
            if end > at:
                piece = source[at:end]
                text = html.unescape(piece) if "&" in piece else piece
                buffer.append(text)
                if links:
                    linked += len(text.strip())
            if not m:
                break
            at = m.end()
            if not m.group(2):
                continue
            stop = _tag_end(source, at, last)
            if stop < 0:
                break
            rest, at = source[at:stop], stop + 1
            name, closing = m.group(2).lower(), m.group(1)
            if name in BLOCK:
                flush()
            if closing:
                if deeper and name not in VOID and name != "br":
                    deeper -= 1
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        pop_to(k)
                        break
                    if tags[stack[k]] in ("table", "article", "main") and name not in BLOCK:
                        break
                continue
            if name == "br":
                buffer.append(" ")
                continue
            if name in VOID:
                continue
            if name in RAW:
                if not rest.endswith("/") or name not in ("svg", "annotation", "annotation-xml"):
                    close = _CLOSE[name].search(source, at)
                    at = close.end() if close else size
                continue
            if len(stack) >= DEPTH:
                deeper += 1
                continue
            if name in BLOCK:
                k = len(stack) - 1
                while k > 0 and tags[stack[k]] not in BLOCK:
                    k -= 1
                if k > 0 and tags[stack[k]] == "p":
                    pop_to(k)
            if name in _CLOSES:
                ends, stops = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in stops:
                        break
                    if tags[stack[k]] in ends:
                        pop_to(k)
                        if name != "tr":
                            break
            if name in ("html", "body") and (name == "html" or self.has_body):
                continue
            self.has_body = self.has_body or name == "body"
            if name == "a":
                if links:
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] == "a":
                            pop_to(k)
                            break
                links += 1
            parents.append(stack[-1])
            tags.append(name)
            attrs.append(rest)
            stack.append(len(tags) - 1)
        flush()

    has_body = False

    def marks(self, x: int) -> tuple[set[str], set[str], set[str], dict[str, str]]:
        """Words of class and id, words of class alone, whole names, attributes."""
        found = {a.lower(): b or c or d or "" for a, b, c, d in _ATTR.findall(self.attrs[x])} if self.attrs[x].strip() else {}
        classes, names = _names(found.get("class", "")), _names(found.get("id", ""))
        return _words(classes) | _words(names), _words(classes), {n.lower() for n in classes + names}, found


def _names(value: str) -> list[str]:
    return [n for n in value.split() if re.split(r"[-_]", n.lower(), maxsplit=1)[0] not in STATES or not re.search("[-_]", n)]


def _words(names: list[str]) -> set[str]:
    return {w for n in names for w in _WORDS.findall(_CAMEL.sub(" ", n).lower())}


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    parent, tag = page.parent, page.tag
    words: list[set[str]] = [set()] * n
    classes: list[set[str]] = [set()] * n
    names: list[set[str]] = [set()] * n
    inside = [False] * n  # whether an article or main is above or here
    holds = [False] * n  # whether one is below
    found: list[dict[str, str]] = [{}] * n
    for x in range(n):
        if page.attrs[x]:
            words[x], classes[x], names[x], found[x] = page.marks(x)
        inside[x] = tag[x] in MAIN or found[x].get("role") == "main" or (x > 0 and inside[parent[x]])
    for x in range(n - 1, 0, -1):
        holds[parent[x]] = holds[parent[x]] or holds[x] or tag[x] in MAIN or found[x].get("role") == "main"
    letters_in, prose_in = [0] * n, [0] * n  # of all text, and of blocks long enough to be prose
    for x, text, links in page.blocks:
        letters_in[x] += len(text)
        prose_in[x] += len(text) if len(text) >= PROSE and links < len(text) / 2 else 0
    for x in range(n - 1, 0, -1):
        letters_in[parent[x]] += letters_in[x]
        prose_in[parent[x]] += prose_in[x]
    never = [False] * n  # by what they are, not by name
    for x in range(n):
        a = found[x]
        bad = (
            tag[x] in DROPPED
            or (tag[x] == "header" and not inside[x])
            or a.get("role", "").lower() in ROLES
            or "hidden" in a
            or a.get("aria-hidden") == "true"
            or re.search(r"display\s*:\s*none", a.get("style", ""), re.I) is not None
        )
        # A form around the page's prose is how some servers send any page.
        wraps = (tag[x] == "form" or a.get("role", "").lower() == "form") and 2 * prose_in[x] > letters_in[0] and "hidden" not in a
        keeps = holds[x] and tag[x] not in ("nav", "footer", "aside") and not words[x] & {"comments", "comment", "related", "recommended"}
        never[x] = (x > 0 and never[parent[x]]) or (bad and not keeps and not wraps)
    weight, links_in = [0] * n, [0] * n
    for x, text, links in page.blocks:
        if not never[x]:
            weight[x] += len(text)
            links_in[x] += links
    for x in range(n - 1, 0, -1):
        weight[parent[x]] += weight[x]
        links_in[parent[x]] += links_in[x]
    whole = weight[0]
    named_bad, under_bad, good = [False] * n, [False] * n, [False] * n
    for x in range(n):
        within = x > 0 and inside[parent[x]]
        said = classes[x] if within and (tag[x] == "section" or tag[x] in HEADINGS) else words[x]
        bad = bool(said & NEGATIVE) and tag[x] not in ("html", "body", "main")
        named_bad[x] = bad or ("header" in words[x] and not inside[x]) or (bool(names[x] & COMMENTS) and within)
        under_bad[x] = named_bad[x] or (x > 0 and under_bad[parent[x]])
        good[x] = inside[x] or bool(words[x] & POSITIVE and tag[x] != "body" and not bad) or (x > 0 and good[parent[x]])
    # A name says nothing of an element that holds most of the text, unless there is prose that no such name stands over.
    prose = [(x, len(text)) for x, text, links in page.blocks if not never[x] and len(text) >= PROSE and links < len(text) / 2]
    clean = sum(size for x, size in prose if not under_bad[x])
    named_good = any(good[x] and not under_bad[x] for x, _ in prose)
    gone = [False] * n
    for x in range(n):
        comments = bool(names[x] & COMMENTS)
        within = x > 0 and inside[parent[x]]
        bad = named_bad[x]
        spared = not comments and ((2 * weight[x] > whole and not named_good and 8 * clean < weight[x]) or tag[x] in HEADINGS)
        if tag[x] == "article":
            spared = not (comments and within)
        elif tag[x] in ("ul", "ol") and within:
            spared = spared or not (names[x] & NEGATIVE and (comments or links_in[x] > 0.8 * weight[x]))
        keeps = holds[x] and not words[x] & {"comments", "comment", "related", "recommended"}
        gone[x] = never[x] or (x > 0 and gone[parent[x]]) or (bad and not keeps and not spared)
    blocks = [b for b in page.blocks if not gone[b[0]]] or [b for b in page.blocks if not never[b[0]]]
    if not blocks:
        return ""
    if all(gone[x] for x, _, _ in blocks):  # nothing is left without the names: they say nothing then
        gone = never
    own, below, letters, linked = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for x, text, links in blocks:
        own[x] += (1 + text.count(",") + min(len(text) / 100, 30)) * (1 - links / len(text))
        letters[x] += len(text)
        linked[x] += links
    for x in range(n - 1, 0, -1):  # whole to the parent, half of what comes from below
        below[parent[x]] += own[x] + below[x] / 2
        letters[parent[x]] += letters[x]
        linked[parent[x]] += linked[x]
    points = [below[x] + (own[x] if tag[x] not in HEADINGS and tag[x] not in ("p", "li") else 0.0) for x in range(n)]
    for x in range(n):
        if letters[x]:
            points[x] += (25 if tag[x] in MAIN or found[x].get("itemprop") == "articleBody" else 0) + (10 if words[x] & POSITIVE and tag[x] != "body" else 0)
            points[x] *= 1 - linked[x] / letters[x]
    best = max((x for x in range(n) if letters[x]), key=lambda x: (points[x], -x))
    top = best
    while top > 0 and not (tag[top] in MAIN or found[top].get("role") == "main"):
        top = parent[top]
    if top == 0:
        top = best
    kept = [False] * n
    kept[top] = True
    if tag[top] not in MAIN and parent[top] >= 0:
        for x in range(n):
            if parent[x] == parent[top] and letters[x] and not gone[x]:
                density = linked[x] / letters[x]
                prose = tag[x] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "dl", "table", "figure")
                kept[x] = kept[x] or (density < 0.5 and (prose or points[x] >= max(5.0, 0.2 * points[top])))
    for x in range(n):
        listing = tag[x] in ("ul", "ol", "div", "section", "table") and letters[x] and linked[x] > 0.8 * letters[x] and x != top
        # In an article lists of links are sources and references, unless a whole name says navigation too.
        listing = listing and (bool(names[x] & NEGATIVE) if x > 0 and inside[parent[x]] else tag[x] != "ol")
        kept[x] = (kept[x] or (x > 0 and kept[parent[x]])) and not listing and not gone[x]
    return "\n".join(text for x, text, _ in blocks if kept[x])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def rows(ids, urls, pages):
        texts = [main_text(p) for p in pages]
        return ids, urls, texts, [len(t) for t in texts]

    return map_rows(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html")), rows, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long", block=200)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
