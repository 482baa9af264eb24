"""Main text of web pages from flat text blocks.

A page is cut at block-level tags into blocks of running text. Each block has its number of words, the share of them inside links,
the same of the blocks before and behind it, its kind (heading, paragraph, list item, or text that stands bare in a container), and
two hints: whether a container around it calls itself something else than the article (navigation, form, advert, comments ...), and
whether one calls itself the article. A decision tree, grown once from the small labelled pages below, keeps or drops each block. The
hints are features among others: on pages without them the tree decides by words, links and neighbours. A form that holds most of a
page's words, or the article, wraps the page and is no hint.

Defined results: null or empty html gives the empty text; malformed html is read as far as it goes, with unclosed
elements closed by the next block; a page is read in time that grows with its length, however long; repeated rows and null ids each give
a row; blocks on which leaves tie (0.5) are kept; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

# Tag and name lists.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
BARE, HEADING, PARAGRAPH, ITEM = range(4)
KINDS = dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), HEADING) | dict.fromkeys(("p", "pre", "blockquote", "figcaption", "dd"), PARAGRAPH) | {"li": ITEM, "dt": ITEM}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUTER = {"nav", "header", "footer", "aside", "button", "dialog", "menu", "search", "fieldset", "label"}
INNER = {"article", "main"}
OUTER_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "captcha", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "rail",
    "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "tags", "toolbar", "warning", "widget", "widgets",
}
OUTER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
INNER_NAMES = {"article", "content", "entry", "main", "post", "story"}

# Labelled pages, one block in a line, an empty line between pages. Kind (b bare, h heading, p paragraph, i list
# item), words, words in links, hint of another container, hint of the article, label (1 main text).
LABELLED = """
i 1 1 1 0 0
i 2 2 1 0 0
i 1 1 1 0 0
b 9 0 1 0 0
h 6 0 0 1 1
p 70 0 0 1 1
p 3 0 0 1 1
p 120 4 0 1 1
p 14 0 0 1 1
b 11 0 1 0 0

h 2 0 0 1 1
p 1 0 0 1 1
b 8 0 1 0 0

i 1 1 0 0 0
i 1 1 0 0 0
i 2 2 0 0 0
h 7 0 0 0 1
b 5 1 0 0 0
p 85 3 0 0 1
p 42 0 0 0 1
h 3 0 0 0 1
p 6 0 0 0 1
p 60 8 0 0 1
b 6 0 0 0 0

p 200 0 0 0 1

h 5 0 0 0 1
p 30 0 0 0 1
p 55 0 0 0 1
p 12 0 0 0 1

h 4 0 0 0 1
p 40 0 0 0 1
p 25 2 0 0 1
p 9 0 0 0 1
i 3 3 0 0 0
i 4 4 0 0 0
i 2 2 0 0 0

b 2 2 0 0 0
b 1 1 0 0 0
b 3 3 0 0 0
b 8 0 0 0 0
b 45 0 0 0 1
b 80 5 0 0 1
b 4 0 0 0 1
b 66 0 0 0 1
b 38 0 0 0 1
b 7 1 0 0 0
b 2 2 0 0 0
b 3 3 0 0 0

b 3 3 0 0 0
b 4 4 0 0 0
h 9 0 0 0 1
b 3 0 0 0 0
b 4 0 0 0 0
b 110 10 0 0 1
b 60 0 0 0 1
h 2 0 0 0 0
i 6 6 0 0 0
i 7 7 0 0 0
i 5 5 0 0 0
b 9 4 0 0 0

h 6 0 0 1 1
p 33 0 0 1 1
i 4 0 0 1 1
i 12 0 0 1 1
i 7 2 0 1 1
p 21 6 0 1 1
p 50 20 0 1 1
h 2 0 0 1 1
p 28 0 0 1 1
i 6 6 0 1 0
i 5 5 0 1 0
i 8 8 0 1 0

h 6 0 0 0 1
p 50 4 0 0 1
i 6 0 0 0 1
i 15 1 0 0 1
i 9 0 0 0 1
p 35 0 0 0 1
h 2 0 1 0 0
p 40 0 1 0 0
p 22 0 1 0 0
p 65 0 1 0 0
b 3 3 1 0 0
b 12 2 1 0 0

b 14 2 1 0 0
b 2 2 1 0 0
h 8 0 0 1 1
b 30 0 0 1 1
b 5 0 0 1 1
b 90 0 0 1 1
p 40 0 1 1 0
p 12 0 1 1 0
h 3 0 1 1 0
b 18 0 1 0 0
b 60 5 1 0 0

b 26 1 1 0 0
h 3 0 1 0 0
b 7 7 1 0 0
p 17 0 0 0 1
p 150 12 0 0 1
p 3 0 0 0 1
p 75 0 0 0 1
b 40 0 1 0 0
p 30 3 1 0 0
h 4 0 1 0 0

i 5 5 0 0 0
h 1 0 0 0 1
p 2 0 0 0 1
p 8 0 0 0 1
p 5 0 0 0 1
b 4 0 0 0 0

b 1 0 0 1 1

b 150 0 0 0 1

b 2 2 0 0 0
h 5 0 0 0 1
b 80 0 0 0 1
b 64 0 0 0 1

b 40 0 0 0 1
b 31 0 0 0 1

b 2 0 0 1 1
b 6 0 0 1 1
b 12 0 0 1 1
b 7 0 0 1 1

h 5 0 0 0 1
p 20 0 0 0 1
h 1 0 0 0 0
i 2 2 0 0 0
i 3 3 0 0 0

h 7 0 0 0 1
p 88 0 0 0 1
h 3 0 0 0 0
b 4 4 0 0 0
b 5 5 0 0 0

h 7 0 0 0 1
b 52 0 0 0 1
b 12 0 0 0 0

h 7 0 0 0 1
b 61 3 0 0 1
b 17 0 0 0 1
b 44 0 0 0 1
b 8 0 0 0 1
b 73 0 0 0 1
b 5 0 0 0 0

b 2 2 0 0 0
h 6 0 0 0 1
p 58 0 0 0 1
h 4 0 0 0 1
p 90 0 0 0 1
p 72 0 0 0 1
h 2 0 0 0 1
p 31 0 0 0 1
b 12 0 0 0 0

h 4 4 0 0 0
p 18 5 0 0 1
p 3 3 0 0 0
h 5 5 0 0 0
p 20 3 0 0 1
p 3 3 0 0 0
"""


def grow(rows: list[tuple[list[float], int]], depth: int = 8, least: int = 1):
    """A binary tree by Gini impurity: a float (share of label 1), or (feature, bound, low side, high side)."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return ones / len(rows)
    best = None
    for k in range(len(rows[0][0])):
        values = sorted({x[k] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            bound = (a + b) / 2
            low = [y for x, y in rows if x[k] <= bound]
            high = [y for x, y in rows if x[k] > bound]
            if min(len(low), len(high)) < least:
                continue
            cost = sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in (low, high))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, bound)
    if best is None:
        return ones / len(rows)
    _, k, bound = best
    return (k, bound, grow([r for r in rows if r[0][k] <= bound], depth - 1, least), grow([r for r in rows if r[0][k] > bound], depth - 1, least))


def features(blocks: list[tuple[int, int, int, int, int]]) -> list[list[float]]:
    """Of blocks (kind, words, linked words, other, article): words, link share, whether bare, heading, paragraph, item, the hints, and
    words and link share of both neighbours; a page's ends count as blocks without words."""
    beside = [(w, x / w) for _, w, x, _, _ in blocks]
    around = [(0, 0.0), *beside, (0, 0.0)]
    return [[*around[k + 1], *(float(kind == x) for x in range(4)), other, article, *around[k], *around[k + 2]] for k, (kind, _, _, other, article) in enumerate(blocks)]


def labelled_rows(table: str = LABELLED) -> list[tuple[list[float], int]]:
    out = []
    for page in table.strip().split("\n\n"):
        blocks = [("bhpi".index(line[0]), *map(int, line.split()[1:])) for line in page.splitlines()]
        out += [(x, b[-1]) for x, b in zip(features([b[:-1] for b in blocks]), blocks)]
    return out


TREE = grow(labelled_rows())


def judge(tree, features: list[float]) -> float:
    while isinstance(tree, tuple):
        k, bound, low, high = tree
        tree = low if features[k] <= bound else high
    return tree


_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[a-z]+")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: The rest of a tag: a bound inside a quoted value is no end; a quote that is never closed is a character like others.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+>""")


def _hints(tag: str, attributes: str, hints: tuple[int, int, int]) -> tuple[int, int, int]:
    """(other container, article, form) inside an element; the first and the last hold for all below it."""
    other, article, form = hints
    if other:
        return hints
    names, role, hidden = set(), "", False
    if attributes:
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names.update(_PARTS.findall(value))
            elif key == "role":
                role = value.strip()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
    if hidden or role in OUTER_ROLES or tag in OUTER and not (tag == "header" and article) or tag == "form" and article:
        return 1, article, form
    named = names & OUTER_NAMES
    if named and tag not in ("body", "html", "main", "form") and not (article and named <= {"header"}) and not (tag == "article" and named <= {"header", "tags"}):
        return 1, article, form
    inner = tag in INNER or role in ("main", "article") or names & INNER_NAMES and tag not in ("body", "html")
    return 0, int(bool(article or inner)), int(form or tag == "form")


def text_blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, kind, words, linked words, hint of another container, hint of the article) of each block with a word, in page order."""
    out: list[tuple] = []
    held: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, tuple[int, int, int]]] = []
    opened: dict[str, int] = {}
    hints, in_link, kind = (0, 0, 0), False, BARE

    def close():
        if held:
            words = _html.unescape("".join(held)).split()
            if words:
                out.append((" ".join(words), kind, len(words), min(len(words), len(_html.unescape(" ".join(linked)).split())), *hints))
            held.clear()
            linked.clear()

    def text(piece: str):
        if piece:
            held.append(piece)
            if in_link:
                linked.append(piece)

    i, n = 0, len(page)
    low = None
    while i < n:
        j = page.find("<", i)
        if j < 0:
            text(page[i:])
            break
        text(page[i:j])
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        if page.startswith("<![CDATA[", j):
            k = page.find("]]>", j)
            text(page[j + 9 : n if k < 0 else k])
            i = n if k < 0 else k + 3
            continue
        closing = page.startswith("</", j)
        m = _NAME.match(page, j + 1 + closing)
        if not m:
            if page[j + 1 : j + 2] in ("!", "?", "/"):
                k = page.find(">", j)
                i = n if k < 0 else k + 1
            else:  # a bare sign in the text
                text("&lt;")
                i = j + 1
            continue
        rest = _REST.match(page, m.end())
        if not rest:
            break
        tag, attributes, i = m[0].lower(), page[m.end() : rest.end() - 1], rest.end()
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                low = page.lower() if low is None else low
                if len(low) != n:  # a few characters change their length in lower case
                    found = re.compile("</" + tag, re.I).search(page, i)
                    end = found.start() if found else -1
                else:
                    end = low.find("</" + tag, i)
                end = n if end < 0 else page.find(">", end)
                i = n if end < 0 else end + 1
            text(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br" or tag == "img" or tag == "wbr":
            text(" ")
            continue
        if tag in BLOCK:
            close()
            kind = BARE if closing else KINDS.get(tag, BARE)
            in_link = False if tag != "li" else in_link
        elif not attributes and not closing or tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                while stack:
                    t, hints = stack.pop()
                    opened[t] -= 1
                    if t == tag:
                        break
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in BLOCK and stack and stack[-1][0] == "p":  # a block ends an open paragraph
                opened["p"] -= 1
                hints = stack.pop()[1]
            own = _hints(tag, attributes, hints)
            if own != hints and tag not in BLOCK:
                close()
            if tag in BLOCK or own != hints:
                stack.append((tag, hints))
                opened[tag] = opened.get(tag, 0) + 1
                hints = own
    close()
    free = [b for b in out if not b[4]]
    wraps = 2 * sum(b[2] for b in free if b[6]) > sum(b[2] for b in free)
    return [(*b[:4], int(b[4] or b[6] and not b[5] and not wraps), b[5]) for b in out]


def main_text(page: str, tree=None) -> str:
    tree = TREE if tree is None else tree
    blocks = text_blocks(page)
    return "\n\n".join([b[0] for b, x in zip(blocks, features([b[1:] for b in blocks])) if judge(tree, x) >= 0.5])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row: one narrow pass, without a shuffle."""
    ship(pages.sparkSession)
    tree = TREE

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py(), tree) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
