"""Main text of HTML pages by line-block distribution.

Markup is stripped so that every block of the page becomes a line. Text inside
menus, headers, footers, forms and the like is not text of the page. A menu,
header or footer of the page itself leaves empty lines behind; other such
containers leave nothing, so what they part stays together. Text lengths are
summed over a window of `window` lines sliding down the page. Where the sum
surges from nothing, text begins; where it dives to nothing, it ends. A stretch
that reaches `surge` characters in a window is text; from the first such stretch's
first line to the last one's last, every line is kept, short and linked ones too.
Lines that are mostly links begin or end none. Where a page marks its article,
lines outside weigh nothing and those inside `marked` times their length, links or
not, so that with these parameters no line of it is too short to count.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import arrow_map, table, text_or_empty

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements whose content is not markup and not text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "noframes", "xmp", "template", "svg", "math", "object"}
#: Elements that are never part of the article.
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "datalist"}
#: Those that part stretches of text where no other element than body encloses them.
PARTING = {"nav", "header", "footer", "menu"}
#: Words of a class, id or role that mark a container apart from the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "comment", "comments", "replies", "disqus",
    "promo", "sponsor", "sponsored", "share", "sharing", "social", "related", "newsletter", "subscribe", "widget", "footer", "copyright",
    "toolbar", "pagination", "pager", "masthead", "complementary", "contentinfo", "search", "alert", "login", "signup",
}
#: As MARKS, but only outside the article: there they may hold its title.
PAGE_MARKS = {"header", "head", "top"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end an open p, and those that an end or a new item does not reach across.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
CELLS = {"table", "td", "th", "caption"}
ITEMS, BUTTON = CELLS | {"ul", "ol"}, CELLS | {"button"}
LISTS = CELLS | {"ul", "ol", "dl", "menu", "section", "article", "aside", "blockquote", "main", "form", "nav", "header", "footer", "fieldset", "figure", "details", "body"}
#: Elements whose end tags may be left out: what a new one ends, and what it does not reach across.
IMPLIED = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, LISTS), "dd": ({"dt", "dd"}, LISTS),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
SPACED = {"br", "img", "input", "wbr"} - {"wbr"}


def _apart(name: str, attributes: str, in_article: bool) -> bool:
    if name in APART or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes:
        return False
    for key, *values in NAMES.findall(attributes):
        key, value = key.lower(), (values[0] or values[1] or values[2]).lower()
        if key == "hidden" and not value or key == "aria-hidden" and value == "true":
            return True
        words = set(re.split(r"[\s_\-]+", value))
        if key in ("class", "id", "role") and (words & MARKS or not in_article and words & PAGE_MARKS):
            return True
    return False


def _reached(stack: list[str], names: set[str], barrier: set[str]) -> int:
    """Where the innermost of the names stands in the stack; its length if there is none before a barrier."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i] in names:
            return i
        if stack[i] in barrier:
            break
    return len(stack)


class _Open:
    """The open elements, other than inline ones."""

    def __init__(self):
        self.stack: list[str] = []
        self.held: Counter = Counter()

    def push(self, name: str):
        self.stack.append(name)
        self.held[name] += 1

    def cut(self, size: int):
        while len(self.stack) > size:
            self.held[self.stack.pop()] -= 1

    def left(self, name: str, closing: bool) -> int:
        """How many stay open at a tag."""
        stack, held = self.stack, self.held
        if closing:
            if not held[name]:
                return len(stack)
            if name in ("table", "body", "html"):
                return _reached(stack, {name}, set())
            if name in IMPLIED and name not in ("li", "dt", "dd"):
                return _reached(stack, {name}, {"table", "select"})
            return _reached(stack, {name}, ITEMS if name == "li" else CELLS)
        left = len(stack)
        if held["p"] and name in ENDS_P:
            left = _reached(stack, {"p"}, BUTTON)
        if name in IMPLIED:
            names, barrier = IMPLIED[name]
            if any(held[n] for n in names):
                left = min(left, _reached(stack, names, barrier))
        return left


def lines_of(html: str, window: int) -> list[tuple[str, bool, int]]:
    """The page's lines: text, whether it stands in a marked article, characters inside links."""
    lines: list[tuple[str, bool, int]] = []
    pieces: list[str] = []
    linked = 0
    article = 0
    in_link = False
    elements = _Open()
    apart, base = "", 0  # the container that is being passed over, and where it stands among the open elements

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                lines.append((text, article > 0, linked))
        linked = 0

    # beyond the last > there is no tag to look for, only an unfinished comment
    at, end, last = 0, len(html), html.rfind(">") + 1
    while at < end:
        tag = TAG.search(html, at, last) if at < last else None
        if not tag and (open_ := html.find("<!--", at)) >= 0:
            html, end = html[:open_], open_
        if tag and tag[0].startswith("<!--") and not tag[0].endswith("-->"):
            end = tag.start()
        stop = tag.start() if tag else end
        if stop > at and not apart:
            pieces.append(piece := html[at:stop])
            if in_link:
                linked += len(piece.strip())
        if not tag:
            break
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if apart:
            if name in RAW:
                if not closing and not attributes.endswith("/"):
                    at = _past(html, name, at, last)
                continue
            if name in VOID and name != "hr" or name in INLINE and name != apart:
                continue
            left = elements.left(name, closing)
            if left > base:  # still inside
                elements.cut(left)
                if not closing and name not in VOID and not attributes.endswith("/"):
                    elements.push(name)
                continue
            elements.cut(base)
            own, apart = closing and name == apart, ""
            if own:
                continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                at = _past(html, name, at, last)
            if name not in ("noscript", "svg", "math", "object"):
                flush()
            continue
        if name in INLINE:
            if name in SPACED:
                pieces.append(" ")
            if name == "a":
                in_link = not closing
            if closing or name in VOID or not attributes or not _apart(name, attributes, article > 0):
                continue
            apart, base = name, len(elements.stack)
            elements.push(name)
            continue
        flush()
        in_link = False
        elements.cut(elements.left(name, closing))
        if not closing and name not in VOID and _apart(name, attributes, article > 0):
            apart, base = name, len(elements.stack)
            if not article and name in PARTING and set(elements.stack) <= {"html", "body"}:
                lines.extend([("", False, 0)] * window)
        elif name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
            if not article:
                lines.extend([("", False, 0)] * window)
        if not closing and name not in VOID:
            elements.push(name)
    flush()
    return lines


def _past(html: str, name: str, at: int, last: int) -> int:
    found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at, last)
    return found.end() if found else len(html)


def main_text(html: str, window: int = 3, surge: int = 80, marked: int = 80) -> str:
    """The article's blocks in page order, joined by two newlines; empty if none."""
    lines = lines_of(html, window)
    if any(a and t for t, a, _ in lines):
        lengths = [marked * len(t) if a else 0 for t, a, _ in lines]
    else:
        lengths = [len(t) if 2 * linked < len(t) else 0 for t, _, linked in lines]
    sums, total = [0] * len(lines), 0
    for i in range(len(lines) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lines) else 0)
        sums[i] = total
    out, between = [], []
    i = 0
    while i < len(lines):
        if not sums[i] or not lengths[i]:
            between.append(i)
            i += 1
            continue
        j, peak = i, 0
        while j < len(lines) and sums[j]:  # from the surge to the dive
            peak = max(peak, sums[j])
            j += 1
        if peak >= surge:
            out += (between if out else []) + list(range(i, j))
            between = []
        else:
            between += range(i, j)
        i = j
    inside = any(a and t for t, a, _ in lines)
    return "\n\n".join(lines[i][0] for i in out if lines[i][0] and (lines[i][1] or not inside))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), window: int = 3, surge: int = 80, marked: int = 80) -> DataFrame:
    """Main text of every page, one row for each input row.

    Returns `id_col`, the `keep` columns, text, n_chars. Null and empty html have
    an empty text. Null ids and repeated rows stay; an empty table gives an empty
    result; columns not named are ignored.
    """

    def rows(batch):
        for *before, html in zip(batch["id"], *(batch[f"keep{i}"] for i in range(len(keep))), batch["html"], strict=True):
            text = main_text(html, window, surge, marked)
            yield (*before, text, len(text))

    kind = lambda c: pages.schema[c].dataType.simpleString()
    out = arrow_map(
        pages.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), text_or_empty(html_col).alias("html")), rows,
        ", ".join([f"id {kind(id_col)}", *(f"keep{i} {kind(c)}" for i, c in enumerate(keep)), "text string", "n_chars long"]),
    )
    return out.toDF(id_col, *keep, "text", "n_chars")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
