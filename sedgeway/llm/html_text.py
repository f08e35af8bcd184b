"""Main text of web pages by tree scoring.

The page is read into a tree of elements with the recovery rules that matter for text (implied ends
of p, li, cells; unclosed and misnested tags).  Every paragraph passes points for its length and
commas to its ancestors, fading with distance; an element's points are discounted by its link
density.  The best container is kept, widened to the article or main element around it, with the
siblings that score or read like it.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are known by tag and role, and by class or id where these leave
no doubt or the element's length and link density agree with them; never headings, and paragraphs
only by an unmistakable class.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeway.llm import common

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>\x00]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
#: Content is no markup: read up to the end tag.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp", "noembed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "input", "nobr",
}
_DROP = {
    "aside", "form", "footer", "nav", "header", "template", "iframe", "noscript", "style", "script", "svg", "canvas", "button", "select",
    "option", "textarea", "input", "menu", "dialog", "object", "embed", "audio", "video", "head", "title", "math", "map", "noframes", "applet", "datalist", "fieldset",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status", "tablist"}
def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[-_\s])(?:{words})(?:$|[-_\s])", re.I)


#: What a class or id says of a container: that it is an advert or has comments; that it is page furniture; that it may be,
#: if what it holds bears that out, as articles have sections on related work and warnings too.
_DECISIVE = _named(r"ads?|adv|adverts?|advertis\w*|adsense|adbox|adslot|dfp|sponsor\w*|outbrain|taboola|comments?|comment\w*|disqus|respond")
_FURNITURE = _named(
    r"promo\w*|banners?|side-?bars?|menus?|nav\w*|breadcrumbs?|footer\w*|masthead|cookies?\w*|consent|gdpr|pop-?ups?|modal|newsletters?|subscri\w*|sign-?up|login"
    r"|share\w*|social\w*|widgets?|toolbar|pagination|pager|hidden"
)
_DOUBTFUL = _named(r"foot|header\w*|repl(?:y|ies)|discussion|notices?|overlay|sharing|related\w*|recommend\w*|alerts?|disclaimer|copyright|skip|warning|legal")
#: Text of a doubtful element may be so long at most, if it has no heading and few links.
SHORT = 200
#: Share of a doubtful element's text in links from which it is a list of links.
LINKED = 0.33
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_SCOPE = {"table", "td", "th", "body", "html", "article", "main", "section", "div", "li"}
_START = {"div": 5, "article": 25, "main": 25, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "th": -5}
#: Elements of running text, which an id only makes a target of links.
_RUNNING = {"p", "pre", "blockquote", "li", "td", "th", "dt", "dd", "figure", "figcaption", "caption", "tr", "tbody", "thead", "code", "em", "strong"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TOP = {"html", "body", "#root"}
#: Characters from which a block counts as a paragraph.
PARAGRAPH = 25


def _suspicion(name: str, key: str, value: str) -> str:
    """What a class or id says against an element; the greater string is the stronger word."""
    if name in ("article", "main"):
        return "decisive" * (key == "class" and name == "article" and bool(re.search(r"comment|repl(?:y|ies)", value, re.I)))
    if name in _RUNNING:
        return "certain" * (key == "class" and bool(_DECISIVE.search(value) or _FURNITURE.search(value)))
    if _DECISIVE.search(value):
        return "decisive"
    if _FURNITURE.search(value):
        return "certain" if key == "class" else "by id"
    return ("by class" if key == "class" else "an id") if _DOUBTFUL.search(value) else ""


class _Page:
    """Elements (parent, tag, dropped, what class and id say) and blocks (element, text, characters in links) in page order."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.drop, self.bad = [-1], ["#root"], [False], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._parts, self._linked = [0], [], []
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            text = _SPACE.sub(" ", _html.unescape("".join(self._parts))).strip()
            if text:
                links = len(_SPACE.sub(" ", _html.unescape("".join(self._linked))).strip()) if self._linked else 0
                at = next(k for k in reversed(self._stack) if self.tag[k] not in _INLINE)
                self.blocks.append((at, text, min(links, len(text))))
            self._parts, self._linked = [], []

    def _text(self, text: str) -> None:
        if text and not self.drop[self._stack[-1]]:
            self._parts.append(text)
            if any(self.tag[k] == "a" for k in reversed(self._stack)):
                self._linked.append(text)

    def _pop_to(self, names: set, stop: set) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in names:
                del self._stack[depth:]
                return
            if tag in stop:
                return

    def _open(self, name: str, attrs: str) -> None:
        block = name not in _INLINE
        if block:
            self._flush()
            self._pop_to({"p"} | (_HEADINGS if name in _HEADINGS else set()), _SCOPE)
            while len(self._stack) > 1 and self.tag[self._stack[-1]] in _INLINE:  # inline elements end with their block
                self._stack.pop()
            if name in _CLOSES:
                names, stop = _CLOSES[name]
                for _ in range(3):
                    self._pop_to(names, stop)
        top = self._stack[-1]
        drop, bad = self.drop[top] or name in _DROP, ""
        if attrs and not drop:
            for key, *values in _ATTR.findall(attrs):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id") and name not in _TOP and name not in _HEADINGS:
                    bad = max(bad, _suspicion(name, key, value))
                elif key == "role" and value.lower() in _ROLES or key == "aria-hidden" and value.lower() == "true" or key == "hidden":
                    drop = True
        if name in _VOID:
            return
        self.parent.append(top)
        self.tag.append(name)
        self.drop.append(drop)
        self.bad.append(bad)
        self._stack.append(len(self.tag) - 1)

    def _close(self, name: str) -> None:
        if name not in _INLINE:
            self._flush()
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag == name:
                del self._stack[depth:]
                return
            if name in _INLINE and tag not in _INLINE:
                return

    def _read(self, page: str) -> None:
        at, n, lower = 0, len(page), None
        for m in iter(lambda: _TAG.search(page, at), None):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self._text(m["cdata"])
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["end"]:
                self._close(name)
                continue
            if name == "br":
                self._text(" ")
                continue
            if name in _RAW:
                lower = page.lower() if lower is None else lower
                stop = lower.find("</" + name, at) if len(lower) == n else page.find("</" + name, at)
                if stop < 0 and name in ("title", "noscript"):
                    continue
                if name != "noscript" or stop >= 0:
                    at = n if stop < 0 else stop
                if name not in _INLINE:
                    self._flush()
                continue
            self._open(name, m["attrs"])
        if at < n:
            self._text(page[at:])

    def ancestors(self, node: int) -> Iterator[int]:
        while node > 0:
            yield node
            node = self.parent[node]


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks joined by blank lines; empty if it has none."""
    if not page:
        return ""
    p = _Page(page)
    if not p.blocks:
        return ""
    n = len(p.tag)
    chars, links, has_article, headed, inside = [0] * n, [0] * n, [False] * n, [False] * n, [False] * n
    for at, text, linked in p.blocks:
        for a in p.ancestors(at):
            chars[a] += len(text)
            links[a] += linked
            headed[a] = headed[a] or p.tag[at] in _HEADINGS
    for k in range(n - 1, 0, -1):
        if p.tag[k] in ("article", "main") and not p.bad[k]:
            for a in p.ancestors(p.parent[k]):
                has_article[a] = True
    total = sum(len(text) for _, text, _ in p.blocks)

    def out(k: int) -> bool:
        """Whether an element goes for its class or id, given where it stands and what it holds."""
        word = p.bad[k]
        # a wrapper that holds the article, or nearly all of the page, stays
        if not word or has_article[k] or chars[k] >= (0.95 if word == "decisive" else 0.7) * total:
            return False
        if word in ("decisive", "certain") or word == "by id" and not inside[k]:
            return True
        if links[k] >= LINKED * chars[k]:
            return True
        if headed[k] or word == "an id" and inside[k]:
            return False
        return chars[k] < SHORT or word == "by class" and not inside[k]

    gone = [False] * n
    for k in range(1, n):
        inside[k] = inside[p.parent[k]] or p.tag[p.parent[k]] in ("article", "main")
        gone[k] = gone[p.parent[k]] or p.drop[k] or out(k)
    live = [b for b in p.blocks if not gone[b[0]]]
    if not live:
        return ""
    points: dict[int, float] = {}
    for at, text, _ in live:
        if len(text) < PARAGRAPH or p.tag[at] in _HEADINGS:
            continue
        worth = 1 + text.count(",") + min(len(text) / 100, 3)
        up = at if p.tag[at] not in ("p", "pre", "td", "blockquote") else p.parent[at]
        for depth, a in enumerate(p.ancestors(up)):
            points[a] = points.get(a, _START.get(p.tag[a], 0)) + worth / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
    for k in range(1, n):
        if p.tag[k] in ("article", "main") and not gone[k] and chars[k]:
            points.setdefault(k, _START[p.tag[k]])
    value = {k: v * (1 - links[k] / chars[k]) for k, v in points.items() if chars[k]}
    if not value:
        return "\n\n".join(text for _, text, _ in live)
    best = max(value, key=lambda k: (value[k], -k))
    for a in p.ancestors(best):
        if p.tag[a] in ("article", "main"):
            best = a
            break
    kept = {best}
    if p.tag[best] not in _TOP:
        least = max(3, 0.25 * value.get(best, 0))
        for k in range(1, n):
            if k != best and p.parent[k] == p.parent[best] and not gone[k] and chars[k] and p.tag[best] not in ("article", "main"):
                density = links[k] / chars[k]
                if value.get(k, 0) >= least or p.tag[k] == "h1" or (p.tag[k] == "p" and (density < 0.25 and chars[k] > 80 or density == 0)):
                    kept.add(k)
            elif k != best and p.tag[k] == "article" == p.tag[best] and p.parent[k] == p.parent[best] and not gone[k] and value.get(k, 0) >= least:
                kept.add(k)
    return "\n\n".join(text for at, text, _ in live if any(a in kept for a in p.ancestors(at)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    A null or empty html has the empty text; null ids and urls are kept as such; repeated rows give
    repeated results; an empty table gives no rows; pages are read whole, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        common.frugal(run), "page_id long, url string, text string, n_chars long"
    )
