"""Parsers from bytes to pages, one function a format, run in Arrow batches.

``parse`` dispatches on the routed format and never fails a job: what can't be read comes back as a
row with an ``error`` and no text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeway.functions.text import newlines

PAGE_SCHEMA = "document_id string, page int, text string, error string"
CHROME = ("script", "style", "nav", "header", "footer", "aside", "noscript")


def form_feed_pages(docs: DataFrame, key: str = "document_id") -> DataFrame:
    """Pages of plain text parted by form feeds, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(newlines(F.col("text")), "\f")).alias("p", "text")).select(key, (F.col("p") + 1).alias("page"), "text")


def _space(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Tree(HTMLParser):
    """A plain element tree: [tag, children]; children are trees or strings.  Comments are left out."""

    _void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    _ends = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
    _blocks = {"p", "div", "ul", "ol", "table", "section", "article", "main", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "nav", "footer", "header", "aside", "form"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["#", []]
        self.open: list[list] = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        implied = self._ends.get(tag, set()) | ({"p"} if tag in self._blocks else set())
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] in implied:
                del self.open[depth:]
                break
            if self.open[depth][0] in ("ul", "ol", "table", "div", "section", "article", "main", "body"):
                break
        node: list = [tag, []]
        self.open[-1][1].append(node)
        if tag not in self._void:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][1].append(data)


def _walk(node: list) -> Iterator[list]:
    yield node
    for child in node[1]:
        if isinstance(child, list) and child[0] not in CHROME:
            yield from _walk(child)


def _text(node: list | str, glue: str = " ") -> str:
    if isinstance(node, str):
        return node
    return "" if node[0] in CHROME else glue.join(t for t in (_text(c, glue) for c in node[1]) if t)


def _render(node: list) -> list[str]:
    out: list[str] = []
    for child in node[1]:
        if isinstance(child, str):
            out.append(_space(child))
            continue
        tag = child[0]
        if tag in CHROME or tag in ("hr", "br", "head", "title"):
            continue
        line = _space(_text(child))
        if re.fullmatch("h[1-6]", tag):
            out.append(f"{'#' * int(tag[1])} {line}" if line else "")
        elif tag == "p":
            out.append(line)
        elif tag in ("ul", "ol"):
            items = [_space(_text(c)) for c in child[1] if isinstance(c, list) and c[0] == "li"]
            out.append("\n".join(f"{f'{n}.' if tag == 'ol' else '-'} {item}".rstrip() for n, item in enumerate(items, 1)))
        elif tag == "table":
            rows = [[_space(_text(c)).replace("|", "\\|") for c in r[1] if isinstance(c, list) and c[0] in ("td", "th")] for r in _walk(child) if r[0] == "tr"]
            out.append(pipe_table(rows))
        elif tag == "pre":
            code = _text(child, "").strip("\n")
            out.append(f"```\n{code}\n```" if code else "")
        elif tag == "blockquote":
            out.append(f"> {line}" if line else "")
        elif any(isinstance(c, list) for c in child[1]) or tag in ("div", "section", "article", "main", "body", "html"):
            out.extend(_render(child))
        else:
            out.append(line)
    return [block for block in out if block]


def pipe_table(rows: list[list[str]]) -> str:
    """A Markdown table as wide as its first row; longer rows are cut, shorter ones padded."""
    width = len(rows[0]) if rows else 0
    if not width:
        return ""
    line = lambda cells: "| " + " | ".join((cells + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def html_markdown(content: bytes) -> str:
    """Markdown of the content root: main, else article, else the container with most text, else the body."""
    declared = re.search(rb"charset\s*=\s*[\"']?\s*([\w-]+)", content[:4096], re.I)
    try:
        page = content.decode(declared[1].decode("ascii") if declared else "utf-8")
    except (LookupError, UnicodeDecodeError):
        page = content.decode("utf-8", "replace")
    tree = _Tree()
    tree.feed(page)
    tree.close()
    nodes = list(_walk(tree.root))
    root = next((n for tag in ("main", "article") for n in nodes if n[0] == tag), None)
    if root is None:
        sized = [(len("".join(_text(n).split())), n) for n in nodes if n[0] in ("div", "section")]
        root = max(sized, key=lambda s: s[0], default=(0, None))
        root = root[1] if root[0] else next((n for n in nodes if n[0] == "body"), tree.root)
    return "\n\n".join(_render(root))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_markdown(content: bytes) -> str:
    """Body of a DOCX in order: headings by style, nested lists, pipe tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                if name is not None:
                    names[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "")
    para = lambda p: _space("".join(t.text or "" if t.tag == f"{_W}t" else " " for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")))
    out: list[str] = []
    listed = False
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(para, c.iter(f"{_W}p")))).replace("|", "\\|") for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            out.append(pipe_table(rows))
            listed = False
            continue
        if node.tag != f"{_W}p":
            continue
        text = para(node)
        if not text:
            continue
        style = node.find(f"{_W}pPr/{_W}pStyle")
        style_id = style.get(f"{_W}val", "") if style is not None else ""
        name = names.get(style_id, style_id)
        heading = re.fullmatch(r"heading\s*(\d+)", name, re.I)
        numbered = node.find(f"{_W}pPr/{_W}numPr")
        bullet = re.match(r"List (?:Bullet|Number|Paragraph)\s*(\d*)", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name), re.I)
        if name.lower() == "title":
            out.append(f"# {text}")
        elif heading:
            out.append(f"{'#' * min(6, max(1, int(heading[1])))} {text}")
        elif numbered is not None or bullet:
            level = numbered.find(f"{_W}ilvl") if numbered is not None else None
            depth = int(level.get(f"{_W}val", 0)) if level is not None else int(bullet[1] or 1) - 1 if bullet else 0
            item = f"{'  ' * depth}- {text}"
            if listed:
                out[-1] += "\n" + item
            else:
                out.append(item)
            listed = True
            continue
        else:
            out.append(text)
        listed = False
    return "\n\n".join(b for b in out if b)


def pptx_markdown(content: bytes) -> list[str]:
    """One page a slide: title, bullets by level, tables, notes."""
    pages = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        para = lambda p: _space("".join(t.text or "" if t.tag == f"{_A}t" else " " for t in p.iter() if t.tag in (f"{_A}t", f"{_A}br")).replace("\v", " "))
        for name in slides:
            title, blocks = "", []
            root = ElementTree.fromstring(z.read(name))
            for shape in root.iter():
                if shape.tag == f"{_P}sp":
                    kind = shape.find(f".//{_P}ph")
                    lines = [(int(p.find(f"{_A}pPr").get("lvl", 0)) if p.find(f"{_A}pPr") is not None else 0, para(p)) for p in shape.iter(f"{_A}p")]
                    lines = [(d, t) for d, t in lines if t]
                    if kind is not None and kind.get("type") in ("title", "ctrTitle"):
                        title = " ".join(t for _, t in lines)
                    elif lines:
                        blocks.append("\n".join(f"{'  ' * d}- {t}" for d, t in lines))
                elif shape.tag == f"{_A}tbl":
                    blocks.append(pipe_table([[" ".join(filter(None, map(para, c.iter(f"{_A}p")))).replace("|", "\\|") for c in r.findall(f"{_A}tc")] for r in shape.findall(f"{_A}tr")]))
            note = name.replace("slides/slide", "notesSlides/notesSlide")
            if note in names:
                spoken = []
                for shape in ElementTree.fromstring(z.read(note)).iter(f"{_P}sp"):
                    kind = shape.find(f".//{_P}ph")
                    if kind is not None and kind.get("type") == "body":
                        spoken += [t for t in map(para, shape.iter(f"{_A}p")) if t]
                if spoken:
                    blocks.append("### Notes\n\n" + "\n".join(spoken))
            pages.append("\n\n".join([f"## {title}".rstrip(), *blocks]))
    return pages


def _plain(content: bytes) -> list[str]:
    return [content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")]


def pdf_markdown(content: bytes) -> list[str]:
    """Markdown of each page of a PDF by the geometry of its words and rules; a page without text is empty."""
    from sedgeway.operators import pdf_geometry
    from sedgeway.sources import pdf

    return [pdf_geometry.page_markdown(p.words, p.width, pdf_geometry.ruled_tables(p.words, p.rules)) for p in pdf.read_pages(content)]


def pdf_words(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words and the images of PDFs (``document_id, content``) as the tables that :mod:`~sedgeway.operators.pdf_geometry` measures.

    A file that can't be read has neither.
    """
    from sedgeway.sources import pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, content in zip(batch["document_id"], batch["content"], strict=True):
                try:
                    pages = pdf.read_pages(bytes(content))
                except Exception:  # parse() says why
                    continue
                for n, p in enumerate(pages, 1):
                    rows += [(doc, n, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w["size"], w["fontname"], p.width, p.height) for w in p.words]
                    rows += [(doc, n, None, x0, x1, top, bottom, None, None, p.width, p.height) for x0, top, x1, bottom in p.images]
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "x0", "x1", "top", "bottom", "size", "fontname", "width", "height"])

    schema = "doc string, page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, width double, height double"
    every = sources.select("document_id", "content").mapInPandas(run, schema)
    return every.where("text is not null"), every.where("text is null").drop("text", "size", "fontname")


PARSERS: dict[str, Callable[[bytes], list[str]]] = {
    "text": _plain, "html": lambda c: [html_markdown(c)], "docx": lambda c: [docx_markdown(c)], "pptx": pptx_markdown, "pdf": pdf_markdown,
}


def parse(sources: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """``document_id, page, text, error`` of ``sources(document_id, format, content)``.

    ``parsers`` adds or replaces functions from bytes to page texts, by format.
    """
    table = PARSERS | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, kind, content in zip(batch["document_id"], batch["format"], batch["content"], strict=True):
                try:
                    if kind not in table:
                        raise ValueError(f"no parser for format {kind}")
                    rows += [(doc, n, text, None) for n, text in enumerate(table[kind](bytes(content)), 1)]
                except Exception as e:  # quarantined, with its reason
                    rows.append((doc, 1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document_id", "page", "text", "error"])

    return sources.select("document_id", "format", "content").mapInPandas(run, PAGE_SCHEMA)
