"""PDFs built here, byte by byte, read back as Markdown and as words."""

import zlib

import pytest

from sedgeway.operators import pdf_geometry
from sedgeway.sources import parsers, pdf

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /LastChar 126 /Widths [" + b"500 " * 95 + b"] >>"
BOLD = FONT.replace(b"/Helvetica", b"/Helvetica-Bold")


def shown(x, y, text, size=10, font="F1"):
    text = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return f"BT /{font} {size} Tf 1 0 0 1 {x} {y} Tm ({text}) Tj ET"


def build(*pages, packed=False, extra=b""):
    """A file of these content streams, Flate-coded; ``packed`` puts the dictionaries into an object stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: FONT, 4: BOLD}
    kids, streams = [], {}
    for n, content in enumerate(pages):
        page, body = 10 + 2 * n, 11 + 2 * n
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % body
        raw = zlib.compress(content if isinstance(content, bytes) else content.encode("cp1252"))
        streams[body] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(raw), raw)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> %s >> >>" % (len(kids), b" ".join(kids), extra)
    if packed:
        head, body = b"", b""
        for number, value in objects.items():
            head += b"%d %d " % (number, len(body))
            body += value + b" "
        raw = zlib.compress(head + body)
        streams[90] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(objects), len(head), len(raw), raw)
        objects = {}
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in [*objects.items(), *streams.items()])
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


PROSE = "\n".join([shown(50, 750, "Annual report", 18, "F2"), *(shown(50, 700 - 14 * k, f"Line {k} of the text goes on.") for k in range(4))])


@pytest.mark.parametrize("packed", [False, True])
def test_headings_and_prose(packed):
    one, two = parsers.pdf_markdown(build(PROSE, shown(50, 700, "Second page (with brackets)."), packed=packed))
    assert one == "# Annual report\n\n" + " ".join(f"Line {k} of the text goes on." for k in range(4)) and two == "Second page (with brackets)."


def test_words_have_places():
    w = pdf.read_pages(build(shown(100, 700, "ab cde")))[0].words
    assert [x["text"] for x in w] == ["ab", "cde"] and [(round(x["x0"]), round(x["x1"])) for x in w] == [(100, 110), (115, 130)]
    assert all(x["size"] == 10 and x["fontname"] == "Helvetica" and 90 < x["top"] < x["bottom"] < 103 for x in w)


def test_columns():
    left = [shown(40, 700 - 15 * k, f"left {k} words words words words") for k in range(12)]
    right = [shown(340, 700 - 15 * k, f"right {k} words words words words") for k in range(12)]
    text = parsers.pdf_markdown(build("\n".join(x for pair in zip(left, right, strict=True) for x in pair)))[0]
    assert text.index("left 11") < text.index("right 0")


def test_ruled_table():
    lines = [f"50 {y} m 350 {y} l S" for y in (600, 630, 660)] + [f"{x} 600 m {x} 660 l S" for x in (50, 200, 350)]
    cells = [shown(60, 640, "Name"), shown(210, 640, "Price in euro"), shown(60, 610, "Bolt"), shown(210, 610, "3")]
    text = parsers.pdf_markdown(build("\n".join([shown(50, 700, "Before the table."), *lines, *cells, shown(50, 560, "After the table.")])))[0]
    assert text == "Before the table.\n\n| Name | Price in euro |\n| --- | --- |\n| Bolt | 3 |\n\nAfter the table."


def test_borderless_table():
    rows = [shown(50, 700 - 15 * k, a) + "\n" + shown(250, 700 - 15 * k, b) for k, (a, b) in enumerate([("Part", "Count"), ("Nut", "4"), ("Bolt", "5")])]
    wide = shown(50, 740, "A line of prose that is as wide as the table below it is, and then some more.")
    assert parsers.pdf_markdown(build("\n".join([wide, *rows])))[0] == "A line of prose that is as wide as the table below it is, and then some more.\n\n| Part | Count |\n| --- | --- |\n| Nut | 4 |\n| Bolt | 5 |"


def test_text_operators():
    body = "BT /F1 10 Tf 14 TL 50 700 Td [(Wo) 20 (rd) -600 (two)] TJ T* (next) Tj (third) ' 0 -30 TD <666f75727468> Tj ET q 2 0 0 2 0 0 cm BT /F1 5 Tf 25 250 Td (scaled) Tj ET Q"
    assert [w["text"] for w in pdf.read_pages(build(body))[0].words] == ["Word", "two", "next", "third", "fourth", "scaled"]
    assert pdf.read_pages(build(body))[0].words[-1]["size"] == 10


def test_unicode_map_and_forms():
    cmap = zlib.compress(b"begincmap 1 beginbfchar <0001> <00480065> endbfchar 1 beginbfrange <0002> <0003> <006C> endbfrange endcmap")
    more = b"20 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream endobj " % (len(cmap), cmap)
    more += b"21 0 obj << /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 20 0 R /DescendantFonts [22 0 R] >> endobj 22 0 obj << /DW 500 /W [1 [900 400]] >> endobj "
    form = b"BT /F9 10 Tf 0 0 Td <000100020003> Tj ET"
    more += b"23 0 obj << /Subtype /Form /Matrix [1 0 0 1 70 600] /Resources << /Font << /F9 21 0 R >> >> /Length %d >>\nstream\n%s\nendstream endobj " % (len(form), form)
    more += b"24 0 obj << /Subtype /Image /Length 3 >>\nstream\nabc\nendstream endobj "
    data = build("/X1 Do q 300 0 0 200 10 20 cm /X2 Do Q", extra=b"/XObject << /X1 23 0 R /X2 24 0 R >>").replace(b"trailer", more + b"trailer")
    page = pdf.read_pages(data)[0]
    assert [(w["text"], round(w["x0"])) for w in page.words] == [("Helm", 70)] and [tuple(map(round, b)) for b in page.images] == [(10, 580, 310, 780)]


def test_predictor():
    about = {"Predictor": 15, "Columns": 4}
    rows = b"\x00\x01\x02\x03\x04" + b"\x02\x01\x01\x01\x01" + b"\x01\x05\x01\x01\x01" + b"\x03\x02\x00\x00\x00" + b"\x04\x01\x00\x00\x00"
    assert pdf._unpredicted(rows, about) == bytes([1, 2, 3, 4, 2, 3, 4, 5, 5, 6, 7, 8, 4, 5, 6, 7, 5, 5, 6, 7])


@pytest.mark.parametrize("bad", [b"", b"no pdf", b"%PDF-1.4\nnothing", build(PROSE).replace(b"/Root", b"/Encrypt 5 0 R /Root")])
def test_unreadable(spark, bad):
    row = parsers.parse(spark.createDataFrame([("d", "pdf", bytearray(bad))], "document_id string, format string, content binary")).first()
    assert row["error"] and row["text"] is None


def test_tables_of_words(spark):
    docs = spark.createDataFrame([("a", bytearray(build(PROSE, ""))), ("b", bytearray(b"x"))], "document_id string, content binary")
    words, images = parsers.pdf_words(docs)
    assert pdf_geometry.measures(words, images).collect()[0]["text_chars"] == sum(len(w) for w in "Annual report".split()) + 4 * len("Line0ofthetextgoeson.")
    assert pdf_geometry.markdown(words).first()["text"].startswith("# Annual report")
