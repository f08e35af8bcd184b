"""Pages and chunks as JSON text and back; what can't be read back is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGES = "array<struct<page:int,text:string,image_ref:string,image_data:string,text_chars:int,image_area_ratio:double,bitmap_area:double>>"
CHUNK = "struct<chunk_id:string,document_id:string,text:string,embed_text:string,page:int,ordinal:int,embedding:array<double>,embedding_model:string,headings:array<string>,metadata:map<string,string>>"


def encode_pages(pages: Column) -> Column:
    """JSON of an array of pages; image bytes as base64."""
    fields = [f.split(":")[0] for f in PAGES[len("array<struct<") : -2].split(",")]
    one = lambda p: F.struct(*[(F.base64(p[f]) if f == "image_data" else p[f]).alias(f) for f in fields])
    return F.to_json(F.transform(pages, one))


def decode_pages(text: Column) -> Column:
    """The array of pages that :func:`encode_pages` wrote, or null."""
    rows = F.from_json(text, PAGES, {"mode": "PERMISSIVE"})
    fields = [f.split(":")[0] for f in PAGES[len("array<struct<") : -2].split(",")]
    one = lambda p: F.struct(*[(F.try_to_binary(p[f], F.lit("base64")) if f == "image_data" else p[f]).alias(f) for f in fields])
    return F.transform(rows, one)


def encode_chunk(chunk: Column) -> Column:
    return F.to_json(chunk)


def decode_chunk(text: Column) -> Column:
    """The chunk that :func:`encode_chunk` wrote; null for what is no object."""
    return F.when(F.trim(text).startswith("{"), F.from_json(text, CHUNK))
