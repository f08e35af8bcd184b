"""Scans of raw files, their identity, and routing by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("text", "pdf", "docx", "pptx", "html", "unknown")
_OFFICE = "application/vnd.openxmlformats-officedocument."
MEDIA_TYPES = {
    "application/pdf": "pdf",
    f"{_OFFICE}presentationml.presentation": "pptx",
    f"{_OFFICE}wordprocessingml.document": "docx",
    **dict.fromkeys(("application/xhtml+xml", "text/html"), "html"),
    **dict.fromkeys(("text/x-markdown", "text/markdown", "text/plain"), "text"),
}
EXTENSIONS = {"html": ("html", "htm"), "pptx": ("pptx",), "docx": ("docx",), "pdf": ("pdf",), "text": ("mkd", "mdown", "markdown", "md", "text", "txt")}


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every file directly in a folder (or the one file) whose name has no leading dot.

    ``source, path, content, media_type, ingest_seq``; ingest_seq follows the path order.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("source"), "path", "content", F.lit(None).cast("string").alias("media_type"))
    return rows.where(~F.col("source").startswith(".")).withColumn("ingest_seq", F.xxhash64("path")).orderBy("path")


def from_media_type(media_type: Column) -> Column:
    """Format of a declared media type, whatever its parameters and case; null if none is known."""
    base = F.lower(F.trim(F.element_at(F.split(media_type, ";"), 1)))
    return F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), base)


def from_extension(name: Column) -> Column:
    out = None
    for kind, endings in EXTENSIONS.items():
        test = F.lower(name).rlike(r"\.(" + "|".join(endings) + ")$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def from_content(content: Column) -> Column:
    """Format by magic bytes: PDF, HTML, and zipped office files by the names of their parts, wherever these stand."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    part = lambda name: F.contains(content, F.lit(name.encode()))
    opening = F.lower(F.ltrim(F.substring(head, 1, 512)))
    zipped = head.startswith("PK\x03\x04")
    return (
        F.when(head.startswith("%PDF-"), "pdf")
        .when(zipped & part("ppt/"), "pptx")
        .when(zipped & (part("word/") | part("xl/") | part("[Content_Types].xml")), "docx")
        .when(opening.startswith("<!doctype html") | opening.startswith("<html"), "html")
    )


def route(name: Column, media_type: Column, content: Column) -> Column:
    """Format of a source: declared type, then file name, then magic bytes, then valid UTF-8 as text."""
    as_text = F.when(F.is_valid_utf8(content.cast("string")), "text")
    return F.coalesce(from_media_type(media_type), from_extension(name), from_content(content), as_text, F.lit("unknown"))


def identify(sources: DataFrame) -> DataFrame:
    """Add ``content_hash`` and ``document_id`` (its first 16 digits)."""
    return sources.withColumn("content_hash", F.sha2("content", 256)).withColumn("document_id", F.substring("content_hash", 1, 16))


def new_sources(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose (namespace, content_hash) isn't stored; of equal ones the first by ingest_seq.

    Hashes decide; contents join what is left of them.
    """
    keys = ["namespace", "content_hash"]
    first = sources.groupBy(*keys).agg(F.min("ingest_seq").alias("ingest_seq")).join(stored.select(*keys).distinct(), keys, "left_anti")
    return sources.join(first, [*keys, "ingest_seq"]).dropDuplicates([*keys, "ingest_seq"])
