"""Text primitives as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filler that carries no content for matching, reranking and scoring.
STOP_WORDS = sorted(
    {
        *"which when where who what how".split(), *"the a an this that it its".split(), *"is are was were be".split(),
        *"of on in to at by as for from with".split(), *"and or do will".split(),
    }
)


def tokens(text: Column) -> Column:
    """ASCII alphanumeric runs of the lower-cased text, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct tokens without stop words, in order of first occurrence."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOP_WORDS)))


def eval_tokens(text: Column) -> Column:
    """Content tokens of a text whose ``[n]`` citation markers are blanked."""
    return content_tokens(F.regexp_replace(text, r"\[\d+\]", " "))


def words(text: Column) -> Column:
    """White-space separated words, as ``str.split`` gives them."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def newlines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two sets held as arrays."""
    return F.size(F.array_intersect(a, b))


def coverage(reference: Column, produced: Column) -> Column:
    """Share of the reference's content tokens that the produced text has; 1 if it has none to cover."""
    r, p = eval_tokens(F.coalesce(reference, F.lit(""))), eval_tokens(F.coalesce(produced, F.lit("")))
    return F.when(F.size(r) == 0, F.lit(1.0)).otherwise(overlap(r, p) / F.size(r))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(content: Column) -> Column:
    """The first 16 hex digits of the content's hash."""
    return F.substring(content_hash(content), 1, 16)


def heading_path(headings: Column) -> Column:
    """Non-blank headings joined as a path."""
    return F.coalesce(F.array_join(F.filter(F.transform(headings, lambda h: F.trim(h)), lambda h: h != ""), " > "), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal width, summed in order as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
