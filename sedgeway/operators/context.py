"""What is put before a chunk when it is embedded."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sedgeway.functions.text import heading_path
from sedgeway.operators.chunking import count_estimate

MAX_CONTEXT_TOKENS = 128


def tagged(source: Column, text: Column) -> Column:
    """The chunk behind a tag with its source."""
    return F.concat(F.lit("[Context: "), source, F.lit("] "), text)


def heading_header(source: Column, headings: Column) -> Column:
    """Document line, and a section line where there is a heading path."""
    path = heading_path(headings)
    return F.concat(F.lit("Document: "), source, F.when(path != "", F.concat(F.lit("\nSection: "), path)).otherwise(F.lit("")))


def locate(full: str, chunk: str) -> tuple[int, int] | None:
    """Where the chunk lies: exactly, else from its first line's place to its last line's."""
    at = full.find(chunk)
    if at >= 0:
        return at, at + len(chunk)
    lines = [x.strip() for x in chunk.splitlines() if x.strip()]
    if not lines or (at := full.find(lines[0])) < 0:
        return None
    end = full.find(lines[-1], at)
    return at, (end + len(lines[-1])) if end >= 0 else at + len(lines[0])


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def sentences(text: str) -> list[str]:
    """Sentences end at their mark or with their line."""
    return [s.strip() for s in re.split(r"\n+|(?<=[.!?])\s+", text) if s.strip()]


def _near(pieces: list[str], glue: str, budget: int, tail: bool, count: Callable[[str], int]) -> str:
    """As many whole pieces as fit, from the end that touches the chunk."""
    best = ""
    for n in range(1, len(pieces) + 1):
        joined = glue.join(pieces[-n:] if tail else pieces[:n])
        if count(joined) > budget:
            break
        best = joined
    return best


def _fitted(parts: list[str], budget: int, tail: bool, count: Callable[[str], int]) -> str:
    if budget <= 0 or not parts:
        return ""
    return _near(parts, "\n\n", budget, tail, count) or _near(sentences(parts[-1] if tail else parts[0]), " ", budget, tail, count)


def situate(full: str, chunk: str, header: str, window: int, budget: int, count: Callable[[str], int] = count_estimate) -> str:
    """Header, neighbouring paragraphs within the budget, and the chunk as it is.

    The header is charged but never cut; what precedes may take half of the rest, what follows all
    that is left.  Whole paragraphs are taken, else whole sentences of the nearest, else nothing.
    """
    place = locate(full, chunk) if window else None
    size = lambda s: count(s) if s else 0
    left = max(0, budget - size(header))
    before = after = ""
    if place:
        before = _fitted(paragraphs(full[: place[0]])[-window:], left // 2, True, count)
        after = _fitted(paragraphs(full[place[1] :])[:window], left - size(before), False, count)
    parts = [header, before and "Preceding: " + before, after and "Following: " + after, chunk]
    return "\n\n".join(p for p in parts if p)


def heading_window(source: Column, headings: Column, text: Column, full_text: Column, window: int = 2, max_context_tokens: int = MAX_CONTEXT_TOKENS) -> Column:
    """Text to embed with heading path and neighbouring paragraphs; without a window it is pure SQL."""
    if window < 0 or max_context_tokens < 0:
        raise ValueError("window and max_context_tokens must not be negative")
    header = heading_header(source, headings)
    if window == 0:
        return F.concat_ws("\n\n", header, text)

    @F.pandas_udf(StringType())
    def run(full: pd.Series, chunk: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([situate(f or "", c or "", h or "", window, max_context_tokens) for f, c, h in zip(full, chunk, head, strict=True)])

    return run(full_text, text, header)


def contextualized(text: Column, full_text: Column, model: Callable[[pd.Series, pd.Series], pd.Series]) -> Column:
    """The seam for a model: ``model(documents, chunks)`` per Arrow batch says what goes before each chunk; a blank reply is none."""
    said = F.trim(F.pandas_udf(model, "string")(full_text, text))
    return F.when(F.coalesce(said, F.lit("")) == "", text).otherwise(F.concat(said, F.lit("\n\n"), text))
