"""Page routing by layout, and vision text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS, MAX_RATIO, MAX_BITMAP = 24, 0.5, 50_000.0


def has_usable_text(text: Column, chars: Column, ratio: Column, bitmap: Column, min_chars: int = MIN_CHARS, max_bitmap: float | None = MAX_BITMAP) -> Column:
    """Without a layout (null chars): any text at all; else enough characters, little image, no large bitmap."""
    test = (chars >= min_chars) & (ratio < MAX_RATIO)
    if max_bitmap is not None:
        test = test & (bitmap < max_bitmap)
    return F.when(chars.isNull(), F.trim(F.coalesce(text, F.lit(""))) != "").otherwise(test)


def page_route(usable: Column, has_image: Column) -> Column:
    """``vision`` where the text is unusable and there is an image to read, else ``text``."""
    return F.when(~usable & has_image, "vision").otherwise("text")


def route_counts(pages: DataFrame, key: str) -> DataFrame:
    """Pages per route; both counts are there even where one is 0."""
    return pages.groupBy(key).agg(F.count_if(F.col("route") == "text").alias("text_pages"), F.count_if(F.col("route") == "vision").alias("vision_pages"))


def transcribed(pages: DataFrame, transcribe: Callable[[bytes], str] | None = None) -> DataFrame:
    """Vision pages (``route, image_ref, image_data``) with the text of their image; offline, its bytes read as UTF-8."""
    if transcribe is None:
        seen = F.coalesce(F.make_valid_utf8(F.col("image_data").cast("string")), F.concat(F.lit("[vision transcription of "), F.col("image_ref"), F.lit("]")))
    else:
        seen = F.pandas_udf(lambda s: s.map(lambda b: transcribe(bytes(b)) if b is not None else ""), "string")(F.col("image_data"))
    return pages.withColumn("text", F.when(F.col("route") == "vision", seen).otherwise(F.col("text")))


