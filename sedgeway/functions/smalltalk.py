"""Small talk: whole messages that aren't questions about the corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUPS = """
    cheers | ty | many thanks | thank you | thanks | thanks a lot | much appreciated | thank you so much | appreciate it | thanks so much | thank you very much
    what is this | help | what do you do | what are you | who are you | what can you do | how do you work | what can i ask you | what can i ask | how do i use this | what should i ask | how does this work
    see ya | see you | bye | good bye | goodbye | goodnight | good night
    got it | ok | okay | nice | cool | perfect | great | understood | makes sense
    yo | hey | hi | hello | heya | hiya | howdy | hey there | hi there | hello there | good day | good evening | good afternoon | good morning | greetings
    test | testing | sup | whats up | you there | are you there | how is it going | hows it going | how are you doing | how are you
"""
PHRASES = sorted({p.strip() for line in _GROUPS.strip().splitlines() for p in line.split("|")})


def normalised(message: Column) -> Column:
    """Bare lower-case words: apostrophes vanish, other signs part words, space collapses."""
    plain = F.translate(F.lower(F.trim(message)), "'’", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z\s]+", " "), r"\s+", " "))


def is_small_talk(message: Column) -> Column:
    """Whether the whole message is a known phrase; a blank one isn't, a null one is null-safe false."""
    return F.coalesce(normalised(message).isin(PHRASES), F.lit(False))
