"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounds half up in plain double arithmetic, as any SQL engine repeats it."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def percent(part: Column, total: Column) -> Column:
    """100 * part / total to two digits; 0 of nothing."""
    return half_up(F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0)), 2)


def count_of(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == value)


def net(positive: Column, negative: Column, total: Column) -> Column:
    return (positive - negative) / F.greatest(total, F.lit(1))


def record_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the SHA-1 of the parts, joined by |; a null part is empty."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 16))


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def lowered(text: Column) -> Column:
    """In lower case, one letter for one: a dotted capital I becomes a plain i, and no i with a mark beside it, which would part a word."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def channel(name: Column, unknown: str | None = None) -> Column:
    """A channel's common name: x, tweets -> twitter; articles -> news; all, any -> null; others -> ``unknown``."""
    low = F.lower(F.trim(name))
    known = F.when(low.isin("x", "twitter", "tweet", "tweets"), "twitter").when(low.isin("news", "article", "articles"), "news").when(low == "reddit", "reddit")
    return F.coalesce(known, F.lit(unknown)) if unknown else known


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a lowered text has the phrase: with a space anywhere, without one as a word."""
    if " " in phrase:
        return text.contains(phrase)
    return text.contains(phrase) & text.rlike(rf"(?<!\w)\Q{phrase}\E(?!\w)")  # few texts come to the pattern


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a lowered text has."""
    return reduce(lambda a, b: a + b, (has_phrase(text, p).cast("int") for p in phrases))


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))
