"""Metadata tags at the end of a line, such as {explicit, user, from 2026-08-14}, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a tag may hold, and its pattern.
AUTHORITIES = ("explicit", "observed", "imported", "inferred")
SOURCES = ("user", "tool", "agent", "document")
TAG = r"[ \t]*\{([^{}\n]*)\}[ \t]*$"


def parse_tag(body: Column) -> Column:
    """(authority, source, valid_from, valid_until, supersedes) of what stands between the braces; null if it is no tag.

    Every item must be known and every field occur once; dates must exist, and ``until`` not lie before ``from``.
    """
    items = F.transform(F.split(body, ","), lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))
    day = lambda s: F.regexp_extract(s, r"^(?i:from|until)\s+(\d{4}-\d{2}-\d{2})$", 1)

    def kind(s: Column) -> Column:
        low = F.lower(s)
        return (
            F.when(low.isin(*AUTHORITIES), "authority").when(low.isin(*SOURCES), "source")
            .when(day(s) != "", F.when(F.try_to_date(day(s), "yyyy-MM-dd").isNull(), "bad").otherwise(F.concat(F.lit("valid_"), F.regexp_extract(low, r"^(from|until)", 1))))
            .when(s.rlike(r"^supersedes:?\s+\S.{0,60}$"), "supersedes").otherwise("bad")
        )

    def made(told: Column) -> Column:
        """The tag from its items as (kind, text), bound once by the caller."""
        kinds = F.transform(told, lambda x: x["kind"])
        of = lambda name: F.get(F.filter(told, lambda x: x["kind"] == name), F.lit(0))["text"]
        date = lambda name: F.try_to_date(day(of(name)), "yyyy-MM-dd")
        fits = ~F.array_contains(kinds, "bad") & (F.size(F.array_distinct(kinds)) == F.size(kinds)) & F.coalesce(date("valid_until") >= date("valid_from"), F.lit(True))
        tag = F.struct(
            F.lower(of("authority")).alias("authority"), F.lower(of("source")).alias("source"), date("valid_from").alias("valid_from"), date("valid_until").alias("valid_until"),
            F.trim(F.regexp_extract(of("supersedes"), r"^supersedes:?\s+(\S.{0,60})$", 1)).alias("supersedes"),
        )
        return F.when(fits, tag)

    told = F.transform(items, lambda s: F.struct(kind(s).alias("kind"), s.alias("text")))
    return F.when(body.isNotNull(), F.get(F.transform(F.array(told), made), F.lit(0)))


def line_tag(line: Column) -> Column:
    """The tag at the end of a line, or null."""
    return F.when(line.rlike(TAG), parse_tag(F.regexp_extract(line, TAG, 1)))


def without_tag(line: Column) -> Column:
    """A line without its closing tag; other braces stay."""
    return F.when(line_tag(line).isNotNull(), F.regexp_replace(line, TAG, "")).otherwise(line)


def strip_tags(text: Column) -> Column:
    """A text without the valid tags at the ends of its lines."""
    return F.array_join(F.transform(F.split(text, "\n", -1), without_tag), "\n")
