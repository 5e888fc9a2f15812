"""Splitting long chunks at natural boundaries, by bounded-quantifier regular expressions in the JVM.

The alternatives stand in order of strength: the rest of the text, a line's end, a sentence's end, white space,
any character. Each consumes up to the limit; pieces after the first leave room for the overlap whatever the boundary,
a weaker one being taken where it must. What is matched includes the one character of white space at the cut, so the
matches tile the text. Overlaps look back into the piece before for its last whole words. The same alternatives without
room for overlaps tell the coarsest boundary that suffices for a text: the weakest one its extraction needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED = ("piece_no", "piece_text", "piece_start", "piece_end", "overlap_chars", "cut_kind")
KINDS = ("line", "sentence", "word", "char")
#: Internal columns have this prefix, so that the table's own may have any other names.
_OWN = "__piece_"


def cut_pattern(limit: int, overlap: int) -> str:
    def ways(most: int) -> str:
        return "|".join((rf".{{1,{most}}}+\z", rf".{{0,{most}}}\n", rf".{{1,{most}}}(?<=[.!?])\s", rf".{{0,{most}}}\s", rf".{{1,{most}}}+"))

    return rf"(?sU)\A(?:{ways(limit)})|{ways(limit - overlap - 1)}"


def kind_pattern(limit: int) -> str:
    """Pieces without overlap; white space in a line after a cut belongs to no piece."""
    blank = r"[^\S\n]*"
    return "(?sU)" + "|".join((rf".{{0,{limit}}}\n", rf".{{1,{limit}}}+\z", rf".{{1,{limit}}}(?<=[.!?])\s{blank}", rf".{{0,{limit}}}\s{blank}", rf".{{1,{limit}}}+"))


def cut_kind(text: Column, limit: int) -> Column:
    """The coarsest of line, sentence, word and char at which cutting alone keeps every piece within the limit."""
    cuts = F.regexp_extract_all(text, F.lit(kind_pattern(limit)), F.lit(0))

    def weakest(found: Column) -> Column:
        def way(c: Column, i: Column) -> Column:
            return F.when(c.endswith("\n") | (i == F.size(found) - 1), 0).when(c.rlike(r"(?U)[.!?]\s+\z"), 1).when(c.rlike(r"(?U)\s\z"), 2).otherwise(3)

        return F.array_max(F.transform(found, way))

    return F.get(F.array(*map(F.lit, KINDS)), F.get(F.transform(F.array(cuts), weakest), F.lit(0)))


def split_oversized(df: DataFrame, *, text: str, start_line: str, limit: int = 1500, overlap: int = 120) -> DataFrame:
    """df with one row for each piece and the added columns piece_no, piece_text, piece_start, piece_end, overlap_chars, cut_kind.

    Columns of df that have these names are replaced.

    A text within the limit comes out whole, with a null ``cut_kind``. Pieces are at most ``limit`` code points long;
    each after the first begins with the last whole words of the one before, at most ``overlap`` characters of them
    (none after a cut inside a run without white space, or where the last word alone is longer). Only white space at
    cuts is left out, and pieces of nothing else. ``piece_start`` and ``piece_end`` are line numbers, counted from
    ``start_line``; they are null where that is null. A null text gives no row, an empty one a single empty piece.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    own = lambda name: F.col(_OWN + name)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ADDED]
    t = own("text")
    base = df.select(*kept, F.col(text).alias(_OWN + "text"), F.col(start_line).alias(_OWN + "line")).filter(t.isNotNull())
    long = F.length(t) > limit
    cuts = F.regexp_extract_all(t, F.lit(cut_pattern(limit, overlap)), F.lit(0))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))

    def parts(found: Column) -> Column:
        """Each cut as its body, the white space after it, and its line breaks."""

        def part(c: Column, i: Column) -> Column:
            most = F.when(i == 0, limit).otherwise(limit - overlap - 1)
            gap = ((i < F.size(found) - 1) | (F.length(c) > most)) & F.substring(c, -1, 1).rlike(r"(?U)\A\s\z")
            return F.struct(F.when(gap, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c).alias("body"), F.when(gap, F.substring(c, -1, 1)).otherwise("").alias("gap"), breaks(c).alias("breaks"))

        return F.transform(found, part)

    def pieces(found: Column) -> Column:
        """Each part with the line breaks before it, and the end of the part before it, of which the overlap is taken."""

        def piece(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(found, i - 1))
            tail = F.when(before["gap"] != "", F.substring(before["body"], F.greatest(F.length(before["body"]) - overlap, F.lit(1)), F.lit(overlap + 1)))
            above = F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda n, q: n + q["breaks"])
            return F.struct(i.alias("at"), p["body"].alias("body"), tail.alias("tail"), F.length(before["body"]).alias("before"), before["gap"].alias("gap"), above.alias("above"))

        return F.transform(found, piece)

    # Each step's result is bound once: the optimizer would repeat the expression of a column for every mention of it.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    made = F.when(long, bound(bound(cuts, parts), pieces)).otherwise(bound(parts(F.array(t)), pieces))
    rows = base.select(*kept, own("line"), F.when(long, cut_kind(t, limit)).alias(_OWN + "kind"), F.explode_outer(made).alias(_OWN + "p"))
    p = own("p")
    rows = rows.filter(own("kind").isNull() | p["body"].rlike(r"(?U)\S"))
    again = F.when(p["before"] <= overlap, p["tail"]).otherwise(F.regexp_extract(p["tail"], r"(?sU)\A\S*\s+(\S.*)\z", 1))
    rows = rows.withColumn(_OWN + "again", F.coalesce(again, F.lit("")))
    lead_in = F.when(own("again") != "", F.concat(own("again"), p["gap"])).otherwise("")
    first = own("line") + p["above"]
    return rows.select(
        *kept,
        (p["at"] + 1).alias("piece_no"),
        F.concat(lead_in, p["body"]).alias("piece_text"),
        (first - breaks(lead_in)).alias("piece_start"),
        (first + breaks(p["body"])).alias("piece_end"),
        F.length(own("again")).alias("overlap_chars"),
        own("kind").alias("cut_kind"),
    )
