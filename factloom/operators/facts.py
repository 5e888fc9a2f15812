"""Facts over time: supersession and conflicts, entries, values at a date, timelines, differences between dates.

All functions take a table of assertions: key, chunk_id, ord, path, label, value (normal form), raw_value, start date,
source (of the date), authority, valid_until date. Choices within a key are nested aggregates and never windows over
a whole key, so they combine on the map side whatever the size of a key; windows run within blocks of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.freshness import WEAK_SOURCES

# Same-date tie-break, a stated fact before one read by a tool, copied in, or guessed.
AUTHORITY = {"explicit": 4, "observed": 3, "imported": 2, "inferred": 1}
OLDEST = "0001-01-01"


def rank_of(authority: Column) -> Column:
    out = F.lit(0)
    for name, r in AUTHORITY.items():
        out = F.when(authority == name, r).otherwise(out)
    return out


def at_cutoffs(assertions: DataFrame, cutoffs: Sequence[date | None]) -> DataFrame:
    """assertions once for each cutoff that they count at: known starts after it are left out, undated ones stay."""
    days = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    rows = assertions.select("*", F.explode(days).alias("cutoff"))
    return rows.filter("cutoff is null or start is null or start <= cutoff")


def conflicts(assertions: DataFrame, cutoffs: Sequence[date | None] = (None,)) -> DataFrame:
    """(cutoff, key, label, winner, winner_value, winner_raw, winner_start, resolved, reason), one row for each conflict.

    A key is in conflict when it has different values, unless all of them stand in one file with one start (a list).
    The newest start wins, then the highest authority, then the last chunk. Different values of the newest start are
    unresolved (same-date) unless all are tagged and the leaders, of one value, outrank the rest; a guess that replaces
    a different stated value is unresolved too (inferred-over-explicit). Undated assertions count as the oldest.
    """
    rows = at_cutoffs(assertions, cutoffs).filter("key is not null and value is not null").withColumn("day", F.coalesce("start", F.to_date(F.lit(OLDEST)))).withColumn("r", rank_of(F.col("authority")))
    item = F.struct("chunk_id", "ord", "value", "raw_value", "authority", "start")
    stated = F.when(F.col("authority") == "explicit", F.col("value"))
    by_rank = rows.groupBy("cutoff", "key", "day", "r").agg(
        F.max(item).alias("last"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("path").alias("p0"), F.max("path").alias("p1"), F.min(stated).alias("e0"), F.max(stated).alias("e1"),
        F.min(F.struct("chunk_id", "ord", "label")).alias("first"),
    )
    wide = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min("first").alias("first")]
    by_day = by_rank.groupBy("cutoff", "key", "day").agg(F.max_by(F.struct("last", "lo", "hi", "r"), "r").alias("top"), F.min("r").alias("least"), *wide)
    by_key = by_day.groupBy("cutoff", "key").agg(F.max_by(F.struct("top", "lo", "hi", "least", "day"), "day").alias("new"), F.min("day").alias("d0"), F.max("day").alias("d1"), *wide)
    win = F.col("new.top.last.value")
    settled = (F.col("new.top.r") > 0) & (F.col("new.top.lo") == F.col("new.top.hi")) & (F.col("new.least") > 0)
    tie = (F.col("new.lo") != F.col("new.hi")) & ~settled
    guess = (F.col("new.top.last.authority") == "inferred") & F.coalesce((F.col("e0") != win) | (F.col("e1") != win), F.lit(False))
    reason = F.when(tie, "same-date").when(guess, "inferred-over-explicit").otherwise("")
    found = by_key.filter("lo != hi").filter(~((F.col("p0") == F.col("p1")) & (F.col("d0") == F.col("d1"))))
    return found.select(
        "cutoff", "key", F.col("first.label").alias("label"), F.col("new.top.last.chunk_id").alias("winner"), win.alias("winner_value"), F.col("new.top.last.raw_value").alias("winner_raw"),
        F.col("new.top.last.start").alias("winner_start"), (reason == "").alias("resolved"), reason.alias("reason"),
    )


def losers(assertions: DataFrame, found: DataFrame, cutoffs: Sequence[date | None] = (None,)) -> DataFrame:
    """(cutoff, key, loser, winner, resolved): chunks whose value of a key in conflict is not the winner's, once each."""
    rows = at_cutoffs(assertions, cutoffs).select("cutoff", "key", "chunk_id", "value").distinct()
    joined = rows.join(found.select(F.col("cutoff").alias("c"), F.col("key").alias("k"), "winner", "winner_value", "resolved"), (F.col("key") == F.col("k")) & F.col("cutoff").eqNullSafe(F.col("c")))
    return joined.filter("value != winner_value and chunk_id != winner").select("cutoff", "key", F.col("chunk_id").alias("loser"), "winner", "resolved").distinct()


def links(assertions: DataFrame, cutoffs: Sequence[date | None] = (None,)) -> DataFrame:
    """(cutoff, key, loser, winner) of resolved conflicts; unresolved ones demote nothing."""
    return losers(assertions, conflicts(assertions, cutoffs), cutoffs).filter("resolved").drop("resolved")


def weak(start: Column, source: Column) -> Column:
    """Entries without a date, or with one that only a saved file gives."""
    return start.isNull() | source.isin(*WEAK_SOURCES)


def exists_at(day: Column, source: Column, starts: Column, when: Column) -> Column:
    """False only where a chunk is known to be written, or its facts all to take effect, after a date."""
    late = (F.size(starts) > 0) & F.forall(starts, lambda s: F.coalesce(s > when, F.lit(False)))
    return source.isin(*WEAK_SOURCES) | ~(F.coalesce(day > when, F.lit(False)) | late)


def expired_at(untils: Column, when: Column) -> Column:
    """True where every fact of a chunk ended before a date."""
    return (F.size(untils) > 0) & F.forall(untils, lambda u: F.coalesce(u < when, F.lit(False)))


def beside(df: DataFrame, key: str, block: Column, order: Sequence[str], take: Sequence[str], *, after: bool = False, prefix: str = "prev_") -> DataFrame:
    """df with the columns ``take`` of the row before (or after) within each key, in the order given.

    Windows run within (key, block); only each block's outermost row crosses to its neighbour, so that a hot key is
    spread over its blocks. Blocks must be ordered like the rows. There is no order among rows equal in ``order``.
    """
    asc = [F.col(c).asc_nulls_first() for c in order]
    rows = df.withColumn("_b", block)
    w = W.partitionBy(key, "_b").orderBy(*asc)
    kept = F.struct(F.lit(True).alias("_is"), *[F.col(c) for c in take])
    step = F.lead if after else F.lag
    inner = rows.withColumn("_n", step(kept).over(w))
    edge = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    ends = rows.groupBy(key, "_b").agg((F.min_by if after else F.max_by)(kept, edge).alias("_e"))
    across = ends.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), step("_e").over(W.partitionBy(key).orderBy(F.col("_b").asc_nulls_first())).alias("_x"))
    joined = inner.join(across, (F.col(key) == F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c")), "left")
    got = F.coalesce("_n", "_x")
    return joined.select(*[F.col(c) for c in df.columns], *[got[c].alias(prefix + c) for c in take])


def _month(day: str = "start") -> Column:
    return F.date_trunc("month", F.col(day))


def timeline(entries: DataFrame) -> DataFrame:
    """(key, value, from_day, to_day, present): each value from where it begins to the next different one.

    An earlier ``until`` of a run's first entry closes it before; the last value without one is present. Undated
    entries come first.
    """
    order = ["start", "chunk_id", "ord"]
    runs = beside(entries.select("key", "value", "raw_value", *order, "valid_until"), "key", _month(), order, ["value"]).filter("prev_value is null or prev_value != value")
    nxt = beside(runs.drop("prev_value"), "key", _month(), order, ["start", "value"], after=True, prefix="next_")
    cut = F.col("valid_until").isNotNull() & (F.col("next_start").isNull() | (F.col("valid_until") < F.col("next_start")))
    return nxt.select(
        "key", F.col("raw_value").alias("value"), F.col("start").alias("from_day"), F.when(cut, F.col("valid_until")).otherwise(F.col("next_start")).alias("to_day"), (~cut & F.col("next_value").isNull()).alias("present")
    )


def value_at(entries: DataFrame, days: Sequence[date]) -> DataFrame:
    """(cutoff, key, chunk_id, value, raw_value, start, status, resolved) for every key and day.

    status: known; uncertain (rests on a file's date, or an undated entry disagrees); expired (its ``until`` passed);
    none (nothing recorded yet) or unknown (only undated or weakly dated entries).
    """
    rows = entries.select("*", F.explode(F.array(*[F.lit(d).cast("date") for d in days])).alias("cutoff"))
    known = F.col("start").isNotNull() & (F.col("start") <= F.col("cutoff"))
    undated = F.when(F.col("start").isNull(), F.col("value"))
    item = F.struct("start", "chunk_id", "ord", "value", "raw_value", "valid_until", "source")
    whole = rows.groupBy("cutoff", "key").agg(
        F.max(F.when(known, item)).alias("last"), F.bool_or(weak(F.col("start"), F.col("source"))).alias("any_weak"), F.min(undated).alias("u0"), F.max(undated).alias("u1")
    )
    found = conflicts(entries, days).select("cutoff", "key", "winner", "resolved")
    won = rows.filter(known).join(found, ["cutoff", "key"]).filter("chunk_id = winner").groupBy("cutoff", "key", "resolved").agg(F.max(item).alias("won"))
    joined = whole.join(won, ["cutoff", "key"], "left").withColumn("cur", F.coalesce("won", "last"))
    disagree = F.coalesce((F.col("u0") != F.col("cur.value")) | (F.col("u1") != F.col("cur.value")), F.lit(False))
    state = (
        F.when(F.col("cur").isNull(), F.when(F.col("any_weak"), "unknown").otherwise("none"))
        .when(F.col("cur.valid_until") < F.col("cutoff"), "expired")
        .when(weak(F.col("cur.start"), F.col("cur.source")) | disagree, "uncertain")
        .otherwise("known")
    )
    return joined.select("cutoff", "key", "cur.chunk_id", "cur.value", "cur.raw_value", "cur.start", state.alias("status"), F.coalesce("resolved", F.lit(True)).alias("resolved"))


def diff_window(entries: DataFrame, since: date, until: date | None = None) -> DataFrame:
    """(key, change, value, previous, label, start, undated): facts added or updated between two days, both included.

    Compares the last value before with the last one inside only; entries without a date are counted, not compared.
    """
    inside = (F.col("start") >= F.lit(since)) & (F.lit(True) if until is None else F.col("start") <= F.lit(until))
    item = F.struct("start", "chunk_id", "ord", "value", "raw_value", "label")
    per = entries.groupBy("key").agg(F.max(F.when(F.col("start") < F.lit(since), item)).alias("old"), F.max(F.when(inside, item)).alias("new"), F.count_if(F.col("start").isNull()).alias("undated"))
    rows = per.filter("new is not null").withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("old.value") != F.col("new.value"), "updated")).filter("change is not null")
    return rows.select("key", "change", F.col("new.raw_value").alias("value"), F.col("old.raw_value").alias("previous"), "new.label", "new.start", "undated")


def undated(entries: DataFrame) -> DataFrame:
    """One row (undated_skipped): the entries that a comparison of days has to leave out."""
    return entries.agg(F.count_if(F.col("start").isNull()).alias("undated_skipped"))


def pick_fact(hits: DataFrame, assertions: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, key, chunk_id, overlap): the fact whose key shares most words with the question among those of its hits.

    Ties go to the better ranked hit, then to the shorter key, then to the first assertion.
    """
    rows = hits.select("qid", "chunk_id", "rank").join(assertions.select("chunk_id", "key", "ord"), "chunk_id").join(queries.select("qid", "terms"), "qid")
    shared = F.size(F.array_intersect(F.split("key", " "), F.col("terms")))
    best = F.min(F.struct((-F.col("overlap")).alias("o"), "rank", F.length("key").alias("n"), "ord", "key", "chunk_id")).alias("b")
    return rows.withColumn("overlap", shared).filter("overlap > 0").groupBy("qid").agg(best).select("qid", "b.key", "b.chunk_id", (-F.col("b.o")).alias("overlap"))
