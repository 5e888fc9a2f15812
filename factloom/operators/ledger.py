"""History of changing attributes: a bitemporal ledger with valid and recorded times.

An update with effective day E, recorded at R, is believed from R on for the days from E to the next known
effective day. Seen in recorded order, every update does one of two things: it replaces the value of a day
already known, or it splits the one interval that covered its day, whose row is closed at R and written again
with the shorter end. No row is overwritten; the row of the present belief has no recorded end.

Which interval an update splits follows from a sweep over the effective days of a fact: its left neighbour
among days seen earlier, and the end it starts with is its right neighbour among them. The sweep runs on one
element for each different effective day of a fact, so its size is bounded by the calendar and not by the
number of rows; all work on single rows is keyed by (fact, day).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.values import nfc, value_key

#: Stands for "no end" among the ends of valid time while events are ordered.
OPEN = "9999-12-31"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each day of each fact, the nearest days before and after it that were seen earlier."""
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        day, seen, seq = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        order = np.lexsort((day, owner))
        day, seen, seq = day[order], seen[order], seq[order]
        rank = np.empty(len(day), np.int64)
        rank[np.lexsort((seq, seen))] = np.arange(len(day))
        before, after = [-1] * len(day), [-1] * len(day)
        at = 0
        ranks = rank.tolist()
        for n in sizes.tolist():
            stack: list[int] = []
            for i in range(at, at + n):
                r = ranks[i]
                while stack and ranks[stack[-1]] > r:
                    after[stack.pop()] = i
                if stack:
                    before[i] = stack[-1]
                stack.append(i)
            at += n
        before_at, after_at = np.array(before, np.int64), np.array(after, np.int64)
        facts = batch.column(0).take(pa.array(owner))
        when = lambda at: pa.array(np.where(at >= 0, day[at], 0).astype(np.int32), mask=at < 0).cast(pa.date32()) if len(day) else pa.array([], pa.date32())
        yield pa.RecordBatch.from_arrays(
            [facts, pa.array(day.astype(np.int32)).cast(pa.date32()), pa.array(seen), pa.array(seq), when(before_at), when(after_at)],
            ["fact", "day", "seen", "seq", "before", "after"],
        )


def bitemporal_ledger(df: DataFrame, fact: str, value: str, effective: Column, recorded: str, sequence: str) -> DataFrame:
    """One row for each belief ever held: (<fact>, value, valid_from, valid_to, recorded_from, recorded_to, sequence).

    ``effective`` is a date column, ``recorded`` a timestamp, ``sequence`` a number that orders rows recorded at one
    instant. ``valid_to`` is exclusive and null for an interval without end; ``recorded_to`` is null for what is
    believed now. Rows without a fact, day or value (null or blank) are ignored; a missing recorded time counts as
    the earliest, a missing sequence as the smallest. Repeated rows count once; beliefs that were replaced at the
    very instant they were recorded are left out. An empty table gives an empty ledger. Other columns are not read.
    """
    rows = df.select(
        F.col(fact).alias("fact"),
        effective.alias("day"),
        F.coalesce(F.unix_micros(F.col(recorded).cast("timestamp")), F.lit(-(1 << 62))).alias("seen"),
        F.coalesce(F.col(sequence).cast("long"), F.lit(-(1 << 62))).alias("seq"),
        F.col(value).alias("value"),
    ).filter("fact is not null and day is not null and value is not null and trim(value) != ''")
    first_seen = rows.groupBy("fact", "day").agg(F.min(F.struct("seen", "seq")).alias("s"))
    days = first_seen.groupBy("fact").agg(F.collect_list(F.struct(F.col("day"), F.col("s.seen"), F.col("s.seq"))).alias("days"))
    kind = df.schema[fact].dataType.simpleString()
    swept = days.mapInArrow(_neighbours, f"fact {kind}, day date, seen bigint, seq bigint, before date, after date")
    ends = swept.select(
        "fact", "seen", "seq", F.explode(F.array(F.struct("day", F.coalesce("after", F.to_date(F.lit(OPEN))).alias("until")), F.struct(F.col("before").alias("day"), F.col("day").alias("until")))).alias("e")
    ).filter("e.day is not null")
    events = rows.select("fact", "day", "seen", "seq", "value", F.lit(None).cast("date").alias("until")).unionByName(
        ends.select("fact", F.col("e.day").alias("day"), "seen", "seq", F.lit(None).cast("string").alias("value"), F.col("e.until").alias("until"))
    )
    w = W.partitionBy("fact", "day").orderBy("seen", "seq", F.col("value").asc_nulls_first())
    told = events.select(
        "fact",
        "day",
        "seen",
        "seq",
        F.last("value", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("value"),
        F.last("until", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("until"),
        F.lead("seen").over(w).alias("replaced"),
    )
    held = told.filter("replaced is null or replaced > seen")
    instant = lambda c: F.when(F.col(c) > -(1 << 62), F.timestamp_micros(c))
    return held.select(
        F.col("fact").alias(fact),
        "value",
        F.col("day").alias("valid_from"),
        F.when(F.col("until") != F.to_date(F.lit(OPEN)), F.col("until")).alias("valid_to"),
        instant("seen").alias("recorded_from"),
        instant("replaced").alias("recorded_to"),
        F.when(F.col("seq") > -(1 << 62), F.col("seq")).alias("sequence"),
    )


def versions(ledger: DataFrame, fact: str) -> DataFrame:
    """What is believed now, with consecutive equal values joined: (<fact>, value, version_start, version_end).

    Values are equal when they differ only in case, white space, a closing period, remarks in parentheses or
    Unicode composition. ``value`` is the spelling of the version's first day; ``version_end`` is the start of the
    next version or null.
    """
    now = ledger.filter("recorded_to is null").select(F.col(fact).alias("fact"), "value", F.col("valid_from").alias("day"))
    keyed = now.withColumn("composed", nfc(F.col("value"))).select("fact", "day", "value", value_key(F.col("composed")).alias("same"))
    w = W.partitionBy("fact").orderBy("day")
    changed = keyed.withColumn("last", F.lag("same").over(w)).filter(~F.col("same").eqNullSafe(F.col("last")))
    return changed.select(F.col("fact").alias(fact), "value", F.col("day").alias("version_start"), F.lead("day").over(w).alias("version_end"))
