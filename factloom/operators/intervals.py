"""Continuous periods and gaps from overlapping day intervals, by dyadic decomposition.

Each closed interval of days is cut into its canonical dyadic blocks, the nodes of a binary tree over all
days (heap order: root 1, parent id >> 1, sibling id ^ 1). Repeated and overlapping intervals share nodes,
so that batches and then a distinct with map-side combining shrink hot keys before anything is shuffled. What is left of one key
is bounded by the calendar, whatever the number of rows. Per key, nodes below a present ancestor are
removed, full sibling pairs are replaced by their parent, and adjacent nodes are joined to periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days are counted from 0001-01-01; 2^22 days reach beyond 9999-12-31, so the last one stands for "no end".
LEVELS = 22
LAST = (1 << LEVELS) - 1
ORIGIN = "0001-01-01"


def dyadic_nodes(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, heap id) of the canonical blocks that tile the days first..last (both included) of each interval.

    Going up from single days, a block that starts at an odd place, or ends at an even one, has its sibling outside.
    """
    lo, hi = first + (1 << LEVELS), last + (1 << LEVELS) + 1
    who = np.arange(len(lo), dtype=np.int64)
    owners, nodes = [], []
    while len(who):
        for odd, node in ((lo & 1 == 1, lo), (hi & 1 == 1, hi - 1)):
            owners.append(who[odd])
            nodes.append(node[odd])
        lo, hi = (lo + 1) >> 1, hi >> 1
        open_ = lo < hi
        lo, hi, who = lo[open_], hi[open_], who[open_]
    return np.concatenate([*owners, who]), np.concatenate([*nodes, who])


def _decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each key in a batch, without repetitions and without those below another one."""
    for batch in batches:
        keys = batch.column(0).dictionary_encode()
        who = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first, last = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        spans = np.unique(np.stack([who, first, last]), axis=1)
        at, node = dyadic_nodes(spans[1], spans[2])
        owner, node, _ = _uncovered(*np.unique(np.stack([spans[0][at], node]), axis=1))
        offsets = np.searchsorted(owner, np.arange(len(keys.dictionary) + 1))
        yield pa.RecordBatch.from_arrays([keys.dictionary, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(node.astype(np.int32)))], ["key", "nodes"])


def _extent(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, first day, last day) of blocks."""
    depth = np.frexp(node.astype(np.float64))[1] - 1
    level = LEVELS - depth
    start = (node - (np.int64(1) << depth)) << level
    return level, start, start + (np.int64(1) << level) - 1


def _uncovered(owner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, node, level) of the blocks that no ancestor of the same owner covers, once each."""
    level, start, end = _extent(node)
    order = np.lexsort((-level, start, owner))
    owner, node, level, end = (x[order] for x in (owner, node, level, end))
    # Blocks nest or are disjoint: a covering ancestor starts no later and comes first.
    reach = np.maximum.accumulate(owner * (LAST + 2) + end)
    covered = np.zeros(len(node), bool)
    covered[1:] = (owner[1:] == owner[:-1]) & (owner[1:] * (LAST + 2) + end[1:] <= reach[:-1])
    return owner[~covered], node[~covered], level[~covered]


def _reduced(owner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first day, last day) of the continuous periods that the nodes of each owner cover."""
    owner, node, level = _uncovered(owner, node)
    kept_owner, kept_node, kept_level = [], [], []
    up_owner, up_node = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(LEVELS + 1):
        here = level == k
        o, n = np.concatenate([owner[here], up_owner]), np.concatenate([node[here], up_node])
        order = np.lexsort((n, o))
        o, n = o[order], n[order]
        pair = np.zeros(len(n), bool)
        if len(n) > 1:
            pair[:-1] = (o[:-1] == o[1:]) & (n[:-1] % 2 == 0) & (n[:-1] + 1 == n[1:])
        both = pair.copy()
        both[1:] |= pair[:-1]
        kept_owner.append(o[~both])
        kept_node.append(n[~both])
        kept_level.append(np.full((~both).sum(), k))
        up_owner, up_node = o[pair], n[pair] >> 1
    owner, node, level = np.concatenate(kept_owner), np.concatenate(kept_node), np.concatenate(kept_level)
    start = (node - (np.int64(1) << (LEVELS - level))) << level
    end = start + (np.int64(1) << level) - 1
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (start[1:] > end[:-1] + 1)
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(owner)) - 1
    return (owner[begins], start[begins], end[ends]) if len(owner) else (owner, start, end)


def _periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        who, first, last = _reduced(owner, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        counts = np.bincount(who, minlength=len(sizes))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, spans)], ["key", "spans"])


def merge_periods(df: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """Periods and gaps of each key: (<key>, span_kind, first_day, last_day date, is_open boolean).

    ``first`` and ``last`` are date columns, both days included; a null ``last`` means without end. Rows with a
    null key or first day, or with the last day before the first, are ignored. Intervals that overlap or follow
    on the next day form one ``period``; a ``gap`` is the days between two periods. ``last_day`` is null and
    ``is_open`` true where a period has no end. Repeated rows and nested intervals change nothing; an empty
    table gives an empty result. Only the named columns are read, so others may have any names.
    """
    origin = F.to_date(F.lit(ORIGIN))
    days = df.select(
        F.col(key).alias("key"), F.datediff(first, origin).cast("long").alias("a"), F.coalesce(F.datediff(last, origin).cast("long"), F.lit(LAST)).alias("b")
    ).filter("key is not null and a is not null and a >= 0 and a <= b")
    kind = df.schema[key].dataType.simpleString()
    blocks = days.mapInArrow(_decompose, f"key {kind}, nodes array<int>")
    nodes = blocks.select("key", F.explode("nodes").alias("node")).distinct()
    lists = nodes.groupBy("key").agg(F.collect_list("node").alias("nodes"))
    spans = lists.mapInArrow(_periods, f"key {kind}, spans array<struct<first:bigint,last:bigint>>")
    gaps = F.when(
        F.size("spans") > 1,
        F.transform(
            F.sequence(F.lit(1), F.size("spans") - 1),
            lambda i: F.struct(F.lit("gap").alias("kind"), (F.element_at("spans", i)["last"] + 1).alias("first"), (F.element_at("spans", i + 1)["first"] - 1).alias("last")),
        ),
    )
    periods = F.transform("spans", lambda s: F.struct(F.lit("period").alias("kind"), s["first"].alias("first"), s["last"].alias("last")))
    rows = spans.select("key", F.explode(F.concat(periods, F.coalesce(gaps, F.expr("array()").cast("array<struct<kind:string,first:bigint,last:bigint>>")))).alias("s"))
    day = lambda c: F.date_add(origin, F.when(F.col(c) < LAST, F.col(c)).cast("int"))
    return rows.select(
        F.col("key").alias(key), F.col("s.kind").alias("span_kind"), day("s.first").alias("first_day"), day("s.last").alias("last_day"), (F.col("s.last") >= LAST).alias("is_open")
    )
