"""Filling containers of fixed capacity with whole documents: bulk-synchronous best fit, largest first.

Full containers cut from documents beyond the capacity need no packing. All other items meet as many containers as
their total size needs at least. Each round range-sorts the items left and the gaps by falling size, and every range is
swept from large to small: an item takes its successor, the smallest gap that holds it, and what remains of the gap
takes its new place among the gaps of the range. What a range cannot settle (items without a gap, then gaps that could
hold more than the range has) is carried on by counts and bounds alone: the driver, with a few numbers from each range,
finds which ranks of one range's items meet which ranks of an earlier range's gaps, so many to a gap as surely fit, and
a join by rank settles them. Then the gaps are updated, and the next round begins. A round that places nothing opens the
containers that the rest needs at least. Where one range holds everything, the result is that of best fit, one document
after another in order of falling size.

No task sees more than one range of sizes, and equal sizes are spread over ranges by hash, so that a size or length that
a third of all documents share is no hot spot.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import DEFAULT_VOCABULARY, token_counts
from factloom.session import forget, stored

GAP, ITEM, PAIR = 0, 1, 2
SWEPT = ["what", "size", "id", "piece", "box", "part", "rank"]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, sorted by falling size with gaps before items: what is placed, and what is left.

    Items left are ranked by falling size. Gaps left are ranked in this way too, but only those that hold any item of
    smaller ranges; the others have no rank.
    """
    held = list(batches)
    if not held:
        return
    rows, part = pa.Table.from_batches(held).combine_chunks(), TaskContext.get().partitionId()
    size, box, key, piece = (rows[c].combine_chunks() for c in ("size", "box", "id", "piece"))
    sizes, gaps, steps = size.to_pylist(), {}, []  # gaps: rows by present size; steps: these sizes in rising order
    items, taken, left = [], [], []

    def put(gap: int, k: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(steps, gap)
        gaps[gap].append(k)

    for k, what in enumerate(rows["what"].to_pylist()):
        need = sizes[k]
        if what == GAP:
            put(need, k)
            continue
        at = bisect.bisect_left(steps, need)
        if at == len(steps):
            left.append(k)
            continue
        gap = steps[at]
        of = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap], steps[at]
        items.append(k)
        taken.append(of)
        if gap > need:
            put(gap - need, of)
    least = sizes[-1]
    open_ = [(gap, k) for gap in reversed(steps) for k in gaps[gap]]
    ranked = sum(gap >= least for gap, _ in open_)

    def told(what: int, of: list[int], boxes: list[int], size: pa.Array, rank: list[int | None]) -> pa.RecordBatch:
        at, n = pa.array(of, pa.int64()), len(of)
        return pa.RecordBatch.from_arrays([pa.array([what] * n, pa.int32()), size, key.take(at), piece.take(at), box.take(pa.array(boxes, pa.int64())), pa.array([part] * n, pa.int32()), pa.array(rank, pa.int32())], SWEPT)

    yield told(PAIR, items, taken, size.take(pa.array(items, pa.int64())), [None] * len(items))
    yield told(ITEM, left, left, size.take(pa.array(left, pa.int64())), list(range(len(left))))
    yield told(GAP, [k for _, k in open_], [k for _, k in open_], pa.array([gap for gap, _ in open_], pa.int32()), [*range(ranked), *[None] * (len(open_) - ranked)])


def carried(items: dict[int, tuple[int, int]], gaps: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(items' range, first rank, how many, gaps' range, rank after the first one's gap, items a gap): matches between ranges.

    ``items`` has the number and the largest size of what a range left, ``gaps`` the number and the smallest size of its
    ranked gaps. Ranges are numbered by falling size. Items take the smallest of the gaps left by the ranges before
    theirs, the last of the last one first, and as many to a gap as any of these holds.
    """
    runs, stack = [], []
    for part in sorted({*items, *gaps}):
        (left, most), rank = items.get(part, (0, 1)), 0
        while left and stack:
            of, n, least = stack.pop()
            each = least // most
            used = min(n, -(-left // each))
            m = min(left, used * each)
            runs.append((part, rank, m, of, n, each))
            if n > used:
                stack.append((of, n - used, least))
            left, rank = left - m, rank + m
        if gaps.get(part):
            stack.append((part, *gaps[part]))
    return runs


def _settled(swept: DataFrame, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """What a round leaves: what is placed, matches between ranges included, and the items and gaps that remain."""
    table = F.broadcast(swept.sparkSession.createDataFrame(runs, "of int, first int, n int, gap_part int, gap_end int, each int"))
    items, gaps = swept.filter(F.col("what") == ITEM), swept.filter(F.col("what") == GAP)
    aimed = items.drop("box").join(table, (F.col("part") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")), "left")
    aimed = aimed.withColumn("gap_rank", F.col("gap_end") - 1 - F.floor((F.col("rank") - F.col("first")) / F.col("each")).cast("int"))
    boxes = gaps.filter("rank is not null").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "box")
    met = aimed.join(boxes, ["gap_part", "gap_rank"], "left").select(F.when(F.col("box").isNull(), ITEM).otherwise(PAIR).alias("what"), *SWEPT[1:5])
    used = aimed.filter("gap_part is not null").groupBy("gap_part", "gap_rank").agg(F.sum("size").cast("int").alias("used"))
    shrunk = gaps.join(used, (F.col("part") == F.col("gap_part")) & (F.col("rank") == F.col("gap_rank")), "left").withColumn("size", F.col("size") - F.coalesce("used", F.lit(0)))
    return swept.filter(F.col("what") == PAIR).select(SWEPT[:5]).unionByName(met).unionByName(shrunk.filter("size > 0").select(SWEPT[:5]))


def best_fit(items: DataFrame, capacity: int, ranges: int | None = None) -> tuple[DataFrame, int]:
    """(id, piece, size, box) of every item, and how many boxes there are. ``items``: id, piece, size up to the capacity."""
    spark = items.sparkSession
    kind = items.schema["id"].dataType.simpleString()
    schema = f"what int, size int, id {kind}, piece int, box bigint, part int, rank int"
    total = items.agg(F.sum("size")).first()[0] or 0
    opened, rounds = -(-total // capacity), []

    def boxes(first: int, n: int) -> DataFrame:
        return spark.range(first, first + n).select(F.lit(GAP).alias("what"), F.lit(capacity).alias("size"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("int").alias("piece"), F.col("id").alias("box"))

    now = items.select(F.lit(ITEM).alias("what"), "size", "id", "piece", F.lit(None).cast("bigint").alias("box")).unionByName(boxes(0, opened))
    order = [F.col("size").desc(), F.col("what"), F.xxhash64("id", "piece", "box")]
    while total:
        ranged = now.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
        done = stored(ranged.mapInArrow(_sweep, schema))
        counts = done.filter(f"what = {PAIR} or rank is not null").groupBy("what", "part").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("size").alias("least"), F.max("size").alias("most")).collect()
        left = {r["part"]: (r["n"], r["most"]) for r in counts if r["what"] == ITEM}
        runs = carried(left, {r["part"]: (r["n"], r["least"]) for r in counts if r["what"] == GAP})
        if runs:
            swept, done = done, stored(_settled(done, runs))
            forget(swept)
        rounds.append(done)
        if sum(n for n, _ in left.values()) == sum(r[2] for r in runs):
            break
        now = done.filter(F.col("what") != PAIR).select(SWEPT[:5])
        if not runs and not any(r["what"] == PAIR for r in counts):
            need = -(-sum(r["all"] for r in counts if r["what"] == ITEM) // capacity)
            now, opened = now.unionByName(boxes(opened, need)), opened + need
    placed = spark.createDataFrame([], f"id {kind}, piece int, size int, box bigint")
    for done in rounds:
        placed = placed.unionByName(done.filter(F.col("what") == PAIR).select("id", "piece", "size", "box"))
    out = stored(placed)
    for done in rounds:
        forget(done)
    return out, opened


def pack_documents(df: DataFrame, *, id: str, text: str, capacity: int = 2048, vocabulary: str = DEFAULT_VOCABULARY, ranges: int | None = None) -> DataFrame:
    """(<id>, piece int, token_from, token_to, n_tokens, container long, is_split boolean), one row for each placed item.

    A document larger than a container is cut into full containers and one rest, which is placed like a document;
    ``token_from`` (inclusive) and ``token_to`` (exclusive) tell the part. All others are whole. Containers have numbers
    of their own, not all of them in use. Rows with a null id are ignored; repeated rows are placed once each. A null or
    empty text has no tokens and is placed nowhere (no row). An empty table gives an empty result. ``ranges`` sets the
    number of ranges of a sweep, which Spark chooses otherwise.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null and text != ''")
    sizes = stored(token_counts(rows, "id", "text", vocabulary).withColumn("copy", F.monotonically_increasing_id()))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")),
        lambda k: F.struct((k + 1).alias("piece"), (k * capacity).alias("from"), F.least(F.col("n_tokens"), (k + 1) * capacity).alias("to"), (F.col("n_tokens") > capacity).alias("split")),
    )
    items = sizes.select(F.struct("id", "copy").alias("id"), F.explode(pieces).alias("p")).select("id", "p.*", (F.col("p.to") - F.col("p.from")).alias("size"))
    whole = items.filter(F.col("size") == capacity)
    placed, opened = best_fit(items.filter(F.col("size") < capacity).select("id", "piece", "size"), capacity, ranges)
    start = (F.col("piece") - 1) * capacity
    # What is smaller than a container is the rest of a larger document, unless it is its first piece.
    told = placed.select("id", "piece", start.alias("from"), (start + F.col("size")).alias("to"), "size", "box", (F.col("piece") > 1).alias("split"))
    full = whole.select("id", "piece", "from", "to", "size", (F.monotonically_increasing_id() + opened).alias("box"), "split")
    return told.unionByName(full).select(
        F.col("id.id").alias(id), "piece", F.col("from").alias("token_from"), F.col("to").alias("token_to"), F.col("size").alias("n_tokens"), F.col("box").alias("container"), F.col("split").alias("is_split")
    )
