"""Mixing sources to target shares by entropy balancing.

Every document of a source gets the rate that keeps the mixture closest (in relative entropy) to one copy each while
the source's expected tokens meet its target: exp(lambda * tokens / mean), cut at the source's allowed repeats. The
convex dual has one multiplier a source; safeguarded Newton steps solve it, each step being one distributed sum over
documents combined by size. Rates become whole copies by systematic rounding in order of size within hashed buckets
of a source, so that a bucket is off by less than one document and no task ever holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.tokens import DEFAULT_VOCABULARY, token_counts
from factloom.session import cut

BUCKET_ROWS = 20_000


def source_key(source: Column) -> Column:
    """Spellings of a source without case and separators; null for nothing but those."""
    bare = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", bare)


def filled_targets(sizes: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int) -> dict[str, float]:
    """Target tokens of each source; what sources at their cap cannot give is shared among the others by their shares."""
    caps = {s: float(sizes.get(s, 0) * repeats[s]) for s in shares}
    full: set[str] = set()
    while True:
        rest = total - sum(caps[s] for s in full)
        weight = sum(shares[s] for s in shares if s not in full)
        goal = {s: rest * shares[s] / weight for s in shares if s not in full} if weight else {}
        over = {s for s, g in goal.items() if g >= caps[s]}
        if not over:
            return goal | {s: caps[s] for s in full}
        full |= over


def solve_rates(by_size: DataFrame, goals: dict[str, float], caps: dict[str, float], repeats: dict[str, int], means: dict[str, float], tolerance: float = 1e-6) -> dict[str, float]:
    """The multiplier of each source, infinite where all its documents are taken as often as allowed.

    Newton steps are kept within a bracket, and halve it where they leave it; expected tokens rise steadily with the
    multiplier, so the steps end with every source within ``tolerance`` of its goal, or at the last bit of its multiplier.
    ``by_size``: source, n_tokens, n.
    """
    spark = by_size.sparkSession
    found = {s: math.inf for s in goals if goals[s] >= caps[s] * (1 - 1e-12)}
    now = {s: 0.0 for s in goals if s not in found and caps.get(s)}
    low, high = {s: -math.inf for s in now}, {s: math.inf for s in now}
    while open_ := {s: v for s, v in now.items() if s not in found}:
        tried = spark.createDataFrame([(s, v, float(repeats[s]), means[s]) for s, v in open_.items()], "source string, lam double, cap double, mean double")
        x = F.col("n_tokens") / F.col("mean")
        rate = F.least(F.col("cap"), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
        t = F.col("n_tokens") * F.col("n")
        sums = by_size.join(F.broadcast(tried), "source").groupBy("source").agg(F.sum(t * rate).alias("got"), F.sum(F.when(rate < F.col("cap"), t * rate * x).otherwise(0.0)).alias("slope"))
        for r in sums.collect():
            s, off = r["source"], r["got"] - goals[r["source"]]
            if abs(off) <= tolerance * max(goals[s], 1.0):
                found[s] = now[s]
                continue
            (high if off > 0 else low)[s] = now[s]
            if math.isfinite(low[s]) and math.isfinite(high[s]) and high[s] - low[s] <= 4e-16 * max(abs(low[s]), abs(high[s]), 1e-300):
                found[s] = now[s]
                continue
            step = now[s] - off / r["slope"] if r["slope"] > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else (now[s] + 4 if off < 0 else now[s] - 4)
            now[s] = step
    return now | found


def mix_sources(documents: DataFrame, targets: DataFrame, *, id: str, text: str, source: str, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (<id>, source, n_tokens, rate double, copies int) and its report, one row for each target source.

    ``targets`` has source, target_share and max_repeats, one row a source, of bounded number. The mixture is as large
    in tokens as all documents with a source; the report has target_share, max_repeats, n_documents, source_tokens,
    goal_tokens, mixed_tokens, actual_share and falls_short (the balancing takes all its documents max_repeats times, and
    these stay below the target share). Documents with a null, blank or unnamed source take no part; the size of the mixture counts those
    with an unnamed one. Rows of one id, source and text count once; two texts of one id are two documents.
    A target without documents falls short and gets none. No document is left out of the sums; empty tables give an
    empty mixture and a report of zeros.
    """
    spark = documents.sparkSession
    plan = targets.select(F.col("source").alias("name"), source_key(F.col("source")).alias("source"), "target_share", "max_repeats").collect()
    names = {r["source"]: r["name"] for r in plan}
    shares, repeats = {r["source"]: float(r["target_share"]) for r in plan}, {r["source"]: int(r["max_repeats"]) for r in plan}
    kind = documents.schema[id].dataType.simpleString()
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"), source_key(F.col(source)).alias("source")).filter("id is not null and source is not null")
    rows = rows.withColumn("keep", F.struct("source", F.unhex(F.md5("text")).alias("same"))).drop("source")
    counted = token_counts(rows, "id", "text", vocabulary, keep="keep").filter("n_tokens > 0")
    sized = cut(counted.select("id", "n_tokens", "keep.*").dropDuplicates(["id", "source", "same"]))
    by_size = sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    by_size = cut(by_size)
    totals = {r["source"]: (r["n"], r["t"]) for r in by_size.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).filter(F.col("source").isin(*names)).collect()}
    whole = by_size.agg(F.sum(F.col("n") * F.col("n_tokens"))).first()[0] or 0
    sizes = {s: totals.get(s, (0, 0))[1] for s in names}
    goals = filled_targets(sizes, shares, repeats, whole)
    caps = {s: float(sizes[s] * repeats[s]) for s in names}
    means = {s: totals[s][1] / totals[s][0] for s in totals}
    lam = solve_rates(by_size, goals, caps, repeats, means)
    table = spark.createDataFrame(
        [
            (s, names[s], shares[s], repeats[s], float(totals.get(s, (0, 0))[0]), float(sizes[s]), goals[s], shares[s] * whole, min(lam.get(s, 0.0), 1e6), s in lam and math.isinf(lam[s]), means.get(s, 1.0), -(-totals.get(s, (1, 0))[0] // BUCKET_ROWS))
            for s in names
        ],
        "source string, name string, target_share double, max_repeats int, n_documents double, source_tokens double, goal_tokens double, wanted double, lam double, at_cap boolean, mean double, buckets int",
    )
    rates = table.select("source", "name", "max_repeats", "lam", "mean", "buckets")
    rate = F.least(F.col("max_repeats").cast("double"), F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.lit(50.0))))
    reached = by_size.join(F.broadcast(rates), "source").groupBy(F.col("name").alias("source")).agg(F.sum(F.col("n") * F.col("n_tokens") * rate).alias("reached"))
    rated = sized.join(F.broadcast(rates), "source").withColumn("rate", rate)
    rated = rated.withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))
    w = W.partitionBy("source", "bucket").orderBy("n_tokens", "id", "same").rowsBetween(W.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source", "bucket"), F.lit(1000)) / 1000.0
    upto = F.sum("rate").over(w) + start
    copies = F.floor(upto + 1e-9) - F.floor(upto - F.col("rate") + 1e-9)
    mixture = rated.withColumn("copies", F.least(copies.cast("int"), F.col("max_repeats"))).filter("copies > 0")
    mixture = mixture.select(F.col("id").alias(id), F.col("name").alias("source"), "n_tokens", "rate", "copies")
    mixed = mixture.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    all_mixed = mixed.agg(F.sum("mixed_tokens").alias("all_mixed"))
    made = reached.join(mixed, "source", "left").withColumnRenamed("source", "name")
    report = table.join(F.broadcast(made), "name", "left").crossJoin(F.broadcast(all_mixed))
    falls_short = (F.col("at_cap") | F.col("reached").isNull()) & (F.coalesce("reached", F.lit(0.0)) < F.col("wanted"))
    report = report.select(
        F.col("name").alias("source"), "target_share", "max_repeats", F.col("n_documents").cast("long").alias("n_documents"), F.col("source_tokens").cast("long").alias("source_tokens"), "goal_tokens",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.col("mixed_tokens") / F.col("all_mixed"), F.lit(0.0)).alias("actual_share"), falls_short.alias("falls_short"),
    )
    return mixture, report
