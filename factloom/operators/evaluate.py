"""Quality figures of retrieval and of answers, over tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _rate(hit: Column) -> Column:
    """The mean of a condition to three places; null where there is nothing to average."""
    return F.round(F.avg(F.when(hit.isNotNull(), hit.cast("int"))), 3)


def retrieval_metrics(ranked: DataFrame, by: str) -> DataFrame:
    """(<by>, n, r1, r5, mrr, stale_rate) for each group and for all. ``ranked``: rank of the right hit or null, stale."""
    rank = F.col("rank")
    rows = ranked.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.count("*").alias("n"), _rate(F.coalesce(rank == 1, F.lit(False))).alias("r1"), _rate(F.coalesce(rank <= 5, F.lit(False))).alias("r5"), F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 3).alias("mrr"),
        _rate(F.when(F.col("stale"), F.coalesce(rank, F.lit(99)) > 1)).alias("stale_rate"),
    )
    return rows.withColumn(by, F.coalesce(by, F.lit("all")))


def flag_metrics(shown: DataFrame, by: str) -> DataFrame:
    """(<by>, n, false_fresh, over_flag): how often the first hit should carry a warning and has none, and the other way round.

    ``shown``: due (whether what is asked for must be checked again), flagged (whether the first hit says so; null: no hit).
    """
    flagged = F.coalesce("flagged", F.lit(False))
    rows = shown.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.count("*").alias("n"), _rate(F.when(F.col("due"), ~flagged)).alias("false_fresh"), _rate(F.when(~F.col("due"), flagged)).alias("over_flag")
    )
    return rows.withColumn(by, F.coalesce(by, F.lit("all")))


def latency(runs: DataFrame, by: str) -> DataFrame:
    """(<by>, p50, p95, p99) of a column ms: the median, and the elements at 95 and 99 percent of the sorted list.

    Latencies are counted by value first, so what is sorted is one element for each different value.
    """
    counts = runs.groupBy(by, "ms").agg(F.count("*").alias("n"))
    total = counts.groupBy(by).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("ms", "n"))).alias("v"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("got"))

    def at(place: Column) -> Column:
        return F.aggregate("v", start, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["got"].isNull() & (a["seen"] + x["n"] > place), x["ms"].cast("double")).otherwise(a["got"]).alias("got")))["got"]

    n = F.col("n")
    half = F.floor(n / 2)
    place = lambda q: F.least(n - 1, F.floor(F.lit(q) * n))
    return total.select(by, F.round(F.when(n % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2), 6).alias("p50"), at(place(0.95)).alias("p95"), at(place(0.99)).alias("p99"))


def graded(ranked: DataFrame) -> DataFrame:
    """ranked with the outcome of each case: correct, stale, wrong or no_answer."""
    rank, stale, said = F.col("rank"), F.col("stale"), F.col("answered")
    out = (
        F.when(rank.isNull() & ~said, "no_answer").when(stale & (F.coalesce(rank, F.lit(99)) > 1), "stale")
        .when(F.coalesce(rank == 1, F.lit(False)) | (said & ~stale), "correct").otherwise("wrong")
    )
    return ranked.withColumn("outcome", out)


def answered(answers: DataFrame) -> DataFrame:
    """answers (said, want, old array of texts) with the outcome of each, judged by the words of what was said.

    no_answer: nothing was said; correct: the wanted value is in it; stale: a former value is, and not the wanted one;
    wrong: neither. A value is in a text when its words follow each other there.
    """
    rows = answers.withColumn("_said", spoken(F.col("said"))).withColumn("_want", spoken(F.col("want"))).withColumn("_old", F.transform(F.coalesce("old", F.array().cast("array<string>")), spoken))
    there = lambda value: (F.trim(value) != "") & F.col("_said").contains(value)
    out = F.when(F.trim("_said") == "", "no_answer").when(there(F.col("_want")), "correct").when(F.exists("_old", there), "stale").otherwise("wrong")
    return rows.withColumn("outcome", out).drop("_said", "_want", "_old")


def spoken(text: Column) -> Column:
    """The words of a text between single blanks, so that containment goes by whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


SALTS = 64


def heldout(cases: DataFrame, id: str, category: str, share: float = 0.3) -> DataFrame:
    """cases with split: a rounded ``share`` of each category, by hash, is heldout, the others are dev.

    Places within a category follow from counts of salted parts, so that no task holds a whole category.
    """
    salted = cases.withColumn("_hash", F.xxhash64(id)).withColumn("_salt", F.shiftrightunsigned(F.col("_hash"), 58).cast("int"))
    parts = salted.groupBy(category, "_salt").agg(F.count("*").alias("_n"))
    w = W.partitionBy(category)
    parts = parts.select(F.col(category).alias("_c"), F.col("_salt").alias("_s"), (F.sum("_n").over(w.orderBy("_salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_off"), F.sum("_n").over(w).alias("_all"))
    joined = salted.join(parts, F.col(category).eqNullSafe(F.col("_c")) & (F.col("_salt") == F.col("_s")))
    place = F.col("_off") + F.row_number().over(W.partitionBy(category, "_salt").orderBy("_hash", id))
    return joined.withColumn("split", F.when(place <= F.round(F.col("_all") * share), "heldout").otherwise("dev")).select(*cases.columns, "split")


def summary(cases: DataFrame) -> DataFrame:
    """(split, category, n, accuracy, stale_rate) by split and by category within it.

    With columns as_of (the day asked for, null: now) and cited (whether the answer says where it is from), also
    current_accuracy, as_of_accuracy and provenance.
    """
    split, category, right = F.col("split"), F.col("category"), F.col("outcome") == "correct"
    more = [_rate(F.when(F.col("as_of").isNull(), right)).alias("current_accuracy"), _rate(F.when(F.col("as_of").isNotNull(), right)).alias("as_of_accuracy")] if "as_of" in cases.columns else []
    more += [_rate(F.coalesce("cited", F.lit(False))).alias("provenance")] if "cited" in cases.columns else []
    rows = cases.groupingSets([[split, category], [split]], split, category).agg(F.count("*").alias("n"), _rate(right).alias("accuracy"), _rate(F.col("outcome") == "stale").alias("stale_rate"), *more)
    return rows.withColumn("category", F.coalesce("category", F.lit("all")))
