"""Keeping views up to date while notes and assertions arrive as streams.

Facts may arrive late and be dated back, so no watermark may drop them. The winner of a fact is a maximum over its
assertions, so each micro-batch is reduced to its own winners and written as one more layer; readers take the maximum
over the layers, and every so many batches the layers are folded into one. A stream that has seen all rows gives the
batch result, in whatever order they came; a batch that is run again replaces its own layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import index, search
from factloom.operators.facts import OLDEST, rank_of

STATE = "key string, best struct<day:date,r:int,chunk_id:bigint,ord:bigint,value:string,raw_value:string,valid_until:date>"
#: Layers after which they are folded.
MOST_LAYERS = 20


def log_entries(pages: DataFrame) -> DataFrame:
    """(path, day, entry) of log pages (path, text), in batch or stream: one row for each item below a heading of a day.

    Lines below an item that are indented belong to it; what stands before the first day has none.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r", "\n")
    parts = F.split(text, r"\n(?=## \d{4}-\d{2}-\d{2}\b)|\A(?=## \d{4}-\d{2}-\d{2}\b)", -1)
    sections = pages.select("path", F.explode(parts).alias("section")).withColumn("day", F.try_to_date(F.nullif(F.regexp_extract("section", r"\A## (\d{4}-\d{2}-\d{2})\b", 1), F.lit("")), "yyyy-MM-dd"))
    items = sections.select("path", "day", F.explode(F.regexp_extract_all("section", F.lit(r"(?m)^- (.*(?:\n(?:  .*|[ \t]*(?=\n  )))*)"), F.lit(1))).alias("entry"))
    return items.withColumn("entry", F.trim(F.regexp_replace("entry", r"(?m)^  ", "")))


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the entries of log pages that come into a folder; each page is read once, whole."""
    pages = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    return log_entries(pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def newest(assertions: DataFrame) -> DataFrame:
    """(key, best): the winning assertion of each key, newest start first, then authority, then chunk."""
    until = F.col("valid_until") if "valid_until" in assertions.columns else F.lit(None).cast("date")
    best = F.struct(
        F.coalesce("start", F.to_date(F.lit(OLDEST))).alias("day"), rank_of(F.col("authority")).alias("r"), F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("ord").cast("bigint").alias("ord"), "value", "raw_value",
        until.alias("valid_until"),
    )
    return assertions.filter("key is not null and value is not null").groupBy("key").agg(F.max(best).alias("best"))


def _layers(home: index.Folder) -> list[int]:
    """Numbers of the finished layers."""
    return sorted(int(n[2:]) for n in home.names() if n.startswith("b=") and home.exists(f"{n}/_SUCCESS")) if home.exists() else []


def _folded(layers: DataFrame) -> DataFrame:
    return layers.groupBy("key").agg(F.max("best").alias("best"))


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The view as of the last finished batch."""
    held = _layers(index.Folder(spark, folder))
    return _folded(spark.read.schema(STATE).parquet(*[f"{folder}/b={n}" for n in held])) if held else spark.createDataFrame([], STATE)


def expired_on(current: DataFrame, day) -> DataFrame:
    """The keys whose value ended before a day; an end falls due on the day after it."""
    return current.filter(F.col("best.valid_until") < F.lit(day)).select("key", F.date_add("best.valid_until", 1).alias("due"))


def keep_current(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts the upkeep of a folder of layers."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        home = index.Folder(spark, folder)
        newest(batch).write.mode("overwrite").parquet(f"{folder}/b={number}")
        held = [n for n in _layers(home) if n < number]
        if len(held) >= MOST_LAYERS:
            # The fold replaces the last of its layers, which it contains; the others go once it is there.
            tmp, last = f"fold-{number}", f"b={held[-1]}"
            _folded(spark.read.schema(STATE).parquet(*[f"{folder}/b={n}" for n in held])).write.mode("overwrite").parquet(f"{folder}/{tmp}")
            home.drop(last)
            home.move(tmp, last)
            for n in held[:-1]:
                home.drop(f"b={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_index(stream: DataFrame, folder: str, checkpoint: str, stem: bool = True) -> StreamingQuery:
    """Starts the upkeep of a saved index by a stream of notes (path, text, mtime): each batch parses its own notes only.

    The last row of a path in a batch counts, by mtime; a null text removes the note.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        w = W.partitionBy("path").orderBy(F.col("mtime").desc_nulls_last(), F.xxhash64("text"))
        last = batch.filter("path is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        made = last.filter("text is not null").select("path", "text", "mtime", F.octet_length("text").cast("bigint").alias("size"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
        new = search.index_tables(made, stem)
        files = made.select("path", "mtime", "size", "sha1")
        try:
            old = index.open_index(spark, folder)
        except index.IndexMissing:
            index.save({"files": files} | new, folder)
            return
        same = old["files"].join(last.select("path"), "path", "left_anti")
        index.save({"files": same.unionByName(files)} | search.merged_tables(old, new, same.select("path")), folder)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
