"""Markdown notes into citable chunks, and chunks into assertions, as window and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.freshness import first_date, is_volatile_text, mtime_date, truthy
from factloom.functions.tags import line_tag, strip_tags, without_tag
from factloom.functions.text import content_words, normalized, stem_all_udf, words_of
from factloom.session import stored

# Line patterns of notes.
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
ITEM = r"^\s{0,3}(?:[-*+]|\d+[.)])\s+"
FENCE = r"^\s{0,3}(```|~~~)"
VERIFIED = r"(?i)\[verified:\s*(\d{4}-\d{2}-\d{2})\]"
VOLATILE = r"(?i)\[volatile\]"
KEY_VALUE = r"^\s*(?:[-*+]|\d+[.)])?\s*(?:\*\*)?([^:|`]{2,60}?)(?:\*\*)?\s*:\s+(\S.*)$"
IS_NOW = r"^([A-Za-z](?U:[\w'’ -]){1,60}?)\s+(?:is now|are now|is|are|moved to|changed to|was changed to|switched to)\s+([^.;]{1,80})"
PRONOUNS = [
    "it", "this", "that", "he", "she", "they", "there", "which", "who", "what", "we", "i", "you", "here", "these", "those", "one", "everything", "something", "nothing",
]
SKIP_KEYS = ["http", "https", "note", "notes", "todo", "tip", "tl;dr", "example", "warning", "q", "a"]


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def lines_of(notes: DataFrame) -> DataFrame:
    """(path, n, line): the lines of each text, 1-based, line ends made equal and a byte order mark dropped."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n|\r", "\n"), "^﻿+", "")
    return notes.select("path", F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def front_matter(lines: DataFrame) -> DataFrame:
    """(path, skip, meta): how many lines a closed front matter takes, and its keys (lower case; the last one counts).

    It opens on the first line and must close within 200 lines; else it is ordinary text. Indented lines are ignored.
    """
    head = lines.filter("n <= 200")
    bare = strip(F.col("line"))
    ends = head.groupBy("path").agg(F.max((F.col("n") == 1) & (bare == "---")).alias("opens"), F.min(F.when((F.col("n") > 1) & bare.isin("---", "..."), F.col("n"))).alias("close"))
    ends = ends.filter("opens and close is not null").select("path", F.col("close").alias("skip"))
    pairs = head.join(ends, "path").filter((F.col("n") > 1) & (F.col("n") < F.col("skip")) & F.col("line").contains(":") & ~F.col("line").rlike(r"^[ \t]"))
    keyed = pairs.select("path", "n", F.lower(strip(F.substring_index("line", ":", 1))).alias("k"), F.regexp_replace(strip(F.expr("substr(line, instr(line, ':') + 1)")), "^[\"']+|[\"']+$", "").alias("v"))
    meta = keyed.groupBy("path", "k").agg(F.max_by("v", "n").alias("v")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))
    return ends.join(meta, "path", "left").select("path", "skip", F.coalesce("meta", F.expr("map()").cast("map<string,string>")).alias("meta"))


def is_date_heading(heading: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(heading, r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)", ""), r"(?U)[\W_]", "")
    return first_date(heading).isNotNull() & (F.length(rest) <= 9)


def parse_notes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (path, mtime, meta, title) and chunks of a table (path, text, mtime).

    Chunks: chunk_id, path, start_line, end_line, text, heading_path, kind, verified, date_source, volatile. A chunk is a
    paragraph, a list item, a table row or a fenced block (closed by any fence line, or by the end of the file); headings
    are no chunks. Ids count chunks in order of path and line. A null text is empty; an empty table gives empty tables.
    The windows run within one file, whose size the scan bounds.
    """
    lines = lines_of(notes)
    matter = front_matter(lines)
    w = W.partitionBy("path").orderBy("n")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    live = lines.join(matter.select("path", "skip"), "path", "left").filter("n > coalesce(skip, 0)").drop("skip")
    c = F.col
    live = live.withColumn("fence", c("line").rlike(FENCE)).withColumn("inside", F.coalesce(F.sum(c("fence").cast("int")).over(before) % 2 == 1, F.lit(False)))
    live = live.withColumn("head", ~c("inside") & ~c("fence") & c("line").rlike(HEADING)).withColumn("blank", ~c("inside") & (strip(c("line")) == ""))
    pipe = F.ltrim(c("line")).startswith("|")
    live = live.withColumn("item", ~c("inside") & ~c("fence") & ~c("head") & ~c("blank") & (c("line").rlike(ITEM) | pipe)).withColumn("rule", c("item") & pipe & strip(c("line")).rlike(r"^[|\-: ]+$"))
    live = live.withColumn("body", c("inside") | c("fence") | ~(c("head") | c("blank") | c("rule")))
    closes = c("fence") & c("inside")
    starts = ~c("inside") & (c("fence") | c("item") | ~F.coalesce(F.lag(c("body") & ~closes).over(w), F.lit(False)))
    live = live.withColumn("grp", F.sum(F.when(c("body") & starts, 1).otherwise(0)).over(upto))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    for k in range(1, 7):
        live = live.withColumn(f"h{k}", F.last(F.when(c("head") & (level == k), F.struct("n", strip(F.regexp_extract("line", HEADING, 2)).alias("t"))), True).over(upto))
    kept = []
    for k in range(1, 7):
        above = F.greatest(F.lit(0), *[F.coalesce(c(f"h{j}.n"), F.lit(0)) for j in range(1, k)]) if k > 1 else F.lit(0)
        kept.append(F.when(c(f"h{k}.n") > above, c(f"h{k}.t")))
    path = F.filter(F.array(*kept), lambda h: h.isNotNull())
    kind = F.when(c("fence"), "code").when(c("item") & pipe, "table").when(c("item"), "item").otherwise("paragraph")
    rows = live.filter("body").withColumn("headings", path).withColumn("kind", kind)
    made = rows.groupBy("path", "grp").agg(
        F.min("n").alias("start_line"), F.max("n").alias("end_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("raw"),
        F.min_by("headings", "n").alias("heading_path"), F.min_by("kind", "n").alias("kind"),
    )
    made = made.withColumn("text", strip(c("raw"))).filter("text != ''")
    tagged = F.regexp_extract("text", VERIFIED, 1)
    dated = F.get(F.filter(F.reverse("heading_path"), is_date_heading), F.lit(0))
    chunks = made.select(
        "path", "start_line", "end_line", "text", "heading_path", "kind",
        F.when(tagged != "", first_date(tagged)).otherwise(first_date(dated)).alias("verified"),
        F.when(tagged != "", "inline").when(dated.isNotNull(), "heading").otherwise("").alias("date_source"),
        c("text").rlike(VOLATILE).alias("volatile"),
    )
    chunks = with_ids(chunks)
    first = chunks.filter(F.size("heading_path") > 0).groupBy("path").agg(F.min_by(F.get("heading_path", F.lit(0)), "start_line").alias("h1"))
    docs = notes.select("path", "mtime").join(matter.select("path", "meta"), "path", "left").join(first, "path", "left")
    own = F.try_element_at("meta", F.lit("title"))
    docs = docs.select("path", "mtime", F.coalesce("meta", F.expr("map()").cast("map<string,string>")).alias("meta"), F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.coalesce("h1", F.lit(""))).alias("title"))
    return docs, chunks


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id in order of path and line: ranges of paths are counted, numbering stays within a path.

    What passes through the one ordered window is one row for each range; a range holds its share of the paths.
    """
    part = F.spark_partition_id().alias("_part")
    sizes = stored(chunks.groupBy("path").agg(F.count("*").alias("_n")).repartitionByRange("path").select("path", "_n", part))
    parts = sizes.groupBy("_part").agg(F.sum("_n").alias("_m"))
    base = parts.select("_part", (F.sum("_m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_m")).alias("_base"))
    inner = sizes.withColumn("_off", F.sum("_n").over(W.partitionBy("_part").orderBy("path").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    offsets = inner.join(F.broadcast(base), "_part").select("path", (F.col("_base") + F.col("_off")).alias("_off"))
    rn = F.row_number().over(W.partitionBy("path").orderBy("start_line"))
    return chunks.join(offsets, "path").select((F.col("_off") + rn - 1).alias("chunk_id"), *chunks.columns)


def clean_text(text: Column) -> Column:
    """A chunk without inline tags and closing brace tags, for display."""
    return strip(F.regexp_replace(strip_tags(F.regexp_replace(F.regexp_replace(text, VERIFIED, ""), VOLATILE, "")), r"[ \t]+", " "))


def tagged_text(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, VERIFIED, ""), VOLATILE, ""), r"[ \t]+", " "))


def value_cut(value: Column) -> Column:
    """A value up to its first comma with a blank, semicolon or spaced dash, without inline tags."""
    bare = F.regexp_replace(value, r"(?i)\s*(\[(?:verified:[^\]]*|volatile)\])\s*", " ")
    return F.get(F.split(bare, r",\s|;|\s[-–—]\s", 2), F.lit(0))


def display_value(value: Column) -> Column:
    return strip(F.regexp_replace(strip(value_cut(value)), r"\.+$", ""))


def value_form(norm: Column) -> Column:
    """The normal form of a value for comparison; ``norm`` is the normalized cut value without parentheses."""
    return F.array_join(F.filter(words_of(norm), lambda w: ~w.isin("now", "currently", "still")), " ")


def dated(chunks: DataFrame, docs: DataFrame, by_phrase: bool = True) -> DataFrame:
    """chunks with effective_date, effective_source and is_volatile, from the chunk, the front matter or the file time."""
    c = F.col
    joined = chunks.join(docs.select("path", "mtime", "meta", "title"), "path", "left")
    fm = [(k, first_date(F.try_element_at("meta", F.lit(k)))) for k in ("verified", "updated", "date")]
    day = F.coalesce("verified", *[d for _, d in fm], mtime_date(c("mtime")))
    source = F.when(c("verified").isNotNull(), F.when(c("date_source") == "", "inline").otherwise(c("date_source")))
    for k, d in fm:
        source = source.when(d.isNotNull(), f"front-matter:{k}")
    source = source.when(mtime_date(c("mtime")).isNotNull(), "mtime").otherwise("unknown")
    volatile = c("volatile") | truthy(F.try_element_at("meta", F.lit("volatile"))) | (is_volatile_text(clean_text(c("text"))) if by_phrase else F.lit(False))
    return joined.withColumn("effective_date", day).withColumn("effective_source", source).withColumn("is_volatile", F.coalesce(volatile, F.lit(False)))


def assertions_of(chunks: DataFrame, stem: bool = True) -> DataFrame:
    """The facts in dated chunks: key, chunk_id, ord, path, label, value, raw_value, start, source, authority, origin, valid_from, valid_until.

    Lines ``key: value`` and sentences ``X is now Y`` give one fact each; a tag ``supersedes K`` files its line under K
    instead. Keys are sets of (stemmed) content words, qualified by the note's entity or title outside dated headings.
    Code gives none.
    """
    c = F.col
    lines = chunks.filter("kind != 'code'").select("chunk_id", "path", "start_line", "date_source", "effective_date", "effective_source", "meta", "title", F.posexplode(F.split(tagged_text(c("text")), "\n")).alias("at", "whole"))
    lines = lines.withColumn("tag", line_tag(c("whole"))).withColumn("line", without_tag(c("whole")))
    key, val = F.regexp_extract("line", KEY_VALUE, 1), F.regexp_extract("line", KEY_VALUE, 2)
    lines = lines.withColumn("has_kv", c("line").rlike(KEY_VALUE)).withColumn("k", F.regexp_replace(strip(key), r"^[*_ ]+|[*_ ]+$", "")).withColumn("v", strip(val))
    lines = lines.withColumn("k_norm", normalized(c("k")))
    kv_ok = c("has_kv") & (F.size(F.split(strip(c("k")), r"\s+")) <= 6) & ~F.coalesce(F.get(words_of(c("k_norm")), F.lit(0)).isin(*SKIP_KEYS), F.lit(False)) & ~c("k").rlike(r"\d$")
    lines = lines.withColumn("kv_ok", kv_ok)
    bullet = r"^\s*(?:[-*+]|\d+[.)])\s+"
    files = F.coalesce(F.nullif(c("tag.supersedes"), F.lit("")), F.lit(""))
    filed = F.struct(F.lit(-1).alias("s"), files.alias("label"), F.when(c("has_kv"), c("v")).otherwise(strip(F.regexp_replace("line", bullet, ""))).alias("raw"))
    direct = F.struct(F.lit(-1).alias("s"), c("k").alias("label"), c("v").alias("raw"))
    said = F.transform(F.split(F.regexp_replace("line", bullet, ""), r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.regexp_replace(strip(x), r"(?i)^(?:the|my|our)\s+", ""))
    claims = F.filter(
        F.transform(said, lambda x, i: F.struct(i.alias("s"), F.regexp_extract(x, IS_NOW, 1).alias("label"), strip(F.regexp_extract(x, IS_NOW, 2)).alias("raw"))), lambda x: x["label"] != ""
    )
    # A key: value line that gives no key or value falls through to its sentences, so both are tried, in this order.
    tries = F.when(files != "", F.array(filed)).when(c("kv_ok"), F.concat(F.array(direct), claims)).otherwise(claims)
    rows = lines.withColumn("filed", files != "").withColumn("tries", tries).select("*", F.explode("tries").alias("t")).drop("tries")
    first = F.lower(F.regexp_extract(F.col("t.label"), r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))
    rows = rows.filter((c("t.s") < 0) | ~first.isin(*PRONOUNS))
    entity = F.coalesce(F.try_element_at("meta", F.lit("entity")), F.lit(""))
    name = F.when(entity != "", entity).when(is_date_heading(c("title")), "").otherwise(F.coalesce("title", F.lit("")))
    rows = rows.withColumn("l_norm", normalized(c("t.label"))).withColumn("q_norm", normalized(name)).withColumn("v_norm", normalized(F.regexp_replace(value_cut(c("t.raw")), r"\(.*?\)", " ")))
    rows = rows.withColumn("subject", content_words(words_of(c("l_norm")))).withColumn("qual", content_words(words_of(c("q_norm")))).withColumn("value", value_form(c("v_norm")))
    if stem:
        rows = rows.withColumn("subject", stem_all_udf("subject")).withColumn("qual", stem_all_udf("qual"))
    apart = (c("date_source") != "heading") & (F.size("qual") > 0) & ~F.arrays_overlap("qual", "subject")
    rows = rows.withColumn("toks", F.when(apart, F.concat("qual", "subject")).otherwise(c("subject"))).filter((F.size("subject") > 0) & (F.size("toks") <= 8) & (c("value") != ""))
    w = W.partitionBy("chunk_id", "at")
    rows = rows.withColumn("direct", F.min("t.s").over(w)).filter("t.s = -1 or direct >= 0")
    return rows.select(
        F.array_join(F.array_sort(F.array_distinct("toks")), " ").alias("key"), "chunk_id", (c("at") * 1000 + F.greatest(c("t.s"), F.lit(0))).alias("ord"), "path", strip(c("t.label")).alias("label"), "value", c("t.raw").alias("raw_value"),
        F.coalesce("tag.valid_from", "effective_date").alias("start"), F.when(c("tag.valid_from").isNotNull(), "tag:from").otherwise(c("effective_source")).alias("source"),
        c("tag.authority").alias("authority"), c("tag.source").alias("origin"), c("tag.valid_from").alias("valid_from"), c("tag.valid_until").alias("valid_until"), F.concat_ws(":", "path", "start_line").alias("cite"),
    )
