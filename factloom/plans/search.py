"""Queries over the whole search: chunks with their parsed dates, the recorded values as facts, supersession by conflicts.

Those over chunks have no SQL; tests compare them with a plain search in Python. Those over documents have.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.freshness import is_volatile_text
from factloom.functions.text import normalized, stem_all_udf, with_tokens
from factloom.operators import notes, retrieval, search
from factloom.plans import facts, texts
from factloom.session import cut, load, spread

DAY = lambda c: F.date_format(c, "yyyy-MM-dd")


#: Questions for chunks like a given one, by its number; those without a vector are not asked.
LIKE = tuple(range(0, 2000, 100))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as search takes them, with index tokens and without their text."""
    rows = texts.dated_chunks(spark, sf_dir, "start_line", "end_line", "text", "heading_path").withColumn("heading_path", F.coalesce("heading_path", F.expr("array()").cast("array<string>")))
    rows = rows.select("chunk_id", "path", "start_line", "end_line", "text", "heading_path", F.col("day").alias("effective_date"), F.col("source").alias("effective_source"), F.col("volatile").alias("is_volatile"))
    return cut(search.with_index_tokens(rows).drop("text", "heading_path"))


def assertion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded values with stemmed keys, and values in the form that notes' facts have."""
    rows = facts.assertions(spark, sf_dir)
    stems = rows.select("key").distinct().withColumn("stemmed", F.array_join(F.array_sort(F.array_distinct(stem_all_udf(F.split("key", " ")))), " "))
    norm = rows.withColumn("n", normalized(F.regexp_replace(notes.value_cut(F.col("raw_value")), r"\(.*?\)", " ")))
    formed = norm.withColumn("value", F.coalesce(F.nullif(notes.value_form(F.col("n")), F.lit("")), "value")).drop("n")
    return cut(formed.join(stems, "key").drop("key").withColumnRenamed("stemmed", "key"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"chunks": chunk_table(spark, sf_dir), "assertions": assertion_table(spark, sf_dir)}


def _like(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The questions with the words and the vector of a stated chunk each: questions, vectors of chunks, vectors of questions."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    asked = vectors.filter(F.col("chunk_id").isin(*LIKE)).select(F.col("chunk_id").cast("string").alias("qid"), "chunk_id", "vec")
    words = chunks.filter(F.col("chunk_id").isin(*LIKE)).join(asked, "chunk_id").select("qid", F.array_distinct("tokens").alias("terms"))
    return spark.createDataFrame(words.collect(), words.schema), vectors, asked.select("qid", "vec")


def search_fused(spark, sf_dir):
    """Fused scores of the best 50 chunks by BM25 and the best 50 by vectors."""
    chunks = chunk_table(spark, sf_dir)
    return search.hybrid_scores({"chunks": chunks}, *_like(spark, sf_dir, chunks)).select("qid", "chunk_id", F.round("score", 6).alias("score"))


def search_hybrid(spark, sf_dir):
    t = tables(spark, sf_dir)
    like = _like(spark, sf_dir, t["chunks"])
    return shown(search.search(t, like[0], k=5, now=texts.NOW, scores=cut(search.hybrid_scores(t, *like))))


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "chunk_id", "cite", F.round("score", 6).alias("score"), "status", "age", DAY("as_of").alias("as_of"), F.col("must_reverify").cast("int").alias("must_reverify"))


def _stated() -> dict[str, str]:
    return dict(texts.QUESTIONS) | {q: t for q, t, _ in facts.ASKED}


def search_notes(spark, sf_dir):
    """The ten best chunks for each stated question, superseding ones promoted."""
    return shown(search.search(tables(spark, sf_dir), search.asked(spark, _stated()), k=10, now=texts.NOW))


def search_asof(spark, sf_dir, as_of=facts.CUTOFFS[1]):
    """The same as it was known on a day in the past."""
    return shown(search.search(tables(spark, sf_dir), search.asked(spark, _stated(), as_of), k=10, now=texts.NOW, as_of=as_of))


def search_explain(spark, sf_dir):
    """For each stated question the fact that answers it, its present value, and how many values it replaced."""
    hits = cut(search.search(t := tables(spark, sf_dir), search.asked(spark, _stated()), k=10, now=texts.NOW))
    told = search.explain(t, _stated(), now=texts.NOW, hits=hits)
    return told.select("qid", "key", "status", F.col("resolved").cast("int").alias("resolved"), F.col("current.value").alias("value"), F.col("current.cite").alias("cite"), F.size(F.coalesce("superseded", F.array())).alias("n_superseded"), F.col("no_match").cast("int").alias("no_match"), F.col("no_fact").cast("int").alias("no_fact"))


# Whole documents, unstemmed, so that SQL can follow: a note's day is when it was updated, and of several notes of one
# entity and title the latest supersedes those of other content.


def document_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = load(spark, sf_dir, "documents")
    source = F.when(F.col("updated").isNotNull(), "front-matter:updated").otherwise("unknown")
    chunks = cut(with_tokens(spread(docs.select("doc_id", "text", "path", "updated"), "doc_id"), "text").select(
        F.col("doc_id").alias("chunk_id"), "path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("updated").alias("effective_date"), source.alias("effective_source"), is_volatile_text(F.col("text")).alias("is_volatile"), "tokens"
    ))
    none = lambda kind: F.lit(None).cast(kind)
    named = docs.filter("entity is not null and title is not null")
    hashed = F.sha1(F.col("text").cast("binary"))
    notes_ = named.select(
        F.lower(F.concat_ws(" ", "entity", "title")).alias("key"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), "path", F.col("title").alias("label"), hashed.alias("value"), hashed.alias("raw_value"), F.col("updated").alias("start"),
        source.alias("source"), none("string").alias("authority"), none("string").alias("origin"), none("date").alias("valid_from"), none("date").alias("valid_until"),
    )
    return {"chunks": chunks, "assertions": notes_, "postings": cut(retrieval.forward(chunks))}


def _found(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("qid", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), *more)


def rerank(spark, sf_dir):
    return _found(search.search(document_tables(spark, sf_dir), texts.questions(spark), k=5, now=texts.NOW, mode="ranked"))


def search_full(spark, sf_dir):
    return _found(search.search(document_tables(spark, sf_dir), texts.questions(spark), k=10, now=texts.NOW, mode="ranked"), "status", "age")


def search_before(spark, sf_dir):
    """As of a day in the past: later notes are left out, and supersede nothing."""
    return _found(search.search(document_tables(spark, sf_dir), texts.questions(spark), k=10, now=texts.NOW, mode="ranked", as_of=facts.CUTOFFS[1]), "status", "age")


def alike(spark: SparkSession, sf_dir: str, t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every hundredth vector asks with the words of the document of its number: questions, vectors, their vectors."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    asked = vectors.filter("pmod(chunk_id, 100) = 0").withColumn("qid", F.col("chunk_id").cast("string"))
    words = t["postings"].join(asked.select("chunk_id", "qid"), "chunk_id").select("qid", F.transform("terms", lambda x: x["term"]).alias("terms"))
    return words, vectors, asked.select("qid", "vec")


def rrf_fuse(spark, sf_dir):
    t = document_tables(spark, sf_dir)
    return search.hybrid_scores(t, *alike(spark, sf_dir, t)).select("qid", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


def hybrid_rrf(spark, sf_dir):
    t = document_tables(spark, sf_dir)
    asked = alike(spark, sf_dir, t)
    return search.search(t, asked[0], k=5, now=texts.NOW, mode="ranked", scores=cut(search.hybrid_scores(t, *asked))).select("qid", "rank", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


_NAMES = "search_fused search_hybrid search_notes search_asof search_explain rerank search_full search_before rrf_fuse hybrid_rrf".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_NOTES = """a AS (SELECT doc_id AS entry_id, lower(entity || ' ' || title) AS key, doc_id AS chunk_id, path, sha1(text) AS value, sha1(text) AS raw, updated AS start, NULL AS authority, coalesce(updated, DATE '0001-01-01') AS day
  FROM documents WHERE entity IS NOT NULL AND title IS NOT NULL)"""
_CONFLICTS = re.sub(r"\b([wt])\b", r"\1_", facts._CONF)  # w and t name other tables here
_NOW, _THEN = "DATE '2026-09-29'", "DATE '2023-01-01'"


def _states(when: str, x: str) -> str:
    """st: the state of every document at a day; x: the facts that count then."""
    return f"""{_NOTES}, {x}, {_CONFLICTS}, su AS (SELECT DISTINCT loser FROM lo WHERE reason = ''),
dd AS (SELECT doc_id, updated, greatest(0, {when} - updated) AS age, regexp_matches(text, '{texts._VOLATILE.replace("'", "''")}') AS vol FROM documents WHERE updated IS NOT NULL UNION ALL SELECT doc_id, updated, NULL, regexp_matches(text, '{texts._VOLATILE.replace("'", "''")}') FROM documents WHERE updated IS NULL),
st AS (SELECT doc_id, updated, age, CASE WHEN age IS NULL THEN 0.0 ELSE pow(0.5, age / 180.0) END AS decay, doc_id IN (SELECT loser FROM su) AS superseded,
  CASE WHEN age IS NULL OR (vol AND age > 30) OR age > 365 THEN 'STALE' WHEN age <= 90 THEN 'FRESH' ELSE 'AGING' END AS fresh FROM dd)"""


def _ranking(scores: str, where: str = "true") -> str:
    return f"""rr AS (SELECT qid, doc_id, age, CASE WHEN superseded THEN 'SUPERSEDED' ELSE fresh END AS status, score * (0.75 + 0.25 * decay) * CASE WHEN superseded THEN 0.6 ELSE 1 END AS score FROM {scores} JOIN st USING (doc_id) WHERE {where}),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rr)"""


_PAST = f"x AS (SELECT a.*, {_THEN} AS cutoff FROM a WHERE start IS NULL OR start <= {_THEN})"
_FUSED = (
    texts._POST + ", " + texts._COS + """, q AS (SELECT DISTINCT CAST(vec_id AS VARCHAR) AS qid, term FROM embeddings JOIN p ON doc_id = vec_id WHERE vec_id % 100 = 0), d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
b AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY qid, doc_id),
sr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b),
fu AS (SELECT qid, doc_id, sum(1 / (60.0 + rank)) AS score FROM (SELECT qid, vec_id AS doc_id, rank FROM dr WHERE rank <= 50 UNION ALL SELECT qid, doc_id, rank FROM sr WHERE rank <= 50) GROUP BY ALL)"""
)
_SHOWN = "SELECT qid, rank, doc_id, round(score, 6) AS score"
ORACLE: dict[str, str] = {
    "rerank": f"WITH {texts._BM25}, {_states(_NOW, facts._ALL)}, {_ranking('b')} {_SHOWN} FROM rk WHERE rank <= 5",
    "search_full": f"WITH {texts._BM25}, {_states(_NOW, facts._ALL)}, {_ranking('b')} {_SHOWN}, status, age FROM rk WHERE rank <= 10",
    "search_before": f"WITH {texts._BM25}, {_states(_THEN, _PAST)}, {_ranking('b', f'updated IS NULL OR updated <= {_THEN}')} {_SHOWN}, status, age FROM rk WHERE rank <= 10",
    "rrf_fuse": f"WITH {_FUSED} SELECT qid, doc_id AS vec_id, round(score, 6) AS score FROM fu",
    "hybrid_rrf": f"WITH {_FUSED}, {_states(_NOW, facts._ALL)}, {_ranking('fu')} SELECT qid, rank, doc_id AS vec_id, round(score, 6) AS score FROM rk WHERE rank <= 5",
}
