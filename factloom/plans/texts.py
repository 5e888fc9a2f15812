"""Queries over documents, chunks and vectors: text functions, freshness, retrieval, the index."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import freshness as fr
from factloom.functions.text import content_words, normalized, stem_all_udf, stem_udf, stemmed, with_tokens, words_of
from factloom.operators import index, retrieval
from factloom.session import load, spread, stored

NOW = date(2026, 9, 29)
#: A stated table of questions; the corpus is asked all of them in one job.
QUESTIONS = (("q1", "deploy the schema migration"), ("q2", "blood pressure of the patient"), ("q3", "contract clause and court appeal"), ("q4", "Rückfahrt Zug Hotel"), ("q5", "sourdough starter in the oven"))
#: A document's date and its source in these queries, for lack of a parsed one.
DAY = "date_add(date'2025-01-01', cast(doc_id % 700 as int))"


def questions(spark: SparkSession) -> DataFrame:
    return with_tokens(spark.createDataFrame(list(QUESTIONS), "qid string, query string"), "query", "terms")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(spread(documents(spark, sf_dir), "doc_id"), "text").select(F.col("doc_id").alias("chunk_id"), "tokens")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("norm", normalized(F.coalesce("text", F.lit("")))).select("doc_id", words_of(F.col("norm")).alias("words"))


def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("n", normalized(F.col("text"))).select("doc_id", F.trim(F.regexp_replace("n", r"[^\p{L}\p{N}]+", " ")).alias("norm"))


def words(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.posexplode("words").alias("pos", "word"))


def word_count(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.size("words").alias("n_words"))


def stopword_filter(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.size(content_words(F.col("words"))).alias("kept"), (F.size("words") - F.size(content_words(F.col("words")))).alias("dropped"))


def tokens_raw(spark, sf_dir):
    return tokens(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), F.array_join("tokens", " ").alias("tokens"))


def tokens_stemmed(spark, sf_dir):
    return stemmed(retrieval.postings(tokens(spark, sf_dir))).groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"))


def stem_vocab(spark, sf_dir):
    return retrieval.postings(tokens(spark, sf_dir)).select("term").distinct().withColumn("stem", stem_udf("term"))


def doc_lines(spark, sf_dir):
    text = F.regexp_replace(F.regexp_replace("text", "\r\n|\r", "\n"), "^﻿", "")
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))


def paragraph_chunks(spark, sf_dir):
    """Runs of lines that are not blank: first line, last line and length of each."""
    lines = doc_lines(spark, sf_dir).withColumn("blank", F.trim("line") == "")
    w = W.partitionBy("doc_id").orderBy("n")
    run = lines.withColumn("grp", F.sum(F.col("blank").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("not blank")
    return run.groupBy("doc_id", "grp").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.sum(F.length("line")).alias("chars")).drop("grp")


def phrase_contains(spark, sf_dir):
    bare = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9#]+", " ")), F.lit(" "))
    return documents(spark, sf_dir).select("doc_id", bare.contains(" end of the week ").cast("int").alias("has"))


def volatile_detect(spark, sf_dir):
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "text").distinct()
    return chunks.select("chunk_id", fr.is_volatile_text(F.col("text")).cast("int").alias("is_volatile"))


def file_sha1(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.octet_length("text").alias("n_bytes"))


def oversize_skip(spark, sf_dir, most: int = 2000):
    return documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("n_bytes")).withColumn("skipped", (F.col("n_bytes") > most).cast("int"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scan of each file: (path, mtime, n_bytes, sha1_hex, title, entity)."""
    rows = load(spark, sf_dir, "note_files")
    last = F.max(F.struct("scanned_at", "mtime", "n_bytes", "sha1_hex", "title", "entity")).alias("s")
    return rows.filter("path is not null").groupBy("path").agg(last).select("path", "s.mtime", "s.n_bytes", "s.sha1_hex", "s.title", "s.entity")


def mtime_date(spark, sf_dir):
    return scans(spark, sf_dir).select("path", F.date_format(fr.mtime_date(F.col("mtime")), "yyyy-MM-dd").alias("day"))


def dated_chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """chunk_id, path, cite, day, source, volatile and ``more`` columns of every chunk: its own date, else the file's."""
    named = ("chunk_id", "path", "start_line", "verified", "date_source", "is_volatile", "text")
    chunks = load(spark, sf_dir, "chunks").select(*named, *[c for c in more if c not in named]).dropDuplicates(["chunk_id"])
    files = scans(spark, sf_dir).select("path", fr.mtime_date(F.col("mtime")).alias("file_day"))
    source = F.when(F.col("verified").isNotNull(), F.coalesce("date_source", F.lit("inline"))).when(F.col("file_day").isNotNull(), "mtime").otherwise("unknown")
    volatile = F.coalesce("is_volatile", F.lit(False)) | fr.is_volatile_text(F.col("text"))
    return chunks.join(files, "path", "left").select("chunk_id", "path", F.concat_ws(":", "path", "start_line").alias("cite"), F.coalesce("verified", "file_day").alias("day"), source.alias("source"), volatile.alias("volatile"), *more)


def effective_date(spark, sf_dir):
    return dated_chunks(spark, sf_dir).select("chunk_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "source")


def assessed(df: DataFrame, now: date = NOW) -> DataFrame:
    """df (day, volatile) with age, must, status and decay."""
    aged = df.withColumn("age", fr.age_days(F.col("day"), F.lit(now)))
    aged = aged.withColumn("must", fr.must_reverify(F.col("age"), F.col("volatile")))
    return aged.withColumn("status", fr.status(F.col("age"), F.col("must"))).withColumn("decay", fr.decay(F.col("age")))


def freshness_age(spark, sf_dir):
    return assessed(dated_chunks(spark, sf_dir)).select("chunk_id", "age")


def freshness_status(spark, sf_dir):
    return assessed(dated_chunks(spark, sf_dir)).select("chunk_id", "status")


def must_reverify(spark, sf_dir):
    return assessed(dated_chunks(spark, sf_dir)).select("chunk_id", F.col("must").cast("int").alias("must_reverify"))


def decay(spark, sf_dir):
    return assessed(dated_chunks(spark, sf_dir)).select("chunk_id", F.round("decay", 6).alias("decay"))


def chunk_doc_join(spark, sf_dir):
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "path", "kind").distinct()
    return chunks.join(scans(spark, sf_dir), "path").select("chunk_id", "kind", "title", "entity", "n_bytes")


def stale_list(spark, sf_dir):
    found = assessed(dated_chunks(spark, sf_dir)).filter("must")
    order = W.partitionBy("path").orderBy(F.coalesce("age", F.lit(0)).desc(), "cite")
    return found.withColumn("place", F.row_number().over(order)).select("path", "cite", "age", "place")


def term_freq(spark, sf_dir):
    return retrieval.postings(tokens(spark, sf_dir))


def doc_freq(spark, sf_dir):
    return retrieval.postings(tokens(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(spark, sf_dir):
    return retrieval.corpus_stats(tokens(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(spark, sf_dir):
    df = doc_freq(spark, sf_dir).crossJoin(F.broadcast(retrieval.corpus_stats(tokens(spark, sf_dir))))
    return df.select("term", F.round(retrieval.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _scores(spark, sf_dir):
    return retrieval.bm25(tokens(spark, sf_dir), questions(spark))


def bm25_topk(spark, sf_dir):
    return retrieval.top_k(_scores(spark, sf_dir), 5).select("qid", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_many(spark, sf_dir):
    """The five best documents for the entity and title of every document. Questions of the same words are scored once."""
    named = with_tokens(load(spark, sf_dir, "documents").withColumn("name", F.concat_ws(" ", "entity", "title")), "name", "terms").select("doc_id", F.array_sort(F.array_distinct("terms")).alias("terms")).filter(F.size("terms") > 0)
    asked = named.withColumn("qid", F.array_join("terms", " "))
    best = retrieval.bm25_best(stored(retrieval.forward(tokens(spark, sf_dir))), asked.select("qid", "terms").distinct(), 5)
    return asked.select(F.col("doc_id").alias("asker"), "qid").join(best, "qid").select("asker", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def stemmed_top(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """The five best texts by stems; texts without tokens don't count."""
    stems = tokens.filter(F.size("tokens") > 0).select("chunk_id", stem_all_udf("tokens").alias("tokens"))
    return retrieval.top_k(retrieval.bm25(stems, asked.select("qid", stem_all_udf("terms").alias("terms"))), 5)


def bm25_stemmed(spark, sf_dir):
    return stemmed_top(tokens(spark, sf_dir), questions(spark)).select("qid", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def grep_score(spark, sf_dir):
    asked = questions(spark).select("qid", F.array_distinct("terms").alias("terms"))
    low = documents(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
    n = F.size(F.filter("terms", lambda t: F.col("low").contains(t)))
    found = low.crossJoin(F.broadcast(asked)).select("qid", F.col("doc_id").alias("chunk_id"), n.alias("score")).filter("score > 0")
    return retrieval.top_k(found, 10).select("qid", "rank", F.col("chunk_id").alias("doc_id"), F.col("score").cast("int").alias("score"))


def rotate_partition(spark, sf_dir, keep_days: int = 365):
    """Dated log sections to archive, by month."""
    log = load(spark, sf_dir, "chunks").filter("path = 'log.md' and verified is not null").select("chunk_id", "verified", "text").distinct()
    old = log.filter(F.col("verified") < F.date_sub(F.lit(NOW), keep_days))
    return old.groupBy(F.date_format("verified", "yyyy-MM").alias("month")).agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"))


#: Scans of the folder before this time make the old manifest, later ones the new one.
SECOND_SCAN = "2026-11-13 00:00:00"


def _manifests(spark, sf_dir):
    scan = load(spark, sf_dir, "note_files").select("path", "mtime", F.col("n_bytes").alias("size"), F.col("sha1_hex").alias("sha1"), "scanned_at").filter("path is not null")
    last = lambda rows: rows.groupBy("path").agg(F.max_by(F.struct("mtime", "size", "sha1"), F.struct("scanned_at", "sha1", "mtime")).alias("s")).select("path", "s.*")
    second = F.col("scanned_at") >= F.to_timestamp_ntz(F.lit(SECOND_SCAN))
    return last(scan.filter(~second)), last(scan.filter(second))


def incremental_diff(spark, sf_dir):
    old, new = _manifests(spark, sf_dir)
    return index.manifest_diff(old, new).select("path", "status")


def index_version(spark, sf_dir):
    return index.version_of(scans(spark, sf_dir).select("path", F.col("sha1_hex").alias("sha1")))


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _vector_queries(spark, sf_dir):
    return _vectors(spark, sf_dir).filter("pmod(vec_id, 100) = 0").select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("vec"))


def cosine_topk(spark, sf_dir):
    found = retrieval.cosine_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10, id="vec_id", vec="embedding")
    return found.select("qid", "rank", F.col("chunk_id").alias("vec_id"), F.round("score", 5).alias("score"))


_NAMES = """normalize_text words word_count stopword_filter tokens_raw tokens_stemmed stem_vocab doc_lines paragraph_chunks phrase_contains volatile_detect file_sha1 oversize_skip
mtime_date effective_date freshness_age freshness_status must_reverify decay chunk_doc_join stale_list term_freq doc_freq corpus_stats bm25_idf bm25_topk bm25_many bm25_stemmed
grep_score rotate_partition incremental_diff index_version cosine_topk""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in __import__("factloom.functions.text", fromlist=["STOPWORDS"]).STOPWORDS)
_WORDS = r"""
w AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(replace(replace(strip_accents(lower(nfc_normalize(coalesce(text, '')))), 'ß', 'ss'), 'ς', 'σ'), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)?'),
  lambda x: regexp_replace(regexp_replace(x, '[''’]s$', ''), '[''’]', '', 'g')), lambda x: x <> '') AS words FROM documents)"""
_NAMES_OF = _WORDS.split("SELECT doc_id, text, ")[1].split(" AS words FROM")[0].replace("coalesce(text, '')", "concat_ws(' ', entity, title)")
_TOKENS = _WORDS + f", t AS (SELECT doc_id, list_filter(words, lambda x: x NOT IN ({_STOP})) AS tokens FROM w)"
_POST = _TOKENS + ", l AS (SELECT doc_id, len(tokens) AS dl FROM t), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY ALL), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l)"
_ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{t}')" for q, x in QUESTIONS for t in dict.fromkeys(x.lower().replace("ü", "u").split()) if t not in ("the", "of", "and", "in")) + ") v(qid, term))"
_BM25 = (
    _POST + ", " + _ASKED + ", d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), "
    "b AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY qid, doc_id)"
)
_VOLATILE = "(?i)" + "|".join(fr.VOLATILE_PATTERNS)
_SCANS = "f AS (SELECT path, mtime, n_bytes, sha1_hex, title, entity FROM note_files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, mtime DESC, n_bytes DESC, sha1_hex DESC, title DESC NULLS LAST, entity DESC NULLS LAST) = 1)"
_DATED = (
    _SCANS + ", c AS (SELECT DISTINCT chunk_id, path, start_line, verified, date_source, is_volatile, text FROM chunks), "
    "e AS (SELECT chunk_id, c.path, c.path || ':' || start_line AS cite, coalesce(verified, CASE WHEN mtime > 0 THEN CAST(to_timestamp(floor(mtime)) AT TIME ZONE 'UTC' AS DATE) END) AS day, "
    "CASE WHEN verified IS NOT NULL THEN coalesce(date_source, 'inline') WHEN mtime > 0 THEN 'mtime' ELSE 'unknown' END AS source, coalesce(is_volatile, false) OR regexp_matches(text, '" + _VOLATILE.replace("'", "''") + "') AS volatile FROM c LEFT JOIN f USING (path)), "
    "a AS (SELECT *, greatest(0, DATE '2026-09-29' - day) AS age FROM (SELECT * FROM e WHERE day IS NOT NULL) UNION ALL SELECT *, NULL FROM e WHERE day IS NULL), "
    "m AS (SELECT *, CASE WHEN age IS NULL THEN volatile ELSE volatile AND age > 30 END AS must FROM a)"
)
_COS = (
    "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v), "
    "dn AS (SELECT CAST(a.vec_id AS VARCHAR) AS qid, b.vec_id, list_dot_product(a.e, b.e) / (CASE WHEN a.n = 0 THEN 1 ELSE a.n END * CASE WHEN b.n = 0 THEN 1 ELSE b.n END) AS score FROM u a, u b WHERE a.vec_id % 100 = 0), "
    "dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dn)"
)
_LAST = "(SELECT path, mtime, n_bytes AS size, sha1_hex AS sha1 FROM note_files WHERE path IS NOT NULL AND scanned_at {when} TIMESTAMP '" + SECOND_SCAN + "' QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, sha1_hex DESC, mtime DESC) = 1)"

ORACLE = {
    "normalize_text": r"SELECT doc_id, trim(regexp_replace(replace(replace(strip_accents(lower(nfc_normalize(text))), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents",
    "words": "WITH" + _WORDS + " SELECT doc_id, unnest(generate_series(0, len(words) - 1)) AS pos, unnest(words) AS word FROM w WHERE len(words) > 0",
    "word_count": "WITH" + _WORDS + " SELECT doc_id, len(words) AS n_words FROM w",
    "stopword_filter": "WITH" + _TOKENS + " SELECT doc_id, len(tokens) AS kept, len(words) - len(tokens) AS dropped FROM w JOIN t USING (doc_id)",
    "tokens_raw": "WITH" + _TOKENS + " SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM t",
    "doc_lines": r"WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '^' || chr(65279), ''), chr(10)) AS ls FROM documents) SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS n, unnest(ls) AS line FROM l",
    "paragraph_chunks": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '^' || chr(65279), ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS n, unnest(ls) AS line FROM l), g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM x)
SELECT doc_id, min(n) AS first, max(n) AS last, CAST(sum(length(line)) AS BIGINT) AS chars FROM g WHERE trim(line) <> '' GROUP BY doc_id, grp""",
    "phrase_contains": "SELECT doc_id, CAST(contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9#]+', ' ', 'g')) || ' ', ' end of the week ') AS INT) AS has FROM documents",
    "volatile_detect": "SELECT DISTINCT chunk_id, CAST(regexp_matches(text, '" + _VOLATILE.replace("'", "''") + "') AS INT) AS is_volatile FROM (SELECT DISTINCT chunk_id, text FROM chunks)",
    "file_sha1": "SELECT doc_id, sha1(text) AS sha1, strlen(text) AS n_bytes FROM documents",
    "oversize_skip": "SELECT doc_id, strlen(text) AS n_bytes, CAST(strlen(text) > 2000 AS INT) AS skipped FROM documents",
    "mtime_date": "WITH " + _SCANS + " SELECT path, CASE WHEN mtime > 0 THEN strftime(to_timestamp(floor(mtime)) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS day FROM f",
    "effective_date": "WITH " + _DATED + " SELECT chunk_id, strftime(day, '%Y-%m-%d') AS day, source FROM e",
    "freshness_age": "WITH " + _DATED + " SELECT chunk_id, age FROM m",
    "freshness_status": "WITH " + _DATED + " SELECT chunk_id, CASE WHEN age IS NULL OR must OR age > 365 THEN 'STALE' WHEN age <= 90 THEN 'FRESH' ELSE 'AGING' END AS status FROM m",
    "must_reverify": "WITH " + _DATED + " SELECT chunk_id, CAST(must AS INT) AS must_reverify FROM m",
    "decay": "WITH " + _DATED + " SELECT chunk_id, round(CASE WHEN age IS NULL THEN 0 ELSE pow(0.5, age / 180.0) END, 6) AS decay FROM m",
    "chunk_doc_join": "WITH " + _SCANS + " SELECT chunk_id, kind, title, entity, n_bytes FROM (SELECT DISTINCT chunk_id, path, kind FROM chunks) JOIN f USING (path)",
    "stale_list": "WITH " + _DATED + " SELECT path, cite, age, row_number() OVER (PARTITION BY path ORDER BY coalesce(age, 0) DESC, cite) AS place FROM m WHERE must",
    "term_freq": "WITH" + _POST + " SELECT doc_id AS chunk_id, term, tf FROM p",
    "doc_freq": "WITH" + _POST + " SELECT term, count(*) AS df FROM p GROUP BY term",
    "corpus_stats": "WITH" + _POST + " SELECT n, round(avgdl, 6) AS avgdl FROM s",
    "bm25_idf": "WITH" + _POST + " SELECT term, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, s GROUP BY term, n",
    "bm25_topk": "WITH" + _BM25 + " SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM b QUALIFY rank <= 5",
    "bm25_many": "WITH" + _POST + ", nm AS (SELECT doc_id AS asker, unnest(list_distinct(list_filter(" + _NAMES_OF + ", lambda x: x NOT IN (" + _STOP + ")))) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM nm) GROUP BY term), "
    "b AS (SELECT asker, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM nm JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY ALL) "
    "SELECT asker, row_number() OVER (PARTITION BY asker ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM b QUALIFY rank <= 5",
    "grep_score": "WITH " + _ASKED + ", g AS (SELECT qid, doc_id, CAST(sum(CAST(contains(lower(text), term) AS INT)) AS INT) AS score FROM documents, q GROUP BY ALL) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM g WHERE score > 0 QUALIFY rank <= 10",
    "rotate_partition": "SELECT strftime(verified, '%Y-%m') AS month, count(*) AS sections, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT DISTINCT chunk_id, verified, text FROM chunks WHERE path = 'log.md' AND verified IS NOT NULL) WHERE verified < DATE '2026-09-29' - 365 GROUP BY 1",
    "incremental_diff": "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.mtime = b.mtime AND a.size = b.size THEN 'unchanged' WHEN a.sha1 = b.sha1 THEN 'touched' ELSE 'updated' END AS status FROM "
    + _LAST.format(when="<") + " a FULL JOIN " + _LAST.format(when=">=") + " b USING (path)",
    "index_version": "WITH " + _SCANS + ", h AS (SELECT count(*) AS files, coalesce(sum(CAST(CAST('0x' || left(sha256(path || '|' || coalesce(sha1_hex, '')), 15) AS BIGINT) AS HUGEINT)), 0) AS total FROM f) SELECT left(sha256(files || ':' || total), 12) AS version, files FROM h",
    "cosine_topk": "WITH " + _COS + " SELECT qid, rank, vec_id, round(score, 5) AS score FROM dr WHERE rank <= 10",
}
