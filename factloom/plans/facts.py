"""Queries over recorded values: supersession, history, explanation, round trips of rendered notes, evaluation."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import content_words, normalized, with_tokens, words_of
from factloom.operators import evaluate, facts, notes, retrieval, search
from factloom.plans import texts
from factloom.session import cut, load, stored

CUTOFFS = (date(2021, 1, 1), date(2023, 1, 1), date(2025, 1, 1))
SINCE, UNTIL = date(2023, 6, 1), date(2024, 6, 1)
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assertion for each recorded value, as the fact operators take them."""
    rows = load(spark, sf_dir, "entries").filter("value is not null and trim(value) != '' and fact_key is not null").distinct()
    start = F.coalesce("valid_from", "as_of")
    return rows.select(
        F.col("fact_key").alias("key"), "chunk_id", F.col("entry_id").alias("ord"), F.regexp_replace("cite", r":\d+$", "").alias("path"), F.coalesce("label", "fact_key").alias("label"), F.lower(F.trim("value")).alias("value"),
        F.col("value").alias("raw_value"), start.alias("start"), F.when(F.col("valid_from").isNotNull(), "tag:from").otherwise(F.coalesce("date_source", F.lit("unknown"))).alias("source"), "authority", F.col("source").alias("origin"), "valid_from", "valid_until", "cite",
        F.col("as_of").alias("day"), F.col("date_source").alias("day_source"),
    )


def assertion_start(spark, sf_dir):
    return assertions(spark, sf_dir).select(F.col("ord").alias("entry_id"), DAY("start").alias("start"), "source")


def fact_entries(spark, sf_dir):
    """Place of each entry within its fact, oldest first."""
    order = ["start", "chunk_id", "ord"]
    rows = facts.beside(assertions(spark, sf_dir).select("key", "value", *order), "key", F.date_trunc("month", "start"), order, ["ord"])
    return rows.select("key", F.col("ord").alias("entry_id"), DAY("start").alias("start"), F.col("prev_ord").alias("previous"))


def conflict_keys(spark, sf_dir):
    rows = assertions(spark, sf_dir)
    return rows.groupBy("key").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("path").alias("n_paths"), F.countDistinct(F.coalesce("start", F.to_date(F.lit("0001-01-01")))).alias("n_starts")).filter("n_values > 1 and not (n_paths = 1 and n_starts = 1)")


def _conflict_rows(found: DataFrame) -> DataFrame:
    return found.select("key", "winner", "winner_value", F.col("resolved").cast("int").alias("resolved"), "reason")


def supersession(spark, sf_dir):
    return _conflict_rows(facts.conflicts(assertions(spark, sf_dir)))


def supersession_asof(spark, sf_dir):
    found = facts.conflicts(assertions(spark, sf_dir), CUTOFFS)
    return found.select(DAY("cutoff").alias("cutoff"), "key", "winner", "winner_value", F.col("resolved").cast("int").alias("resolved"), "reason")


def authority_tiebreak(spark, sf_dir):
    """Supersession where every entry is tagged, so that authority settles ties."""
    rows = assertions(spark, sf_dir).withColumn("authority", F.coalesce("authority", F.element_at(F.array(*map(F.lit, ("explicit", "observed", "imported", "inferred"))), (F.col("ord") % 4 + 1).cast("int"))))
    return _conflict_rows(facts.conflicts(rows))


def conflicts_report(spark, sf_dir):
    rows = assertions(spark, sf_dir)
    found = facts.conflicts(rows)
    lost = facts.losers(rows, found).groupBy("key").agg(F.count("*").alias("n_losers"), F.min("loser").alias("first_loser"), F.max("loser").alias("last_loser"))
    return found.join(lost, "key", "left").select("key", "winner", "winner_value", DAY("winner_start").alias("start"), "reason", F.coalesce("n_losers", F.lit(0)).alias("n_losers"), "first_loser", "last_loser")


def hit_links(spark, sf_dir):
    return facts.links(assertions(spark, sf_dir)).select("key", "loser", "winner")


def _by_chunk(spark, sf_dir) -> DataFrame:
    """The facts of each chunk in one row: a chunk's entries are as many as its text has lines."""
    rows = assertions(spark, sf_dir)
    return rows.groupBy("chunk_id").agg(F.collect_list(F.coalesce("start", F.to_date(F.lit("0001-01-01")))).alias("starts"), F.collect_list(F.coalesce("valid_until", F.to_date(F.lit("9999-12-31")))).alias("untils"), F.max("day").alias("day"), F.max(F.coalesce("day_source", F.lit("unknown"))).alias("source"))


def asof_filter(spark, sf_dir):
    when = F.lit(CUTOFFS[1])
    return _by_chunk(spark, sf_dir).filter(facts.exists_at(F.col("day"), F.col("source"), F.col("starts"), when)).select("chunk_id")


def expired(spark, sf_dir):
    return _by_chunk(spark, sf_dir).filter(facts.expired_at(F.col("untils"), F.lit(texts.NOW))).select("chunk_id")


def weak_entries(spark, sf_dir):
    return assertions(spark, sf_dir).filter(facts.weak(F.col("start"), F.col("source"))).select(F.col("ord").alias("entry_id"), "source")


def value_at(spark, sf_dir):
    return facts.value_at(assertions(spark, sf_dir), CUTOFFS).select(DAY("cutoff").alias("cutoff"), "key", "chunk_id", "value", "status", F.col("resolved").cast("int").alias("resolved"))


def timeline(spark, sf_dir):
    found = facts.timeline(assertions(spark, sf_dir))
    return found.select("key", "value", DAY("from_day").alias("from_day"), DAY("to_day").alias("to_day"), F.col("present").cast("int").alias("present"))


def diff_window(spark, sf_dir):
    return facts.diff_window(assertions(spark, sf_dir), SINCE, UNTIL).select("key", "change", "value", "previous", DAY("start").alias("start"), "undated")


ASKED = (("f1", "orvane halt relay p00 status", "orvane halt p00 relay status"), ("f2", "monthly cost of the canopy", "monthly cost canopy"), ("f3", "review state fjord", "review state fjord"), ("f4", "deploy region", "deploy region"))


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, t.split()) for q, _, t in ASKED], "qid string, terms array<string>")


def key_overlap(spark, sf_dir):
    keys = assertions(spark, sf_dir).select("key").distinct().crossJoin(F.broadcast(_asked(spark)))
    return keys.select("qid", "key", F.size(F.array_intersect(F.split("key", " "), F.col("terms"))).alias("overlap")).filter("overlap > 0")


def _fact_hits(spark, sf_dir, k: int = 10) -> DataFrame:
    """The k chunks whose facts share most key words with each question; ties by chunk."""
    rows = assertions(spark, sf_dir).select("chunk_id", "key").distinct().join(key_overlap(spark, sf_dir), "key").groupBy("qid", "chunk_id").agg(F.max("overlap").cast("double").alias("score"))
    return retrieval.top_k(rows, k)


def pick_fact(spark, sf_dir):
    return facts.pick_fact(_fact_hits(spark, sf_dir), assertions(spark, sf_dir), _asked(spark)).select("qid", "key", "chunk_id", F.col("overlap").cast("int").alias("overlap"))


def explain_current(spark, sf_dir):
    """For each question the fact, its present value, whether that is settled, and how many values it replaced."""
    rows = assertions(spark, sf_dir)
    picked = facts.pick_fact(_fact_hits(spark, sf_dir), rows, _asked(spark)).select("qid", "key", "chunk_id")
    found = facts.conflicts(rows).select("key", "winner", "resolved", "reason")
    about = picked.join(found, "key", "left").withColumn("at", F.coalesce("winner", "chunk_id"))
    own = about.join(rows.select("key", F.col("chunk_id").alias("at"), "start", "ord", "value", "raw_value", "valid_until"), ["key", "at"])
    cur = own.groupBy("qid", "key", "at", "resolved", "reason").agg(F.min(F.struct(F.coalesce("start", F.to_date(F.lit("0001-01-01"))).alias("d"), "ord", "value", "raw_value", "start", "valid_until")).alias("c"))
    older = rows.join(cur.select("qid", "key", F.col("c.value").alias("now"), F.col("c.d").alias("d")), "key").filter("value != now and coalesce(start, date'0001-01-01') <= d").groupBy("qid").agg(F.count("*").alias("n_older"))
    state = F.when(F.col("c.valid_until") < F.lit(texts.NOW), "expired").otherwise("known")
    return cur.join(older, "qid", "left").select("qid", "key", F.col("c.raw_value").alias("value"), DAY("c.start").alias("start"), state.alias("status"), F.coalesce(F.col("resolved"), F.lit(True)).cast("int").alias("resolved"), F.when(F.col("resolved").isNotNull(), F.coalesce("n_older", F.lit(0))).otherwise(0).alias("n_superseded"))


def promote_one_level(spark, sf_dir):
    """Hits of each question after promotion, links given by chunk number: every third chunk is superseded by its successor."""
    ids = load(spark, sf_dir, "chunks").select("chunk_id").distinct()
    links = ids.filter("pmod(chunk_id, 3) = 0").select(F.col("chunk_id").alias("loser"), (F.col("chunk_id") + 1).alias("winner"), F.lit("deploy region").alias("key")).join(ids.select(F.col("chunk_id").alias("winner")), "winner", "left_semi")
    hits = ids.select(F.lit("f4").alias("qid"), "chunk_id", (F.pmod(F.col("chunk_id") * 7919, F.lit(100003)) / 100003.0).alias("score"))
    out = retrieval.promote(hits, links, _asked(spark), 5)
    return out.select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


def value_norm(spark, sf_dir):
    rows = load(spark, sf_dir, "entries").select("entry_id", "value").filter("value is not null").distinct()
    normed = rows.withColumn("n", normalized(F.regexp_replace(notes.value_cut(F.col("value")), r"\(.*?\)", " ")))
    return normed.select("entry_id", notes.value_form(F.col("n")).alias("form"))


def canonical_key(spark, sf_dir):
    """Keys of labels, qualified by their entity where they don't name it, without stemming."""
    rows = load(spark, sf_dir, "entries").select("entry_id", "label", "entity").filter("label is not null").distinct()
    rows = rows.withColumn("l", normalized(F.col("label"))).withColumn("e", normalized(F.coalesce("entity", F.lit("")))).select("entry_id", content_words(words_of(F.col("l"))).alias("s"), content_words(words_of(F.col("e"))).alias("q"))
    toks = F.when((F.size("q") > 0) & ~F.arrays_overlap("q", "s"), F.concat("q", "s")).otherwise(F.col("s"))
    return rows.withColumn("t", toks).filter("size(t) <= 8 and size(s) > 0").select("entry_id", F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("key"))


def stats(spark, sf_dir):
    chunks = texts.assessed(texts.dated_chunks(spark, sf_dir))
    one = chunks.agg(F.count("*").alias("chunks"), F.count_if("must").alias("must_reverify"))
    files = texts.scans(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))
    clashes = facts.conflicts(assertions(spark, sf_dir)).agg(F.count("*").alias("conflicts"))
    return one.crossJoin(F.broadcast(files)).crossJoin(F.broadcast(clashes))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown note for each customer: front matter, a heading, its segment, and a dated section for each order."""
    cust, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    line = F.concat(F.lit("\n## "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n\n- Order "), F.col("o_orderkey"), F.lit(" status: "), F.col("o_orderstatus"), F.lit("\n"))
    logs = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda x: x["t"]), "").alias("log"))
    joined = cust.join(logs, cust.c_custkey == logs.o_custkey, "left")
    text = F.concat(F.lit("---\nupdated: 2024-05-01\n---\n# "), F.col("c_name"), F.lit("\n\n- Segment: "), F.col("c_mktsegment"), F.lit("\n"), F.coalesce("log", F.lit("")))
    return joined.select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(".md")).alias("path"), text.alias("text"), F.lit(0.0).alias("mtime"))


def md_roundtrip_headings(spark, sf_dir):
    _, chunks = notes.parse_notes(rendered(spark, sf_dir))
    return chunks.filter("size(heading_path) = 2").groupBy("path").agg(F.count("*").alias("sections"), F.min(F.get("heading_path", F.lit(1))).alias("first_day"), F.max(F.get("heading_path", F.lit(1))).alias("last_day"))


def md_roundtrip_chunks(spark, sf_dir):
    _, chunks = notes.parse_notes(rendered(spark, sf_dir))
    return chunks.select("path", "start_line", "end_line", "kind", F.array_join("heading_path", " > ").alias("heading_path"), "text", DAY("verified").alias("verified"), "date_source")


def md_roundtrip_facts(spark, sf_dir):
    docs, chunks = notes.parse_notes(rendered(spark, sf_dir))
    found = notes.assertions_of(notes.dated(chunks, docs), stem=False)
    return found.select("path", "key", "value", DAY("start").alias("start"), "source")


def span_contains(spark, sf_dir):
    """Chunks that hold the middle line of their file's span."""
    chunks = load(spark, sf_dir, "chunks").select("chunk_id", "path", "start_line", "end_line").distinct()
    middle = chunks.groupBy("path").agg(F.floor((F.min("start_line") + F.max("end_line")) / 2).cast("int").alias("line"))
    return chunks.join(middle, "path").filter("line between start_line and end_line").select("chunk_id", "path", "line")


def _ranked(spark, sf_dir) -> DataFrame:
    """A result table for the metrics: each labelled document is asked for by the words of its entity and title.

    rank is its place among ten hits of BM25, stale whether another content of its entity and title is newer, ms a stand-in.
    """
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "doc_labels").filter("subject is not null").select(F.col("doc_id").alias("id"), F.col("subject").alias("category"), "rater").distinct()
    wanted = docs.join(labels.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    named = with_tokens(wanted.withColumn("name", F.concat_ws(" ", "entity", "title")), "name", "terms").select(F.col("doc_id").cast("string").alias("qid"), F.array_distinct("terms").alias("terms"))
    best = retrieval.bm25_best(stored(retrieval.forward(texts.tokens(spark, sf_dir))), named, 10)
    own = best.groupBy(F.col("qid").cast("long").alias("id")).agg(F.max(F.when(F.col("qid") == F.col("chunk_id").cast("string"), F.col("rank"))).alias("rank"), F.lit(True).alias("any"))
    key = F.lower(F.concat_ws(" ", "entity", "title"))
    newest = docs.filter("entity is not null and title is not null and updated is not null").groupBy(key.alias("key")).agg(F.max("updated").alias("newest"))
    states = docs.join(newest, key == F.col("key"), "left").select(F.col("doc_id").alias("id"), F.coalesce(F.col("updated") < F.col("newest"), F.lit(False)).alias("stale"), (F.col("n_chars") % 997 / 10.0).alias("ms"))
    found = labels.join(own, "id", "left").join(states, "id")
    return found.select("id", "category", F.concat("category", F.lit("/"), "rater").alias("case"), "rank", "stale", F.coalesce("any", F.lit(False)).alias("answered"), "ms")


def eval_metrics(spark, sf_dir):
    return evaluate.retrieval_metrics(_ranked(spark, sf_dir), "category")


def latency_quantiles(spark, sf_dir):
    return evaluate.latency(_ranked(spark, sf_dir), "category")


def grade_outcome(spark, sf_dir):
    return evaluate.graded(_ranked(spark, sf_dir)).select("id", "case", "outcome")


def temporal_summary(spark, sf_dir):
    return evaluate.summary(evaluate.graded(_ranked(spark, sf_dir)).withColumn("split", F.when(F.pmod("id", F.lit(10)) < 3, "heldout").otherwise("dev")))


def failure_counts(spark, sf_dir):
    return evaluate.graded(_ranked(spark, sf_dir)).filter("outcome != 'correct'").groupBy("category", "outcome").agg(F.count("*").alias("n"))


def bench_systems(spark, sf_dir):
    """The five best places of each system for each question. The two vector systems ask with the vectors of stated documents."""
    from factloom.plans import search as plans

    tables, stated = plans.document_tables(spark, sf_dir), texts.questions(spark)
    runs = {
        "grep": texts.grep_score(spark, sf_dir).filter("rank <= 5").withColumnRenamed("doc_id", "chunk_id"), "bm25": retrieval.top_k(retrieval.bm25_of(tables["postings"], stated), 5),
        "bm25_stemmed": texts.stemmed_top(tables["chunks"].select("chunk_id", "tokens"), stated), "full": search.search(tables, stated, k=5, now=texts.NOW, mode="ranked"),
    }
    asked, vectors, vecs = plans.alike(spark, sf_dir, tables)
    near = cut(retrieval.cosine_top_k(vectors, vecs, 50, id="chunk_id", vec="vec"))
    layered = search.search(tables, asked, k=5, now=texts.NOW, mode="ranked", scores=near.select("qid", "chunk_id", F.greatest("score", F.lit(0.0)).alias("score")))
    runs |= {"embed": near.filter("rank <= 5"), "embed_layer": layered}
    # Each system's few rows are stored before the next plan is made, so that the driver never holds all plans at once.
    return reduce(DataFrame.unionByName, [cut(rows.select(F.lit(name).alias("system"), "qid", "rank", F.col("chunk_id").alias("doc_id"))) for name, rows in runs.items()])


def temporal_systems(spark, sf_dir):
    """Accuracy of two answers for the value on given days: the last recorded entry, and the value in effect."""
    rows = assertions(spark, sf_dir)
    effect = facts.value_at(rows, CUTOFFS).select("cutoff", "key", "value", "status")
    last = rows.groupBy("key").agg(F.max(F.struct("ord", "value"))["value"].alias("said"))
    return effect.join(last, "key").groupBy("cutoff", "status").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("value")).alias("last_agrees")).select(DAY("cutoff").alias("cutoff"), "status", "n", "last_agrees")


_NAMES = """assertion_start fact_entries conflict_keys supersession supersession_asof authority_tiebreak conflicts_report hit_links asof_filter expired weak_entries value_at timeline diff_window
key_overlap pick_fact explain_current promote_one_level value_norm canonical_key stats md_roundtrip_headings md_roundtrip_chunks md_roundtrip_facts span_contains eval_metrics latency_quantiles
grade_outcome temporal_summary failure_counts bench_systems temporal_systems""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_A = r"""a AS (SELECT DISTINCT entry_id, fact_key AS key, chunk_id, regexp_replace(cite, ':\d+$', '') AS path, lower(trim(value)) AS value, value AS raw, coalesce(valid_from, as_of) AS start,
  CASE WHEN valid_from IS NOT NULL THEN 'tag:from' ELSE coalesce(date_source, 'unknown') END AS source, {auth} AS authority, valid_until, as_of, date_source,
  coalesce(coalesce(valid_from, as_of), DATE '0001-01-01') AS day FROM entries WHERE value IS NOT NULL AND trim(value) <> '' AND fact_key IS NOT NULL)"""
_CUT = "x AS (SELECT a.*, c.cutoff FROM a, (VALUES (DATE '2021-01-01'), (DATE '2023-01-01'), (DATE '2025-01-01')) c(cutoff) WHERE a.start IS NULL OR a.start <= c.cutoff)"
_ALL = "x AS (SELECT a.*, NULL::DATE AS cutoff FROM a)"
_CONF = """r AS (SELECT *, CASE authority WHEN 'explicit' THEN 4 WHEN 'observed' THEN 3 WHEN 'imported' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END AS rk, max(day) OVER (PARTITION BY cutoff, key) AS newest FROM x),
g AS (SELECT cutoff, key FROM r GROUP BY cutoff, key HAVING count(DISTINCT value) > 1 AND NOT (count(DISTINCT path) = 1 AND count(DISTINCT day) = 1)),
n AS (SELECT r.*, max(rk) OVER (PARTITION BY r.cutoff, r.key) AS top FROM r WHERE day = newest),
w AS (SELECT cutoff, key, chunk_id AS winner, value AS wv, raw AS wraw, authority AS wa, start AS wstart FROM n WHERE rk = top QUALIFY row_number() OVER (PARTITION BY cutoff, key ORDER BY chunk_id DESC, entry_id DESC) = 1),
t AS (SELECT n.cutoff, n.key, count(DISTINCT n.value) > 1 AS tied, max(top) > 0 AND count(DISTINCT CASE WHEN rk = top THEN n.value END) = 1 AND count(*) FILTER (WHERE authority IS NULL) = 0 AS settled FROM n GROUP BY ALL),
ex AS (SELECT DISTINCT r.cutoff, r.key FROM r JOIN w ON w.key = r.key AND w.cutoff IS NOT DISTINCT FROM r.cutoff WHERE r.authority = 'explicit' AND r.value <> wv),
cf AS (SELECT g.cutoff, g.key, winner, wv, wraw, wstart, CASE WHEN tied AND NOT settled THEN 'same-date' WHEN wa = 'inferred' AND ex.key IS NOT NULL THEN 'inferred-over-explicit' ELSE '' END AS reason
  FROM g JOIN w ON w.key = g.key AND w.cutoff IS NOT DISTINCT FROM g.cutoff JOIN t ON t.key = g.key AND t.cutoff IS NOT DISTINCT FROM g.cutoff LEFT JOIN ex ON ex.key = g.key AND ex.cutoff IS NOT DISTINCT FROM g.cutoff),
lo AS (SELECT DISTINCT cf.cutoff, cf.key, x.chunk_id AS loser, winner, reason FROM cf JOIN x ON x.key = cf.key AND x.cutoff IS NOT DISTINCT FROM cf.cutoff WHERE x.value <> wv AND x.chunk_id <> winner)"""
_P = _A.replace("{auth}", "authority")
_TAGGED = _A.replace("{auth}", "coalesce(authority, ['explicit', 'observed', 'imported', 'inferred'][entry_id % 4 + 1])")
_QS = "qs AS (SELECT * FROM (VALUES " + ", ".join(f"('{q}', {t.split()!r})" for q, _, t in ASKED) + ") v(qid, terms))"
_OVER = _QS + ", ko AS (SELECT qid, key, len(list_intersect(string_split(key, ' '), terms)) AS overlap FROM (SELECT DISTINCT key FROM a), qs WHERE len(list_intersect(string_split(key, ' '), terms)) > 0)"
_PICK = (
    _OVER + ", ht AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY max(overlap) DESC, chunk_id) AS rank FROM (SELECT DISTINCT chunk_id, key FROM a) JOIN ko USING (key) GROUP BY qid, chunk_id QUALIFY rank <= 10), "
    "pk AS (SELECT qid, a.key, chunk_id, ko.overlap FROM ht JOIN a USING (chunk_id) JOIN ko USING (qid, key) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ko.overlap DESC, rank, length(a.key), entry_id, a.key) = 1)"
)
_NORM = "replace(replace(strip_accents(lower(nfc_normalize({x}))), 'ß', 'ss'), 'ς', 'σ')"
_LIST = r"list_filter(list_transform(regexp_extract_all({x}, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)?'), lambda x: regexp_replace(regexp_replace(x, '[''’]s$', ''), '[''’]', '', 'g')), lambda x: x <> '' {and_})"
_RANKED = (texts._POST + """, lb AS (SELECT DISTINCT doc_id AS id, subject AS category, subject || '/' || rater AS case_ FROM doc_labels WHERE subject IS NOT NULL),
q AS (SELECT DISTINCT doc_id AS qid, unnest(list_filter({names}, lambda x: x NOT IN ({stop}))) AS term FROM documents WHERE doc_id IN (SELECT id FROM lb)), d AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
b AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY qid, doc_id),
bb AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b QUALIFY rank <= 10),
nw AS (SELECT lower(entity || ' ' || title) AS key, max(updated) AS newest FROM documents WHERE entity IS NOT NULL AND title IS NOT NULL GROUP BY 1),
rd AS (SELECT id, category, case_, bb.rank, coalesce(updated < newest, false) AS stale, id IN (SELECT qid FROM bb) AS answered, (n_chars % 997) / 10.0 AS ms
  FROM lb JOIN documents ON documents.doc_id = id LEFT JOIN bb ON bb.qid = id AND bb.doc_id = id LEFT JOIN nw ON nw.key = lower(entity || ' ' || title)),
gr AS (SELECT *, CASE WHEN rank IS NULL AND NOT answered THEN 'no_answer' WHEN stale AND coalesce(rank, 99) > 1 THEN 'stale' WHEN rank = 1 OR (answered AND NOT stale) THEN 'correct' ELSE 'wrong' END AS outcome FROM rd)""").replace("{names}", _LIST.replace("{x}", _NORM.format(x="concat_ws(' ', entity, title)"), 1).replace("{and_}", "")).replace("{stop}", texts._STOP)
_D = lambda c: f"strftime({c}, '%Y-%m-%d')"
_CUST = "cu AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.md' AS path, * FROM customer)"

ORACLE = {
    "assertion_start": f"WITH {_P} SELECT entry_id, {_D('start')} AS start, source FROM a",
    "fact_entries": f"WITH {_P} SELECT key, entry_id, {_D('start')} AS start, lag(entry_id) OVER (PARTITION BY key ORDER BY start NULLS FIRST, chunk_id, entry_id) AS previous FROM a",
    "conflict_keys": f"WITH {_P} SELECT key, count(DISTINCT value) AS n_values, count(DISTINCT path) AS n_paths, count(DISTINCT day) AS n_starts FROM a GROUP BY key HAVING n_values > 1 AND NOT (n_paths = 1 AND n_starts = 1)",
    "supersession": f"WITH {_P}, {_ALL}, {_CONF} SELECT key, winner, wv AS winner_value, CAST(reason = '' AS INT) AS resolved, reason FROM cf",
    "supersession_asof": f"WITH {_P}, {_CUT}, {_CONF} SELECT {_D('cutoff')} AS cutoff, key, winner, wv AS winner_value, CAST(reason = '' AS INT) AS resolved, reason FROM cf",
    "authority_tiebreak": f"WITH {_TAGGED}, {_ALL}, {_CONF} SELECT key, winner, wv AS winner_value, CAST(reason = '' AS INT) AS resolved, reason FROM cf",
    "conflicts_report": f"WITH {_P}, {_ALL}, {_CONF} SELECT cf.key, cf.winner, wv AS winner_value, {_D('wstart')} AS start, cf.reason, count(loser) AS n_losers, min(loser) AS first_loser, max(loser) AS last_loser FROM cf LEFT JOIN lo ON lo.key = cf.key GROUP BY ALL",
    "hit_links": f"WITH {_P}, {_ALL}, {_CONF} SELECT key, loser, winner FROM lo WHERE reason = ''",
    "asof_filter": f"WITH {_P}, k AS (SELECT chunk_id, max(as_of) AS d, max(coalesce(date_source, 'unknown')) AS s, bool_and(day > DATE '2023-01-01') AS late FROM a GROUP BY chunk_id) SELECT chunk_id FROM k WHERE s IN ('mtime', 'unknown') OR NOT (coalesce(d > DATE '2023-01-01', false) OR late)",
    "expired": f"WITH {_P} SELECT chunk_id FROM a GROUP BY chunk_id HAVING bool_and(coalesce(valid_until < DATE '2026-09-29', false))",
    "weak_entries": f"WITH {_P} SELECT entry_id, source FROM a WHERE start IS NULL OR source IN ('mtime', 'unknown')",
    "value_at": f"""WITH {_P}, {_CUT}, {_CONF}, ks AS (SELECT DISTINCT key, c.cutoff FROM a, (VALUES (DATE '2021-01-01'), (DATE '2023-01-01'), (DATE '2025-01-01')) c(cutoff)),
e AS (SELECT x.* FROM x LEFT JOIN cf ON cf.key = x.key AND cf.cutoff = x.cutoff WHERE start IS NOT NULL AND (cf.key IS NULL OR x.chunk_id = cf.winner) QUALIFY row_number() OVER (PARTITION BY x.key, x.cutoff ORDER BY start DESC, chunk_id DESC, entry_id DESC) = 1),
i AS (SELECT key, bool_or(start IS NULL OR source IN ('mtime', 'unknown')) AS anyweak FROM a GROUP BY key),
u AS (SELECT DISTINCT e.key, e.cutoff FROM e JOIN a ON a.key = e.key AND a.start IS NULL AND a.value <> e.value)
SELECT {_D('ks.cutoff')} AS cutoff, ks.key, chunk_id, value, CASE WHEN e.key IS NULL THEN CASE WHEN anyweak THEN 'unknown' ELSE 'none' END WHEN valid_until < ks.cutoff THEN 'expired' WHEN source IN ('mtime', 'unknown') OR u.key IS NOT NULL THEN 'uncertain' ELSE 'known' END AS status,
  CASE WHEN e.key IS NULL THEN 1 ELSE CAST(coalesce(cf.reason = '', true) AS INT) END AS resolved
FROM ks JOIN i ON i.key = ks.key LEFT JOIN e ON e.key = ks.key AND e.cutoff = ks.cutoff LEFT JOIN u ON u.key = ks.key AND u.cutoff = ks.cutoff LEFT JOIN cf ON cf.key = ks.key AND cf.cutoff = ks.cutoff""",
    "timeline": f"""WITH {_P}, l AS (SELECT *, lag(value) OVER o AS pv FROM a WINDOW o AS (PARTITION BY key ORDER BY start NULLS FIRST, chunk_id, entry_id)), k AS (SELECT * FROM l WHERE pv IS DISTINCT FROM value),
m AS (SELECT *, lead(start) OVER o AS ns, lead(entry_id) OVER o IS NULL AS final FROM k WINDOW o AS (PARTITION BY key ORDER BY start NULLS FIRST, chunk_id, entry_id)), c AS (SELECT *, valid_until IS NOT NULL AND (ns IS NULL OR valid_until < ns) AS cut FROM m)
SELECT key, raw AS value, {_D('start')} AS from_day, {_D('CASE WHEN cut THEN valid_until ELSE ns END')} AS to_day, CAST(NOT cut AND final AS INT) AS present FROM c""",
    "diff_window": f"""WITH {_P}, b AS (SELECT * FROM a WHERE start < DATE '2023-06-01' QUALIFY row_number() OVER (PARTITION BY key ORDER BY start DESC, chunk_id DESC, entry_id DESC) = 1),
i AS (SELECT * FROM a WHERE start BETWEEN DATE '2023-06-01' AND DATE '2024-06-01' QUALIFY row_number() OVER (PARTITION BY key ORDER BY start DESC, chunk_id DESC, entry_id DESC) = 1), u AS (SELECT key, count(*) FILTER (WHERE start IS NULL) AS undated FROM a GROUP BY key)
SELECT i.key, CASE WHEN b.key IS NULL THEN 'added' ELSE 'updated' END AS change, i.raw AS value, b.raw AS previous, {_D('i.start')} AS start, undated FROM i JOIN u ON u.key = i.key LEFT JOIN b ON b.key = i.key WHERE b.key IS NULL OR b.value <> i.value""",
    "key_overlap": f"WITH {_P}, {_OVER} SELECT qid, key, overlap FROM ko",
    "pick_fact": f"WITH {_P}, {_PICK} SELECT qid, key, chunk_id, CAST(overlap AS INT) AS overlap FROM pk",
    "explain_current": f"""WITH {_P}, {_ALL}, {_CONF}, {_PICK}, cu AS (SELECT qid, pk.key, a.value, a.raw, a.start, a.day, a.valid_until, cf.reason FROM pk LEFT JOIN cf ON cf.key = pk.key JOIN a ON a.key = pk.key AND a.chunk_id = coalesce(cf.winner, pk.chunk_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY a.day, entry_id) = 1)
SELECT qid, cu.key, cu.raw AS value, {_D('cu.start')} AS start, CASE WHEN cu.valid_until < DATE '2026-09-29' THEN 'expired' ELSE 'known' END AS status, CAST(coalesce(cu.reason = '', true) AS INT) AS resolved,
  CASE WHEN cu.reason IS NULL THEN 0 ELSE (SELECT count(*) FROM a WHERE a.key = cu.key AND a.value <> cu.value AND a.day <= cu.day) END AS n_superseded FROM cu""",
    "promote_one_level": """WITH h AS (SELECT chunk_id, ((chunk_id * 7919) % 100003) / 100003.0 AS score FROM (SELECT DISTINCT chunk_id FROM chunks)), k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS r FROM h QUALIFY r <= 15),
g AS (SELECT k.*, CASE WHEN chunk_id % 3 = 0 AND chunk_id + 1 IN (SELECT chunk_id FROM h) THEN chunk_id + 1 WHEN chunk_id % 3 = 1 THEN chunk_id ELSE chunk_id END AS head FROM k),
p AS (SELECT head, min(r) AS place FROM g GROUP BY head), m AS (SELECT head AS chunk_id, place, 0 AS lower FROM p UNION ALL SELECT chunk_id, place, 1 FROM g JOIN p USING (head) WHERE chunk_id <> head),
o AS (SELECT chunk_id, row_number() OVER (ORDER BY place, lower, chunk_id) AS rank FROM m)
SELECT 'f4' AS qid, rank, o.chunk_id, round(coalesce(k.score, 0), 6) AS score FROM o LEFT JOIN k USING (chunk_id) WHERE rank <= 5""",
    "value_norm": "WITH v AS (SELECT DISTINCT entry_id, " + _NORM.format(x=r"regexp_replace(regexp_extract(regexp_replace(value, '(?i)\s*(\[(?:verified:[^\]]*|volatile)\])\s*', ' ', 'g'), '^(?s:(.*?))(?:,\s|;|\s[-–—]\s|$)', 1), '\(.*?\)', ' ', 'g')") + " AS n FROM entries WHERE value IS NOT NULL) SELECT entry_id, array_to_string(" + _LIST.replace("{x}", "n", 1).replace("{and_}", "AND x NOT IN ('now', 'currently', 'still')") + ", ' ') AS form FROM v",
    "canonical_key": f"""WITH v AS (SELECT DISTINCT entry_id, {_LIST.replace('{x}', _NORM.format(x='label'), 1).replace('{and_}', f'AND x NOT IN ({texts._STOP})')} AS s, {_LIST.replace('{x}', _NORM.format(x="coalesce(entity, '')"), 1).replace('{and_}', f'AND x NOT IN ({texts._STOP})')} AS q FROM entries WHERE label IS NOT NULL),
t AS (SELECT entry_id, s, CASE WHEN len(q) > 0 AND NOT list_has_any(q, s) THEN list_concat(q, s) ELSE s END AS t FROM v) SELECT entry_id, array_to_string(list_sort(list_distinct(t)), ' ') AS key FROM t WHERE len(t) <= 8 AND len(s) > 0""",
    "stats": "WITH " + texts._DATED.replace(" m AS ", " mm AS ").replace("a AS (SELECT *, greatest", "ag AS (SELECT *, greatest").replace("AS must FROM a)", "AS must FROM ag)") + f", {_P}, {_ALL}, {_CONF} SELECT (SELECT count(*) FROM mm) AS chunks, (SELECT count(*) FROM mm WHERE must) AS must_reverify, (SELECT count(*) FROM f) AS files, (SELECT CAST(sum(n_bytes) AS BIGINT) FROM f) AS bytes, (SELECT count(*) FROM cf) AS conflicts",
    "md_roundtrip_headings": f"WITH {_CUST} SELECT path, count(*) AS sections, min({_D('o_orderdate')}) AS first_day, max({_D('o_orderdate')}) AS last_day FROM cu JOIN orders ON o_custkey = c_custkey GROUP BY path",
    "md_roundtrip_chunks": f"""WITH {_CUST}, o AS (SELECT path, c_name, o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY path ORDER BY o_orderkey) AS k FROM cu JOIN orders ON o_custkey = c_custkey)
SELECT path, CAST(6 AS INT) AS start_line, CAST(6 AS INT) AS end_line, 'item' AS kind, c_name AS heading_path, '- Segment: ' || c_mktsegment AS text, NULL AS verified, '' AS date_source FROM cu
UNION ALL SELECT path, CAST(6 + 4 * k AS INT), CAST(6 + 4 * k AS INT), 'item', c_name || ' > ' || {_D('o_orderdate')}, '- Order ' || o_orderkey || ' status: ' || o_orderstatus, {_D('o_orderdate')}, 'heading' FROM o""",
    "md_roundtrip_facts": f"""WITH {_CUST}, n AS (SELECT *, list_sort(list_distinct(list_concat(regexp_extract_all(lower(c_name), '[a-z0-9]+'), ['segment']))) AS k FROM cu)
SELECT path, array_to_string(k, ' ') AS key, lower(c_mktsegment) AS value, '2024-05-01' AS start, 'front-matter:updated' AS source FROM n
UNION ALL SELECT path, array_to_string(list_sort(['order', CAST(o_orderkey AS VARCHAR), 'status']), ' '), lower(o_orderstatus), {_D('o_orderdate')}, 'heading' FROM cu JOIN orders ON o_custkey = c_custkey""",
    "span_contains": "WITH c AS (SELECT DISTINCT chunk_id, path, start_line, end_line FROM chunks), m AS (SELECT path, CAST(floor((min(start_line) + max(end_line)) / 2.0) AS INT) AS line FROM c GROUP BY path) SELECT chunk_id, path, line FROM c JOIN m USING (path) WHERE line BETWEEN start_line AND end_line",
    "eval_metrics": "WITH" + _RANKED + " SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 3) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 3) AS r5, round(avg(coalesce(1.0 / rank, 0)), 3) AS mrr, round(avg(CASE WHEN stale THEN CASE WHEN coalesce(rank, 99) > 1 THEN 1.0 ELSE 0 END END), 3) AS stale_rate FROM rd GROUP BY GROUPING SETS ((category), ())",
    "latency_quantiles": "WITH" + _RANKED + ", s2 AS (SELECT category, list_sort(list(ms)) AS v FROM rd GROUP BY category) SELECT category, round(CAST(CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) / 2.0 END AS DOUBLE), 6) AS p50, CAST(v[least(len(v), CAST(floor(0.95 * len(v)) AS BIGINT) + 1)] AS DOUBLE) AS p95, CAST(v[least(len(v), CAST(floor(0.99 * len(v)) AS BIGINT) + 1)] AS DOUBLE) AS p99 FROM s2",
    "grade_outcome": "WITH" + _RANKED + " SELECT id, case_ AS \"case\", outcome FROM gr",
    "temporal_summary": "WITH" + _RANKED + ", z AS (SELECT *, CASE WHEN id % 10 < 3 THEN 'heldout' ELSE 'dev' END AS split FROM gr) SELECT split, coalesce(category, 'all') AS category, count(*) AS n, round(avg(CASE WHEN outcome = 'correct' THEN 1.0 ELSE 0 END), 3) AS accuracy, round(avg(CASE WHEN outcome = 'stale' THEN 1.0 ELSE 0 END), 3) AS stale_rate FROM z GROUP BY GROUPING SETS ((split, category), (split))",
    "failure_counts": "WITH" + _RANKED + " SELECT category, outcome, count(*) AS n FROM gr WHERE outcome <> 'correct' GROUP BY ALL",
}
