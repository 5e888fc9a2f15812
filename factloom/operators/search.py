"""Search over an index of notes for tables of questions: scoring, as-of filter, rerank, promotion, explanation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import freshness as fr
from factloom.functions.text import stem_all_udf, with_tokens
from factloom.operators import facts, notes, retrieval
from factloom.session import cut

NONE_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def index_tables(texts: DataFrame, stem: bool = True, by_phrase: bool = True) -> dict[str, DataFrame]:
    """docs, chunks (dated), postings (the forward index) and assertions of a table of notes (path, text, mtime), written once."""
    docs, chunks = notes.parse_notes(texts)
    docs = cut(docs)
    dated = cut(notes.dated(cut(chunks), docs, by_phrase))
    return {"docs": docs, "chunks": dated, "postings": cut(retrieval.forward(with_index_tokens(dated, stem))), "assertions": cut(notes.assertions_of(dated, stem))}


def merged_tables(old: dict[str, DataFrame], new: dict[str, DataFrame], same: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index from what it had of the files in ``same`` (path) and the tables of all others; chunks are numbered anew."""
    kept = lambda name: old[name].join(same, "path", "left_semi")
    tagged = lambda df, of: df.withColumn("chunk_id", F.struct(F.lit(of).alias("of"), F.col("chunk_id").alias("n")))
    chunks = tagged(kept("chunks"), 0).unionByName(tagged(new["chunks"], 1)).withColumnRenamed("chunk_id", "was")
    chunks = cut(notes.with_ids(chunks))
    number = chunks.select(F.col("was").alias("chunk_id"), F.col("chunk_id").alias("now"))
    renumbered = lambda df: df.join(number, "chunk_id").drop("chunk_id").withColumnRenamed("now", "chunk_id").select(df.columns)
    return {
        "docs": cut(kept("docs").unionByName(new["docs"])), "chunks": chunks.drop("was"),
        "postings": cut(renumbered(tagged(old["postings"], 0).unionByName(tagged(new["postings"], 1)))),
        "assertions": cut(renumbered(tagged(kept("assertions"), 0).unionByName(tagged(new["assertions"], 1)))),
    }


def postings_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The forward index of a set of tables: that of the saved index, or one made of the chunks' tokens."""
    if "postings" not in tables:
        tables["postings"] = cut(retrieval.forward(tables["chunks"]))
    return tables["postings"]


def links_of(tables: dict[str, DataFrame], as_of: date | None = None) -> DataFrame:
    """(loser, winner, key) of the facts known by a day, worked out once for a set of tables."""
    name = f"links {as_of}"
    if name not in tables:
        tables[name] = cut(facts.links(tables["assertions"], [as_of]).select("loser", "winner", "key"))
    return tables[name]


#: How many superseded chunks a hit or conflict lists; their number is given, and ``facts.losers`` has all of them.
MOST_LISTED = 1000


def listed(rows: DataFrame, by: list[str], item, order: list[str], out: str) -> DataFrame:
    """(<by>, n_<out>, <out> array): the first MOST_LISTED rows of each group in order, and how many there are."""
    w = W.partitionBy(*by).orderBy(*order)
    first = rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= MOST_LISTED).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", item.alias("_item")))), lambda x: x["_item"]).alias(out))
    return first.join(rows.groupBy(*by).agg(F.count("*").alias(f"n_{out}")), by)


def with_provenance(found: DataFrame, tables: dict[str, DataFrame], as_of: date | None = None) -> DataFrame:
    """Hits with facts (array), keys, superseded_by (cites), n_supersedes, supersedes (cites) and expired.

    A chunk has as many facts as lines, and one superseding chunk for each fact.
    """
    found = cut(found)
    mine = found.select("chunk_id").distinct()
    rows = tables["assertions"].join(mine, "chunk_id", "left_semi")
    fact = F.struct("key", "label", notes.display_value(F.col("raw_value")).alias("value"), "start", "source", "authority", F.col("origin"), "valid_from", "valid_until")
    own = rows.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", fact.alias("f")))), lambda x: x["f"]).alias("facts"), F.array_sort(F.collect_set("key")).alias("keys"))
    cites = tables["chunks"].select(F.col("chunk_id").alias("_other"), F.concat_ws(":", "path", "start_line").alias("_cite"))
    links = links_of(tables, as_of)
    up = links.join(mine, F.col("loser") == F.col("chunk_id"), "left_semi").select(F.col("loser").alias("chunk_id"), F.col("winner").alias("_other")).distinct().join(cites, "_other")
    down = links.join(mine, F.col("winner") == F.col("chunk_id"), "left_semi").select(F.col("winner").alias("chunk_id"), F.col("loser").alias("_other")).distinct().join(cites, "_other")
    out = found.join(own, "chunk_id", "left").join(up.groupBy("chunk_id").agg(F.array_sort(F.collect_set("_cite")).alias("superseded_by")), "chunk_id", "left")
    out = out.join(listed(down, ["chunk_id"], F.col("_cite"), ["_other"], "supersedes"), "chunk_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"keys": F.coalesce("keys", none), "superseded_by": F.coalesce("superseded_by", none), "supersedes": F.coalesce("supersedes", none), "n_supersedes": F.coalesce("n_supersedes", F.lit(0))})


def conflict_report(assertions: DataFrame) -> DataFrame:
    """Conflicts with n_losers, losers (chunk ids) and values (chunk id to the last value as written there)."""
    found = facts.conflicts(assertions).drop("cutoff")
    beaten = facts.losers(assertions, facts.conflicts(assertions)).select("key", "loser").distinct()
    said = assertions.join(found.select("key"), "key", "left_semi").groupBy("key", "chunk_id").agg(F.max_by("raw_value", "ord").alias("raw"))
    values = listed(said, ["key"], F.struct("chunk_id", "raw"), ["chunk_id"], "values").select("key", F.map_from_entries("values").alias("values"))
    out = found.join(listed(beaten, ["key"], F.col("loser"), ["loser"], "losers"), "key", "left").join(values, "key", "left")
    return out.withColumns({"n_losers": F.coalesce("n_losers", F.lit(0)), "losers": F.coalesce("losers", F.array().cast("array<bigint>"))})


def with_index_tokens(chunks: DataFrame, stem: bool = True) -> DataFrame:
    """chunks (text, heading_path) with tokens: the words of the text, then once each those that only its headings have."""
    tok = with_tokens(chunks, "text", "own")
    tok = with_tokens(tok.withColumn("heads", F.array_join("heading_path", " ")), "heads", "above")
    if stem:
        tok = tok.withColumn("own", stem_all_udf("own")).withColumn("above", stem_all_udf("above"))
    return tok.withColumn("tokens", F.concat("own", F.array_sort(F.array_except(F.array_distinct("above"), "own")))).drop("own", "above", "heads")


def asked(spark: SparkSession, questions: dict[str, str], as_of: date | None = None, stem: bool = True) -> DataFrame:
    """(qid, query, terms); an as-of date in a question is a filter, not words to match."""
    rows = [(q, t.replace(as_of.isoformat(), " ") if as_of else t) for q, t in questions.items()]
    df = with_tokens(spark.createDataFrame(rows, "qid string, query string"), "query", "terms")
    return df.withColumn("terms", stem_all_udf("terms")) if stem else df


def chunk_facts(assertions: DataFrame) -> DataFrame:
    """The starts and ends of each chunk's facts, of which it has as many as lines."""
    return assertions.groupBy("chunk_id").agg(F.collect_list(F.coalesce("start", F.to_date(F.lit(NONE_DAY)))).alias("starts"), F.collect_list(F.coalesce("valid_until", F.to_date(F.lit(LAST_DAY)))).alias("untils"))


def search(tables: dict[str, DataFrame], queries: DataFrame, *, k: int = 5, now: date, mode: str = "full", as_of: date | None = None, scores: DataFrame | None = None, cfg: fr.Windows = fr.Windows()) -> DataFrame:
    """(qid, rank, chunk_id, cite, score, status, age, as_of, date_source, volatile, must_reverify, ...), k rows a question.

    ``scores`` (qid, chunk_id, score) replaces BM25 as the first stage. With ``as_of``, chunks known to be written or to
    take effect later are left out, supersession counts facts in effect by then, and ages are measured from then; corpus
    figures stay those of the whole corpus. Mode ranked leaves out promotion, bm25 all but the first stage. Columns heading_path and text are given where the table of chunks has them.
    """
    if mode not in ("full", "ranked", "bm25"):
        raise ValueError(f"unknown mode {mode!r}")
    when = as_of or now
    arrays = lambda c: F.coalesce(c, F.expr("array()").cast("array<date>"))
    chunks = tables["chunks"].join(chunk_facts(tables["assertions"]), "chunk_id", "left").withColumns({"starts": arrays(F.col("starts")), "untils": arrays(F.col("untils"))})
    age = fr.age_days(F.col("effective_date"), F.lit(when))
    must = fr.must_reverify(age, F.col("is_volatile"), cfg)
    long = [c for c in ("heading_path", "text") if c in tables["chunks"].columns]
    state = chunks.select(
        "chunk_id", F.concat_ws(":", "path", "start_line").alias("cite"), "path", "start_line", "end_line", *long, "effective_date", "effective_source", "is_volatile", "starts",
        age.alias("age"), must.alias("must"), fr.status(age, must, cfg).alias("fresh"), fr.decay(age, cfg).alias("decay"), facts.expired_at(F.col("untils"), F.lit(when)).alias("expired"),
    )
    raw = scores if scores is not None else retrieval.bm25_of(postings_of(tables), queries)
    if as_of is not None:
        alive = state.filter(facts.exists_at(F.col("effective_date"), F.col("effective_source"), F.col("starts"), F.lit(as_of))).select("chunk_id")
        raw = raw.join(alive, "chunk_id", "left_semi")
    if mode == "bm25":
        best = retrieval.top_k(raw, k).select("qid", "rank", "chunk_id", "score")
        shown = best.join(state, "chunk_id").withColumn("status", F.lit("UNKNOWN")).withColumn("must", F.lit(False)).withColumn("age", F.lit(None).cast("int"))
    else:
        links = links_of(tables, as_of)
        beaten = links.select(F.col("loser").alias("chunk_id"), F.lit(True).alias("superseded")).distinct()
        rows = raw.join(state.select("chunk_id", "decay", "expired"), "chunk_id").join(beaten, "chunk_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
        scored = retrieval.rerank_scores(rows)
        placed = retrieval.promote(scored, links, queries, k) if mode == "full" else retrieval.top_k(scored, k).select("qid", "chunk_id", "score", "rank")
        status = F.when(F.coalesce("superseded", F.lit(False)), "SUPERSEDED").when(F.col("expired"), "EXPIRED").otherwise(F.col("fresh"))
        shown = placed.join(state, "chunk_id").join(beaten, "chunk_id", "left").withColumn("status", status)
    return shown.select(
        "qid", "rank", "chunk_id", "cite", "path", "start_line", "end_line", *long, "score", "status", "age", F.col("effective_date").alias("as_of"), F.col("effective_source").alias("date_source"),
        F.col("is_volatile").alias("volatile"), F.col("must").alias("must_reverify"), "expired",
        fr.note(F.col("age"), F.col("effective_date"), F.col("effective_source"), F.col("fresh"), F.col("must")).alias("freshness"),
    )


def hybrid_scores(tables: dict[str, DataFrame], queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, *, depth: int = 50, as_of: date | None = None) -> DataFrame:
    """First-stage scores by reciprocal-rank fusion of the best ``depth`` by BM25 and by vectors (chunk_id, vec / qid, vec)."""
    alive = None
    if as_of is not None:
        arrays = F.coalesce("starts", F.expr("array()").cast("array<date>"))
        chunks = tables["chunks"].join(chunk_facts(tables["assertions"]), "chunk_id", "left")
        alive = chunks.filter(facts.exists_at(F.col("effective_date"), F.col("effective_source"), arrays, F.lit(as_of))).select("chunk_id")
        vectors = vectors.join(alive, "chunk_id", "left_semi")
    dense = retrieval.cosine_top_k(vectors, query_vectors, depth, id="chunk_id", vec="vec")
    return retrieval.fuse([retrieval.bm25_best(postings_of(tables), queries, depth, among=alive), dense])


def stale(tables: dict[str, DataFrame], now: date, cfg: fr.Windows = fr.Windows()) -> DataFrame:
    """Chunks to check again, oldest first: (cite, text, age, as_of, date_source)."""
    age = fr.age_days(F.col("effective_date"), F.lit(now))
    rows = tables["chunks"].withColumn("age", age).filter(fr.must_reverify(age, F.col("is_volatile"), cfg))
    return rows.select(F.concat_ws(":", "path", "start_line").alias("cite"), "text", "age", F.col("effective_date").alias("as_of"), F.col("effective_source").alias("date_source")).orderBy(F.coalesce("age", F.lit(0)).desc(), "cite")


def explain(tables: dict[str, DataFrame], questions: dict[str, str], *, now: date, as_of: date | None = None, stem: bool = True, hits: DataFrame | None = None, cfg: fr.Windows = fr.Windows()) -> DataFrame:
    """One row a question: qid, no_match, no_fact, nearest, key, label, status, resolved, reason, current, superseded, changed_after, timeline, freshness.

    The fact is the one picked among ten hits; lists hold the entries of that one fact. Without a hit as of the date the
    search is repeated without it, so that the answer can say that nothing was recorded yet.
    """
    spark, rows = tables["chunks"].sparkSession, tables["assertions"]
    queries = asked(spark, questions, as_of, stem)
    found = search(tables, queries, k=10, now=now, as_of=as_of) if hits is None else hits
    found = cut(found.select("qid", "rank", "chunk_id", "cite"))
    if as_of is not None:
        plain = search(tables, queries, k=10, now=now).select("qid", "rank", "chunk_id", "cite")
        found = cut(found.unionByName(plain.join(found.select("qid").distinct(), "qid", "left_anti")))
    near = found.groupBy("qid").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "cite"))), 1, 3), lambda x: x["cite"]).alias("nearest"))
    picked = facts.pick_fact(found, rows, queries).select("qid", "key", F.col("chunk_id").alias("top"))
    ref = as_of or now
    day = F.coalesce("start", F.to_date(F.lit(NONE_DAY)))
    own = picked.select("qid", "key", "top").join(rows, "key").withColumn("d", day)
    clash = facts.conflicts(rows, [as_of]).select("key", "winner", "resolved", "reason")
    own = own.join(clash, "key", "left")
    item = F.struct("d", "chunk_id", "ord", "value", "raw_value", "cite", "start", "source", "authority", "origin", "valid_from", "valid_until", "label")
    target = F.coalesce("winner", "top")
    if as_of is None:
        cur = F.min(F.when(F.col("chunk_id") == target, item))
    else:
        inside = F.col("start").isNotNull() & (F.col("start") <= F.lit(as_of))
        cur = F.max(F.when(inside & (F.col("winner").isNull() | (F.col("chunk_id") == F.col("winner"))), item))
    undated = F.when(F.col("start").isNull(), F.col("value"))
    per = own.groupBy("qid", "key").agg(
        cur.alias("cur"), F.array_sort(F.collect_list(item)).alias("items"), F.max("resolved").alias("resolved"), F.max("reason").alias("reason"), F.bool_or(facts.weak(F.col("start"), F.col("source"))).alias("any_weak"), F.min(undated).alias("u0"), F.max(undated).alias("u1"),
    )
    entry = lambda x: F.struct(
        notes.display_value(x["raw_value"]).alias("value"), x["cite"].alias("cite"), x["start"].alias("as_of"), x["source"].alias("date_source"), x["authority"].alias("authority"), x["origin"].alias("source"), x["valid_from"].alias("valid_from"), x["valid_until"].alias("valid_until"),
    )
    c, items = F.col("cur"), F.col("items")
    older = F.filter(items, lambda x: (x["value"] != c["value"]) & (x["d"] <= c["d"]))
    later = F.filter(items, lambda x: (x["value"] != c["value"]) & (x["start"] > F.lit(ref)))
    spans = F.filter(items, lambda x, i: (i == 0) | (F.get(items, i - 1)["value"] != x["value"]))
    runs = F.when(c.isNull() | F.col("resolved").isNotNull() | (F.size(later) > 0), spans).otherwise(F.array(c))
    per = per.withColumn("runs", runs)
    line = F.transform("runs", lambda x, i: F.struct(x.alias("x"), F.get("runs", i + 1)["start"].alias("nxt"), (i == F.size("runs") - 1).alias("final")))
    early = lambda y: y["x"]["valid_until"].isNotNull() & (y["nxt"].isNull() | (y["x"]["valid_until"] < y["nxt"]))
    line = F.transform(line, lambda y: F.struct(notes.display_value(y["x"]["raw_value"]).alias("value"), y["x"]["start"].alias("from"), F.when(early(y), y["x"]["valid_until"]).otherwise(y["nxt"]).alias("to"), (~early(y) & y["final"]).alias("present")))
    expired = c["valid_until"] < F.lit(ref)
    if as_of is None:
        status = F.when(expired, "expired").otherwise("known")
    else:
        shaky = facts.weak(c["start"], c["source"]) | F.coalesce((F.col("u0") != c["value"]) | (F.col("u1") != c["value"]), F.lit(False))
        status = F.when(c.isNull(), F.when(F.col("any_weak"), "unknown").otherwise("none")).when(expired, "expired").when(shaky, "uncertain").otherwise("known")
    none = F.expr("array()")
    told = per.select(
        "qid", "key", F.coalesce(c["label"], F.element_at(items, -1)["label"]).alias("label"), status.alias("status"), F.when(c.isNotNull(), F.coalesce("resolved", F.lit(True))).alias("resolved"),
        F.when(~F.col("resolved"), F.col("reason")).alias("unresolved_reason"), F.when(c.isNotNull(), entry(c)).alias("current"), F.when(F.col("resolved").isNotNull(), F.reverse(F.transform(older, entry))).alias("superseded"),
        (F.transform(later, entry) if as_of is not None else none).alias("changed_after"), line.alias("timeline"), c["chunk_id"].alias("at"),
    )
    age = fr.age_days(F.col("effective_date"), F.lit(ref))
    must = fr.must_reverify(age, F.col("is_volatile"), cfg)
    fresh = tables["chunks"].select(F.col("chunk_id").alias("at"), F.struct(fr.status(age, must, cfg).alias("status"), age.alias("age_days"), F.col("effective_date").alias("as_of"), F.col("is_volatile").alias("volatile"), must.alias("must_reverify")).alias("freshness"))
    out = queries.select("qid", "query").join(near, "qid", "left").join(told, "qid", "left").join(fresh, "at", "left").drop("at")
    return out.withColumn("no_match", F.col("nearest").isNull()).withColumn("no_fact", F.col("nearest").isNotNull() & F.col("key").isNull())
