"""Ranked retrieval for tables of queries: postings, BM25, freshness rerank, promotion, fusion with vectors.

One job answers all queries. Query terms are joined to postings restricted to them; corpus figures come from the
whole corpus. Ranks use row_number with a limit, which Spark turns into a group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import stored

K1, B = 1.2, 0.75


def postings(tokens: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(chunk_id, term, tf) from a table with an array of tokens."""
    return tokens.select(F.col(id), F.explode("tokens").alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (n, avgdl); texts without tokens count in n."""
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def forward(tokens: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(chunk_id, dl, terms array<term, tf>): the forward index, one row a text, made without a shuffle; texts without tokens count.

    Sorted tokens are runs of equal terms, whose lengths are the term frequencies.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf")))), F.lit(0))

    ordered = F.array_sort(F.coalesce("tokens", F.array().cast("array<string>")))
    terms = F.get(F.transform(F.array(ordered), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))), F.lit(0))
    return tokens.select(F.col(id), F.coalesce(F.size("tokens"), F.lit(0)).alias("dl"), terms.alias("terms"))


def bm25(tokens: DataFrame, queries: DataFrame, id: str = "chunk_id") -> DataFrame:
    """bm25_of the forward index of a table with an array of tokens, which is written once."""
    return bm25_of(stored(forward(tokens, id)), queries, id)


def bm25_of(index: DataFrame, queries: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(qid, chunk_id, score) of every chunk that shares a term with a query. ``index``: see forward; ``queries``: qid, terms array.

    Repeated query terms count once; queries without terms, an empty corpus and one without tokens give no rows.
    """
    wanted = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    stats = index.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    hits = index.select(F.col(id), "dl", F.inline("terms")).join(wanted.select("term").distinct(), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(F.broadcast(stats)).join(df, "term").filter("avgdl > 0")
    scored = weighed.select(id, "term", (idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("w"))
    return scored.join(wanted, "term").groupBy("qid", id).agg(F.sum("w").alias("score"))


#: Postings at which a block of documents ends, rows of one sorted step, and the part of a block, if not fewer than so many texts, that makes a term common.
BLOCK, STEP, COMMON, LEAST = 4_000_000, 2_000_000, 128, 16


def _posting_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, dl, terms) as rows: ids in order, their dl, the words, and for each word in turn its documents' places and tf."""
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32())

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, dl = table.column(0).to_numpy(), table.column(1).to_numpy()
        lists = table.column(2).combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
        coded = flat.field("term").dictionary_encode()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        by_word = np.argsort(codes, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary))))
        values = (ids[order], dl[order], coded.dictionary, starts, np.repeat(place, sizes)[by_word], flat.field("tf").to_numpy(zero_copy_only=False)[by_word])
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, kind)) for v, kind in zip(values, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["ids", "dls", "words", "starts", "places", "tfs"])

    parts, held = [], 0
    for batch in batches:
        if batch.num_rows:
            parts, held = [*parts, batch], held + len(batch.column(2).flatten())
        if held >= BLOCK:
            yield block(parts)
            parts, held = [], 0
    if parts:
        yield block(parts)


def _first(values: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest are, largest first, the earlier of equal ones first."""
    if len(values) > k:
        among = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
        return among[np.argsort(-values[among], kind="stable")[:k]]
    return np.argsort(-values, kind="stable")


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each of several spans, one span after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _best_in_block(r: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question's place, document's id, score) of the k best documents of a block for each of a block of questions.

    Questions that have the same common terms share the scores of these, of which the k best documents will do: whatever
    comes after them is beaten unless it has a rare term, and documents with one are scored all.
    """
    n_docs, dl = len(r["ids"]), r["dls"]
    vocabulary = r["asked"].dictionary_encode()
    at = pa.compute.index_in(vocabulary.dictionary, r["words"]).to_numpy(zero_copy_only=False)
    there = ~np.isnan(at)
    at = np.where(there, at, 0).astype(np.int64)
    begin, size = np.where(there, r["starts"][at], 0), np.where(there, np.diff(r["starts"])[at], 0)
    weight = r["tfs"] * (K1 + 1) / (r["tfs"] + K1 * (1 - B + B * dl[r["places"]] / r["avgdl"]))
    term, of = vocabulary.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(r["lengths"])), r["lengths"])
    idf_of = np.zeros(len(size))
    idf_of[term] = r["idfs"]
    term, of = term[size[term] > 0], of[size[term] > 0]
    common = size[term] > max(n_docs // COMMON, LEAST)
    order = np.lexsort((term[common], of[common]))
    shared: dict[bytes, list[int]] = {}
    owners, first = np.unique(of[common][order], return_index=True)
    ends, of_common = np.append(first, len(order))[1:], term[common][order]
    for q, a, b in zip(owners.tolist(), first.tolist(), ends.tolist()):
        shared.setdefault(of_common[a:b].tobytes(), []).append(q)
    rare_of, rare = of[~common], term[~common]  # in order of questions
    shared[b""] = np.setdiff1d(np.unique(rare_of), owners).tolist()
    bounds = np.searchsorted(rare_of, np.arange(len(r["lengths"]) + 1))
    weights_until = np.append(0, np.cumsum(size[rare]))
    found = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]
    for key, group in shared.items():
        score, top = np.zeros(n_docs), np.array([], np.int64)
        for t in np.frombuffer(key, np.int64):
            span = slice(begin[t], begin[t] + size[t])
            score[r["places"][span]] += weight[span] * idf_of[t]
        if key:
            hit = np.flatnonzero(score)
            top = hit[_first(np.round(score[hit], 9), k)]
        qs = np.array(group, np.int64)
        rows = weights_until[bounds[qs + 1]] - weights_until[bounds[qs]] + len(top)
        for step in np.split(np.arange(len(qs)), np.flatnonzero(np.diff(np.cumsum(rows) // STEP)) + 1):
            mine = qs[step]
            n_rare = bounds[mine + 1] - bounds[mine]
            entries = _spans(bounds[mine], n_rare)
            t, sizes = rare[entries], size[rare[entries]]
            posting = _spans(begin[t], sizes)
            asker = np.append(np.repeat(np.repeat(np.arange(len(mine)), n_rare), sizes), np.repeat(np.arange(len(mine)), len(top)))
            doc = np.append(r["places"][posting], np.tile(top, len(mine))).astype(np.int64)
            part = np.append(weight[posting] * np.repeat(idf_of[t], sizes), np.zeros(len(mine) * len(top)))
            pair, which = np.unique(asker * n_docs + doc, return_inverse=True)
            asker, doc = np.divmod(pair, n_docs)
            total = np.bincount(which, part, len(pair)) + score[doc]
            ranked = np.lexsort((doc, -np.round(total, 9), asker))
            asker = asker[ranked]
            keep = ranked[np.arange(len(asker)) - np.searchsorted(asker, asker) < k]
            found.append((mine[pair[keep] // n_docs], r["ids"][doc[keep]], total[keep]))
    return tuple(map(np.concatenate, zip(*found)))


def _best_of_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = {n: c[i].values for n, c in zip(batch.schema.names, batch.columns) if pa.types.is_list(c.type)}
                r = {n: v if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False) for n, v in values.items()} | {"avgdl": batch.column("avgdl")[i].as_py()}
                asker, ids, scores = _best_in_block(r, k)
                yield pa.RecordBatch.from_arrays([r["qids"].take(pa.array(asker)), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["qid", "chunk_id", "score"])

    return run


def bm25_best(index: DataFrame, queries: DataFrame, k: int, id: str = "chunk_id", block: int = 250_000, among: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the first k of bm25_of for each query, for tables of very many queries.

    Blocks of queries meet blocks of the index, and each pair gives k rows a query, so that what is moved grows with the
    queries and not with the pairs of query and text. ``queries``: qid string, terms array; ``among`` (a table of ids): only
    these texts are ranked, while corpus figures stay those of the whole corpus.
    """
    wanted = queries.select(F.col("qid").cast("string").alias("qid"), F.explode(F.array_distinct("terms")).alias("term")).filter("qid is not null")
    stats = index.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    df = index.select(F.inline("terms")).groupBy("term").agg(F.count("*").alias("df"))
    asked = wanted.join(df, "term").crossJoin(F.broadcast(stats)).filter("avgdl > 0").groupBy("qid", "avgdl").agg(F.collect_list(F.struct("term", idf(F.col("n"), F.col("df")).alias("idf"))).alias("t"))
    asked = stored(asked)
    blocks = -(-asked.count() // block) or 1
    lists = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("b"), "avgdl").agg(F.collect_list(F.struct("qid", "t")).alias("q"))
    flat = F.flatten(F.col("q.t"))
    lists = lists.select("avgdl", F.col("q.qid").alias("qids"), F.transform("q", lambda x: F.size(x["t"])).alias("lengths"), flat["term"].alias("asked"), flat["idf"].alias("idfs"))
    ranked = index if among is None else index.join(among, id, "left_semi")
    packs = ranked.filter(F.size("terms") > 0).select(F.col(id).cast("bigint"), F.col("dl").cast("int"), "terms").mapInArrow(_posting_blocks, "ids array<bigint>, dls array<int>, words array<string>, starts array<bigint>, places array<int>, tfs array<int>")
    return top_k(packs.crossJoin(lists).mapInArrow(_best_of_blocks(k), "qid string, chunk_id bigint, score double"), k)


def top_k(scores: DataFrame, k: int | Column, id: str = "chunk_id", digits: int = 9) -> DataFrame:
    """scores with their rank in each query, best first, ties by id; scores are compared as rounded."""
    w = W.partitionBy("qid").orderBy(F.round("score", digits).desc(), id)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank_scores(candidates: DataFrame, *, weight: float = 0.25, penalty: float = 0.6) -> DataFrame:
    """candidates (qid, chunk_id, score, decay, superseded, expired) with the score decayed by age and penalised once."""
    aged = F.col("score") * ((1 - weight) + weight * F.col("decay"))
    return candidates.withColumn("score", F.when(F.col("superseded") | F.col("expired"), aged * penalty).otherwise(aged))


PROMOTED = "qid string, chunk_id bigint, score double, rank int"


def _promote(frames: pd.DataFrame) -> pd.DataFrame:
    """Orders one query's window by a key for each chunk: what brought it in, then its path below that.

    A hit that has no key yet brings in its superseding chunks, in order of their facts, and then itself. A chunk below
    another one has the other's key and its own turn among the chunks superseded by it, and the least key counts.
    """
    hits, links = frames[frames["kind"] == "hit"].sort_values("rank"), frames[frames["kind"] == "link"].sort_values(["key", "chunk_id"])
    scores = dict(zip(hits["chunk_id"], hits["score"]))
    winners, beaten = links.groupby("chunk_id")["winner"].agg(list).to_dict(), links[links["chunk_id"].isin(scores)].groupby("winner")["chunk_id"].agg(list).to_dict()
    key: dict[int, tuple] = {}
    for place, hit in enumerate(hits["chunk_id"]):
        if hit in key:
            continue
        front = [((place, turn), root) for turn, root in enumerate([*winners.get(hit, []), hit]) if root not in key]
        while front:
            reached: dict[int, tuple] = {}
            for path, chunk in front:
                if path < key.get(chunk, (place + 1,)) and path < reached.get(chunk, (place + 1,)):
                    reached[chunk] = path
            key |= reached
            front = [((*path, turn), below) for chunk, path in reached.items() for turn, below in enumerate(beaten.get(chunk, []))]
    out = sorted(key, key=key.__getitem__)
    return pd.DataFrame({"qid": frames["qid"].iloc[0], "chunk_id": out, "score": [scores.get(i, 0.0) for i in out], "rank": range(1, len(out) + 1)})


def promote(reranked: DataFrame, links: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best of each query after promotion.

    ``reranked``: qid, chunk_id, score; ``links``: loser, winner, key (resolved supersessions); ``queries``: qid, terms.
    Only the first max(3k, k + 5) hits of a query are rearranged, so what a task sees of one query is bounded. A link
    applies when its key shares a word with the query; a superseding chunk that was not retrieved enters with score 0.
    """
    window = top_k(reranked, max(3 * k, k + 5))
    topical = F.arrays_overlap(F.split("key", " "), F.col("terms"))
    near = window.join(links, window.chunk_id == links.loser).select("qid", window.chunk_id, "winner", "key")
    back = window.join(links, window.chunk_id == links.winner).select("qid", F.col("loser").alias("chunk_id"), F.col("winner"), "key")
    # Losers enter only if retrieved; winners of retrieved losers may also supersede other retrieved chunks.
    wins = near.select("qid", F.col("winner").alias("w")).distinct()
    more = wins.join(links, wins.w == links.winner).select("qid", F.col("loser").alias("chunk_id"), "winner", "key")
    within = window.select("qid", "chunk_id")
    edges = near.unionByName(back.unionByName(more).join(within, ["qid", "chunk_id"], "left_semi")).distinct()
    edges = edges.join(queries.select("qid", "terms"), "qid").filter(topical)
    rows = window.select("qid", F.lit("hit").alias("kind"), "chunk_id", "score", "rank", F.lit(None).cast("bigint").alias("winner"), F.lit(None).cast("string").alias("key")).unionByName(
        edges.select("qid", F.lit("link").alias("kind"), "chunk_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), "winner", "key")
    )
    return rows.groupBy("qid").applyInPandas(_promote, PROMOTED).filter(F.col("rank") <= k)


def unit(vec: Column) -> Column:
    """A vector of length one; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    """The inner product, as far as the shorter vector goes."""
    return F.aggregate(F.filter(F.zip_with(a, b, lambda x, y: x * y), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of (id, vec) as one row: ids, all numbers, and where each vector begins."""
    for batch in batches:
        vecs = batch.column(1)
        starts = np.append(0, np.cumsum(vecs.value_lengths().to_numpy(zero_copy_only=False)))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([one(batch.column(0).to_pylist(), pa.int64()), one(vecs.flatten().to_numpy(zero_copy_only=False), pa.float64()), one(starts, pa.int64())], ["ids", "flat", "starts"])


def _units(flat: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Vectors as rows of length one, short ones filled up with zeros; the zero vector stays."""
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                r = {n: c[i].values.to_pylist() if n == "qids" else c[i].values.to_numpy(zero_copy_only=False) for n, c in zip(names, batch.columns)}
                width = int(max(np.diff(r["starts"]).max(), np.diff(r["asked_starts"]).max()))
                sims = _units(r["asked_flat"], r["asked_starts"], width) @ _units(r["flat"], r["starts"], width).T
                ids = r["ids"]
                order = np.argsort(ids, kind="stable")  # among equal scores the smaller ids come first
                ids, sims = ids[order], sims[:, order]
                best = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(r["qids"], object), best.shape[1]), pa.string()), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(sims, best, 1).ravel())], ["qid", "chunk_id", "score"]
                )

    return run


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id: str, vec: str, block: int = 1000) -> DataFrame:
    """(qid, chunk_id, score, rank): the k nearest vectors of each stated query, blocks of queries against blocks of rows.

    One plan for any number of queries, which never pass through the driver: rows are packed where they are read, queries
    into blocks of about ``block`` by hash, and every pair of blocks gives k rows a query. Null vectors take no part.
    ``queries``: qid string, vec.
    """
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and qid is not null")
    blocks = -(-asked.count() // block) or 1
    lists = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("qid", "vec")).alias("q"))
    starts = F.aggregate("q", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x["vec"]))))
    lists = lists.select(F.transform("q", lambda x: x["qid"]).alias("qids"), F.flatten(F.transform("q", lambda x: x["vec"])).alias("asked_flat"), starts.alias("asked_starts"))
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("vec is not null and id is not null")
    packs = rows.mapInArrow(_packed, "ids array<bigint>, flat array<double>, starts array<bigint>")
    return top_k(packs.crossJoin(lists).mapInArrow(_nearest(k), "qid string, chunk_id bigint, score double"), k)


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(qid, chunk_id, score): reciprocal-rank fusion of tables with qid, chunk_id and rank."""
    bag = rankings[0].select("qid", "chunk_id", "rank")
    for r in rankings[1:]:
        bag = bag.unionByName(r.select("qid", "chunk_id", "rank"))
    return bag.groupBy("qid", "chunk_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))
