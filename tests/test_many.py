"""Searches for as many questions as there are texts: exact, and without a row for each pair of question and text."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import retrieval
from factloom.plans import facts, search, texts


def shuffled(spark, run) -> int:
    """Rows that the stages of a run wrote for others."""
    sc = spark.sparkContext
    tracker, before = sc._jsc.sc().statusStore(), set()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = tracker.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s := found.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(found.size())}

    before = set(stages())
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """600 notes whose titles share their words, each with a word of its own; every one is labelled."""
    d = str(tmp_path_factory.mktemp("alike"))
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.expr("concat('weekly notes canopy number', id, ' ', repeat('words ', cast(id % 7 as int)))").alias("text"), F.lit("canopy").alias("entity"), F.concat(F.lit("weekly notes number"), "id").alias("title"),
        F.lit(50).cast("long").alias("n_chars"), F.lit("a.md").alias("path"), F.to_date(F.lit("2024-01-01")).alias("updated"),
    )
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding")).coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    spark.range(600).select(F.col("id").alias("doc_id"), F.lit("law").alias("subject"), F.lit("r1").alias("rater")).coalesce(1).write.parquet(f"{d}/doc_labels.parquet")
    return d


@pytest.fixture(scope="module")
def mixed(spark):
    """Texts and questions over words of every frequency, and the five best of each question by bm25_of."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 40}" for _ in range(5000)]
    rows = [(i * 7 % 211, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(211)]
    asked = [(f"q{i}", [rng.choice([*words, "nowhere"]) for _ in range(rng.randint(0, 5))]) for i in range(150)]
    index = retrieval.forward(spark.createDataFrame(rows, "chunk_id bigint, tokens array<string>").repartition(3))
    queries = spark.createDataFrame(asked, "qid string, terms array<string>")
    return index, queries, {(r.qid, r.rank, r.chunk_id): r.score for r in retrieval.top_k(retrieval.bm25_of(index, queries), 5).collect()}


def test_blocks_give_what_pairs_give(mixed):
    index, queries, want = mixed
    got = {(r.qid, r.rank, r.chunk_id): r.score for r in retrieval.bm25_best(index, queries, 5, block=40).collect()}
    assert got == pytest.approx(want, abs=1e-9) and want


@pytest.mark.parametrize("block, step, common", [(60, 40, 2), (300, 1, 1), (100, 10**9, 10**9), (10**9, 50, 16)])
def test_any_cut_into_blocks_gives_the_same(mixed, monkeypatch, block, step, common):
    index, queries, want = mixed
    for name, value in {"BLOCK": block, "STEP": step, "COMMON": common, "LEAST": 1}.items():
        monkeypatch.setattr(retrieval, name, value)
    rows = index.collect()
    n, avgdl = len(rows), sum(r.dl for r in rows) / len(rows)
    df = Counter(t.term for r in rows for t in r.terms)
    asked = [(r.qid, [t for t in dict.fromkeys(r.terms) if t in df]) for r in queries.collect()]
    flat = [t for _, ts in asked for t in ts]
    q = {"asked": pa.array(flat), "idfs": np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in flat]), "lengths": np.array([len(ts) for _, ts in asked]), "avgdl": avgdl}
    found, blocks = defaultdict(list), 0
    for b in retrieval._posting_blocks(iter(index.toArrow().to_batches(max_chunksize=20))):
        values = {name: b.column(name)[0].values for name in b.schema.names}
        r = {name: v if pa.types.is_string(v.type) else v.to_numpy() for name, v in values.items()} | q
        blocks += 1
        for who, doc, score in zip(*retrieval._best_in_block(r, 5)):
            found[asked[who][0]].append((-round(score, 9), doc))
    assert {(qid, rank, doc): -s for qid, rows in found.items() for rank, (s, doc) in enumerate(sorted(rows)[:5], 1)} == pytest.approx(want, abs=1e-8)
    assert (blocks > 1) == (block < 1000)


def test_no_questions_and_no_texts(spark):
    empty = spark.createDataFrame([], "chunk_id bigint, tokens array<string>")
    some = spark.createDataFrame([(1, ["a"]), (2, [])], "chunk_id bigint, tokens array<string>")
    asked = spark.createDataFrame([("q", ["a"]), ("r", ["b"]), ("s", [])], "qid string, terms array<string>")
    best = lambda t, q: [(r.qid, r.chunk_id) for r in retrieval.bm25_best(retrieval.forward(t), q, 5).collect()]
    assert best(some, asked) == [("q", 1)] and best(empty, asked) == [] and best(some, asked.filter("qid = 'none'")) == []


def test_bm25_many_moves_no_pairs(spark, alike):
    got = []
    assert shuffled(spark, lambda: got.extend(texts.bm25_many(spark, alike).collect())) < 40_000  # 360 000 pairs
    assert len(got) == 3000 and all(r.doc_id == r.asker for r in got if r["rank"] == 1)


@pytest.mark.parametrize("name, most", [("rrf_fuse", 4_000), ("hybrid_rrf", 7_000)])
def test_fusion_moves_no_pairs(spark, alike, name, most):
    got = []
    n = shuffled(spark, lambda: got.extend(search.QUERIES[name](spark, alike).collect()))
    assert len({r.qid for r in got}) == 6 and n < most, n


def test_bench_systems_moves_few_rows(spark, alike):
    got = []
    n = shuffled(spark, lambda: got.extend(facts.bench_systems(spark, alike).collect()))
    assert {r.system for r in got} >= {"embed", "embed_layer"} and n < 7_000, n


@pytest.mark.parametrize("name", ["failure_counts", "latency_quantiles", "eval_metrics", "grade_outcome", "temporal_summary"])
def test_metrics_move_no_pairs(spark, alike, name):
    got = []
    n = shuffled(spark, lambda: got.extend(facts.QUERIES[name](spark, alike).collect()))
    assert n < 40_000, n
