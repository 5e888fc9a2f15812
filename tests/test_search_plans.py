"""The registered searches against a plain one in Python, over the smallest test tables."""

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.plans import catalogue, search, texts
from factloom.session import load

DATA = "/root/testdata/sf0.001"
RANK = {"explicit": 4, "observed": 3, "imported": 2, "inferred": 1, None: 0}
MIN = dt.date.min


@pytest.fixture(scope="module")
def world(spark):
    t = search.tables(spark, DATA)
    return {r.chunk_id: r for r in t["chunks"].collect()}, t["assertions"].collect()


def bm25(chunks, terms):
    n, avg = len(chunks), sum(len(c.tokens) for c in chunks.values()) / len(chunks)
    bags = {i: Counter(c.tokens) for i, c in chunks.items()}
    out = defaultdict(float)
    for t in set(terms):
        own = [i for i, b in bags.items() if t in b]
        w = math.log(1 + (n - len(own) + 0.5) / (len(own) + 0.5))
        for i in own:
            tf = bags[i][t]
            out[i] += w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(chunks[i].tokens) / avg))
    return out


def best(scores, k):
    return sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]


def fused(chunks, vectors, q, depth=50):
    u = {i: v / (np.linalg.norm(v) or 1) for i, v in vectors.items()}
    out = defaultdict(float)
    for ranking in (best(bm25(chunks, chunks[q].tokens), depth), best({i: float(v @ u[q]) for i, v in u.items()}, depth)):
        for r, i in enumerate(ranking, 1):
            out[i] += 1 / (60 + r)
    return out


def links(facts, as_of):
    by = defaultdict(list)
    for a in facts:
        if as_of is None or a.start is None or a.start <= as_of:
            by[a.key].append(a)
    out = set()
    for key, rows in by.items():
        day = lambda a: a.start or MIN
        if len({a.value for a in rows}) < 2 or (len({a.path for a in rows}) == 1 and len({day(a) for a in rows}) == 1):
            continue
        win = max(rows, key=lambda a: (day(a), RANK[a.authority], a.chunk_id, a.ord))
        same = [a for a in rows if day(a) == day(win)]
        lead = [a for a in same if RANK[a.authority] == RANK[win.authority]]
        if len({a.value for a in same}) > 1 and not (all(RANK[a.authority] for a in same) and len({a.value for a in lead}) == 1):
            continue
        if win.authority == "inferred" and any(a.authority == "explicit" and a.value != win.value for a in rows):
            continue
        out |= {(a.chunk_id, win.chunk_id, key) for a in rows if a.value != win.value and a.chunk_id != win.chunk_id}
    return out


def plain_search(chunks, facts, scores, terms, k, as_of=None):
    when = as_of or texts.NOW
    own = defaultdict(list)
    for a in facts:
        own[a.chunk_id].append(a)
    if as_of:
        late = lambda i: chunks[i].effective_source not in ("mtime", "unknown") and ((chunks[i].effective_date or MIN) > as_of or (own[i] and all((a.start or MIN) > as_of for a in own[i])))
        scores = {i: s for i, s in scores.items() if not late(i)}
    found = links(facts, as_of)
    beaten = {x for x, _, _ in found}
    expired = lambda i: bool(own[i]) and all(a.valid_until and a.valid_until < when for a in own[i])
    age = lambda i: max(0, (when - chunks[i].effective_date).days) if chunks[i].effective_date else None
    decay = lambda i: 0 if age(i) is None else 0.5 ** (age(i) / 180)
    ranked = {i: s * (0.75 + 0.25 * decay(i)) * (0.6 if i in beaten or expired(i) else 1) for i, s in scores.items()}
    window = best(ranked, max(3 * k, k + 5))
    topical = sorted((key, x, w) for x, w, key in found if set(key.split()) & set(terms))
    out = []

    def put(i):
        if i not in out:
            out.append(i)
            for _, x, w in topical:
                if w == i and x in window:
                    put(x)

    for i in window:
        if i not in out:
            for _, x, w in topical:
                if x == i:
                    put(w)
            put(i)

    def row(rank, i):
        a, volatile = age(i), chunks[i].is_volatile
        must = volatile and (a is None or a > 30)
        fresh = "STALE" if a is None or must or a > 365 else "FRESH" if a <= 90 else "AGING"
        return rank, i, pytest.approx(ranked[i] if i in window else 0.0, abs=1e-5), "SUPERSEDED" if i in beaten else "EXPIRED" if expired(i) else fresh, a, int(must)

    return [row(r, i) for r, i in enumerate(out[:k], 1)]


def got(df):
    by = defaultdict(list)
    for r in df.orderBy("qid", "rank").collect():
        by[r.qid].append((r.rank, r.chunk_id, r.score, r.status, r.age, r.must_reverify))
    return dict(by)


@pytest.fixture(scope="module")
def vectors(spark, world):
    return {r.vec_id: np.array(r.embedding, float) for r in load(spark, DATA, "embeddings").collect() if r.vec_id in world[0]}


def test_fusion_takes_fifty_of_each(spark, world, vectors):
    chunks, _ = world
    rows = defaultdict(dict)
    for r in catalogue.queries()["search_fused"](spark, DATA).collect():
        rows[r.qid][r.chunk_id] = r.score
    asked = [i for i in vectors if i in search.LIKE]
    assert set(rows) == {str(q) for q in asked} and min(map(len, rows.values())) >= 50
    for q in asked:
        assert rows[str(q)] == pytest.approx(fused(chunks, vectors, q), abs=1e-5)


def test_hybrid_search_equals_a_plain_one(spark, world, vectors):
    chunks, facts = world
    want = {str(q): plain_search(chunks, facts, fused(chunks, vectors, q), chunks[q].tokens, 5) for q in vectors if q in search.LIKE}
    assert got(catalogue.queries()["search_hybrid"](spark, DATA)) == want


@pytest.mark.parametrize("name, as_of", [("search_notes", None), ("search_asof", dt.date(2023, 1, 1))])
def test_search_equals_a_plain_one(spark, world, name, as_of):
    chunks, facts = world
    asked = {r.qid: r.terms for r in search.search.asked(spark, search._stated(), as_of).collect()}
    want = {q: plain_search(chunks, facts, bm25(chunks, terms), terms, 10, as_of) for q, terms in asked.items()}
    assert got(catalogue.queries()[name](spark, DATA)) == {q: rows for q, rows in want.items() if rows}
    assert any(r[3] == "SUPERSEDED" for rows in want.values() for r in rows)
    assert as_of or any(r[2] == 0.0 for rows in want.values() for r in rows), "no superseding chunk was brought in"


def test_explain_follows_the_search(spark, world):
    _, facts = world
    rows = catalogue.queries()["search_explain"](spark, DATA).collect()
    assert {r.qid for r in rows} == set(search._stated()) and any(r.n_superseded for r in rows)
    assert all(r.key in {a.key for a in facts} for r in rows if not (r.no_match or r.no_fact))
