import random

import numpy as np

from factloom.llm.subjects import BUCKETS, assign_subjects, complement_weights, fit_curve, hashed, posteriors, tokens_of

WORDS = {"sport": "goal keeper sprint podium league referee".split(), "cooking": "dough oven simmer spice whisk batter".split(), "law": "court appeal clause verdict lease notary".split()}
FILLER = ["Nothing else to add for now.", "Keep this short.", "Too tired to finish this today.", "Follow up next week."]


def note(rnd, subjects, n=10):
    lines = [f"- The {rnd.choice(WORDS[s])} came before the {rnd.choice(WORDS[s])} again." for s in subjects for _ in range(n // max(1, len(subjects)) - 1)]
    lines += [f"- {rnd.choice(FILLER)}" for _ in range(4)]
    rnd.shuffle(lines)
    return "---\nentity: Law Court\n---\n\n# Law of Sport\n\n" + "\n".join(lines)


def corpus(n, seed):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rnd.sample(sorted(WORDS), rnd.choice([0, 1, 1, 1, 2]))
        docs.append((i, note(rnd, own)))
        truth[i] = set(own)
    return docs, truth


def test_held_out_documents(spark):
    docs, truth = corpus(600, 1)
    docs += [(1000, None), (1001, ""), (1002, "# only a heading"), (None, "goal"), (5, docs[5][1])]
    labels = [(i, s, "r") for i in range(150) for s in (truth[i] or [None])] + [(3, "astrology", "r"), (None, "law", "r"), (0, None, "r")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    got = {i: set() for i in truth}
    for r in assign_subjects(df, lab, list(WORDS), id="doc_id", text="text").collect():
        got[r.doc_id].add(r.subject)
    right = sum(got[i] == truth[i] for i in range(150, 600)) / 450
    assert right > 0.95
    assert not got.get(1000) and not got.get(1001) and not got.get(1002)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a goal")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert assign_subjects(df, none, ["law"], id="doc_id", text="text").collect() == []
    assert assign_subjects(df.limit(0), spark.createDataFrame([(1, "law")], "doc_id long, subject string"), ["law"], id="doc_id", text="text").collect() == []


def test_sentences_and_buckets():
    words = tokens_of("\ufeff---\ntitle: x\n---\n# Head\n- One two. Three!\n\n2) four\n```\n...\n")
    assert [w for w in words if w.isalpha()] == ["one", "two", "three", "four"]
    code = {"one": 11, "two": 22, "three": 33, "four": 44}
    flat, sizes = hashed(np.array([code.get(w, -1) for w in words]))
    assert sizes.tolist() == [3, 1, 1] and flat.min() >= 0 and flat.max() < BUCKETS
    again, _ = hashed(np.array([11, 22, -1, 33, -1, 44, -1]))
    assert flat.tolist() == again.tolist() and hashed(np.array([-1, -1]))[0].size == 0


def test_posteriors_match_plain_loop():
    rnd = np.random.default_rng(3)
    counts, n = rnd.random((3, 50)) * 9, np.array([4.0, 5.0, 6.0])
    w = complement_weights(counts, n, 0.1)
    sizes = np.array([3, 0, 5])
    flat = rnd.integers(0, 50, 8)
    allowed = np.array([[1, 1, 1], [1, 0, 1], [0, 1, 1]], bool)
    p = posteriors(w, np.log(n / n.sum()), flat, sizes, allowed)
    at = 0
    for k, m in enumerate(sizes):
        s = np.exp(w[flat[at : at + m]].astype(float).sum(0) + np.log(n / n.sum())) * allowed[k]
        assert np.allclose(p[k], s / s.sum())
        at += m


def test_curve_finds_the_step():
    x = np.linspace(0, 1, 400)
    y = (x > 0.3).astype(float)
    y[[3, 390]] = 1 - y[[3, 390]]
    a, b = fit_curve(x, y)
    assert abs(-b / a - 0.3) < 0.03
