import random

import pytest

from factloom.llm.mixing import filled_targets, mix_sources

TARGETS = "source string, target_share double, max_repeats int"


def test_filled_targets_share_what_is_missing():
    goal = filled_targets({"a": 100, "b": 900, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 3, "c": 1}, 1010)
    assert goal["c"] == 10 and goal["a"] == 200 and goal["b"] == pytest.approx(800)


def test_shares_caps_and_report(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["Big Notes", "big-notes", "BIG_NOTES "])) for i in range(600)]
    rows += [(1000 + i, " ".join(["w"] * rnd.randrange(1, 60)), "mid") for i in range(150)] + [(2000 + i, "w w w", "tiny") for i in range(5)]
    rows += rows[:20] + [(3000, None, "mid"), (3001, "", "mid"), (3002, "w " * 50, None), (3003, "w " * 50, "  "), (3004, "w " * 9, "stranger")]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "doc_id long, text string, source string, lam int, rate double")
    targets = spark.createDataFrame([("big-notes", 0.4, 2), ("mid", 0.5, 5), ("tiny", 0.06, 3), ("none-such", 0.04, 2)], TARGETS)
    mixture, report = mix_sources(df, targets, id="doc_id", text="text", source="source")
    rep = {r.source: r for r in report.collect()}
    copies = mixture.collect()
    assert rep["tiny"].falls_short and rep["none-such"].falls_short and not rep["mid"].falls_short and not rep["big-notes"].falls_short
    assert max(r.copies for r in copies if r.source == "big-notes") <= 2 and max(r.copies for r in copies if r.source == "mid") <= 5
    assert sum(r.copies for r in copies if r.source == "tiny") == 15
    whole = sum(len(t.split()) for i, t, s in set(rows) if t and s and s.strip())
    mixed = sum(r.copies * r.n_tokens for r in copies)
    assert abs(mixed / whole - 1) < 0.05
    for s in ("big-notes", "mid"):
        assert abs(rep[s].mixed_tokens / rep[s].goal_tokens - 1) < 0.05
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1)


def test_texts_of_one_id_count_apart_and_rows_twice_count_once(spark):
    df = spark.createDataFrame([(1, "a b c", "S"), (1, "d e f", "s"), (1, "a b c", "s "), (2, "g h i", "s")], "doc_id long, text string, source string")
    _, report = mix_sources(df, spark.createDataFrame([("s", 1.0, 2)], TARGETS), id="doc_id", text="text", source="source")
    row = report.first()
    assert row.n_documents == 3 and row.mixed_tokens == row.source_tokens and not row.falls_short


def test_nothing_to_mix(spark):
    mixture, report = mix_sources(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([("a", 1.0, 2)], TARGETS), id="doc_id", text="text", source="source")
    assert mixture.collect() == [] and report.first()["mixed_tokens"] == 0
