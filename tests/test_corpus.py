import datetime as dt
import json

import pytest

from factloom import corpus
from factloom.operators import evaluate


def test_vault_and_figures(spark, tmp_path):
    told = corpus.recorded(spark, 12)
    assert sorted(map(str, told.collect())) == sorted(map(str, corpus.recorded(spark, 12).collect()))
    asked = corpus.cases(told, 1)
    made = corpus.written(corpus.vault(told), asked, tmp_path)
    assert made["files"] == len(list(tmp_path.rglob("*.md"))) and json.loads((tmp_path / "manifest.json").read_text()) == made
    lines = [json.loads(x) for x in (tmp_path / "cases.jsonl").read_text().splitlines()]
    assert len(lines) == 48 and {x["category"] for x in lines} == {"lookup", "paraphrase", "superseded"}
    rows = corpus.figures(spark, 12)
    got = {(r.system, r.category): r for r in rows.collect()}
    assert got["full", "superseded"].r1 > got["bm25", "superseded"].r1 and got["full", "superseded"].stale_rate < got["bm25", "superseded"].stale_rate
    assert got["full", "lookup"].r5 == 1.0
    assert corpus.markdown(rows, "Figures", ["system", "category"]).startswith("## Figures\n\n| system | category | n |")


def test_outcomes_of_answers(spark):
    rows = [("It is Ana Holm now.", "ana holm", ["Bo"], "correct"), ("Bo, they say", "Ana", ["Bo"], "stale"), ("Boris", "Ana", ["Bo"], "wrong"), (" ", "Ana", [], "no_answer"), (None, "Ana", None, "no_answer"), ("Ana, formerly Bo", "Ana", ["Bo"], "correct")]
    df = spark.createDataFrame(rows, "said string, want string, old array<string>, expected string")
    assert all(r.outcome == r.expected for r in evaluate.answered(df).collect())


def test_heldout_is_stratified(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)], "id long, kind string")
    got = {(r.kind, r.split): r["count"] for r in evaluate.heldout(df, "id", "kind").groupBy("kind", "split").count().collect()}
    assert got == {("hot", "heldout"): 60, ("hot", "dev"): 140, (None, "heldout"): 30, (None, "dev"): 70}


def test_flags_and_summary(spark):
    df = spark.createDataFrame([("a", True, False), ("a", True, True), ("a", False, True), ("b", False, None), ("b", True, None)], "kind string, due boolean, flagged boolean")
    got = {r.kind: (r.n, r.false_fresh, r.over_flag) for r in evaluate.flag_metrics(df, "kind").collect()}
    assert got["a"] == (3, 0.5, 1.0) and got["b"] == (2, 1.0, 0.0) and got["all"][1] == pytest.approx(0.667)
    cases = spark.createDataFrame([("dev", "x", "correct", None, True), ("dev", "x", "stale", dt.date(2024, 1, 1), None)], "split string, category string, outcome string, as_of date, cited boolean")
    row = evaluate.summary(cases).filter("category = 'x'").first()
    assert (row.accuracy, row.current_accuracy, row.as_of_accuracy, row.provenance) == (0.5, 1.0, 0.0, 0.5)
