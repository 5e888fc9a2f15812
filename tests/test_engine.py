import datetime as dt
import json
import multiprocessing
import os

import pytest
from pyspark.sql import functions as F

from factloom import api, cli
from factloom.operators import facts, index, retrieval
from factloom.sources import logbook
from factloom.sources.notes import read_notes, scan
from factloom.streaming import current

NOW = dt.date(2026, 9, 29)
NOTES = {
    "projects/orion.md": "---\nverified: 2025-11-02\n---\n# Orion\n\n## People\n- Project lead: Dana Whitfield\n- Budget owner: Priya\n\n## Notes\nThe build runner restarts on Friday.\n",
    "journal/2026-08-14.md": "# 2026-08-14\n\n- Orion project lead: Sam Okafor\n- Lunch was late\n",
    "places/gym.md": "# Gym\n\n- Membership costs $45 [verified: 2026-03-01]\n- Hours: 6 to 22 [verified: 2026-09-20]\n- Bring a towel\n",
}


@pytest.fixture(scope="module")
def store(spark):
    s = api.NotesStore(spark, texts=NOTES, mtimes={"places/gym.md": 1772323200.0})
    s.index()
    return s


def test_supersession_promotes_the_newest(store):
    rows = store.search("who is the orion project lead", now=NOW).collect()
    assert [r.cite for r in rows[:2]] == ["journal/2026-08-14.md:3", "projects/orion.md:7"]
    assert rows[0].status == "FRESH" and rows[1].status == "SUPERSEDED"
    plain = store.search("who is the orion project lead", now=NOW, mode="bm25").collect()
    assert {r.status for r in plain} == {"UNKNOWN"} and not any(r.must_reverify for r in plain)
    with pytest.raises(ValueError):
        store.search("x", mode="other")
    assert store.search("zzz qqq", now=NOW).collect() == [] and store.search("the of", now=NOW).collect() == []


def test_as_of(store):
    rows = store.search("orion project lead", now=NOW, as_of=dt.date(2026, 1, 1)).collect()
    assert rows[0].cite == "projects/orion.md:7" and rows[0].status == "FRESH" and rows[0].age == 60
    assert all(not r.path.startswith("journal") for r in rows)


def test_stale_stats_conflicts(store):
    assert [(r.cite, r.age) for r in store.stale(NOW).collect()] == [("places/gym.md:3", 212)]
    s = store.stats(NOW)
    assert (s["files"], s["conflicts"], s["must_reverify"]) == (3, 1, 1)
    c = store.conflicts().collect()
    assert [(r.key, r.winner_value, r.resolved) for r in c] == [("lead orion project", "sam okafor", True)]


def test_explain(store):
    r = store.explain({"a": "who is the orion project lead", "b": "build runner friday", "c": "zzz"}, now=NOW).collect()
    by = {x.qid: x for x in r}
    a = by["a"]
    assert a.current.value == "Sam Okafor" and [x.value for x in a.superseded] == ["Dana Whitfield"] and a.status == "known" and a.resolved
    assert [(t.value, str(t["from"]), str(t.to), t.present) for t in a.timeline] == [("Dana Whitfield", "2025-11-02", "2026-08-14", False), ("Sam Okafor", "2026-08-14", "None", True)]
    assert by["b"].no_fact and by["b"].nearest and not by["b"].no_match and by["c"].no_match
    past = store.explain("orion project lead", now=NOW, as_of=dt.date(2026, 1, 1)).first()
    assert past.current.value == "Dana Whitfield" and [x.value for x in past.changed_after] == ["Sam Okafor"] and past.status == "known"
    early = store.explain("orion project lead", now=NOW, as_of=dt.date(2025, 1, 1)).first()
    assert not early.no_match and early.status == "none" and early.current is None


def test_hybrid_finds_other_words(spark):
    def embed(texts):
        return [[float("lead" in t or "boss" in t), float("hours" in t.lower()), 0.01] for t in texts]

    s = api.NotesStore(spark, texts=NOTES, embed=embed)
    s.index()
    got = [r.cite for r in s.search("boss", k=10, now=NOW, mode="hybrid").collect()]
    assert got[0] == "journal/2026-08-14.md:3" and "projects/orion.md:7" in got


def table(spark, rows):
    full = [(k, c, o, p, k, v, v, d and dt.date.fromisoformat(d), src, a, None, u and dt.date.fromisoformat(u), f"{p}:{c}") for k, c, o, p, v, d, src, a, u in rows]
    return spark.createDataFrame(full, "key string, chunk_id long, ord long, path string, label string, value string, raw_value string, start date, source string, authority string, valid_from date, valid_until date, cite string")


def test_conflict_rules(spark):
    h = "heading"
    t = table(
        spark,
        [
            ("tie", 1, 0, "a", "x", "2026-01-01", h, None, None), ("tie", 2, 0, "b", "y", "2026-01-01", h, None, None),
            ("auth", 3, 0, "a", "x", "2026-01-01", h, "explicit", None), ("auth", 4, 0, "b", "y", "2026-01-01", h, "inferred", None),
            ("half", 5, 0, "a", "x", "2026-01-01", h, "explicit", None), ("half", 6, 0, "b", "y", "2026-01-01", h, None, None),
            ("guess", 7, 0, "a", "x", "2026-01-01", h, "explicit", None), ("guess", 8, 0, "b", "y", "2026-02-01", h, "inferred", None),
            ("list", 9, 0, "a", "x", "2026-01-01", h, None, None), ("list", 10, 0, "a", "y", "2026-01-01", h, None, None),
            ("two", 11, 0, "a", "x", "2026-01-01", h, None, None), ("two", 12, 0, "a", "y", "2026-01-02", h, None, None),
            ("undated", 13, 0, "a", "x", None, "unknown", None, None), ("undated", 14, 0, "b", "y", "2026-01-02", h, None, None),
            ("same", 15, 0, "a", "x", "2026-01-01", h, None, None), ("same", 16, 0, "b", "x", "2026-01-02", h, None, None),
        ],
    )
    got = {r.key: (r.winner, r.resolved, r.reason) for r in facts.conflicts(t).collect()}
    assert got == {
        "tie": (2, False, "same-date"), "auth": (3, True, ""), "half": (5, False, "same-date"), "guess": (8, False, "inferred-over-explicit"), "two": (12, True, ""), "undated": (14, True, ""),
    }
    assert {(r.loser, r.winner) for r in facts.links(t).collect()} == {(4, 3), (11, 12), (13, 14)}
    assert facts.conflicts(t.limit(0)).collect() == []


def test_timeline_value_and_diff(spark):
    t = table(
        spark,
        [
            ("lead", 1, 0, "a", "dana", "2025-11-02", "heading", None, None), ("lead", 2, 0, "b", "sam", "2026-03-01", "heading", None, None), ("lead", 3, 0, "b", "sam", "2026-03-05", "heading", None, None), ("lead", 4, 0, "c", "kai", "2026-08-01", "tag:from", None, None),
            ("freeze", 5, 0, "a", "on", "2026-06-01", "heading", None, "2026-07-31"), ("saved", 6, 0, "a", "v", "2026-06-01", "mtime", None, None),
        ],
    )
    spans = [(r.value, str(r.from_day), str(r.to_day), r.present) for r in facts.timeline(t).filter("key = 'lead'").orderBy("from_day").collect()]
    assert spans == [("dana", "2025-11-02", "2026-03-01", False), ("sam", "2026-03-01", "2026-08-01", False), ("kai", "2026-08-01", "None", True)]
    assert [(str(r.to_day), r.present) for r in facts.timeline(t).filter("key = 'freeze'").collect()] == [("2026-07-31", False)]
    days = [dt.date(2025, 1, 1), dt.date(2025, 12, 1), dt.date(2026, 4, 1), dt.date(2026, 8, 5)]
    got = {(r.key, str(r.cutoff)): (r.value, r.status) for r in facts.value_at(t, days).collect()}
    assert [got["lead", str(d)] for d in days] == [(None, "none"), ("dana", "known"), ("sam", "known"), ("kai", "known")]
    assert got["freeze", "2026-08-05"] == ("on", "expired") and got["saved", "2026-04-01"] == (None, "unknown") and got["saved", "2026-08-05"] == ("v", "uncertain")
    rows = facts.diff_window(t, dt.date(2026, 7, 1)).collect()
    assert [(r.key, r.change, r.value, r.previous) for r in rows] == [("lead", "updated", "kai", "sam")]


def test_beside_equals_plain_window(spark):
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), None if rnd.random() < 0.1 else dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(200)), i, rnd.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d date, i int, v int")
    for after in (False, True):
        got = {r.i: r.prev_v for r in facts.beside(df, "k", F.date_trunc("month", "d"), ["d", "i"], ["v"], after=after).collect()}
        want = {}
        for k in "ab":
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] or dt.date.min, r[2]))
            for n, r in enumerate(own):
                at = n + 1 if after else n - 1
                want[r[2]] = own[at][3] if 0 <= at < len(own) else None
        assert got == want


def test_promotion_chain_and_topic(spark):
    hits = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.8), ("q", 3, 0.7)], "qid string, chunk_id long, score double")
    links = spark.createDataFrame([(2, 9, "lead"), (3, 9, "lead"), (1, 8, "budget")], "loser long, winner long, key string")
    queries = spark.createDataFrame([("q", ["lead"])], "qid string, terms array<string>")
    got = [(r.chunk_id, r.score) for r in retrieval.promote(hits, links, queries, 5).orderBy("rank").collect()]
    assert got == [(1, 0.9), (9, 0.0), (2, 0.8), (3, 0.7)]


def test_fusion_and_vectors(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, chunk_id long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "qid string, chunk_id long, rank int")
    got = {r.chunk_id: r.score for r in retrieval.fuse([a, b]).collect()}
    assert got == pytest.approx({2: 1 / 62 + 1 / 61, 1: 1 / 61, 3: 1 / 62})
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None)], "id long, vec array<double>")
    q = spark.createDataFrame([("x", [0.0, 1.0]), ("y", None)], "qid string, vec array<double>")
    assert [(r.chunk_id, r.score) for r in retrieval.cosine_top_k(v, q, 2, id="id", vec="vec", block=1).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]


def folder(tmp_path):
    for name, text in NOTES.items():
        p = tmp_path / "notes" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = tmp_path / "notes"
    (root / ".git").mkdir()
    (root / ".git" / "x.md").write_text("no")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.md").write_text("no")
    (root / "_u.MD").write_bytes(b"bad \xff byte")
    (root / "x.txt").write_text("no")
    return root


def test_source_and_incremental_index(spark, tmp_path):
    root = folder(tmp_path)
    assert [os.path.relpath(p, root) for p, _ in scan(root)] == ["_u.MD", "journal/2026-08-14.md", "places/gym.md", "projects/orion.md"]
    rows = {r.path: r for r in read_notes(spark, root, max_bytes=100, pack_bytes=50).collect()}
    assert rows["_u.MD"].text == "bad � byte" and rows["projects/orion.md"].skipped and rows["projects/orion.md"].text is None
    s = api.NotesStore(spark, root)
    first = s.index()
    assert (first["added"], first["files"]) == (4, 4)
    (root / "places" / "gym.md").write_text("# Gym\n- Hours: 7 to 20\n")
    (root / "journal" / "2026-08-14.md").unlink()
    (root / "new.md").write_text("- a fact: one\n")
    second = s.index()
    assert {k: second[k] for k in ("added", "updated", "removed", "unchanged")} == {"added": 1, "updated": 1, "removed": 1, "unchanged": 2}
    assert second["version"] != first["version"] and s.index()["version"] == second["version"]


def test_index_fails_closed(spark, tmp_path):
    root = folder(tmp_path)
    api.NotesStore(spark, root).index()
    home = root / ".factloom"
    assert set(index.open_index(spark, str(home))) == set(api.TABLES)
    meta = json.loads((home / "_manifest.json").read_text())
    for change in (lambda m: m | {"schema": 999}, lambda m: {"schema": 1, "tables": m["tables"] | {"docs": m["tables"]["docs"] | {"rows": 99}}}, lambda m: []):
        (home / "_manifest.json").write_text(json.dumps(change(meta)))
        with pytest.raises(index.IndexCorrupt):
            api.NotesStore(spark, root).load()
    (home / "_manifest.json").write_bytes(b"\xff\xfe garbage")
    with pytest.raises(index.IndexCorrupt):
        api.NotesStore(spark, root).ensure()
    with pytest.raises(index.IndexMissing):
        index.open_index(spark, str(tmp_path / "none"))
    assert cli.main(["--root", str(root), "search", "orion"], spark) == 3


def test_cli(spark, tmp_path, capsys):
    root = folder(tmp_path)
    at = ["--root", str(root), "--now", "2026-09-29"]
    assert cli.main([*at, "index"], spark) == 0
    assert cli.main([*at, "search", "orion", "project", "lead"], spark) == 0 and "journal/2026-08-14.md:3  [FRESH, 46d]" in capsys.readouterr().out
    assert cli.main([*at, "search", "zzz"], spark) == 1
    assert cli.main([*at, "explain", "orion", "project", "lead"], spark) == 0 and "Sam Okafor" in capsys.readouterr().out
    assert cli.main([*at, "add", "Orion project lead: Kai", "--date", "2026-09-01"], spark) == 0
    assert cli.main([*at, "diff", "--since", "2026-08-15", "--json"], spark) == 0 and '"previous": "Sam Okafor"' in capsys.readouterr().out
    assert cli.main([*at, "stale"], spark) == 0 and cli.main([*at, "conflicts"], spark) == 0 and cli.main([*at, "stats"], spark) == 0
    with pytest.raises(SystemExit) as e:
        cli.main([*at, "diff", "--since", "2026-9-1"], spark)
    assert e.value.code == 2


def _write(args):
    root, n = args
    for i in range(10):
        logbook.append(root, f"entry {n}-{i}", dt.date(2026, 3, 1))


def test_logbook(tmp_path):
    p = logbook.append(tmp_path, "first\n\nmore", dt.datetime(2026, 3, 1, 23, 30, tzinfo=dt.timezone(dt.timedelta(hours=-2))))
    assert p.read_text() == "# Log\n\n## 2026-03-02\n\n- first\n\n  more\n"
    with pytest.raises(ValueError):
        logbook.append(tmp_path, "  ")
    root = tmp_path / "many"
    with multiprocessing.get_context("spawn").Pool(4) as pool:
        pool.map(_write, [(root, n) for n in range(4)])
    text = (root / "log.md").read_text()
    assert text.count("- entry") == 40 and text.count("## ") == 1 and not (root / ".factloom.lock").exists()


def test_rotation(tmp_path):
    for d in ("2026-07-30", "2026-08-02", "2026-09-20", "2026-09-28"):
        logbook.append(tmp_path, f"on {d}", dt.date.fromisoformat(d))
    out = logbook.rotate(tmp_path, 14, dt.date(2026, 9, 29))
    assert out == {"archived": 2, "kept": 2, "files": ["archive/log-2026-07.md", "archive/log-2026-08.md"]}
    assert "on 2026-07-30" in (tmp_path / "archive" / "log-2026-07.md").read_text() and "2026-08-02" not in (tmp_path / "log.md").read_text()
    assert logbook.rotate(tmp_path, 14, dt.date(2026, 9, 29))["archived"] == 0


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(f"k{i % 5}", i, i, "p", f"k{i % 5}", f"v{i % 3}", f"V{i % 3}", dt.date(2024, 1, 1) + dt.timedelta((i * 37) % 90) if i % 9 else None, "heading", [None, "explicit"][i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, chunk_id long, ord long, path string, label string, value string, raw_value string, start date, source string, authority string")
    src, out = tmp_path / "in", str(tmp_path / "view")
    for part in range(3):
        df.filter(F.col("ord") % 3 == part).coalesce(1).write.mode("append").parquet(f"file://{src}")
        q = current.keep_current(spark.readStream.schema(df.schema).parquet(f"file://{src}"), out, f"file://{tmp_path}/cp")
        q.awaitTermination()
    assert sorted(map(str, current.read_current(spark, out).collect())) == sorted(map(str, current.newest(df).collect()))
