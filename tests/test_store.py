import datetime as dt
import io
import json
import os

import pytest

from factloom import api, cli, demo, server
from factloom.operators import index
from factloom.sources import notes as source
from factloom.streaming import current

NOW = dt.date(2026, 9, 29)
PAGE = "---\nverified: 2025-11-02\n---\n# Orion\n\n- Project lead: Dana Whitfield {explicit, user}\n- Budget owner: Priya\n"
LATER = "# 2026-08-14\n\n- Orion project lead: Sam Okafor {explicit, tool, until 2026-12-31}\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    (root / "orion.md").write_text(PAGE)
    (root / "2026-08-14.md").write_text(LATER)
    (root / "undated.md").write_text("- Lunch menu: soup\n")
    os.utime(root / "undated.md", (0, 0))
    return root


@pytest.fixture(scope="module")
def store(spark, folder):
    return api.NotesStore(spark, folder)


def test_hits_say_where_they_are_from(store):
    out = api.answer(store, "orion project lead", now=NOW)
    top, below = out["results"][:2]
    assert (out["mode"], out["files_indexed"], out["no_match"]) == ("full", 3, False) and out["index_version"] == store.head()["version"]
    assert top["cite"] == "2026-08-14.md:3" and top["supersedes"] == ["orion.md:6"] and top["n_supersedes"] == 1 and top["superseded_by"] == []
    assert below["superseded_by"] == ["2026-08-14.md:3"] and below["status"] == "SUPERSEDED" and below["keys"] == ["lead orion project"]
    assert top["provenance"] == {"authority": "explicit", "origin": "tool", "valid_from": None, "valid_until": "2026-12-31"} and top["facts"][0]["value"] == "Sam Okafor" and top["expired"] is False
    assert top["score"] == round(top["score"], 4) and top["freshness"].startswith("FRESH, 46d old")


def test_conflicts_diff_and_stats(store, folder):
    [row] = api.rows_of(store.conflicts())
    assert row["n_losers"] == 1 and list(row["values"].values()) and set(row["values"].values()) == {"Dana Whitfield", "Sam Okafor"} and len(row["losers"]) == 1
    out = api.difference(store, dt.date(2026, 1, 1))
    assert [(r["value"], r["previous"]) for r in out["updated"]] == [("Sam Okafor", "Dana Whitfield")] and out["undated_skipped"] == 1 and out["until"] is None
    stats = store.stats(NOW)
    assert stats["files"] == 3 and stats["conflicts"] == 1 and stats["index_bytes"] > 0 and stats["built_at"] and stats["skipped_files"] == []


def test_unchanged_files_are_not_read_again(spark, store, folder, monkeypatch):
    asked = []
    reading = source.read_some

    def counted(files, *more):
        asked.append(sorted(r["path"] for r in files.select("path").collect()))
        return reading(files, *more)

    monkeypatch.setattr(api, "read_some", counted)
    before = {r.cite: r.key for r in store.tables["assertions"].collect()}
    generation = json.loads((folder / ".factloom" / "_manifest.json").read_text())["generation"]
    assert store.index()["unchanged"] == 3 and asked == [[]]
    assert json.loads((folder / ".factloom" / "_manifest.json").read_text())["generation"] == generation  # nothing was written
    (folder / "a-new.md").write_text("# Vega\n\n- Project lead: Ines\n")
    os.utime(folder / "orion.md", (1_700_000_000, 1_700_000_000))
    got = store.index()
    assert (got["added"], got["updated"], got["unchanged"], got["removed"]) == (1, 0, 3, 0) and asked[1] == ["a-new.md", "orion.md"]
    assert {r.cite: r.key for r in store.tables["assertions"].collect()} == before | {"a-new.md:3": "lead project vega"}
    ids = [r.chunk_id for r in store.tables["chunks"].orderBy("path", "start_line").collect()]
    assert ids == list(range(len(ids))) and sorted(r.chunk_id for r in store.tables["postings"].collect()) == ids
    fresh = api.NotesStore(spark, folder, index_dir=folder / ".other")
    fresh.index()
    same = lambda t: sorted(map(str, t.select(sorted(t.columns)).collect()))
    assert all(same(fresh.tables[t]) == same(store.tables[t]) for t in ("chunks", "assertions", "files"))
    (folder / "a-new.md").unlink()


def test_refresh_is_on_unless_turned_off(spark, store, folder):
    still = api.NotesStore(spark, folder, refresh=False)
    (folder / "late.md").write_text("# Rigel\n\n- Dock number: seven\n")
    assert not still.search("rigel dock number", now=NOW).filter("path = 'late.md'").collect()
    assert store.search("rigel dock number", now=NOW).first()["path"] == "late.md"


def test_server(store):
    ask = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}]
    ask += [{"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "diff", "arguments": {"since": "2026-01-01"}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "diff", "arguments": {"since": "2026-1-1"}}}, {"jsonrpc": "2.0", "id": 5, "method": "no"}]
    out = io.StringIO()
    server.serve(store, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, None] and {t["name"] for t in got[1]["result"]["tools"]} == set(api.TOOLS)
    assert json.loads(got[2]["result"]["content"][0]["text"])["updated"][0]["value"] == "Sam Okafor"
    assert got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700


def test_command_line_flags(spark, folder, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"], spark)
    assert e.value.code == 0 and "factloom" in capsys.readouterr().out
    assert cli.main(["--root", str(folder), "--now", "2026-09-29", "--no-refresh", "--volatile-days", "5", "search", "orion", "project", "lead"], spark) == 0
    out = capsys.readouterr().out
    assert "superseded by 2026-08-14.md:3" in out and "supersedes orion.md:6" in out and "explicit, tool" in out
    assert cli.main(["--root", str(folder), "--no-refresh", "search", "--mode", "hybrid", "orion"], spark) == 2


def test_index_kept_by_a_stream(spark, tmp_path):
    schema = "path string, text string, mtime double"
    for batch in ([("orion.md", PAGE, 1.0), ("x.md", "- old thing: one\n", 1.0)], [("2026-08-14.md", LATER, 2.0), ("x.md", None, 2.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        current.keep_index(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"{tmp_path}/ix", f"file://{tmp_path}/cp").awaitTermination()
    tables = index.open_index(spark, f"{tmp_path}/ix")
    assert {r.path for r in tables["files"].collect()} == {"orion.md", "2026-08-14.md"} == {r.path for r in tables["chunks"].collect()}
    assert [(r.chunk_id, r.value) for r in tables["assertions"].orderBy("chunk_id").collect()] == [(0, "sam okafor"), (1, "dana whitfield"), (2, "priya")]


def test_log_entries_in_batch_and_stream(spark, tmp_path):
    text = "# Log\n\n- before any day\n\n## 2026-03-01\n\n- first\n\n  more\n- second\n\n## 2026-13-40\n- no such day\n"
    want = {(None, "before any day"), ("2026-03-01", "first\n\nmore"), ("2026-03-01", "second"), (None, "no such day")}
    show = lambda rows: {(str(r.day) if r.day else None, r.entry) for r in rows}
    assert show(current.log_entries(spark.createDataFrame([("log.md", text), ("x.md", None)], "path string, text string")).collect()) == want
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.md").write_text(text)
    rows = current.log_stream(spark, f"file://{tmp_path}/in")
    rows.writeStream.format("memory").queryName("log_rows").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert show(spark.table("log_rows").collect()) == want


def test_visitors(spark, store):
    assert demo.checked(["a"], " b ") == ["a", "b"]
    for notes, new in (([], " "), ([], "x" * 401), (["n"] * 20, "x")):
        with pytest.raises(ValueError):
            demo.checked(notes, new)
    assert demo.html_row({"cite": "a.md:1", "status": "FRESH", "age": 3, "text": "<b>&"}) == "<tr><td>a.md:1</td><td>FRESH</td><td>3 d</td><td>&lt;b&gt;&amp;</td></tr>"
    report, chunks = store.conflicts(), store.tables["chunks"]
    assert demo.visitor_conflicts(report, chunks, "orion").count() == 1 and demo.visitor_conflicts(report, chunks, "late").count() == 0


def test_every_chunk_has_postings(store):
    assert index.misaligned(store.tables["chunks"], store.tables["postings"]).collect() == []
    assert {r.missing for r in index.misaligned(store.tables["chunks"], store.tables["postings"].limit(1)).collect()} == {"postings"}
