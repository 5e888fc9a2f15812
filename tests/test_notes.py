import datetime as dt

from factloom.operators import notes
from factloom.sources.notes import from_texts

NOTE = """---
Updated: "2025-11-02"
 indented: no
updated: 2025-11-03
entity: Atlas
---
# A
## B ##
### C
Para one
still one

## D
- one
- two
  more
* three [verified: 2026-05-01] [volatile]
| h | i |
|---|---|
| 1 | 2 |
```sh
# no heading

x
```
after
## 2026-03-14 Tue
Text under a date.
~~~
never closed
"""


def test_chunks_of_a_note(spark):
    df = from_texts(spark, {"b.md": NOTE, "a.md": "---\nno: end\n\n# Only heading\n", "empty.md": ""})
    docs, chunks = notes.parse_notes(df)
    rows = sorted(chunks.collect(), key=lambda r: r.chunk_id)
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    assert (rows[0].path, rows[0].text, rows[0].start_line, rows[0].end_line) == ("a.md", "---\nno: end", 1, 2)
    got = [(r.start_line, r.end_line, r.kind, r.heading_path, r.text.split("\n")[0]) for r in rows[1:]]
    assert got == [
        (10, 11, "paragraph", ["A", "B", "C"], "Para one"), (14, 14, "item", ["A", "D"], "- one"), (15, 16, "item", ["A", "D"], "- two"), (17, 17, "item", ["A", "D"], "* three [verified: 2026-05-01] [volatile]"),
        (18, 18, "table", ["A", "D"], "| h | i |"), (20, 20, "table", ["A", "D"], "| 1 | 2 |"), (21, 25, "code", ["A", "D"], "```sh"), (26, 26, "paragraph", ["A", "D"], "after"),
        (28, 28, "paragraph", ["A", "2026-03-14 Tue"], "Text under a date."), (29, 31, "code", ["A", "2026-03-14 Tue"], "~~~"),
    ]
    three = rows[4]
    assert (str(three.verified), three.date_source, three.volatile) == ("2026-05-01", "inline", True)
    assert (str(rows[9].verified), rows[9].date_source) == ("2026-03-14", "heading")
    by = {r.path: r for r in docs.collect()}
    assert by["b.md"].meta == {"updated": "2025-11-03", "entity": "Atlas"} and by["b.md"].title == "A" and by["a.md"].title == "" and by["empty.md"].title == ""


def test_line_ends_and_empty_table(spark):
    _, chunks = notes.parse_notes(from_texts(spark, {"x.md": "﻿# T\r\n\r\n- a\r- b\r\n"}))
    assert [(r.start_line, r.text) for r in sorted(chunks.collect(), key=lambda r: r.chunk_id)] == [(3, "- a"), (4, "- b")]
    docs, chunks = notes.parse_notes(from_texts(spark, {"x": "a"}).limit(0))
    assert docs.collect() == [] and chunks.collect() == []


def facts_of(spark, texts, mtimes=None, stem=True):
    docs, chunks = notes.parse_notes(from_texts(spark, texts, mtimes))
    rows = notes.assertions_of(notes.dated(chunks, docs), stem).collect()
    return sorted((r.path, r.key, r.label, r.value, r.raw_value, str(r.start), r.source, r.authority) for r in rows)


def test_facts(spark):
    got = facts_of(
        spark,
        {
            "orion.md": "---\nupdated: 2025-11-02\n---\n# Orion\n- Project lead: Sam Okafor (took over from Dana), effective Monday\n- http: //x\n- Note: skip\n- 10:30 call\n- It is late\n- The gate code is now 4711. Parking moved to Lot B; ask first\n```\nkey: value\n```\n",
            "log.md": "# Log\n\n## 2026-08-14\n\n- Orion project lead: Kai Ito {explicit, user, from 2026-08-01}\n- some words {supersedes orion budget}\n- Seven words are too many in key: x\n",
            "atlas.md": "---\nentity: Atlas\n---\nStatus: paused\n",
        },
        {"atlas.md": 1772323200.0},
    )
    assert got == [
        ("atlas.md", "atla statu", "Status", "paused", "paused", "2026-03-01", "mtime", None),
        ("log.md", "budget orion", "orion budget", "some words", "some words", "2026-08-14", "heading", None),
        ("log.md", "lead orion project", "Orion project lead", "kai ito", "Kai Ito", "2026-08-01", "tag:from", "explicit"),
        ("log.md", "seven word", "Seven words", "too many in key x", "too many in key: x", "2026-08-14", "heading", None),
        ("orion.md", "code gate orion", "gate code", "4711", "4711", "2025-11-02", "front-matter:updated", None),
        ("orion.md", "lead orion project", "Project lead", "sam okafor", "Sam Okafor (took over from Dana), effective Monday", "2025-11-02", "front-matter:updated", None),
        ("orion.md", "orion park", "Parking", "lot b", "Lot B", "2025-11-02", "front-matter:updated", None),
    ]
    keys = {g[1] for g in got}
    assert {"atla statu", "budget orion", "lead orion project", "code gate orion"} <= keys and not any("http" in k for k in keys)


def test_display_value(spark):
    df = spark.createDataFrame([("Sam; then Kai.",), ("$40,000 [verified: 2026-01-01]",), ("a - b",)], "v string")
    assert [r[0] for r in df.select(notes.display_value(df.v)).collect()] == ["Sam", "$40,000", "a"]
    assert dt.date(2026, 1, 1)
