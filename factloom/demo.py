"""Helpers for a page on which visitors try their own notes beside those of a store: checks, rows and conflicts, no server."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a visitor may leave.
MOST_SIGNS, MOST_NOTES = 400, 20


def checked(notes: list[str], new: str) -> list[str]:
    """The visitor's notes with a new one; blank and overlong ones, and more than may be left, raise ValueError."""
    bare = (new or "").strip()
    if not bare:
        raise ValueError("a note needs text")
    if len(bare) > MOST_SIGNS:
        raise ValueError(f"a note has at most {MOST_SIGNS} characters")
    if len(notes) >= MOST_NOTES:
        raise ValueError(f"at most {MOST_NOTES} notes")
    return [*notes, bare]


def html_row(hit: dict) -> str:
    """A hit as a table row, its text escaped."""
    cells = (hit["cite"], hit["status"], "" if hit.get("age") is None else f"{hit['age']} d", hit.get("text", ""))
    return "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>"


def visitor_conflicts(report: DataFrame, chunks: DataFrame, folder: str) -> DataFrame:
    """The conflicts in which a chunk below a visitor's folder takes part, as winner or loser."""
    own = chunks.filter(F.col("path").startswith(folder)).select(F.col("chunk_id").alias("own"))
    sides = report.select("key", F.explode(F.array_union(F.array("winner"), "losers")).alias("own")).join(own, "own", "left_semi").select("key").distinct()
    return report.join(sides, "key", "left_semi")
