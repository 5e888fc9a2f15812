"""Command line: factloom [--root DIR] index | search | explain | diff | add | conflicts | stale | stats | rotate | serve.

Exit codes: 0 found, 1 nothing found, 2 wrong use, 3 the index can't be trusted (run index --rebuild).
"""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import date

from factloom import __version__, api, server
from factloom.functions.freshness import Windows
from factloom.operators.index import IndexCorrupt

DAY_FLAG = ("--as-of", {"type": "day"})
COMMANDS = {
    "index": [("--rebuild", {"action": "store_true"})],
    "search": [("query", {"nargs": "+"}), ("-k", {"type": int, "default": 5}), ("--mode", {"choices": ["full", "bm25", "hybrid"], "default": "full"}), DAY_FLAG],
    "explain": [("query", {"nargs": "+"}), ("--mode", {"choices": ["full", "hybrid"], "default": "full"}), DAY_FLAG],
    "diff": [("--since", {"type": "day", "required": True}), ("--until", {"type": "day"})],
    "add": [("text", {"nargs": "+"}), ("--log", {"default": "log.md"}), ("--date", {"type": "day"})],
    "conflicts": [],
    "stale": [],
    "stats": [],
    "rotate": [("--keep-days", {"type": int, "default": 14}), ("--log", {"default": "log.md"})],
    "serve": [],
}


def day(text: str) -> date:
    try:
        return api.strict_day(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def function(text: str):
    """module:name of a function from a list of texts to vectors."""
    module, _, name = text.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom", description="Dated facts in Markdown notes.")
    p.add_argument("--version", action="version", version=f"factloom {__version__}")
    p.add_argument("--root", default=".")
    p.add_argument("--index-dir")
    p.add_argument("--now", type=day)
    p.add_argument("--no-refresh", action="store_true", help="answer from the index as it is")
    p.add_argument("--volatile-days", type=int, default=Windows().volatile, help="days until a volatile passage must be checked")
    p.add_argument("--embed", type=function, metavar="MODULE:FUNCTION", help="texts to vectors, for --mode hybrid")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name, args in COMMANDS.items():
        s = sub.add_parser(name)
        for flag, kw in args:
            s.add_argument(flag, **{k: day if v == "day" else v for k, v in kw.items()})
        s.add_argument("--json", action="store_true")
    return p


def provenance(r: dict) -> str:
    parts = [r.get("authority"), r.get("origin") or r.get("source"), *(f"{w} {r[k]}" for w, k in (("from", "valid_from"), ("until", "valid_until")) if r.get(k))]
    return ", ".join(x for x in parts if x)


def hit_lines(r: dict) -> list[str]:
    age = f", {r['age']}d" if r["age"] is not None else ""
    lines = [f"{r['cite']}  [{r['status']}{age}]" + (" must re-verify" if r["must_reverify"] else ""), "  " + r["text"].split("\n")[0]]
    if r["superseded_by"]:
        lines.append("  superseded by " + ", ".join(r["superseded_by"]))
    if r["n_supersedes"]:
        lines.append("  supersedes " + ", ".join(r["supersedes"][:3]) + (f" and {r['n_supersedes'] - 3} more" if r["n_supersedes"] > 3 else ""))
    if r["provenance"] and provenance(r["provenance"]):
        lines.append("  " + provenance(r["provenance"]))
    return lines


def explain_lines(r: dict) -> list[str]:
    cur = r["current"]
    told = f"  {cur['value']}  ({cur['cite']}, {cur['as_of'] or 'undated'}" + (f"; {provenance(cur)}" if provenance(cur) else "") + ")" if cur else ""
    lines = [r["label"], f"  {r['status'].upper()}{told}"]
    if r["resolved"] is False:
        lines.append(f"  UNRESOLVED: {r['unresolved_reason']}")
    return lines + [f"  {t['from'] or '?'} to {t['to'] or ('now' if t['present'] else '?')}: {t['value']}" for t in r["timeline"]]


def run(store: api.NotesStore, a: argparse.Namespace) -> tuple[object, list[str], int]:
    """The result, its lines for people, and the exit code."""
    table = lambda out: [f"{k}: {v}" for k, v in out.items()]
    if a.cmd in ("index", "stats", "rotate"):
        out = store.index(a.rebuild) if a.cmd == "index" else store.stats(a.now) if a.cmd == "stats" else store.rotate(a.keep_days, a.now, a.log)
        return out, table(out), 0
    if a.cmd == "add":
        out = {"appended_to": store.add(" ".join(a.text), a.date, a.log)}
        return out, [out["appended_to"]], 0
    if a.cmd == "explain":
        r = api.rows_of(store.explain(" ".join(a.query), a.now, a.as_of, a.mode))[0]
        if r["no_match"] or r["no_fact"]:
            return r, ["no match" if r["no_match"] else "no fact found; nearest: " + ", ".join(r["nearest"])], 1
        return r, explain_lines(r), 0
    if a.cmd == "search":
        out = api.answer(store, " ".join(a.query), a.k, a.now, a.mode, a.as_of)
        lines = [x for r in out["results"] for x in hit_lines(r)]
        return out, lines or ["no match"], 1 if out["no_match"] else 0
    if a.cmd == "diff":
        out = api.difference(store, a.since, a.until)
        lines = [f"{kind}  {r['label']}: {r['value']}" + (f" (was {r['previous']})" if r["previous"] else "") for kind in ("added", "updated") for r in out[kind]]
        return out, [*(lines or ["no match"]), *([f"{out['undated_skipped']} undated facts left out"] if out["undated_skipped"] else [])], 0 if lines else 1
    if a.cmd == "conflicts":
        rows = api.rows_of(store.conflicts())
        lines = [f"{r['label']}: {r['winner_raw']}  ({r['n_losers']} other)" + ("" if r["resolved"] else f"  UNRESOLVED: {r['reason']}") for r in rows]
    else:
        rows = api.rows_of(store.stale(a.now))
        lines = [f"{r['cite']}  {r['age']}d  {r['text']}" for r in rows]
    return rows, lines or ["no match"], 0 if rows else 1


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = api.NotesStore(spark, a.root, index_dir=a.index_dir, cfg=Windows(volatile=a.volatile_days), embed=a.embed, refresh=not a.no_refresh)
    try:
        if a.cmd == "serve":
            server.serve(store)
            return 0
        out, lines, code = run(store, a)
    except IndexCorrupt as e:
        print(f"the index can't be trusted ({e}); run index --rebuild", file=sys.stderr)
        return 3
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print(api.to_json(out) if a.json else "\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())
