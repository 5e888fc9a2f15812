"""The tools as a server on standard input and output: JSON-RPC 2.0, one message a line (the model context protocol)."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from factloom import __version__
from factloom.api import TOOLS, NotesStore, call_tool

PROTOCOL = "2024-11-05"
_KINDS = {str: "string", int: "integer"}
_REQUIRED = {"search": ["query"], "add": ["text"], "explain": ["question"], "diff": ["since"]}


def described() -> list[dict]:
    return [
        {"name": name, "description": text, "inputSchema": {"type": "object", "properties": {a: {"type": _KINDS[t]} for a, t in args.items()}, "required": _REQUIRED.get(name, [])}} for name, (text, args) in TOOLS.items()
    ]


def reply(store: NotesStore, message: dict) -> dict | None:
    """The answer to one message; notifications have none."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "factloom", "version": __version__}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": described()}
    elif method == "tools/call":
        try:
            told, wrong = json.dumps(call_tool(store, params.get("name", ""), params.get("arguments") or {}), ensure_ascii=False), False
        except (ValueError, KeyError) as e:
            told, wrong = str(e), True
        result = {"content": [{"type": "text", "text": told}], "isError": wrong}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method!r}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(store: NotesStore, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = reply(store, json.loads(line))
        except json.JSONDecodeError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if answer is not None:
            out.write(json.dumps(answer, ensure_ascii=False) + "\n")
            out.flush()
