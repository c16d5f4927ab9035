"""A tool server on standard input and output: JSON-RPC, one message a line.

Tools take file paths, never texts of documents, and return no restored value. Paths are restricted to the configured roots.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from maskwright.api import Gate

_TEXT, _VERSION = {"type": "string"}, "2024-11-05"
#: name: (description, required parameters, optional ones).
TOOLS = {
    "mask_file": ("Replaces personal data and project terms of a local file by tokens; the values stay here.", ("path",), ("project",)),
    "route_file": ("Decides whether a local file may leave, and returns what may. Where nothing may, a local model can answer a question into a local file.", ("path",), ("project", "question", "local_answer_path")),
    "unmask_to_file": ("Restores a text with tokens into a new local file; returns its path and counts.", ("masked_text", "job_id", "out_path"), ()),
    "list_entities": ("Tokens, their types and numbers of spellings, without values.", (), ()),
}


def _answer_path(path: str) -> str:
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    return f"{stem}.local-answer.md"


def call(gate: Gate, name: str, arguments: dict) -> object:
    """The tool's result; what the caller did wrong comes back as {"error": ...}."""
    if name not in TOOLS:
        raise KeyError(name)
    _, required, optional = TOOLS[name]
    wrong = [k for k in required if k not in arguments] + [k for k in arguments if k not in (*required, *optional)]
    if wrong:
        return {"error": f"missing or unknown: {', '.join(wrong)}"}
    try:
        if name == "mask_file":
            return gate.mask_file(arguments["path"], arguments.get("project"))
        if name == "route_file":
            question = arguments.get("question")
            return gate.route_file(arguments["path"], arguments.get("project"), question, (arguments.get("local_answer_path") or _answer_path(arguments["path"])) if question else None)
        if name == "unmask_to_file":
            return gate.unmask_to_file(arguments["masked_text"], arguments["job_id"], arguments["out_path"])
        return gate.entities()
    except (PermissionError, FileNotFoundError, FileExistsError, ValueError) as e:
        return {"error": str(e)}


def respond(gate: Callable[[], Gate], message: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    method, at = message.get("method"), message.get("id")
    if at is None:
        return None
    if method == "initialize":
        result: dict = {"protocolVersion": _VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "maskwright", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: _TEXT for k in (*r, *o)}, "required": list(r)}} for n, (d, r, o) in TOOLS.items()]}
    elif method == "tools/call" and message.get("params", {}).get("name") in TOOLS:
        got = call(gate(), message["params"]["name"], message["params"].get("arguments") or {})
        result = {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False)}], "isError": isinstance(got, dict) and "error" in got}
    else:
        return {"jsonrpc": "2.0", "id": at, "error": {"code": -32601, "message": f"unknown: {method}"}}
    return {"jsonrpc": "2.0", "id": at, "result": result}


def serve(gate: Callable[[], Gate], source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = respond(gate, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
