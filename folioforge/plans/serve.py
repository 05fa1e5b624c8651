"""The engine's tools over standard input and output: JSON-RPC 2.0, a message on each line."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from datetime import datetime
from typing import Any, TextIO

from pyspark.sql import DataFrame

from ..operators.catalog import CatalogError
from .engine import Engine, ReadOnly

PROTOCOL = "2024-11-05"
_TEXT, _LIST, _INT = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer"}
#: Tool -> (what it does, its arguments, those that must be given).
TOOLS: dict[str, tuple[str, dict[str, Any], list[str]]] = {
    "search_docs": ("Ranked search over the sources, the best of each", {"query": _TEXT, "sources": _LIST, "limit": _INT, "kind": _TEXT}, ["query"]),
    "get_page": ("A page as markdown, by its path or its address", {"source": _TEXT, "path": _TEXT, "url": _TEXT}, ["source"]),
    "list_sources": ("Sources with page counts and freshness", {}, []),
    "get_outline": ("Headings of sources, with anchors", {"sources": _LIST}, []),
    "refresh_source": ("Pull sources again", {"names": _LIST}, []),
    "add_source": ("Add a source by its address", {"spec": _TEXT, "name": _TEXT, "kind": _TEXT, "refresh": _TEXT, "max_pages": _INT}, ["spec"]),
    "remove_source": ("Forget a source", {"name": _TEXT}, ["name"]),
}


def plain(x: Any) -> Any:
    """Rows, times and results as JSON has them."""
    if isinstance(x, DataFrame):
        return [plain(r.asDict(True)) for r in x.collect()]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, datetime):
        return x.isoformat()
    return plain(vars(x)) if hasattr(x, "__dict__") else x


def call(engine: Engine, name: str, arguments: dict[str, Any]) -> Any:
    """The result of a tool. Unknown tools and arguments are errors."""
    if name not in engine.tools:
        raise KeyError(f"no tool {name}")
    _, known, needed = TOOLS[name]
    wrong = [a for a in needed if a not in arguments] + [a for a in arguments if a not in known]
    if wrong:
        raise KeyError(f"{name}: argument {wrong[0]}")
    return plain(getattr(engine, name)(**arguments))


def answer(engine: Engine, message: dict[str, Any]) -> dict[str, Any] | None:
    """The answer to one message; none to a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    out: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "folioforge", "version": "1"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": n, "description": TOOLS[n][0], "inputSchema": {"type": "object", "properties": TOOLS[n][1], "required": TOOLS[n][2]}} for n in engine.tools]}}
    if method == "tools/call":
        try:
            text, failed = json.dumps(call(engine, params.get("name", ""), params.get("arguments") or {}), ensure_ascii=False), False
        except (KeyError, ValueError, CatalogError, ReadOnly) as e:
            text, failed = str(e), True
        return out | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return out | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(engine: Engine, lines: Iterable[str] | None = None, to: TextIO | None = None) -> None:
    """Answer each line until they end."""
    to = to or sys.stdout
    for line in lines if lines is not None else sys.stdin:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            message, out = None, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if message is not None:
            out = answer(engine, message)
        if out is not None:
            print(json.dumps(out, ensure_ascii=False), file=to, flush=True)
