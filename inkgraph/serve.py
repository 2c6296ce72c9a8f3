"""The query API as a line protocol: JSON-RPC 2.0 requests on standard input, answers on standard output.

Methods: ``initialize``, ``ping``, ``tools/list`` and ``tools/call`` with ``{"name": ..., "arguments": {...}}``;
requests without an id are notifications and get no answer.  An unknown document is an error of
the tool, told in its result; a method or tool that is not known is an error of the protocol.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO, Any

from . import __version__
from .api import Queries, UnknownDocument

#: Name -> (what it tells, argument names, those that may be left out).
TOOLS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "what-links-to": ("Documents that link to a document.", ("document",), ()),
    "list-orphans": ("Documents by structural defect.", (), ()),
    "path-between": ("The shortest path of links between two documents.", ("from", "to"), ()),
    "get-section": ("A section by its id, document#slug.", ("id",), ()),
    "corpus-summary": ("The whole graph manifest.", (), ()),
    "suggest-links": ("Suggested links, of one document or the best of all.", (), ("document", "limit")),
    "critical-docs": ("Documents and links that the graph falls apart without.", (), ("limit",)),
}


def call(queries: Queries, name: str, told: dict[str, Any]) -> Any:
    """One tool's answer as plain values."""
    answers: dict[str, Callable[[], Any]] = {
        "what-links-to": lambda: queries.what_links_to(told["document"]), "list-orphans": queries.list_orphans, "path-between": lambda: queries.path_between(told["from"], told["to"]),
        "get-section": lambda: queries.get_section(told["id"]), "corpus-summary": lambda: json.loads(queries.corpus_summary()),
        "suggest-links": lambda: queries.suggest_links(told.get("document"), int(told.get("limit", 10))), "critical-docs": lambda: queries.critical_docs(int(told.get("limit", 10))),
    }
    return answers[name]()


def _listed() -> list[dict[str, Any]]:
    kind = lambda x: {"type": "integer" if x == "limit" else "string"}
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {x: kind(x) for x in (*needed, *free)}, "required": list(needed)}} for n, (d, needed, free) in TOOLS.items()]


def answer(queries: Queries, request: Any) -> dict[str, Any] | None:
    """The answer to one request, None for a notification."""
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
    if "id" not in request:
        return None
    said: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request["method"], request.get("params") or {}
    if method == "initialize":
        return said | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "inkgraph", "version": __version__}}}
    if method == "ping":
        return said | {"result": {}}
    if method == "tools/list":
        return said | {"result": {"tools": _listed()}}
    if method != "tools/call":
        return said | {"error": {"code": -32601, "message": f"no method {method!r}"}}
    name, told = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS or any(x not in told for x in TOOLS[name][1]):
        return said | {"error": {"code": -32602, "message": f"no tool {name!r}" if name not in TOOLS else f"{name} needs {', '.join(TOOLS[name][1])}"}}
    try:
        text, failed = json.dumps(call(queries, name, told), ensure_ascii=False), False
    except UnknownDocument as unknown:
        text, failed = f"no document {unknown}", True
    return said | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(queries: Queries, lines: IO[str], out: IO[str]) -> None:
    """Answer line by line until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            said: dict[str, Any] | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            said = answer(queries, request)
        if said is not None:
            out.write(json.dumps(said, ensure_ascii=False) + "\n")
            out.flush()
