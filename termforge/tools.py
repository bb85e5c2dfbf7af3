"""The JSON-RPC protocol by which agents call the engine."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from termforge.operators import filters
from termforge.operators.params import to_array
from termforge.sources.export import dictionary_index

if TYPE_CHECKING:
    from termforge.engine import Engine

# Protocol version, error codes.
PROTOCOL, PARSE_ERROR, INVALID_REQUEST, FAILED = "2025-06-18", -32700, -32600, -32603


def _required(arguments: dict, **names: str) -> list[str]:
    for key, name in names.items():
        if not (arguments.get(key) or "").strip():
            raise ValueError(f"{name} required")
    return [arguments[k] for k in names]


def list_dictionaries(engine: Engine, arguments: dict) -> str:
    rows = dictionary_index(engine.dictionaries, engine.users).collect() if engine.users is not None else [
        *filters.public(engine.dictionaries).select("name", "description", F.lit(None).alias("maintainer")).orderBy("name").collect()
    ]
    parts = [f"**{r.name}**\nDescription: {r.description or ''}\nMaintainer: {r.maintainer or ''}\n" for r in rows]
    return f"Found {len(parts)} dictionaries:\n\n" + "\n".join(parts)


def get_dictionary_description(engine: Engine, arguments: dict) -> str:
    (name,) = _required(arguments, name="Dictionary name is")
    row = engine.scope([name]).select("description").first()
    return f'Description for dictionary "{name}":\n\n{row.description or ""}'


def find_ids(engine: Engine, arguments: dict) -> str:
    labels = to_array(_required(arguments, labels="Labels are")[0])
    name = (arguments.get("dictionary") or "").strip()
    found = {r.label: r.identifiers for r in engine.find_ids(labels, [name] if name else None).collect()}
    where = f'dictionary "{name}"' if name else "all public dictionaries"
    lines = [f"**{x}**: {', '.join(found.get(x, []))}" for x in dict.fromkeys(labels)]
    return f"Found identifiers for terms in {where}:\n\n" + "\n".join(lines)


def find_terms(engine: Engine, arguments: dict) -> str:
    text, name = _required(arguments, ids="IDs are", dictionary="Dictionary name is")
    ids = to_array(text)
    found = {r.identifier: r for r in engine.find_terms(ids, [name]).collect()}
    lines = [f"**{x}**: {found[x].label} (from {found[x].dictionary})" for x in dict.fromkeys(ids) if x in found]
    return f'Found terms for identifiers in dictionary "{name}":\n\n' + "\n".join(lines)


TEXT = "string"
#: Name, what it does, its arguments, those it must have, and its function.
TOOLS: dict[str, tuple[str, dict[str, str], list[str], Callable]] = {
    "list_dictionaries": ("Lists the public dictionaries", {}, [], list_dictionaries),
    "get_dictionary_description": ("Describes one dictionary", {"name": "its name"}, ["name"], get_dictionary_description),
    "find_ids": ("Identifiers of terms", {"labels": "terms, separated by commas", "dictionary": "its name; all public ones without"}, ["labels"], find_ids),
    "search": ("Identifiers of terms", {"labels": "terms, separated by commas", "dictionary": "its name; all public ones without"}, ["labels"], find_ids),
    "find_terms": ("Terms of identifiers", {"ids": "identifiers, separated by commas", "dictionary": "its name"}, ["ids", "dictionary"], find_terms),
}


def tool_list() -> list[dict]:
    schema = lambda given, must: {"type": "object", "properties": {k: {"type": TEXT, "description": v} for k, v in given.items()}, "required": must}
    return [{"name": n, "description": what, "inputSchema": schema(given, must)} for n, (what, given, must, _) in TOOLS.items()]


def _call(engine: Engine, name: str | None, arguments: dict) -> dict:
    """A tool's text; an error of the tool is a result as well, which the agent can read."""
    try:
        if name not in TOOLS:
            raise ValueError(f"Unknown tool: {name}")
        return {"content": [{"type": "text", "text": TOOLS[name][3](engine, arguments)}]}
    except Exception as e:  # noqa: BLE001
        return {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}


def respond(engine: Engine, body: str) -> dict:
    """The answer to one request, as a dict to be sent as JSON; empty for a notification."""
    try:
        request = json.loads(body)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "Parse error"}}
    if not (isinstance(request, dict) and request.get("jsonrpc") == "2.0" and isinstance(request.get("method"), str)):
        number = request.get("id") if isinstance(request, dict) else None
        return {"jsonrpc": "2.0", "id": number, "error": {"code": INVALID_REQUEST, "message": "Invalid Request"}}
    method, params, number = request["method"], request.get("params") or {}, request.get("id")
    if method.startswith("notifications/"):
        return {}
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "termforge", "version": "1.0.0"}}
    elif method == "tools/list":
        result = {"tools": tool_list()}
    elif method == "tools/call":
        result = _call(engine, params.get("name"), params.get("arguments") or {})
    else:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": FAILED, "message": f"Method not found: {method}"}}
    return {"jsonrpc": "2.0", "id": number, "result": result}
