"""The analysis as tools for assistants: JSON-RPC, a message a line, on standard input and output."""

from __future__ import annotations

import json
from typing import IO

from pyspark.sql import SparkSession

from . import __version__
from .commands import Project
from .errors import PlumblineError

PROTOCOL = "2025-06-18"
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer", "minimum": 0}


def _tool(name: str, description: str, required: list[str], **properties: dict) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": required}}


TOOLS = [
    _tool("analyze", "Find architectural issues of a code base.", [], path=_TEXT, format={"type": "string", "enum": ["json", "markdown"]}),
    _tool("ai", "Give a compact context of a code base.", [], path=_TEXT, tokens=_NUMBER, signatures={"type": "boolean"}, format={"type": "string", "enum": ["json", "markdown", "xml"]}),
    _tool("impact", "Show what depends on a file.", ["file"], file=_TEXT, path=_TEXT, depth=_NUMBER),
]


def manifest() -> dict:
    """The tools' description, from the list that the server itself uses, and the command that starts it."""
    return {"name": "plumbline", "version": __version__, "command": ["python", "-m", "plumbline", "mcp"], "description": "Architecture analytics of code bases.", "tools": TOOLS}


class BadCall(ValueError):
    """A call that names no tool or lacks a parameter."""


def call(spark: SparkSession, root: str, name: str, given: dict) -> str:
    """The text of a tool's result; JSON if the call names no format."""
    if name not in {t["name"] for t in TOOLS}:
        raise BadCall(f"unknown tool: {name}")
    if name == "impact" and not given.get("file"):
        raise BadCall("file is missing")
    project, form = Project(spark, given.get("path") or root), given.get("format") or "json"
    if name == "analyze":
        if form not in ("json", "markdown"):
            raise ValueError(f"unknown format: {form}")
        return "".join(project.report(project.analysis(), form))
    if name == "ai":
        return "".join(project.context(form if form in ("markdown", "xml") else "json", given.get("tokens"), bool(given.get("signatures"))))
    return "".join(project.impact(given["file"], given.get("depth"), "json"))


def answer(spark: SparkSession, root: str, message: dict) -> dict | None:
    """The reply to one message; none to a notification."""
    if "id" not in message:
        return None
    method, given, result, error = message.get("method"), message.get("params") or {}, None, None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "plumbline", "version": __version__}, "instructions": "analyze finds issues, ai gives a context, impact shows what a change reaches."}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        try:
            text, bad = call(spark, root, given.get("name", ""), given.get("arguments") or {}), False
        except BadCall as e:
            error = {"code": -32602, "message": str(e)}
        except (PlumblineError, ValueError) as e:
            text, bad = str(e), True
        if error is None:
            result = {"content": [{"type": "text", "text": text}], "isError": bad}
    else:
        error = {"code": -32601, "message": f"unknown method: {method}"}
    return {"jsonrpc": "2.0", "id": message["id"], **({"error": error} if error else {"result": result})}


def serve(spark: SparkSession, root: str, source: IO[str], sink: IO[str]) -> None:
    """Answers messages until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(spark, root, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
