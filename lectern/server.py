"""The engine's tools for clients that speak JSON-RPC over standard input and output, a message a line."""

from __future__ import annotations

import inspect
import json
import sys
from typing import IO

from pyspark.sql import SparkSession

from lectern.engine import TOOLS, Engine

# The protocol's version, and error codes of JSON-RPC.
PROTOCOL = "2024-11-05"
NO_JSON, NO_METHOD = -32700, -32601

DESCRIPTIONS = {
    "search_chunks": "Finds the passages of a knowledge base that fit a query best.",
    "search_documents": "Finds documents by text, title, author, journal and year.",
    "list_documents": "Lists documents page by page.",
    "get_document": "Gives a document's metadata, abstract and outline.",
    "get_document_text": "Reads a document's text, whole or one section, page by page.",
    "add_document": "Takes one PDF in; gives a job.",
    "remove_document": "Removes a document.",
    "create_kb": "Makes a knowledge base of a folder of PDFs; gives a job.",
    "delete_kb": "Deletes a knowledge base: first a preview with a token, then with it.",
    "list_kbs": "Lists knowledge bases.",
    "get_job": "Says how a job is doing.",
}
_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "dict": "object", "None": "null"}


def tool_schema(engine: type | Engine, name: str) -> dict:
    """A tool's arguments as JSON schema, from its signature."""
    known = {k: p for k, p in inspect.signature(getattr(engine, name)).parameters.items() if k != "self"}
    kinds = {k: [_TYPES[x] for x in str(p.annotation).split(" | ")] for k, p in known.items()}
    return {"type": "object", "properties": {k: {"type": v[0] if len(v) == 1 else v} for k, v in kinds.items()}, "required": [k for k, p in known.items() if p.default is inspect.Parameter.empty]}


def answer(engine: Engine, message: object) -> dict | None:
    """The answer to a message; None to notifications."""
    if not isinstance(message, dict) or "method" not in message:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": NO_METHOD, "message": "not a request"}}
    if "id" not in message:
        return None
    method, asked = message["method"], message.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lectern", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": DESCRIPTIONS[n], "inputSchema": tool_schema(engine, n)} for n in TOOLS]}
    elif method == "tools/call":
        got = engine.dispatch(str(asked.get("name")), asked.get("arguments", {}))
        result = {"content": [{"type": "text", "text": json.dumps(got, ensure_ascii=False, default=str)}], "isError": "error_code" in got}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": NO_METHOD, "message": f"unknown method: {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(engine: Engine, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answers messages until the input ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": NO_JSON, "message": "not JSON"}}
        else:
            reply = answer(engine, message)
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()


def main(arguments: list[str] | None = None) -> None:
    """``python -m lectern.server [CONFIG]``: an engine from settings, served over standard input and output."""
    from lectern.session import local_session
    from lectern.sources.settings import Settings

    given = sys.argv[1:] if arguments is None else arguments
    settings = Settings.load(given[0] if given else None)
    # a session that is there (spark-submit) is used; else one on this machine
    spark = SparkSession.getActiveSession() or local_session()
    serve(Engine.from_settings(spark, settings))


if __name__ == "__main__":
    main()
