"""A tool server over standard input and output: one JSON-RPC message a line."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import functions as F

from tessera import __version__
from tessera.operators.compile import compile_files, object_json
from tessera.plans.engine import Engine

PROTOCOL = "2024-11-05"


def _schema(required: list[str], **kinds: str) -> dict:
    return {"type": "object", "properties": {name: {"type": kind} for name, kind in kinds.items()}, "required": required}


TOOLS = {
    "query": ("Files that hold what is asked for, with the reasons why they match.", _schema(["query"], query="string", limit="integer")),
    "scan": ("New, changed and deleted files of a workspace. Changes nothing.", _schema(["workspace"], workspace="string")),
    "compile": ("The objects that a workspace's files give. Changes nothing.", _schema(["workspace"], workspace="string")),
    "rebuild": ("Index a workspace anew.", _schema(["workspace"], workspace="string")),
    "status": ("How many files are known, active and deleted.", _schema([], workspace="string")),
}


def _query(engine: Engine, p: dict) -> str:
    return engine.query(p["query"], int(p.get("limit", 10)))


def _scan(engine: Engine, p: dict) -> str:
    return json.dumps([r.asDict() for r in engine.scan(p["workspace"]).where("status <> 'UNCHANGED'").select("path", "status").toLocalIterator()])


def _compile(engine: Engine, p: dict) -> str:
    objects = compile_files(engine.files(p["workspace"]).withColumn("seq", F.lit(0).cast("long")))
    return "[" + ", ".join(r["json"] for r in object_json(objects).toLocalIterator()) + "]"


def _rebuild(engine: Engine, p: dict) -> str:
    return json.dumps(engine.rebuild(p["workspace"]))


def _status(engine: Engine, p: dict) -> str:
    return json.dumps(engine.status(p.get("workspace")).first().asDict())


RUN: dict[str, Callable[[Engine, dict], str]] = {"query": _query, "scan": _scan, "compile": _compile, "rebuild": _rebuild, "status": _status}


def answer(engine: Engine, message: dict) -> dict | None:
    """The response to a message; notifications have none."""
    method, params, number = message.get("method"), message.get("params") or {}, message.get("id")
    if number is None:
        return None
    reply = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": __version__}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}}
    if method != "tools/call" or params.get("name") not in RUN:
        return reply | {"error": {"code": -32601, "message": f"unknown method or tool: {params.get('name', method)}"}}
    given = params.get("arguments") or {}
    missing = [k for k in TOOLS[params["name"]][1]["required"] if not given.get(k)]
    if missing:
        return reply | {"error": {"code": -32602, "message": f"missing: {', '.join(missing)}"}}
    try:
        return reply | {"result": {"content": [{"type": "text", "text": RUN[params["name"]](engine, given)}]}}
    except Exception as failed:  # a failed tool is an answer; the server goes on
        return reply | {"result": {"content": [{"type": "text", "text": f"{type(failed).__name__}: {failed}"}], "isError": True}}


def serve(engine: Engine, source: TextIO, sink: TextIO) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)
