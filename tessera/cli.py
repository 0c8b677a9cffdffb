"""Command line: ``python -m tessera COMMAND``. Every command is a call of the engine or of a parser."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.code import parse_code
from tessera.operators.compile import compile_files, object_json
from tessera.operators.markdown import parse_markdown
from tessera.plans.engine import Engine
from tessera.session import local_session
from tessera.sources import files as fs
from tessera.sources import pdf

HOME = os.environ.get("TESSERA_HOME", str(Path.home() / ".tessera"))


def engine(args: argparse.Namespace) -> Engine:
    """The engine of the home folder; on a cluster the submitted session is taken as it is."""
    return Engine(local_session(args.cores, "tessera"), args.home, args.ignore)


def workspace(args: argparse.Namespace) -> str:
    return str(Path(args.workspace).resolve())


def lines(frame, as_json: bool, columns: list[str]) -> str:
    """A small result as JSON lines or as tab-separated columns."""
    if as_json:
        return "\n".join(frame.toJSON().collect())
    return "\n".join("\t".join(str(r[c]) for c in columns) for r in frame.select(*columns).collect())


def scan(args) -> str:
    return lines(engine(args).scan(workspace(args)).where("status <> 'UNCHANGED'").orderBy("path"), args.json, ["status", "path"])


def parse(args) -> str:
    spark = engine(args).spark
    path = str(Path(args.file).resolve())
    kind = fs.TYPES.get(Path(path).suffix.lower())
    if kind is None:
        raise SystemExit(f"no parser for {Path(path).name}; known extensions: {' '.join(sorted(fs.TYPES))}")
    found = spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), "content")
    if kind == "pdf":
        return "\n".join(pdf.read_layout(found).toJSON().collect())
    text = fs.texts(found)
    parsed = parse_markdown(text) if kind == "markdown" else parse_code(text)
    return "\n".join(parsed.toJSON().collect())


def compile(args) -> str:
    numbered = engine(args).files(workspace(args)).withColumn("seq", F.lit(0).cast("long"))
    objects = compile_files(numbered)
    return "\n".join(r["json"] for r in object_json(objects).toLocalIterator()) if args.json else lines(objects.orderBy("id"), False, ["id", "type", "domain", "source_file"])


def rebuild(args) -> str:
    return json.dumps(engine(args).rebuild(workspace(args)))


def update(args) -> str:
    on = engine(args)
    return json.dumps(on.update(workspace(args)) if args.workspace else on.update_all())


def status(args) -> str:
    on = engine(args)
    counts = on.status(workspace(args) if args.workspace else None).first()
    return json.dumps(counts.asDict() | {"objects": on.count(), "workspaces": on.workspaces()})


def query(args) -> str:
    return engine(args).query(" ".join(args.text), args.limit, "json" if args.json else "markdown", fresh=not args.stale)


def hubs(args) -> str:
    return lines(engine(args).hubs(args.limit), args.json, ["inbound", "id", "name", "file_path"])


def graph_page(args) -> str:
    on = engine(args)
    graph.export_html(on.table("edges"), on.table("documents"), args.out)
    return args.out


def context(args) -> str:
    return lines(engine(args).context(args.concept, args.hops), True, [])


def serve(args) -> str:
    from tessera.server import serve as run

    run(engine(args), sys.stdin, sys.stdout)
    return ""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    top.add_argument("--home", default=HOME)
    top.add_argument("--ignore", help="file with ignore patterns")
    top.add_argument("--cores", default="*")
    commands = top.add_subparsers(required=True)

    def add(name: str, run, *arguments) -> None:
        command = commands.add_parser(name)
        command.set_defaults(run=run, json=False)
        for argument, options in arguments:
            command.add_argument(argument, **options)

    folder, as_json = ("workspace", {}), ("--json", {"action": "store_true"})
    maybe_folder = ("workspace", {"nargs": "?"})
    add("scan", scan, folder, as_json)
    add("parse", parse, ("file", {}))
    add("compile", compile, folder, as_json)
    add("index", update, folder)
    add("update", update, maybe_folder)
    add("rebuild", rebuild, folder)
    add("status", status, maybe_folder)
    add("query", query, ("text", {"nargs": "+"}), ("--limit", {"type": int, "default": 10}), ("--stale", {"action": "store_true", "help": "do not update first"}), as_json)
    add("hubs", hubs, ("--limit", {"type": int, "default": 20}), as_json)
    add("graph", graph_page, ("--out", {"default": "graph.html"}))
    add("context", context, ("concept", {}), ("--hops", {"type": int, "default": 2}))
    add("serve", serve)
    return top


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    print(args.run(args))
    return 0
