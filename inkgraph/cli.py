"""Command line: ``python -m inkgraph.cli [summary|check|graph|index|emit|report|fix-prompt|orphans|serve|version] PATH``; summary if no verb is given."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import __version__
from .api import Queries
from .docgraph import DocGraph
from .model import FINDING_KINDS, POLICIES, finding_kind
from .operators import conformance
from .operators import findings as N
from .serve import serve
from .sinks import render
from .sources import config

OK, FAILED, USAGE, RUNTIME = 0, 1, 2, 3
VERBS = ("summary", "check", "graph", "index", "emit", "report", "fix-prompt", "orphans", "serve", "version")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkgraph")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--root", action="append", dest="roots")
    p.add_argument("--threshold", type=int)
    p.add_argument("--okf", action="store_true", default=None)
    p.add_argument("--resolution", choices=POLICIES)
    p.add_argument("--out")
    p.add_argument("--format", choices=("json", "mermaid", "dot"), default="json")
    p.add_argument("--tree", action="store_true")
    p.add_argument("--title", default="Documentation")
    p.add_argument("--kind", action="append", choices=FINDING_KINDS)
    p.add_argument("--errors-only", action="store_true")
    p.add_argument("--all", action="store_true")
    p.add_argument("--llms", action="store_true")
    p.add_argument("--full", action="store_true")
    p.add_argument("--small", action="store_true")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    p.add_argument("--only", action="append", choices=("isolated", "deadEnd", "underLinked", "unreachable", "farFromRoot"), help="orphans: these lists alone")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    if not args or args[0].startswith("--") and args[0] != "--help" or args[0] not in VERBS and os.path.isdir(args[0]):
        args.insert(0, "summary")
    try:
        a = parser().parse_args(args)
    except SystemExit as stop:
        return USAGE if stop.code else OK
    if a.verb == "version":
        print(__version__)
        return OK
    try:
        options, notices = config.load(a.path, strict=a.strict, roots=tuple(a.roots) if a.roots else None, inbound_threshold=a.threshold, okf=a.okf, policy=a.resolution, output_dir=a.out)
    except (ValueError, TypeError) as bad:
        print(f"configuration: {bad}", file=sys.stderr)
        return USAGE
    for kind in a.kind or ():
        finding_kind(kind)
    spark = spark or SparkSession.builder.appName("inkgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return _run(a, DocGraph.from_path(spark, a.path, options), notices)
    except OSError as bad:
        print(bad, file=sys.stderr)
        return RUNTIME


def _run(a: argparse.Namespace, g: DocGraph, notices: list) -> int:
    for kind, path, detail in (*notices, *g.notices):
        print(f"{kind} {path}: {detail}", file=sys.stderr)
    if a.verb == "orphans":
        found = Queries(g).list_orphans()
        print(json.dumps({k: found[k] for k in a.only} if a.only else found, indent=2))
        return OK
    if a.verb == "serve":
        serve(Queries(g), sys.stdin, sys.stdout)
        return OK
    if a.verb == "summary":
        for kind, path, detail in g.analysis_notices():
            print(f"{kind} {path}: {detail}", file=sys.stderr)
        print(render.terminal(render.View(g), N.report(g), render.use_colour(a.color, sys.stdout.isatty(), dict(os.environ))), end="")
        return OK
    if a.verb == "emit":
        render.write_all(a.out or "out", render.bundle(g, a.title))
        return OK
    if a.verb in ("graph", "index", "report"):
        v = render.View(g)
        if a.verb == "graph":
            text = render.mermaid_tree(v) if a.tree else {"json": render.graph_json, "mermaid": render.mermaid, "dot": render.dot}[a.format](v)
        elif a.verb == "report":
            text = render.report_md(v, N.report(g))
        else:
            text = render.llms(v, a.title) if a.llms else render.llms_bodies(v) if a.full else render.llms_bodies(v, render.small_set(v)) if a.small else render.index_md(v, a.title)
        print(text, end="")
        return OK
    found = N.report(g)
    if a.verb == "fix-prompt":
        print(render.fix_prompt(found, kinds=tuple(a.kind or ()), errors_only=a.errors_only, everything=a.all, exclude=g.config.emit_exclude), end="")
        return OK
    counted = {r["kind"]: r["n"] for r in N.counts(found).collect()}
    conformant = not g.config.okf or conformance.violations(g.documents, g.sections).isEmpty()
    if a.out:
        render.write_all(a.out, {"findings.json": render.findings_json(found, conformant if g.config.okf else None, conformance.version(g.documents) if g.config.okf else None), "junit.xml": render.junit(found)})
    print(json.dumps(counted, indent=2, sort_keys=True))
    return N.exit_code(counted, g.config.strict, g.config.structure_severity, conformant)


if __name__ == "__main__":
    sys.exit(main())
