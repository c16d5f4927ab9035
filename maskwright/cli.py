"""Command line: mask, unmask, route, entities, glossary-check, bootstrap, apply-review, confirm, audit, check-model, serve."""

from __future__ import annotations

import argparse
import functools
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright import server
from maskwright.api import Gate
from maskwright.operators import bootstrap, confirm, evaluation, glossary, router
from maskwright.sources import files, providers

#: command: positional and required options.
COMMANDS = {"mask": ("path",), "route": ("path",), "unmask": ("path", "--job", "--out"), "entities": (), "glossary-check": (), "bootstrap": ("path", "--out"), "apply-review": ("path",), "confirm": (), "audit": (), "check-model": (), "serve": ()}


def provider(args: argparse.Namespace, cfg_model: str | None):
    """What makes the model provider: none with --rules-only or if no model is named."""
    model = None if args.rules_only else args.model or cfg_model
    return functools.partial(providers.HttpProvider, model) if model else None


def run(args: argparse.Namespace, spark: SparkSession, make=None) -> int:
    own = Gate(spark, args.home, restricted=args.restricted or args.command == "serve")
    own.make = make or provider(args, own.cfg.model)
    show = lambda x: print(json.dumps(x, ensure_ascii=False))
    if args.command == "mask":
        got = own.mask_file(args.path, args.project, args.l2_context)
        show(got)
        return 2 if got.get("blocked") else 0
    if args.command == "route":
        got = own.route_file(args.path, args.project, args.question, args.answer)
        show(got)
        return router.EXIT_CODES.get(got["route"], 0)
    if args.command == "unmask":
        answer = files.read_documents(spark, str(own._checked(args.path))).first()["text"]
        show(own.unmask_to_file(answer, args.job, args.out, args.overwrite))
    elif args.command == "entities":
        show(own.entities())
    elif args.command == "glossary-check":
        rows = glossary.glossary_frame(spark, own.glossary(args.project))
        glossary.summary(rows).orderBy("effective_level").show()
        bad = glossary.problems(rows)
        bad.show(1000, False)
        return int(not bad.isEmpty())
    elif args.command == "bootstrap":
        docs = files.read_folder(spark, str(own._checked(args.path))).withColumn("doc_id", F.xxhash64("path"))
        found, excluded = bootstrap.bootstrap(docs, own.make)
        row = confirm.render_review(found, excluded).first()
        own._checked(args.out).write_text(row["text"] if row else "", encoding="utf-8")
    elif args.command == "apply-review":
        own.apply_review(args.project, args.path)
    elif args.command == "confirm":
        show({"left": own.confirm(args.project)})
    elif args.command == "audit":
        files.audit_tail(spark, args.home, args.n).show(args.n, False)
    elif args.command == "check-model":
        got = evaluation.connectivity(own.make() if own.make else None)
        show(got)
        return int(not got["ok"])
    elif args.command == "serve":
        server.serve(lambda: own)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright")
    p.add_argument("--home", default=str(Path.home() / ".maskwright"))
    p.add_argument("--project")
    p.add_argument("--model")
    p.add_argument("--rules-only", action="store_true")
    p.add_argument("--restricted", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(o, **({"required": True} if o.startswith("--") else {}))
        if name == "mask":
            c.add_argument("--l2-context", choices=("keep", "drop"), default="keep")
        if name == "route":
            c.add_argument("--question")
            c.add_argument("--answer")
        if name == "unmask":
            c.add_argument("--overwrite", action="store_true")
        if name == "audit":
            c.add_argument("-n", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return run(args, SparkSession.builder.appName("maskwright").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
