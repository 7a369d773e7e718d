"""Command line: check, scan, report and dupes over a file or folder, or scan over standard input."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import findings, lexer, scores
from tessera.plans import analysis, render
from tessera.sources import files as sources
from tessera.sources.settings import Calibration, load

VERSION = "0.1"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--version", "-V", action="version", version=VERSION)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("check", "scan", "report", "dupes"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="*")
        c.add_argument("--calibration")
        if name == "check":
            c.add_argument("--all", action="store_true")
        if name in ("scan", "report"):
            c.add_argument("--git", action="store_true")
            c.add_argument("--json", action="store_true")
            c.add_argument("--prior", type=float, default=0.5)
        if name == "scan":
            c.add_argument("--verbose", "-v", action="store_true")
            c.add_argument("--stdin", action="store_true")
            c.add_argument("--lang")
        if name == "dupes":
            c.add_argument("--threshold", type=float, default=0.30)
            c.add_argument("--cross-lang", action="store_true")
    return p


def _show(table, column: str = "text") -> None:
    for row in table.toLocalIterator():
        print(row[column])


def _folder(path: str) -> str:
    """The folder whose history tells about a path: itself, or that of a file."""
    return path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))


def _calibration_file(paths: list[str]) -> str | None:
    """A calibration file where the tool runs, or else beside what it looks at."""
    places = [os.getcwd(), *map(_folder, paths)]
    return next(filter(os.path.isfile, (os.path.join(p, C.CALIBRATION_FILE) for p in places)), None)


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    at = args.calibration or _calibration_file(args.paths)
    calibration = load(spark, at) if at else Calibration()
    stdin = getattr(args, "stdin", False)
    if stdin:
        files = sources.from_bytes(spark, [("<stdin>" + (f".{args.lang}" if args.lang else ""), sys.stdin.buffer.read())])
    else:
        if not args.paths or not all(map(os.path.exists, args.paths)):
            print(f"cannot read {' '.join(args.paths) or 'nothing: no path is given'}", file=sys.stderr)
            return 1
        files = None
        for path in args.paths:
            own = sources.read_folder(spark, path) if os.path.isdir(path) else sources.read_file(spark, path)
            files = own if files is None else files.unionByName(own)
    project = not stdin and any(map(os.path.isdir, args.paths))
    git = _folder(args.paths[0]) if getattr(args, "git", False) and not stdin else None
    options = analysis.Options(include_general=getattr(args, "all", args.command == "report"), git_folder=git, prior=getattr(args, "prior", 0.5), calibration=calibration, threshold=getattr(args, "threshold", 0.30), cross_language=getattr(args, "cross_lang", False))
    if args.command == "check":
        found = analysis.check(files, options).cache()
        _show(render.findings_text(found))
        counts = findings.severity_counts(found)
        if not found.limit(1).count():
            print("no issues found")
        return render.exit_of_check(counts)
    if args.command == "dupes":
        found = analysis.duplicates(files, options)
        _show(render.duplicate_listing(found.functions, found.members, found.clusters))
        if not found.clusters.limit(1).count():
            print(f"no duplicate functions found (NCD < {options.threshold:.2f}, bodies of at least {C.LEAST_BODY} bytes)")
        return render.exit_of_duplicates(found.clusters)
    # what the head of the JSON and the report need besides is found once
    again = args.command == "report" or args.json and project
    tables = lexer.tables(files) if again else None
    dup = analysis.duplicates(files, options, tables=tables) if again else None
    scored = analysis.scan(files, options, project, tables, dup).cache()
    overview = scores.project(scored)
    _show(files.where("skip_reason is not null").select(F.format_string("skipped %s (%s)", "path", "skip_reason").alias("text")))
    if args.json:
        head = overview.select(F.format_string('{"calibrated":%s,"temperature":%.2f,"project_score":%.1f,"dup_ratio":%.4f,"files":', F.lit(str(calibration.loaded).lower()), F.lit(calibration.temperature), F.col("project_score") * 10, F.lit(dup.ratio.first().ratio if project else 0.0)).alias("text"))
        print(head.first().text + "[" if project else "[")
        rows = scores.as_json(scored.orderBy(F.desc("probability"), "path")).toLocalIterator()
        first = True
        for row in rows:
            print(("" if first else ",") + row.json)
            first = False
        print("]}" if project else "]")
    else:
        _show(render.file_table(scored))
        if args.command == "report" or getattr(args, "verbose", False):
            _show(render.signal_table(scores.signals(scored)))
        _show(overview.select(F.format_string("project score %.1f", F.col("project_score") * 10).alias("text")))
    if args.command == "report":
        parts = analysis.report(files, options, tables, dup, scored if project else None)
        for name in ("overview", "summary", "findings", "dead_code", "duplicate_listing", "skipped", "methodology", "settings"):
            title = name.upper().replace("_", " ")
            print(f"\n{'-' * 72}\n  {title}\n{'-' * 72}")
            text = parts[name] if name == "duplicate_listing" else render.findings_text(parts[name]) if name in ("findings", "dead_code") else parts[name].select(F.to_json(F.struct("*")).alias("text"))
            _show(text)
    return render.exit_of_scan(overview)


if __name__ == "__main__":
    sys.exit(main())
