"""Entry points: check, scan, report and duplicates, each a dict or table of DataFrames."""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import duplicates as D
from tessera.operators import features, findings, lexer, scores
from tessera.plans import render
from tessera.sources import files as sources
from tessera.sources import history
from tessera.sources.settings import Calibration, as_table, bounds_table
from tessera.sources.staging import released, written


@dataclass(frozen=True)
class Options:
    include_general: bool = False
    git_folder: str | None = None  # its history adds a signal
    prior: float = 0.5
    calibration: Calibration = Calibration()
    threshold: float = C.DUPLICATE_DISTANCE
    cross_language: bool = False
    #: How functions that may be copies are found; None compares all of similar size.
    index: D.Index | None = D.Index()


def check(files: DataFrame, options: Options = Options(), tables: lexer.Tables | None = None) -> DataFrame:
    return findings.check(files, options.include_general, tables)


@dataclass(frozen=True)
class Duplicates:
    functions: DataFrame
    pairs: DataFrame
    members: DataFrame  # func_ord, cluster
    clusters: DataFrame
    ratio: DataFrame


def duplicates(files: DataFrame, options: Options = Options(), most: int | None = 20, tables: lexer.Tables | None = None) -> Duplicates:
    """Near-duplicate functions of a project."""
    functions = lexer.shown(D.numbered((tables or lexer.tables(files)).functions))
    functions = functions.withColumn("body", F.encode("body", "ISO-8859-1")).where(F.octet_length("body") >= C.LEAST_BODY)
    functions = written(functions)
    pairs = written(D.compression_pairs(functions, options.threshold, None if options.cross_language else "family", index=options.index))
    members = written(D.clusters(pairs))
    return Duplicates(functions, pairs, members, D.cluster_table(pairs, members, most), D.duplicate_ratio(functions, members))


def measured(files: DataFrame, options: Options = Options(), project: bool = True, tables: lexer.Tables | None = None, dup: Duplicates | None = None) -> DataFrame:
    """File metrics with what the score needs besides: compression, history, dead lines, the project's duplicates."""
    tables = tables or lexer.tables(files)
    lexed, functions = tables.lexed, tables.functions
    metrics = features.file_metrics(lexed, functions)
    dead = findings.dead_functions(functions, lexed).groupBy("path").agg(F.sum("lines").cast("long").alias("dead_lines"))
    metrics = metrics.join(dead, "path", "left").fillna(0, ["dead_lines"])
    if options.git_folder:
        named = metrics.withColumn("name", F.substring_index("path", "\x00", 1))
        style = history.commit_style(history.read_commits(named.select(F.col("name").alias("path")).distinct(), options.git_folder))
        metrics = named.join(style.select(F.col("path").alias("name"), "composite"), "name", "left").drop("name")
    if project:
        dup = dup or duplicates(files, options, tables=tables)
        metrics = metrics.crossJoin(F.broadcast(dup.ratio.select(F.col("ratio").alias("dup_ratio"))))
    return metrics


def scan(files: DataFrame, options: Options = Options(), project: bool = True, tables: lexer.Tables | None = None, dup: Duplicates | None = None) -> DataFrame:
    """Scores of the files that are not skipped; a single file or stream has no project. Tables and duplicates that are there are used."""
    return lexer.shown(_scored(files, options, project, tables, dup))


def _scored(files: DataFrame, options: Options, project: bool, tables: lexer.Tables | None, dup: Duplicates | None = None) -> DataFrame:
    """Scores with the tables' own keys. The metrics are written, so that all larger tables go when they were made here."""
    with released() if tables is None else nullcontext():
        metrics = written(measured(files, options, project, tables, dup), outlive=tables is None)
    return scores.score_files(metrics, options.calibration, options.prior)


def report(files: DataFrame, options: Options = Options(include_general=True), tables: lexer.Tables | None = None, dup: Duplicates | None = None, scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of a report; files are lexed and duplicates are found once, or not at all where they are given."""
    tables = tables or lexer.tables(files)
    dup = dup or duplicates(files, options, tables=tables)
    scored = scored or written(scan(files, options, tables=tables, dup=dup))
    found = written(check(files, options, tables))
    return {
        "overview": scores.project(scored).crossJoin(F.broadcast(dup.ratio)),
        "files": scored.orderBy("path"),
        "signals": scores.signals(scored),
        "findings": found,
        "summary": findings.severity_counts(found),
        "dead_code": found.where("kind = 'dead-code'"),
        "duplicates": dup.clusters,
        "members": dup.functions.join(dup.members, "func_ord").select("cluster", "func_ord", "path", "start_line", "end_line", "name"),
        "duplicate_listing": render.duplicate_listing(dup.functions, dup.members, dup.clusters),
        "skipped": files.where("skip_reason is not null").select("path", "skip_reason"),
        "methodology": as_table(files.sparkSession, options.calibration),
        "settings": bounds_table(files.sparkSession, options.calibration, options.threshold),
    }


def analyse(files: DataFrame, options: Options = Options(include_general=True), project: bool = True) -> DataFrame:
    """A row for every file, skipped ones included: score, findings as an array, line counts."""
    tables = lexer.tables(files)
    scored = _scored(files, options, project, tables)
    row = F.struct("seq", "kind", "severity", "line", "message")
    found = findings.check_tables(tables, options.include_general).groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("findings"))
    kept = tables.lexed.select("path", "family", "language", F.lit(False).alias("skipped")).join(scored, "path", "left").join(found, "path", "left")
    skipped = files.where("skip_reason is not null").select("path", "family", "language", F.lit(True).alias("skipped"))
    return lexer.shown(kept).unionByName(skipped, allowMissingColumns=True)


def analyse_file(spark: SparkSession, path: str, options: Options = Options(include_general=True)) -> DataFrame:
    return analyse(sources.read_file(spark, path), options, project=False)


def analyse_folder(spark: SparkSession, folder: str, options: Options = Options(include_general=True)) -> DataFrame:
    return analyse(sources.read_folder(spark, folder), options)
