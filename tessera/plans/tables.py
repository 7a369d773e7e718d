"""Queries of the full scan over whole tables, whose rows are files.

The lexer, the functions, all signals of the score and the detectors run over every row. SQL cannot follow them;
they are tested by brute force. An id identifies a row; rows without one go by their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lexer, scores
from tessera.plans import analysis
from tessera.plans.samples import sample_files
from tessera.sources import files as sources


def _named(folder: str, key: Column, text: str, ending: str = "") -> Column:
    name = F.coalesce(key.cast("string"), F.concat(F.lit("none-"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.concat(F.lit(folder), name, F.lit(ending))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sources.virtual(rows, _named("", F.col("doc_id"), "text"), F.col("text"))


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as scripts, documents, turns of conversations, and the samples, which have what the tables lack."""
    pages, documents, turns = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents", "conversations"))
    found = sources.virtual(pages, _named("pages/", F.col("page_id"), "html", ".js"), F.col("html"))
    found = found.unionByName(sources.virtual(documents, _named("documents/", F.col("doc_id"), "text"), F.col("text")))
    turn = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    found = found.unionByName(sources.virtual(turns, _named("conversations/", turn, "text"), F.col("text")))
    return found.unionByName(sample_files(spark))


def scan_scores(spark, sf_dir):
    found = analysis.scan(document_files(spark, sf_dir))
    found = found.withColumn("doc_id", F.expr("try_cast(path as bigint)"))
    return found.select("doc_id", F.round("raw_score", 6).alias("raw_score"), F.round("probability", 6).alias("probability"), "label", "code_lines")


def scan_labels(spark, sf_dir):
    return scan_scores(spark, sf_dir).groupBy("label").agg(F.count("*").alias("files"), F.sum("code_lines").alias("code_lines"))


def scan_project(spark, sf_dir):
    return scores.project(scan_scores(spark, sf_dir)).withColumn("project_score", F.round("project_score", 6))


def scan_top_files(spark, sf_dir):
    return scan_scores(spark, sf_dir).orderBy(F.desc("probability"), "doc_id").limit(20)


def scan_signals(spark, sf_dir):
    found, llr = scores.signals(analysis.scan(document_files(spark, sf_dir))), F.round("llr", 6)
    return found.groupBy("grp", "signal").agg(F.count("*").alias("files"), F.sum((llr > 0).cast("long")).alias("against"), F.sum((llr < 0).cast("long")).alias("for"))


def table_lines(spark, sf_dir):
    return lexer.shown(lexer.lines(lexer.lex(table_files(spark, sf_dir).where("skip_reason is null")))).select("path", "line", "kind", "indent", "code")


def table_functions(spark, sf_dir):
    found = lexer.shown(lexer.tables(table_files(spark, sf_dir)).functions)
    return found.select("path", "func_idx", "name", "start_line", "end_line", "body_offset", "body_len")


def table_findings(spark, sf_dir):
    return analysis.check(table_files(spark, sf_dir), analysis.Options(include_general=True))


def table_scan(spark, sf_dir):
    return scores.signals(analysis.scan(table_files(spark, sf_dir)))


def table_scores(spark, sf_dir):
    return scores.as_json(analysis.scan(table_files(spark, sf_dir)))


def table_duplicates(spark, sf_dir):
    return analysis.duplicates(table_files(spark, sf_dir), most=None).clusters


def table_analysis(spark, sf_dir):
    return analysis.analyse(table_files(spark, sf_dir)).select("path", "skipped", "label", "raw_score", F.size("findings").alias("findings"))


SCANS = {f.__name__: f for f in (scan_scores, scan_labels, scan_project, scan_top_files, scan_signals)}
TABLES = {f.__name__: f for f in (table_lines, table_functions, table_findings, table_scan, table_scores, table_duplicates, table_analysis)}
