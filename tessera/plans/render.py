"""Plain text of reports, made from small tables on the driver, and exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def findings_text(findings: DataFrame) -> DataFrame:
    """One line of text a finding, with a header before each change of severity; ordered by path and seq."""
    w = Window.partitionBy("path").orderBy("seq")
    count = F.count("*").over(Window.partitionBy("path"))
    rows = findings.withColumn("before", F.lag("severity").over(w)).withColumn("n", count)
    title = F.when(F.col("before").isNull(), F.format_string("\n  %s - %d finding%s\n", "path", "n", F.when(F.col("n") == 1, "").otherwise("s"))).otherwise("")
    head = F.when(F.col("before").isNull() | (F.col("before") != F.col("severity")), F.format_string("  %s\n", "severity")).otherwise("")
    line = F.when(F.col("line") == 0, "-").otherwise(F.format_string(":%d", "line"))
    return rows.select("path", "seq", F.concat(title, head, F.format_string("    %s\t%s %s", line, "kind", "message")).alias("text")).orderBy("path", "seq")


def file_table(scores: DataFrame) -> DataFrame:
    dead = F.when(F.col("dead_lines") > 0, F.col("dead_lines").cast("string")).otherwise("-")
    text = F.format_string("%5.1f  %+6.2f  %5s  %s", F.col("probability") * 10, "raw_score", dead, "path")
    return scores.orderBy(F.desc("probability"), "path").select("path", text.alias("text"))


def signal_table(signals: DataFrame) -> DataFrame:
    text = F.format_string("  %-32s %-16s %+.2f  %s", F.concat("grp", F.lit(" / "), "signal"), "measured", "llr", F.coalesce("why", F.lit("")))
    return signals.orderBy("path", "ord").select("path", "ord", text.alias("text"))


def duplicate_listing(functions: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """The clusters in their order, each with a header and a line for every member."""
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "cluster"))  # clusters is the bounded top of the list
    top = clusters.withColumn("rank", rank)
    head = top.select("rank", F.lit(-1).cast("long").alias("func_ord"), F.format_string("\n  cluster %d - NCD %.2f (%s)", "rank", "min_ncd", "label").alias("text"))
    name = F.when(F.col("name") == "", "?").otherwise(F.col("name"))
    line = F.format_string("    %s:%d\t%s()\t[%d lines]", "path", "start_line", name, F.col("end_line") - F.col("start_line") + 1)
    rows = members.join(F.broadcast(top.select("cluster", "rank")), "cluster").join(functions, "func_ord")
    rows = rows.select("rank", F.col("func_ord").cast("long").alias("func_ord"), line.alias("text"))
    return head.unionByName(rows).orderBy("rank", "func_ord")


def exit_of_check(counts: DataFrame) -> int:
    return counts.first().exit_code


def exit_of_scan(overview: DataFrame) -> int:
    return overview.first().exit_code


def exit_of_duplicates(clusters: DataFrame) -> int:
    return 2 if clusters.limit(1).count() else 0
