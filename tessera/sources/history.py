"""Commit messages of files, and the style of a file's history."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera import constants as C
from tessera.functions import text as T

#: Commits that one task reads in one pass.
RANGE = 2000


def _git(folder: str, *arguments: str) -> bytes:
    return subprocess.run(["git", "-C", folder, *arguments], capture_output=True, check=True).stdout


@dataclass
class Commits(InputPartition):
    first: int
    many: int


class HistoryReader(DataSourceReader):
    def __init__(self, folder: str, many: int):
        self.folder, self.many = folder, many

    def partitions(self) -> list[InputPartition]:
        done = subprocess.run(["git", "-C", self.folder, "rev-list", "--count", "HEAD"], capture_output=True)
        total = int(done.stdout) if done.returncode == 0 else 0  # no repository, or one without commits
        return [Commits(i, self.many) for i in range(0, total, self.many)] or [Commits(0, 0)]

    def read(self, partition: Commits) -> Iterator[tuple[str, int, str]]:
        if not partition.many:
            return
        out = _git(self.folder, "log", f"--skip={partition.first}", f"--max-count={partition.many}", "--relative", "--name-only", "-z", "--format=%x01%B%x02", "HEAD")
        for i, commit in enumerate(re.split(b"\x01", out)[1:]):
            message, _, names = commit.partition(b"\x02")
            text = message.decode(errors="replace").strip()
            for name in filter(None, (n.strip(b"\n") for n in names.split(b"\x00"))):
                yield name.decode(errors="replace"), partition.first + i, text


class HistorySource(DataSource):
    """Reads a git repository: relative path, place in the log (0 is the newest commit) and message, a row for each file of a commit.

    Options: folder (readable where tasks run), range (commits a partition). Each partition is one pass over a range of commits.
    """

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "relative string, place long, message string"

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options["folder"], int(self.options.get("range", RANGE)))


def read_history(spark: SparkSession, folder: str, many: int = RANGE) -> DataFrame:
    spark.dataSource.register(HistorySource)
    return spark.read.format(HistorySource.name()).option("folder", os.path.abspath(folder)).option("range", many).load()


def read_commits(paths: DataFrame, folder: str, many: int = RANGE) -> DataFrame:
    """The latest messages of each path, newest first; paths are absolute or relative to the folder."""
    root = os.path.abspath(folder).rstrip("/") + "/"
    relative = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    rows = read_history(paths.sparkSession, folder, many).where("message <> ''")
    rows = paths.select("path", relative.alias("relative")).distinct().join(rows, "relative")
    rank = F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1  # Spark keeps the first of each path before it shuffles
    return rows.withColumn("rank", rank).where(F.col("rank") < C.COMMITS).select("path", "rank", "message")


def commit_style(commits: DataFrame) -> DataFrame:
    """multiline_ratio, conventional_ratio, avg_msg_length and composite of each path."""
    message = F.regexp_replace(F.regexp_replace("message", r"^[ \t\r\n\f\x0B]+", ""), r"[ \t\r\n\f\x0B]+$", "")
    rows = commits.where(F.col("rank") < C.COMMITS).select("path", message.alias("message")).where("message <> ''")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    found = rows.groupBy("path").agg(
        share(F.col("message").contains("\n")).alias("multiline_ratio"),
        share(T.is_conventional(F.col("message"))).alias("conventional_ratio"),
        F.avg(F.octet_length("message")).alias("avg_msg_length"),
        F.count("*").alias("messages"),
    )
    size = F.least(F.greatest((F.col("avg_msg_length") - 10.0) / 190.0, F.lit(0.0)), F.lit(1.0))
    return found.withColumn("composite", (F.col("multiline_ratio") + F.col("conventional_ratio") + size) / 3)
