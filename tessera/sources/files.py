"""Source files as rows: path, content, length, family, language, skip_reason."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import paths


def described(files: DataFrame, skip: bool = True) -> DataFrame:
    """Adds family, language and skip_reason to path and content."""
    reason = paths.skip_reason(F.col("content")) if skip else F.lit(None).cast("string")
    return files.select(
        "path",
        "content",
        F.octet_length("content").cast("long").alias("length"),
        paths.family(F.col("path")).alias("family"),
        paths.language(F.col("path")).alias("language"),
        reason.alias("skip_reason"),
    )


def read_ignore_file(spark: SparkSession, folder: str, name: str = "tesseraignore.txt") -> list[str]:
    """Entries of the ignore file, one path segment a line; 256 at most. No file, no entries.

    Its name does not start with a dot, since Spark's readers pass over such files.
    """
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        return []
    rows = spark.read.text(path).select(F.regexp_replace("value", "[\r\n]+$", "").alias("entry"))
    return [r.entry for r in rows.where("entry <> '' and not startswith(entry, '#')").limit(256).collect()]


def is_repository(folder: str) -> bool:
    done = subprocess.run(["git", "-C", folder, "rev-parse", "--git-dir"], capture_output=True)
    return done.returncode == 0


def tracked_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Relative paths that git tracks or would track."""
    listed = subprocess.run(["git", "-C", folder, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True)
    names = [(n,) for n in listed.stdout.decode(errors="replace").split("\x00") if n]
    return spark.createDataFrame(names, "relative string")


def read_folder(spark: SparkSession, folder: str, use_git: bool | None = None) -> DataFrame:
    """Source files of a folder, without those that are ignored; an empty table if there are none."""
    folder = folder.rstrip("/") or "/"
    entries = read_ignore_file(spark, folder)
    # without content nothing is opened, so what is left out costs its place in the listing alone
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("uri"))
    root = F.regexp_replace(F.lit(os.path.abspath(folder)), "/+$", "")
    found = listed.withColumn("path", F.regexp_replace("uri", "^file:/*", "/"))
    relative = F.substr(F.col("path"), F.char_length(root) + 2)
    found = found.withColumn("relative", relative).where(paths.is_source(F.col("path")))
    if is_repository(folder) if use_git is None else use_git:
        found = found.join(tracked_paths(spark, folder), "relative", "left_semi").where(~paths.is_ignored(F.col("relative"), entries))
    else:
        hidden = F.exists(paths.segments(F.col("relative")), lambda s: s.startswith("."))
        found = found.where(~hidden & ~paths.in_folders(F.col("relative")) & ~paths.is_ignored(F.col("path"), entries))
    kept = [_literal(r.uri) for r in found.select("uri").toLocalIterator()]  # Spark's own listing is on the driver as well
    if not kept:
        return described(spark.createDataFrame([], "path string, content binary"))
    read = spark.read.format("binaryFile").load(kept)
    return described(read.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"))


def _literal(path: str) -> str:
    """A path whose signs are no pattern to Spark's readers."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.format("binaryFile").load(path)
    return described(read.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"))


def from_bytes(spark: SparkSession, rows: list[tuple[str, bytes]], skip: bool = False) -> DataFrame:
    """Given contents under given names, as from standard input; they are not skipped by default."""
    return described(spark.createDataFrame(rows, "path string, content binary"), skip)


def virtual(rows: DataFrame, path: Column, text: Column, skip: bool = False) -> DataFrame:
    """Rows of any table as files."""
    return described(rows.select(path.alias("path"), F.coalesce(text, F.lit("")).cast("binary").alias("content")), skip)


def analysed(files: DataFrame) -> DataFrame:
    return files.where("skip_reason is null")


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.EXTENSIONS), "extension string, family string, language string")
