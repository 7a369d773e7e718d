"""Files as a stream: what is found in a file depends on that file alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import findings
from tessera.sources.files import described
from tessera.sources.staging import released

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """New source files of a folder as they come."""
    read = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)
    read = read.where(paths.is_source(F.col("path")))
    return described(read.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"))


def check_stream(files: DataFrame, target: str, checkpoint: str, include_general: bool = False):
    """Findings of each batch of new files, in a folder of its own below the target; a batch that is run again replaces its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        with released():  # a stream runs on and on
            findings.check(batch, include_general).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
