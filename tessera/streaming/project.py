"""A project as a stream: scores, duplicate functions and the project score of files that come batch by batch.

Each batch is lexed once and adds a folder to four tables below a target: ``functions`` (bodies with their compressed size),
``sketches`` (hashes of different bodies), ``pairs`` (near copies, of which one at least is new) and ``metrics`` (of files). A batch that
is run again replaces its own folders and reads those before it only, so a lost driver leaves nothing twice. Metrics come last:
readers take the batches that have them.

What a batch costs: its own files, the narrow columns of what came before (hashes, sizes, digests), the lists that its own
functions stand in, and the bodies of candidates. As everywhere, each row is a file of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import duplicates as D
from tessera.operators import lexer, scores
from tessera.plans import analysis
from tessera.sources.staging import released, written

#: Functions of a batch are numbered from the batch's number shifted by so many bits.
SHIFT = 40
#: Where a function stands.
PLACE = ("path", "func_idx", "name", "start_line", "end_line")


def _store(table: DataFrame, target: str, name: str, epoch: int) -> DataFrame:
    path = f"{target}/{name}/epoch={epoch}"
    table.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _stored(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{name}")


def _before(like: DataFrame, target: str, name: str, epoch: int) -> DataFrame:
    """Rows of the earlier batches, with the columns of what this one has stored."""
    return _stored(like.sparkSession, target, name).where(F.col("epoch") < epoch).select(*like.columns)


def _near_copies(functions: DataFrame, target: str, epoch: int, options: analysis.Options) -> DataFrame:
    """Pairs a < b of near copies where b is one of the batch's functions."""
    first = epoch << SHIFT
    every = _before(functions, target, "functions", epoch).unionByName(functions)
    group = None if options.cross_language else "family"
    if options.index is None:
        pairs = D.pair_candidates(every, "func_ord", "size", group, first=first)
    else:
        of = lambda t: t.select("func_ord", (F.col(group) if group else F.lit(0)).alias("g"), "digest")
        placed = of(functions).where("g is not null")
        own = written(placed.groupBy("g", "digest").agg(F.min("func_ord").alias("first")))
        # the least of a body's copies, and the batch's own first one, whose body stands for them
        least = D.large(of(every)).join(D.large(own), ["g", "digest"]).groupBy("g", "digest", "first").agg(F.min("func_ord").alias("least"))
        firsts = D.large(functions.drop("digest")).join(D.large(least.withColumnRenamed("first", "func_ord")), "func_ord")
        firsts = written(firsts)
        copies = D.same_body(placed, firsts, options.threshold).where("least < func_ord").select(F.col("least").alias("a"), F.col("func_ord").alias("b"), "ncd")
        different = firsts.where("least = func_ord").withColumn("text", F.decode("body", "ISO-8859-1"))
        own = _store(D.sketches(different, "func_ord", "text", "size", group, options.index), target, "sketches", epoch)
        pairs = D.later_candidates(own, _before(own, target, "sketches", epoch), first, index=options.index)
        return D.near_pairs(pairs, every, firsts, options.threshold).unionByName(copies)
    return D.near_pairs(pairs, every, functions, options.threshold)


def add_batch(files: DataFrame, target: str, epoch: int, options: analysis.Options = analysis.Options()) -> None:
    """Adds the files of a batch; the options must be the same for all batches of a target."""
    with released():
        tables = lexer.tables(files)
        rows = written(lexer.shown(D.numbered(tables.functions)).withColumn("body", F.encode("body", "ISO-8859-1")))
        rows = rows.withColumn("func_ord", F.col("func_ord") + F.lit(epoch << SHIFT))
        functions = _store(D.packed(rows, "family", *PLACE).withColumn("digest", F.sha2("body", 256)), target, "functions", epoch)
        _store(_near_copies(functions, target, epoch, options), target, "pairs", epoch)
        _store(lexer.shown(analysis.measured(files, options, False, tables)), target, "metrics", epoch)


def scan_stream(files: DataFrame, target: str, checkpoint: str, options: analysis.Options = analysis.Options()):
    """A query that adds the files of a stream to the tables of a target."""
    return files.writeStream.foreachBatch(lambda batch, epoch: add_batch(batch, target, epoch, options)).option("checkpointLocation", checkpoint).start()


def project_of(spark: SparkSession, target: str, options: analysis.Options = analysis.Options(), most: int | None = 20) -> dict[str, DataFrame]:
    """files (their scores, with the project's duplicates), overview, clusters and members of all batches up to now.

    The same as a scan of all files at once: equal scores where the same near copies are found. With ``Options(index=None)`` they always are; the
    index meets more of them in a stream, since a new function meets its neighbours in lists as long as they are by then.
    """
    metrics = _stored(spark, target, "metrics")
    last = metrics.agg(F.max("epoch")).first()[0]
    upto = lambda name: _stored(spark, target, name).where(F.col("epoch") <= last)
    functions, pairs = upto("functions").drop("epoch"), upto("pairs").drop("epoch")
    # numbered as in one scan: by path and place
    order = D.in_order(functions.select("path", "func_idx", "func_ord"), ["path", "func_idx", "func_ord"], "ord").select("func_ord", "ord")
    order = written(order)
    of = lambda column: order.select(F.col("func_ord").alias(column), F.col("ord").alias(f"{column}_ord"))
    pairs = D.large(pairs).join(D.large(of("a")), "a").join(D.large(of("b")), "b").select(F.least("a_ord", "b_ord").alias("a"), F.greatest("a_ord", "b_ord").alias("b"), "ncd")
    functions = D.large(functions).join(D.large(order), "func_ord").drop("func_ord").withColumnRenamed("ord", "func_ord")
    members = written(D.clusters(written(pairs)))
    ratio = D.duplicate_ratio(functions, members)
    metrics = metrics.where(F.col("epoch") <= last).crossJoin(F.broadcast(ratio.select(F.col("ratio").alias("dup_ratio"))))
    scored = scores.score_files(metrics, options.calibration, options.prior)
    found = D.large(functions).join(D.large(members), "func_ord").select("cluster", "func_ord", "path", "start_line", "end_line", "name")
    return {"files": scored, "overview": scores.project(scored).crossJoin(F.broadcast(ratio)), "clusters": D.cluster_table(pairs, members, most), "members": found, "pairs": pairs}
