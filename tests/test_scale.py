"""Narrow tables with many rows: tasks and plans."""

from pyspark.sql import functions as F

from tessera.operators import duplicates as D
from tessera.plans import crafted
from tessera.sources import files as sources
from tessera.streaming import project


def test_narrow_rows_are_dealt_out(spark, tmp_path):
    part = spark.range(0, 200_000, 1, 1).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.lit("Brand#1").alias("p_brand"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    for files in (crafted.crafted_files, crafted.brand_files):
        sizes = files(spark, str(tmp_path)).select("path").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 20 and max(r["count"] for r in sizes) < 20_000


def test_copies_are_not_gathered_on_the_driver(spark):
    """Copies make a small file with many rows, whose size says nothing about the memory that they need."""
    body = "x = source.read(1);\n" * 12
    rows = spark.createDataFrame([(i, f"{body}{i // 10}".encode(), "c-like") for i in range(60)], "func_ord long, body binary, family string")
    found = D.compression_pairs(rows, index=D.Index())
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in found.collect()} >= {(i // 10 * 10, i) for i in range(60) if i % 10}
    exact = {(r.a, r.b): r.ncd for r in D.compression_pairs(rows).collect()}
    assert all(exact[r.a, r.b] == r.ncd for r in found.collect())


def test_a_project_of_copies_is_not_gathered_on_the_driver(spark, tmp_path):
    body = "\n".join(f"  const value{i} = input.part{i} * {i};" for i in range(12))
    files = [(f"{name}.ts", f"export function load(input) {{\n{body}\n}}\n".encode()) for name in "abc"]
    project.add_batch(sources.from_bytes(spark, files), str(tmp_path), 0)
    found = project.project_of(spark, str(tmp_path))
    for name in ("pairs", "members"):
        assert "BroadcastHashJoin" not in found[name]._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.path for r in found["members"].collect()) == ["a.ts", "b.ts", "c.ts"]
