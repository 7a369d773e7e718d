"""A project in batches against one scan of all its files."""

import random

from pyspark.sql import functions as F

from tessera.operators import duplicates as D
from tessera.operators import scores
from tessera.plans import analysis, crafted
from tessera.sources import files as sources
from tessera.streaming import project, watch
from tests.test_copy_index import functions

SF = "/root/testdata/sf0.001"


def project_files(spark):
    """Near copies and copies in files of their own, a file without functions, one that is skipped, and names that repeat."""
    bodies = functions(seed=7, families=8, each=4)
    texts = [f"export function load{i}(input) {{\n{b}\n}}\n" for i, b in enumerate(bodies)] + [f"export function same() {{\n{bodies[0]}\n}}\n"] * 3
    random.Random(1).shuffle(texts)
    named = [(f"src/f{i % 30}.ts", t.encode()) for i, t in enumerate(texts)]
    return sources.from_bytes(spark, [*named, ("src/plain.ts", b"let x = 1;\n"), ("src/a.js", b"a\x00b")], True)


def batches(files, n):
    return [files.where(F.pmod(F.xxhash64("path", "content"), F.lit(n)) == i) for i in range(n)]


def pairs_by_text(functions, pairs):
    f = functions.select("func_ord", F.sha2("body", 256).alias("t"))
    both = pairs.join(f.toDF("a", "ta"), "a").join(f.toDF("b", "tb"), "b")
    return sorted((*sorted((r.ta, r.tb)), round(r.ncd, 2)) for r in both.collect())


def test_three_batches_equal_one_scan(spark, tmp_path):
    files = project_files(spark)
    options = analysis.Options(index=None)
    for epoch, batch in enumerate(batches(files, 3)):
        project.add_batch(batch, str(tmp_path), epoch, options)
    got = project.project_of(spark, str(tmp_path), options)
    dup = analysis.duplicates(files, options)
    want = scores.project(analysis.scan(files, options)).crossJoin(dup.ratio).first().asDict()
    assert want["funcs_in_dup"] > 10
    near = lambda r: {k: round(v, 9) for k, v in r.items()}
    assert near(got["overview"].first().asDict()) == near(want)
    shown = lambda t: sorted((r.path, r.label, round(r.raw_score, 6), r.code_lines, [s.signal for s in r.signals]) for r in t.collect())
    assert shown(got["files"]) == shown(analysis.scan(files, options))
    sizes = lambda t: sorted((r.size, r.label) for r in t.collect())
    assert sizes(got["clusters"]) == sizes(dup.clusters)


def test_index_in_batches_finds_what_all_pairs_find(spark, tmp_path):
    files = project_files(spark)
    for epoch, batch in enumerate(batches(files, 4)):
        project.add_batch(batch, str(tmp_path), epoch)
    stored = spark.read.parquet(f"{tmp_path}/functions")
    got = set(pairs_by_text(stored, spark.read.parquet(f"{tmp_path}/pairs")))
    exact = analysis.duplicates(files, analysis.Options(index=None))
    # an index links each copy to the least of its class: texts tell what is linked
    want = set(pairs_by_text(exact.functions, exact.pairs))
    different = lambda found: {x[:2] for x in found if x[0] != x[1]}
    assert different(got) <= different(want) and len(different(got)) >= 0.95 * len(different(want))
    again = project.project_of(spark, str(tmp_path))["overview"].first()
    assert again.funcs_in_dup >= 0.95 * exact.ratio.first().funcs_in_dup


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    files = project_files(spark)
    first, second = batches(files, 2)
    project.add_batch(first, str(tmp_path), 0)
    project.add_batch(second, str(tmp_path), 1)
    count = lambda: [spark.read.parquet(f"{tmp_path}/{x}").count() for x in ("functions", "sketches", "pairs", "metrics")]
    before = count()
    project.add_batch(second, str(tmp_path), 1)
    assert count() == before and before[2] > 10


def test_no_pairs_of_earlier_rows(spark):
    rows = [(i, f"one two three four five six {i // 2} " + "x y z " * 20, 100) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string, n long")
    own = D.sketches(df, "id", "text", "n", None)
    met = {(r.a, r.b) for r in D.later_candidates(own.where("id >= 8"), own.where("id < 8"), 8).collect()}
    assert met == {(a, b) for b in range(8, 12) for a in range(b)}
    later = {(r.a, r.b) for r in D.pair_candidates(df, "id", "n", None, first=8).collect()}
    assert later == met


def test_stream_of_a_folder(spark, tmp_path):
    """An empty batch, a batch without functions, and files that come while the query runs."""
    (tmp_path / "in").mkdir()
    body = "\n".join(f"  const value{i} = input.part{i} + other.part{i} * {i};" for i in range(12))
    (tmp_path / "in/a.ts").write_text("let x = 1;\n")
    query = project.scan_stream(watch.watch_folder(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        query.processAllAvailable()
        one = project.project_of(spark, str(tmp_path / "out"))
        assert one["files"].count() == 1 and one["overview"].first().total_funcs == 0
        for name in ("b", "c"):
            (tmp_path / f"in/{name}.ts").write_text(f"export function fetch_{name}(input, other) {{\n{body}\n}}\n")
            query.processAllAvailable()
    finally:
        query.stop()
    got = project.project_of(spark, str(tmp_path / "out"))
    assert got["files"].count() == 3
    assert [(r.size, r.label) for r in got["clusters"].collect()] == [(2, "nearly identical")]
    assert got["overview"].first().ratio == 1.0
    project.add_batch(sources.from_bytes(spark, [("x.js", b"a\x00b")], True), str(tmp_path / "out"), 9)
    assert project.project_of(spark, str(tmp_path / "out"))["files"].count() == 3


def test_clusters_of_three_batches(spark):
    rows = lambda q: sorted(map(tuple, q(spark, SF).collect()))
    assert rows(crafted.stream_duplicates) == rows(crafted.crafted_duplicates)
