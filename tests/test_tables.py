from tessera.operators import scores
from tessera.plans import analysis, documents, registry, tables

TEXTS = {
    1: "// First, we read\n// Next, we write\n// Then we stop\n/* a block\nof two lines */\nfunction readIt(a) {\n  // TODO later\n  return a;\n}\n",
    2: "plain words\n\nof a text\n",
    3: None,
    4: "// only a comment\n",
}


def brute(text):
    """Lines of code and of comments, and comments that narrate."""
    code = comment = narration = 0
    block = False
    for line in (text or "").split("\n"):
        x = line.strip()
        if block or x.startswith(("//", "/*")):
            comment += 1
            block = "*/" not in x if block or x.startswith("/*") else False
            narration += x.removeprefix("// ").lower().startswith(("first, we", "next, we", "then we"))
        elif x:
            code += 1
    return code, comment, narration


def write(spark, path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "// a page\nfunction onPage(x) {\n  return x;\n}\n")], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, 0, "words"), (1, 1, "// a comment")], "conv_id long, turn int, text string").write.parquet(f"{path}/conversations.parquet")


def test_scores_see_comments(spark, tmp_path):
    write(spark, tmp_path)
    got = {r.doc_id: r.code_lines for r in tables.scan_scores(spark, str(tmp_path)).collect()}
    assert got == {d: brute(t)[0] for d, t in TEXTS.items()}
    rows = scores.signals(analysis.scan(tables.document_files(spark, str(tmp_path)))).collect()
    measured = {(r.path, r.signal): r.measured for r in rows}
    for d in (1, 2):
        code, comment, narration = brute(TEXTS[d])
        assert measured[str(d), "comment-to-code"] == f"{comment / code:.2f}"
        assert measured[str(d), "narration"] == f"{'yes' if narration >= 3 else 'no'} ({narration} hits)"
        assert measured[str(d), "func length CV"] == f"n/a ({int(d == 1)} funcs)"


def test_whole_tables_are_read(spark, tmp_path):
    write(spark, tmp_path)
    at = str(tmp_path)
    assert set(tables.TABLES) <= set(registry.QUERIES)
    kinds = {}
    for r in tables.table_lines(spark, at).collect():
        kinds.setdefault(r.path, []).append(r.kind)
    for d, t in TEXTS.items():
        found = kinds[f"documents/{d}"]
        assert (found.count("code"), found.count("comment")) == brute(t)[:2]
    assert kinds["conversations/1/1"] == ["comment"] and kinds["pages/1.js"] == ["comment", "code", "code", "code", "blank"]
    names = {(r.path, r.name) for r in tables.table_functions(spark, at).collect()}
    assert {("documents/1", "readIt"), ("pages/1.js", "onPage"), ("dup/a.ts", "fetchProfile")} <= names
    want = {"pages/1.js", "conversations/1/0", "conversations/1/1", *(f"documents/{d}" for d in TEXTS)}
    assert want <= {r.path for r in tables.table_analysis(spark, at).collect()}


def test_copies_meet_by_partial_aggregates(spark, tmp_path):
    rows = [(d, "same") for d in (9, 4, 4, 7, None)] + [(1, "alone"), (2, None), (3, "")]
    spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = documents.exact_components(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(2, 2), (3, 2), (4, 4), (7, 4), (9, 4)]
    assert "Window" not in documents._copies(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_missing_ids(spark, tmp_path):
    """One row in, one row out: rows that share an id, or have none, are files of their own."""
    text = "// First, we read\nfunction readIt(a) {\n  try {\n    return a;\n  } catch (e) { }\n}\n"
    rows = [(1, text), (1, "x = 1\ny = 2\nz = 3\n"), (2, text), (2, text), (None, text), (None, text), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.code_lines) for r in tables.scan_scores(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, brute(t)[0]) for d, t in rows), key=repr)
    files = tables.document_files(spark, str(tmp_path))
    found = analysis.check(files).where("kind = 'narration'").collect()
    assert sorted((r.path[:4], r.line) for r in found) == [("1", 1), ("2", 1), ("2", 1), ("none", 1), ("none", 1)]
    done = analysis.analyse(files).collect()
    assert len(done) == len(rows) and sum(len(r.findings or []) for r in done) == 5


def test_staged_tables_go_after_a_scan(spark, tmp_path):
    import os

    from tessera.sources.staging import shared_folder

    write(spark, tmp_path)
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = tables.scan_scores(spark, str(tmp_path))
    assert len(set(os.listdir(folder)) - before) == 1  # the metrics alone
    assert found.count() == len(TEXTS)
