"""Rules on small files of our own; each row says what must and what must not be found."""

import subprocess

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import duplicates as D
from tessera.operators import lexer, scores
from tessera.plans import analysis, render, samples
from tessera.sources import files as sources
from tessera.sources import history, settings


@pytest.fixture(scope="module")
def found(spark):
    rows = samples.sample_findings(spark, "").collect()
    return [(r.path, r.kind, r.line, r.message) for r in rows]


EXPECTED = [
    ("app/users.ts", "narration", 4, '"// First, we read the row"'),
    ("app/users.ts", "over-wrap", 8, "redundant null check on 'row_data' (already checked at line 7)"),
    ("app/users.ts", "over-wrap", 30, "try/catch nested 3 deep in deep()"),
    ("app/users.ts", "as-any", 6, '"as any" cast hides the type'),
    ("app/users.ts", "ts-directive", 12, "@ts-ignore hides a type error"),
    ("app/users.ts", "zombie-param", 5, "parameter 'unusedFlag' in loadUser() is never used"),
    ("app/users.ts", "unused-import", 2, "imported name 'Shape' not used in file"),
    ("app/users.ts", "magic-string", 22, 'string "some repeated text" repeated 3 times'),
    ("app/users.ts", "dead-code", 16, "neverCalled() defined but never referenced (4 lines)"),
    ("app/users.ts", "dead-code", 21, "alsoNever() defined but never referenced (5 lines)"),
    ("app/users.ts", "dead-code", 0, "2 unused functions, 9 dead lines total"),
    ("app/store.go", "err-suppress", 10, "error is dropped"),
    ("app/store.go", "err-suppress", 12, "error is dropped"),
    ("app/store.go", "unused-import", 6, "imported name 'log' not used in file"),
    ("app/store.go", "dead-code", 16, "helperOnly() defined but never referenced (3 lines)"),
    ("app/tool.py", "narration", 8, "\"    # Next, we look at the arguments\""),
    ("app/tool.py", "ts-directive", 9, '"noqa" hides a check'),
    ("app/tool.py", "unused-import", 2, "imported name 'search' not used in file"),
    ("app/tool.py", "zombie-param", 20, "parameter 'second' in _left_over() is never used"),
    ("lib/list.c", "dead-code", 5, "hidden() defined but never referenced (3 lines)"),
    ("app/run.sh", "narration", 2, '"# Step 1: build"'),
]


@pytest.mark.parametrize("row", EXPECTED, ids=lambda r: f"{r[0]}:{r[1]}:{r[2]}")
def test_found(found, row):
    assert row in found


def test_nothing_else_is_dead_or_unused(found):
    dead = {(p, m.split("(")[0]) for p, k, line, m in found if k == "dead-code" and line}
    assert {d for d in dead if not d[1].startswith("_left")} == {("app/users.ts", "neverCalled"), ("app/users.ts", "alsoNever"), ("app/store.go", "helperOnly"), ("lib/list.c", "hidden")}
    assert not any(p == "app/generated.ts" for p, *_ in found)
    assert not any(k == "unused-import" and ("http" in m or "readRow" in m or "'os'" in m) for _, k, _, m in found)


def check_one(spark, name, text):
    files = sources.from_bytes(spark, [(name, text.encode())])
    return [(r.kind, r.line) for r in analysis.check(files, analysis.Options(include_general=True)).collect()]


QUIET = [
    ("a.ts", "// Firstly\n// Finalize it\n// first-time\n// Next-gen\nconst u = 'http://x';\n"),
    ("b.go", "package b\nfunc TestThing(t *T) {\n\tcall(t)\n}\nfunc BenchmarkIt(b *B) {\n\tcall(b)\n}\n"),
    ("c.ts", "@Decorated()\nclass A {\n  ngOnInit() {\n    this.x = 1;\n  }\n}\n"),
    ("d.c", "struct point {\n  int x;\n};\nenum e { A, B };\nint f(int n)\n{\n  return n;\n}\n"),
    ("e.c", "void g(int unused_value) {\n  (void)unused_value;\n  work();\n}\n"),
    ("f.py", "def main():\n    pass\n"),
    ("empty.ts", ""),
    ("comment.ts", "// only a comment"),
]


@pytest.mark.parametrize("name,text", QUIET, ids=[n for n, _ in QUIET])
def test_quiet(spark, name, text):
    assert check_one(spark, name, text) == []


def test_lexer():
    code, kinds = lexer.classify(b"a // b 'c'\n'x // y' /* m\nn */ z `q\n`", "c-like")
    assert code == b"a         \n" + b" " * 13 + b"\n     z   \n "
    assert len(kinds) == len(code)
    assert lexer.classify(b"x = '''a # b''' # c", "python")[0] == b"x =" + b" " * 16
    assert lexer.classify(b"echo ${x#y} # z", "shell")[0] == b"echo ${x#y}    "


def test_functions(spark):
    rows = samples.sample_functions(spark, "").collect()
    got = {(r.path, r.name): (r.start_line, r.end_line) for r in rows}
    assert got[("app/users.ts", "loadUser")] == (5, 14)
    assert got[("app/users.ts", "deep")] == (27, 39)
    assert got[("app/tool.py", "value_of")] == (13, 19)
    assert got[("app/tool.py", "_left_over")] == (20, 23)
    assert got[("lib/list.c", "hidden")] == (5, 7)
    assert not any(n == "node" for _, n in got)


def test_duplicates(spark):
    files = samples.sample_files(spark)
    dup = analysis.duplicates(files)
    rows = dup.clusters.collect()
    assert len(rows) == 1 and rows[0]["size"] == 2 and rows[0].min_ncd < 0.3
    assert render.exit_of_duplicates(dup.clusters) == 2
    ratio = dup.ratio.first()
    assert ratio.funcs_in_dup == 2 and 0 < ratio.ratio <= 1


def test_pair_join_equals_the_nested_loop(spark):
    import random

    r = random.Random(2)
    rows = [(i, r.randrange(1, 2000), r.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, n long, g string")
    got = {(x.a, x.b) for x in D.pair_candidates(df, "id", "n", "g").collect()}
    want = {(a, b) for a, n, g in rows for b, m, h in rows if a < b and g == h and max(n, m) <= 2 * min(n, m)}
    assert got == want


def test_scores(spark):
    assert S.prior_llr(0.5) == S.prior_llr(0.999) == 0 and round(S.prior_llr(0.8), 4) == 1.3863
    # a worked example: the sum of its signals and the score
    c = F.lit
    values = spark.range(1).select(
        S.sigmoid(c(9.0766) / 2).alias("p"),
        S.spearman([c(0.0), c(1.0), c(2.0), c(3.0)]).alias("up"),
        S.spearman([c(1.0), c(1.0), c(1.0), c(1.0)]).alias("flat"),
        S.gradient(c(40), c(8), c(40), c(2)).alias("fades"),
    ).first()
    assert abs(values.p - 0.98942) < 1e-4 and values.up == 1.0 and values.flat == 0.5 and values.fades
    files = sources.from_bytes(spark, [("a.ts", b"// nothing\n")])
    row = analysis.scan(files, analysis.Options(prior=0.8), project=False).first()
    assert [s.signal for s in row.signals] == ["insufficient code"] and abs(row.raw_score - 1.3863) < 1e-3


def test_json_and_tables(spark):
    scored = analysis.scan(samples.sample_files(spark)).cache()
    assert '"signals":[{"group":"regularity"' in scores.as_json(scored).where("path = 'app/users.ts'").first().json
    assert render.file_table(scored).count() == 7
    assert render.signal_table(scores.signals(scored)).count() > 70
    assert scores.project(scored).first().exit_code in (0, 1, 2)


def test_folder_history_and_settings(spark, tmp_path):
    (tmp_path / "src/vendor").mkdir(parents=True)
    for name, text in {"src/a.py": "x = 1\n", "src/vendor/b.py": "y = 1\n", "src/c.min.js": "z", "src/d e.ts": "let q = 1;\n", "src/skipme/e.go": "package e\n", "tesseraignore.txt": "# none\nskipme\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda df: sorted(r.path.split("/")[-1] for r in df.collect())
    assert names(sources.read_folder(spark, str(tmp_path))) == ["a.py", "d e.ts"]
    git = ["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x"]
    subprocess.run([*git[:3], "init", "-q"], check=True)
    subprocess.run([*git, "add", "src/a.py"], check=True)
    subprocess.run([*git, "commit", "-qm", "feat(x): add a\n\nbecause"], check=True)
    assert names(sources.read_folder(spark, str(tmp_path))) == ["a.py", "b.py", "d e.ts"]
    style = history.commit_style(history.read_commits(spark.createDataFrame([("src/a.py",)], "path string"), str(tmp_path))).first()
    assert style.multiline_ratio == 1 and style.conventional_ratio == 1 and style.messages == 1
    (tmp_path / "cal.json").write_text('{"temperature": 0.01, "signals": {"ccr": {"mu_ai": 1, "sigma_ai": 1, "mu_h": 0, "sigma_h": 1}}}')
    assert not settings.load(spark, str(tmp_path / "cal.json")).loaded


def test_calibration(spark):
    rows = {r.signal: r for r in samples.calibration_parse(spark, "").collect()}
    assert rows["regularity"].sigma_h == 0.1 and rows["dup"].sigma_ai == 0.01 and rows["decay"].mu_h == 0.01


def test_stream(spark, tmp_path):
    from tessera.streaming import watch

    import os

    tables = lambda: {x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("table-")}
    before = tables()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ts").write_text("// First, we go\nlet x = 1;\n")
    query = watch.check_stream(watch.watch_folder(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["narration"]
    assert tables() == before  # a batch leaves no tables behind


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io
    import json

    from tessera import cli

    (tmp_path / "a b.ts").write_text("// First, we go\nexport const x = 1;\n")
    (tmp_path / "empty").mkdir()
    assert cli.main(["nonsense"]) == 1 and cli.main(["check", str(tmp_path / "none")]) == 1 and cli.main(["--version"]) == 0
    assert cli.main(["check", str(tmp_path / "a b.ts")]) == 2 and "narration" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "empty")]) == 0 and "no issues found" in capsys.readouterr().out
    assert cli.main(["dupes", str(tmp_path)]) == 0
    capsys.readouterr()
    assert cli.main(["scan", "--json", str(tmp_path)]) in (0, 1, 2)
    found = json.loads(capsys.readouterr().out)
    assert found["calibrated"] is False and found["files"][0]["file"].endswith("a b.ts")
    stdin = type("In", (), {"buffer": io.BytesIO(b"let x = 1;\n")})()
    monkeypatch.setattr("sys.stdin", stdin)
    assert cli.main(["scan", "--stdin", "--lang=js", "--json"]) in (0, 1, 2)
    assert json.loads(capsys.readouterr().out)[0]["file"] == "<stdin>.js"


def test_analyse_keeps_skipped_files(spark):
    rows = {r.path: r for r in samples.sample_analysis(spark, "").collect()}
    assert rows["app/generated.ts"].skipped and rows["app/generated.ts"].raw_score is None
    assert rows["app/users.ts"].findings > 5


@given(st.binary(max_size=200).map(lambda b: b.translate(bytes(b"ab \n\"'`/*#\\{}()"[i % 15] for i in range(256)))), st.sampled_from(["c-like", "python", "shell"]))
def test_lexer_keeps_places(content, family):
    code, kinds = lexer.classify(content, family)
    assert len(code) == len(kinds) == len(content)
    for c, x, k in zip(content, code, kinds):
        assert (c == 10) == (k == 10) and (x == c if k in b"0\n" else x == 32)


def findings_of(spark, name, text):
    rows = analysis.check(sources.from_bytes(spark, [(name, text.encode())]), analysis.Options(include_general=True)).collect()
    return [(r.kind, r.line, r.message) for r in rows]


def test_strings_by_their_tokens(spark):
    got = findings_of(spark, "a.ts", 'f("x" + separator + "y");\n' * 3 + 'g("tab\\tseparated value");\n' * 3 + "h(`over\ntwo lines`);\n" * 3 + "k('only twice here'); k('only twice here');\n")
    assert [x for x in got if x[0] == "magic-string"] == [("magic-string", 4, 'string "tab\\tseparated value" repeated 3 times'), ("magic-string", 7, 'string "over\ntwo lines" repeated 3 times')]


def test_parameters_over_several_lines(spark):
    go = "export function go(\n  usedOne: Map<string, number>,\n  neverUsed: Array<[string, number]>,\n  callback: (a: string, b: number) => void\n) {\n  return usedOne + callback + go.length;\n}\n"
    got = {m for k, _, m in findings_of(spark, "a.ts", go) if k == "zombie-param"}
    assert got == {"parameter 'neverUsed' in go() is never used"}
    py = "def work(\n    used,\n    never_used=(1, 2),\n):\n    return used + 1 + 2 + 3\n\n\nwork(1)\n"
    assert {m for k, _, m in findings_of(spark, "a.py", py) if k == "zombie-param"} == {"parameter 'never_used' in work() is never used"}
    c = "int f(int first, void *second,\n      int third) {\n  (void)second;\n  return first + 10;\n}\n"
    assert {m for k, _, m in findings_of(spark, "a.c", c) if k == "zombie-param"} == {"parameter 'third' in f() is never used"}


def test_errors_dropped_in_go(spark):
    go = "package main\n\nfunc run() {\n\tvalue, _ := load()\n\t_ = fmt.Sprintf(\"%v\", value)\n\t_ = closeErr()\n\tfor _, x := range value {\n\t\tuse(x)\n\t}\n}\n"
    assert [x[1] for x in findings_of(spark, "a.go", go) if x[0] == "err-suppress"] == [4, 6]


def test_equal_imports_have_their_own_lines(spark):
    text = "import { Thing } from 'a';\nconst x = 1;\nimport { Thing } from 'b';\nexport default x;\n"
    files = sources.from_bytes(spark, [("a.ts", text.encode()), ("b.py", b"import os\nimport sys\nimport os\nprint(1)\n")])
    tables = lexer.tables(files)
    from tessera.operators.findings import imports

    got = sorted((r.path, r.line, r.name) for r in imports(tables.lexed, tables.lines).collect())
    assert got == [("a.ts", 1, "Thing"), ("a.ts", 3, "Thing"), ("b.py", 1, "os"), ("b.py", 2, "sys"), ("b.py", 3, "os")]


def test_static_is_looked_for_in_five_lines(spark):
    """The line of the brace and the four before it; an attribute exports a static function."""
    def dead(text):
        return [m for k, _, m in findings_of(spark, "a.c", text) if k == "dead-code"]

    body = "{\n  return 1 + 2;\n}\n"
    assert dead("static\nint\nfirst(\n  int a)\n" + body) == ["first() defined but never referenced (3 lines)"]
    assert dead("static\nint\nfirst(\n  int a,\n  int b)\n" + body) == []
    assert dead("static __attribute__((used)) int first(int a) " + body) == []
    assert dead("int first(int a) " + body) == []


def test_report_and_json_lex_once(spark, tmp_path, capsys, monkeypatch):
    from tessera import cli

    calls, lex = [], lexer.lex
    monkeypatch.setattr(lexer, "lex", lambda files: calls.append(1) or lex(files))
    body = "\n".join(f"  const value{i} = input.part{i} + other.part{i} * {i};" for i in range(12))
    for n in ("a", "b"):
        (tmp_path / f"{n}.ts").write_text(f"export function fetch_{n}(input, other) {{\n{body}\n  return value1;\n}}\n")
    cli.main(["scan", "--json", str(tmp_path)])
    assert '"dup_ratio":1.0000' in capsys.readouterr().out and len(calls) == 1
    cli.main(["report", str(tmp_path)])
    assert "fetch_b()" in capsys.readouterr().out and len(calls) == 2


def test_python_functions_end(spark):
    text = "def a():\n    x = 1\n\n    def inner():\n        return 2\n    return inner\nvalue = 3\nasync def b():\n    pass\n"
    got = sorted((r.start_line, r.end_line, r.name) for r in lexer.tables(sources.from_bytes(spark, [("a.py", text.encode())])).functions.collect())
    assert got == [(1, 3, "a"), (4, 5, "inner"), (8, 10, "b")] or got == [(1, 3, "a"), (4, 5, "inner"), (8, 9, "b")]


def test_listing_report_and_calibration_file(spark, tmp_path, capsys, monkeypatch):
    from tessera import cli

    body = "\n".join(f"  const value{i} = input.part{i} + other.part{i} * {i};" for i in range(12))
    (tmp_path / "a.ts").write_text(f"export function fetchOne(input, other) {{\n{body}\n  return value1;\n}}\n")
    (tmp_path / "b.ts").write_text(f"export function fetchTwo(input, other) {{\n{body}\n  return value2;\n}}\n")
    assert cli.main(["dupes", str(tmp_path)]) == 2
    text = capsys.readouterr().out
    assert "cluster 1 - NCD 0.0" in text and "b.ts:1\tfetchTwo()\t[15 lines]" in text and "a.ts:1\tfetchOne()" in text
    pairs = {k: {"mu_ai": 0.5, "sigma_ai": 0.1, "mu_h": 0.4, "sigma_h": 0.1} for k in ("regularity", "ccr", "cond", "ident")}
    import json

    (tmp_path / "tessera-calibration.json").write_text(json.dumps({"version": 1, "temperature": 3.5, "signals": pairs}))
    monkeypatch.chdir(tmp_path)
    assert cli.main(["report", str(tmp_path)]) in (0, 1, 2)
    text = capsys.readouterr().out
    assert all(x in text for x in ("OVERVIEW", "SUMMARY", "METHODOLOGY", "DUPLICATE LISTING", '"temperature","value":3.5', "How even line lengths"))
