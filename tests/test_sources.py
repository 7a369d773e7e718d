import os
import subprocess

from pyspark.sql import functions as F

from tessera.sources import files, history


def test_skipped_files_are_not_opened(spark, tmp_path):
    """Files of more than 2 GB, which Spark can list but not read, where the walk leaves them out."""
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules" / "deep").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a" / "one.py").write_text("x = 1\n")
    (tmp_path / "a" / "odd [1] {b}*.ts").write_text("const x = 1;\n")
    (tmp_path / "a" / "with space.go").write_text("package a\n")
    for name in ("node_modules/deep/big.js", "a/blob.bin", ".hidden/big.py", "a/big.min.js"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(3 << 30)  # a hole, no bytes on disk
    got = {r.path: bytes(r.content) for r in files.read_folder(spark, str(tmp_path), use_git=False).collect()}
    assert got == {f"{tmp_path}/a/one.py": b"x = 1\n", f"{tmp_path}/a/odd [1] {{b}}*.ts": b"const x = 1;\n", f"{tmp_path}/a/with space.go": b"package a\n"}
    (tmp_path / "empty").mkdir()
    assert files.read_folder(spark, str(tmp_path / "empty"), use_git=False).count() == 0


def git(folder, *arguments):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=a", "-c", "user.email=a@b", *arguments], check=True, capture_output=True)


def test_history_by_ranges_of_commits(spark, tmp_path):
    git(tmp_path, "init", "-q")
    (tmp_path / "sub").mkdir()
    expected = {"a.py": [], "sub/b c.py": [], "é.py": []}
    for i in range(45):
        name = list(expected)[i % 2 if i < 44 else 2]
        (tmp_path / name).write_text(f"{i}\n")
        message = f"feat: step {i}\n\nwith a body" if i % 3 else f"step {i}"
        git(tmp_path, "add", "-A")
        git(tmp_path, "commit", "-q", "-m", message)
        expected[name].insert(0, message)
    rows = history.read_history(spark, str(tmp_path), 10)
    assert rows.rdd.getNumPartitions() == 5  # processes follow the commits, not the paths
    assert rows.count() == 45
    paths = spark.createDataFrame([(f"{tmp_path}/a.py",), ("sub/b c.py",), ("é.py",), ("no.py",), ("a.py",)], "path string")
    got = {}
    for r in history.read_commits(paths, str(tmp_path), 10).orderBy("path", "rank").collect():
        got.setdefault(r.path, []).append(r.message)
    assert got == {f"{tmp_path}/a.py": expected["a.py"][:20], "a.py": expected["a.py"][:20], "sub/b c.py": expected["sub/b c.py"][:20], "é.py": expected["é.py"]}
    below = history.read_commits(spark.createDataFrame([("b c.py",)], "path string"), str(tmp_path / "sub"))
    assert below.count() == 20
    style = history.commit_style(history.read_commits(paths, str(tmp_path)))
    assert style.where(F.col("path") == "é.py").first().multiline_ratio == float("\n" in expected["é.py"][0])


def test_no_history(spark, tmp_path):
    assert history.read_history(spark, str(tmp_path)).count() == 0
    git(tmp_path, "init", "-q")
    assert history.read_history(spark, str(tmp_path)).count() == 0 and os.path.isdir(tmp_path / ".git")
