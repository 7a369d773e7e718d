import re
from collections import Counter

import pytest

from tessera.llm import quality_rules as q

ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a b a b a b"),
    (5, "one two three\none two three\n\n \nx"),
    (6, "é ü\xa0x # ** $%&|<>"),
    (7, "word " * 80),
    (8, "w\x0bv\x0cu\r\nz\r\nz\r"),
    (9, " ".join(f"token{i}" for i in range(60))),
    (9, " ".join(f"token{i}" for i in range(60))),
    (10, " ".join(f"tok{i}#" for i in range(60))),
    (None, "\n".join(["same line"] * 40)),
    (11, " ".join(f"t{i % 700}x" for i in range(30_000))),
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if seen[tuple(w[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup, rep = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    base = n < 50 or 100 * rep > 50 * n
    kept = not (base or 100 * symbols > 30 * n or chars < 2 * n or chars > 20 * n or 5 * dup > n)
    return n, chars, symbols, dup, rep, base, kept


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as w", "2 as n_words")
    got = q.cascade(df, report=True).collect()
    key = lambda x: (str(x[0]), x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((d, *brute(t)) for d, t in ROWS), key=key)
    short = {r.doc_id: r.kept for r in q.cascade(df).collect()}
    assert short == {r.doc_id: r.kept for r in got}


def test_order_and_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted(r.name for r in q.order_rules(df)) == sorted(r.name for r in q.RULES)
    assert q.cascade(df.limit(0), report=True).count() == 0


def test_plan_is_native(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = q.cascade(df, report=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(q.OP4_SQL)
    names = want.columns
    got = q.op4_quality_rules(spark, sf).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_rejected_rows_skip_later_rules(spark):
    """A measure that only a later rule needs is not computed for a row that an earlier one rejects."""
    from pyspark.sql import functions as F

    def costly(text, w):
        return F.when(F.size(w) < 50, F.raise_error(F.lit("computed for a rejected row")).cast("int")).otherwise(F.size(w))

    q.MEASURES["costly"] = costly
    try:
        last = q.Rule("last", ("costly",), lambda m: m["costly"] > 1_000_000)
        df = spark.createDataFrame(ROWS, "doc_id long, text string")
        rows = q._texts(df)
        order = [*q.RULES, last]
        kept = rows.select("doc_id", q.verdict(order, q.measures(F.col("text"), F.col("w"), tuple(q.MEASURES))).alias("kept")).collect()
        assert {r.doc_id: r.kept for r in kept} == {d: brute(t)[-1] for d, t in ROWS}
        with pytest.raises(Exception, match="computed for a rejected row"):
            rows.select(q.verdict([last, *q.RULES], q.measures(F.col("text"), F.col("w"), tuple(q.MEASURES)))).collect()
    finally:
        del q.MEASURES["costly"]


def test_letters_and_distinct_words(spark):
    rows = [(1, " ".join(f"{i}" for i in range(80))), (2, " ".join(f"{i}é" for i in range(80))), (3, " ".join(f"w{i} x y" for i in range(3)) + " z" * 30 + " q" * 40), (4, " ".join(f"a{i % 9}{i % 7}" for i in range(63)) + " 1" * 30)]
    got = {r.doc_id: r.kept for r in q.cascade(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    assert got[1] is False and got[2] is True
