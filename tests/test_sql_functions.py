from tessera.operators import lexer
from tessera.plans import sql_functions
from tessera.sources import files

TEXTS = {"a.ts": "const s = `x\n\n y`; // é\n/* b\n */ let q = 'z';\n\t\n", "b.py": 'x = """doc\nmore"""  # note\n\ny = "a" + \'b\'\n', "c.sh": "echo ${x#y} # z\n", "d.go": ""}


def test_lateral_calls_give_the_rows_of_dataframes(spark):
    sql_functions.register(spark)
    rows = files.from_bytes(spark, [(p, t.encode()) for p, t in TEXTS.items()])
    rows.createOrReplaceTempView("sources")
    lexed = lexer.lex(rows)
    got = spark.sql("SELECT path, l.line, l.at, l.kind, l.raw, l.code FROM sources, LATERAL lex_lines(content, family) l").collect()
    want = lexer.shown(lexer.lines(lexed)).select("path", "line", "at", "kind", "raw", "code").collect()
    assert len(got) > 12 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    strings = spark.sql("SELECT path, s.spot, s.text FROM sources, LATERAL lex_strings(content, family) s").collect()
    assert sorted(map(tuple, strings)) == sorted(map(tuple, lexer.shown(lexer.strings(lexed)).select("path", "spot", "text").collect()))
    assert [tuple(r) for r in spark.sql("SELECT l.line, l.kind FROM (SELECT cast(null AS string) AS t), LATERAL lex_lines(t, 'shell') l").collect()] == [(1, "blank")]
