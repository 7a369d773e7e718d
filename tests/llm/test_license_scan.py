import random
import re

import duckdb
import pytest

from tessera.llm import license_scan as L

MARKED = 'use of <<var;name="x";words="1-3">> is free <<beginOptional>>for all <<beginOptional>>people<<endOptional>><<endOptional>> under rule <<var;name="v";match="2|2 0|3">> here'


def accepted(template, words):
    """By the regular expression of the template, tried from each place."""
    pattern, out = re.compile(L.as_regex(template)), []
    for i in range(len(words)):
        m = pattern.match("".join(w + " " for w in words[i:]))
        out.append(bool(m))
    return out


@pytest.mark.parametrize("text, fits", [
    ("Use of THIS, is free; under rule 2 here", True),
    ("use of a b c is free for all under rule 2.0 here", True),
    ("use of a b c d is free under rule 3 here", False),
    ("use of a is free for all people under rule 3 here", True),
    ("use of a is free people under rule 3 here", False),
    ("use of a is free for all people under rule 4 here", False),
    ("use of a is free for under rule 2 here", False),
    ("use of is free is free under rule 2 here", True),
])
def test_regions(text, fits):
    assert (L.compiled(MARKED).accepts(L.words_of(text), 0) >= 0) == fits


def test_automata_against_regular_expressions():
    r = random.Random(12)
    for label, template in L.TEMPLATES + (("x", MARKED),):
        automaton = L.compiled(template)
        vocab = L.words_of(L._MARK.sub(" ", template)) + ["a", "2", "0", "nc", "licensed", "released"]
        sure = [w for part in L.parse(template) for w in (part.words if isinstance(part, L.Text) else part.options[0] if isinstance(part, L.Choice) else ["x"] * part.least if isinstance(part, L.Any_) else ())]
        for _ in range(40):
            words = [r.choice(vocab) for _ in range(8)] + list(sure) + [r.choice(vocab) for _ in range(8)]
            if r.random() < 0.5:
                words[r.randrange(len(words))] = "zz"
            assert [automaton.accepts(words, i) >= 0 for i in range(len(words))] == accepted(template, words)
        assert automaton.accepts(list(sure), 0) >= 0


@pytest.mark.parametrize("bad", ["a <<beginOptional>> b", "a <<endOptional>>", '<<var;name="x";words="0-2">> a', 'a <<var;name="x";words="3-2">> b', "a <<alt>> b"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        L.compiled(bad)


def test_query_against_sql(spark, tmp_path):
    r = random.Random(3)
    pieces = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "licensed under the apache\nlicense, version 2.0", "cc by", "CC-BY gnu general public", "© 2020 Élan, Inc. All rights reserved", "Copyright (c) 2020 Élan, Inc. All rights reserved.", "the of and this", "permission is hereby granted", "mit license mit license", "KKelvin İ cc by", "licensed under the cc0 1.0", "licensed under", "released under mit license"]
    rows = [(0, None), (1, ""), (2, " .,;"), (3, "cc"), (4, "x " * 20_000 + "cc by"), (None, "cc by"), (5, pieces[0]), (5, pieces[0])]
    rows += [(i, r.choice((" ", "\n", ". ", "")).join(r.choice(pieces) for _ in range(r.randrange(9)))) for i in range(10, 200)]
    df = spark.createDataFrame([(d, t, "l", [1]) for d, t in rows], "doc_id long, text string, labels string, base array<int>")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op12_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select distinct doc_id, text from '{tmp_path}/documents.parquet/*.parquet' where doc_id is not null")
    want = con.sql(L.OP12_SQL)
    expected = set(want.fetchall())
    assert len({x[6] for x in expected}) > 30
    found = list(map(tuple, got.select(want.columns).collect()))
    assert len(found) == len(rows)
    assert {x for x in found if x[0] is not None} == expected
    assert [x for x in found if x[0] is None] == [(None, 2, 1, 0, 0, "cc-by", "cc-by", 0.5)]


def test_spans_and_empty(spark):
    docs = spark.createDataFrame([(1, "Note: released under the MIT License. Copyright (c) 2020 A B, all rights reserved!")], "doc_id long, text string")
    row = L.scan_licenses(docs).first()
    assert [tuple(x) for x in row.matches] == [("mit", 1, 5), ("all-rights-reserved", 6, 8)] and [tuple(x) for x in row.base] == [("mit", 4, 2)]
    assert L.scan_licenses(docs.where("false")).count() == 0
