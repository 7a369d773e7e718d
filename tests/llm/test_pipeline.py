import corpus_pipeline as cp
from tests.llm.test_pipeline_whole import brute_cut, brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_classifier", "jaccard_join", "suffix_array_dedup", "packing"]
    for name, work in cp.STAGES:
        before = docs.collect()
        docs = work(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS) and len(rows) == len({r.doc_id for r in rows})
        if name == "language_id":
            assert {r.doc_id for r in before if any(c.isalpha() for c in r.text) and len(r.text) > 80} <= {r.doc_id for r in rows}
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
            assert len({r.doc_id for r in rows} & set(good)) >= 0.97 * len(good)
        if name == "jaccard_join":
            assert {r.doc_id for r in rows} == brute_near([(r.doc_id, r.text) for r in before], 5, 80)
        if name == "suffix_array_dedup":
            want = brute_cut([(r.doc_id, r.text) for r in before], 400, 51)
            for r in rows:
                kept = want[r.doc_id]
                assert r.n_chars == len(r.text) and 0 <= len(r.text.encode()) - len(kept) <= 60  # characters that stay whole
        if name == "packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "Words of a text that has no id at all.", "en", "s", 3), (4, "12 34", None, None, None), (5, "One text with words.", "en", "s", 1), (5, "One text with words.", "en", "s", 1)]
    rows += [(10 + i, f"More text number {i} with words of its own.", "en", "s", 9) for i in range(20)] + [(40 + i, "x### y$$$ z%%% " * 5, "en", "s", 9) for i in range(20)]
    labels = [(10 + i, 1, 0) for i in range(20)] + [(40 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}
    assert {5, 10, 11, None} <= got and not {1, 2, 4, 40} & got
    assert cp.run(spark, SF).count() > 50


def test_empty_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], schema)
    for name, work in cp.STAGES:
        assert work(spark, empty, str(tmp_path)).count() == 0
    rows = [(i, f"A text with words of its own, number {i}.", "en", "s", 9) for i in range(30)] + [(50, None, "en", "s", 0), (51, "", None, None, None), (None, "A text that has no id.", None, "s", 3), (3, "A text with words of its own, number 3.", "en", "s", 9)]
    odd = spark.createDataFrame(rows, schema).selectExpr("*", "1 as score", "'x' as lang_pred", "2 as row", "3 as seed", "4 as digest", "5 as kept", "6 as least", "7 as region")
    plain = spark.createDataFrame(rows, schema)
    for name, work in cp.STAGES:
        key = lambda r: str([v for k, v in r.asDict().items() if k not in ("sequence_id", "offset", "step_id", "start", "length", "ids_crc32", "tier")])
        a, b = (sorted({key(r) for r in work(spark, x, str(tmp_path)).collect()}) for x in (odd, plain))
        assert a == b, name


def test_rows_without_id_go_by_their_own_text(spark, tmp_path):
    good, bad = [f"More text number {i} with words of its own." for i in range(30)], [f"x### y$$$ z%%% {i} " * 5 for i in range(30)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, bad[3]), (None, bad[3]), (None, bad[4]), (None, "y### z$$$ x%%% 9 " * 5), (None, good[5]), (None, good[5])]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.classify_quality(spark, df, str(tmp_path)).collect()
    assert sorted(r.text for r in got if r.doc_id is None) == [good[5], good[5]]
    assert {r.doc_id for r in got} - {None} == set(range(30))


def test_languages_are_found_and_strange_texts_go(spark):
    en = ["the quick brown fox jumps over the lazy dog and runs away", "this is a text about the weather of today", "people like to read good books in the evening"]
    fr = ["le renard brun saute par dessus le chien paresseux", "ceci est un texte qui parle du temps de demain", "les gens aiment lire de bons livres le soir"]
    rows = [(i, (en if i % 2 else fr)[i % 3], "en" if i % 2 else "fr", "s", 1) for i in range(60)]
    rows += [(100, en[0], None, "s", 1), (101, fr[1], "en", "s", 1), (102, "\u4e2d\u6587\u5b57\u7b26 \u6ca1\u6709\u5b66\u8fc7 " * 8, None, "s", 1), (103, "123 456", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in cp.identify_language(spark, df, "").collect()}
    assert {i: got.get(i) for i in range(60)} == {i: "en" if i % 2 else "fr" for i in range(60)}
    assert got[100] == "en" and got[101] == "fr" and 102 not in got and 103 not in got
