import random
import re
from collections import defaultdict
from dataclasses import replace

import pytest

import corpus_pipeline as cp
from tessera.llm import suffix_array_dedup as suf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], SCHEMA).repartition(3)


def brute_near(docs, n, least):
    """The ids that stay: the least of each group linked by n-word shingles."""
    sets, root = [], list(range(len(docs)))
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return {min(g) for g in groups.values()}


def test_near_copies_by_five_words(spark):
    base = [f"w{i}" for i in range(100)]
    edited = ["x" if i in (30, 70) else w for i, w in enumerate(base)]  # 0.81 by five words, 0.885 by three
    far = ["y" if i % 20 == 10 else w for i, w in enumerate(base)]
    docs = [(4, " ".join(base)), (7, " ".join(edited)), (9, " ".join(far))]
    assert {r.doc_id for r in cp.drop_near_copies(spark, frame(spark, docs), "").collect()} == {4, 9}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id for r in cp.drop_near_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert got == brute_near(docs, 5, 80) != brute_near(docs, 3, 90)


def test_repeated_rows_keep_one_whole_text(spark):
    r = random.Random(1)
    long, other, lone = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(90)) for k in "abc")
    docs = [(5, long), (5, long), (5, long), (6, other), (6, None), (6, ""), (7, "short"), (None, lone), (None, lone)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], SCHEMA).repartition(4)
    kept = cp.drop_near_copies(spark, df, "")
    assert kept.columns == list(cp.COLUMNS)
    rows = [(x.doc_id, x.text, x.n_chars) for x in cp.cut_repeats(spark, kept, "").collect()]
    assert len(long) > 400 and sorted(rows, key=str) == sorted([(d, t, len(t)) for d, t in ((5, long), (6, other), (7, "short"), (None, lone), (None, lone))], key=str)


def brute_cut(docs, width, n_words):
    """Bytes left when repeated strings of width bytes and repeated runs of n_words words are gone."""
    data = {d: t.encode() for d, t in docs}
    spans = {d: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for d, b in data.items()}
    where = defaultdict(list)
    for d, b in data.items():
        for i in range(len(b) - width + 1):
            where[b[i : i + width]].append((d, i, i + width))
        for i in range(len(spans[d]) - n_words + 1):
            run = spans[d][i : i + n_words]
            where[tuple(b[x:y] for x, y in run)].append((d, run[0][0], run[-1][1]))
    gone = {d: bytearray(len(b)) for d, b in data.items()}
    for places in where.values():
        for d, x, y in places if len(places) > 1 else ():
            gone[d][x:y] = b"\1" * (y - x)
    return {d: bytes(c for c, g in zip(b, gone[d]) if not g) for d, b in data.items()}


def passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij\u00e9") for _ in range(r.randrange(3, 7)))
    shared = [[word() for _ in range(n)] for n in (50, 51, 64, 80)]
    docs = []
    for d in range(40):
        words = [word() for _ in range(r.randrange(60))] + shared[d % 4] + [word() for _ in range(r.randrange(60))]
        docs.append((d, "".join(w + r.choice([" ", " ", "  ", "\n"]) for w in words)))
    solid = "".join(word() for _ in range(200))  # over 400 bytes, one word
    return docs + [(50, solid + " one"), (51, "two " + solid), (52, ""), (53, "k " * 60), (54, "k " * 60)]


def test_passages_of_over_50_words(spark):
    docs = passages(4)
    want = brute_cut(docs, 400, 51)
    got = {r.doc_id: r.text.encode() for r in cp.cut_repeats(spark, frame(spark, docs), "").collect()}
    assert got == want
    assert all(len(want[d]) < len(t.encode()) for d, t in docs if d < 40 and d % 4)


@pytest.mark.parametrize("limit", [4096, 3])
def test_passages_in_crowded_groups(spark, limit):
    docs = passages(5)
    p, q = (replace(x, group_limit=limit, batch=20) for x in (replace(suf.BYTES, width=60, seed=12), replace(cp.PASSAGES, width=12, seed=3)))
    got = {r.doc_id: bytes(r.kept) for r in suf.remove_repeats(frame(spark, docs), p, passages=q).collect()}
    assert got == brute_cut(docs, 60, 12)


def test_cut_repeats_on_a_table(spark):
    df = cp.drop_near_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    want = brute_cut([(r.doc_id, r.text) for r in df.collect()], 400, 51)
    for r in cp.cut_repeats(spark, df, SF).collect():
        assert 0 <= len(r.text.encode()) - len(want[r.doc_id]) <= 60  # characters that stay whole


def test_least_cosines_count_all_rows(spark):
    """The score of rank ceil(n / 100) among all rows of a language, at any number of rows, ties and repeated ids included."""
    from pyspark.sql import functions as F

    sizes = {"aa": 30_001, "bb": 25_000, "cc": 101, "dd": 1}
    score = (F.lit(0.2) + F.round(F.rand(7), 6) * F.rand(8)).alias("score")
    parts = [spark.range(n).select(F.lit(k).alias("lang_pred"), F.when(F.col("id") % 3 == 0, F.lit(0.71)).otherwise(F.least(F.round(score, 9), F.lit(1.0))).alias("score")) for k, n in sizes.items()]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = spark.createDataFrame(rows.collect(), "lang_pred string, score double").repartition(5)
    own = defaultdict(list)
    for r in rows.collect():
        own[r.lang_pred].append(r.score)
    want = {k: sorted(v)[-(-len(v) // 100) - 1] * cp.COSINE_SHARE for k, v in own.items()}
    got = {r.lang_pred: r.least for r in cp.least_cosines(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_language_threshold_reads_every_labelled_row(spark):
    """Above 20,000 labelled rows one weak text in 60 still sets the threshold, whatever its hash: a sample of ids without them would reject it."""
    from pyspark.sql import functions as F

    from tessera.llm import language_id

    usual, weak = "the quick brown fox jumps over the lazy dog and runs away from it " * 2, "zyxw vutsr qponm lkjih gfedc bazyx wvuts rqpon mlkji hgfed cbazy xwvut " * 2
    taken = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << 40)) < int(0.75 * (1 << 40))  # ids that a sample of 20,000 of these rows takes
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when((F.col("id") % 15 == 0) & ~taken, weak).otherwise(usual).alias("text"))
    df = rows.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(1 as long) as n_chars")
    n_weak = df.where(F.col("text") == weak).count()
    learned = df.where(~language_id.held_out())
    assert learned.count() > 20_000 and learned.where(F.col("text") == weak).count() > 0.011 * learned.count()
    kept = cp.identify_language(spark, df, "")
    assert kept.where(F.col("text") == weak).count() == n_weak


def test_language_stage_leaves_no_texts_on_disk(spark):
    """What the stage writes for itself lies there until the session ends, if its caller does not release it: scores may, whole texts may not."""
    from pathlib import Path

    from pyspark.sql import functions as F

    from tessera.llm.common import shared_dir

    text = F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(30)])
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), text.alias("text")).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(1 as long) as n_chars")
    size = lambda: sum(x.stat().st_size for x in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    before, n_bytes = size(), df.agg(F.sum(F.length("text"))).first()[0]
    kept = cp.identify_language(spark, df, "")
    assert kept.count() == 2_000
    assert size() - before < n_bytes / 20
