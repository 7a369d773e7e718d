import hashlib
import random
from collections import defaultdict
from dataclasses import replace

import pytest

from tessera.llm import substring_dedup as sub
from tessera.llm import suffix_array_dedup as suf


def brute_bytes(docs, width):
    where = defaultdict(set)
    data = {d: (t or "").encode() for d, t in docs}
    for d, b in data.items():
        for i in range(len(b) - width + 1):
            where[b[i : i + width]].add((d, i))
    out = {}
    for d, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if len(where[b[i : i + width]]) > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, kept)
    return out


def brute_words(docs, width):
    least, split = {}, {d: (t or "").encode().split() for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(d, least.get(k, d))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["a", "b", "é", "cc", "d\t", "e\n"]
    phrases = [[r.choice(vocab) for _ in range(r.randrange(5, 60))] for _ in range(8)]
    docs = [(0, None), (1, ""), (2, " \n\t "), (3, "aaaaaaaa" * 9), (4, "aaaaaaaa" * 9)]
    for d in range(5, n):
        words = []
        for _ in range(r.randrange(0, 6)):
            words += r.choice(phrases) if r.random() < 0.6 else [r.choice(vocab) + str(r.randrange(30)) for _ in range(r.randrange(20))]
        docs.append((d * 7 % n + 5 if d % 2 else 1000 + d, " ".join(words)))
    seen = {}
    for d, t in docs:
        seen.setdefault(d, t)
    return list(seen.items())


@pytest.mark.parametrize("limit", [4096, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, limit):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, spans string").repartition(5)
    p = replace(suf.BYTES, width=24, seed=6, group_limit=limit, batch=20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suf.remove_repeats(df, p).collect()}
    assert got == brute_bytes(docs, 24)
    p = replace(sub.WORDS, width=10, seed=3, group_limit=limit, batch=20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sub.remove_repeated_words(df, p).collect()}
    assert got == brute_words(docs, 10)


def test_production_parameters(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9)))
    passage = " ".join(word() for _ in range(120))
    docs = []
    for d in range(30):
        t = " ".join(word() for _ in range(r.randrange(200)))
        docs.append((d, t + (" " + passage[: r.randrange(300, len(passage))] + " " if d % 3 == 0 else "") + " ".join(word() for _ in range(40))))
    docs.append((99, docs[0][1]))
    docs.append((100, "long " * 60_000 + passage))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suf.remove_repeats(df).collect()}
    assert got == brute_bytes(docs, 400)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in sub.remove_repeated_words(df).collect()}
    assert got == brute_words(docs, 50)


def test_empty_table_and_odd_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, seed long, lo int")
    assert suf.remove_repeats(empty).count() == 0
    assert sub.remove_repeated_words(empty).count() == 0
    long = "word " * 500
    df = spark.createDataFrame([(None, long, "s"), (None, None, None), (7, "short", "s"), (8, long, "s")], "doc_id long, text string, source string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suf.remove_repeats(df, carry=("source",), whole_characters=True).collect()}
    assert got == {(None, 2500): 0, (None, 0): 0, (7, 5): 0, (8, 2500): 2500}
    got = {(r.doc_id, r.n_words): r.n_removed for r in sub.remove_repeated_words(df).collect()}
    assert got == {(None, 500): 0, (None, 0): 0, (7, 1): 0, (8, 500): 0}


def test_queries_on_a_table(spark, tmp_path):
    docs = corpus(5)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suf.op3_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (a, b, hashlib.sha256(k).hexdigest()) for d, (a, b, _, k) in brute_bytes(docs, 400).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sub.op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (a, b, hashlib.sha256(k.encode()).hexdigest()) for d, (a, b, k) in brute_words(docs, 50).items()}


def test_repeated_and_missing_ids(spark):
    """Each row is searched and cut by itself; a row without an id counts as an occurrence and keeps its own bytes."""
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    p, q, alone = text(80), text(80), text(80)
    rows = [(1, p), (1, q), (2, alone), (3, q + " tail of three"), (None, alone), (4, p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in suf.remove_repeats(df).collect())
    want = [("1", len(p), len(p)), ("1", len(q), len(q)), ("2", len(alone), len(alone)), ("3", len(q) + 14, len(q)), ("4", len(p), len(p)), ("None", len(alone), 0)]
    cut = {x[:2]: x[2] for x in got}
    assert sorted(cut) == sorted(w[:2] for w in want)
    for d, n, gone in want:  # the blank before a tail may repeat by chance; no other byte may
        assert cut[d, n] in (gone, gone + 1), (d, n)
    got = sorted((str(x.doc_id), x.n_words, x.n_removed) for x in sub.remove_repeated_words(df).collect())
    assert got == [("1", 80, 0), ("1", 80, 0), ("2", 80, 0), ("3", 83, 80), ("4", 80, 80), ("None", 80, 0)]


def test_long_words_that_sums_cannot_tell_apart(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, a + " " + rest[:150]), (2, b + " " + rest[:150])], "doc_id long, text string")
    p = replace(sub.WORDS, width=10, seed=3)
    got = {x.doc_id: x.n_removed for x in sub.remove_repeated_words(df, p).collect()}
    assert got == {1: 0, 2: len(rest[:150].split())}


def test_hot_passage_in_many_contexts(spark):
    """One passage in more different surroundings than a group may have: every level of prefixes is needed."""
    r = random.Random(11)
    passage = [f"p{i}" for i in range(14)]
    docs = []
    for d in range(300):
        before, after = ([f"{r.choice('abc')}{r.randrange(40)}" for _ in range(r.randrange(8))] for _ in range(2))
        docs.append((d, " ".join(before + passage[r.randrange(3) : 14 - r.randrange(3)] + after)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    p = replace(sub.WORDS, width=10, seed=3, group_limit=20, batch=30)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in sub.remove_repeated_words(df, p).collect()} == brute_words(docs, 10)
    p = replace(suf.BYTES, width=30, seed=8, group_limit=20, batch=30)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suf.remove_repeats(df, p).collect()} == brute_bytes(docs, 30)
