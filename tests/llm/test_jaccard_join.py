import random
import re

import pytest

from tessera.llm import jaccard_join as jj
from tessera.llm.components import components


def brute(docs, percent):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = ["Ab", "b", "É", "cc", "dd", "e\t", "f\n"] + [f"w{i}" for i in range(300)]
    bases = [[r.choice(vocab) for _ in range(size)] for size in (1, 2, 3, 8, 12, 20, 40, 60, 80, 150, 150, 400)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "TWO one")]
    for d in range(7, n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 12])):
            at = r.randrange(len(words))
            if r.random() < 0.5:
                words[at] = r.choice(vocab)
            elif r.random() < 0.5:
                words[at:at] = [r.choice(vocab)]
            else:
                del words[at]
            words = words or ["x"]
        docs.append((d * 37 % 1009 + 10, " ".join(words)))
    return docs


@pytest.mark.parametrize("p", [jj.Join(), jj.Join(leaf=8, pivots=3), jj.Join(family_limit=8), jj.Join(percent=80, leaf=10)])
def test_against_brute_force(spark, p):
    docs = corpus(p.leaf)
    df = spark.createDataFrame([(d, t, "f") for d, t in docs], "doc_id long, text string, family string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(df, p).collect()}
    assert got == brute(docs, p.percent)


def test_empty_table_and_repeated_rows(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {k: v for k, v in got.items() if k in want} == want


def test_regions_are_made_of_a_table(spark, monkeypatch):
    """Families of documents beyond a leaf are split by pivots, also on a small table."""
    split = []
    plain = jj.Region._split

    def counted(self, members, sizes, overlap):
        done = plain(self, members, sizes, overlap)
        split.append(done)
        return done

    p = jj.Join(n=5, percent=80)
    texts = jj.numbered(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    known = jj.signatures(texts, p).cache()
    families = components(jj.candidates(known)).withColumnRenamed("component", "family")
    rows = known.select("row", "node").join(families, "node").join(texts, "row").select("family", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r.family, set()).add(r.text)
    monkeypatch.setattr(jj.Region, "_split", counted)
    for own in by.values():
        data = [t.encode() for t in sorted(own)]
        offsets = jj.np.cumsum([0] + [len(x) for x in data])
        sets = jj.shingle_sets(jj.np.frombuffer(b"".join(data), jj.np.uint8), offsets, p.n)
        jj.Region(sets, p).join(jj.np.arange(len(sets)))
    assert sum(split) > 0


@pytest.mark.parametrize("limit", [16, 40])
def test_one_large_group(spark, limit):
    """A group of near copies with outliers, larger than a task's limit: pivots meet it by a shuffle, level after level."""
    r = random.Random(limit)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for d in range(320):
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            words[r.randrange(60)] = f"x{r.randrange(500)}"
        docs.append((d, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for percent in (80, 90):
        p = jj.Join(percent=percent, family_limit=limit, pivots=4)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jj.jaccard_components(df, p).collect()} == brute(docs, percent)


def test_rows_of_one_id_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (3, "g h i j k l"), (None, "m n o p q"), (None, "m n o p q"), (8, long), (9, long + " end"), (7, None)]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", 4, "5"), ("5", 4, "3"), ("3", 4, "3"), ("None", 3, "None"), ("None", 3, "None"), ("8", 199_998, "8"), ("9", 199_999, "8"), ("7", 0, "7")])
