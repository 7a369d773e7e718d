"""Near copies by the index of shingles, against all pairs of similar size."""

import random
from hashlib import md5

from pyspark.sql import functions as F

from tessera.operators import duplicates as D


def functions(seed=4, families=25, each=5):
    """Bodies of code in families: lines are changed, added and left out, and names are replaced."""
    r, rows = random.Random(seed), []
    names = [f"{a}{b}" for a in ("user", "order", "item", "total", "path", "cache", "row", "node") for b in ("Id", "_list", "Count", "s", "Map")]
    for f in range(families):
        lines = [f"  const {r.choice(names)} = {r.choice(names)}.{r.choice(names)}({r.randrange(50)}, '{r.choice(names)}');" for _ in range(r.randrange(8, 25))]
        for _ in range(each):
            own = [x for x in lines if r.random() > 0.05]
            own = [x.replace(r.choice(names), r.choice(names)) if r.random() < 0.15 else x for x in own]
            rows.append("\n".join(own))
    r.shuffle(rows)
    return list(dict.fromkeys(rows))  # copies have a test of their own


def pairs(spark, bodies, index, threshold=0.3):
    df = spark.createDataFrame([(i, b.encode()) for i, b in enumerate(bodies)], "func_ord long, body binary")
    return {(x.a, x.b) for x in D.compression_pairs(df, threshold, None, index=index).collect()}


def test_recall_on_functions(spark):
    bodies = functions()
    every, found = pairs(spark, bodies, None), pairs(spark, bodies, D.Index())
    assert len(every) > 120 and found <= every
    assert len(found) >= 0.95 * len(every), (len(found), len(every))


def test_recall_and_number_of_candidates_on_documents(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("octet_length(text) between 200 and 4000").dropDuplicates(["text"])
    rows = texts.select(F.col("doc_id").alias("func_ord"), F.col("text").cast("binary").alias("body"), "text", F.octet_length("text").alias("size")).cache()
    every = {(x.a, x.b) for x in D.compression_pairs(rows, 0.3, None).collect()}
    found = {(x.a, x.b) for x in D.compression_pairs(rows, 0.3, None, index=D.Index()).collect()}
    assert found <= every and len(found) >= 0.9 * len(every)
    all_sizes, met = D.pair_candidates(rows, "func_ord", "size", None).count(), D.index_candidates(rows, "func_ord", "text", "size", None).count()
    assert met < 0.2 * all_sizes


def test_candidates_grow_with_the_rows(spark):
    """A line that all share, and a group of near copies: what is met grows as the rows do."""
    def met(n):
        rows = [(i, f"the same line for all of them {'x ' * 40} and then {i % 50} {i} {i * 7 % 97} {i * 13 % 89}", 100) for i in range(n)]
        return D.index_candidates(spark.createDataFrame(rows, "id long, text string, size int"), "id", "text", "size", None).count()

    assert met(4000) < 5 * met(1000)


def test_copies_are_one_class(spark):
    body = "const value = compute(total, count);\n" * 8 + "return value;"
    assert pairs(spark, [body] * 30, D.Index()) == {(0, i) for i in range(1, 30)}
    rows = spark.createDataFrame([(1, "", 5, "c"), (2, None, 5, "c"), (3, "one two", None, "c"), (4, "one two", 4, None), (5, " \n", 4, "c")], "id long, text string, size int, g string")
    assert D.index_candidates(rows, "id", "text", "size", "g").count() == 0


def test_least_hashes_in_slices(monkeypatch):
    """The hashes do not depend on where a text is sliced, and are those of its shingles."""
    index = D.Index(tokens=3, sketch=20)
    words = [random.Random(n).choice(["a", "b_1", "é", "+", "日本", "("]) for n in range(200)]
    for n in (0, 1, 2, 3, 4, 9, 200):
        own = words[:n]
        text = "\t".join(own).encode()
        shingles = {" ".join(own[i : i + 3]) for i in range(max(n - 2, 1))} if n else set()
        want = sorted(int(md5(s.encode()).hexdigest()[:15], 16) for s in shingles)[:20]
        for size in (4, 5, 7, 1 << 16):
            monkeypatch.setattr(D, "SLICE", size)
            assert D.least_hashes(text, index).tolist() == want, (n, size)


def test_hubs_connect_what_after_connects(spark):
    rows = [(i, f"{'a line of all ' * 3} {i % 7} x {i % 11} y {i % 5}", 40 + (i * 31) % 300) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, size int")
    index = D.Index(near=3, posted=5, piece=64)
    met = D.index_neighbours(D.index_lists(df, "id", "text", "size", None, index), index=index).cache()
    got = {frozenset((x.a, x.b)) for x in D.pairs_of(met, "after").collect()}
    assert got == {frozenset((x.a, x.b)) for x in D.pairs_of(met, "before").collect()} and got
    whole, thin = ({(x.node, x.component) for x in D.components(D.pairs_of(met, c)).collect()} for c in ("after", "hubs"))
    assert whole == thin
