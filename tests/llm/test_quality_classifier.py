import zlib

import numpy as np

from tessera.llm.quality_classifier import NAMES, Ranking, features, op2_quality_classifier, rank

SF = "/root/testdata/sf0.01"


def test_features_of_single_texts_and_batches():
    texts = [b"", b"One two three\nOne two three\n", "été ## 12, x!".encode(), b" \n ", b"a" * 5000]
    one = np.concatenate([features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    both = features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    assert both.shape == (5, len(NAMES)) and np.allclose(one, both)
    assert both[1][NAMES.index("new_lines")] == 0.5 and both[1][NAMES.index("distinct")] == 0.5


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op2_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in own) >= 0.93 * len(own)


def test_edge_rows(spark):
    docs = [(i, ("Good words of a text. " * 5) if i % 2 else "x### y$$$ z%%% " * 5, 1) for i in range(200)]
    docs += [(500, None, 1), (501, "", 1), (None, "Good words of a text.", 1), (502, "long " * 200_000, 1), (1, docs[1][1], 1)]
    labels = [(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0), (3, 1, 0), (999, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, label int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = rank(df, lab).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[4].predicted == 0 and by[5].predicted == 1 and by[None].held_out is False
    assert rank(df.limit(0), lab).count() == 0
    none = rank(df, lab.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert rank(docs, labels, Ranking(sample=30, pairs=500)).count() == docs.count()


def brute_features(text):
    """The same measures, one text at a time, by plain loops."""
    import math
    import re

    from tessera.llm.quality_classifier import CLASSES

    data = (text or "").encode()
    shares = [0.0] * (len(CLASSES) + 2)
    for b in data:
        k = next((i for i, c in enumerate(CLASSES) if b in c), None)
        shares[k if k is not None else len(CLASSES) + (b > 127)] += 1 / len(data)
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = re.findall(rb"[^\n]*\n|[^\n]+$", data)
    grams = list(zip(w, w[1:], w[2:]))
    n, some = len(w), max(len(w), 1)
    rest = [math.log1p(n), sum(map(len, w)) / some, sum(len(x) > 20 for x in w) / some, sum(len(x) <= 3 for x in w) / some, sum(65 <= x[0] <= 90 for x in w) / some]
    return shares + rest + [len(set(w)) / some, len(set(w)) / math.sqrt(some), len(set(grams)) / max(len(grams), 1), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1)]


def test_scores_by_brute_force(spark):
    """Features by loops, the logistic loss of the pairs by plain descent, scores and cut by their definition."""
    from tessera.llm.quality_classifier import fit

    r = np.random.default_rng(4)
    good = [" ".join(r.choice(["Some", "words", "of", "a", "fine", "text.", "été"], 30)) + "\nMore." for _ in range(60)]
    poor = [" ".join(r.choice(["x###", "12", "<b>", "Some", "words", "|"], r.integers(1, 40))) for _ in range(40)]
    texts = good + poor + ["", None]
    x = np.array([brute_features(t) for t in texts])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, quality int")
    p = Ranking(pairs=3000)
    got = {g.doc_id: g for g in rank(docs, labels, p).collect()}
    learn = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    learn.sort(key=lambda i: got[i].doc_id)
    label = np.array([int(i < 60) for i in learn])
    model = fit(x[learn], label, p)
    # the order of the sample decides which pairs are drawn, so scores are compared by rank and the loss by value
    mine = np.array([got[i].score for i in range(102)])
    brute_strength = np.array([sum(model.weights[k][sum(e <= v for e in model.edges[k])] for k, v in enumerate(row)) for row in x])
    assert np.allclose(brute_strength, model.strength(x))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(brute_strength + model.shift, -50, 50))))
    assert np.corrcoef(np.argsort(np.argsort(mine[:100])), np.argsort(np.argsort(model.score(x)[:100])))[0, 1] > 0.9
    # the cut is the quantile of the label share: as many learned documents fall below it as are labelled 0
    below = sum(mine[i] < 0.3 for i in learn)
    assert abs(below - int((label == 0).sum())) <= 1
    # plain full descent over all pairs of the same binned features does not find a much smaller loss
    hot = np.stack([np.eye(model.weights.shape[1])[[sum(e <= v for e in model.edges[k]) for k, v in enumerate(row)]].ravel() for row in x[learn]])
    a, b = np.nonzero(label == 1)[0], np.nonzero(label == 0)[0]
    diff = (hot[a][:, None, :] - hot[b][None, :, :]).reshape(-1, hot.shape[1])
    w = np.zeros(hot.shape[1])
    for _ in range(300):
        w += diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff)
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean()
    assert loss(model.weights.ravel()) <= loss(w) + 0.05


def test_features_by_brute_force(spark):
    texts = ["", "One two three\nOne two three\n", "été ## 12, x!", " \n ", "a" * 5000, "A-b \"c\" <d>\n\n\n|", "One\x0bTwo\x0cTHREE four four four four"]
    from tessera.llm.quality_classifier import document_features

    got = {r.doc_id: r.features for r in document_features(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")).collect()}
    for i, t in [*enumerate(texts), (99, None)]:
        assert np.allclose(got[i], brute_features(t)), t
