import zlib

import numpy as np

from tessera.llm.language_id import Profiles, bundles, identify, letter_vector, op9_language_id

SF = "/root/testdata/sf0.001"


def brute_bundle(text, p):
    symbols = [0]
    for c in text.lower():
        x = ord(c) if c.isalpha() else 0
        if x or symbols[-1]:
            symbols.append(x)
    if symbols[-1]:
        symbols.append(0)
    out = np.zeros(p.dimensions)
    if len(symbols) < p.n or not any(symbols):
        return out
    for i in range(len(symbols) - p.n + 1):
        v = np.ones(p.dimensions)
        for k, c in enumerate(reversed(symbols[i : i + p.n])):
            v = v * np.roll(letter_vector(p, c), k)
        out += v
    return out


def test_bundles():
    p = Profiles(dimensions=64)
    texts = ["", "Éa b", "...", "x", "don't stop", "aaa aaa"]
    assert np.allclose(bundles(texts, p), [brute_bundle(t, p) for t in texts])


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !!", "fr"), (None, "hello there", "en"), (4, "hello there", None), (4, "hello there", None), (5, "x" * 300_000, "de")]
    rows += [(100 + i, "hello there my friend", "en") for i in range(8)] + [(200 + i, "bonjour mon ami cher", "fr") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as held_out")
    got = identify(df).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert pred[1] == pred[2] == pred[3] == ("und", 0.0)
    assert pred[4][0] == "en" and pred[None][0] == "en" and pred[200][0] == "fr"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert identify(df.limit(0)).count() == 0


def test_prediction_by_brute_force(spark):
    """Prototypes, cosines and the first of the best languages, from the definition, for every row."""
    p = Profiles(dimensions=64)
    rng = np.random.default_rng(8)
    letters = {"aa": "abcdeé", "bb": "cdefgh ", "cc": "xyzc -"}
    rows = [(i, "".join(rng.choice(list(letters[lang]), int(rng.integers(0, 60)))), lang) for i, lang in enumerate(rng.choice(list(letters), 60).tolist())]
    rows += [(60, None, "aa"), (61, "abc", None), (62, "12", "bb"), (63, rows[0][1], rows[0][2])]
    bundled = {i: brute_bundle(t or "", p) for i, t, _ in rows}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    prototypes = {}
    for lang in sorted(letters):
        total = sum(bundled[i] for i, t, own in rows if own == lang and t is not None and not out[i])
        prototypes[lang] = total / np.linalg.norm(total)
    want = {}
    for i in bundled:
        norm = np.linalg.norm(bundled[i])
        cosines = {lang: round(float(bundled[i] @ v / max(norm, 1)), 9) for lang, v in prototypes.items()}
        best = max(sorted(cosines), key=cosines.get)
        want[i] = (out[i], best if norm else "und", round(min(max(cosines[best], 0), 1), 6) if norm else 0.0)
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), p).collect()
    assert {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 6)) for r in got} == want and len(got) == len(rows)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in op9_language_id(spark, SF).collect() if r.held_out and r.lang_pred != "und"]
    assert len(got) > 30
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got)


def test_segments_and_slices(monkeypatch):
    """Long and varied texts are taken in segments of symbols and slices of n-grams; sums are the same."""
    from tessera.llm import language_id as li

    p = Profiles(dimensions=32)
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 500))) + " word", "", "abc def " * 40, "é"]
    want = bundles(texts, p)
    monkeypatch.setattr(li, "_SEGMENT", 37)
    monkeypatch.setattr(li, "_GRAMS", 5)
    assert np.allclose(bundles(texts, p), want) and np.allclose(want, [brute_bundle(t, p) for t in texts])


def test_memory_of_a_varied_text():
    """A text of 250,000 different n-grams takes less than 300 MB."""
    import subprocess
    import sys

    code = (
        "import resource, numpy as np\n"
        "from tessera.llm.language_id import Profiles, bundles\n"
        "bundles(['warm'], Profiles())\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "bundles([''.join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FFF, 250_000)))], Profiles())\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 300, out.stdout
