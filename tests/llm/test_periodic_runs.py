import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs
from tessera.llm.periodic_runs import Periods, runs


def brute(x, exponent=4, least=6):
    """Runs by the definition: maximal stretches of each period, without those of a smaller period."""
    n, out = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(x[y] == x[y + d] for y in range(i, i + size - d)) for d in range(1, q))
            if size >= max(least, exponent * q) and not smaller:
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples():
    r = random.Random(13)
    yield from ([], [1], [1] * 5, [1] * 6, [1] * 300, [1, 2] * 40, [1, 1, 2] * 30 + [1, 1, 3] * 30)
    for _ in range(400):
        base, parts = r.randrange(1, 5), []
        for _ in range(r.randrange(1, 6)):
            unit = [r.randrange(base) for _ in range(r.randrange(1, 12))]
            parts += (unit * r.randrange(1, 8))[: r.randrange(1, 60)]
            parts += [r.randrange(base + 3) for _ in range(r.randrange(4))]
        yield parts
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b  # a word of many squares
    unit = [r.randrange(1000) for _ in range(257)]
    yield [7, 8] + unit * 4 + unit[:100] + [9]


def test_runs_by_brute_force():
    for x in samples():
        assert runs(np.array(x, np.int64)) == brute(x), x
        assert runs(np.array(x, np.int64), Periods(3, 4)) == brute(x, 3, 4), x


def test_least_exponent():
    with pytest.raises(ValueError):
        Periods(exponent=2)


def test_work_grows_with_the_length():
    """A hot text: one word, and one phrase, 200,000 times."""
    for unit in ([1], [1, 2, 3, 1, 2], list(range(3000))):
        x = np.array(unit * (200_000 // len(unit)), np.int64)
        assert runs(x) == [(0, len(x), len(unit))]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    own = brute(words)
    gone = {i for s, size, q in own for i in range(s + q, s + size)}
    top = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (
        doc_id, len(own), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in own).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_by_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "a " * 50), (4, "no break no break " * 9), (None, "x y x y x y x y"), (None, None), (3, "a " * 50)]
    rows += [(i, " ".join(r.choice(("the", "été")) for _ in range(r.randrange(150)))) for i in range(10, 150)]
    df = spark.createDataFrame([(d, t, "p", [1]) for d, t in rows], "doc_id long, text string, period string, runs array<int>")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path))
    want = [expected(d, t) for d, t in rows]
    assert sum(w[1] for w in want) > 40
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "say it again again again again again again ok")], "doc_id long, text string")
    row = periodic_runs.find_runs(docs).first()
    assert row.collapsed == "say it again ok" and [tuple(x) for x in row.runs] == [(2, 6, 1)]
    assert periodic_runs.find_runs(docs.where("false")).count() == 0
