from collections import defaultdict
from dataclasses import replace

import pytest

from tessera.llm import suffix_array_dedup as suf
from tessera.llm.repeat_groups import maximal_repeats
from tests.llm.test_repeats import brute_bytes, corpus


def brute_repeats(docs, width):
    """Every maximal repeat of at least width bytes, with the set of its places."""
    data = {i: (t or "").encode() for i, (_, t) in enumerate(docs)}
    where = defaultdict(list)
    for d, b in data.items():
        for i in range(len(b) - width + 1):
            where[b[i : i + width]].append((d, i))
    seen = set()
    for places in where.values():
        for x, (d, i) in enumerate(places):
            for e, j in places[:x]:
                lo = hi = 0
                while i - lo > 0 and j - lo > 0 and data[d][i - lo - 1] == data[e][j - lo - 1]:
                    lo += 1
                while i + hi < len(data[d]) and j + hi < len(data[e]) and data[d][i + hi] == data[e][j + hi]:
                    hi += 1
                seen.add(data[d][i - lo : i + hi])
    out = {}
    for s in seen:
        found = set()
        for d, b in data.items():
            at = b.find(s)
            while at >= 0:
                found.add((d, at))
                at = b.find(s, at + 1)
        out[s] = found
    return out


@pytest.mark.parametrize("limit", [4096, 4])
def test_maximal_repeats(spark, limit):
    docs = [(i, t) for i, (_, t) in enumerate(corpus(3, 40)) if not (t or "").startswith("aaaa")]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    width = 24
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    p = replace(suf.BYTES, width=width, seed=6, group_limit=limit, batch=20)
    data = {d: (t or "").encode() for d, t in docs}
    groups, covered = defaultdict(set), {d: bytearray(len(b)) for d, b in data.items()}
    for r in maximal_repeats(df, p).collect():
        groups[r.repeat, r.n_symbols].add((r.doc_id, r.start))
        covered[r.doc_id][r.start : r.start + r.n_symbols] = b"\1" * r.n_symbols
    want = brute_repeats(docs, width)
    strings = {}
    for (_, n), places in groups.items():
        text = {data[d][i : i + n] for d, i in places}
        assert len(text) == 1 and n >= width
        s = text.pop()
        everywhere = {(d, i) for d, b in data.items() for i in range(len(b) - n + 1) if b[i : i + n] == s}
        assert places == everywhere  # all occurrences, not only neighbours
        strings[s] = places
    assert {d: sum(c) for d, c in covered.items()} == {d: x[1] for d, x in brute_bytes(docs, width).items()}
    if limit > 100:
        short = {s for s in want if len(s) <= 2 * width}
        assert short and short <= set(strings)  # longer ones are put together from pieces where their occurrences agree
        assert any(len(s) > 2 * width and s in strings for s in want)


def test_empty(spark):
    assert maximal_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
