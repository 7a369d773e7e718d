import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import conversation_trie as T


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute(convs):
    """Nodes by their definition."""
    if not convs:
        return set()
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        subtree = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in subtree if not any(y[:-1] == x for y in members if y)]
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        out.add((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(x[:-1] == node for x in members if x), len(leaves),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in subtree if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    wide = [(*r, "x", [1]) for r in rows]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, turns string, depth array<int>")


def conversations(seed, n=60):
    r, rows = random.Random(seed), []
    for c in [*range(n), 100, 200, 203, 250, 307, -5, -100, -101, 10**12 + 1]:
        if r.random() < 0.9:
            size = r.choice((1, 2, 3, 4, 6, 9, 30))
            rows += [(c, t, r.choice("ua"), r.choice(("", "hi", "été", "why?", None)) if t > 1 or r.random() < 0.3 else "hello") for t in range(size)]
    return rows


def same(found, want):
    rows = list(map(tuple, found.select(COLUMNS).collect()))
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_by_brute_force(spark, tmp_path, seed):
    rows = conversations(seed) + [(7, None, None, None), (8, None, "u", "first"), (None, 0, "u", "lost"), (9, 50, None, "x"), (9, 50, "a", "x")]
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for parts, merge in (("4", "true"), ("7", "false"), ("64", "false")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
        try:
            same(T.op11_conversation_trie(spark, str(tmp_path)), brute(rebuilt(rows)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def trie_of(convs, ranges):
    """The scan alone: sequences dealt into ranges, then the spines, without Spark."""
    import numpy as np

    number = {}
    own = {c: [(number.setdefault(t, len(number)), len(t[1])) for t in turns] for c, turns in convs.items()}
    distinct = {}
    for c in sorted(own):
        distinct.setdefault(tuple(own[c]), []).append(c)
    order, edges, spines = sorted(distinct), [], []
    arrays = lambda s: (np.array([(t, t) for t, _ in s], np.int64).reshape(-1, 2), np.array([n for _, n in s], np.int64))
    cut = sorted(random.Random(ranges).sample(range(len(order) + 1), min(ranges, len(order))))
    for part, (a, b) in enumerate(zip([0, *cut], [*cut, len(order)])):
        scan = T.Scan(whole=False)
        for s in order[a:b]:
            scan.add(*arrays(s), [(len(s), len(distinct[s]), distinct[s][0], 0, 0, 0, distinct[s][0])])
        scan.finish()
        edges += T._edges(scan, part)
        spines += [(s, scan.hangers[side], 2 * part + side) for side, s in enumerate((order[a], order[b - 1])) if scan.hangers[side]] if a < b else []
    last = T.Scan(whole=True)
    for s, hangers, spine in sorted(spines):
        last.add(*arrays(s), hangers, spine)
    last.finish()
    answers = {(s, d): c for s, d, c in last.answers}
    edges += T._edges(last, 0)
    out = set()
    for e in edges:
        parent = answers[e["spine"], e["spine_depth"]] if "spine" in e else e["parent_conv_id"]
        for i, chars in enumerate(e["below"]):
            depth = e["top"] + 1 + i
            foot = depth == e["depth"]
            ids = [c for c in own if foot and e["end_id"] is not None and own[c] == own[e["end_id"]]]
            out.add((e["conv_id"], depth, parent if i == 0 else e["conv_id"], e["n_convs"], e["n_children"] if foot else 1, e["n_leaves"], e["saved"] + (e["n_convs"] - 1) * chars, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()))
    return out


def test_scan_over_ranges():
    for seed in range(150):
        convs = rebuilt(conversations(seed, n=seed % 25))
        want = brute(convs)
        for ranges in (0, 1, 2, 5, 20):
            assert trie_of(convs, ranges) == want, (seed, ranges)


def test_edges_are_compressed():
    import numpy as np

    scan = T.Scan(whole=True)
    long = np.arange(2000, dtype=np.int64).repeat(2).reshape(-1, 2)
    other = long.copy()
    other[1000:] += 5000
    for i, s in enumerate((long, other)):
        scan.add(s, np.ones(2000, np.int64), [(2000, 1, i, 0, 0, 0, i)])
    scan.finish()
    assert sorted((e[0], e[1]) for e in scan.edges) == [(0, -1), (1000, 0), (2000, 1000), (2000, 1000)]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(T.OP11_SQL)
    got = T.op11_conversation_trie(spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    same(got, set(want.select(", ".join(COLUMNS)).fetchall()))


def test_empty_and_only_turnless(spark):
    assert T.trie(T.lent(T.sequences(frame(spark, [])))).count() == 0
    assert T.trie(T.lent(T.sequences(frame(spark, [(None, 1, "u", "a")])))).count() == 0
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    rows = [(c, 0, "u", "a")]  # its base is absent
    same(T.trie(T.lent(T.sequences(frame(spark, rows)))), {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())})
