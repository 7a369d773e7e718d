import numpy as np
import pytest

from tessera.llm.embedding_dedup import Cells, near_duplicates


def brute(rows, threshold):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            ok.append(i)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ok:
        for j in ok:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def vectors(seed, n=260, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(20)] + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.25])
        rows.append(((i * 37) % 1009, v.tolist(), int(rng.integers(3))))
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(5)]
    rows += [(3000, None, 1), (3001, [0.0] * d, 1), (3002, [None] + [1.0] * (d - 1), 1), (3003, [float("nan")] * d, 1), (3004, rows[0][1], None), (3005, [], 1), (3006, rows[0][1][:5], 0), (3007, [3 * x for x in rows[0][1]], rows[0][2]), (3008, [float("inf")] * d, 0)]
    return rows


@pytest.mark.parametrize("p", [Cells(), Cells(per_cell=20, block=16, sample=100), Cells(threshold=0.9, per_cell=40)])
def test_against_brute_force(spark, p):
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as cell", "2 as rep").repartition(4)
    assert sorted(map(tuple, near_duplicates(df, p).collect())) == brute(rows, p.threshold)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    rows = [(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.component_id, r.kept) for r in got} >= {(1, 1, True), (2, 1, False)} and len(got) == 3


def test_labels_that_differ_late_and_cells(spark):
    rng = np.random.default_rng(5)
    long = "x" * 70
    rows = [(1, [1.0, 2.0], long + "a"), (2, [1.0, 2.0], long + "b"), (3, [1.0, 2.0], long + "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1)}
    x = rng.normal(size=(1500, 12))
    x[700:] = x[:800] + rng.normal(size=(800, 12)) * rng.choice([0.01, 0.15, 0.3], size=(800, 1))
    rows = [(i, [float(np.float32(a)) for a in v], i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for p in (Cells(), Cells(per_cell=4, block=64)):
        assert sorted(map(tuple, near_duplicates(df, p).collect())) == brute(rows, p.threshold)
