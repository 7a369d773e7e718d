"""Embedding near-dedup: spherical k-means cells and blocked cosine products within them, exact.

Vectors are compared only within a label. Unit vectors go to the cell of the nearest centroid;
a vector visits every later cell whose members may lie within the threshold of it: two unit
vectors with cosine ``t`` are at most ``sqrt(2 - 2 t)`` apart, and so are their distances from the plane
between two centroids. So each pair within the threshold meets in the later one of its two cells and no link is
lost. A cell's vectors are dealt to blocks of about ``block`` rows, and each block is multiplied with the
cell, read as a stream; no task holds more than a block and a slice.

The number of cells grows with the root of the largest label's vectors up to ``most_cells``: more cells save products and cost
visits. Beyond (26 million vectors of a label with the defaults) the cells themselves grow, and each block is still compared with its whole
cell, so the copies of a vector grow with its cell: a bound of this form. Centroids are fitted on at most ``sample`` vectors (those with the least hash of vec_id) of at most
``sample_bytes``; every vector is assigned. Equal vectors of a label are merged first and counted.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null label, link with nothing and are kept; vectors of different lengths never link; repeated
rows link like copies; a row with a null vec_id links with nothing; an empty table gives no rows; columns other than the three are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, stage, table
from tessera.llm.components import components


@dataclass(frozen=True)
class Cells:
    threshold: float = 0.98
    per_cell: int = 100  # the largest label's vectors for the square of the number of cells
    most_cells: int = 512
    sample: int = 20_000
    sample_bytes: int = 64 << 20
    block: int = 2048
    rounds: int = 8
    seed: int = 11


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and vector (bytes of its numbers, null if it can link with nothing), and the vector's digest."""
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for label, x in zip(batch.column(1), batch.column(2)):
                data = None
                if label.is_valid and x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(v).all() and v.any():
                        most = float(np.abs(v).max())
                        data = (v / most if not single and not 1e-100 <= most <= 1e100 else v).tobytes()
                vectors.append(data)
            digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), pa.array(digests, pa.binary())], names=["vec_id", "label", "vector", "digest"])

    numbers = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), numbers.alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, vector binary, digest binary")


def _unit(column, width: int) -> np.ndarray:
    """Unit vectors in double precision; width is the bytes of a number."""
    x = np.stack([np.frombuffer(v, np.float32 if width == 4 else np.float64) for v in column]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, p: Cells) -> np.ndarray:
    rng = np.random.default_rng(p.seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(p.rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def _assigned(classes: DataFrame, centroids: dict[int, np.ndarray], width: int, p: Cells) -> DataFrame:
    """Each vector in its own cell, and in each later cell that may hold a partner."""
    reach = np.sqrt(2 - 2 * p.threshold)
    gaps = {d: np.linalg.norm(c[:, None] - c[None], axis=2) for d, c in centroids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            sizes = np.array([len(v) // width for v in vectors])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                c = centroids.get(d)
                if c is None:  # a length that the sample has not seen: one cell
                    row, cell, own = rows, np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                else:
                    near = _unit([vectors[i] for i in rows], width) @ c.T
                    home = near.argmax(axis=1)
                    here = near[np.arange(len(rows)), home][:, None] - near <= reach * gaps[d][home] + 1e-9
                    here &= np.arange(len(c)) >= home[:, None]
                    row, cell = np.nonzero(here)
                    own = home[row] == cell
                    row = rows[row]
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([d] * len(row), pa.int32()), pa.array(cell.astype(np.int32)), pa.array(own)], names=[*batch.schema.names, "length", "cell", "own"])

    return classes.mapInArrow(run, "label string, rep long, copies long, vector binary, length int, cell int, own boolean")


def _products(rows: DataFrame, width: int, p: Cells) -> DataFrame:
    """Sorted blocks, the block's own vectors first -> node, other (linked), links (copies of linked vectors; null on edges)."""
    names = ["label", "length", "cell", "block", "other", "own", "rep", "copies", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, mine_rep, mine_copies, links = None, None, None, None, None
        held: list = []

        def record(node, other, count=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.nulls(len(node), pa.int64()) if count is None else pa.array(count)], names=["node", "other", "links"])

        def settle() -> Iterator[pa.RecordBatch]:
            """The block's own vectors are all there: compare them with each other."""
            nonlocal mine, mine_rep, mine_copies, links, held
            if held:
                mine, mine_rep, mine_copies = _unit([h[2] for h in held], width), np.array([h[0] for h in held]), np.array([h[1] for h in held])
                links = mine_copies - 1
                held = []
                yield from compare(mine, mine_rep, mine_copies, np.zeros(len(mine_rep), bool))

        def compare(x, rep, copies, visits) -> Iterator[pa.RecordBatch]:
            nonlocal links
            near = (mine @ x.T >= p.threshold) & (mine_rep[:, None] != rep[None, :])
            links = links + near @ copies
            back = mine_copies @ near[:, visits]  # visitors count their links here, since their own cells do not see these
            if back.any():
                yield record(rep[visits][back > 0], rep[visits][back > 0], back[back > 0])
            a, b = np.nonzero(near)
            first = np.unique(b, return_index=True)[1]  # links of one vector with several of the block: those join through it
            again = np.ones(len(b), bool)
            again[first] = False
            head = a[first][np.searchsorted(b[first], b[again])]
            src = np.concatenate([rep[b[first]], mine_rep[a[again]]])
            dst = np.concatenate([mine_rep[a[first]], mine_rep[head]])
            edges = np.unique(np.stack([src, dst], axis=1), axis=0)
            yield record(edges[:, 0], edges[:, 1])

        def stream(later: list) -> Iterator[pa.RecordBatch]:
            if later and mine is not None:
                yield from compare(_unit([r[3] for r in later], width), np.array([r[0] for r in later]), np.array([r[1] for r in later]), np.array([r[2] for r in later]))

        def close(later: list) -> Iterator[pa.RecordBatch]:
            nonlocal mine
            yield from settle()
            yield from stream(later)
            if mine is not None:
                yield record(mine_rep, mine_rep, links)
            mine = None

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            later: list = []
            for label, length, cell, block, other, own, rep, copies, vector in zip(*columns):
                if (label, length, cell, block) != key:
                    yield from close(later)
                    key, later = (label, length, cell, block), []
                if not other:
                    held.append((rep, copies, vector))
                else:
                    yield from settle()
                    later.append((rep, copies, not own, vector))
            yield from stream(later)
        yield from close([])

    return rows.mapInArrow(run, "node long, other long, links long")


def near_duplicates(rows: DataFrame, p: Cells = Cells()) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    width = 4 if rows.schema["embedding"].dataType.simpleString() == "array<float>" else 8
    known = stage(usable(rows))
    classes = known.where("digest is not null and vec_id is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stage(classes)
    found = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.octet_length("vector")).alias("size")).agg(F.max("n"), F.max("size")).first()
    largest, size = found[0] or 0, found[1] or 1
    sample = bounded_sample(classes, "rep", max(1, min(p.sample, p.sample_bytes // size))).select("vector").toPandas()["vector"].tolist()
    k = max(1, min(p.most_cells, math.ceil(math.sqrt(largest / p.per_cell))))
    lengths = sorted({len(v) for v in sample})
    centroids = {n // width: fit_centroids(_unit([v for v in sample if len(v) == n], width), k, p) for n in lengths}
    placed = _assigned(classes.select("label", "rep", "copies", "vector"), centroids, width, p)
    placed = stage(placed)
    cells = placed.groupBy("label", "length", "cell").agg(F.sum(F.col("own").cast("long")).alias("members"))
    cells = cells.select("label", "length", "cell", F.greatest(F.lit(1), F.ceil(F.col("members") / p.block)).cast("int").alias("blocks"))
    dealt = placed.join(cells, ["label", "length", "cell"]).withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("other", ~(F.col("own") & (F.col("mine") == F.col("block"))))
    keys = ["label", "length", "cell", "block"]
    dealt = dealt.select(*keys, "other", "own", "rep", "copies", "vector").repartition(*keys).sortWithinPartitions(*keys, "other")
    found = stage(_products(dealt, width, p))
    links = found.where("links is not null").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("links is null").select(F.col("node").alias("src"), F.col("other").alias("dst"))).select(F.col("node").alias("rep"), "component")
    classes = classes.select("label", "digest", "rep").join(links, "rep", "left").join(parts, "rep", "left")
    result = known.select("vec_id", "label", "digest").join(classes, ["label", "digest"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return result.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
