"""N-gram Jaccard join in metric space, exact.

Jaccard distance is a metric, but most documents are at distance 1 from nearly all others, where no
pivot can tell them apart. So an exact filter first leaves the documents that may have a partner: of the
shingles in hash order each document shows enough that two linked ones have ``least`` of these in common, and
of those shown it keeps the rarest, so many that one of the common ones is among them. Documents that
keep an equal shingle hang together; each group is one metric space, a family.

Every family is joined recursively. Pivots, drawn from its members, create Voronoi regions: a document goes
to the region of its nearest pivot, and the triangle inequality gives the window of other regions whose
members may still be within reach: ``d(x, p_j) <= d(x, p_i) + 2 r``. Documents within ``r`` of a pivot
are linked to it at once. Families of more than ``limit`` sets are split as Spark jobs (pivots meet the
members by a shuffle, each pivot copied to as many tasks as the family needs), level after level; what is
smaller is split in the task that holds it, and regions of ``leaf`` sets are compared through their posting
lists. A region whose members are all linked through its pivots is done. One that does not shrink is dealt into
blocks by size: linked sets have sizes in the same or in neighbouring bands, and documents that pivots have linked
to each other need no comparison, so only the others meet the blocks of their bands.

Defined results: a null, empty or blank text has an empty set and links with nothing; fewer words
than ``n`` give one shingle, the whole sequence; equal sets are linked; repeated rows link like
copies, also if texts of one doc_id differ; a text of any length is one set; rows with a null doc_id link,
but name no component (their component is null if no member has an id); an empty table gives no rows. Columns
other than doc_id and text are ignored. Shingles are compared by 64-bit hashes.
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

from tessera.llm.common import LOWER, chunks, mix, stage, table, text_buffer, window_hash, word_hashes, words
from tessera.llm.components import components
from tessera.llm.repeats import numbered


@dataclass(frozen=True)
class Join:
    n: int = 3  # words in a shingle
    percent: int = 90  # least similarity
    family_limit: int = 256  # sets of a family or block that one task joins
    pivots: int = 8
    leaf: int = 2


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = LOWER[raw]
    starts, ends, first = words(low, offsets)
    symbols = word_hashes(low, starts, ends)
    grams = window_hash(symbols, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:  # a word count in the hash keeps such sequences apart from shingles
            out.append(mix(window_hash(symbols[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least_shown(n: int) -> int:
    """Common shingles that linked documents show at least, by the size of the smaller one."""
    return max(1, n // 10)


def shown(own: np.ndarray, p: Join) -> tuple[np.ndarray, int]:
    """The first shingles of a set in hash order, and how many of them a linked set shows too.

    Linked sets share at least ``percent`` of the larger one; the first of the shared ones lie so far front
    in both that each shows them.
    """
    shared = -(-len(own) * p.percent // 100)
    return own[: len(own) - shared + _least_shown(len(own))], _least_shown(shared)


#: Digests that a task remembers, so that copies which it reads show their shingles once.
_REMEMBERED = 100_000


def signatures(texts: DataFrame, p: Join) -> DataFrame:
    """For each of (row, doc_id, text): row, doc_id, n_shingles, digest of the set, node (64 bits of it), least, keys (the shingles shown)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            offsets, raw = text_buffer(batch.column(2))
            for i, j in chunks(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.n)
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                node = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digest], np.int64)
                keys, least = [], []
                for x, d in zip(sets, digest):
                    key, n = shown(x, p) if len(x) else (x, 1)
                    keys.append(key[:0] if d in seen else key)
                    least.append(n)
                    seen.add(d)
                if len(seen) > _REMEMBERED:
                    seen.clear()
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in (0, 1)], pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(node), pa.array(least, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                    names=["row", "doc_id", "n_shingles", "digest", "node", "least", "keys"],
                )

    return texts.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_shingles long, digest binary, node long, least int, keys array<long>")


def candidates(known: DataFrame) -> DataFrame:
    """src, dst: edges along which all linked sets hang together, between nodes that keep an equal shingle."""
    keys = known.where("n_shingles > 0").select("node", "least", F.explode("keys").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "n")
    rare = keys.join(often, "key").groupBy("node").agg(F.max("least").alias("least"), F.array_sort(F.collect_set(F.struct("n", "key"))).alias("own"))
    # shingles that no other set shows are the rarest; of the others as many stay as a linked set cannot lack
    rare = rare.where(F.size("own") >= F.col("least")).select("node", F.explode(F.slice("own", F.lit(1), F.size("own") - F.col("least") + 1)).alias("kept"))
    kept = stage(rare.select("node", F.col("kept.key").alias("key")))
    hubs = kept.groupBy("key").agg(F.min("node").alias("dst"), F.max("node").alias("high")).where("dst < high").select("key", "dst")
    return kept.join(hubs, "key").select(F.col("node").alias("src"), "dst").where("src <> dst").distinct()


#: Regions are worth making if they have together at most this share of the pairs that they come from; so work shrinks from level to level.
SHRINK = 0.8


class Region:
    """Sets of one region, their shingles numbered; labels are the least member linked so far."""

    def __init__(self, sets: list[np.ndarray], p: Join):
        self.p = p
        self.size = np.array([len(x) for x in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        _, self.item = np.unique(np.concatenate(sets), return_inverse=True)
        self.root = list(range(len(sets)))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def link(self, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            a, b = self.find(x), self.find(y)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def postings(self, members: np.ndarray):
        """Overlaps of one member with all members, by counting over posting lists."""
        sizes = self.size[members]
        rows = np.repeat(np.arange(len(members)), sizes)
        flat = np.concatenate([self.item[self.at[m] : self.at[m + 1]] for m in members.tolist()])
        names, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        by = rows[np.argsort(inverse, kind="stable")]
        ends = np.cumsum(counts)
        begins = ends - counts
        cuts = np.concatenate([[0], np.cumsum(sizes)])

        def overlap(k: int) -> np.ndarray:
            own = inverse[cuts[k] : cuts[k + 1]]
            own = own[counts[own] > 1]
            if not len(own):
                return np.zeros(len(members), np.int64)
            n = counts[own]
            index = np.arange(n.sum()) + np.repeat(begins[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            return np.bincount(by[index], minlength=len(members))

        return sizes, overlap

    def join(self, members: np.ndarray) -> None:
        p = self.p
        if len(members) < 2:
            return
        sizes, overlap = self.postings(members)
        if len(members) > p.leaf and self._split(members, sizes, overlap):
            return
        for k in range(len(members)):
            both = overlap(k)
            near = np.flatnonzero(100 * both >= p.percent * (sizes + sizes[k] - both))
            self.link(int(members[k]), members[near[near > k]])

    def _split(self, members: np.ndarray, sizes: np.ndarray, overlap) -> bool:
        p, r = self.p, 1 - self.p.percent / 100
        pivots, distances, cores = [0], [], []
        for _ in range(p.pivots):
            both = overlap(pivots[-1])
            union = sizes + sizes[pivots[-1]] - both
            distances.append(1 - both / union)
            cores.append(100 * both >= p.percent * union)
            self.link(int(members[pivots[-1]]), members[cores[-1]])
            far = np.min(distances, axis=0)
            if far.max() <= r:
                break
            pivots.append(int(far.argmax()))
        d = np.array(distances)
        home = d.argmin(axis=0)
        least = d.min(axis=0)
        regions = []
        rest = np.ones(len(members), bool)
        rest[pivots[: len(d)]] = False  # pivots have met all members
        for j in range(len(d)):
            # of a pair in two regions, the one of the lower region is repeated in the higher
            inside = rest & ((home == j) | ((home < j) & (d[j] <= least + 2 * r + 1e-9)))
            if not cores[j][inside].all():  # documents within r of the pivot are linked through it already
                regions.append(members[inside])
        if sum(len(x) ** 2 for x in regions) > SHRINK * len(members) ** 2:
            return False
        for x in regions:
            self.join(x)
        return True


def join_regions(rows: DataFrame, p: Join) -> DataFrame:
    """region, row, text sorted by region -> row, label: the least row linked with it in the region."""

    def solve(ids: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        region = Region([sets[i] for i in order], p)
        region.join(np.arange(len(order)))
        return [ids[i] for i in order], [ids[order[region.find(k)]] for k in range(len(order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sets = None, [], []
        done: list[list] = [[], []]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], names=["row", "label"])
            done[0], done[1] = [], []
            return out

        for batch in batches:
            region, row, text = (batch.column(batch.schema.get_field_index(c)) for c in ("region", "row", "text"))
            offsets, raw = text_buffer(text)
            region, row = region.to_pylist(), row.to_pylist()
            for i, j in chunks(offsets):
                own = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.n)
                for k in range(i, j):
                    if region[k] != current:
                        if len(ids) > 1:
                            a, b = solve(ids, sets)
                            done[0] += a
                            done[1] += b
                        current, ids, sets = region[k], [], []
                    ids.append(row[k])
                    sets.append(own[k - i])
            if len(done[0]) > 4096:
                yield flush()
        if len(ids) > 1:
            a, b = solve(ids, sets)
            done[0] += a
            done[1] += b
        yield flush()

    return rows.mapInArrow(run, "row long, label long")


def _distances(rows: DataFrame, p: Join) -> DataFrame:
    """Sorted tasks of a region, its pivots first (region, task, member, row, text) -> region, row, size, pivots, d, core of each member.

    d has the distance from each pivot, and bit j of core is set if the member is linked to pivot j.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots, names = None, [], []
        for batch in batches:
            region, part, member, row, text = (batch.column(batch.schema.get_field_index(c)) for c in ("region", "task", "member", "row", "text"))
            offsets, raw = text_buffer(text)
            region, part, member, row = (x.to_pylist() for x in (region, part, member, row))
            out: list[list] = [[], [], [], [], [], []]
            for i, j in chunks(offsets):
                own = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.n)
                for k in range(i, j):
                    x = own[k - i]
                    if (region[k], part[k]) != key:
                        key, pivots, names = (region[k], part[k]), [], []
                    if not member[k]:
                        pivots.append(x)
                        names.append(row[k])
                        continue
                    both = [len(np.intersect1d(x, y, assume_unique=True)) for y in pivots]
                    union = [len(x) + len(y) - n for y, n in zip(pivots, both)]
                    core = sum(1 << at for at, (n, u) in enumerate(zip(both, union)) if 100 * n >= p.percent * u)
                    for column, v in zip(out, (region[k], row[k], len(x), names, [1 - n / u for n, u in zip(both, union)], core)):
                        column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["region", "row", "size", "pivots", "d", "core"])

    return rows.mapInArrow(run, "region long, row long, size long, pivots array<long>, d array<double>, core long")


def _joined_pivots(cores: DataFrame) -> DataFrame:
    """region, masks (sets of pivots that one member is linked to) -> region, parts: sets of pivots that hang together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for masks in batch.column(1).to_pylist():
                own: list[int] = []
                for m in masks:
                    m |= sum(x for x in own if x & m)
                    own = [x for x in own if not x & m] + [m]
                parts.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int64()))], names=["region", "parts"])

    return cores.mapInArrow(run, "region long, parts array<long>")


def _voronoi(members: DataFrame, texts: DataFrame, p: Join) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions too large for a task (region, row, n) -> links (row, label) with pivots, the other members, rows of the regions these are split into.

    The members get part: the pivots, hanging together, that the row is linked to, or null. The rows have region, row, part, origin (the region they
    come from) and n, its size.
    """
    r = 1 - p.percent / 100
    least = [F.min(F.struct(F.xxhash64("row", F.lit(i)).alias("h"), "row")).alias(f"p{i}") for i in range(p.pivots)]
    chosen = members.groupBy("region").agg(*least, F.max("n").alias("n"))
    tasks = F.ceil(F.col("n") / p.family_limit).cast("int")
    chosen = chosen.select("region", tasks.alias("tasks"), F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.row") for i in range(p.pivots)]))).alias("row"))
    chosen = chosen.select("region", "row", F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    dealt = members.select("region", "row", F.lit(True).alias("member"), F.pmod(F.xxhash64("row", F.lit("task")), tasks).cast("int").alias("task"))
    rows = chosen.unionByName(dealt).join(texts.select("row", "text"), "row")
    rows = rows.repartition("region", "task").sortWithinPartitions("region", "task", "member", "row")
    placed = stage(_distances(rows, p).join(members.groupBy("region").agg(F.max("n").alias("n")), "region"))
    linked = F.filter(F.arrays_zip("pivots", F.sequence(F.lit(0), F.size("pivots") - 1).alias("at")), lambda x: F.bit_get(F.col("core"), x["at"]) == 1)
    links = placed.where("core <> 0").select("row", F.explode(linked).alias("pivot")).select("row", F.col("pivot.pivots").alias("label"))
    parts = _joined_pivots(placed.where("core <> 0").groupBy("region").agg(F.collect_set("core").alias("masks")))
    part = F.get(F.filter("parts", lambda x: x.bitwiseAND(F.col("core")) != 0), 0)
    rest = placed.where(~F.array_contains("pivots", F.col("row")))  # pivots have met all members
    whole = stage(rest.join(parts, "region", "left").select("region", "row", "size", "n", part.alias("part"), "d"))
    nearest = F.array_min("d")
    each = whole.select("region", "row", "n", "part", nearest.alias("nearest"), (F.array_position("d", nearest) - 1).alias("home"), F.posexplode("d").alias("at", "far"))
    # of a pair in two regions, the one of the lower region is repeated in the higher
    inside = each.where((F.col("at") == F.col("home")) | ((F.col("at") > F.col("home")) & (F.col("far") <= F.col("nearest") + 2 * r + 1e-9)))
    return links, whole.select("region", "row", "size", "part"), inside.select(F.xxhash64("region", "at").alias("region"), "row", "part", F.col("region").alias("origin"), "n")


def _blocks(rows: DataFrame, p: Join) -> DataFrame:
    """Regions that pivots do not split (region, row, size, part), as regions of two blocks each; pairs linked through pivots already need not meet."""
    counts = rows.groupBy("region", "part").agg(F.count("*").alias("m"))
    main = counts.where("part is not null").groupBy("region").agg(F.max(F.struct("m", "part"))["part"].alias("main"))
    rows = rows.join(main, "region", "left").withColumn("done", F.coalesce((F.col("part") == F.col("main")).cast("int"), F.lit(0)))
    # linked sizes lie less than one band apart, also after rounding
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / min(p.percent, 99)) * (1 - 1e-9)).cast("int")
    rows = rows.select("region", "row", "done", band.alias("band"))
    blocks = rows.groupBy("region", "band", "done").agg(F.ceil(F.count("*") / p.family_limit).cast("int").alias("blocks"))
    code = lambda band, done, k: band.cast("long") * F.lit(1 << 32) + done * F.lit(1 << 31) + k
    own = rows.join(blocks, ["region", "band", "done"])
    own = own.select("region", "row", "done", code(F.col("band"), F.col("done"), F.pmod(F.xxhash64("row"), "blocks")).alias("own"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    other = blocks.select("region", "band", F.col("done").alias("other_done"), "blocks")
    met = own.join(other, ["region", "band"]).where("done + other_done < 2").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("other", code(F.col("band"), F.col("other_done"), F.col("k")))
    return met.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "row")


def _linked(members: DataFrame, texts: DataFrame, p: Join) -> DataFrame:
    """row, label: links (and more that follow from them) of all regions (region, row)."""
    links, small = [], []
    sized = members.join(members.groupBy("region").agg(F.count("*").alias("n")), "region")
    while True:
        large = sized.where(F.col("n") > p.family_limit)
        small.append(sized.where(F.col("n") <= p.family_limit).select("region", "row"))
        if not large.limit(1).count():
            break
        found, whole, inside = _voronoi(large, texts, p)
        links.append(found)
        sizes = inside.groupBy("origin", "region").agg(F.max("n").alias("n"), F.count("*").alias("now"), F.count("part").alias("named"), F.min("part").alias("low"), F.max("part").alias("high"))
        sizes = stage(sizes.where("now > 1 and (named < now or low < high)").select("origin", "region", "n", "now"))
        pairs = sizes.groupBy("origin").agg((F.sum(F.col("now").cast("double") * F.col("now")) / F.max(F.col("n").cast("double") * F.col("n"))).alias("share"))
        stuck, shrunk = pairs.where(F.col("share") > SHRINK), pairs.where(F.col("share") <= SHRINK)
        small.append(_blocks(whole.join(stuck.select(F.col("origin").alias("region")), "region"), p))
        sized = stage(inside.select("region", "row").join(sizes.join(shrunk, "origin").select("region", F.col("now").alias("n")), "region"))
    rows = small[0]
    for x in small[1:]:
        rows = rows.unionByName(x)
    rows = rows.join(texts.select("row", "text"), "row").repartition("region").sortWithinPartitions("region", "row")
    result = join_regions(rows, p)
    for x in links:
        result = result.unionByName(x)
    if not links:  # every row is in one region, so its label is final
        return result
    return components(result.select(F.col("row").alias("src"), F.col("label").alias("dst"))).select(F.col("node").alias("row"), F.col("component").alias("label"))


def jaccard_components(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    texts = numbered(docs)
    known = stage(signatures(texts, p))
    families = components(candidates(known))
    classes = known.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("node").alias("node"), F.count("*").alias("copies"))
    classes = stage(classes.join(families, "node", "left").where("component is not null or copies > 1").select("digest", "rep", "row", F.col("component").alias("region")))
    links = _linked(classes.where("region is not null").select("region", "row"), texts, p)
    labelled = stage(classes.join(links, "row", "left").select("digest", "rep", F.coalesce("label", "row").alias("label")))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    labelled = labelled.join(least, "label").select("digest", "component")
    result = known.select("doc_id", "n_shingles", "digest").join(labelled, "digest", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
