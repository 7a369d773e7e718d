"""The trie of conversations, built compressed (Patricia) and then expanded.

A conversation is a sequence of turns (role, text); each turn is told by two 64-bit hashes and its number of characters, so
texts do not travel. Equal sequences are merged by a partial aggregate, and the different ones sorted over the cluster
by range. Every task scans its range with a stack: a point is created only where conversations branch or end, and the common
prefix of neighbours tells where. When a point closes, its counts are final and go to the point above; the edge between them is kept
compressed.

Points on the path of a range's first or last sequence may go on in the ranges around. They are not closed there; their
finished subtrees are summed up as hangers at their depth, and the same scan runs once more over the first and last sequences of all
ranges, two rows a task of the first scan. So no subtree is ever collected, however many conversations share a first turn.

At the end edges are expanded: the nodes on an edge have the counts of the point at its foot, and their saved characters by the
suffix sums of the edge.

The numbers of the conversations that end at a node are joined in blocks of consecutive numbers and hashed as a stream.

A conversation is one row, as a document is, of 24 bytes a turn. Turns with the same number are ordered by role, then by
the hash of their text. Defined results: rows without a conv_id belong to no conversation and are left out; a repeated row is a
turn of its own; an empty table gives no rows; null role or text counts as empty, also where all are; a conversation may be rebuilt without a
turn and ends at the root; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, stage, table

#: A base conversation lends at most so many turns, less one.
LENT = 6
#: Conversation numbers of a block that is joined at once.
BLOCK = 4096

_TURNS = "array<struct<h1: bigint, h2: bigint, n: bigint>>"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as hashes and lengths."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turn = F.struct("turn", "role", *[F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)], F.char_length("text").cast("long").alias("n"))
    ordered = F.sort_array(F.collect_list("x"))  # a null turn comes first
    found = rows.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(ordered.alias("x"))
    return found.select("conv_id", F.transform("x", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["n"].alias("n"))).alias("turns"))


def lent(own: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 100 in place of its own first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, LENT - 1).alias("head"))
    rows = own.withColumn("h", h).withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left")
    head = F.coalesce("head", F.expr(f"cast(array() as {_TURNS})"))
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return rows.select("conv_id", F.concat(F.slice(head, F.lit(1), F.col("h")), rest).alias("turns"))


def _ends(rows: DataFrame) -> DataFrame:
    """first_id (the least conversation of each sequence) and the hash of all its conversations."""
    key = ["k1", "k2", "size"]
    blocks = rows.groupBy(*key, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # BLOCK numbers at most
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    blocks = blocks.select(*key, "block", F.get("ids", 0).alias("first_id"), joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, digest = None, 0, None
        for batch in batches:
            out: list[tuple[int, str]] = []
            columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)]
            for *own, first_id, ids in zip(*columns):
                if own != last:
                    if digest is not None:
                        out.append((first, digest.hexdigest()))
                    last, first, digest = own, first_id, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _ended(out)
        if digest is not None:
            yield _ended([(first, digest.hexdigest())])

    ordered = blocks.repartition(*key).sortWithinPartitions(*key, "block")
    return ordered.mapInArrow(run, "first_id long, ends_sha256 string")


def _ended(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["first_id", "ends_sha256"])


class Point:
    __slots__ = ("depth", "n", "conv", "children", "leaves", "saved", "end", "asked", "number")

    def __init__(self, depth: int, number: int):
        self.depth, self.number = depth, number
        self.n = self.children = self.leaves = self.saved = 0
        self.conv: int | None = None
        self.end: int | None = None
        self.asked: list[int] = []

    def take(self, n: int, conv: int, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None or conv < self.conv else self.conv
        self.children += children
        self.leaves += leaves
        self.saved += saved


class Scan:
    """A stack scan over sorted, different sequences; ``whole`` if no other range has any.

    Results: edges (of points that are complete), and hangers of the first and the last sequence.
    """

    def __init__(self, whole: bool):
        self.whole = whole
        self.stack = [Point(0, 0)]
        self.points = 1
        self.shared = -1  # depth up to which the open path is that of the first sequence
        self.turns: np.ndarray | None = None
        self.first: np.ndarray | None = None
        self.chars = np.zeros(1, np.int64)
        self.edges: list[tuple] = []
        self.parent: list[int] = []  # number of the point above each edge
        self.conv: dict[int, int] = {}  # of complete points
        self.hangers: tuple[list, list] = ([], [])
        self.spine: dict[int, tuple[int, int]] = {}  # side and depth of points that are not complete
        self.answers: list[tuple[int, int, int]] = []

    def _point(self, depth: int) -> Point:
        """The open point at a depth, made if it is not there."""
        i = len(self.stack)
        while self.stack[i - 1].depth > depth:
            i -= 1
        if self.stack[i - 1].depth < depth:
            self.stack.insert(i, Point(depth, self.points))
            self.points += 1
            return self.stack[i]
        return self.stack[i - 1]

    def _hang(self, p: Point, side: int) -> None:
        self.spine[p.number] = (side, p.depth)
        self.hangers[side].append((p.depth, p.n, p.conv, p.children, p.leaves, p.saved, p.end))

    def _finish(self, p: Point, above: Point | None) -> None:
        top = above.depth if above else -1
        sums, q = self.chars, p.depth
        p.leaves += p.children == 0
        if q:
            p.saved += (p.n - 1) * int(sums[q] - sums[q - 1])
        below = sums[q - 1] - sums[top:q] if above else np.zeros(1, np.int64)
        self.edges.append((q, top, p.conv, p.n, p.children, p.leaves, p.saved, p.end, below))
        self.parent.append(above.number if above else -1)
        self.conv[p.number] = p.conv
        self.answers += [(asked, q, p.conv) for asked in p.asked]
        if above:
            above.take(p.n, p.conv, 1, p.leaves, p.saved + (p.n - 1) * int(below[0]))

    def _close(self, depth: int) -> None:
        """Close all points below a depth of the open path."""
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            above = self._point(max(depth, self.stack[-1].depth))
            if p.depth <= self.shared and not self.whole:
                self._hang(p, 0)
            else:
                self._finish(p, above)

    def add(self, turns: np.ndarray, chars: np.ndarray, hangers: list[tuple], asks: int | None = None) -> None:
        """turns: two hashes a row. hangers: (depth, n, conv, children, leaves, saved, end), by depth."""
        if self.turns is None:
            self.first, self.shared = turns, len(turns)
        else:
            m = min(len(turns), len(self.turns))
            other = np.flatnonzero((turns[:m] != self.turns[:m]).any(axis=1))
            common = int(other[0]) if other.size else m
            self._close(common)
            self.shared = min(self.shared, common)
        self.turns, self.chars = turns, np.concatenate([[0], np.cumsum(chars)])
        for depth, n, conv, children, leaves, saved, end in hangers:
            p = self._point(depth)
            p.take(n, conv, children, leaves, saved)
            if end is not None:
                p.end = end
            if asks is not None:
                p.asked.append(asks)

    def finish(self) -> None:
        if self.turns is None:
            return
        if self.whole:
            self._close(0)
            self._finish(self.stack.pop(), None)
            return
        while self.stack:
            p = self.stack.pop()
            if p.n:  # else nothing ends or hangs here
                self._hang(p, int(p.depth > self.shared))
        for side in self.hangers:
            side.sort()


_EDGE = ["depth", "top", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "end_id"]
_HANGER = ["depth", "n", "conv", "children", "leaves", "saved", "end"]
_FIELDS = pa.schema(
    [(c, pa.int64()) for c in _EDGE]
    + [("below", pa.list_(pa.int64())), ("parent_conv_id", pa.int64()), ("spine", pa.int64()), ("spine_depth", pa.int64())]
    + [("turns", pa.list_(pa.struct([(c, pa.int64()) for c in ("h1", "h2", "n")]))), ("hangers", pa.list_(pa.struct([(c, pa.int64()) for c in _HANGER])))]
)
SCHEMA = ", ".join(f"{c} long" for c in _EDGE) + ", below array<long>, parent_conv_id long, spine long, spine_depth long, turns " + _TURNS + f", hangers array<struct<{', '.join(f'{c}: long' for c in _HANGER)}>>"
_ROWS = 2000


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, _ROWS)):
        yield pa.RecordBatch.from_pylist(part, schema=_FIELDS)


def _rows(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and lengths of each row's turns."""
    lists = batch.column(column)
    flat = lists.flatten()
    hashes = np.stack([flat.field(c).to_numpy() for c in ("h1", "h2")], axis=1)
    chars = flat.field("n").to_numpy()
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield hashes[a:b], chars[a:b]


def _edges(scan: Scan, part: int) -> Iterator[dict]:
    for edge, parent in zip(scan.edges, scan.parent):
        row = dict(zip(_EDGE, edge)) | {"below": edge[-1].tolist(), "parent_conv_id": scan.conv.get(parent)}
        if parent in scan.spine:
            side, depth = scan.spine[parent]
            row |= {"spine": 2 * part + side, "spine_depth": depth}
        yield row


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of complete points of a range, and its first and last sequence with what hangs there."""
    scan, part, chars = Scan(whole=False), None, None
    ends: list[np.ndarray] = []
    for batch in batches:
        ids, counts = batch.column("first_id").to_pylist(), batch.column("n").to_pylist()
        for (turns, own), first_id, n in zip(_rows(batch, "turns"), ids, counts):
            if part is None:
                part, chars = batch.column("part")[0].as_py(), own
            scan.add(turns, own, [(len(turns), n, first_id, 0, 0, 0, first_id)])
            ends = [turns, own]
    if part is None:
        return
    scan.finish()

    def spines() -> Iterator[dict]:
        for side, (turns, own) in enumerate(((scan.first, chars), ends)):
            if scan.hangers[side]:
                listed = [{"h1": a, "h2": b, "n": n} for (a, b), n in zip(turns.tolist(), own.tolist())]
                yield {"spine": 2 * part + side, "turns": listed, "hangers": [dict(zip(_HANGER, h)) for h in scan.hangers[side]]}

    yield from _batches(_edges(scan, part))
    yield from _batches(spines())


def _spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the points that several ranges share, and for each hanger the least conversation of its point."""
    scan = Scan(whole=True)
    for batch in batches:
        for (turns, chars), spine, hangers in zip(_rows(batch, "turns"), batch.column("spine").to_pylist(), batch.column("hangers").to_pylist()):
            scan.add(turns, chars, [tuple(h[c] for c in _HANGER) for h in hangers], spine)
    scan.finish()
    yield from _batches(_edges(scan, 0))
    yield from _batches({"spine": s, "spine_depth": d, "conv_id": c} for s, d, c in scan.answers)


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, turns), with counts; see the module."""
    bounded_batches(rows.sparkSession)
    keyed = stage(rows.select("conv_id", "turns", F.xxhash64("turns").alias("k1"), F.xxhash64(F.lit(2), "turns").alias("k2"), F.size("turns").alias("size")))
    distinct = keyed.groupBy("k1", "k2", "size").agg(F.min("conv_id").alias("first_id"), F.count("*").alias("n"), F.any_value("turns").alias("turns"))
    distinct = stage(distinct.select("first_id", "n", "turns"))
    ordered = distinct.repartitionByRange("turns").sortWithinPartitions("turns").select("first_id", "n", "turns", F.spark_partition_id().alias("part"))
    ranges = stage(ordered.mapInArrow(_ranges, SCHEMA))
    spines = ranges.where("hangers is not null").select("spine", "turns", "hangers")
    shared = stage(spines.repartition(1).sortWithinPartitions("turns").mapInArrow(_spines, SCHEMA))  # two rows a range
    answers = shared.where("depth is null").select("spine", "spine_depth", F.col("conv_id").alias("answer"))
    columns = [*_EDGE, "below", "parent_conv_id"]
    own = ranges.where("depth is not null")
    hung = own.where("spine is not null").join(answers, ["spine", "spine_depth"]).withColumn("parent_conv_id", F.col("answer"))
    edges = own.where("spine is null").select(*columns).unionByName(hung.select(*columns)).unionByName(shared.where("depth is not null").select(*columns))
    ended = edges.where("end_id is not null").join(_ends(keyed).withColumnRenamed("first_id", "end_id"), "end_id")
    edges = ended.unionByName(edges.where("end_id is null").withColumn("ends_sha256", F.lit(None).cast("string")))
    return expand(edges)


def expand(edges: DataFrame) -> DataFrame:
    """All nodes of compressed edges, from the one below the point above down to the point at the foot."""
    nodes = edges.select("*", F.posexplode("below").alias("i", "chars"))
    depth, foot = F.col("top") + 1 + F.col("i"), F.col("top") + 1 + F.col("i") == F.col("depth")
    nothing = F.sha2(F.lit(""), 256)

    def at_foot(c: str, other: Column) -> Column:
        return F.when(foot, F.col(c)).otherwise(other)

    return nodes.select(
        "conv_id",
        depth.alias("depth"),
        F.when(F.col("i") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        at_foot("n_children", F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        F.coalesce(at_foot("ends_sha256", nothing), nothing).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(lent(stage(sequences(table(spark, sf_dir, "conversations")))))


#: crc32 of a decimal number, bit by bit.
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, y: xor(b >> 1, (b & 1) * 3988292384))), 4294967295))"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM own)
), rebuilt AS (
  SELECT convs.c, i, role, text, 0 AS part FROM convs JOIN own ON own.c = convs.c - convs.c % 100 AND i <= h
  UNION ALL SELECT convs.c, i, role, text, 1 FROM convs JOIN own ON own.c = convs.c AND i > h
), numbered AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM rebuilt
), paths AS (
  SELECT c, d, length(text) AS n, string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS k FROM numbered
  UNION ALL SELECT c, 0, 0, '' FROM convs
), nodes AS (
  SELECT k, any_value(d) AS d, any_value(n) AS n, min(c) AS c, count(*) AS m FROM paths GROUP BY k
), parents AS (
  SELECT nodes.*, p.c AS parent, p.k AS parent_k FROM nodes LEFT JOIN nodes p ON nodes.d > 0 AND p.k = substr(nodes.k, 1, length(nodes.k) - 64)
), children AS (
  SELECT parent_k AS k, count(*) AS children FROM parents WHERE parent_k IS NOT NULL GROUP BY parent_k
), below AS (
  SELECT top.k, sum((nodes.m - 1) * nodes.n) AS saved, count(*) FILTER (WHERE children IS NULL) AS leaves
  FROM nodes LEFT JOIN children USING (k) JOIN paths top ON top.c = nodes.c AND top.d <= nodes.d GROUP BY top.k
), ends AS (
  SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY d DESC) AS r FROM paths) WHERE r = 1 GROUP BY k
)
SELECT c::BIGINT AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, m::BIGINT AS n_convs, coalesce(children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM parents LEFT JOIN children USING (k) JOIN below USING (k) LEFT JOIN ends USING (k)
"""
