"""Maximal repeats with all their occurrences, from the common-prefix interval tree.

An interval of the tree has all suffixes that share ``depth`` symbols. Its members, ordered by what stands to their left,
have an interval tree of their own: a left interval whose members share ``b`` symbols and then differ is left-diverse,
and if its members do not all lie in one child of the right interval it is right-diverse too. So each pair of
intervals with ``b + depth >= width`` is one maximal repeat, and its members are all of its occurrences.

Of all occurrences of a repeat those at one anchor are known to meet if a window within the repeat has that anchor; other
intervals are passed over, since another anchor has them. One anchor sees two widths to both sides, so repeats of up to two widths are whole. Longer ones are put together from
pieces with the same occurrences (the same rows at the same distances) that overlap; of a seed with very many
contexts the pieces are those of a range of windows.

Defined results: rows as for ``remove_repeats``; a row with a null doc_id is an occurrence like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.repeats import Batch, Windows, common, halved, numbered, repeated_contexts, row_order, seed_groups
from tessera.llm.suffix_array_dedup import BYTES, intervals


def maximal_groups(batch: Batch, width: int, early: np.ndarray, late: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(b, depth, members) of each repeat: the symbols before and from the seed on, and the rows that hold it.

    early and late: the first and last start of a window whose anchor the seed is, for each row.
    """
    return [(b, depth, own) for b, depth, own in _tree_groups(batch, width) if max(-b, early[own[0]]) <= min(depth - width, late[own[0]])]


def _tree_groups(batch: Batch, width: int) -> list[tuple[int, int, np.ndarray]]:
    n, seed = batch.n, batch.p.seed
    # a context that stands several times repeats as a whole
    found = [(int(batch.left_len[i]), int(batch.right_len[i]), np.array([i])) for i in np.flatnonzero(batch.count > 1) if batch.left_len[i] + batch.right_len[i] >= width]
    if n < 2:
        return found
    sa = row_order(batch.ahead)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common(batch.ahead[sa[1:]], batch.ahead[sa[:-1]])
    rank = np.empty(n, np.int64)
    rank[row_order(batch.back)] = np.arange(n)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    for depth, first, last in intervals(lcp, seed):
        members = sa[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = np.concatenate([[0], common(batch.back[members[1:]], batch.back[members[:-1]])])
        if shared.max() + depth < width:
            continue
        for b, i, j in intervals(shared, max(width - depth, 0)):
            own = members[i : j + 1]
            at = place[own]
            if lcp[at.min() + 1 : at.max() + 1].min() == depth:  # not all in one child of the interval
                found.append((b, depth, own))
        if width <= depth and shared[1:].min() == 0:  # the seed's own place begins the repeat: nothing to the left is shared by all
            found.append((0, depth, members))
    return found


def _groups(classes: DataFrame, p: Windows) -> DataFrame:
    """node, grp, lo, hi of classes (grp, a, b, node, copies, least, left, early, late, context): the repeats that each class holds."""
    schema = "node long, grp long, lo int, hi int"

    def work(rows: list) -> pa.RecordBatch:
        seed, node, copies, left, first, last = (np.concatenate([r[c].to_numpy() for r in rows]) for c in range(6))
        batch = Batch(seed, left, [x for r in rows for x in r[6].to_pylist()], node, copies, replace(p, width=2 * p.width))
        names, early, late = (np.empty(batch.n, np.int64) for _ in range(3))
        names[batch.member], early[batch.member], late[batch.member] = node, first, last
        out: list[list] = [[], [], [], []]
        for b, depth, own in maximal_groups(batch, p.width, early, late):
            one = np.concatenate([batch.back[own[0], :b][::-1], batch.ahead[own[0], :depth]]).astype(np.int64)
            grp = int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8).digest(), "little", signed=True)
            for column, v in zip(out, (names[own].tolist(), [grp] * len(own), [-b] * len(own), [depth] * len(own))):
                column += v
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["node", "grp", "lo", "hi"])

    sizes = classes.groupBy("grp").agg(F.count("*").alias("n"))
    classes = stage(classes.join(sizes, "grp"))
    few = classes.where((F.col("n") <= p.group_limit) & ((F.col("n") > 1) | (F.col("copies") > 1)))
    found = seed_groups(few.withColumnRenamed("grp", "seed"), ("seed", "node", "copies", "left", "early", "late", "context"), schema, p.batch, work)
    crowded = classes.where(F.col("n") > p.group_limit)
    if not crowded.limit(1).count():
        return found
    parts = stage(halved(crowded, p))
    reach = crowded.select(F.col("node").alias("parent"), "early", "late")
    children = stage(parts.join(reach, "parent").groupBy("node").agg(*[F.first(c).alias(c) for c in ("grp", "a", "b", "left", "context", "early", "late")], F.sum("copies").alias("copies"), F.min("least").alias("least")))
    back = parts.select("parent", "node").join(_groups(children, p), "node").select(F.col("parent").alias("node"), "grp", "lo", "hi")
    return found.unionByName(back.distinct())


def maximal_repeats(docs: DataFrame, p: Windows = BYTES) -> DataFrame:
    """repeat, n_symbols, row, doc_id and start: a row for every occurrence of every maximal repeat of width symbols or more."""
    rows = numbered(docs)
    contexts = repeated_contexts(rows.where("text is not null").select("row", F.col("row").alias("doc"), "text"), p, wide=True)
    classes = contexts.groupBy(F.col("seed").alias("grp"), F.col("own").alias("node")).agg(F.first("left").alias("left"), F.first("context").alias("context"), F.first("early").alias("early"), F.first("late").alias("late"), F.sum(F.size("pos")).cast("long").alias("copies"), F.min("doc").alias("least"))
    classes = stage(classes.withColumn("a", F.lit(p.seed)).withColumn("b", F.lit(p.width)))
    places = contexts.select(F.col("own").alias("node"), "row", F.explode("pos").alias("pos")).join(_groups(classes, p), "node")
    pieces = stage(places.select("grp", "row", (F.col("pos") + F.col("lo")).alias("start"), (F.col("hi") - F.col("lo")).alias("n")).distinct())
    # pieces with the same occurrences, but for a shift, are parts of one repeat
    first = pieces.groupBy("grp").agg(F.min(F.struct("row", "start")).alias("first"), F.max("n").alias("n"))
    shifted = pieces.drop("n").join(first, "grp").withColumn("shift", F.col("start") - F.col("first.start"))
    alike = shifted.groupBy("grp").agg(F.count("*").alias("k"), F.sum(F.xxhash64("row", "shift").cast("decimal(20,0)")).alias("sum"), F.max("first").alias("first"), F.max("n").alias("n"))
    alike = alike.where("k > 1").withColumn("from", F.col("first.start")).withColumn("to", F.col("from") + F.col("n"))
    w = Window.partitionBy("k", "sum", "first.row").orderBy("from", "to")  # the pieces of one repeat
    until = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    alike = alike.withColumn("fresh", F.coalesce(F.col("from") > until, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(w))
    whole = alike.groupBy("k", "sum", F.col("first.row").alias("first_row"), "run").agg(F.min(F.struct("from", "grp")).alias("head"), F.max("to").alias("to"))
    whole = whole.select(F.col("head.grp").alias("grp"), (F.col("to") - F.col("head.from")).alias("n_symbols"))
    found = pieces.select("grp", "row", "start").join(whole, "grp").join(rows.select("row", "doc_id"), "row")
    return found.select(F.col("grp").alias("repeat"), F.col("n_symbols").cast("long").alias("n_symbols"), "row", "doc_id", F.col("start").cast("long").alias("start"))
