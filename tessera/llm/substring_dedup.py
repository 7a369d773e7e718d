"""Substring dedup: prefix-partitioned suffix trees over words.

Suffixes are split by a prefix of ``seed`` words into groups that fit in memory, a batch of
groups becomes one suffix tree, and every internal node deep enough gives the repeats that its
leaves share. A group with more than ``group_limit`` different contexts is split by longer prefixes (see
``repeats``) until each part has a tree of its own. A word goes if a window of ``width`` words that covers it also starts in
a document with a smaller id.

Defined results: a null or blank text has no words and keeps the empty string; documents of fewer
than ``width`` words lose nothing; a text of any length is searched whole; of equal documents the one with
the smallest id stays whole; rows that repeat a doc_id are judged each, and none has a smaller id than the
other; a null doc_id is smaller than none, so such a row keeps its words and takes none; an empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.repeats import Batch, Windows, common, numbered, repeated_spans, row_order

WORDS = Windows(width=50, seed=8, unit="word", earlier_only=True)


def _earlier(shared: list[int], least: list[int], width: int) -> list[int]:
    """For leaves in left-context order: the longest left context shared with a leaf of a smaller id, -width if none has one."""
    n = len(least)
    best = [-width] * n
    for order, step in ((range(n), -1), (range(n - 1, -1, -1), 0)):
        stack: list[tuple[int, int]] = []  # a leaf, and what it shares with the one under it
        for i in order:
            run = shared[i + step] if stack else 0
            while stack and least[stack[-1][0]] >= least[i]:
                run = min(run, stack.pop()[1])
            if stack:
                best[i] = max(best[i], run)
            stack.append((i, run))
    return best


def deep_nodes(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """How far back and ahead of its seed each suffix repeats one of a smaller document."""
    n, width, seed = batch.n, batch.p.width, batch.p.seed
    back, on = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return back, on
    leaves = row_order(batch.ahead)
    fork = np.zeros(n, np.int64)
    fork[1:] = common(batch.ahead[leaves[1:]], batch.ahead[leaves[:-1]])
    beside = np.zeros(n, np.int64)
    near = np.flatnonzero(fork >= seed)
    beside[near] = common(batch.back[leaves[near]], batch.back[leaves[near - 1]])
    rank = np.empty(n, np.int64)
    rank[row_order(batch.back)] = np.arange(n)
    least = batch.least
    cuts = np.flatnonzero(fork < seed)
    nodes = [(a, b - 1) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n]) if b - a > 1]
    while nodes:
        first, last = nodes.pop()
        if last == first + 1:
            depth, b = int(fork[last]), int(beside[last])
            x, y = leaves[first], leaves[last]
            if b + depth >= width and least[x] != least[y]:
                late = x if least[x] > least[y] else y
                back[late], on[late] = max(back[late], b), max(on[late], depth)
            continue
        inside = fork[first + 1 : last + 1]
        depth = int(inside.min())
        members = leaves[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = common(batch.back[members[1:]], batch.back[members[:-1]])
        if shared.max() + depth >= width:
            best = np.array(_earlier(shared.tolist(), least[members].tolist(), width))
            hit = best + depth >= width
            x = members[hit]
            back[x], on[x] = np.maximum(back[x], best[hit]), np.maximum(on[x], depth)
        edges = np.flatnonzero(inside == depth) + first + 1
        bounds = [first, *edges.tolist(), last + 1]
        nodes += [(a, b - 1) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
    return back, on


def remove_repeated_words(docs: DataFrame, p: Windows = WORDS) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed."""
    texts = numbered(docs, nulls=False)
    spans = repeated_spans(texts, p, deep_nodes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts, found = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("spans"))
                kept, total, gone = [], [], []
                for k in range(len(batch)):
                    own = (texts[k].as_py() or "").encode().split()
                    stay, done = [], 0
                    if found[k].is_valid:
                        for lo, hi in sorted((x["lo"], x["hi"]) for x in found[k].as_py()):
                            stay += own[done:lo]
                            done = max(done, hi)
                    stay += own[done:]
                    kept.append(b" ".join(stay).decode())
                    total.append(len(own))
                    gone.append(len(own) - len(stay))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

    joined = texts.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, kept string, n_words long, n_removed long")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
