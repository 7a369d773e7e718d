"""Suffix-array dedup: the common-prefix interval tree of an enhanced suffix array.

Each batch of whole seed groups is a sparse suffix array with its common-prefix table. A stack
scan over the table gives the interval tree; an interval of depth d has all suffixes that share d
bytes. Its members are then split by what stands to their left: members that also share
``width - d`` bytes there are one group of occurrences of a repeat, and how far each one's left
context agrees with its nearest neighbour's bounds the repeat on that side. Intervals whose
members differ at once on the left have no such group and are passed over.

Defined results: a null text counts as empty; texts shorter than ``width`` lose nothing; a text of any
length is searched whole; every row is a document of its own, also if its doc_id is repeated, so equal
rows are occurrences of each other; a row with a null doc_id is an occurrence too, but keeps its own
bytes; an empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, words
from tessera.llm.repeats import Batch, Windows, common, numbered, repeated_spans, row_order

BYTES = Windows(width=400, seed=64, unit="byte", earlier_only=False)


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval of at least that depth, children first."""
    stack = [(0, 0)]
    n = len(lcp)
    for i, h in enumerate(lcp.tolist() + [0]):
        if i == 0:
            continue
        left = i - 1
        while stack[-1][0] > h:
            depth, left = stack.pop()
            if depth >= least:
                yield depth, left, i - 1
        if stack[-1][0] < h:
            stack.append((h, left))
    assert len(stack) == 1 or n == 0


def repeat_groups(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """How far back and ahead of its seed each suffix lies in a repeat of the full width."""
    n, width, seed = batch.n, batch.p.width, batch.p.seed
    back, on = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return back, on
    sa = row_order(batch.ahead)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common(batch.ahead[sa[1:]], batch.ahead[sa[:-1]])
    beside = np.zeros(n, np.int64)
    near = np.flatnonzero(lcp >= seed)
    beside[near] = common(batch.back[sa[near]], batch.back[sa[near - 1]])
    rank = np.empty(n, np.int64)
    by_left = row_order(batch.back)
    rank[by_left] = np.arange(n)
    for depth, first, last in intervals(lcp, seed):
        if last == first + 1:
            b = int(beside[last])
            if b + depth >= width:
                for x in (sa[first], sa[last]):
                    back[x], on[x] = max(back[x], b), max(on[x], depth)
            continue
        members = sa[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = common(batch.back[members[1:]], batch.back[members[:-1]])
        if shared.max() + depth < width:
            continue
        best = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
        hit = best + depth >= width
        x = members[hit]
        back[x], on[x] = np.maximum(back[x], best[hit]), np.maximum(on[x], depth)
    return back, on


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _whole_characters(data: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Runs shrunk so that a character that is removed in part stays whole."""
    out = []
    for lo, hi in runs:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append([lo, hi])
    return out


def _word_bytes(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes."""
    if not spans:
        return []
    starts, ends, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return [(int(starts[lo]), int(ends[hi - 1])) for lo, hi in spans]


def remove_repeats(docs: DataFrame, p: Windows = BYTES, carry: tuple[str, ...] = (), whole_characters: bool = False, passages: Windows | None = None) -> DataFrame:
    """doc_id, the columns named in carry, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans.

    With ``passages``, windows of words, the words that lie in a repeated one go as well.
    """
    texts = numbered(docs, *carry)
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    spans = repeated_spans(texts, p, repeat_groups)
    if passages:
        both = spans.withColumn("unit", F.lit("byte")).unionByName(repeated_spans(texts, passages, repeat_groups).withColumn("unit", F.lit("word")))
        spans = both.groupBy("row").agg(*[F.flatten(F.collect_list(F.when(F.col("unit") == u, F.col("spans")))).alias(c) for u, c in (("byte", "spans"), ("word", "word_spans"))])
    found_columns = ["spans", "word_spans"] if passages else ["spans"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts, *found = (batch.column(batch.schema.get_field_index(c)) for c in ("text", *found_columns))
                kept, counts = [], []
                for k in range(len(batch)):
                    data = (texts[k].as_py() or "").encode()
                    own = [[(x["lo"], x["hi"]) for x in f[k].as_py() or []] for f in found]
                    runs = merged(own[0] + _word_bytes(data, own[1]) if passages else own[0])
                    if whole_characters:
                        runs = _whole_characters(data, runs)
                    parts, done = [], 0
                    for lo, hi in runs:
                        parts.append(data[done:lo])
                        done = hi
                    kept.append(b"".join([*parts, data[done:]]) if runs else data)
                    counts.append((len(data), len(data) - len(kept[-1]), len(runs)))
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *carry)], pa.array(kept, pa.binary()), *columns], names=["doc_id", *carry, "kept", "n_bytes", "n_removed", "n_spans"])

    named = F.col("doc_id").isNotNull()
    joined = texts.join(spans, "row", "left").select("doc_id", *carry, "text", *[F.when(named, F.col(c)).alias(c) for c in found_columns])
    extra = "".join(f"`{c}` {types[c]}, " for c in carry)
    return joined.mapInArrow(cut, f"doc_id long, {extra}kept binary, n_bytes long, n_removed long, n_spans long")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
