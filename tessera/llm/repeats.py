"""Exact repeats of fixed-length windows, found from few suffixes.

A window is ``width`` consecutive symbols (bytes or words) of one document. Among the
``width - seed + 1`` seeds (``seed`` consecutive symbols) of a window, the one with the least
hash, leftmost on ties, is its anchor. The choice depends on the window's content alone, so
equal windows have anchors at the same place in them, and only anchors need to be compared:
about ``2 / (width - seed)`` of all suffixes. Each anchor stands for a run of windows and
carries the symbols that those windows cover, to the left and to the right.

Seeds that occur once in the corpus are dropped by a count (partial sums before the shuffle);
the others are grouped by seed. ``resolve`` is the caller's index structure over one batch of
whole groups. For seeds with more than ``group_limit`` occurrences equal contexts are merged first.
A seed with more different contexts than that is split by longer prefixes: a window that covers the
seed has some number ``e`` of symbols from the seed's start on, and a group is a range of ``e``. All
windows of the range ``a`` to ``b`` agree in ``a`` symbols onward and ``width - b`` symbols back, so contexts
that differ there part; each context is cut to what such windows can cover, and equal ones merge.
Ranges are halved until every group fits; a range of one value is one window, and one group of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import (
    BYTE_SYMBOLS,
    chunks,
    identified,
    stage,
    text_buffer,
    unstage,
    window_hash,
    word_hashes,
    words,
)

_LOW = np.uint64((1 << 24) - 1)
#: Symbols of one document that are searched for anchors at a time; such pieces overlap by a window.
_PIECE = 1 << 22


@dataclass(frozen=True)
class Windows:
    width: int
    seed: int
    unit: str  # "byte" or "word"
    earlier_only: bool  # a window counts if it also starts in a document with a smaller id
    group_limit: int = 2048
    batch: int = 2048


def _symbols(raw: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    if unit == "byte":
        return BYTE_SYMBOLS[raw], offsets
    starts, ends, first = words(raw, offsets)
    return word_hashes(raw, starts, ends), first


def _sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    n = len(values)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def find_anchors(symbols: np.ndarray, bounds: np.ndarray, p: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, position, first and last window start of each anchor; rows are bounds[i]:bounds[i + 1]."""
    n, w = len(symbols), p.width - p.seed + 1
    none = np.zeros(0, np.int64)
    if n < p.width:
        return np.zeros(0, np.uint64), none, none, none
    if n > _PIECE + p.width:
        parts = []
        for at in range(0, n - p.width + 1, _PIECE):
            end = min(n, at + _PIECE + p.width - 1)
            cut = np.unique(np.concatenate([[at], np.clip(bounds, at, end), [end]]))
            key, pos, lo, hi = find_anchors(symbols[at:end], cut - at, p)
            parts.append((key, pos + at, lo + at, hi + at))
        return tuple(np.concatenate(x) for x in zip(*parts))
    key = window_hash(symbols, p.seed)
    order = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)
    least = _sliding_least(order, w)
    first, last = bounds[:-1], bounds[1:] - p.width + 1
    some = last > first
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some], -1)
    start = np.flatnonzero(np.cumsum(change[: len(least)]) > 0)
    if not len(start):
        return np.zeros(0, np.uint64), none, none, none
    pos = (least[start] & _LOW).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1)]))
    tail = np.concatenate([head[1:] - 1, [len(start) - 1]])
    return key[pos[head]], pos[head], start[head], start[tail]


def numbered(docs: DataFrame, *carry: str, nulls: bool = True) -> DataFrame:
    """row, doc_id, text and the columns named in carry, row telling the rows apart: doc_id itself where that does.

    With ``nulls`` false a null doc_id is no fault, since such rows take no part in the search.
    """
    texts = identified(docs, "doc_id", "text", *carry)
    same = texts.groupBy("doc_id").agg(F.count("*").alias("n"))
    if same.where("n > 1 and doc_id is not null" + " or doc_id is null" * nulls).limit(1).count():
        return stage(texts.select(F.monotonically_increasing_id().alias("row"), *texts.columns))
    return texts.select(F.col("doc_id").alias("row"), *texts.columns)


def anchors(texts: DataFrame, p: Windows) -> DataFrame:
    """seed, row and places: position, first and last window start of each occurrence, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            offsets, raw = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                symbols, bounds = _symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.unit)
                key, pos, lo, hi = find_anchors(symbols, bounds, p)
                row = np.searchsorted(bounds, pos, side="right") - 1
                order = np.lexsort((pos, key, row))
                key, row = key[order], row[order]
                places = np.stack([x[order] - bounds[row] for x in (pos, lo, hi)], axis=1).astype(np.int32)
                # a seed that a document has many times is one row
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
                ends = np.append(head, len(key)).astype(np.int32) * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[head].view(np.int64)), ids.take(pa.array(row[head] + i)), pa.ListArray.from_arrays(pa.array(ends), pa.array(places.ravel()))],
                    names=["seed", "row", "places"],
                )

    return texts.select("row", "text").mapInArrow(run, "seed long, row long, places array<int>")


def _contexts(joined: DataFrame, p: Windows, wide: bool = False) -> DataFrame:
    """Anchors of repeated seeds with the text that their windows cover; equal ones of a document share a row.

    With ``wide`` a context reaches two widths to both sides, whichever windows are the anchor's, and each has its digest;
    early and late are the first and last start of the anchor's windows, relative to it.
    """
    schema = "seed long, crowded boolean, row long, doc long, pos array<int>, left int, units int, own long, context binary" + ", early int, late int" * wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.int32()] * 2 * wide]
        out: list[list] = [[] for _ in names]
        size = 0

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            rows, docs, texts, hits = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc", "text", "hits"))
            for k in range(len(batch)):
                data = texts[k].as_py().encode()
                units = data if p.unit == "byte" else data.split()  # bytes split at exactly the bytes 9 to 13 and 32
                row, doc = rows[k].as_py(), docs[k].as_py()
                found = hits[k].values.flatten()
                equal: dict[tuple, list[int]] = {}
                for seed, places, crowded in zip(*[found[c].to_pylist() for c in range(3)]):
                    for pos, lo, hi in zip(places[::3], places[1::3], places[2::3]):
                        end, reach = hi + p.width, (lo - pos, hi - pos) if wide else ()
                        if wide:
                            lo, end = max(0, pos - 2 * p.width), min(len(units), pos + 2 * p.width)
                        piece = units[lo:end] if p.unit == "byte" else b" ".join(units[lo:end])
                        equal.setdefault((seed, crowded, pos - lo, end - lo, piece, reach), []).append(pos)
                for (seed, crowded, left, length, piece, reach), pos in equal.items():
                    own = int.from_bytes(hashlib.blake2b(piece, digest_size=8, key=b"%d %d" % (seed, left)).digest(), "little", signed=True) if crowded or wide else None
                    for x, v in zip(out, (seed, crowded, row, doc, pos, left, length, own, piece, *reach)):
                        x.append(v)
                    size += len(piece) + 40
                if size > 1 << 20:
                    yield flush()
                    size = 0
        if out[0]:
            yield flush()

    return joined.mapInArrow(run, schema)


class Batch:
    """Anchors of whole seed groups as rows of symbols around the seed, equal rows merged.

    ``ahead[i]`` has the symbols from the seed on and ``back[i]`` those before it, nearest first,
    filled with values that no other row has, so that common prefixes never run past a text.
    """

    def __init__(self, seed: np.ndarray, left: np.ndarray, contexts: list[bytes], docs: np.ndarray, copies: np.ndarray, p: Windows):
        self.p = p
        order: dict[tuple, int] = {}
        member = np.empty(len(contexts), np.int64)
        for i, key in enumerate(zip(seed.tolist(), left.tolist(), contexts)):
            member[i] = order.setdefault(key, len(order))
        n = len(order)
        self.member, self.n = member, n
        self.count = np.zeros(n, np.int64)
        np.add.at(self.count, member, copies)
        self.least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.least, member, docs)
        self.seed = np.fromiter((k[0] for k in order), np.int64, n)
        lefts = np.fromiter((k[1] for k in order), np.int64, n)
        raw = np.frombuffer(b"".join(k[2] for k in order), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(k[2]) for k in order], dtype=np.int64)])
        if p.unit == "byte":
            kind = np.int16 if n < 30_000 else np.int32
            symbols, bounds = raw.astype(kind), offsets
        else:
            starts, ends, bounds = words(raw, offsets)
            symbols, kind = word_hashes(raw, starts, ends).view(np.int64), np.int64
        self.right_len, self.left_len = np.diff(bounds) - lefts, lefts
        span, own = p.width, -1 - np.arange(n, dtype=kind)[:, None]
        middle = (bounds[:-1] + lefts).astype(np.int32)[:, None]
        if not len(symbols):
            symbols = np.zeros(1, kind)
        steps = np.arange(span, dtype=np.int32)
        self.ahead = np.where(steps < self.right_len[:, None], symbols[np.minimum(middle + steps, len(symbols) - 1)], own)
        self.back = np.where(steps < lefts[:, None], symbols[np.maximum(middle - 1 - steps, 0)], own)


def row_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows as strings of bytes: rows with long common prefixes lie side by side."""
    rows = np.ascontiguousarray(rows)
    return np.argsort(rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel(), kind="stable")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    at = differ.argmax(axis=1)
    at[~differ.any(axis=1)] = a.shape[1]
    return at


def seed_groups(contexts: DataFrame, columns: tuple[str, ...], schema: str, size: int, work: Callable[[list], pa.RecordBatch]) -> DataFrame:
    """work on lists of column slices that hold whole seeds, about size rows at a time; the first column is the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            rest = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            while len(rest[0]):
                take = min(len(rest[0]), 1024)
                part, rest = [c.slice(0, take) for c in rest], [c.slice(take) for c in rest]
                keys = part[0].to_numpy()
                if n >= size:  # cut where a new seed begins
                    same = int(np.searchsorted(keys != rows[-1][0][-1].as_py(), True))
                    if same < take:
                        if same:
                            rows.append([c.slice(0, same) for c in part])
                        yield work(rows)
                        rows, n, part = [], 0, [c.slice(same) for c in part]
                rows.append(part)
                n += len(part[0])
        if rows:
            yield work(rows)

    return contexts.repartition(columns[0]).sortWithinPartitions(columns[0]).select(*columns).mapInArrow(run, schema)


def _resolved(contexts: DataFrame, p: Windows, resolve: Callable[[Batch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """seed, key, pos, and lo and hi of repeated symbols relative to pos, of rows (seed, key, doc, copies, pos, left, context)."""

    def spans(rows: list) -> pa.RecordBatch:
        seed, key, docs, copies, left = (np.concatenate([r[c].to_numpy() for r in rows]) for c in (0, 1, 2, 3, 5))
        batch = Batch(seed, left, [x for r in rows for x in r[6].to_pylist()], docs, copies, p)
        reach_back, reach_on = resolve(batch)
        m = batch.member
        whole = docs > batch.least[m] if p.earlier_only else batch.count[m] > 1
        lo = -np.where(whole, batch.left_len[m], reach_back[m])
        hi = np.where(whole, batch.right_len[m], reach_on[m])
        keep = hi - lo >= p.width
        pos = pa.concat_arrays([r[4] for r in rows]).filter(pa.array(keep))
        seed, key, lo, hi = (pa.array(x[keep]) for x in (seed, key, lo.astype(np.int32), hi.astype(np.int32)))
        return pa.RecordBatch.from_arrays([seed, key, pos, lo, hi], names=["seed", "key", "pos", "lo", "hi"])

    columns = ("seed", "key", "doc", "copies", "pos", "left", "context")
    return seed_groups(contexts, columns, "seed long, key long, pos array<int>, lo int, hi int", p.batch, spans)


def _placed(lo, hi):
    """The span at each place of a row."""
    return F.transform("pos", lambda x: F.struct((x + lo).alias("lo"), (x + hi).alias("hi"))).alias("spans")


def halved(crowded: DataFrame, p: Windows) -> DataFrame:
    """Classes of groups that are too large -> their parts in both halves of the range of e: parent, and columns of a class."""
    schema = "parent long, grp long, a int, b int, node long, copies long, least long, left int, units int, context binary"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def digest(kind: str, a: int, b: int, left: int, data: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=f"{kind} {a} {b} {left}".encode()).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                rows = []
                for node, a, b, copies, least, left, context in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "a", "b", "copies", "least", "left", "context")]):
                    units = context if p.unit == "byte" else context.split(b" ")
                    right, middle = len(units) - left, (a + b) // 2
                    for lo, hi in ((a, middle), (middle + 1, b)):
                        back, on = min(left, p.width - lo), min(right, hi)
                        if right < lo or left < p.width - hi:
                            continue  # it has no window of this half
                        cut = units[left - back : left + on]
                        core = units[left - (p.width - hi) : left + lo]
                        if p.unit == "word":
                            cut, core = b" ".join(cut), b" ".join(core)
                        rows.append((node, digest("group", lo, hi, 0, core), lo, hi, digest("class", lo, hi, back, cut), copies, least, back, back + on, cut))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return crowded.select("node", "a", "b", "copies", "least", "left", "context").mapInArrow(run, schema)


def _class_spans(classes: DataFrame, p: Windows, resolve: Callable[[Batch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """node, lo, hi: the repeated symbols of each class (grp, a, b, node, copies, least, left, units, context), for its least document."""
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n"))
    classes = stage(classes.join(sizes, "grp"))
    few = classes.where((F.col("n") <= p.group_limit) & ((F.col("n") > 1) | (F.col("copies") > 1)))
    few = few.select(F.col("grp").alias("seed"), F.col("node").alias("key"), F.col("least").alias("doc"), "copies", F.array(F.lit(0)).alias("pos"), "left", "context")
    found = _resolved(few, p, resolve).select(F.col("key").alias("node"), "lo", "hi")
    crowded = classes.where(F.col("n") > p.group_limit)
    if not crowded.limit(1).count():
        return found
    parts = stage(halved(crowded, p))
    children = parts.groupBy("node").agg(*[F.first(c).alias(c) for c in ("grp", "a", "b", "left", "units", "context")], F.sum("copies").alias("copies"), F.min("least").alias("least"))
    children = stage(children)
    below = children.select("node", F.col("least").alias("first_doc")).join(_class_spans(children, p, resolve), "node", "left")
    back = parts.select("parent", "node", "least", "left", "units").join(below, "node")
    lo, hi = F.col("lo"), F.col("hi")
    if p.earlier_only:
        later = F.col("least") > F.col("first_doc")
        lo, hi = F.when(later, -F.col("left")).otherwise(lo), F.when(later, F.col("units") - F.col("left")).otherwise(hi)
    # windows of one class all cover its seed, so their union has no gap
    back = back.groupBy(F.col("parent").alias("node")).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).where("lo is not null")
    return found.unionByName(back)


def _crowded(contexts: DataFrame, p: Windows, resolve: Callable[[Batch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Spans for very frequent seeds: equal contexts are merged before they meet in a task."""
    merged = [F.first(c).alias(c) for c in ("left", "units", "context")]
    classes = contexts.groupBy("seed", "own").agg(F.sum(F.size("pos")).alias("copies"), F.min("doc").alias("least"), F.max("doc").alias("most"), *merged)
    classes = stage(classes)
    whole = classes.select(F.col("seed").alias("grp"), F.lit(p.seed).alias("a"), F.lit(p.width).alias("b"), F.col("own").alias("node"), "copies", "least", "left", "units", "context")
    found = classes.select(F.col("own").alias("node"), "least", "most").join(_class_spans(whole, p, resolve), "node", "left")
    found = stage(found.where("lo is not null or most > least" if p.earlier_only else "lo is not null"))
    members = contexts.select(F.col("own").alias("node"), "row", "doc", "pos", "left", "units").join(found, "node")
    first, last = F.col("lo"), F.col("hi")
    if p.earlier_only:  # a later document repeats the whole context of the least one
        later = F.col("doc") > F.col("least")
        first = F.when(later, -F.col("left")).otherwise(first)
        last = F.when(later, F.col("units") - F.col("left")).otherwise(last)
    members = members.select("row", "pos", first.alias("first"), last.alias("last")).where("first is not null")
    return members.select("row", _placed(F.col("first"), F.col("last")))


def repeated_contexts(texts: DataFrame, p: Windows, wide: bool = False) -> DataFrame:
    """Staged contexts of all anchors whose seed stands twice or more. texts: row, doc, text."""
    found = stage(anchors(texts, p))
    often = stage(found.groupBy("seed").agg((F.sum(F.size("places")) / 3).alias("n")).where("n > 1"))
    hits = found.join(often, "seed").withColumn("crowded", F.col("n") > p.group_limit)
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("seed", "places", "crowded")).alias("hits"))
    contexts = stage(_contexts(texts.join(hits, "row"), p, wide))
    unstage(found, often)
    return contexts


def repeated_spans(texts: DataFrame, p: Windows, resolve: Callable[[Batch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """row and spans: array of (lo, hi), in symbols; every repeated window lies in one of them. texts: row, doc_id, text."""
    texts = texts.where("text is not null").select("row", F.col("doc_id" if p.earlier_only else "row").alias("doc"), "text")
    if p.earlier_only:
        texts = texts.where("doc is not null")
    contexts = repeated_contexts(texts, p)
    usual = contexts.where("not crowded").select("seed", F.col("row").alias("key"), "doc", F.size("pos").cast("long").alias("copies"), "pos", "left", "context")
    spans = _resolved(usual, p, resolve).select(F.col("key").alias("row"), _placed(F.col("lo"), F.col("hi")))
    crowded = contexts.where("crowded")
    if crowded.limit(1).count():
        spans = spans.unionByName(_crowded(crowded, p, resolve))
    return spans.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
