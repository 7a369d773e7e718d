"""Periodic runs: stretches of words that repeat with a period, found by block matching.

A document's words become whole numbers. For each power of two k, the document is dealt into aligned blocks of
k words; the blocks are keys of an Aho-Corasick automaton over whole numbers, and the document is searched for them.
An occurrence of a block q words further on, k <= q < 2 k, is a seed: a run of period q and at least three periods
holds an aligned block of k words and its copy. Seeds are extended word by word in both directions, exactly.

Two exact rules keep the work small. A word of a run of period q comes again within q words or, at the run's end, came
before, so a block whose words do not all come again within 2 k words is no key. And where a block and its copy lie in a run of a
smaller period, Fine and Wilf's theorem says that a run of the larger period would be that same run, so they seed nothing. A run of n equal words
thus costs one seed, not n squared.

Every document is worked on alone, by one task; nothing is shuffled. Memory follows the longest document of a batch.

Defined results: a null, empty or blank text has no words and no runs; ties for the longest run go to the smallest
start, then the smallest period; repeated rows and rows without an id are worked on each; an empty table gives no rows;
columns other than doc_id and text are ignored; texts of any length count whole.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import identified, table


@dataclass(frozen=True)
class Periods:
    """A run has at least ``least`` words and ``exponent`` periods; an exponent of three or more lets blocks find all runs."""

    exponent: int = 4
    least: int = 6

    def __post_init__(self):
        if self.exponent < 3 or self.least < 1:
            raise ValueError("an exponent of three at least, and a positive length")


def _agree(ids: np.ndarray, q: int, at: int) -> tuple[int, int]:
    """The largest range (lo, hi) around at with ids[x] == ids[x + q] for all lo <= x < hi."""
    n, step, hi = len(ids) - q, 64, at
    while hi < n:
        end = min(hi + step, n)
        other = np.flatnonzero(ids[hi:end] != ids[hi + q : end + q])
        if other.size:
            hi += int(other[0])
            break
        hi, step = end, 2 * step
    lo, step = at, 64
    while lo > 0:
        begin = max(0, lo - step)
        other = np.flatnonzero(ids[begin:lo] != ids[begin + q : lo + q])
        if other.size:
            lo = begin + int(other[-1]) + 1
            break
        lo, step = begin, 2 * step
    return lo, hi


def _next_same(ids: np.ndarray) -> np.ndarray:
    """Distance to the next equal number, or a large one."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids) + 1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


class _Found:
    """Runs by start, so that a place can be looked up among those of smaller periods."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []  # start, end, period
        self.reach: list[int] = []  # the furthest end among the runs up to here

    def add(self, fresh: list[tuple[int, int, int]]) -> None:
        self.runs = sorted(self.runs + fresh)
        far, self.reach = 0, []
        for _, end, _ in self.runs:
            far = max(far, end)
            self.reach.append(far)

    def covers(self, lo: int, hi: int) -> bool:
        """Whether one run holds lo to hi."""
        i = bisect_right(self.runs, (lo, 1 << 62, 0)) - 1
        while i >= 0 and self.reach[i] >= hi:
            if self.runs[i][1] >= hi:
                return True
            i -= 1
        return False


def runs(ids: np.ndarray, p: Periods = Periods()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, found, k = len(ids), _Found(), 1
    ahead = _next_same(ids) if n >= p.least else None
    symbols: list[int] | None = None
    while n >= p.least and p.exponent * k <= n:
        whole = n // k
        live = np.flatnonzero((ahead[: whole * k] < 2 * k).reshape(whole, k).all(axis=1)) * k
        live = [i for i in live.tolist() if not found.covers(i, min(n, i + 3 * k))]
        if live:
            if symbols is None:
                symbols = ids.tolist()
            seeds: dict[int, list[int]] = {}
            blocks: dict[tuple[int, ...], list[int]] = {}
            for i in live:
                blocks.setdefault(tuple(symbols[i : i + k]), []).append(i)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for block, places in blocks.items():
                automaton.add_word(block, (places, [0]))
            automaton.make_automaton()
            for end, (places, passed) in automaton.iter(tuple(symbols)):
                j = end - k + 1  # a copy here belongs to the blocks that start 2 k - 1 to k words before it
                while passed[0] < len(places) and j - places[passed[0]] >= 2 * k:
                    passed[0] += 1
                at = passed[0]
                while at < len(places) and j - places[at] >= k:  # one place at most: aligned blocks are k words apart
                    seeds.setdefault(j - places[at], []).append(places[at])
                    at += 1
            fresh = []
            for q, places in sorted(seeds.items()):
                done = -1  # equal words at distance q are known up to here
                for i in places:
                    if i < done or found.covers(i, i + k + q):
                        continue
                    lo, hi = _agree(ids, q, i)
                    done = hi
                    if hi - lo + q >= max(p.least, p.exponent * q) and not found.covers(lo, hi + q):
                        fresh.append((lo, hi + q, q))
            if fresh:
                found.add(fresh)
        k *= 2
    return [(lo, hi - lo, q) for lo, hi, q in found.runs]


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten, by a checksum of its id, repeats a stretch of its words up to its end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _document(words: list[bytes], p: Periods) -> tuple:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    own = runs(ids, p)
    listed = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in own).encode()).hexdigest()
    if own:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, size, q in own:
            edge[s + q] += 1
            edge[s + size] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return own, listed, words


RUN = "struct<start: long, length: long, period: long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, runs_sha256 string, collapsed string, collapsed_sha256 string"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, p: Periods = Periods(), loops: bool = False, texts: bool = True) -> DataFrame:
    """All runs of each row, and its words without what repeats; ``loops`` applies looped() first.

    Without ``texts`` the column collapsed is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, found, listed, kept, digests = batch.column(0), [], [], [], [], []
            for doc_id, text in zip(ids, batch.column(1)):
                words = (text.as_py() or "").encode().split()  # bytes are split at space and 9 to 13
                if loops:
                    words = looped(words, doc_id.as_py())
                sizes.append(len(words))
                own, digest, words = _document(words, p)
                found.append([{"start": s, "length": size, "period": q} for s, size, q in own])
                listed.append(digest)
                left = b" ".join(words)
                kept.append(left.decode() if texts else None)
                digests.append(hashlib.sha256(left).hexdigest())
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(found, _ARROW), pa.array(listed, pa.string()), pa.array(kept, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "runs_sha256", "collapsed", "collapsed_sha256"])

    return identified(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), loops=True, texts=False)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    found = found.withColumn("top", top)
    period = -F.col("top.less")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("top.length") / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
