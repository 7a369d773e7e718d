"""Near-duplicate functions: candidates by an index of shingles, or by all sizes in range; compression distance; connected components."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from hashlib import md5
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera import constants as C
from tessera.sources.staging import written


def pair_candidates(rows: DataFrame, key: str, size: str, group: str | None, ratio: float = C.SIZE_RATIO, first: int | None = None) -> DataFrame:
    """a < b of rows of one group whose sizes differ by the ratio at most, found by size buckets.

    Sizes within a ratio of 2 lie in the same or in neighbouring buckets of powers of two, so one side is
    repeated three times and the join has equal keys only. Rows without a size or group have no pair. With ``first``
    only pairs with b from there on are made: those of rows that came later.
    """
    group_column = F.col(group) if group else F.lit(0)
    own = rows.select(F.col(key).alias("id"), F.col(size).alias("n"), group_column.alias("g")).where("n > 0")
    bucket = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    reach = int(-(-(ratio - 1) // 1)) or 1
    left = own.select(F.col("id").alias("a"), F.col("n").alias("na"), "g", F.explode(F.sequence(bucket - reach, bucket + reach)).alias("bucket"))
    later = own if first is None else own.where(F.col("id") >= first)
    right = later.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g", bucket.alias("bucket"))
    found = large(left).join(large(right), ["g", "bucket"]).where("a < b")
    return found.where(F.greatest("na", "nb") <= ratio * F.least("na", "nb")).select("a", "b")


def large(rows: DataFrame) -> DataFrame:
    """Rows whose joins sort both sides: a table of copies is a small file with very many rows, and by the file's size Spark would gather it on the driver."""
    return rows.hint("merge")


@F.pandas_udf(LongType())
def compressed_size(data: pd.Series) -> pd.Series:
    return data.map(lambda b: len(zlib.compress(bytes(b), 6)) if b else 0)


def compress_ratio(content: Column) -> Column:
    """Compressed size over size; null for short contents."""
    size = F.octet_length(content)
    return F.when(size >= C.LEAST_COMPRESSED, compressed_size(content) / size)


def distance(x: Column, y: Column, both: Column) -> Column:
    """Normalised compression distance from the sizes of x, of y and of both together."""
    found = (both - F.least(x, y)) / F.greatest(x, y)
    return F.when((x <= 0) | (y <= 0) | (both <= 0), F.lit(1.0)).otherwise(F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))


#: A word, or a sign of its own.
TOKENS = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]"
_TOKENS = re.compile(TOKENS.encode())


@dataclass(frozen=True)
class Index:
    """Posting lists of shingles of so many ``tokens``.

    A text has the ``sketch`` least hashes of its shingles and is posted under ``posted`` of them: first under those with the longest lists that
    are still read wholly, then under the shortest of the others. A list is read in order of size, and each text meets the ``near`` that follow it, so
    the candidates of a text are bounded and a list that is common to very many texts costs no more than its length; lists of more
    than ``piece`` texts are dealt into pieces.
    """

    tokens: int = 4
    sketch: int = 64
    posted: int = 16
    near: int = 16
    piece: int = 4096


#: Tokens of a text that are hashed at a time.
SLICE = 1 << 16


def least_hashes(text: bytes, index: Index) -> np.ndarray:
    """The first 60 bits of the MD5 of each shingle of a UTF-8 text: the least of them, in order."""
    least = np.empty(0, np.int64)
    found = (m.group() for m in _TOKENS.finditer(text))
    words = list(islice(found, SLICE))
    short = len(words) < index.tokens
    while words and (short or len(words) >= index.tokens):
        more = list(islice(found, SLICE))
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digests = b"".join([md5(joined[i : j - 1]).digest() for i, j in zip(starts, ends[min(index.tokens, len(ends)) - 1 :])])
        least = np.unique(np.concatenate([least, (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)]))[: index.sketch]
        words = words[-(index.tokens - 1) :] + more if more and index.tokens > 1 else more
    return least


def sketch(text: Column, index: Index = Index()) -> Column:
    """The least hashes of a text's shingles; a text with fewer tokens is one shingle, without tokens it has none."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: least_hashes(t or b"", index))

    return of(text.cast("binary"))


def sketches(rows: DataFrame, key: str, text: str, size: str, group: str | None, index: Index = Index()) -> DataFrame:
    """id, n (size), g (group) and terms (the least hashes) of the texts that have a size and a group."""
    own = rows.select(F.col(key).alias("id"), F.col(size).alias("n"), (F.col(group) if group else F.lit(0)).alias("g"), F.col(text).alias("text")).where("n > 0 and g is not null")
    return own.select("id", "n", "g", sketch(F.col("text"), index).alias("terms"))


def index_lists(rows: DataFrame, key: str, text: str, size: str, group: str | None, index: Index = Index()) -> DataFrame:
    """id, n (size), g (group) and each term that a text is posted under, with the piece of the term's list."""
    return _lists(written(sketches(rows, key, text, size, group, index)), None, index)


def _lists(own: DataFrame, before: DataFrame | None, index: Index) -> DataFrame:
    """Lists of the terms that texts are posted under, with all texts that came ``before`` and have such a term."""
    posted = own.select("id", "n", "g", F.explode("terms").alias("term"))
    counted = posted
    if before is not None:
        # what came before counts, but for the new terms alone
        before = before.select("id", "n", "g", F.explode("terms").alias("term"))
        before = written(large(before).join(large(posted.select("g", "term").distinct()), ["g", "term"], "left_semi"))
        counted = posted.unionByName(before)
    shared = counted.groupBy("g", "term").agg(F.count("*").alias("k")).where("k > 1")
    order = F.when(F.col("k") <= index.near + 1, -F.col("k")).otherwise(F.col("k"))
    best = F.row_number().over(Window.partitionBy("id", "n", "g").orderBy(order, "term"))
    kept = large(posted).join(large(shared), ["g", "term"]).withColumn("place", best).where(F.col("place") <= index.posted).drop("place")
    if before is not None:
        kept = written(kept)
        kept = kept.unionByName(large(before).join(large(kept.select("g", "term", "k").distinct()), ["g", "term"]))
    return kept.select("id", "n", "g", "term", F.pmod(F.xxhash64("id", "term"), F.ceil(F.col("k") / index.piece)).alias("piece"))


def later_candidates(own: DataFrame, before: DataFrame, first: int, ratio: float = C.SIZE_RATIO, index: Index = Index()) -> DataFrame:
    """a < b of sketches where b is one of the later texts ``own`` (ids from ``first`` on) and a another of them or one that came before.

    Only the lists of terms that a later text has are read. In each it meets ``near`` texts on both sides.
    """
    met = index_neighbours(_lists(own, before, index), ratio, index).where(F.col("id") >= first)
    met = met.select(F.explode(F.array_union("after", "before")).alias("a"), F.col("id").alias("b"))
    return met.where("a < b")  # two later texts meet in the rows of both


def index_neighbours(lists: DataFrame, ratio: float = C.SIZE_RATIO, index: Index = Index()) -> DataFrame:
    """id, after, before and hubs: the different ids that it meets in its lists, by their place in the order of (size, id).

    ``hubs`` has the least id of each run of a list, where a run ends when the next size is out of the ratio. Hubs connect what ``after``
    connects, over few steps: sizes grow along a list, so whoever is near enough in size is in the same run, and neighbours in a
    run are near enough. An id has at most ``posted * near`` of each kind, so all of its ids fit in one row; a list has ``piece`` rows or so.
    """
    w = Window.partitionBy("g", "term", "piece").orderBy("n", "id")
    after = [F.when(F.lead("n", j).over(w) <= ratio * F.col("n"), F.lead("id", j).over(w)) for j in range(1, index.near + 1)]
    before = [F.when(F.col("n") <= ratio * F.lag("n", j).over(w), F.lag("id", j).over(w)) for j in range(1, index.near + 1)]
    starts = F.coalesce(F.col("n") > ratio * F.lag("n").over(w), F.lit(True))
    met = lists.select("id", "g", "term", "piece", "n", F.array(*after).alias("after"), F.array(*before).alias("before"), starts.cast("int").alias("starts"))
    met = met.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("hub", F.array(F.min("id").over(Window.partitionBy("g", "term", "piece", "run"))))

    def different(name: str) -> Column:
        return F.array_compact(F.array_remove(F.array_distinct(F.flatten(F.collect_list(name))), F.col("id"))).alias(name)

    return met.groupBy("id").agg(different("after"), different("before"), different("hub").alias("hubs"))


def pairs_of(neighbours: DataFrame, name: str) -> DataFrame:
    """a < b of an array column of index_neighbours()."""
    found = neighbours.select("id", F.explode(name).alias("other"))
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def index_candidates(rows: DataFrame, key: str, text: str, size: str, group: str | None, ratio: float = C.SIZE_RATIO, index: Index = Index()) -> DataFrame:
    """a < b of rows of one group that meet in a posting list and whose sizes differ by the ratio at most.

    Texts should differ: copies are the caller's to merge. Their number grows with that of the rows; what may be missed are pairs
    without a posted shingle in common and those far from each other in a long list. pair_candidates() gives all pairs. The lesser of a
    pair by size and id finds the other in every list, so pairs are told apart in its row.
    """
    return pairs_of(index_neighbours(index_lists(rows, key, text, size, group, index), ratio, index), "after")


def packed(functions: DataFrame, group: str | None = "family", *more: str) -> DataFrame:
    """func_ord, body, size, packed (compressed size), the group and more columns of the functions that are long enough."""
    bodies = functions.where(F.octet_length("body") >= C.LEAST_BODY)
    return bodies.select("func_ord", "body", F.octet_length("body").alias("size"), compressed_size(F.col("body")).alias("packed"), *([group] if group else []), *more)


def compression_pairs(functions: DataFrame, threshold: float = C.DUPLICATE_DISTANCE, group: str | None = "family", ratio: float = C.SIZE_RATIO, index: Index | None = None) -> DataFrame:
    """a, b and ncd below the threshold; functions have func_ord, body (binary) and the group.

    Each body is compressed once; a pair needs one more compression, of both bodies in a row. With an index, equal bodies are
    merged first (each is paired with the least of them, and their distance is measured once) and candidates come from the index; else all pairs in range are tried.
    """
    if index is None:
        bodies = packed(functions, group)
        return near_pairs(pair_candidates(bodies, "func_ord", "size", group, ratio), bodies, bodies, threshold)
    g = F.col(group) if group else F.lit(0)
    own = functions.where((F.octet_length("body") >= C.LEAST_BODY) & g.isNotNull())
    placed = written(own.select("func_ord", g.alias("g"), F.sha2("body", 256).alias("digest")))
    least = written(placed.groupBy("g", "digest").agg(F.min("func_ord").alias("least"), F.count("*").alias("copies")))
    different = own.join(large(least.select(F.col("least").alias("func_ord"), "g", "digest", "copies")), "func_ord")
    different = written(packed(different, group, "g", "digest", "copies"))
    copies = same_body(placed, different.where("copies > 1"), threshold).where("least < func_ord")
    texts = different.withColumn("text", F.decode("body", "ISO-8859-1"))
    pairs = near_pairs(index_candidates(texts, "func_ord", "text", "size", group, ratio, index), different, different, threshold)
    return pairs.unionByName(copies.select(F.col("least").alias("a"), F.col("func_ord").alias("b"), "ncd"))


def same_body(placed: DataFrame, different: DataFrame, threshold: float) -> DataFrame:
    """func_ord, least and ncd of copies: placed functions of a group and digest of one of the different bodies, whose number (or ``least``) they get.

    Copies are as far apart as a body is from itself.
    """
    least = F.col("least" if "least" in different.columns else "func_ord").alias("least")
    itself = different.select("g", "digest", least, distance(F.col("packed"), F.col("packed"), compressed_size(F.concat("body", "body"))).alias("ncd"))
    return large(placed).join(large(itself.where(F.col("ncd") < threshold)), ["g", "digest"]).select("func_ord", "least", "ncd")


def near_pairs(pairs: DataFrame, lesser: DataFrame, greater: DataFrame, threshold: float) -> DataFrame:
    """a, b and ncd of the pairs whose distance is below the threshold; a is one of the lesser and b of the greater of packed()."""
    x = lesser.select(F.col("func_ord").alias("a"), F.col("body").alias("x"), F.col("packed").alias("cx"))
    y = greater.select(F.col("func_ord").alias("b"), F.col("body").alias("y"), F.col("packed").alias("cy"))
    both = large(pairs).join(large(x), "a").join(large(y), "b").withColumn("cxy", compressed_size(F.concat("x", "y")))
    return both.select("a", "b", distance(F.col("cx"), F.col("cy"), F.col("cxy")).alias("ncd")).where(F.col("ncd") < threshold)


def in_order(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of narrow columns that tell them apart.

    The rows are range-partitioned and numbered in their partitions; what stands before a partition is
    summed over one row a partition. They are written once, so that both steps see the same partitions.
    """
    placed = rows.select(*columns).orderBy(*columns).withColumn("n", F.monotonically_increasing_id())
    placed = written(placed).withColumn("part", F.shiftright("n", 33))
    starts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("part", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("before"))
    number = F.col("n").bitwiseAND((1 << 33) - 1) + F.col("before")
    return placed.join(F.broadcast(starts), "part").select(*columns, number.alias(name))


def numbered(functions: DataFrame) -> DataFrame:
    """func_ord by path and place, from 0."""
    return large(functions).join(large(in_order(functions, ["path", "func_idx"], "func_ord")), ["path", "func_idx"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of edges(a, b): least labels spread, and jump, until they rest."""
    pairs = edges.select("a", "b").where("a <> b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        around = large(both).join(large(labels), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = large(labels).join(large(around), "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        nearer = written(large(nearer).join(large(jump), "component", "left").select("node", F.least("component", "further").alias("component"), "old"))
        changed = nearer.where("component <> old").limit(1).count()
        labels = nearer.select("node", "component")
        if not changed:
            return labels


def clusters(pairs: DataFrame) -> DataFrame:
    """func_ord and cluster: numbered from 0 by first member."""
    found = components(pairs)
    rank = in_order(found.select("component").distinct(), ["component"], "cluster")
    return large(found).join(large(rank), "component").select(F.col("node").alias("func_ord"), "cluster")


def cluster_table(pairs: DataFrame, clustered: DataFrame, most: int | None = 20) -> DataFrame:
    """Clusters by size, with their least distance and a label; the top of the list is the report."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("size"))
    least = large(pairs).join(large(clustered), F.col("a") == F.col("func_ord")).groupBy("cluster").agg(F.min("ncd").alias("min_ncd"))
    label = F.when(F.col("min_ncd") < 0.10, "nearly identical").when(F.col("min_ncd") < 0.20, "very similar").otherwise("similar")
    found = large(sizes).join(large(least), "cluster").withColumn("label", label)
    return found.orderBy(F.desc("size"), "cluster").limit(most) if most else found


def duplicate_ratio(functions: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row: functions in clusters over all of enough size; 0 if there are none."""
    total = functions.where(F.octet_length("body") >= C.LEAST_BODY).agg(F.count("*").alias("total_funcs"))
    inside = clustered.agg(F.count("*").alias("funcs_in_dup"))
    ratio = F.when(F.col("total_funcs") > 0, F.col("funcs_in_dup") / F.col("total_funcs")).otherwise(0.0)
    return total.crossJoin(F.broadcast(inside)).select("funcs_in_dup", "total_funcs", ratio.alias("ratio"))
