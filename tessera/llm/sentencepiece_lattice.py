"""SentencePiece encoding and decoding by a lattice over distinct text parts.

Documents are dealt into blocks by doc_id, text and where they are read. Spark explodes their texts into parts and
groups them, so a block has each different part once, and cogroups a block's parts with its documents: the task
joins the parts' substrings with the pieces, keeps the best last edge of every place and walks back, many parts at a time
(``piece_lattice``), and each document looks up its parts' ids. All of this stays in the block's partition.

The same in SQL functions alone is ``encode(in_sql=True)``: parts are exploded into all
substrings up to the longest piece, and an equi-join with the piece table keeps the edges of the
lattice (the table has a fixed size, that of the vocabulary, and is broadcast). Edges are grouped by
part and folded by Spark's ``aggregate``: edges come in order of their end and start, the fold carries
the best node of every place, and a second fold walks back and gives the piece ids. Tests hold one form against the other.

Decoding is the reverse: pieces by id, bytes put together, U+2581 to a space, the first one dropped.

In SQL a long part goes by a digest, and is cut into windows that overlap by the longest piece before its
substrings are exploded, so no row carries it along.

Defined results: a null or empty text has no pieces and decodes to the empty text; repeated rows are
encoded each, and rows without an id as well; texts and parts of any length are taken whole, in time that grows with their length; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import identified, stage, table
from tessera.llm.piece_lattice import Trie, best_paths
from tessera.llm.unigram import PARTS, SPACE, Vocabulary, default_path, parts

#: Bytes of text in a block, about.
BLOCK_BYTES = 16 << 20


#: An edge is one long, so that a word's edges are few bytes and sort by end, then start: end, start, id + 1.
_END, _START, _ID = 1 << 40, 1 << 17, (1 << 17) - 1


#: Parts of more characters go by a digest, and are exploded window by window.
_WINDOW = 256


def _key(part: Column) -> Column:
    """A line feed before a digest, since no part but the line feed itself has one."""
    return F.when(F.char_length(part) > _WINDOW, F.concat(F.lit("\n"), F.sha2(part, 256))).otherwise(part)


def _windows(part: Column, longest: int) -> Column:
    """Windows of a part, each with the first characters of the next one; all but the last have _WINDOW places of their own."""
    cut = F.regexp_extract_all(part, F.lit(f"(?s).{{1,{_WINDOW}}}"), F.lit(0))
    return F.transform(cut, lambda x, i: F.struct((i * _WINDOW).alias("base"), F.char_length(x).alias("own"), F.concat(x, F.substring(F.coalesce(F.get(cut, i + 1), F.lit("")), 1, longest - 1)).alias("text")))


def _edges(words: DataFrame, vocabulary: Vocabulary, spark: SparkSession) -> DataFrame:
    """block, key of a part and its edges, sorted; an id of -1 is a character that is no piece."""
    rows = [(piece, i) for piece, (i, _) in vocabulary.pieces.items()]
    table = F.broadcast(spark.createDataFrame(rows, "piece string, id int"))
    length, longest = F.char_length("part"), vocabulary.longest
    whole = F.array(F.struct(F.lit(0).alias("base"), length.alias("own"), F.col("part").alias("text")))
    windows = words.select("block", _key(F.col("part")).alias("key"), F.explode(F.when(length > _WINDOW, _windows(F.col("part"), longest)).otherwise(whole)).alias("w"))
    windows = windows.select("block", "key", "w.*")
    starts = windows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("text") - F.col("at"))))
    substrings = starts.withColumn("size", size).withColumn("piece", F.substring("text", F.col("at") + 1, F.col("size")))
    found = substrings.join(table, "piece", "left").where("id is not null or size = 1")
    start = (F.col("base") + F.col("at")).cast("long")
    edge = (start + F.col("size")) * F.lit(_END) + start * F.lit(_START) + F.coalesce("id", F.lit(-1)) + 1
    return found.groupBy("block", "key").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def piece_score(number: Column, unknown: float) -> Column:
    """Score by id + 1, as unigram.score gives it."""
    return F.when(number == 0, F.lit(unknown)).otherwise(-F.rint(16 * F.log((number + 1).cast("double"))) / 16)


#: Edges that one inner fold takes. Arrays are copied when they grow, so a long part is folded in chunks.
_CHUNK = 512


def best_path(edges: Column, unknown: float, longest: int) -> Column:
    """Ids of the best path, first to last.

    An edge starts at most ``longest`` places before its end, so the fold keeps that many nodes near and puts the
    others away chunk by chunk: the work grows with the length of a part.
    """
    node = lambda start, score, i: F.array(F.struct(start.cast("int").alias("start"), score.alias("score"), i.cast("int").alias("id")))
    kind = "array<struct<start:int,score:double,id:int>>"

    def step(state: Column, e: Column) -> Column:
        nodes, base = state["near"], state["base"]
        end, start, number = F.shiftright(e, 40).cast("int"), F.shiftright(e, 17).bitwiseAND((1 << 23) - 1).cast("int"), e.bitwiseAND(_ID)
        total = F.get(nodes, start - base)["score"] + piece_score(number, unknown)
        fresh = F.size(nodes) == end - base
        better = total > F.get(nodes, end - base)["score"]
        grown = F.when(fresh, F.concat(nodes, node(start, total, number - 1))).when(better, F.concat(F.slice(nodes, F.lit(1), end - base), node(start, total, number - 1))).otherwise(nodes)
        return F.struct(base.alias("base"), grown.alias("near"))

    def chunk(state: Column, i: Column) -> Column:
        begin = F.struct(state["base"].alias("base"), state["near"].alias("near"))
        return F.transform(F.array(F.aggregate(F.slice(edges, i * _CHUNK + 1, F.lit(_CHUNK)), begin, step)), lambda s: settled(state["done"], s))[0]

    def settled(done: Column, s: Column) -> Column:
        away = F.greatest(F.size(s["near"]) - (longest + 1), F.lit(0))
        return F.struct((s["base"] + away).alias("base"), F.slice(s["near"], away + 1, F.lit(longest + 2)).alias("near"), F.concat(done, F.array(F.slice(s["near"], F.lit(1), away))).alias("done"))

    start = F.struct(F.lit(0).alias("base"), node(F.lit(0), F.lit(0.0), F.lit(-2)).cast(kind).alias("near"), F.array().cast(f"array<{kind}>").alias("done"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / _CHUNK).cast("int"))
    nodes = F.aggregate(chunks, start, chunk, lambda s: F.concat(F.flatten(s["done"]), s["near"]))

    def walk(all_nodes: Column) -> Column:
        """Back from the last place, again in chunks, since each step copies the path that it has."""
        ints = F.array().cast("array<int>")
        last = F.size(all_nodes) - 1
        begin = F.struct(last.alias("at"), F.array().cast("array<array<int>>").alias("done"))

        def back(s: Column, place: Column) -> Column:
            n = F.get(all_nodes, place)
            return F.when(place == s["at"], F.struct(n["start"].alias("at"), F.concat(s["path"], F.array(n["id"])).alias("path"))).otherwise(s)

        def chunk_back(s: Column, i: Column) -> Column:
            high = last - i * _CHUNK
            places = F.sequence(high, F.greatest(high - _CHUNK + 1, F.lit(1)), F.lit(-1))
            part = F.aggregate(places, F.struct(s["at"].alias("at"), ints.alias("path")), back)
            return F.transform(F.array(part), lambda x: F.struct(x["at"].alias("at"), F.concat(s["done"], F.array(x["path"])).alias("done")))[0]

        rounds = F.sequence(F.lit(0), F.floor((last - 1) / _CHUNK).cast("int"))
        return F.when(last < 1, ints).otherwise(F.reverse(F.flatten(F.aggregate(rounds, begin, chunk_back)["done"])))

    return F.transform(F.array(nodes), walk)[0]


@contextmanager
def wide_aggregates(spark: SparkSession):
    """For encode in SQL. Lists of edges stay in memory: a block has a bounded number of parts, and sorting them would spill."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@lru_cache(maxsize=1)
def _trie(path: str) -> Trie:
    return Trie(Vocabulary.load(path))


#: Parts of texts that are looked up at a time.
_LOOKED_UP = 1 << 18


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, in_sql: bool = False) -> DataFrame:
    """doc_id, text and ids (array of int); in_sql is best run within wide_aggregates."""
    texts = identified(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # the partition is the block, so what follows needs no other shuffle
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")).repartition(int(blocks), "block")
    # doc_id is counted, which is always true, so that both uses of the texts have the same columns and share one shuffle
    words = dealt.select("doc_id", "block", F.explode(parts(F.col("text"))).alias("part")).groupBy("block", "part").agg(F.count("doc_id").alias("n")).where("n >= 0")
    if in_sql:
        vocabulary = Vocabulary.load(path)
        found = _edges(words.select("block", "part"), vocabulary, docs.sparkSession).select(F.col("block").alias("own_block"), "key", best_path(F.col("edges"), vocabulary.unknown, vocabulary.longest).alias("ids"))
    else:
        found = words.select(F.col("block").alias("own_block"), "part")

    def paths_in_sql(right: pa.Table, split: list[list[str]]) -> tuple[dict[str, int], list[np.ndarray], list[np.ndarray]]:
        vocabulary = Vocabulary.load(path)
        names, ids = _names(vocabulary), dict(zip(right["key"].to_pylist(), right["ids"].to_pylist()))
        place = {x: i for i, x in enumerate(dict.fromkeys(x for own in split for x in own))}
        paths = [ids[x if len(x) <= _WINDOW else "\n" + hashlib.sha256(x.encode()).hexdigest()] for x in place]
        paths = [_with_bytes(x, own, vocabulary, names) if -1 in own else own for x, own in zip(place, paths)]
        return place, [np.array([len(x) for x in paths], np.int64)], [np.array(x, np.int32) for x in paths]

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        find = re.compile(PARTS).findall
        texts = left["text"].to_pylist()
        if in_sql:
            place, counts, flat = paths_in_sql(right, [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts])
        else:
            own = right["part"].to_pylist()
            place = dict(zip(own, range(len(own))))
            counts, flat = zip(*best_paths(own, _trie(path))) if own else ((), ())
        none = np.zeros(0, np.int32)
        counts, flat = np.concatenate([none, *counts]).astype(np.int64), np.concatenate([none, *flat])
        first, out, sizes, looked, ends = np.cumsum(counts) - counts, [none], [none], [], [0]

        def put() -> None:
            at = np.array(looked, np.int64)
            n = counts[at]
            upto = np.concatenate([[0], np.cumsum(n)])
            out.append(flat[np.repeat(first[at] - upto[:-1], n) + np.arange(upto[-1])])
            sizes.append(np.diff(upto[ends]))
            looked.clear()
            ends[1:] = []

        for t in texts:
            if t:
                looked.extend(map(place.__getitem__, find(SPACE + t.replace(" ", SPACE))))
            ends.append(len(looked))
            if len(looked) > _LOOKED_UP:
                put()
        put()
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.table([left["doc_id"], left["text"], pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out)))], names=["doc_id", "text", "ids"])

    return dealt.groupBy("block").cogroup(found.groupBy("own_block")).applyInArrow(gather, "doc_id long, text string, ids array<int>")


def _with_bytes(part: str, path: list[int], vocabulary: Vocabulary, names: dict[int, str]) -> list[int]:
    """Put the byte pieces of unknown characters in their places."""
    out, at = [], 0
    for i in path:
        if i == -1:
            out += [vocabulary.byte_ids[b] for b in part[at].encode()]
            at += 1
        else:
            out.append(i)
            at += len(names[i])
    return out


def _names(vocabulary: Vocabulary) -> dict[int, str]:
    return {i: piece for piece, (i, _) in vocabulary.pieces.items()}


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded to rows with ids."""
    vocabulary = Vocabulary.load(path)
    names = {i: piece.encode() for piece, (i, _) in vocabulary.pieces.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
    table = [names.get(i, b"") for i in range(max(names) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(batch.schema.get_field_index("ids")):
                text = b"".join([table[i] for i in own.values.to_numpy().tolist()]).decode(errors="replace").replace(SPACE, " ")
                out.append(text[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    ids_hash = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256)
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), ids_hash.alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
    return stage(found)
