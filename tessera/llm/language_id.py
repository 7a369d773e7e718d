"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point alone. An n-gram is
bound by multiplying its letters' vectors, each permuted by its place, and a text is the bundle
(sum) of its n-grams. A language's prototype is the bundle of its labelled texts; a text gets the
language whose prototype has the largest cosine, the first in alphabetical order on ties. Sums are
whole numbers, so the prototypes do not depend on the order in which tasks end.

Letters are those of Unicode, lower-cased; all else separates words, and a word's edges count as
one more symbol. Defined results: ``und`` with score 0 if a text is null or has no letter, or if no
language could be learned; rows with a null lang or doc_id are not learned from; repeated rows are learned from and
predicted each; a text of any length counts whole, in bounded memory; an empty table gives no rows; columns
other than the named ones are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import chunks, identified, table, text_buffer


@dataclass(frozen=True)
class Profiles:
    n: int = 3
    dimensions: int = 1024
    seed: int = 2024


_letters: dict[tuple, np.ndarray] = {}
_is_letter: list[np.ndarray] = []


def letter_vector(p: Profiles, code: int) -> np.ndarray:
    key = (p.seed, p.dimensions, code)
    if key not in _letters:
        if len(_letters) >= 1 << 15:  # scripts have more letters than a worker should remember
            _letters.clear()
        bits = np.random.default_rng([p.seed, code]).integers(0, 2, p.dimensions, dtype=np.int8)
        _letters[key] = 2 * bits - 1
    return _letters[key]


def _letter_table() -> np.ndarray:
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _is_letter[0]


def bundles(texts: list[str], p: Profiles) -> np.ndarray:
    """The bundle of each text, rows of whole numbers; zero for texts without a letter."""
    own = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    at = np.cumsum([0] + [len(x) + 2 for x in own])
    codes = np.zeros(at[-1], np.uint32)  # a separator on both sides of each text
    for a, x in zip(at.tolist(), own):
        codes[a + 1 : a + 1 + len(x)] = x
    codes[~_letter_table()[codes]] = 0
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[at[:-1]] = True
    row = np.repeat(np.arange(len(own)), np.diff(at))[keep]
    codes = codes[keep]
    out = np.zeros((len(texts), p.dimensions))
    for at in range(0, len(codes) - p.n + 1, _SEGMENT):  # n-grams are summed, so they may be taken a segment at a time
        _add(out, codes[at : at + _SEGMENT + p.n - 1], row[at : at + _SEGMENT + p.n - 1], p)
    return out


#: Symbols, and different n-grams, that are worked on at a time, so that memory does not grow with the length or variety of a text.
_SEGMENT, _GRAMS = 1 << 18, 4096


def _add(out: np.ndarray, codes: np.ndarray, row: np.ndarray, p: Profiles) -> None:
    """Add the n-grams of a segment to the bundles of their rows."""
    symbols, inverse = np.unique(codes, return_inverse=True)
    if len(codes) < p.n or len(symbols) < 2:
        return
    base = len(symbols)
    gram = np.zeros(len(codes) - p.n + 1, np.int64)
    for k in range(p.n):
        gram = gram * base + inverse[k : len(codes) - p.n + 1 + k]
    owner = row[: len(gram)]
    inside = owner == row[p.n - 1 :]
    if not inside.any():
        return
    gram, first = gram[inside], int(owner[0])
    owner = owner[inside] - first
    rows = int(owner[-1]) + 1
    names, which = np.unique(gram, return_inverse=True)
    for lo in range(0, len(names), _GRAMS):
        own = names[lo : lo + _GRAMS]
        here = (which >= lo) & (which < lo + len(own)) if len(names) > _GRAMS else slice(None)
        counts = np.bincount(owner[here] * len(own) + which[here] - lo, minlength=rows * len(own)).reshape(rows, -1)
        letters, place = np.unique(np.stack([own // base**k % base for k in range(p.n)]), return_inverse=True)
        table = np.stack([letter_vector(p, int(symbols[c])) for c in letters])
        place = place.reshape(p.n, -1)
        bound = np.ones((len(own), p.dimensions), np.float32)
        for k in range(p.n):  # the last letter of the n-gram first; its place is its permutation
            bound *= np.roll(table, k, axis=1)[place[k]]
        out[first : first + rows] += counts.astype(np.float32) @ bound


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    offsets, _ = text_buffer(column)
    for i, j in chunks(offsets):
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]


def learn(docs: DataFrame, p: Profiles) -> dict[str, np.ndarray]:
    """Prototype by language, from text and lang of all given rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, texts in _texts(batch.column(0)):
                found = bundles(texts, p)
                own = np.array(langs[i : i + len(texts)], object)
                for lang in set(own.tolist()):
                    sums[lang] = sums.get(lang, 0) + found[own == lang].astype(np.int64).sum(axis=0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.int64()))], names=["lang", "bundle"])

    parts = docs.select("text", "lang").where("lang is not null and text is not null").mapInArrow(run, "lang string, bundle array<long>")
    rows = parts.select("lang", F.posexplode("bundle").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("bundle")).collect()
    found = {r.lang: np.array([x.v for x in r.bundle], np.float64) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], p: Profiles, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in carry, lang_pred, score: the cosine with the nearest prototype, 0 at least."""
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())).T if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in _texts(batch.column(1)):
                found = bundles(texts, p)
                norm = np.linalg.norm(found, axis=1)
                if matrix is None:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cosine = np.round(found @ matrix / np.maximum(norm, 1)[:, None], 9)
                best = cosine.argmax(axis=1)
                langs += [names[b] if n else "und" for b, n in zip(best.tolist(), norm.tolist())]
                scores += np.clip(cosine[np.arange(len(best)), best], 0, 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *own, "lang_pred", "score"])

    own = [f"carry_{i}" for i in range(len(carry))]  # names of any kind may clash
    rows = identified(docs, "doc_id", "text", *carry)
    types = "".join(f"{n} {rows.schema[i + 2].dataType.simpleString()}, " for i, n in enumerate(own))
    found = rows.mapInArrow(run, f"doc_id long, {types}lang_pred string, score double")
    return found.select("doc_id", *[F.col(n).alias(c) for n, c in zip(own, carry)], "lang_pred", "score")


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learned(docs: DataFrame, p: Profiles = Profiles()) -> dict[str, np.ndarray]:
    """Prototypes from the rows that are not held out."""
    rows = identified(docs, "doc_id", "text", "lang")
    return learn(rows.where(~held_out() & F.col("doc_id").isNotNull()), p)


def identify(docs: DataFrame, p: Profiles = Profiles()) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    return predict(docs, learned(docs, p), p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
