"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a sum of weights, one for the quantile bin of each feature of its text.
The probability that a good document beats a bad one is the logistic function of the difference of
their strengths; the weights are learned from pairs (label 1, label 0) by logistic loss on feature
differences. The cut is a quantile of the strengths of the labelled sample: the share of label 0.
Strengths are shifted so that the cut has score 0.3.

Features are counted over whole texts of all documents. Only the weights are learned on a sample:
at most ``sample`` labelled rows, those with the least hash of doc_id, and ``pairs`` pairs of them.

Defined results: a null or empty text has zero features and gets a score as any other; rows with a
null label or doc_id teach nothing; of several labels of a document the largest counts; if a label
is missing from the sample all scores are 0.5; repeated rows are scored each, and equal texts have equal scores; a score of
exactly the cut is predicted 1, and of feature values on a bin's edge the upper bin counts; texts of any length are taken whole, a
slice of a batch at a time; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, chunks, identified, stage, table, text_buffer, window_hash, word_hashes, words


@dataclass(frozen=True)
class Ranking:
    sample: int = 20_000
    pairs: int = 40_000
    bins: int = 16
    steps: int = 300
    penalty: float = 1e-4
    cut: float = 0.3  # score at the quantile
    seed: int = 7


#: Byte classes counted as shares of a text.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b".",
    b",",
    b"!?",
    b"|",
    b"#*$%&",
    b"<>{}[]=+/\\@~^_",
    b"'\"():;-",
)
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _k
_CLASS[128:] = len(CLASSES) + 1
NAMES = [*[f"share_{k}" for k in range(len(CLASSES) + 2)], "log_words", "word_bytes", "long_words", "short_words", "capitals", "distinct", "distinct_root", "new_trigrams", "new_lines", "line_words"]


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row; rows are sorted."""
    if not len(value):
        return np.zeros(n)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(r[fresh], minlength=n).astype(float)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)[:, None]
    row = np.repeat(np.arange(n), np.diff(offsets))
    width = len(CLASSES) + 2
    shares = np.bincount(row * width + _CLASS[raw], minlength=n * width).reshape(n, width) / size
    starts, ends, first = words(raw, offsets)
    count = np.diff(first)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    length = ends - starts
    hashes = word_hashes(raw, starts, ends)
    sums = lambda w: np.bincount(owner, weights=w, minlength=n)
    grams = window_hash(hashes, 3)
    inside = owner[: len(grams)] == owner[2:] if len(grams) else np.zeros(0, bool)
    n_grams = np.bincount(owner[: len(grams)][inside], minlength=n)
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[offsets] = True
    breaks[1:] |= raw == 10
    line_starts = np.flatnonzero(breaks[:-1]) if len(raw) else np.zeros(0, np.int64)
    line_ends = np.append(line_starts[1:], len(raw))
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    line_hash = word_hashes(raw, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
    n_lines = np.bincount(line_owner, minlength=n)
    distinct = _distinct(owner, hashes, n)
    columns = [
        np.log1p(count),
        sums(length) / some,
        sums(length > 20) / some,
        sums(length <= 3) / some,
        sums((raw[starts] >= 65) & (raw[starts] <= 90)) / some,
        distinct / some,
        distinct / np.sqrt(some),
        _distinct(owner[: len(grams)][inside], grams[inside], n) / np.maximum(n_grams, 1),
        _distinct(line_owner, line_hash, n) / np.maximum(n_lines, 1),
        count / np.maximum(n_lines, 1),
    ]
    return np.column_stack([shares, *columns])


def document_features(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, the column named in carry (a string), features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                found = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = pa.array(np.arange(j - i + 1, dtype=np.int32) * found.shape[1])
                kept = [batch.column(k).slice(i, j - i) for k in ((0, 2) if carry else (0,))]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(at, pa.array(found.ravel()))], names=["doc_id", *names, "features"])

    names = [carry] if carry else []
    return identified(docs, "doc_id", "text", *names).mapInArrow(run, "doc_id long, " + "".join(f"{c} string, " for c in names) + "features array<double>")


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # features x (bins - 1)
    weights: np.ndarray  # features x bins
    shift: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in range(x.shape[1]):
            out += self.weights[k][np.searchsorted(self.edges[k], x[:, k], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) + self.shift, -50, 50)))


def fit(x: np.ndarray, label: np.ndarray, p: Ranking) -> Model | None:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    edges = np.quantile(x, np.arange(1, p.bins) / p.bins, axis=0).T
    for part in (good, bad):  # the rarer label has bins of its own range too
        edges = np.sort(np.concatenate([edges, np.quantile(x[part], [0.1, 0.5, 0.9], axis=0).T], axis=1), axis=1)
    k, bins = x.shape[1], edges.shape[1] + 1
    cell = np.stack([np.searchsorted(edges[i], x[:, i], side="right") + i * bins for i in range(k)], axis=1)
    rng = np.random.default_rng(p.seed)
    a, b = cell[rng.choice(good, p.pairs)], cell[rng.choice(bad, p.pairs)]
    w, m, v = np.zeros(k * bins), np.zeros(k * bins), np.zeros(k * bins)
    for step in range(1, p.steps + 1):
        part = rng.integers(0, p.pairs, 4000)
        miss = 1 / (1 + np.exp(w[a[part]].sum(axis=1) - w[b[part]].sum(axis=1)))  # what the logistic loss leaves
        push = np.repeat(miss, k)
        g = p.penalty * w - (np.bincount(a[part].ravel(), push, k * bins) - np.bincount(b[part].ravel(), push, k * bins)) / len(part)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(edges, w.reshape(k, bins), 0.0)
    strength = model.strength(x)
    cut = np.quantile(strength, len(bad) / len(x))
    return Model(edges, model.weights, float(np.log(p.cut / (1 - p.cut)) - cut))


def rank(docs: DataFrame, labels: DataFrame, p: Ranking = Ranking(), folds: int = 5, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted, learned from documents whose crc32 is not divisible by folds; and the column named in carry."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    found, names = stage(document_features(docs, carry)), [carry] if carry else []
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = bounded_sample(found.join(known, "doc_id"), "doc_id", p.sample).select("features", "label").toPandas()
    model = fit(np.stack(sample["features"].to_list()), sample["label"].to_numpy(), p) if len(sample) else None
    cut = p.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            x = batch.column(len(names) + 1).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, len(NAMES)))
            score = model.score(x) if model is not None else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", *names, "score", "predicted"])

    scored = found.mapInArrow(run, "doc_id long, " + "".join(f"{c} string, " for c in names) + "score double, predicted int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", *names)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
