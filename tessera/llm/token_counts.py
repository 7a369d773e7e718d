"""Token counts: a Viterbi search that counts and keeps no path.

An Aho-Corasick automaton over the unigram vocabulary lists all piece matches of a text part by
their last character; for each place the search carries the best score and the number of pieces
that it takes, with the tie rule of the unigram tokenizer (the earlier start wins). Parts that a
task has seen lately are remembered, up to ``remembered`` of them.

Defined results: a null or empty text has no pieces and score 0; repeated rows are counted each; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import identified, table
from tessera.llm.unigram import PARTS, SPACE, Vocabulary, default_path


class Counter(dict):
    """(pieces, score) by part."""

    def __init__(self, vocabulary: Vocabulary, remembered: int):
        super().__init__()
        import ahocorasick

        self.remembered, self.vocabulary = remembered, vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (_, s) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), s))
        self.automaton.make_automaton()

    def __missing__(self, part: str) -> tuple[int, float]:
        found = self.search(part)
        if len(self) >= self.remembered:
            self.clear()
        self[part] = found
        return found

    def search(self, part: str) -> tuple[int, float]:
        unknown, pieces = self.vocabulary.unknown, self.vocabulary.pieces
        best, count = [0.0], [0]
        matches: list[list] = [[] for _ in part]
        for end, match in self.automaton.iter(part):
            matches[end].append(match)
        for end, own in enumerate(matches):
            top, n = None, 0
            for size, s in sorted(own, reverse=True):  # earlier starts first
                candidate = best[end + 1 - size] + s
                if top is None or candidate > top:
                    top, n = candidate, count[end + 1 - size] + 1
            c = part[end]
            if c not in pieces and (top is None or best[end] + unknown > top):
                top, n = best[end] + unknown, count[end] + len(c.encode())
            best.append(top)
            count.append(n)
        return count[-1], best[-1]


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def count_pieces(docs: DataFrame, path: str, remembered: int = 200_000) -> DataFrame:
    """doc_id, n_chars, n_pieces, score of the best segmentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counter(_vocabulary(path), remembered)
        split = re.compile(PARTS).findall
        for batch in batches:
            chars, pieces, scores = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, s = 0, 0.0
                for a, b in map(known.__getitem__, split(SPACE + text.replace(" ", SPACE)) if text else ()):
                    n += a
                    s += b
                chars.append(len(text))
                pieces.append(n)
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(pieces, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_chars", "n_pieces", "score"])

    return identified(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_pieces long, score double")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), default_path())
