"""License scans by templates with markup.

A template is the wording of a license notice with two kinds of regions, after the public markup of license lists:

    <<beginOptional>> ... <<endOptional>>            words that may be left out; regions may nest
    <<var;name="holder";words="0-12">>               any words, so many of them
    <<var;name="version";match="2|2 0|3 0">>         one of these wordings

All other words are mandatory. Each template is compiled into an automaton over words: states, steps that take a word, and steps
that take none; counters of a replaceable region are unrolled. A text has the template's label if the automaton accepts a
stretch of its words: mandatory words stand exactly and in order. Words are runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z lower-cased, so punctuation, case and line breaks do not matter.

Short phrases that name a license give base labels, whatever stands around them; templates add labels of their own.

Words are found and compared by hash for a whole batch at once; an automaton starts only where a word and its successor can begin
its template, and reads the words themselves. Each document is worked on alone and nothing is shuffled; memory follows a
batch, which is worked on some hundred kilobytes at a time, or the longest text.

Defined results: a null or empty text has no words, no labels and score 0; several places of a label count as one
label; repeated rows and rows without an id are scanned each; an empty table gives no rows; columns other than doc_id
and text are ignored; texts of any length count whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, chunks, identified, table, text_buffer, word_hashes

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_CC = 'cc <<var;name="rights";match="{}">> <<var;name="version";match="{}">> <<beginOptional>><<var;name="port";match="international|unported">><<endOptional>>'
_LICENSED = '<<var;name="verb";match="licensed|released|distributed|available">> under <<beginOptional>>the<<endOptional>> '
_GPL_VERSION = '<<beginOptional>>or <<beginOptional>>at your option any<<endOptional>> later <<beginOptional>>version<<endOptional>><<endOptional>>'

#: Public wordings, by the label that they give.
TEMPLATES = (
    ("apache-2.0", _LICENSED + 'apache license <<beginOptional>>version<<endOptional>> 2 0'),
    ("apache-2.0", 'you may not use this file except in compliance with the license you may obtain a copy of the license at <<var;name="place";words="1-10">> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind'),
    ("gpl-2.0", _LICENSED + 'gnu general public license version 2 <<beginOptional>>0<<endOptional>> ' + _GPL_VERSION),
    ("gpl-3.0", _LICENSED + 'gnu general public license version 3 <<beginOptional>>0<<endOptional>> ' + _GPL_VERSION),
    ("gpl", 'this <<var;name="work";words="1-4">> is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>><<var;name="kind";match="lesser|affero|library">><<endOptional>> general public license as published by the free software foundation'),
    ("mit", _LICENSED + 'mit license'),
    ("mit", 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software'),
    ("isc", 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies'),
    ("bsd", 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer'),
    ("cc-by", _LICENSED + _CC.format("by", "1 0|2 0|2 5|3 0|4 0")),
    ("cc-by-nc", _LICENSED + _CC.format("by nc", "1 0|2 0|2 5|3 0|4 0")),
    ("cc-by-nd", _LICENSED + _CC.format("by nd", "1 0|2 0|2 5|3 0|4 0")),
    ("cc-by-sa", _LICENSED + _CC.format("by sa", "1 0|2 0|2 5|3 0|4 0")),
    ("cc-by-nc-nd", _LICENSED + _CC.format("by nc nd", "1 0|2 0|2 5|3 0|4 0")),
    ("cc-by-nc-sa", _LICENSED + _CC.format("by nc sa", "1 0|2 0|2 5|3 0|4 0")),
    ("cc0", _LICENSED + 'cc0 <<beginOptional>>1 0<<endOptional>>'),
    ("all-rights-reserved", 'copyright <<beginOptional>>c<<endOptional>> <<var;name="holder";words="1-12">> all rights reserved'),
)

_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_MARK = re.compile(r'<<beginOptional>>|<<endOptional>>|<<var;name="[^"]*";words="(\d+)-(\d+)">>|<<var;name="[^"]*";match="([^"]*)">>')


def words_of(text: str) -> list[str]:
    """Words of a text: A-Z are lower-cased, all other characters stay."""
    return _WORD.findall(text.translate(_FOLD))


_FOLD = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Text:
    """Mandatory words."""

    words: tuple[str, ...]


@dataclass(frozen=True)
class Optional_:
    inner: tuple


@dataclass(frozen=True)
class Any_:
    least: int
    most: int


@dataclass(frozen=True)
class Choice:
    options: tuple[tuple[str, ...], ...]


def parse(template: str) -> tuple:
    """Regions of a template, nested as its markup is."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1].append(Text(tuple(words_of(template[at : m.start()]))))
        at = m.end()
        if m[0] == "<<beginOptional>>":
            stack.append([])
        elif m[0] == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            inner = tuple(stack.pop())
            stack[-1].append(Optional_(inner))
        elif m[3] is not None:
            stack[-1].append(Choice(tuple(tuple(words_of(x)) for x in m[3].split("|"))))
        else:
            if int(m[1]) > int(m[2]):
                raise ValueError("a region's least number of words is above its largest")
            stack[-1].append(Any_(int(m[1]), int(m[2])))
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    if "<<" in _MARK.sub("", template):
        raise ValueError("unknown markup")
    stack[0].append(Text(tuple(words_of(template[at:]))))
    return tuple(x for x in stack[0] if x != Text(()))


@dataclass
class Automaton:
    """Steps by word, steps that take any word, and steps that take none; 0 is the start."""

    words: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    none: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.none.append([])
        return len(self.words) - 1

    def literal(self, at: int, words: tuple[str, ...]) -> int:
        for w in words:
            self.words[at].setdefault(w, []).append(to := self.state())
            at = to
        return at

    def add(self, at: int, regions: tuple) -> int:
        for r in regions:
            if isinstance(r, Text):
                at = self.literal(at, r.words)
                continue
            to = self.state()
            if isinstance(r, Optional_):
                self.none[at].append(to)
                self.none[self.add(at, r.inner)].append(to)
            elif isinstance(r, Choice):
                for option in r.options:
                    self.none[self.literal(at, option)].append(to)
            else:
                for k in range(r.most + 1):
                    if k >= r.least:
                        self.none[at].append(to)
                    if k < r.most:
                        self.free[at].append(further := self.state())
                        at = further
            at = to
        return at

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.none[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        out: set[int] = set()
        for s in states:
            out.update(self.words[s].get(word, ()))
            out.update(self.free[s])
        return self.closure(out) if out else frozenset()

    def accepts(self, words: list[str], start: int) -> int:
        """End of the longest stretch from start that is accepted, or -1."""
        states, end = self.closure({0}), -1
        for i in range(start, len(words) + 1):
            if self.final in states:
                end = i
            if i == len(words) or not (states := self.step(states, words[i])):
                break
        return end


def compiled(template: str) -> Automaton:
    out = Automaton()
    out.final = out.add(0, parse(template))
    start = out.closure({0})
    if out.final in start or any(out.free[s] for s in start):
        raise ValueError("a template begins with a mandatory word")
    return out


@dataclass(frozen=True)
class Scan:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    phrases: tuple[tuple[str, str], ...] = PHRASES


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


class Scanner:
    """Compiled templates, and which words they may begin with."""

    def __init__(self, scan: Scan):
        self.templates = [(label, compiled(t)) for label, t in scan.templates]
        self.phrases = [(tuple(words_of(p)), label) for p, label in scan.phrases]
        first: dict[str, list] = {}
        # a template is tried where its first word and one of the possible second words stand; None: any, or the end
        for k, (_, a) in enumerate(self.templates):
            for s in a.closure({0}):
                for w, to in a.words[s].items():
                    after = a.closure(set(to))
                    open_ = a.final in after or any(a.free[x] for x in after)
                    second = None if open_ else {x for t in after for x in a.words[t]}
                    first.setdefault(w, []).append((k, second))
        for words, _ in self.phrases:
            first.setdefault(words[0], [])
        self.first = first
        names = sorted(first)
        hashes = np.array([_hash(w) for w in names], np.uint64)
        self.hashes = np.sort(hashes)
        pairs = set()
        for w, tries in first.items():
            seconds = [s for _, s in tries] + [{p[1]} if len(p) > 1 else None for p, _ in self.phrases if p[0] == w]
            for s in seconds:
                pairs |= {(w, None)} if s is None else {(w, x) for x in s}
        self.alone = np.sort(np.array([_hash(w) for w, x in pairs if x is None], np.uint64))
        self.pairs = np.sort(np.array([_pair(np.uint64(_hash(w)), np.uint64(_hash(x))) for w, x in pairs if x is not None], np.uint64))

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words where something may begin; a place too many does no harm."""
        hit = np.flatnonzero(_among(hashes, self.hashes))
        following = np.zeros(len(hit), np.uint64)
        inside = hit + 1 < len(hashes)
        following[inside] = hashes[hit[inside] + 1]
        with np.errstate(over="ignore"):
            return hit[_among(hashes[hit], self.alone) | _among(_pair(hashes[hit], following), self.pairs)]

    def at(self, words: list[str], places: list[int]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int]]]:
        """Base places and labels, and accepted stretches (label, start, length)."""
        base, found = [], []
        for i in places:
            for phrase, label in self.phrases:
                if words[i] == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase:
                    base.append((i, label))
            following = words[i + 1] if i + 1 < len(words) else None
            for k, second in self.first.get(words[i], ()):
                if second is None or following in second:
                    label, automaton = self.templates[k]
                    end = automaton.accepts(words, i)
                    if end >= 0:
                        found.append((label, i, end - i))
        return base, found


def _pair(a, b):
    with np.errstate(over="ignore"):
        return a * np.uint64(0x9E3779B97F4A7C15) ^ b


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


@lru_cache(maxsize=4)
def _scanner(scan: Scan) -> Scanner:
    return Scanner(scan)


_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True

_MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
SCHEMA = "doc_id long, n_words long, base array<struct<label: string, start: long, length: long>>, matches array<struct<label: string, start: long, length: long>>"


def _slice(raw: np.ndarray, offsets: np.ndarray, scanner: Scanner) -> Iterator[tuple[int, list, list]]:
    """n_words, base places and accepted stretches of each row."""
    low = LOWER[raw]
    solid = np.zeros(len(low) + 1, bool)
    solid[:-1] = _SOLID[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(low), bool)
    before[1:] = solid[: len(low)][:-1]
    starts = np.flatnonzero(solid[:-1] & (~before | edge[:-1]))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge[1:])) + 1
    row = np.searchsorted(starts, offsets)
    hits = scanner.candidates(word_hashes(low, starts, ends)) if len(starts) else np.zeros(0, np.int64)
    of = np.searchsorted(hits, row)
    text = low.tobytes()
    for r in range(len(offsets) - 1):
        base, found = [], []
        if of[r + 1] > of[r]:
            lo, hi = int(row[r]), int(row[r + 1])
            words = [text[s:e].decode() for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
            base, found = scanner.at(words, (hits[of[r] : of[r + 1]] - lo).tolist())
        yield int(row[r + 1] - row[r]), base, found


def scan_licenses(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """doc_id, n_words, base (places of phrases) and matches (stretches that a template accepts) of each row."""
    sizes = {label: len(words_of(p)) for p, label in scan.phrases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(scan)
        for batch in batches:
            offsets, raw = text_buffer(batch.column(1))
            n_words, base, matches = [], [], []
            for i, j in chunks(offsets):
                own = offsets[i : j + 1]
                for n, places, found in _slice(raw[own[0] : own[-1]], own - own[0], scanner):
                    n_words.append(n)
                    base.append([{"label": b, "start": s, "length": sizes[b]} for s, b in places])
                    matches.append([{"label": b, "start": s, "length": size} for b, s, size in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(base, _MATCH), pa.array(matches, _MATCH)], names=["doc_id", "n_words", "base", "matches"])

    return identified(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def _labels(*columns: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in columns]))), ",")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 1 if a template accepts a stretch, 0.5 if a phrase stands there alone, else 0."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    start = F.transform("base", lambda x: x["start"])
    score = F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), _labels("base").alias("base_labels"), _labels("base", "matches").alias("labels"), score.alias("score"))


def as_regex(template: str) -> str:
    """The template for words that are each followed by one space, as SQL's regular expressions have it."""

    def of(regions: tuple) -> str:
        out = ""
        for r in regions:
            if isinstance(r, Text):
                out += "".join(f"{w} " for w in r.words)
            elif isinstance(r, Optional_):
                out += f"(?:{of(r.inner)})?"
            elif isinstance(r, Choice):
                out += "(?:" + "|".join("".join(f"{w} " for w in o) for o in r.options) + ")"
            else:
                out += rf"(?:[^ ]+ ){{{r.least},{r.most}}}"
        return out

    return of(parse(template))


def oracle(scan: Scan = Scan()) -> str:
    sizes = sorted({len(words_of(p)) for p, _ in scan.phrases})
    grams = ", ".join(" || ' ' || ".join(["x", *[f"lead(x, {j}) OVER o" for j in range(1, k)]]) + f" AS x{k}" for k in sizes)
    gram = "CASE k " + " ".join(f"WHEN {k} THEN x{k}" for k in sizes) + " END"
    phrases = ", ".join(f"('{p}', {len(words_of(p))}, '{label}')" for p, label in scan.phrases)
    templates = ", ".join(f"(' {as_regex(t)}', '{label}')" for label, t in scan.templates)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(p, k, label) AS (VALUES {phrases}), templates(r, label) AS (VALUES {templates}),
grams AS (
  SELECT doc_id, i, {grams} FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), base AS (
  SELECT doc_id, label, i FROM grams JOIN phrases ON p = {gram}
), places AS (
  SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id
), own AS (
  SELECT doc_id, label FROM d JOIN templates ON regexp_matches(' ' || array_to_string(w, ' ') || ' ', r)
), all_labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM own) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(places.labels, '') AS base_labels, coalesce(all_labels.labels, '') AS labels,
  CASE WHEN d.doc_id IN (SELECT doc_id FROM own) THEN 1.0 WHEN n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN all_labels USING (doc_id)
"""


OP12_SQL = oracle()
