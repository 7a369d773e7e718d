"""Quality rules: a short-circuit cascade of DataFrame expressions.

A rule is a condition under which a document is rejected. On a bounded sample each rule's cost (the
measures it needs, timed) and selectivity (the share it rejects) are estimated, and the rules are
ordered by rejections per cost. The verdict is one ``CASE``: a document that a rule rejects is not
tested by the rules after it, and the measures that only those need are not computed for it. The order
changes the time that the verdict takes, never the verdict. In a report the measures that are returned for
every document cost a rule nothing more, so the rules on letters and on distinct words, which look at every
word again, see only what the others leave.

Words are runs of characters other than the ASCII space and 9 to 13. Defined results: a null or
blank text has no words, zero for every measure, and fails; repeated rows are judged each; a text of any length is
judged whole, within its row; rules of equal gain keep the order in which they are given; an
empty table gives no rows; columns other than doc_id and text are ignored. Repeated word windows are
told apart by a 64-bit hash of their three words within one document.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import identified, table

#: ASCII white space between words, one by one.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.char_length(_without(text, BLANKS))


def n_symbols(text: Column) -> Column:
    return F.char_length(text) - F.char_length(_without(text, SYMBOLS))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # the array is bound once, since it is used twice
    return F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0]


def n_repeat_words(w: Column) -> Column:
    """Words in a window of three that occurs at least twice; w must be a plain column."""

    def covered(order: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            before = F.get(order, k - 1)["h"]
            after = F.get(order, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        hits = F.filter(order, again)
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeats = F.transform(F.array(pairs), covered)[0]
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(F.transform(F.array(hashes), counted)[0])


#: Measures by name, as functions of the text and of its words.
MEASURES = {
    "n_words": lambda text, w: F.size(w),
    "word_chars": lambda text, w: word_chars(text),
    "n_symbols": lambda text, w: n_symbols(text),
    "n_dup_lines": lambda text, w: n_dup_lines(text),
    "n_repeat_words": lambda text, w: n_repeat_words(w),
    "n_distinct_words": lambda text, w: F.size(F.array_distinct(w)),
    "n_lettered_words": lambda text, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
}
#: Those that a report gives for every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Mapping[str, Column]], Column]  # over the measures it needs


RULES = (
    Rule("too_short", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("dup_lines", ("n_words", "n_dup_lines"), lambda m: 5 * m["n_dup_lines"] > m["n_words"]),
    Rule("few_letters", ("n_words", "n_lettered_words"), lambda m: 100 * m["n_lettered_words"] < 60 * m["n_words"]),
    Rule("few_distinct", ("n_words", "n_distinct_words"), lambda m: 50 * m["n_distinct_words"] < m["n_words"]),
)
BASE = ("too_short", "repeats")
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE = 1000


def _texts(docs: DataFrame) -> DataFrame:
    rows = identified(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("w", words(F.col("text")))


def _sample(docs: DataFrame, bound: int) -> DataFrame:
    """At most bound rows, taken by a hash wherever they are; words are found for these alone."""
    rows = identified(docs, "doc_id", "text")
    total = rows.count()
    if total > 2 * bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(2 * bound / total * (1 << 40)))
    return _texts(rows.limit(bound))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, given: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejections per cost, largest first; by name on ties. Measures that are given anyway cost nothing."""
    text, w = F.col("text"), F.col("w")
    rows = _sample(docs, sample).select("text", "w", *[c.alias(m) for m, c in measures(text, w, given).items()]).cache()
    try:
        total = rows.count()
        if not total:
            return list(rules)

        def timed(df: DataFrame) -> tuple[float, int]:
            begun = time.perf_counter()
            n = df.first()[0] or 0
            return time.perf_counter() - begun, n

        found = []
        for rule in rules:
            needed = {m: F.col(m) if m in given else c for m, c in measures(text, w, rule.needs).items()}
            cost, rejected = min(timed(rows.agg(F.sum(rule.rejects(needed).cast("int")))) for _ in range(2))
            found.append((-rejected / total / max(cost, 1e-4), rule.name, rule))
        return [r for _, _, r in sorted(found, key=lambda x: x[:2])]
    finally:
        rows.unpersist()


def measures(text: Column, w: Column, names=tuple(MEASURES)) -> dict[str, Column]:
    return {m: MEASURES[m](text, w).cast("long") for m in names}


def verdict(rules: list[Rule], measured: Mapping[str, Column]) -> Column:
    """True if no rule rejects; rules after the first that does are not reached."""
    cases = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        cases = cases.when(rule.rejects(measured), F.lit(False))
    return cases.otherwise(F.lit(True))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, report: bool = False) -> DataFrame:
    """doc_id and kept; with report also the reported measures of every document, which the verdict then reads."""
    rows, text, w = _texts(docs), F.col("text"), F.col("w")
    if not report:
        return rows.select("doc_id", verdict(order_rules(docs, rules, sample), measures(text, w)).alias("kept"))
    order = order_rules(docs, rules, sample, REPORTED)
    rows = rows.select("doc_id", "text", "w", *[c.alias(m) for m, c in measures(text, w, REPORTED).items()])
    columns = {m: F.col(m) if m in REPORTED else c for m, c in measures(text, w).items()}
    base = [r for r in rules if r.name in BASE]
    return rows.select("doc_id", *REPORTED, (~verdict(base, columns)).alias("base_failed"), verdict(order, columns).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(table(spark, sf_dir, "documents"), report=True)


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM again, (VALUES (0), (1), (2)) AS t(k)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (100 * n_symbols > 30 * n_words OR word_chars < 2 * n_words
  OR word_chars > 20 * n_words OR 5 * n_dup_lines > n_words OR 100 * n_lettered < 60 * n_words OR 50 * n_distinct < n_words) AS kept
FROM b
"""
