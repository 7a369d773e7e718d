"""Measures of one text, all within its row: no shuffle however many texts there are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as C


def bind(value: Column, use) -> Column:
    """Compute value once and hand it to use."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """Lines as a reader of bytes sees them: what follows the last line feed is one more, perhaps empty."""
    return F.split(text, "\n")


def line_lengths(text: Column) -> Column:
    """Lengths in bytes of the lines that are not empty."""
    return F.filter(F.transform(lines(text), lambda x: F.octet_length(x)), lambda n: n > 0)


def is_blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\r\f\x0b")) == ""


def entropy(lengths: Column) -> Column:
    """Entropy of line lengths in buckets, as a share of its maximum; 0 if one bucket is used."""
    buckets = F.sort_array(F.transform(lengths, lambda n: F.least((n / C.BUCKET_WIDTH).cast("int"), F.lit(C.BUCKETS - 1))))

    def measure(b: Column) -> Column:
        total = F.size(b).cast("double")
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0).alias("used"))

        def part(run: Column) -> Column:
            return F.when(run > 0, run * F.log2(F.greatest(run, F.lit(1.0)))).otherwise(0.0)

        def step(s: Column, x: Column) -> Column:
            fresh = F.struct(x.alias("last"), F.lit(1.0).alias("run"), (s["sum"] + part(s["run"])).alias("sum"), (s["used"] + 1).alias("used"))
            same = F.struct(s["last"].alias("last"), (s["run"] + 1.0).alias("run"), s["sum"].alias("sum"), s["used"].alias("used"))
            return F.when(s["last"] == x, same).otherwise(fresh)

        def done(s: Column) -> Column:
            h = F.log2(total) - (s["sum"] + part(s["run"])) / total
            return F.when(s["used"] > 1, h / F.log2(s["used"].cast("double"))).otherwise(0.0)

        return F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.aggregate(b, start, step, done))

    return bind(buckets, measure)


def spread(values: Column, least: int = 2) -> Column:
    """Population deviation over mean; 0 below the least number of values or for a mean of 0."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x.cast("double") * x).alias("q"))

    def measure(v: Column) -> Column:
        n = F.size(v).cast("double")
        done = lambda a: F.when(a["s"] > 0, F.sqrt(F.greatest(a["q"] / n - (a["s"] / n) * (a["s"] / n), F.lit(0.0))) / (a["s"] / n)).otherwise(0.0)
        return F.when(F.size(v) < least, F.lit(0.0)).otherwise(F.aggregate(v, start, step, done))

    return bind(values, measure)


def indents(text: Column) -> Column:
    """Indent of each line with something on it: a blank counts one, a tab four."""
    solid = F.filter(lines(text), lambda x: ~is_blank(x))
    return F.transform(solid, lambda x: bind(F.regexp_extract(x, r"^[ \t]*", 0), lambda i: F.char_length(i) + 3 * (F.char_length(i) - F.char_length(F.replace(i, F.lit("\t"), F.lit(""))))))


def identifiers(code: Column) -> Column:
    """Names in code: two characters at least, with a lower-case letter, no keywords."""
    words = F.regexp_extract_all(code, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & w.rlike("[a-z]") & ~w.isin(*C.KEYWORDS))


def is_generic(word: Column) -> Column:
    return word.isin(*C.GENERIC_NAMES)


def is_camel(word: Column) -> Column:
    return (F.char_length(word) > 2) & word.rlike("^[a-z].*[A-Z]")


def is_snake(word: Column) -> Column:
    return word.rlike("^[a-z0-9_]{3,}$") & word.contains("_")


def is_all_upper(word: Column) -> Column:
    return ~word.rlike("[a-z]")


def conditionals(code: Column) -> Column:
    words = "|".join(C.CONDITIONALS)
    return F.regexp_count(code, F.lit(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"))


def has_word(text: Column, word: str) -> Column:
    return text.rlike(f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def narrates(comment: Column) -> Column:
    """Whether a comment's text starts with a narration marker, in any case."""
    return F.lower(F.ltrim(comment)).rlike(f"^(?:{'|'.join(C.NARRATION_MARKERS)})")


def is_conventional(message: Column) -> Column:
    return message.rlike(rf"^(?:{'|'.join(C.COMMIT_TYPES)})(?:\([^)]*\))?!?:")


def is_parameter_word(word: Column) -> Column:
    return word.isin(*C.PARAMETER_WORDS)


def is_entry_point(name: Column, language: Column) -> Column:
    script = language.isin("ts", "js") & name.isin(*C.LIFECYCLE)
    go = (language == "go") & (name.rlike("^(?:Test|Fuzz)[A-Z]|^Benchmark|^Example") | (name == "TestMain") | name.isin(*C.GO_HOOKS))
    return name.isin(*C.ENTRY_POINTS) | script | go
