"""Measures of files as one table, from row-local expressions and a few sums by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import text as T
from tessera.operators import lexer


def line_metrics(files: DataFrame, key: str, text: str) -> DataFrame:
    """Lines and bytes of texts without comments, all within the row."""
    all_lines = T.lines(F.col(text))
    found = files.select(
        key,
        F.size(all_lines).cast("long").alias("segments"),
        F.size(F.filter(all_lines, T.is_blank)).cast("long").alias("blank_lines"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.aggregate(F.transform(all_lines, lambda x: F.octet_length(x)), F.lit(0), lambda a, x: F.greatest(a, x)).cast("long").alias("longest_line"),
    )
    return found.withColumn("code_lines", F.col("segments") - F.col("blank_lines"))


def layout(files: DataFrame, key: str, text: str) -> DataFrame:
    """nz_lines, entropy, line_cv and indent_cv of texts."""
    rows = files.select(key, T.line_lengths(F.col(text)).alias("lengths"), T.indents(F.col(text)).alias("indents"))
    return rows.select(
        key,
        F.size("lengths").cast("long").alias("nz_lines"),
        T.entropy(F.col("lengths")).alias("entropy"),
        T.spread(F.col("lengths")).alias("line_cv"),
        F.size("indents").cast("long").alias("indented_lines"),
        F.when(F.size("indents") >= 15, T.spread(F.col("indents"))).alias("indent_cv"),
    )


def naming(files: DataFrame, key: str, code: str) -> DataFrame:
    """Counts of identifiers: total, generic, unique (2048 at most), camel and snake case."""
    rows = files.select(key, T.identifiers(F.col(code)).alias("w"))
    count = lambda f: F.size(F.filter("w", f)).cast("long")
    return rows.select(
        key,
        F.size("w").cast("long").alias("total_identifiers"),
        count(T.is_generic).alias("generic_identifiers"),
        F.least(F.size(F.array_distinct("w")), F.lit(C.UNIQUE_CAP)).cast("long").alias("unique_identifiers"),
        count(T.is_camel).alias("camel"),
        count(T.is_snake).alias("snake"),
    )


def file_metrics(lexed: DataFrame, functions: DataFrame) -> DataFrame:
    """What the score of a file is computed from."""
    c = F.col
    size = F.char_length("raw")  # a character is a byte here
    lengths = F.transform(F.filter(F.split("raw", "\n"), lambda x: x != ""), lambda x: F.char_length(x))
    own = lexed.select(
        "path", "family", "language", size.cast("long").alias("bytes"), (c("packed") / size).alias("compression_ratio"), lengths.alias("lengths"), "kinds", _total_lines().alias("total_lines"),
        _letters("kinds", "bB").alias("blank_lines"), _letters("kinds", "m").alias("comment_lines"), _letters("kinds", "cs").alias("code_lines"),
        "indents", *[x for x in lexer.COUNTS if x != "different_identifiers"], F.least("different_identifiers", F.lit(C.UNIQUE_CAP)).cast("long").alias("unique_identifiers"),
    )
    own = own.select(*[x for x in own.columns if x != "lengths"], T.entropy(c("lengths")).alias("entropy"), T.spread(c("lengths")).alias("line_cv"))
    sizes = functions.groupBy("path").agg(F.min("start_line").alias("body_start"), F.collect_list(c("end_line") - c("start_line") + 1).alias("function_lines"), F.count("*").alias("functions"))
    extra = [
        sizes,
        lexer.narration(lexed).groupBy("path").agg(F.count("*").alias("narration")),
        lexer.overwraps(lexed).groupBy("path").agg(F.count("*").alias("overwraps")),
        name_breaks(lexed, functions).groupBy("path").agg(F.count("*").alias("name_breaks")),
        lexer.defects(lexed).groupBy("path").agg(F.collect_list("line").alias("defects")),
    ]
    found = own
    for table in extra:
        found = found.join(table, "path", "left")

    def defects(q: int) -> Column:
        quarter = lambda line: F.least(F.floor((line - 1) / F.floor(c("total_lines") / 4)), F.lit(3))
        return F.when(c("total_lines") >= 4, F.size(F.filter("defects", lambda line: quarter(line) == q))).cast("long")

    found = found.withColumns(_halves() | {f"defects_{q}": defects(q) for q in range(4)}).drop("kinds", "defects", "body_start")
    return found.fillna(0, [x for x in found.columns if x != "compression_ratio"])


def _total_lines() -> Column:
    """Lines of a file; what follows the last line feed is one if it is not empty."""
    return F.char_length("kinds") - ((F.col("raw") == "") | F.endswith("raw", F.lit("\n"))).cast("int")


def _halves() -> dict[str, Column]:
    """Lines and comments of the halves of what follows the first function's start, from kinds, total_lines and body_start."""
    total, start = F.col("total_lines"), F.coalesce("body_start", F.lit(1))
    body = total - start + 1
    half = (start + F.floor(body / 2)).cast("int")
    inside = lambda x: F.when(body >= 2 * C.GRADIENT_LINES, x).otherwise(0).cast("long")
    return {
        "top_lines": inside(half - start),
        "top_comments": inside(_letters(F.substr("kinds", start, half - start), "m")),
        "bottom_lines": inside(total - half + 1),
        "bottom_comments": inside(_letters(F.substr("kinds", half, total - half + 1), "m")),
    }


def comment_halves(lexed: DataFrame, functions: DataFrame) -> DataFrame:
    """path and the columns of file_metrics() that tell whether comments thin out."""
    start = functions.groupBy("path").agg(F.min("start_line").alias("body_start"))
    halves = _halves()
    return lexed.select("path", "kinds", _total_lines().alias("total_lines")).join(start, "path", "left").withColumns(halves).select("path", *halves)


def _letters(kinds: Column | str, letters: str) -> Column:
    """How many of these letters a string has."""
    return (F.char_length(kinds) - F.char_length(F.translate(kinds, letters, ""))).cast("long")


def name_breaks(lexed: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions with four camel or snake names at least, over a quarter of each."""
    # over a quarter of four names are two at least
    mixed = lexed.where("camel > 1 and snake > 1")
    functions = functions.join(mixed.select("path"), "path", "left_semi")
    own = mixed.select("path", F.posexplode(F.split("code", "\n")).alias("i", "code")).select("path", (F.col("i") + 1).alias("line"), T.identifiers(F.col("code")).alias("w"))
    count = lambda f: F.size(F.filter("w", f)).cast("long")
    own = own.select("path", "line", F.lit(1).alias("order"), F.lit(None).cast("int").alias("func_idx"), count(T.is_camel).alias("camel"), count(T.is_snake).alias("snake")).where("camel + snake > 0")
    # a function opens before its first line and closes after its last: what is counted in between is its own
    zero = F.lit(0).cast("long")
    edge = lambda line, order: functions.select("path", F.col(line).alias("line"), F.lit(order).alias("order"), "func_idx", zero.alias("camel"), zero.alias("snake"))
    w = Window.partitionBy("path").orderBy("line", "order").rowsBetween(Window.unboundedPreceding, 0)
    swept = own.unionByName(edge("start_line", 0)).unionByName(edge("end_line", 2))
    swept = swept.withColumn("camel", F.sum("camel").over(w)).withColumn("snake", F.sum("snake").over(w)).where("func_idx is not null")
    inside = lambda c: (F.max(F.when(F.col("order") == 2, F.col(c))) - F.max(F.when(F.col("order") == 0, F.col(c)))).alias(c)
    found = swept.groupBy("path", "func_idx").agg(inside("camel"), inside("snake"))
    found = found.where("camel + snake >= 4").join(functions.select("path", "func_idx", "language", "name", "start_line"), ["path", "func_idx"])
    share = lambda c: F.floor(100 * F.col(c) / (F.col("camel") + F.col("snake"))).cast("int")
    found = found.select("path", "language", "name", F.col("start_line").alias("line"), share("camel").alias("camel_pct"), share("snake").alias("snake_pct"))
    return found.where("camel_pct > 25 and snake_pct > 25")
