"""Thirteen signals, their sum and the project score, as column expressions over file metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.sources.settings import Calibration

#: What a signal looks at, in words of our own.
EXPLANATIONS = {
    "insufficient code": "There is no code; the score is the prior.",
    "composite": "How even line lengths and compressibility are.",
    "composite*": "How even line lengths are; the text is too short for its compressibility to tell.",
    "comment-to-code": "Comment lines for each line of code.",
    "narration": "Comments that tell what the next lines do.",
    "conditional dens.": "Conditional keywords for each line of code.",
    "quality decay": "Comments that thin out or defects that gather towards the end.",
    "over-wrapping": "Error handling nested in error handling.",
    "naming breaks": "Two naming styles in one function.",
    "ident. specificity": "Share of names that say nothing.",
    "func length CV": "How much functions differ in length.",
    "token diversity": "Share of names that are new.",
    "indent regularity": "How much indents differ.",
    "duplicate ratio": "Share of functions that have near copies.",
    "commit style": "How messages of the file's history are written.",
}


def _signal(group: str, name: Column | str, measured: Column, llr: Column, when: Column | None = None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    row = F.struct(F.lit(group).alias("grp"), name.alias("signal"), measured.alias("measured"), llr.alias("llr"))
    return row if when is None else F.when(when, row)


def _number(x: Column) -> Column:
    return F.format_string("%.2f", x)


def _counted(column: str, word: str) -> Column:
    n = F.col(column)
    return F.when(n == 1, f"1 {word}").when(n > 1, F.format_string(f"%d {word}s", n)).otherwise("none")


def score_files(metrics: DataFrame, calibration: Calibration = Calibration(), prior: float = 0.5) -> DataFrame:
    """path, raw_score, probability, label, code_lines, dead_lines and signals (array, in order).

    metrics may have compression_ratio, dup_ratio, composite (of the history) and dead_lines; where they are
    missing or null their signals are left out.
    """
    for name in ("compression_ratio", "dup_ratio", "composite"):
        if name not in metrics.columns:
            metrics = metrics.withColumn(name, F.lit(None).cast("double"))
    if "dead_lines" not in metrics.columns:
        metrics = metrics.withColumn("dead_lines", F.lit(0).cast("long"))
    # spreads are columns, since a signal names them several times
    sizes = F.coalesce("function_lines", F.array().cast("array<int>"))
    indents = F.coalesce("indents", F.array().cast("array<int>"))
    metrics = metrics.withColumns({"function_spread": T.spread(F.filter(sizes, lambda n: n >= 1)), "indent_spread": T.spread(indents)})
    g, b, limit = calibration.gaussian, calibration.binary, calibration.limit
    c = F.col
    code = F.greatest(c("code_lines"), F.lit(1))
    has_ratio = F.coalesce((c("compression_ratio") > 0) & (c("compression_ratio") < 1), F.lit(False))
    even = S.regularity(c("entropy"), c("line_cv"), F.coalesce("compression_ratio", F.lit(-1.0)))
    even_llr = S.gaussian_llr(even, g["regularity"], limit)
    even_llr = F.when(has_ratio, even_llr).otherwise(S.clamp(even_llr, -C.CLAMP_NO_RATIO, C.CLAMP_NO_RATIO))
    small = c("total_lines") < C.LEAST_LINES
    even_llr = F.when(small, S.clamp(even_llr, -C.CLAMP_SMALL, C.CLAMP_SMALL)).otherwise(even_llr)
    narration = F.when(c("narration") >= 8, F.lit(limit)).otherwise(S.binary_llr(c("narration") >= 3, b["narration"], limit))
    density, enough = c("conditionals") / code, c("conditionals") >= 3
    quarters = [c(f"defects_{q}").cast("double") for q in range(4)]
    decay = ~small & (sum(quarters[1:], quarters[0]) >= C.LEAST_DEFECTS) & (S.spearman(quarters) > C.TREND)
    decay = decay | S.gradient(c("top_lines"), c("top_comments"), c("bottom_lines"), c("bottom_comments"))
    generic, named = c("generic_identifiers") / F.greatest(c("total_identifiers"), F.lit(1)), c("total_identifiers") >= 20
    lengths, five = c("function_spread"), F.size(F.filter(sizes, lambda n: n >= 1)) >= 5
    ttr, fifty = c("unique_identifiers") / F.greatest(c("total_identifiers"), F.lit(1)), c("total_identifiers") >= 50
    indent, fifteen = c("indent_spread"), F.size(indents) >= 15
    zero = F.lit(0.0)

    def measured(ok: Column, x: Column, parameters, none: Column, shown: Column | None = None) -> tuple[Column, Column]:
        return F.when(ok, _number(x) if shown is None else F.concat(_number(x), shown)).otherwise(none), F.when(ok, S.gaussian_llr(x, parameters, limit)).otherwise(zero)

    signals = [
        _signal("regularity", F.when(has_ratio, "composite").otherwise("composite*"), _number(even), even_llr),
        _signal("comments", "comment-to-code", _number(c("comment_lines") / code), S.gaussian_llr(c("comment_lines") / code, g["ccr"], limit)),
        _signal("comments", "narration", F.format_string("%s (%d hits)", F.when(c("narration") >= 3, "yes").otherwise("no"), "narration"), narration),
        _signal("structure", "conditional dens.", *measured(enough, density, g["cond"], F.format_string("n/a (%d kw)", "conditionals"))),
        _signal("position", "quality decay", F.when(small, f"n/a (<{C.LEAST_LINES} lines)").when(decay, "detected").otherwise("none"), F.when(small, zero).otherwise(S.binary_llr(decay, b["decay"], limit))),
        _signal("patterns", "over-wrapping", _counted("overwraps", "hit"), S.binary_llr(c("overwraps") > 0, b["overwrap"], limit)),
        _signal("patterns", "naming breaks", _counted("name_breaks", "func"), S.binary_llr(c("name_breaks") > 0, b["namebreak"], limit)),
        _signal("naming", "ident. specificity", *measured(named, generic, g["ident"], F.format_string("n/a (%d idents)", "total_identifiers"), F.format_string(" (%d/%d)", "generic_identifiers", "total_identifiers"))),
        _signal("structure", "func length CV", *measured(five, lengths, g["func_cv"], F.format_string("n/a (%d funcs)", F.size(sizes)), F.format_string(" (%d funcs)", F.size(sizes)))),
        _signal("naming", "token diversity", *measured(fifty, ttr, g["ttr"], F.format_string("n/a (%d tokens)", "total_identifiers"), F.format_string(" (%d/%d)", "unique_identifiers", "total_identifiers"))),
        _signal("whitespace", "indent regularity", *measured(fifteen, indent, g["indent"], F.format_string("n/a (%d lines)", F.size(indents)), F.format_string(" (%d lines)", F.size(indents)))),
        _signal("dupes", "duplicate ratio", _number(c("dup_ratio")), S.gaussian_llr(c("dup_ratio"), g["dup"], limit), c("dup_ratio") >= 0),
        _signal("git", "commit style", _number(c("composite")), S.gaussian_llr(c("composite"), g["git"], limit), c("composite").isNotNull()),
    ]
    none = _signal("score", "insufficient code", F.lit("0 code lines"), zero)
    rows = metrics.withColumn("signals", F.when(c("code_lines") <= 0, F.array(none)).otherwise(F.filter(F.array(*signals), lambda s: s.isNotNull())))
    raw = F.aggregate("signals", zero, lambda a, s: a + s["llr"]) + S.prior_llr(prior)
    rows = rows.withColumn("raw_score", raw).withColumn("probability", S.sigmoid(c("raw_score") / calibration.temperature))
    return rows.select("path", "raw_score", "probability", S.label(c("probability")).alias("label"), c("code_lines").cast("long").alias("code_lines"), "dead_lines", "signals")


def signals(scores: DataFrame) -> DataFrame:
    """A row for each signal of each file, with its explanation."""
    # an inner explode would bring a filter on the array, whose whole expression is then computed twice
    rows = scores.select("path", F.posexplode_outer("signals").alias("ord", "s")).where("ord is not null").select("path", "ord", "s.*")
    table = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])
    return rows.withColumn("why", F.try_element_at(table, F.col("signal")))


def project(scores: DataFrame, probability: str = "probability", code_lines: str = "code_lines") -> DataFrame:
    """One row: the score weighted by code lines and the numbers of files by label."""
    w = F.when(F.col(code_lines) > 0, F.col(code_lines)).otherwise(1)
    p = F.col(probability)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return scores.agg(
        F.coalesce(F.sum(p * w) / F.sum(w), F.lit(0.0)).alias("project_score"),
        F.coalesce(count(p >= C.FLAGGED), F.lit(0)).alias("sloppy"),
        F.coalesce(count((p >= C.MODERATE) & (p < C.FLAGGED)), F.lit(0)).alias("moderate"),
        F.coalesce(count(p < C.MODERATE), F.lit(0)).alias("clean"),
        F.coalesce(F.max(S.exit_code(p)), F.lit(0)).alias("exit_code"),
    )


def as_json(scores: DataFrame) -> DataFrame:
    """path and json, one object a file."""
    items = F.transform("signals", lambda s: F.struct(s["grp"].alias("group"), s["signal"].alias("signal"), s["measured"].alias("measured"), F.round(s["llr"], 4).alias("llr")))
    row = F.struct(F.col("path").alias("file"), F.round("raw_score", 4).alias("raw_score"), F.round(F.col("probability") * 10, 1).alias("score"), "dead_lines", "label", items.alias("signals"))
    return scores.select("path", F.to_json(row).alias("json"))
