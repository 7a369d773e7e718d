"""Findings: one DataFrame for each detector, put together in a fixed order.

Each has path, line, kind, severity and message. Severities are ``strong tell``, ``score-related`` and
``general``; the last only on request.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import lexer
from tessera.operators.duplicates import compressed_size, distance
from tessera.operators.features import comment_halves, name_breaks

STRONG, RELATED, GENERAL = "strong tell", "score-related", "general"
WORD = "A-Za-z0-9_"


def _finding(rows: DataFrame, kind: str, severity: str, message: Column, line: Column | str = "line", seq: Column | str | None = None) -> DataFrame:
    place = F.lit(0) if seq is None else seq
    return rows.select("path", (F.col(line) if isinstance(line, str) else line).cast("int").alias("line"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message"), (F.col(place) if isinstance(place, str) else place).cast("long").alias("place"))


def narration(lexed: DataFrame) -> DataFrame:
    hits = lexer.narration(lexed)
    return _finding(hits, "narration", STRONG, F.concat(F.lit('"'), F.rtrim("text"), F.lit('"')))


def comment_gradient(metrics: DataFrame) -> DataFrame:
    c = F.col
    rows = metrics.where(S.gradient(c("top_lines"), c("top_comments"), c("bottom_lines"), c("bottom_comments")))
    top, bottom = c("top_comments") / c("top_lines"), c("bottom_comments") / c("bottom_lines")
    percent = lambda x: F.floor(x * 100 + 0.5).cast("int")
    message = F.format_string("top half %d%% comments, bottom half %d%% (gradient %.1fx)", percent(top), percent(bottom), F.bround(top / F.greatest(bottom, F.lit(0.001)), 1))
    return _finding(rows, "comment-decay", STRONG, message, F.lit(0))


def redundant_copies(functions: DataFrame) -> DataFrame:
    """Near-duplicate functions of one file."""
    own = functions.withColumn("bytes", F.encode("body", "ISO-8859-1")).where(F.octet_length("bytes") >= C.LEAST_BODY)
    own = own.select("path", "func_idx", "name", "start_line", "bytes", F.octet_length("bytes").alias("size"), compressed_size(F.col("bytes")).alias("packed"))
    pairs = own.alias("x").join(own.alias("y"), F.expr(f"x.path = y.path and x.func_idx < y.func_idx and greatest(x.size, y.size) <= {C.SIZE_RATIO} * least(x.size, y.size)"))
    pairs = pairs.withColumn("both", compressed_size(F.concat("x.bytes", "y.bytes"))).withColumn("ncd", distance(F.col("x.packed"), F.col("y.packed"), F.col("both")))
    rows = pairs.where(F.col("ncd") < C.DUPLICATE_DISTANCE)
    message = F.format_string("%s() and %s() are near-duplicates (NCD %.2f)", _shown("x.name"), _shown("y.name"), "ncd")
    return _finding(rows.select("x.path", F.col("x.start_line").alias("line"), message.alias("m"), (F.col("x.func_idx") * 100000 + F.col("y.func_idx")).alias("seq")), "redup", RELATED, F.col("m"), seq="seq")


def _shown(name: str) -> Column:
    return F.when(F.col(name) == "", "?").otherwise(F.col(name))


def overwraps(lexed: DataFrame, functions: DataFrame) -> DataFrame:
    hits = lexer.overwraps(lexed).select("path", "pos", F.struct("line", "depth").alias("hit"), F.lit(None).cast("struct<name: string, until: bigint>").alias("inside"))
    # the last body that began before; bodies do not overlap
    body = F.struct("name", (F.col("body_offset") + F.col("body_len")).cast("long").alias("until"))
    begun = functions.join(hits.select("path").distinct(), "path", "left_semi").select("path", F.col("body_offset").alias("pos"), F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), body.alias("inside"))
    w = Window.partitionBy("path").orderBy("pos", F.col("hit").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.unionByName(begun).withColumn("inside", F.last("inside", ignorenulls=True).over(w)).where("hit is not null and pos < inside.until")
    return _finding(rows, "over-wrap", RELATED, F.format_string("try/catch nested %d deep in %s()", "hit.depth", _shown("inside.name")), "hit.line")


def null_checks(lexed: DataFrame, within: int = 10, remembered: int = 32) -> DataFrame:
    """A variable tested for null again within ten lines; a repeated test does not count as a first one."""
    tested = F.regexp_extract("code", rf"^[ \t]*(?:\}} *else +)?if[ (].*?([A-Za-z_$][{WORD}$.]*)[ \t]*(?:[!=]=+|is(?: not)?)[ \t]*(?:null|undefined|nil|None)(?![{WORD}])", 1)
    rows = lexer.lines_with(lexed, "if").select("path", "line", tested.alias("name")).where("name <> ''")

    tests = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "name"))).alias("tests"))
    start = F.expr("named_struct('seen', cast(array() as array<struct<line: int, name: string>>), 'found', cast(array() as array<struct<line: int, name: string, first: int>>))")

    def step(state: Column, test: Column) -> Column:
        near = F.filter(state["seen"], lambda x: (x["name"] == test["name"]) & (test["line"] - x["line"]).between(1, within))
        first = F.get(near, 0)["line"]
        seen = F.concat(state["seen"], F.array(test))
        latest = F.slice(seen, F.greatest(F.size(seen) - remembered + 1, F.lit(1)), F.lit(remembered))
        again = F.struct(test["line"].alias("line"), test["name"].alias("name"), first.alias("first"))
        fresh = F.struct(latest.alias("seen"), state["found"].alias("found"))
        return F.when(first.isNull(), fresh).otherwise(F.struct(state["seen"].alias("seen"), F.concat(state["found"], F.array(again)).alias("found")))

    found = tests.select("path", F.explode(F.aggregate("tests", start, step)["found"]).alias("x")).select("path", "x.*")
    return _finding(found, "over-wrap", RELATED, F.format_string("redundant null check on '%s' (already checked at line %d)", "name", "first"))


def mixed_names(lexed: DataFrame, functions: DataFrame) -> DataFrame:
    rows = name_breaks(lexed, functions).where("language <> 'go'")
    return _finding(rows, "naming-break", RELATED, F.format_string("mixed naming in %s(): %d%% camelCase, %d%% snake_case", _shown("name"), "camel_pct", "snake_pct"))


def first_then_total(hits: DataFrame, key: str, order: str, most: int = 3) -> DataFrame:
    """The first hits of each key with n, their place, and total; a further row with n null where there are more."""
    w = Window.partitionBy(key)
    rows = hits.withColumn("n", F.row_number().over(w.orderBy(order))).withColumn("total", F.count("*").over(w)).where(F.col("n") <= most)
    more = rows.where(f"n = 1 and total > {most}").withColumn("n", F.lit(None).cast("int"))
    return rows.unionByName(more)


def _capped(hits: DataFrame, kind: str, message: str, total: str) -> DataFrame:
    rows = first_then_total(hits.withColumn("order", F.struct("line", "spot")), "path", "order")
    return _finding(rows, kind, RELATED, F.when(F.col("n").isNotNull(), F.lit(message)).otherwise(F.format_string(total, "total")), seq=F.coalesce("n", F.lit(9)))


def _occurrences(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    return rows.select("path", "line", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("spot", "hit"))


def any_casts(lexed: DataFrame) -> DataFrame:
    hits = _occurrences(lexer.lines_with(lexed.where("language = 'ts'"), " as any"), "code", r" as any(?![A-Za-z0-9])")
    return _capped(hits, "as-any", '"as any" cast hides the type', '%d total "as any" casts in file')


def ts_directives(lexed: DataFrame) -> DataFrame:
    rows = lexer.comments(lexed.where("language in ('ts', 'js')"))
    hits = rows.select("path", "line", F.posexplode(F.regexp_extract_all("comment", F.lit("@ts-(?:ignore|nocheck|expect-error)"), F.lit(0))).alias("spot", "hit"))
    message = F.when(F.col("hit") == "@ts-ignore", "@ts-ignore hides a type error").when(F.col("hit") == "@ts-nocheck", "@ts-nocheck turns type checks off for the file").otherwise("@ts-expect-error hides a type error")
    return _finding(hits, "ts-directive", RELATED, message, seq="spot")


def python_directives(lexed: DataFrame) -> DataFrame:
    rows = lexer.comments(lexed.where("language = 'python'"))
    out = None
    for pattern, name in (("type: ignore", "type: ignore"), ("noqa", "noqa")):
        hits = _occurrences(rows, "comment", rf"{pattern}(?![A-Za-z0-9])")
        found = _capped(hits, "ts-directive", f'"{name}" hides a check', f'%d total "{name}" in file')
        out = found if out is None else out.unionByName(found)
    return out


def dropped_errors(lexed: DataFrame) -> DataFrame:
    """Go: an error assigned to the blank name."""
    code = F.concat(F.lit("\t"), F.col("code"))
    blank = code.rlike(r"[ \t,]_ :?=(?!=)") & ~code.rlike(r"_ :?=.{0,80}(?<![A-Za-z0-9_])range(?![A-Za-z0-9_])")
    many, error = code.rlike(r",[ \t]*_ :?="), F.lower(F.regexp_extract(code, r"_ :?=(.*)$", 1)).contains("err")
    hits = lexer.lines_with(lexed.where("language = 'go'"), "_").where(blank & (many | error)).select("path", "line", F.lit(0).alias("spot"))
    return _capped(hits, "err-suppress", "error is dropped", "%d total dropped errors in file")


#: What stands between parentheses, three levels deep.
_BALANCED = r"[^()]*(?:\([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*\)[^()]*)*"


def unused_parameters(functions: DataFrame) -> DataFrame:
    """Parameters whose name is no word of the body, comments and strings included."""
    python = F.col("language") == "python"
    inside = F.when(python, F.regexp_extract("head", rf"^\s*(?:async +)?def +\w+\s*\(({_BALANCED})\)", 1)).otherwise(F.regexp_extract("head", rf"\(({_BALANCED})\)[^()]*$", 1))
    # a comma within brackets parts no parameters, but one in a pattern of a script's parameter does
    flat = F.regexp_replace(F.replace(inside, F.lit("=>"), F.lit("")), r":\s*\{[^{}]*\}", "")
    flat = F.when(F.col("language").isin("ts", "js"), F.regexp_replace(flat, "[{}]", " ")).otherwise(flat)
    for _ in range(3):
        flat = F.regexp_replace(flat, r"[(<\[{][^()<>\[\]{}]*[)>\]}]", "")
    part = F.explode(F.slice(F.split(flat, ","), 1, 16))
    # a def that goes on over more lines: its body begins after them
    lines_of_def = F.size(F.split(F.regexp_extract("head", rf"^\s*(?:async +)?def +\w+\s*\({_BALANCED}\)", 0), "\n")) - 1
    body = F.when(python & (lines_of_def > 0), F.array_join(F.slice(F.split("body", "\n"), lines_of_def + 1, F.lit(1 << 30)), "\n")).otherwise(F.col("body"))
    rows = functions.where(F.col("body_len") >= 10).select("path", "language", "name", "start_line", "func_idx", body.alias("body"), part.alias("part"))
    typed = F.regexp_extract(F.regexp_replace("part", "=.*$", ""), r"([A-Za-z_$][A-Za-z0-9_$]*)[^A-Za-z0-9_$]*$", 1)
    named = F.regexp_extract("part", r"^\s*[ \t.*&{\[]*([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    rows = rows.withColumn("parameter", F.when(F.col("language").isin("c", "cpp", "java", "rust", "swift", "other"), typed).otherwise(named))
    rows = rows.where((F.char_length("parameter") >= 2) & ~T.is_parameter_word(F.col("parameter")))
    used = F.array_contains(F.regexp_extract_all("body", F.lit("[A-Za-z0-9_$]+"), F.lit(0)), F.col("parameter"))
    return _finding(rows.where(~used), "zombie-param", GENERAL, F.format_string("parameter '%s' in %s() is never used", "parameter", _shown("name")), "start_line")


def _clauses(text: Column, pattern: str, group: int) -> Column:
    """What the pattern finds, each with its place (from 1) in the text; the same clause may stand twice."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<clause:string,pos:int>>").alias("out"))

    def step(acc: Column, clause: Column) -> Column:
        pos = F.call_function("locate", clause, text, acc["at"])
        return F.struct((pos + F.char_length(clause)).alias("at"), F.concat(acc["out"], F.array(F.struct(clause.alias("clause"), pos.alias("pos")))).alias("out"))

    return F.aggregate(found, start, step)["out"]


def imports(lexed: DataFrame, lines: DataFrame) -> DataFrame:
    """path, line and name of what a file imports; a group in braces has the line where it starts."""
    return lexer.shown(_imports(lexed, lines))


def _imports(lexed: DataFrame, lines: DataFrame) -> DataFrame:
    at_line = F.size(F.split(F.expr("substring(raw, 1, found.pos)"), "\n"))
    raw_code, clause = F.col("code"), F.col("found.clause")
    # scripts: the clause between import and from
    script = lexed.where("language in ('ts', 'js')").select("path", "raw", F.explode(_clauses(raw_code, r"(?<![A-Za-z0-9_.])import\s+(?:type\s+)?([^;'\"()]*?)\sfrom", 1)).alias("found"))
    names = F.explode(F.split(F.regexp_replace(clause, "[{}]", ","), ","))
    script = script.select("path", at_line.alias("line"), names.alias("item"))
    script = script.select("path", "line", F.regexp_extract("item", r"([A-Za-z_$][A-Za-z0-9_$]*)\s*$", 1).alias("name")).where("name <> ''")
    # Python, line by line; a group in parentheses goes on
    python = lexed.where("language = 'python'").withColumn("joined", F.regexp_replace(raw_code, r"\\\n", "  "))
    python = python.select("path", "raw", F.explode(_clauses(F.col("joined"), r"(?m)^[ \t]*(?:from[ \t]+[A-Za-z0-9_.]+[ \t]+import[ \t]*(?:\([^)]*\)|[^\n(]*)|import[ \t]+[^\n,]*)", 0)).alias("found"))
    items = F.regexp_replace(F.regexp_replace(clause, r"^\s*(?:from\s+[A-Za-z0-9_.]+\s+)?import", ""), "[()\n]", " ")
    python = python.select("path", at_line.alias("line"), F.explode(F.split(items, ",")).alias("item"))
    python = python.select("path", "line", F.coalesce(F.nullif(F.regexp_extract("item", r"\sas\s+([A-Za-z_]\w*)", 1), F.lit("")), F.regexp_extract("item", r"^\s*([A-Za-z_]\w*)", 1)).alias("name")).where("name <> ''")
    # Go: an alias, or the last part of the path
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("code").rlike(r"^\s*import\s*\("), "open").when(F.col("code").rlike(r"^\s*\)|^\s*(?:func|type|var|const)\b"), "shut")
    go = lines.where("language = 'go'").withColumn("group", F.last(mark, ignorenulls=True).over(w))
    go = go.where((F.col("group") == "open") & F.col("has_string") | F.col("code").rlike(r"^\s*import\s+[A-Za-z_.]*\s*$"))
    alias = F.regexp_extract(F.regexp_replace("code", r"^\s*import\s*", ""), r"^\s*([A-Za-z_.][A-Za-z0-9_]*)", 1)
    go = go.select("path", "line", alias.alias("alias"), F.regexp_extract("raw", r'"(?:[^"]*/)?([^"/]+)"', 1).alias("last"))
    go = go.where("alias not in ('_', '.')").select("path", "line", F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("last")).alias("name"))
    return script.unionByName(python).unionByName(go.where("name <> ''"))


def unused_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """Names that are no word of their file outside the lines from..to of the name."""
    # a word stands outside these lines exactly when its first or its last line does
    extents = words.groupBy(F.col("path").alias("p"), F.col("word").alias("w")).agg(F.min("line").alias("first_use"), F.max("line").alias("last_use"))
    found = names.join(extents, (F.col("path") == F.col("p")) & (F.col("name") == F.col("w")), "left")
    inside = (F.col("first_use") >= F.col("from")) & (F.col("last_use") <= F.col("to"))
    return found.where(F.coalesce(inside, F.lit(True))).drop("p", "w", "first_use", "last_use")


def _words_near(names: DataFrame, lexed: DataFrame, few: int = 64) -> DataFrame:
    """The words of files that have a name to look for. Only these names are words of interest; they are looked for in the row where they are few."""
    sought = names.groupBy("path").agg(F.collect_set("name").alias("names"))
    rows = lexed.select("path", "code").join(sought, "path").select("path", "names", F.posexplode(F.split("code", "\n")).alias("i", "code"))
    rows = rows.select("path", "names", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("code", F.lit(f"[{WORD}]+"), F.lit(0))).alias("word"))
    return rows.where((F.size("names") > few) | F.array_contains("names", F.col("word"))).select("path", "line", "word")


def unused_imports(lexed: DataFrame, lines: DataFrame) -> DataFrame:
    found = _imports(lexed, lines).withColumn("from", F.col("line"))
    found = found.join(lexed.select("path", "language"), "path")
    found = found.withColumn("to", F.col("line"))
    # names with other characters are looked up by their first word
    found = found.withColumn("shown", F.col("name")).withColumn("name", F.regexp_extract("name", r"([A-Za-z0-9_]+)$", 1))
    return _finding(unused_names(found, _words_near(found, lexed)), "unused-import", GENERAL, F.format_string("imported name '%s' not used in file", "shown"))


def magic_strings(lexed: DataFrame) -> DataFrame:
    """Strings of 8 to 127 bytes that stand three times or more in a file."""
    rows = lexer.strings(lexed.where("has_string")).where(F.char_length("text").between(8, 127))
    found = rows.groupBy("path", "text").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n >= 3")
    cut = F.concat(F.substring("text", 1, 48), F.when(F.char_length("text") > 48, "...").otherwise(""))
    return _finding(found, "magic-string", GENERAL, F.format_string('string "%s" repeated %d times', cut, "n"))


def is_exported(rows: DataFrame) -> Column:
    c = F.col
    above = F.regexp_extract("above", r"[^\n]*$", 0)
    script = c("language").isin("ts", "js") & (c("signature").rlike(r"^\s*export(?![A-Za-z0-9_])") | above.rlike(r"^\s*(?:export(?![A-Za-z0-9_])|@)"))
    near = F.concat_ws("\n", "above", "signature")
    static = near.rlike(r"(?<![A-Za-z0-9_])static(?![A-Za-z0-9_])")
    other = (c("family") == C.C_LIKE) & ~c("language").isin("ts", "js", "go") & (~static | near.contains("__attribute__"))
    return script | (c("language") == "go") & c("name").rlike("^[A-Z]") | (c("language") == "python") & ~c("name").startswith("_") | other


def dead_functions(functions: DataFrame, lexed: DataFrame) -> DataFrame:
    """Functions of more than one line that nothing outside them names, exports or calls by rule."""
    rows = functions.where((F.col("name") != "") & (F.col("end_line") > F.col("start_line")))
    rows = rows.where(~is_exported(rows) & ~T.is_entry_point(F.col("name"), F.col("language")))
    rows = rows.withColumn("from", F.least("start_line", "name_line")).withColumn("to", F.col("end_line"))
    return unused_names(rows, _words_near(rows, lexed)).withColumn("lines", F.col("end_line") - F.col("start_line") + 1)


def dead_code(functions: DataFrame, lexed: DataFrame) -> DataFrame:
    dead = dead_functions(functions, lexed)
    each = _finding(dead, "dead-code", GENERAL, F.format_string("%s() defined but never referenced (%d lines)", "name", "lines"), "start_line")
    total = dead.groupBy("path").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).where("n > 1")
    return each.unionByName(_finding(total, "dead-code", GENERAL, F.format_string("%d unused functions, %d dead lines total", "n", "lines"), F.lit(0), F.lit(1 << 40)))


def check(files: DataFrame, include_general: bool = False, tables: lexer.Tables | None = None) -> DataFrame:
    """path, seq, kind, severity, line and message of the findings in all files that are not skipped."""
    return lexer.shown(check_tables(tables or lexer.tables(files), include_general))


def check_tables(tables: lexer.Tables, include_general: bool = False) -> DataFrame:
    """The same, with the tables' own keys of files."""
    lexed, lines, functions = tables.lexed, tables.lines, tables.functions
    metrics = comment_halves(lexed, functions)
    found = [
        narration(lexed), comment_gradient(metrics), redundant_copies(functions), overwraps(lexed, functions), null_checks(lexed),
        mixed_names(lexed, functions), any_casts(lexed), ts_directives(lexed), python_directives(lexed), dropped_errors(lexed),
    ]
    if include_general:
        found += [unused_parameters(functions), unused_imports(lexed, lines), magic_strings(lexed), dead_code(functions, lexed)]
    out = None
    for i, table in enumerate(found):
        table = table.withColumn("detector", F.lit(i))
        out = table if out is None else out.unionByName(table)
    w = Window.partitionBy("path").orderBy("detector", F.when(F.col("line") == 0, F.col("place")).otherwise(0), "line", "place", "message")
    rows = out.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= C.FINDINGS_CAP)
    return rows.select("path", "seq", "kind", "severity", "line", "message")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: findings by severity and the exit code of a check."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, 1)), F.lit(0)).cast("long")
    rows = findings.agg(count(STRONG).alias("strong"), count(RELATED).alias("related"), count(GENERAL).alias("general"))
    return rows.withColumn("exit_code", F.when(F.col("strong") > 0, 2).when(F.col("related") > 0, 1).otherwise(0))
