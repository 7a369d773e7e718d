"""Files to lines, words and functions.

One small kernel tells code, line comments, strings and block comments apart, byte by byte, and says what kind each line is and
how often kinds of words stand in a file; all tables are then made by DataFrame operations. Texts are kept as ISO-8859-1 strings, so that a position
in a string is a position in the file's bytes.

Differences from a lexer with two separate passes: one pass serves metrics and findings alike, strings
end with their line unless they are in backticks, and a line inside a longer string is code.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import text as T
from tessera.sources.staging import written

# each pattern begins with a set of bytes, so that the search runs fast over what is code
_QUOTED = rb'(?<=")(?:[^"\\\n]|\\[\s\S])*+(?:"|(?=\n)|\Z)|' + rb"(?<=')(?:[^'\\\n]|\\[\s\S])*+(?:'|(?=\n)|\Z)"
_TOKENS = {
    C.C_LIKE: re.compile(rb"""[/"'`](?:(?<=/)(?P<line>/[^\n]*)|(?<=/)(?P<block>\*[\s\S]*?(?:\*/|\Z))|(?P<string>""" + _QUOTED + rb"|(?<=`)(?:[^`\\]|\\[\s\S])*+(?:`|\Z)))"),
    C.PYTHON: re.compile(rb"""[#"'](?:(?<=#)(?P<line>[^\n]*)|(?P<block>""" + rb'(?<=")""[\s\S]*?(?:"""|\Z)|' + rb"(?<=')''[\s\S]*?(?:'''|\Z))|(?P<string>" + _QUOTED + rb"))"),
    C.SHELL: re.compile(rb"""[#"'](?:(?<![^\s;(]#)(?<=#)(?P<line>[^\n]*)|(?P<block>(?!))|(?P<string>""" + _QUOTED + rb"))"),
}
_KIND = {"line": b"1", "string": b"2", "block": b"3"}
_BLANK = bytes(10 if i == 10 else 32 for i in range(256))
_CLASS = {k: bytes(10 if i == 10 else k[0] for i in range(256)) for k in (b"0", *_KIND.values())}


def runs(content: bytes, family: str) -> list[tuple[int, int, str]]:
    """Start, end and kind (line, string, block) of all that is not code."""
    return [(*m.span(), m.lastgroup) for m in _TOKENS[family].finditer(content)]


def blanked(content: bytes, found: list[tuple[int, int, str]]) -> bytes:
    """Code with all else blanked; lines stay."""
    parts, at = [], 0
    for start, end, _ in found:
        parts += [content[at:start], content[start:end].translate(_BLANK)]
        at = end
    return b"".join([*parts, content[at:]])


def classify(content: bytes, family: str) -> tuple[bytes, bytes]:
    """Code with all else blanked, and the class of each byte (0 code, 1 line comment, 2 string, 3 block comment)."""
    found, kinds, at = runs(content, family), [], 0
    for start, end, kind in found:
        kinds += [content[at:start].translate(_CLASS[b"0"]), content[start:end].translate(_CLASS[_KIND[kind]])]
        at = end
    return blanked(content, found), b"".join([*kinds, content[at:].translate(_CLASS[b"0"])])


def line_starts(content: bytes) -> np.ndarray:
    """First byte of each line."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(content, np.uint8) == 10) + 1])


def line_marks(starts: np.ndarray, size: int, found: list[tuple[int, int, str]]) -> list[dict | None] | None:
    """For each line whether a string stands in it, and place (from 1) and length of its line comment; None for plain code."""
    if not found:
        return None
    marks: list[dict | None] = [None] * len(starts)
    first = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    last = np.searchsorted(starts, [max(r[0], r[1] - 1) for r in found], side="right") - 1
    for (start, end, kind), a, b in zip(found, first.tolist(), last.tolist()):
        if kind == "block":
            continue
        for i in range(a, b + 1):
            stop = int(starts[i + 1]) - 1 if i + 1 < len(starts) else size
            begin, until = max(start, int(starts[i])), min(end, stop)
            if until <= begin:
                continue  # an empty line of a longer string
            mark = marks[i] = marks[i] or {"string": False, "at": None, "size": None}
            if kind == "string":
                mark["string"] = True
            else:
                mark |= {"at": begin - int(starts[i]) + 1, "size": until - begin}
    return marks


_SPACE = b" \t\r\f\x0b"
_QUOTING = {"c": "s", "m": "s", "b": "B"}


def line_kinds(content: bytes, code: bytes, found: list[tuple[int, int, str]]) -> tuple[list[int], str, list[int], list[int], list[int]]:
    """The first byte of each line, a letter for each (c code, s code with a string, m comment, b blank, B blank within a string), the indents of
    code lines, and the lines (from 1) that have a line comment with its places (from 1)."""
    raw = content.split(b"\n")
    kinds = ["c" if own.strip(_SPACE) else "m" if whole.strip(_SPACE) else "b" for own, whole in zip(code.split(b"\n"), raw)]
    starts, commented, places = [0, *accumulate(len(x) + 1 for x in raw[:-1])], [], []
    for start, end, kind in found:
        i = bisect_right(starts, start) - 1
        if kind == "line":
            commented.append(i + 1)
            places.append(start - starts[i] + 1)
        elif kind == "string":
            while i < len(raw) and starts[i] < end:
                if raw[i]:  # not an empty line of a longer string
                    kinds[i] = _QUOTING.get(kinds[i], kinds[i])
                i += 1
    indents = []
    for line, kind in zip(raw, kinds):
        if kind in "cs":
            lead = len(line) - len(line.lstrip(b" \t"))
            indents.append(lead + 3 * line.count(b"\t", 0, lead) if lead else 0)
    return starts, "".join(kinds), indents, commented, places


_WORDS = bytes(i if chr(i).isascii() and (chr(i).isalnum() or i == 95) else 32 for i in range(256))


class _Naming(dict):
    """What a word is, as bits: 1 a conditional; 2 a name, 4 a generic one, 8 in camel and 16 in snake case, 32 after digits. So many words are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        text, name = word.decode(), word.lstrip(b"0123456789").decode()
        bits = int(text in C.CONDITIONALS)
        if len(name) > 1 and re.search("[a-z]", name) and name not in C.KEYWORDS:
            camel = len(name) > 2 and re.match("[a-z].*[A-Z]", name)
            snake = "_" in name and re.fullmatch("[a-z0-9_]{3,}", name)
            bits |= 2 | 4 * (name in C.GENERIC_NAMES) | 8 * bool(camel) | 16 * bool(snake) | 32 * (name != text)
        self[word] = bits
        return bits


_NAMING = _Naming()


def word_counts(code: bytes) -> tuple[int, int, int, int, int, int]:
    """Conditionals, names, generic and different names, names in camel and in snake case."""
    words = code.translate(_WORDS).split()
    counts = Counter(map(_NAMING.__getitem__, words)).items()
    different = {w.lstrip(b"0123456789") if _NAMING[w] & 32 else w for w in set(words) if _NAMING[w] & 2}
    total = lambda bit: sum(n for bits, n in counts if bits & bit)
    return total(1), total(2), total(4), len(different), total(8), total(16)


#: What word_counts() gives.
COUNTS = ("conditionals", "total_identifiers", "generic_identifiers", "different_identifiers", "camel", "snake")
_LEXED = pa.schema(
    [(c, pa.string()) for c in ("path", "family", "language", "raw", "code")]
    + [(c, pa.bool_()) for c in ("has_string", "braces", "nested")]
    + [("packed", pa.int32()), ("starts", pa.list_(pa.int32())), ("kinds", pa.string()), ("indents", pa.list_(pa.int32())), ("commented", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))]
    + [(c, pa.int64()) for c in COUNTS]
)
_SCHEMA = (
    "path string, family string, language string, raw string, code string, has_string boolean, braces boolean, nested boolean, packed int, starts array<int>, kinds string, indents array<int>, commented array<int>, places array<int>, "
    + ", ".join(f"{c} bigint" for c in COUNTS)
)


def lex(files: DataFrame) -> DataFrame:
    """A row for each file: raw and code (of one length), has_string, braces (some are there), nested (code has ``try`` three times), packed (compressed
    size), the first byte of each line, what line_kinds() says of lines, and counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, content, family, language = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for p, c, f, lang in zip(path, content, family, language):
                found = runs(c, f)
                packed = len(zlib.compress(c, 6)) if len(c) >= C.LEAST_COMPRESSED else None
                code = blanked(c, found) if found else c
                text = code.decode("latin-1") if found else None
                rows.append((p, f, lang, c.decode("latin-1"), text, any(k == "string" for *_, k in found), b"{" in c, code.count(b"try") > 2, packed, *line_kinds(c, code, found), *word_counts(code)))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), _LEXED.types)] if rows else [pa.array([], t) for t in _LEXED.types]
            yield pa.RecordBatch.from_arrays(columns, schema=_LEXED)

    key = F.concat("path", F.lit(_CUT), F.conv(F.monotonically_increasing_id().cast("string"), 10, 36))
    columns = files.select(key.alias("path"), F.coalesce("content", F.lit(b"")).alias("content"), "family", "language")
    return _whole(columns.mapInArrow(run, _SCHEMA))


_CUT = "\x00"


def shown(table: DataFrame) -> DataFrame:
    """Names of files in place of the keys that tell them apart."""
    return table.withColumn("path", F.substring_index("path", _CUT, 1))


def _whole(table: DataFrame) -> DataFrame:
    """Code that equals the text is kept as null."""
    return table.withColumn("code", F.coalesce("code", "raw"))


def _slim(table: DataFrame) -> DataFrame:
    return table.withColumn("code", F.nullif("code", "raw"))


def strings(lexed: DataFrame) -> DataFrame:
    """Every string of the code: path, the line where it starts, spot (its first byte) and text without quotes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, family, raw in zip(b["path"], b["family"], b["raw"]):
                content, line, at = raw.encode("latin-1"), 1, 0
                for m in _TOKENS[family].finditer(content):
                    if m.lastgroup == "string":
                        line, at = line + content.count(b"\n", at, m.start()), m.start()
                        out.append((path, line, at, m.group()[1:-1].decode("latin-1")))
            yield pd.DataFrame(out, columns=["path", "line", "spot", "text"])

    return lexed.select("path", "family", "raw").mapInPandas(run, "path string, line int, spot int, text string")


def lines(lexed: DataFrame) -> DataFrame:
    """A row for each line: line (from 1), raw, code, at (its first byte), kind, indent and has_string."""
    both = F.arrays_zip(F.split("raw", "\n").alias("raw"), F.split("code", "\n").alias("code"), F.split("kinds", "").alias("kind"), F.col("starts").alias("at"))
    rows = lexed.select("path", "family", "language", F.posexplode(both).alias("i", "x"))
    letter = F.col("x.kind")
    kind = F.when(letter.isin("c", "s"), "code").when(letter == "m", "comment").otherwise("blank")
    rows = rows.select("path", "family", "language", (F.col("i") + 1).alias("line"), "x.raw", "x.code", "x.at", letter.isin("s", "B").alias("has_string"), kind.alias("kind"))
    lead = F.char_length("raw") - F.char_length(F.ltrim("raw", F.lit(" \t")))
    indent = lead + 3 * (lead - F.char_length(F.replace(F.substr("raw", F.lit(1), lead), F.lit("\t"), F.lit(""))))
    return rows.withColumn("indent", F.when(F.col("kind") == "code", indent))


def lines_with(lexed: DataFrame, text: str) -> DataFrame:
    """Lines whose code has a text; files without it are not taken apart."""
    return lines(lexed.where(F.col("code").contains(text))).where(F.col("code").contains(text))


def words(lines_: DataFrame) -> DataFrame:
    """Every word of the code, keywords and numbers included."""
    found = F.explode(F.regexp_extract_all("code", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    return lines_.select("path", "line", found.alias("word"))


def identifiers(lines_: DataFrame) -> DataFrame:
    rows = lines_.select("path", "line", F.explode(T.identifiers(F.col("code"))).alias("word"))
    w = F.col("word")
    return rows.select("path", "line", "word", T.is_generic(w).alias("is_generic"), T.is_camel(w).alias("is_camel"), T.is_snake(w).alias("is_snake"))


def comments(lexed: DataFrame) -> DataFrame:
    """Line comments: the text after the comment sign, and the whole line."""
    rows = lexed.where(F.size("commented") > 0).select("path", "language", F.split("raw", "\n").alias("lines"), F.arrays_zip("commented", "places").alias("x"))
    rows = rows.select("path", "language", "lines", F.explode("x").alias("x"))
    rows = rows.select("path", "language", F.col("x.commented").alias("line"), F.get("lines", F.col("x.commented") - 1).alias("raw"), F.col("x.places").alias("place"))
    body = F.regexp_replace(F.expr("substring(raw, place)"), r"^(?://+|#+)", "")  # a line comment ends with its line
    return rows.select("path", "language", "line", body.alias("comment"), F.regexp_replace("raw", r"[ \t\r\f\x0B]+$", "").alias("raw"))


def narration(lexed: DataFrame) -> DataFrame:
    hits = comments(lexed).where(T.narrates(F.col("comment")))
    w = Window.partitionBy("path").orderBy("line")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= C.NARRATION_CAP).select("path", "line", F.substring("raw", 1, 255).alias("text"))


def defects(lexed: DataFrame) -> DataFrame:
    """TODO and FIXME in line comments, a catch closed on its line, a bare except."""
    marked = comments(lexed).where(F.col("comment").rlike("TODO|FIXME")).select("path", "line")
    caught = lines_with(lexed.where(F.col("family") == C.C_LIKE), "catch").where(F.col("code").rlike(r"(?<![A-Za-z0-9_])catch(?![A-Za-z0-9_])[^{}]*\{[^{}]*\}")).select("path", "line")
    bare = lines_with(lexed.where(F.col("family") == C.PYTHON), "except").where(F.col("code").rlike(r"(?<![A-Za-z0-9_])except[ \t]*:")).select("path", "line")
    return marked.unionByName(caught).unionByName(bare)


_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"


def _braces(lexed: DataFrame) -> DataFrame:
    """Opening and closing braces in code, with the depth around them, the line so far, and the code lines before.

    What stands before a line is read in the row of its file, so that only lines with braces are sorted. ``previous`` (the last line with code) is
    given where the brace is the first of its line.
    """
    rows = lexed.where((F.col("family") == C.C_LIKE) & F.col("braces")).select("path", "family", "language", "starts", "kinds", F.split("code", "\n").alias("codes"))
    rows = rows.select("*", F.posexplode("codes").alias("i", "code")).where(F.col("code").contains("{") | F.col("code").contains("}"))
    above = F.concat_ws("\n", *[F.coalesce(F.get("codes", F.col("i") - k), F.lit("")) for k in (4, 3, 2, 1)])
    char = F.when(F.col("code").contains("{"), "{").otherwise("}")
    only = F.array(F.struct(char.alias("c"), (F.position(char, F.col("code")) - 1).alias("i")))
    spots = F.filter(F.transform(F.split("code", ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].isin("{", "}"))
    spots = F.when(F.char_length(F.translate("code", "{}", "")) == F.char_length("code") - 1, only).otherwise(spots)
    rows = rows.select("path", "family", "language", "codes", "kinds", "i", "code", (F.col("i") + 1).alias("line"), F.get("starts", F.col("i")).alias("at"), above.alias("above"), F.explode(spots).alias("spot"))
    rows = rows.withColumn("open", F.col("spot.c") == "{").withColumn("here", F.expr("substring(code, 1, spot.i)"))
    # the letters of lines without code are cut off the end
    last = F.char_length(F.rtrim(F.substr("kinds", F.lit(1), F.col("i")), F.lit("bBm")))
    previous = F.when(F.col("open") & T.is_blank(F.col("here")), F.coalesce(F.get("codes", last - 1), F.lit(""))).otherwise("")
    when_open = lambda c: F.when(F.col("open"), F.col(c)).alias(c)
    rows = rows.select("path", "family", "language", "line", (F.col("at") + F.col("spot.i")).alias("pos"), "open", when_open("here"), when_open("above"), previous.alias("previous"))
    w = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("after", F.sum(F.when(F.col("open"), 1).otherwise(-1)).over(w))
    rows = rows.withColumn("depth", F.when(F.col("open"), F.col("after") - 1).otherwise(F.col("after")))
    # after an opening brace the next one of its depth closes it
    return rows.withColumn("close", F.lead(F.struct("pos", "line")).over(Window.partitionBy("path", "depth").orderBy("pos")))


def c_functions(lexed: DataFrame) -> DataFrame:
    rows = _braces(lexed).where("open")
    here, previous = F.col("here"), F.col("previous")
    signature = F.when(T.is_blank(here), previous).otherwise(here)
    # what follows the last ; or }
    recent = F.substring_index(F.translate(F.concat_ws("\n", "above", "here"), "}", ";"), ";", -1)
    called = here.contains("(") | previous.contains("(") & T.is_blank(here) | recent.contains("(")
    trimmed = F.ltrim(signature, F.lit(" \t"))
    control = trimmed.rlike(rf"^(?:\}}|(?:{'|'.join(C.CONTROL_WORDS)})(?![A-Za-z0-9_]))")
    kind = signature.rlike(rf"(?<![A-Za-z0-9_])(?:{'|'.join(C.TYPE_WORDS)})(?![A-Za-z0-9_])")
    rows = rows.withColumn("candidate", called & ~control & ~kind)
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("depth") == 0, F.col("candidate")), ignorenulls=True).over(w)
    rows = rows.withColumn("parent", F.coalesce(parent, F.lit(False)))
    rows = rows.where(F.col("candidate") & ((F.col("depth") == 0) | (F.col("depth") == 1) & ~F.col("parent")) & F.col("close").isNotNull())
    called_names = F.filter(F.regexp_extract_all(recent, F.lit(_NAME + r"[ \t]*(?:<[^<>()]*>)?\("), F.lit(1)), lambda n: ~n.isin("func", "if", "for", "while", "switch", "function"))
    arrow = F.regexp_extract(signature, r"(?:const|let|var)[ \t]+" + _NAME, 1)
    field = F.when((F.col("depth") == 1) & signature.rlike(r"=[^=]") & signature.rlike(r"\(|=>|function"), F.regexp_extract(signature, _NAME + r"[ \t]*=[^=]", 1)).otherwise("")
    last = F.coalesce(F.get(called_names, F.size(called_names) - 1), F.lit(""))
    name = F.coalesce(F.nullif(F.when(arrow != "", arrow).otherwise(last), F.lit("")), F.nullif(field, F.lit("")), F.lit(""))
    back = F.split("above", "\n")  # the four lines before
    place = F.when(here.contains(F.col("name")), F.col("line"))
    for k in (1, 2, 3, 4):
        place = place.when(F.get(back, 4 - k).contains(F.col("name")), F.col("line") - k)
    rows = rows.withColumn("name", name).withColumn("name_line", place.otherwise(F.col("line")))
    return rows.select("path", "family", "language", "name", "name_line", F.col("line").alias("start_line"), F.col("close.line").alias("end_line"), (F.col("pos") + 1).alias("body_offset"), (F.col("close.pos") - F.col("pos") - 1).alias("body_len"), signature.alias("signature"), "above", "depth")


def python_functions(lines_: DataFrame) -> DataFrame:
    """From a def line to the next def, or to the first code line that is indented no deeper."""
    rows = lines_.where((F.col("family") == C.PYTHON) & (F.col("kind") == "code"))
    spaces = F.char_length(F.regexp_extract("code", "^ *", 0))
    is_def = F.col("code").rlike(r"^ *(?:async )?def ")
    # every line belongs to the last def before it, and its function ends at the next def at the latest
    by_line = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("def_no", F.sum(is_def.cast("int")).over(by_line)).where("def_no > 0")
    rows = rows.withColumn("own", F.first(spaces).over(Window.partitionBy("path", "def_no").orderBy("line")))
    closing = F.col("code").rlike(r"^\s*\)")  # of a def that goes on over more lines
    shallow = F.when(~is_def & ~closing & (spaces <= F.col("own")), F.struct(F.col("line").alias("l"), F.col("at").alias("a")))
    head = F.max(F.when(is_def, F.struct("family", "language", "line", "code", "at"))).alias("head")
    defs = rows.groupBy("path", "def_no").agg(head, F.min(shallow).alias("shallow")).select("path", "head.*", "shallow")
    following = F.lead(F.struct(F.col("line").alias("l"), F.col("at").alias("a"))).over(by_line)
    defs = defs.withColumn("next", F.coalesce("shallow", following))
    whole = lines_.groupBy("path").agg(F.max("line").alias("last"), F.max(F.col("at") + F.char_length("raw")).alias("size"))
    found = defs.join(whole, "path")
    begin = F.col("at") + F.char_length("code") + 1
    end = F.coalesce(F.col("next.a"), F.col("size"))
    name = F.regexp_extract("code", r"def +([A-Za-z_][A-Za-z0-9_]*)", 1)
    return found.select("path", "family", "language", name.alias("name"), F.col("line").alias("name_line"), F.col("line").alias("start_line"), F.coalesce(F.col("next.l") - 1, F.col("last")).alias("end_line"), F.least(begin, end).alias("body_offset"), F.greatest(end - begin, F.lit(0)).alias("body_len"), F.col("code").alias("signature"), F.lit("").alias("above"), F.lit(0).cast("bigint").alias("depth"))


def functions(lexed: DataFrame) -> DataFrame:
    """Functions of C-like and Python files with their bodies, numbered by file."""
    found = c_functions(lexed).unionByName(python_functions(lines(lexed.where(F.col("family") == C.PYTHON))))
    may = F.col("braces") & (F.col("family") == C.C_LIKE) | (F.col("family") == C.PYTHON)
    found = found.join(lexed.where(may).select("path", "raw", F.col("code").alias("all_code")), "path")
    body = F.expr("substring(raw, cast(body_offset + 1 as int), cast(body_len as int))")
    # a signature may stand on several lines: the code before the body, for Python from the def on
    before = F.expr(f"substring(all_code, cast(greatest(body_offset - {C.SIGNATURE}, 0) + 1 as int), cast(least(body_offset, {C.SIGNATURE}) as int))")
    after = F.expr(f"substring(all_code, cast(greatest(body_offset - length(signature) - 1, 0) + 1 as int), {C.SIGNATURE})")
    w = Window.partitionBy("path").orderBy("body_offset")
    found = found.withColumn("body", body).withColumn("head", F.when(F.col("family") == C.PYTHON, after).otherwise(before))
    return found.drop("raw", "all_code").withColumn("func_idx", F.row_number().over(w) - 1)


def overwraps(lexed: DataFrame) -> DataFrame:
    """Openings of a try inside at least two others, within a function."""
    rows = _braces(lexed.where("nested"))
    is_try = F.col("open") & F.regexp_extract(F.concat_ws(" ", "previous", "here"), r"(?<![A-Za-z0-9_])(try)[ \t]*$", 1).isin("try")
    tries = rows.where(is_try & F.col("close").isNotNull()).select("path", "line", "pos", F.col("close.pos").alias("until"))
    # openings and closings in order: how many are open at each opening
    opened = tries.select("path", "line", "pos", F.lit(1).alias("step"))
    events = opened.unionByName(tries.select("path", F.lit(None).cast("int").alias("line"), F.col("until").alias("pos"), F.lit(-1).alias("step")))
    w = Window.partitionBy("path").orderBy("pos")
    return events.withColumn("depth", F.sum("step").over(w)).where("line is not null and depth > 2").select("path", "line", "pos", "depth")


@dataclass(frozen=True)
class Tables:
    """What all later steps read; each file is lexed once, and files and functions are written. Lines are made from the files where they are read."""

    lexed: DataFrame
    lines: DataFrame
    functions: DataFrame


def tables(files: DataFrame) -> Tables:
    """Tables of the files that are not skipped."""
    lexed = _whole(written(_slim(lex(files.where("skip_reason is null")))))
    return Tables(lexed, lines(lexed), written(functions(lexed)))
