"""Kernels as SQL table functions, for LATERAL calls over any table.

    SELECT d.doc_id, l.* FROM documents d, LATERAL lex_lines(d.text, 'c-like') l
    SELECT d.doc_id, s.* FROM documents d, LATERAL lex_strings(d.text, 'python') s

A null content is an empty file; families are those of ``constants``: c-like, python, shell.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.operators import lexer

_SPACE = " \t\r\f\x0b"


def _bytes(content: str | bytes | None) -> bytes:
    return (content or "").encode() if content is None or isinstance(content, str) else bytes(content)


@udtf(returnType="line: int, at: int, kind: string, raw: string, code: string")
class LexLines:
    """Lines from 1: first byte, kind (code, comment, blank), text and code, both as ISO-8859-1."""

    def eval(self, content, family: str) -> Iterator[tuple]:
        data = _bytes(content)
        found = lexer.runs(data, family)
        code, starts = lexer.blanked(data, found), lexer.line_starts(data)
        marks = lexer.line_marks(starts, len(data), found) or [None] * len(starts)
        for i, (at, raw, own, mark) in enumerate(zip(starts.tolist(), data.split(b"\n"), code.split(b"\n"), marks)):
            text, plain = raw.decode("latin-1"), own.decode("latin-1")
            kind = "blank" if not text.strip(_SPACE) else "code" if plain.strip(_SPACE) or (mark and mark["string"]) else "comment"
            yield i + 1, at, kind, text, plain


@udtf(returnType="spot: int, text: string")
class LexStrings:
    """Strings of the code: first byte, and text without quotes."""

    def eval(self, content, family: str) -> Iterator[tuple]:
        data = _bytes(content)
        for start, end, kind in lexer.runs(data, family):
            if kind == "string":
                yield start, data[start:end][1:-1].decode("latin-1")


def register(spark: SparkSession) -> None:
    spark.udtf.register("lex_lines", LexLines)
    spark.udtf.register("lex_strings", LexStrings)
