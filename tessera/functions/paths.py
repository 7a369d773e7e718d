"""Predicates and lookups on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as C


def extension(path: Column) -> Column:
    """From the last dot on, anywhere in the path; empty without a dot."""
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def _lookup(path: Column, column: int, other: str) -> Column:
    table = F.create_map(*[F.lit(x) for row in C.EXTENSIONS for x in (row[0], row[column])])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(other))


def family(path: Column) -> Column:
    return _lookup(path, 1, C.C_LIKE)


def language(path: Column) -> Column:
    return _lookup(path, 2, "unknown")


def has_skip_suffix(path: Column) -> Column:
    out = F.lit(False)
    for suffix in C.SKIP_SUFFIXES:
        out = out | path.endswith(suffix)
    return out


def is_source(path: Column) -> Column:
    return ~has_skip_suffix(path) & extension(path).isin(*[e for e, _, _ in C.EXTENSIONS], *C.EXTRA_EXTENSIONS)


def segments(path: Column) -> Column:
    return F.split(path, "/")


def in_folders(path: Column, folders=C.SKIP_FOLDERS) -> Column:
    return F.arrays_overlap(segments(path), F.array(*[F.lit(f) for f in folders]))


def is_ignored(path: Column, entries: list[str]) -> Column:
    """Whether a segment of the path equals an entry exactly."""
    return in_folders(path, entries) if entries else F.lit(False)


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(folder, "(?<!^)/+$", ""), name)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.locate("\x00", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0


def is_minified(content: Column) -> Column:
    """More than 200 bytes a line on average, rounded down."""
    text = F.decode(content, "ISO-8859-1")
    size = F.octet_length(content)
    breaks = size - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.floor((size - breaks) / F.greatest(breaks, F.lit(1))) > 200


def is_generated(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    out = F.lit(False)
    for mark in C.GENERATED_MARKS:
        out = out | head.contains(mark)
    return out


def skip_reason(content: Column) -> Column:
    return F.when(is_binary(content), "binary").when(is_minified(content), "minified").when(is_generated(content), "generated")
