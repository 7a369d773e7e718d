"""Helpers shared by the operators: staging, Arrow text access, vectorised hashing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; whole documents are never cut by it.
CHUNK = 1 << 18


#: Bounds of an Arrow batch, since documents may be long: rows, bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, for the whole session, since plans run after this returns; a smaller setting stays."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder in its warehouse, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"


_open: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write to the shared folder and read again: what follows survives lost executors.

    With ``outlive`` the table stays when the innermost released() block ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    if len(_open) > outlive:
        _open[-1 - outlive].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader is done."""
    for df in tables:
        _delete(df.sparkSession, df._staged_path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: for steps whose result is stored by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def identified(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The named columns alone, so extra columns of any name do not matter."""
    return df.select(F.col(f"`{key}`").cast("long").alias(key), *[F.col(f"`{c}`") for c in columns])


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The rows with the least hash of key, bound at most.

    Rows beyond twice the bound are passed over by their hash where they are, so that what the tasks send
    to the driver does not grow with their number.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    total = df.count()
    if total > 2 * bound:
        df = df.where(place < int(2 * bound / total * (1 << 40)))
    return df.orderBy(place, key).limit(bound)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, width)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], raw


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK * 2), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 23:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """c with (c[e] - c[s]) * inverse ** s a hash of symbols[s:e], all modulo 2 ** 64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power("up", len(symbols)), dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * _power("down", len(prefix))[start]


def window_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of each k consecutive symbols."""
    c = prefix_hash(symbols)
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((c[k:] - c[:n]) * _power("down", len(c))[:n])


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run of bytes other than ASCII space and 9 to 13), and the first word of each row.

    A word never crosses a row. The third array has a last entry: the number of words.
    """
    n = len(raw)
    solid = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a row's first byte starts a word though the byte before is solid
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of more bytes get a cryptographic hash, since sums modulo 2 ** 64 are known to agree for some long words.
LONG_WORD = 256


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word."""
    out = mix(span_hash(prefix_hash(BYTE_SYMBOLS[raw]), starts, ends) + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out
