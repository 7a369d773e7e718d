import random
import struct

import pytest
import sentencepiece

from tessera.llm import sentencepiece_lattice as lattice
from tessera.llm import token_counts, unigram

PATH = unigram.default_path()


def field(number, kind, value):
    key = bytes([*varint(number << 3 | kind)])
    if kind == 2:
        return key + varint(len(value)) + value
    return key + (struct.pack("<f", value) if kind == 5 else varint(value))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def library():
    """The library's own unigram search over the same pieces and scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = b""
    for i in range(model.get_piece_size()):
        kind = 6 if model.is_byte(i) else 3 if model.is_control(i) else 2 if model.is_unknown(i) else 1
        out += field(1, 2, field(1, 2, model.id_to_piece(i).encode()) + field(2, 5, unigram.score(i)) + field(3, 0, kind))
    out += field(2, 2, field(3, 0, 1) + field(35, 0, 1))
    out += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def texts(n=120):
    r = random.Random(4)
    rows = [(0, None), (1, ""), (2, " "), (3, "  a  b "), (4, "\n\n x\n"), (5, "日本語 ☃ naïve été, fin."), (6, "a,b.c,,d.. 1.5,x"), (7, "x" * 3000), (8, "one\ttwo\r\nthree"), (9, "▁a ▁▁ b"), (10, "<s> </s> <0x41>")]
    vocab = ["the", "thending,", "ouerhe.", "été", "!!", "the&&&", "12,5", "\n", "ß", "\U0001f600", "edtionea"]
    return rows + [(20 + i, " ".join(r.choice(vocab) for _ in range(r.randrange(80)))) for i in range(n)] + [(20, "again"), (None, "no id")]


def test_against_the_library(spark, library):
    rows = texts()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int").repartition(3)
    want = sorted((str(d), tuple(library.encode(t or ""))) for d, t in rows)
    encoded = lattice.encode(df, PATH, block_bytes=2000)
    got = lattice.decode(encoded, PATH).collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == want
    assert all(r.decoded == r.text.replace("▁", " ") for r in got)
    counted = token_counts.count_pieces(df, PATH, remembered=50).collect()
    assert sorted((str(r.doc_id), r.n_pieces) for r in counted) == sorted((d, len(i)) for d, i in want)


def test_score(library):
    v = unigram.Vocabulary.load(PATH)
    c = token_counts.Counter(v, 10)
    ids = library.encode("representation")
    assert c.search("▁representation") == (len(ids), sum(unigram.score(i) for i in ids))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.encode(empty, PATH).count() == 0
    assert token_counts.count_pieces(empty, PATH).count() == 0


def test_scores_in_sql(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 32001).select("id", lattice.piece_score(F.col("id"), -99.0).alias("s")).collect()
    assert all(r.s == (-99.0 if r.id == 0 else unigram.score(r.id - 1)) for r in rows)


def test_long_parts(spark, library):
    """Parts without a space of tens of thousands of characters, folded chunk by chunk in time that grows with their length."""
    import time

    r = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/中文字"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(n))) for i, n in enumerate((700, 5000, 32_000))]
    begun = time.time()
    with lattice.wide_aggregates(spark):
        got = {x.doc_id: x.ids for x in lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert time.time() - begun < 90
    assert got == {i: library.encode(t) for i, t in rows}


def test_time_grows_with_the_length_of_a_part(spark, library):
    import time

    r, took = random.Random(9), []
    for n in (1000, 8000, 32_000):
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        begun = time.time()
        with lattice.wide_aggregates(spark):
            got = lattice.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first().ids
        took.append(time.time() - begun)
        assert got == library.encode(text)
    assert took[2] < max(5 * took[1], 10) and took[2] < 30, took


def test_rows_without_id_are_dealt_out(spark, library):
    rows = [(None, t) for t in ("one", "two", "one", "", None, "x" * 600 + " \U0001f600" + "\U0001f600" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.text, tuple(r.ids)) for r in lattice.encode(df, PATH, block_bytes=100).collect())
    assert got == sorted((t or "", tuple(library.encode(t or ""))) for _, t in rows)


def test_both_forms_agree(spark, library):
    """Arrays of parts and SQL functions give the library's ids, with odd characters, digests and blocks of a few texts."""
    rows = texts(60) + [(200, "\0 a\0b"), (201, "\U0001f600☃é߿ࠀ￿" * 60), (202, "ab" * 400 + "中" * 300), (203, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(d), tuple(library.encode(t or ""))) for d, t in rows if "\0" not in (t or ""))
    for in_sql in (False, True):
        with lattice.wide_aggregates(spark):
            got = lattice.encode(df, PATH, block_bytes=3000, in_sql=in_sql).collect()
        assert len(got) == len(rows)
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in got if "\0" not in r.text) == want
        zero = [r.ids for r in got if r.doc_id == 200]
        assert [zero[0]] == [r.ids for r in lattice.encode(df.where("doc_id = 200"), PATH).collect()]


def test_work_of_many_parts(library):
    """100,000 different parts in under 10 seconds."""
    import time

    import numpy as np

    from tessera.llm.piece_lattice import Trie, best_paths

    r = random.Random(5)
    parts = ["▁" * r.randrange(2) + "".join(r.choice("abcdefghijklmnoprstuvé☃") for _ in range(r.randrange(1, 16))) for _ in range(100_000)] + ["x" * 700, "y" * 512]
    trie = Trie(unigram.Vocabulary.load(PATH))
    begun = time.time()
    found = list(best_paths(parts, trie))
    assert time.time() - begun < 10
    counts, ids = (np.concatenate([x[k] for x in found]) for k in range(2))
    at = np.cumsum(counts) - counts
    for k in [*range(0, len(parts), 97), len(parts) - 2, len(parts) - 1]:
        own = ids[at[k] : at[k] + counts[k]].tolist()
        if parts[k].startswith("▁"):
            assert own == library.encode(parts[k][1:]), parts[k]
