import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import Packing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(n=400):
    r = random.Random(5)
    vocab = ["The", "it's", "x y", "<|endoftext|>", "a<|startoftext|>b", "ΣΑΣ", "é", "\n", "\x1c", "don't,", "42", "!!", "café"] + ["w" * i + "q" for i in range(30)]
    rows = [(0, None), (1, ""), (2, " \n ")]
    for d in range(3, n):
        rows.append((d, " ".join(r.choice(vocab) for _ in range(int(r.paretovariate(0.7)) % 9000))))
    return rows + [(5, "again"), (5, "again"), (None, "no id")]


@pytest.mark.parametrize("round_tokens", [1 << 18, 3000])
def test_pieces(spark, round_tokens):
    rows = docs()
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, tier string").repartition(3)
    got = [r.asDict() for r in pack(df, Packing(PATH, round_tokens=round_tokens)).collect()]
    tok = Tokenizer.from_file(PATH)
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows if d != 5}
    sequences, pieces = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    for d, ids in want.items():
        own = sorted(pieces[d], key=lambda x: x[0])
        assert [x[0] for x in own] == np.cumsum([0] + [len(x[1]) for x in own[:-1]]).tolist()
        assert np.concatenate([x[1] for x in own]).tolist() == ids and {x[2] for x in own} == {len(ids)}
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        n = sum(r["length"] for r in own)
        assert n <= 2048 and n & (n - 1) == 0 and {r["tier"] for r in own} == {n}
    steps = {}
    for own in sequences.values():
        steps.setdefault(own[0]["step_id"], []).append(own[0]["tier"])
    assert all(len(set(t)) == 1 and sum(t) <= 1 << 15 for t in steps.values())


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), Packing(PATH)).count() == 0


def test_chunks_of_the_corpus(spark):
    """Ids by chunk are those of whole texts, over a table with accents and capitals."""
    from tessera.llm.packing import ChunkIds

    tok = Tokenizer.from_file(PATH)
    known = ChunkIds(PATH, 10_000)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["ÀÉ ÿ. ß, ﬁ, İstanbul é, ª. º, µm Ⅷ, x., .,", "Straße STRASSE, ÆØÅ. Ǆ ǆ,"]
    for text in texts:
        chunks = text.encode().split()
        known.learn(set(chunks))
        got = np.frombuffer(b"".join(known[c] for c in chunks), "<u4").tolist()
        assert got == tok.encode(text, add_special_tokens=False).ids


def test_fuzzed_chunks():
    """Stops after letters of any kind, marks and capitals whose lower case has two characters."""
    import sys
    import unicodedata

    from tessera.llm.packing import ChunkIds

    r = random.Random(8)
    tok, known = Tokenizer.from_file(PATH), ChunkIds(PATH, 10_000)
    assert known.shortcuts and not known.whole
    letters = [c for c in map(chr, range(sys.maxunicode)) if unicodedata.category(c)[0] in "LMN"]
    odd = [c for c in letters if len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c] + ["İ", "ı", "ß", "ẞ", "ǅ", "ª", "̇", "क़", "'", "-"]
    for _ in range(20_000):
        chunks = []
        for _ in range(r.randrange(1, 5)):
            word = "".join(r.choice(r.choice([odd, "abcXYZéÜß", "abcdefgh", letters[:600], letters])) for _ in range(r.randrange(1, 6)))
            chunks.append((word + r.choice([",", ".", "", "", ".,", "'s,"])).encode())
        known.learn(set(chunks))
        got = np.frombuffer(b"".join(known[c] for c in chunks), "<u4").tolist()
        assert got == tok.encode(b" ".join(chunks).decode(), add_special_tokens=False).ids, chunks


def test_other_tokenizers_are_encoded_whole(spark):
    """A file that does not keep the chunk rules is used without them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Two words, one space."), (2, " a  b\n\nc"), (3, None), (4, "İstanbul, İ.")]
    tok = Tokenizer.from_file(path)
    got = {}
    for r in pack(spark.createDataFrame(rows, "doc_id long, text string"), Packing(path, end_id=50256)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    for d, t in rows:
        assert np.frombuffer(b"".join(x for _, x in sorted(got[d])), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [50256]


def test_very_long_text(spark):
    text = "word, " * 400_000 + "z" * 100_000
    rows = [(1, text), (2, text), (3, "")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), Packing(PATH), with_ids=False).collect()
    n = len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids) + 1
    totals = {d: sum(r.length for r in got if r.doc_id == d) for d in (1, 2, 3)}
    assert totals == {1: n, 2: n, 3: 1} and all(0 < r.length <= 2048 for r in got)
