"""Hierarchical multi-length packing of token sequences.

A document is its token ids and an end id. Whole windows of the longest tier are cut off first;
the rest is routed to the shortest tier (a power of two) that holds it. Each tier is packed into
windows of its own length, longest tier first: a window's gap is filled with the largest pieces of
the shorter tiers that fit, and the last gap by cutting a piece. What no longer fills a window
waits for the next round, and at the end of a task is laid out in windows of lesser powers of two,
so that no window needs padding at all. Windows of one tier are dealt to step groups of equal
numbers of tokens.

Every task packs the documents it reads, round by round over a bounded number of tokens: nothing
is shuffled, and a task that is run again packs the same rows the same way. Tokens are found by
white-space-separated chunk and remembered, since the tokenizer never joins across white space.

Defined results: a null or empty text is the end id alone; a text of any length is cut into windows as
it is; repeated rows are packed each; pieces of equal size go in the order of arrival; a null doc_id
stays null; an empty table gives no rows; columns other than doc_id and text are ignored. The last
step group of each tier of a task may stay partial.
"""

from __future__ import annotations

import bisect
import gc
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import identified, table


@dataclass(frozen=True)
class Packing:
    tokenizer: str  # file of a public tokenizer
    end_id: int = 1
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    round_tokens: int = 1 << 18  # of waiting pieces before a round of packing
    step_tokens: int = 1 << 15
    remembered: int = 300_000  # chunks whose ids a worker remembers


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long, ids binary"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level tokenizers name bytes: printable ones by themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest) if b != 10}


_BYTE_LETTERS = _byte_letters()


_LITTLE = sys.byteorder == "little"


def pack_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if not _LITTLE:
        out.byteswap()
    return out.tobytes()


def _plain(low: str) -> bool:
    """Whether a lower-cased word has letters up to U+00FF alone."""
    return low.isalpha() and (low.isascii() or max(low) < "\u0100")


def _ends_word(letter: str) -> bool:
    """Letters after which a stop is cut off: those whose lower case is one letter too, without a mark that joins the stop."""
    return letter.isalpha() and letter < "\u0250" and len(letter.lower()) == 1


class ChunkIds(dict):
    """Ids (little-endian 32-bit, as bytes) by chunk.

    In this tokenizer family a comma or full stop after a letter is a token of its own and letters are
    lower-cased, so such chunks share the ids of their letters, and words of letters up to U+00FF go to the
    model at once. All else goes through the whole tokenizer, and so does everything if the file at hand
    does not keep these rules (``shortcuts``).
    """

    def __init__(self, path: str, limit: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.whole = not self._chunks_stand_alone()
        self.shortcuts = not self.whole and self._rules_hold()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunks_stand_alone(self) -> bool:
        """Whether white space only parts chunks: neither a token of its own nor a part of one."""
        chunks = ["It's", "a", "Word,", "42", "\u00e9t\u00e9.", "(x)", "a"]
        apart = [i for c in chunks for i in self._ids(c)]
        return all(self._ids(space.join(chunks)) == apart for space in (" ", "  ", "\n", "\t", "\r", "\x0b", "\x0c"))

    def _rules_hold(self) -> bool:
        letters = [c for c in map(chr, range(0x250)) if _ends_word(c)]
        stops = all(self._ids(f"b{c}{m}") == self._ids(f"b{c}") + self._ids(m) for c in letters for m in ",.")
        words = [w for c in letters if c < "\u0100" for w in (c, f"{c}b", f"Ab{c}ab") if _plain(w.lower())]
        return stops and all(pack_ids(self._ids(w)) == self._word(w.lower()) for w in words)

    def _word(self, low: str) -> bytes:
        """Ids of a word of lower-case letters by the model alone."""
        text = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return pack_ids([t.id for t in self.tokenizer.model.tokenize(text)])

    def learn(self, chunks: set[bytes]) -> None:
        new = chunks - self.keys()
        if len(self) + len(new) > self.limit:
            self.clear()
            new = chunks
        if not self.shortcuts:
            return self._encode(list(new))
        plain, lower, stopped, other = set(), [], [], []
        for c, text in zip(new, b"\n".join(new).decode().split("\n")):
            head = c
            if text[-1] in ",.":
                text, head = text[:-1], c[:-1]
                if not (text and _ends_word(text[-1])):
                    other.append(c)
                    continue
                stopped.append(c)
                if head in self or head in new:
                    continue
            if text.isalpha() and (text.isascii() or _plain(text)):
                low = text.lower()
                if low != text:
                    low = low.encode()
                    lower.append((head, low))
                    if low in self:
                        continue
                    plain.add(low)
                else:
                    plain.add(head)
            else:
                other.append(head)
        tokenize = self.tokenizer.model.tokenize
        simple = [w for w in plain if w.isascii()]
        accented = [w for w in plain if not w.isascii()]
        texts = b"\n".join(simple).decode().split("\n") if simple else []
        texts += b"\n".join(accented).decode("latin-1").translate(_BYTE_LETTERS).split("\n") if accented else []
        found = [array("I", [t.id for t in tokenize(x)]).tobytes() for x in texts] if _LITTLE else [pack_ids([t.id for t in tokenize(x)]) for x in texts]
        self.update(zip(simple + accented, found))
        self._encode(other)
        self.update([(c, self[x]) for c, x in lower])
        if stopped:
            self._encode([m for m in (b",", b".") if m not in self])
            self.update([(c, self[c[:-1]] + self[c[-1:]]) for c in stopped])

    def _encode(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), 4096):
            part = [c.decode() for c in chunks[at : at + 4096]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            first = np.array([a for a, _ in found.offsets], np.int64)
            ends = np.cumsum([len(c) + 1 for c in part])
            cut = np.concatenate([[0], np.searchsorted(first, ends)])
            for c, a, b in zip(chunks[at : at + 4096], cut.tolist(), cut[1:].tolist()):
                self[c] = ids[a:b].tobytes()


@lru_cache(maxsize=1)
def _known(path: str, limit: int) -> ChunkIds:
    """One for all tasks of a worker; what it remembers never changes what it gives."""
    return ChunkIds(path, limit)


#: A waiting piece: tokens, order of arrival, doc_id, start, tokens of its document, ids.
Piece = tuple[int, int, int, int, int, bytes]


class Packer:
    def __init__(self, p: Packing, first_id: int):
        self.p, self.next_id, self.first_id = p, first_id, first_id
        self.longest = p.tiers[-1]
        self.waiting: dict[int, list[Piece]] = {t: [] for t in p.tiers}
        self.tokens = self.arrived = 0
        self.steps: dict[int, list[int]] = {}
        self.next_step = first_id
        self.out: list[tuple] = []

    def _wait(self, piece: Piece) -> None:
        tier = self.p.tiers[bisect.bisect_left(self.p.tiers, piece[0])]
        bisect.insort(self.waiting[tier], piece)
        self.tokens += piece[0]

    def _emit(self, tier: int, pieces: list[Piece]) -> None:
        step = self.steps.get(tier)
        if step is None or step[1] + tier > self.p.step_tokens:
            step = self.steps[tier] = [self.next_step, 0]
            self.next_step += 1
        step[1] += tier
        offset = 0
        for n, _, doc, start, total, ids in pieces:
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, tier, step[0], ids))
            offset += n
        self.next_id += 1

    def add(self, doc: int, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while total - start >= self.longest:
            self._emit(self.longest, [(self.longest, 0, doc, start, total, ids[4 * start : 4 * (start + self.longest)])])
            start += self.longest
        if start < total:
            self.arrived += 1
            self._wait((total - start, self.arrived, doc, start, total, ids[4 * start :]))
        if self.tokens >= self.p.round_tokens:
            self.round()

    @staticmethod
    def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
        size, order, doc, start, total, ids = piece
        return (n, order, doc, start, total, ids[: 4 * n]), (size - n, order, doc, start + n, total, ids[4 * n :])

    def _fit(self, room: int, below: int) -> Piece | None:
        """The largest waiting piece of at most room tokens, from tiers up to below."""
        for tier in reversed(self.p.tiers):
            own = self.waiting[tier]
            if tier <= below and own and own[0][0] <= room:
                piece = own.pop(bisect.bisect_right(own, (room + 1,)) - 1)
                self.tokens -= piece[0]
                return piece
        return None

    def round(self) -> None:
        for tier in reversed(self.p.tiers):
            while self.waiting[tier]:
                pieces, room = [], tier
                while room and (piece := self._fit(room, tier)):
                    pieces.append(piece)
                    room -= piece[0]
                if room:  # no piece fits whole: cut the least that is long enough
                    own = next((w for t in self.p.tiers if t <= tier and (w := self.waiting[t])), None)
                    if own is None:
                        for piece in pieces:
                            self._wait(piece)
                        break
                    piece = own.pop(0)
                    self.tokens -= piece[0]
                    head, tail = self._cut(piece, room)
                    pieces.append(head)
                    self._wait(tail)
                self._emit(tier, pieces)

    def finish(self) -> None:
        self.round()
        left = sorted((x for own in self.waiting.values() for x in own), reverse=True)
        while left:
            tokens = sum(x[0] for x in left)
            tier = min(self.longest, 1 << (tokens.bit_length() - 1))
            pieces, room = [], tier
            while room:
                piece = left.pop(0)
                if piece[0] > room:
                    piece, tail = self._cut(piece, room)
                    left.insert(0, tail)
                pieces.append(piece)
                room -= piece[0]
            self._emit(tier, pieces)


def pack(docs: DataFrame, p: Packing, with_ids: bool = True) -> DataFrame:
    """One row for each piece; sequences are told apart by sequence_id, whose length is tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(p.tokenizer, p.remembered)
        packer = Packer(p, TaskContext.get().partitionId() << 33)
        end = np.array([p.end_id], "<u4").tobytes()
        fields = [f.split() for f in SCHEMA.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [()] * len(fields)
            packer.out = []
            if not with_ids:
                columns[-1] = [None] * len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

        collecting = gc.isenabled()
        gc.disable()  # nothing here has cycles, and the collector would walk all that is remembered
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
                for at in range(0, len(ids), 256):
                    own_texts = [t or b"" for t in texts.slice(at, 256).to_pylist()]
                    if known.whole:
                        for doc, t in zip(ids[at : at + 256], own_texts):
                            packer.add(doc, pack_ids(known._ids(t.decode())) + end)
                        continue
                    parts = [t.split() for t in own_texts]
                    known.learn(set().union(*parts))
                    for doc, own in zip(ids[at : at + 256], parts):
                        packer.add(doc, b"".join([*map(known.__getitem__, own), end]))
                if len(packer.out) > 512:
                    yield rows()
            packer.finish()
            yield rows()
        finally:
            if collecting:
                gc.enable()

    return identified(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    p = Packing(public_tokenizers.path("word_bpe_49k.json"))
    return pack(table(spark, sf_dir, "documents"), p, with_ids=False).drop("ids")
