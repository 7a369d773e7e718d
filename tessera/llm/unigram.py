"""A unigram vocabulary over the pieces of a public SentencePiece model.

Nothing is trained: the pieces come from the model file, whose path is a parameter, and the score of
the piece with id ``i`` is ``-ln(i + 2)`` rounded to sixteenths, a Zipf law by rank. Sums of such scores
are exact in single and double precision, so ties are real ties and fall as SentencePiece's own
unigram search has them: of equally good paths to a place, the one whose last piece starts first.

Text is not changed but for spaces, which become U+2581, and one U+2581 put before it; an empty text
has no pieces. A character that is no piece costs ten more than the worst piece and becomes its
UTF-8 bytes. No piece has U+2581 after another character, a comma or full stop after a letter, or a
line feed, so a text may be cut there and its parts be searched one by one; ``Vocabulary.load``
checks that.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Parts that can be searched alone.
PARTS = f"\n|▁*[{LETTERS}]+(?=[.,])|▁+[^▁\n]*|[^▁\n]+"


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, tuple[int, float]]  # id and score
    byte_ids: tuple[int, ...]
    unknown: float  # score of a character that is no piece

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = (i, score(i))
        if any("\n" in x or SPACE in x.lstrip(SPACE) or re.search(f"[{LETTERS}][.,]", x) for x in pieces) or len(byte_ids) != 256:
            raise ValueError("pieces of this model cross the places where texts are cut")
        return Vocabulary(pieces, tuple(byte_ids[b] for b in range(256)), min(s for _, s in pieces.values()) - 10)

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def score(i: int) -> float:
    return -round(16 * math.log(i + 2)) / 16


def escaped(text: Column) -> Column:
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def parts(text: Column) -> Column:
    return F.regexp_extract_all(escaped(text), F.lit(PARTS), F.lit(0))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
