"""The lexer's kernel against plain rules."""

import random
import re

from tessera import constants as C
from tessera.operators import lexer


def test_kinds_of_lines():
    rng, space = random.Random(5), " \t\r\f\x0b"
    signs = ["a", "b ", "\n", "\n", '"', "'", "`", "//", "#", "/*", "*/", "\\", " ", "\t", "\x0b", '"""', "x1", "_", "é", "\r\n", "{", "}"]
    for _ in range(3000):
        family = rng.choice([C.C_LIKE, C.PYTHON, C.SHELL])
        content = "".join(rng.choice(signs) for _ in range(rng.randrange(40))).encode("latin-1")
        found, begun = lexer.runs(content, family), lexer.line_starts(content)
        code = lexer.blanked(content, found)
        starts, kinds, indents, commented, places = lexer.line_kinds(content, code, found)
        marks = lexer.line_marks(begun, len(content), found) or [None] * len(begun)
        want, spaces, comments = "", [], []
        for i, (raw, own, mark) in enumerate(zip(content.decode("latin-1").split("\n"), code.decode("latin-1").split("\n"), marks)):
            quoted = bool(mark and mark["string"])
            want += "bB"[quoted] if not raw.strip(space) else "cs"[quoted] if own.strip(space) or quoted else "m"
            if want[-1] in "cs":
                lead = re.match("[ \t]*", raw)[0]
                spaces.append(len(lead) + 3 * lead.count("\t"))
            if mark and mark["at"]:
                comments.append((i + 1, mark["at"]))
                assert mark["size"] == len(raw) - mark["at"] + 1
        assert (starts, kinds, indents, list(zip(commented, places))) == (begun.tolist(), want, spaces, comments)


def test_counts_of_words():
    rng = random.Random(6)
    for _ in range(1000):
        code = "".join(rng.choice(["if", "else", "data", " ", " ", "9", "a", "_", "B", "x_y", "camelCase", "é", "\n", "12ab", "match", "self"]) for _ in range(rng.randrange(60)))
        names = [w for w in re.findall("[A-Za-z_][A-Za-z0-9_]*", code) if len(w) > 1 and re.search("[a-z]", w) and w not in C.KEYWORDS]
        conditionals = re.findall(rf"(?<![A-Za-z0-9_])(?:{'|'.join(C.CONDITIONALS)})(?![A-Za-z0-9_])", code)
        camel = [w for w in names if len(w) > 2 and re.match("[a-z].*[A-Z]", w)]
        snake = [w for w in names if re.fullmatch("[a-z0-9_]{3,}", w) and "_" in w]
        want = tuple(map(len, (conditionals, names, [w for w in names if w in C.GENERIC_NAMES], set(names), camel, snake)))
        assert lexer.word_counts(code.encode("latin-1")) == want
