"""The lattice of a batch of text parts as arrays, and the best path through each.

The parts of a batch lie side by side, longest first. The edges that start at all places are found by a
join with the trie of the pieces, one character at a time: places whose substring begins no piece drop out.
Edges are then taken by their start, all parts at once, and keep the best last edge of every place; an edge that
starts later has to be better, so the earlier start wins ties. A walk back gives the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.unigram import Vocabulary

#: Classes of characters whose steps are a table; steps by rarer ones are searched in a sorted list.
_DENSE = 96
#: Characters of a batch; parts of more than _LONG characters are folded alone, _SEGMENT starts at a time.
BATCH, _LONG, _SEGMENT = 1 << 20, 512, 1 << 17


class Trie:
    """Pieces by their characters, with the id of each node's piece or -1, and scores by id + 1."""

    def __init__(self, vocabulary: Vocabulary):
        steps: dict[tuple[int, str], int] = {}
        ids = [-1, -1]  # node 0 is nowhere, node 1 the root
        for piece, (i, _) in vocabulary.pieces.items():
            node = 1
            for c in piece:
                if (node, c) not in steps:
                    steps[node, c] = len(ids)
                    ids.append(-1)
                node = steps[node, c]
            ids[node] = i
        self.piece = np.array(ids, np.int32)
        self.score = np.full(self.piece.max() + 2, vocabulary.unknown)
        for i, s in vocabulary.pieces.values():
            self.score[i + 1] = s
        often: dict[str, int] = {}
        for _, c in steps:
            often[c] = often.get(c, 0) + 1
        classes = {c: k for k, c in enumerate(sorted(often, key=often.get, reverse=True), 1)}
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no piece
        for c, k in classes.items():
            self.kind[ord(c)] = k
        self.table = np.zeros((len(ids), _DENSE), np.int32)
        rare = []
        for (node, c), to in steps.items():
            if classes[c] < _DENSE:
                self.table[node, classes[c]] = to
            else:
                rare.append((node << 32 | classes[c], to))
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*sorted(rare) or [(-1, 0)]))
        self.bytes = np.array(vocabulary.byte_ids, np.int32)

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = self.table.ravel()[node.astype(np.int64) * _DENSE + np.where(kind < _DENSE, kind, 0)]
        rare = np.flatnonzero(kind >= _DENSE)
        if len(rare):
            key = node[rare].astype(np.int64) << 32 | kind[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.to[at], 0)
        return out

    def edges(self, start: np.ndarray, row: np.ndarray, base: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Size, starts, rows and ids of the edges from the given places; kind[base[s] + row] is the character at place s of a row."""
        node, size = np.ones(len(start), np.int32), 0
        while len(start):
            node = self.step(node, kind[base[start + size] + row])
            size += 1
            own = self.piece[node]
            if size == 1:  # a character that is no piece is an edge of its own
                yield 1, start, row, own
            elif (hit := own >= 0).any():
                yield size, start[hit], row[hit], own[hit]
            on = node > 0
            start, row, node = start[on], row[on], node[on]


def _fold(trie: Trie, lengths: np.ndarray, base: np.ndarray, count: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and id of the best last edge of each place, for parts side by side."""
    start = np.repeat(np.arange(len(count) - 1, dtype=np.int32), count[1:])
    row = (np.arange(len(start)) - np.repeat(np.cumsum(count[1:]) - count[1:], count[1:])).astype(np.int32)
    best, size, last = np.full(len(kind), -np.inf), np.zeros(len(kind), np.int32), np.full(len(kind), -1, np.int32)
    best[: count[0]] = 0
    found = [(n, r, i, np.searchsorted(s, np.arange(len(count)))) for n, s, r, i in trie.edges(start, row, base, kind)]
    for s in range(len(count) - 1):
        here = best[base[s] : base[s] + count[s]]
        for n, rows, ids, at in found:
            lo, hi = at[s], at[s + 1]
            if lo == hi:
                continue
            r, i = rows[lo:hi], ids[lo:hi]
            score, to = here[r] + trie.score[i + 1], base[s + n] + r
            better = score > best[to]
            to = to[better]
            best[to], size[to], last[to] = score[better], n, i[better]
    return size, last


def _fold_one(trie: Trie, length: int, base: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long part."""
    best, size, last = [0.0] + [-np.inf] * length, np.zeros(length + 1, np.int32), np.full(length + 1, -1, np.int32)
    for at in range(0, length, _SEGMENT):
        start = np.arange(at, min(length, at + _SEGMENT))
        found = [(s, np.full(len(s), n), i) for n, s, _, i in trie.edges(start, np.zeros(len(start), np.int64), base, kind)]
        s, n, i = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(s, kind="stable")
        for s, n, i, v in zip(*(x[order].tolist() for x in (s, n, i, trie.score[i + 1]))):
            if (score := best[s] + v) > best[s + n]:
                best[s + n], size[s + n], last[s + n] = score, n, i
    return size, last


def _batch(parts: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    codes = np.frombuffer("\0".join([parts[i] for i in order.tolist()] + [""]).encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    longest = int(lengths[0])
    # the place s of the row r is base[s] + r; the place after the last character counts
    if len(parts) == 1:
        count, base, place = np.ones(longest + 1, np.int64), np.arange(longest + 1), np.arange(longest + 1)
    else:
        count = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")
        base = np.cumsum(count) - count
        place = np.concatenate([first[:n] + s for s, n in enumerate(count.tolist())])
    codes = codes[place]
    kind = trie.kind[codes]
    ends = base[lengths] + np.arange(len(lengths))
    kind[ends] = 0
    size, last = _fold_one(trie, longest, base, kind) if len(parts) == 1 and longest > _LONG else _fold(trie, lengths, base, count, kind)
    at, row, pieces = lengths, np.arange(len(lengths)), []
    if len(parts) == 1:
        steps, own, place = size.tolist(), [], longest
        while place:
            own.append(place)
            place -= steps[place]
        ids, begin, row = last[own[::-1]], np.array(own[::-1]) - size[own[::-1]], np.zeros(len(own), np.int64)
    else:
        while len(row := row[at > 0]):
            at = at[at > 0]
            end = base[at] + row
            at = at - size[end]
            pieces.append((row, last[end], base[at] + row))
        row, ids, begin = (np.concatenate([p[k] for p in pieces[::-1]]) for k in range(3))
        back = np.argsort(order[row], kind="stable")  # rows as they came, first piece first
        row, ids, begin = order[row[back]], ids[back], begin[back]
    if (ids < 0).any():  # a character that is no piece becomes its bytes
        code = codes[begin].astype(np.int64)
        n = np.where(ids < 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        which = np.repeat(np.arange(len(ids)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        size, code = n[which], code[which]
        low = code >> (6 * (size - 1 - nth)) & 0x3F | 0x80
        head = np.where(size == 1, code, code >> (6 * (size - 1)) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[size])
        ids = np.where(ids[which] < 0, trie.bytes[np.where(nth == 0, head, low) & 0xFF], ids[which])
        row = row[which]
    return np.bincount(row, minlength=len(parts)), ids.astype(np.int32)


def best_paths(parts: list[str], trie: Trie) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For batches of the parts, in order: how many pieces each part has, and the ids one after the other. No part is empty."""
    batch, size = [], 0
    for part in parts:
        long = len(part) > _LONG
        if batch and (long or size + len(part) > BATCH):
            yield _batch(batch, trie)
            batch, size = [], 0
        batch.append(part)
        size += len(part)
        if long:
            yield _batch(batch, trie)
            batch, size = [], 0
    if batch:
        yield _batch(batch, trie)
