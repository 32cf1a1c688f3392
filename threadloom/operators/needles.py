"""Many needles looked for in texts at once: a trie in flat arrays, walked from all places of a block of texts together.

A node costs some 24 to 36 bytes whatever the needles, less than an automaton of objects takes, so one worker holds them all where
they would have been split among scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: No character: ends texts, and with them every walk.
_END = 0x110000
_CHAR_BITS = np.uint64(21)
_NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Places walked from at once, and characters of the texts that are met together (a longer text is met whole).
BLOCK = 1 << 16


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Needles:
    """Different needles of one character or more, by number."""

    def __init__(self, needles: Sequence[str]):
        codes, sizes = _codes("".join(needles)), np.fromiter(map(len, needles), np.int64, len(needles))
        starts, nodes, of_node = np.cumsum(sizes) - sizes, 1, [np.full(1, -1, np.int32)]
        going, at, steps = np.arange(len(needles)), np.zeros(len(needles), np.uint64), []
        for depth in range(int(sizes.max(initial=0))):  # all needles go one node down
            keys, place = np.unique((at << _CHAR_BITS) | codes[starts[going] + depth], return_inverse=True)
            ended, own = sizes[going] == depth + 1, np.full(len(keys), -1, np.int32)
            own[place[ended]] = going[ended]
            of_node.append(own)
            steps.append(keys)
            going, at = going[~ended], (place[~ended] + nodes).astype(np.uint64)
            nodes += len(keys)
        self._needle = np.concatenate(of_node)
        self._first = np.zeros(_END + 1, np.int32)
        if steps:
            self._first[steps[0].astype(np.int64)] = np.arange(1, 1 + len(steps[0]))
        self._table(np.concatenate([*steps[1:], np.zeros(0, np.uint64)]), 1 + sum(map(len, steps[:1])))
        self._count = len(needles)

    def _table(self, keys: np.ndarray, first: int) -> None:
        """Nodes by (parent, character), numbered from ``first`` on in the order of keys; at most a third of the places are taken."""
        bits = max(4, (len(keys) * 3).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._node, self._key = np.zeros(1 << bits, np.int32), np.concatenate([np.full(first, _NO_KEY), keys])
        left = np.arange(first, len(self._key), dtype=np.int32)
        place = self._home(keys)
        while len(left):
            free = np.flatnonzero(self._node[place] == 0)
            self._node[place[free]] = left[free]
            on = np.flatnonzero(self._node[place] != left)
            left, place = left[on], (place[on] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> self._shift).view(np.int64)

    def _step(self, nodes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child by their character, and these children."""
        keys = (nodes.astype(np.uint64) << _CHAR_BITS) | chars
        place = self._home(keys)
        out = self._node.take(place)
        other = np.flatnonzero((self._key.take(out) != keys) & (out != 0))
        place, wanted = place.take(other), keys.take(other)
        while len(other):
            place = (place + 1) & self._mask
            held = self._node.take(place)
            out[other] = held
            more = np.flatnonzero((self._key.take(held) != wanted) & (held != 0))
            other, place, wanted = other.take(more), place.take(more), wanted.take(more)
        on = np.flatnonzero(out)
        return on, out.take(on)

    def _found(self, codes: np.ndarray, text_of: np.ndarray, start: int) -> np.ndarray:
        """Text * needles + needle for what begins in the block at ``start``, once each."""
        nodes = self._first.take(codes[start : start + BLOCK])
        at = np.flatnonzero(nodes)
        nodes, depth, found = nodes.take(at), 1, [np.zeros(0, np.int64)]
        at += start
        while len(at):
            needle = self._needle.take(nodes)
            ends = np.flatnonzero(needle >= 0)
            pairs = text_of.take(at.take(ends)) * self._count + needle.take(ends)
            pairs.sort()
            found.append(pairs[np.diff(pairs, prepend=-1) != 0])
            on, nodes = self._step(nodes, codes.take(at + depth, mode="clip"))  # the last one is no character
            at, depth = at.take(on), depth + 1
        return np.concatenate(found)

    def in_texts(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of texts, numbers of needles): which texts hold which needles, each pair once, some texts at a time."""
        at = 0
        while at < len(texts) and self._count:
            own, held = [], 0
            while at + len(own) < len(texts) and held < BLOCK:
                own.append(texts[at + len(own)] or "")
                held += len(own[-1]) + 1
            codes, sizes = _codes("\0".join(own) + "\0").copy(), np.fromiter(map(len, own), np.int64, len(own)) + 1
            codes[np.cumsum(sizes) - 1] = _END
            text_of = np.repeat(np.arange(len(own)), sizes)
            found = [self._found(codes, text_of, start) for start in range(0, len(codes), BLOCK)]
            pairs = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            yield pairs // self._count + at, pairs % self._count
            at += len(own)
