"""The longest part of a text that stands in a pool, in time linear in both: a suffix automaton of the shorter one.

Blanks don't count: a part stands in the pool if it does without them, white space at its ends aside.
"""

from __future__ import annotations

from itertools import accumulate


class SuffixAutomaton:
    """States are the substrings that end at the same places; each knows the length of its longest one."""

    def __init__(self, text: str):
        self.step: list[dict[str, int]] = [{}]
        self.link, self.size, self.ends = [-1], [0], []
        last = 0
        for c in text:
            new = self._state(self.size[last] + 1)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.step[p][c]
                if self.size[q] == self.size[p] + 1:
                    self.link[new] = q
                else:  # q's longest substring ends at other places than this shorter one
                    twin = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
                    while p >= 0 and self.step[p].get(c) == q:
                        self.step[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new
            self.ends.append(new)

    def _state(self, size: int, step: dict[str, int] | None = None, link: int = 0) -> int:
        self.step.append({} if step is None else step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def walk(self, other: str):
        """For each character of another text: the state and length of its longest ending that stands in this one."""
        state = length = 0
        step, link, size = self.step, self.link, self.size
        for c in other:
            while state and c not in step[state]:
                state = link[state]
                length = size[state]
            if c in step[state]:
                state = step[state][c]
                length += 1
            yield state, length


def matched_lengths(text: str, pool: str) -> list[int]:
    """For each character of the text the length of the longest part ending with it that stands in the pool."""
    if len(pool) <= len(text):
        return [length for _, length in SuffixAutomaton(pool).walk(text)]
    own = SuffixAutomaton(text)
    found = [0] * len(own.size)
    for state, length in own.walk(pool):
        if length > found[state]:
            found[state] = length
    for state in sorted(range(1, len(found)), key=own.size.__getitem__, reverse=True):  # what ends a longer part stands there too
        if found[state]:
            found[own.link[state]] = own.size[own.link[state]]
    whole = [0] * len(found)
    for state in sorted(range(1, len(found)), key=own.size.__getitem__):
        whole[state] = found[state] or whole[own.link[state]]
    return [whole[s] for s in own.ends]


class Pool:
    """A text in which quotes are looked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.bare = self.text.replace(" ", "")

    def holds(self, quote: str) -> bool:
        return quote.strip().replace(" ", "") in self.bare

    def longest(self, text: str | None, limit: int, least: int = 4) -> str:
        """The text, cut at the limit, if it stands here; else the first of its longest parts that do; empty below the least length."""
        text = (text or "").strip()
        if not text or self.holds(text):
            return text[:limit]
        solid = [c != " " for c in text]
        count = [0, *accumulate(solid)]  # characters but blanks before each place
        lengths = matched_lengths(text.replace(" ", ""), self.bare)
        first, k = [0] * len(text), len(text)  # the next character from each place on that is no white space
        for i in range(len(text) - 1, -1, -1):
            k = k if text[i].isspace() else i
            first[i] = k
        start, best, last = 0, (0, 0), -1
        for end in range(1, len(text) + 1):
            if not text[end - 1].isspace():
                last = end - 1
            start = max(start, end - limit)
            # a part of a part that stands here does too, so the window only moves on
            while start < end and first[start] <= last and lengths[count[last + 1] - 1] < count[last + 1] - count[first[start]]:
                start += 1
            if end - start > best[1] - best[0]:
                best = (start, end)
        return text[best[0] : best[1]] if best[1] - best[0] >= least else ""
