"""Short sections joined to a neighbour of their branch: a heap of pairs over a linked list.

The pair with the least neighbour goes first, ties by position. A join changes one section's size and at most the openness of
its branch, so only the pairs beside it, and those of a branch that has lost its last child, are weighed again.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import replace
from heapq import heappop, heappush

from .packing import tokens


class Merger:
    def __init__(self, sections: list, least: int, most: int) -> None:
        self.s, self.least, self.most = sections, least, most
        n = len(sections)
        self.size = [s.tokens() for s in sections]
        self.before, self.after = list(range(-1, n - 1)), [*range(1, n), -1] if n else []
        self.version = [0] * n
        self.children: Counter = Counter(p for s in sections for p in self.prefixes(s.path))
        self.at: dict[tuple, set[int]] = defaultdict(set)
        for i, s in enumerate(sections):
            self.at[tuple(s.path)].add(i)
        self.heap: list[tuple] = []

    @staticmethod
    def prefixes(path: list[str]) -> list[tuple]:
        return [tuple(path[:d]) for d in range(1, len(path))]

    def leaf(self, i: int) -> bool:
        return not self.children[tuple(self.s[i].path)]

    def fits(self, i: int, j: int) -> bool:
        """Whether short section i may join its neighbour j."""
        if self.s[i].fixed or self.s[j].fixed or self.size[i] >= self.least or not self.leaf(i):
            return False
        lo, hi = min(i, j), max(i, j)
        a, b = self.s[lo], self.s[hi]
        siblings = a.parent == b.parent
        if not (siblings or a.parent == b.path or b.parent == a.path) or not self.leaf(hi):
            return False
        path = [*a.parent, " ".join(a.joined_index(b)).strip()] if siblings else a.path
        return self.size[i] + self.size[j] <= self.most - tokens(" > ".join(path))

    def weigh(self, i: int) -> None:
        """Puts the pairs of i and each neighbour into the heap, in both directions."""
        for j in (self.before[i], self.after[i]):
            for x, y in ((i, j), (j, i)) if j >= 0 else ():
                if self.fits(x, y):
                    heappush(self.heap, (self.size[y], x, y, self.version[x], self.version[y]))

    def join(self, lo: int, hi: int) -> None:
        a, b = self.s[lo], self.s[hi]
        self.at[tuple(b.path)].discard(hi)
        self.at[tuple(a.path)].discard(lo)
        a.absorb(b)
        self.at[tuple(a.path)].add(lo)
        self.size[lo] += self.size[hi]
        self.after[lo] = self.after[hi]
        if self.after[hi] >= 0:
            self.before[self.after[hi]] = lo
        self.version[lo] += 1
        self.version[hi] = -1
        emptied = []
        for p in self.prefixes(b.path):
            self.children[p] -= 1
            if not self.children[p]:
                emptied.append(p)
        for i in {lo, *(i for p in emptied for i in self.at[p])}:
            self.weigh(i)

    def run(self) -> list:
        for i in range(len(self.s)):
            self.weigh(i)
        while self.heap:
            _, i, j, vi, vj = heappop(self.heap)
            if (self.version[i], self.version[j]) == (vi, vj) and j in (self.before[i], self.after[i]) and self.fits(i, j):
                self.join(min(i, j), max(i, j))
        return [s for s, v in zip(self.s, self.version, strict=True) if v >= 0]


def merge_short(sections: list, least: int, most: int) -> list:
    """The sections after joining leaves of fewer than `least` tokens to a neighbour on their branch, none above `most`."""
    return Merger([replace(s, blocks=list(s.blocks)) for s in sections], least, most).run() if least > 0 else sections
