"""Which two tokens may stand side by side in an encoding by ranked merges.

Ranked merges happen in the order of their ranks, and what a merge makes only takes part in merges of higher rank. So while
two neighbouring tokens are built, the sign left of their border runs through the right spine of the first and the sign
right of it through the left spine of the second, each step at its rank. The two stay apart unless, at some time, the
pair at the border has a rank that comes before the next step on either side (among equal ranks the left one goes first).
"""

from __future__ import annotations

from collections.abc import Callable

NEVER = 1 << 60


def merged(symbols, rank) -> list:
    """The encoding of symbols by ranked merges, lowest rank first, leftmost among equals."""
    s = list(symbols)
    while len(s) > 1:
        best, at = None, -1
        for i in range(len(s) - 1):
            r = rank(s[i], s[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return s
        s[at : at + 2] = [s[at] + s[at + 1]]
    return s


class Neighbours:
    """rank(a, b): the rank of that merge or None. parts(t): the two tokens that t is merged of, or None for a base sign."""

    def __init__(self, rank: Callable, parts: Callable, bound: int = 1_000_000):
        self.rank, self.parts, self.bound = rank, parts, bound
        self.known: dict = {}
        self.right: dict = {}
        self.left: dict = {}

    def spine(self, t, side: int) -> list:
        """[(token, rank of the next step)] from the base sign at that end up to t."""
        kept = self.right if side else self.left
        got = kept.get(t)
        if got is None:
            out, above = [], NEVER
            while True:
                out.append((t, above))
                two = self.parts(t)
                if two is None:
                    break
                above, t = self.rank(*two), two[side]
            got = kept[out[0][0]] = out[::-1]
        return got

    def apart(self, a, b) -> bool:
        key = (a, b)
        v = self.known.get(key)
        if v is None:
            if len(self.known) > self.bound:
                self.known.clear()
            v = self.known[key] = self._apart(a, b)
        return v

    def _apart(self, a, b) -> bool:
        ra, lb = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        rank = self.rank
        while True:
            x, nx = ra[i]
            y, ny = lb[j]
            q = rank(x, y)
            if q is not None and q < nx and q <= ny:
                return False
            if nx is NEVER and ny is NEVER:
                return True
            if nx <= ny:
                i += 1
            else:
                j += 1
