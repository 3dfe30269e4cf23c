"""Word edit distances by furthest-reaching diagonals; words are integers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np

from inkstone.llm import _words as W


def reach(a: list, b: list, most: int, after: int = 2) -> list[int]:
    """For 0..most edits, how many words of a from its start are covered by a start of b.

    An edited stretch counts only if at least after equal words follow it.
    """
    out, best, front = [], 0, {}
    for e in range(most + 1):
        now = {}
        for d in range(-e, e + 1):
            came = 0 if e == 0 else max(front.get(d, -2) + 1, front.get(d + 1, -2) + 1, front.get(d - 1, -2))
            if came < 0 or came > len(a) or came + d > len(b) or came + d < 0:
                continue
            i = came
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            now[d] = i
            if i - came >= (after if e else 1):
                best = max(best, i)
        front = now
        out.append(best)
    return out


def common_runs(a: list, b: list, run: int) -> Iterator[tuple[int, int]]:
    """Starts (in a, in b) of the maximal stretches of at least run equal words, diagonal by diagonal; never a table of all pairs."""
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    if min(len(x), len(y)) < run:
        return
    gx, gy = W.grams(x, run), W.grams(y, run)
    order = np.argsort(gy, kind="stable")
    lo, hi = np.searchsorted(gy[order], gx), np.searchsorted(gy[order], gx, "right")
    seen = np.zeros(len(x) + len(y), bool)
    for i in np.flatnonzero(hi > lo):
        seen[order[lo[i] : hi[i]] - i + len(x)] = True
    for d in (np.flatnonzero(seen) - len(x)).tolist():
        at = max(0, -d)
        n = min(len(x) - at, len(y) - at - d)
        equal = np.concatenate([[False], x[at : at + n] == y[at + d : at + d + n], [False]])
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i >= run:
                yield at + i, at + i + d


def holds_passage(query: list, stored: list, places: Iterable[tuple[int, int]], words: int, per: int, longest: int, run: int, after: int = 2) -> bool:
    """Does stored hold n >= words consecutive words of query with at most n // per edits, around one of places?

    places: starts (in query, in stored) of equal runs of at least run words, ascending on each diagonal. longest:
    what the shortest such passage of any length may measure.
    """
    changes = longest // per
    ends: dict[int, int] = {}  # by diagonal, the query position up to which it was tried
    for i, j in places:
        if ends.get(j - i, -1) >= i:
            continue
        r = i
        while r < len(query) and r + j - i < len(stored) and query[r] == stored[r + j - i]:
            r += 1
        ends[j - i] = r - run
        if r - i >= words:
            return True
        s = r + j - i
        right = reach(query[r : r + longest], stored[s : s + longest + changes], changes, after)
        left = reach(query[max(0, i - longest) : i][::-1], stored[max(0, j - longest - changes) : j][::-1], changes, after)
        if any(x + r - i + y >= max(words, per * (d + e)) for d, x in enumerate(left) for e, y in enumerate(right)):
            return True
    return False


def shared_shingles(a: list, b: list, k: int = 5) -> int:
    """Word k-grams of a that b has too, each as often as b has it."""
    x, y = (Counter(zip(*(t[i:] for i in range(k)))) for t in (a, b))
    return sum(min(n, y[g]) for g, n in x.items() if g in y)


def distance(a: list, b: list, most: int) -> int | None:
    """Edits that turn a into b, or None if more than most are needed."""
    goal, front = len(b) - len(a), {0: 0}
    for e in range(most + 1):
        now = {}
        for d in range(-e, e + 1):
            i = 0 if e == 0 else max(front.get(d, -2) + 1, front.get(d + 1, -2) + 1, front.get(d - 1, -2))
            if i < 0 or i + d < 0 or i > len(a) or i + d > len(b):
                continue
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            now[d] = i
        if now.get(goal, -1) >= len(a):
            return e
        front = now
    return None
