"""Merging adjacent pairs of symbols, lowest rank first and leftmost of equals.

``rank`` has the rank of a pair under ``left << SHIFT | right``, and ``made`` the symbol that its
merge makes.
"""

from __future__ import annotations

import heapq

SHIFT = 24
NONE = 1 << 29  # above any rank


def merge_short(symbols: list[int], rank: dict[int, int], made: dict[int, int]) -> list[int]:
    """Scans for the lowest rank before each merge; for a few symbols."""
    ranks = [rank.get(a << SHIFT | b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == NONE:
            break
        i = ranks.index(least)
        symbols[i] = made[symbols[i] << SHIFT | symbols[i + 1]]
        del symbols[i + 1], ranks[i]
        if i:
            ranks[i - 1] = rank.get(symbols[i - 1] << SHIFT | symbols[i], NONE)
        if i < len(ranks):
            ranks[i] = rank.get(symbols[i] << SHIFT | symbols[i + 1], NONE)
    return symbols


def heap_merges(symbols: list[int], rank: dict[int, int], made: dict[int, int]) -> int:
    """Merges in place by heap and linked list; returns the number of merges.

    A merged-away symbol is -1.  A heap entry is ``rank << 32 | place``; it is stale if the
    pair that starts at its place has another rank by now.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = [rank.get(a << SHIFT | b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    ranks.append(NONE)
    heap = [r << 32 | i for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)
    pop, push, merges = heapq.heappop, heapq.heappush, 0
    while heap:
        top = pop(heap)
        i, r = top & 0xFFFFFFFF, top >> 32
        if ranks[i] != r:
            continue
        j = after[i]
        k = after[j]
        symbols[i], symbols[j], ranks[j] = made[symbols[i] << SHIFT | symbols[j]], -1, NONE
        after[i] = k
        merges += 1
        if k < n:
            before[k] = i
            ranks[i] = s = rank.get(symbols[i] << SHIFT | symbols[k], NONE)
            if s != NONE:
                push(heap, s << 32 | i)
        else:
            ranks[i] = NONE
        h = before[i]
        if h >= 0:
            ranks[h] = s = rank.get(symbols[h] << SHIFT | symbols[i], NONE)
            if s != NONE:
                push(heap, s << 32 | h)
    return merges


def merge_long(symbols: list[int], rank: dict[int, int], made: dict[int, int]) -> list[int]:
    heap_merges(symbols, rank, made)
    return [s for s in symbols if s >= 0]
