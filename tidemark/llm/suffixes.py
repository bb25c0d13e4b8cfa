"""Suffix sorting by grouping on Lyndon prefixes.

Suffixes start out grouped by their first symbol. The groups are processed in descending order. A suffix of the group at
hand extends the context of the nearest suffix before it that stands in a lower group (its previous-smaller pointer);
those move up within their own groups, the further the more suffixes of the group at hand they lead to. In the end
a group holds the suffixes with one Lyndon prefix. One ascending pass then emits the order: a sorted suffix places the
suffixes whose Lyndon prefix ends where it starts, found along the pointers. Nothing is renamed and solved again.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def _grouped(text: np.ndarray) -> tuple[list[int], list[int]]:
    """The final group of each suffix (the group's first place in the order) and its previous-smaller pointer, -1 for none."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    opens = np.ones(n, bool)
    opens[1:] = sorted_text[1:] != sorted_text[:-1]
    starts = np.flatnonzero(opens)
    sizes = dict(zip(starts.tolist(), np.diff(np.append(starts, n)).tolist(), strict=True))
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(starts, list(sizes.values()))
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    at, group, place, before = order.tolist(), group_of.tolist(), place_of.tolist(), [-1] * n
    end = n
    while end:
        g = group[at[end - 1]]
        led: Counter = Counter()
        members = at[g:end]
        if len(members) > 1:
            members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[s] = p
            if p >= 0:
                led[p] += 1
        end = g
        # Per lower group: those that lead to more suffixes of this group go to higher places.
        if len(led) == 1:
            moves = led.items()
        else:
            moves = sorted(led.items(), key=lambda x: (group[x[0]], -x[1]))
        last_group, last_count, top, new = -1, 0, 0, 0
        for p, count in moves:
            h = group[p]
            if h != last_group or count != last_count:
                if last_group >= 0:
                    _close(at, group, sizes, last_group, new, top)
                if h != last_group:
                    top = h + sizes[h]
                else:
                    top = new
                last_group, last_count, new = h, count, top
            new -= 1
            q = at[new]
            i = place[p]
            at[new], at[i] = p, q
            place[p], place[q] = new, i
        if last_group >= 0:
            _close(at, group, sizes, last_group, new, top)
    return group, before


def _close(at: list[int], group: list[int], sizes: dict[int, int], old: int, new: int, top: int) -> None:
    """The places from new to top become a group of their own."""
    if new != old:
        sizes[old] = new - old
        sizes[new] = top - new
        for i in range(new, top):
            group[at[i]] = new
    else:
        sizes[old] = top - old


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of symbols (whole numbers, 0 or more) in ascending order."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    group, before = _grouped(text)
    n = len(text)
    free = list(range(n))  # of each group, the next place
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    free[0] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return np.array(out[1:], np.int64)
