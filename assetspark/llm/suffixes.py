"""Suffix sorting by linear grouping.

Suffixes lie in groups in the order of a common prefix, at first their leading
symbol.  Groups are processed from the highest down.  The suffix just before
those of a group (its previous smaller one, found by where contexts end) has its
own context prolonged by the group's, as often as that repeats, and moves to a
new group right above its old one.  In the end a suffix's context is its longest
Lyndon prefix and ends at its next smaller suffix, so emitting suffixes in
order, each one placing those whose context ends at it at the next free place of
their group, gives the suffix array.  Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes | np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of small non-negative integers."""
    symbols = np.frombuffer(text, np.uint8) if isinstance(text, (bytes, bytearray)) else np.asarray(text)
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    first = np.searchsorted(symbols[order], symbols, "left")
    sa = order.tolist()
    group = first.tolist()  # where a suffix's group starts
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = place.tolist()  # where a suffix stands
    size = [0] * n  # of the group that starts here
    for start, count in zip(*np.unique(first, return_counts=True), strict=True):
        size[start] = int(count)
    length = [1] * n  # of a suffix's context
    before = list(range(-1, n))  # the suffix whose context ends here
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        long = length[sa[start]]
        if end - start == 1:  # most groups: one suffix, which cannot repeat
            j = before[sa[start]]
            if j >= 0:
                before[sa[start] + long] = j
                length[j] += long
                old = group[j]
                last = old + size[old] - 1
                if last > old:  # leaves its group for a new one above it
                    other, here = sa[last], at[j]
                    sa[here], at[other] = other, here
                    sa[last], at[j] = j, last
                    size[old] -= 1
                    group[j] = last
                    size[last] = 1
            end = start
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for k in range(start, end):
            i = sa[k]
            j = before[i]
            if j < 0 or group[j] == start:  # the latter is reached from the run's first suffix
                continue
            times, stop = 1, i + long
            while stop < n and group[stop] == start:
                times += 1
                stop += long
            before[stop] = j
            length[j] += times * long
            moves.setdefault((group[j], times), []).append(j)
        for i in (sa[start:end] if any(before[x] < 0 for x in sa[start:end]) else ()):
            if before[i] < 0:  # a run at the very start of the text has nothing before it
                stop = i + long
                while stop < n and group[stop] == start:
                    stop += long
                before[stop] = -1
        for (old, _), some in sorted(moves.items(), key=lambda x: -x[0][1]):
            last = old + size[old]
            for j in some:
                last -= 1
                other, here = sa[last], at[j]
                sa[here], at[other] = other, here
                sa[last], at[j] = j, last
            if last > old:
                size[old] -= len(some)
                size[last] = len(some)
                for j in some:
                    group[j] = last
        end = start
    # emit: children of a suffix are those whose context ends at it
    head, sibling = [-1] * (n + 1), [-1] * n
    for i in range(n):
        stop = i + length[i]
        sibling[i] = head[stop]
        head[stop] = i
    free = list(range(n))
    out = [0] * n
    i = head[n]
    while i >= 0:
        g = group[i]
        out[free[g]] = i
        free[g] += 1
        i = sibling[i]
    for k in range(n):
        i = head[out[k]]
        while i >= 0:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = sibling[i]
    return np.array(out, np.int64)
