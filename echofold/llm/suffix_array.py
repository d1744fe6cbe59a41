"""Suffix sorting by linear grouping.

Suffixes start in one group per first symbol.  Groups are taken in descending order.  The group at hand holds the suffixes
that begin with one Lyndon word, its context; each of them has a previous-smaller pointer, to the nearest suffix on its left in
a lower group.  A suffix that is pointed at by c members extends its own context by the group's, c times over, and moves to
the upper end of its group, behind those with fewer.  When every group has been taken, each suffix stands in the group of its
longest Lyndon prefix, and the order within the groups follows without renaming or recursion: going up the finished
order, the suffix on the left of each and its chain of previous-smaller pointers are next in their groups.

Nothing is sorted by comparison: first symbols and counts go by buckets, and every group knows its end.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of text (symbols below 2 ** 16), whose last symbol must be smaller than all others."""
    n = len(text)
    if n == 1:
        return [0]
    place = np.argsort(np.asarray(text, np.uint16), kind="stable").tolist()  # a radix sort: suffixes in groups by first symbol
    rank = [0] * n  # where a suffix stands in place
    group = [0] * n  # where its group begins
    ends = [n] * n  # where the group that begins here ends
    begin = 0
    for i, s in enumerate(place):
        if text[s] != text[place[begin]]:
            ends[begin] = i
            begin = i
        rank[s] = i
        group[s] = begin
    before = [-1] * n
    end = n
    while end:
        low = group[place[end - 1]]
        members = place[low:end]
        point_left(members, low, group, before)
        pointed: dict[int, int] = {}
        for s in members:
            if (p := before[s]) >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_group: dict[int, list[int]] = {}
        for p in pointed:
            by_group.setdefault(group[p], []).append(p)
        for home, parents in by_group.items():
            # Parents go to the end of their group, more often pointed at ones last.
            stop = ends[home]
            by_count: list[list[int]] = [[] for _ in range(max(pointed[p] for p in parents) + 1)]
            for p in parents:
                by_count[pointed[p]].append(p)
            if stop - home == len(parents) == len(by_count[-1]):
                continue
            at = stop - len(parents)
            stay = [s for s in place[at:stop] if s not in pointed]
            gaps = [rank[p] for p in parents if rank[p] < at]
            for s, r in zip(stay, gaps, strict=True):
                place[r], rank[s] = s, r
            ends[home] = at
            for same in by_count:
                new = at
                for p in same:
                    place[at], rank[p], group[p] = p, at, new
                    at += 1
                if same:
                    ends[new] = at
        end = low
    # Every suffix now stands in its final group; emit each group's order.
    front = list(range(n))
    out = [-1] * n
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            done[s] = True
            s = before[s]
    return out


def point_left(members: list[int], low: int, group: list[int], before: list[int]) -> None:
    """Previous-smaller pointers of a group's members, in any order: first to the nearest of this group or a lower one, then past this group."""
    for s in members:
        p = s - 1
        while p >= 0 and group[p] > low:
            p = before[p]
        before[s] = p
    for s in members:
        p, chain = before[s], [s]
        while p >= 0 and group[p] == low:
            chain.append(p)
            p = before[p]
        for c in chain:
            before[c] = p
