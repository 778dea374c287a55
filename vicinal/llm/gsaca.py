"""Suffix arrays by linear grouping, for many small texts in step.

The construction has two phases. Phase 1 sorts suffixes into groups by first character and takes the
groups from the highest down. For each suffix of the group at hand it finds the previous suffix that
lies in a lower group (by following earlier such pointers), and the suffixes pointed to move behind
the rest of their own group, those that are pointed to more often further back. In the end suffixes
with equal Lyndon prefixes share a group, and groups are in order. Phase 2 fills the suffix array from
the front: the suffix before each one placed takes the next place of its group, then the suffix its
pointer names, and so on until one is already placed. No suffix is compared and nothing is renamed.

All texts of a call go through the same steps at the same time, so each step is a few array
operations; the work is linear in the length of the texts, the number of steps in that of the longest.
Wherever an order is needed (symbols, groups, counts), it is made by counting passes over 16-bit digits;
distinct suffixes are found by marks. Nothing is sorted by comparison.
"""

from __future__ import annotations

import numpy as np

from .common import run_starts, spread


def suffix_arrays(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts ``text[first[i]:first[i + 1]]``, each ended by its only, smallest symbol.

    Returns positions in ``text``, the texts' arrays one after another.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    lane = np.repeat(np.arange(len(first) - 1), np.diff(first))
    group, pointer = _groups(text.astype(np.int64), lane, first.astype(np.int64))
    return _emit(group, pointer, lane, first.astype(np.int64))


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by columns of non-negative numbers, the first the most significant.

    numpy's stable sort of 16-bit numbers is a radix sort, so this is linear in the rows for each digit.
    """
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        shift, top = 0, int(key.max()) if len(key) else 0
        while not shift or top >> shift:
            order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
            shift += 16
    return order


def _groups(text: np.ndarray, lane: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each suffix's group in the order of groups, pointer to the previous suffix in a lower group or -1)."""
    n = len(text)
    order = _order(lane, text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    starts = run_starts(lane[order], text[order])
    lengths = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, lengths)
    size = np.zeros(n, np.int64)
    size[starts] = lengths
    pointer = np.full(n, -1, np.int64)
    begin = first[:-1]
    is_first = np.zeros(n, bool)
    is_first[begin] = True
    moving = np.zeros(n, bool)
    mark, times_of = np.empty(n, np.int64), np.zeros(n, np.int64)
    active = np.flatnonzero(np.diff(first) > 0)
    high = first[1:].copy()
    while len(active):
        top = high[active]
        low = group[order[top - 1]]
        members = order[spread(low, top - low)]
        own = np.repeat(low, top - low)
        pointer[members] = np.where(is_first[members], -1, members - 1)
        todo, at_least = members, own
        while len(todo):
            to = pointer[todo]
            up = to >= 0
            up[up] = group[to[up]] >= at_least[up]
            todo, at_least, to = todo[up], at_least[up], to[up]
            pointer[todo] = pointer[to]
        to = pointer[members]
        to = to[to >= 0]
        if len(to):
            # distinct targets, and how often each is pointed to
            mark[to] = np.arange(len(to))
            named = to[mark[to] == np.arange(len(to))]
            np.add.at(times_of, to, 1)
            times = times_of[named]
            times_of[named] = 0
            g = group[named]
            by = _order(g, times)
            named, times, g = named[by], times[by], g[by]
            g_at = run_starts(g)
            m = np.diff(np.append(g_at, len(g)))
            tail = np.repeat(g[g_at] + size[g[g_at]] - m - g_at, m) + np.arange(len(g))
            # those that stand in the tail but stay change places with those that come from further ahead
            moving[named] = True
            there = order[tail]
            stay = there[~moving[there]]
            left = place[named]
            left = left[left < np.repeat(g[g_at] + size[g[g_at]] - m, m)]
            moving[named] = False
            order[left] = stay
            place[stay] = left
            order[tail] = named
            place[named] = tail
            size[g[g_at]] -= m
            new = run_starts(g, times)
            length = np.diff(np.append(new, len(g)))
            size[tail[new]] = length
            group[named] = np.repeat(tail[new], length)
        high[active] = low
        active = active[low > begin[active]]
    return group, pointer


def _emit(group: np.ndarray, pointer: np.ndarray, lane: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(group)
    out = np.full(n, -1, np.int64)
    used = np.zeros(n, np.int64)
    placed = np.zeros(n, bool)
    live = np.flatnonzero(np.diff(first) > 0)
    begin, end = first[live], first[live + 1]
    out[begin] = end - 1  # the last symbol is the smallest
    placed[end - 1] = True
    at = begin.copy()
    s = out[at] - 1
    while len(at):
        stop = (s < begin) | placed[s]
        go = ~stop
        here = s[go]
        g = group[here]
        out[g + used[g]] = here
        used[g] += 1
        placed[here] = True
        s[go] = pointer[here]
        s[go] = np.where(s[go] < 0, begin[go] - 1, s[go])
        at[stop] += 1
        done = at >= end
        if done.any():
            at, begin, end, s, stop = at[~done], begin[~done], end[~done], s[~done], stop[~done]
        s[stop] = out[at[stop]] - 1
    return out
