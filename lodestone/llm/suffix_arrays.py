"""Suffix arrays by Lyndon grouping, of many texts at once.

The suffixes of a text are first grouped by their first byte, and the groups are taken from the highest down. When a group is taken, each of
its suffixes finds the nearest suffix before it in the text that lies in a lower group; the pointer is kept, and later searches
jump along it. A suffix that is found so begins with what its group stands for, followed by what the taken group stands for, once for each suffix that found it;
those move to new groups right above their old one, higher the more often. When all groups are taken, a group holds the suffixes with one
longest Lyndon prefix. A second pass goes through the suffixes in their final order: the suffix before each, and what its pointers lead
to, come next in their own groups. No text is renamed and sorted again, and both passes are linear.

Steps of one text depend on each other, so texts go side by side: a step takes the highest group of every text, in numpy.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of each text in ascending order. x: the texts one after the other, as whole numbers; ends: where each ends. Every text ends in a
    symbol that is lower than all its others. What comes back has each text's positions, in x, at the text's own place."""
    n, ends = len(x), np.asarray(ends, np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    at = np.argsort((np.repeat(np.arange(len(ends)), ends - begins) << 20) | x.astype(np.int64), kind="stable")
    group, previous, before, size = _groups(x, at, begins, ends)
    return _placed(group, previous, before, size, at[begins], begins, ends, n)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    return np.repeat(starts - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)


def _groups(x: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each position its final group (the group's first place), the pointer to the nearest lower one before it (n: none), the position
    before it, and the groups' sizes."""
    n = len(x)
    text = np.repeat(np.arange(len(ends)), ends - begins)
    new = np.concatenate(([True], (x[at[1:]] != x[at[:-1]]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    group = np.full(n + 1, -1, np.int64)
    group[at] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    before = np.arange(-1, n - 1)
    before[begins] = n
    previous = np.full(n + 1, n, np.int64)
    target, moving = np.zeros(n, bool), np.zeros(n, bool)
    low, top = begins.copy(), ends.copy()
    while True:
        open_ = top > low + 1
        if not open_.all():
            low, top = low[open_], top[open_]
        if not len(low):
            return group, previous, before, size
        own = group[at[top - 1]]
        lengths = top - own
        top = own
        if len(lengths) == lengths.sum():
            members, level = at[own], own
        else:
            members, level = at[_ranges(own, lengths)], np.repeat(own, lengths)
        # the nearest position before that is in this group or a lower one, then past those in this group
        found = before[members]
        higher = np.flatnonzero(group[found] > level)
        while len(higher):
            step = previous[found[higher]]
            found[higher] = step
            higher = higher[group[step] > level[higher]]
        previous[members] = found
        equal = np.flatnonzero(group[found] == level)
        while len(equal):
            step = previous[found[equal]]
            found[equal] = step
            previous[members[equal]] = step
            equal = equal[group[step] == level[equal]]
        moved = found[found < n]
        if not len(moved):
            continue
        moved.sort()
        edge = np.flatnonzero(np.concatenate(([True], moved[1:] != moved[:-1])))
        times = np.diff(np.append(edge, len(moved)))
        moved = moved[edge]
        home = group[moved]
        order = np.argsort((home << 24) | times) if times.max() < 1 << 24 else np.lexsort((times, home))
        moved, home, times = moved[order], home[order], times[order]
        edge = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
        count = np.diff(np.append(edge, len(home)))
        homes = home[edge]
        goal = _ranges(homes + size[homes] - count, count)
        target[goal], moving[moved] = True, True
        was = place[moved]
        empty, there = was[~target[was]], at[goal]
        pushed = there[~moving[there]]
        target[goal], moving[moved] = False, False
        at[empty], place[pushed] = pushed, empty
        at[goal], place[moved] = moved, goal
        size[homes] -= count
        split = np.concatenate(([True], (home[1:] != home[:-1]) | (times[1:] != times[:-1])))
        edge = np.flatnonzero(split)
        count = np.diff(np.append(edge, len(home)))
        group[moved] = np.repeat(goal[edge], count)
        size[goal[edge]] = count


def _placed(group: np.ndarray, previous: np.ndarray, before: np.ndarray, size: np.ndarray, lowest: np.ndarray, begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The final order: each group's suffixes as their turn comes."""
    out = np.empty(n, np.int64)
    out[begins] = lowest
    done = np.zeros(n + 1, bool)
    done[lowest] = done[n] = True
    room = np.arange(n)
    rank, stop = begins.copy(), ends
    current = before[lowest]
    while len(rank):
        go = np.flatnonzero(~done[current])
        here = current[go]
        own = group[here]
        slot = room[own]
        out[slot] = here
        room[own] = slot + 1
        done[here] = True
        current[go] = previous[here]
        idle = np.flatnonzero(done[current])
        rank[idle] += 1
        if len(idle) and (over := rank[idle] >= stop[idle]).any():
            keep = np.ones(len(rank), bool)
            keep[idle[over]] = False
            rank, stop, current = rank[keep], stop[keep], current[keep]
            idle = np.flatnonzero(done[current])
            # those that were idle and stay have had their step already
        if len(idle):
            current[idle] = before[out[rank[idle]]]
    return out
