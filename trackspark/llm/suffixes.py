"""Suffix arrays of many short texts at once, by grouping suffixes by their Lyndon prefix.

Linear grouping in two phases. The first one groups the suffixes of a text by their first symbol and
processes groups from the highest down: each suffix of a group points to the nearest one before it in a
lower group, and those pointed to leave their group for a new one right above it, further up the more
pointers they get. Then each group holds the suffixes with one Lyndon prefix, in the order of these
prefixes. The second phase reads the suffix array from the lowest suffix on: what ends its Lyndon prefix
at the suffix just read is found along the pointers, and takes the next free place of its group. Nothing
is renamed or sorted by later parts of a text.

Both phases take one step of every text at a time, in numpy: texts are independent of each other.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ..., start + size - 1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix array of each of the texts that stand one after the other in symbols, as places in
    symbols. Each text must end with a symbol that is smaller than all others of it."""
    n, starts = len(symbols), np.cumsum(lengths) - lengths
    if not n:
        return np.zeros(0, np.int64)
    kind = np.int32 if n + len(lengths) < 1 << 31 else np.int64
    text = np.repeat(np.arange(len(lengths), dtype=kind), lengths)
    # every text has a cell before it, lower than all groups, where pointers end
    cell = np.arange(n, dtype=kind) + text + 1
    first = (starts + np.arange(len(lengths))).astype(kind)
    width = int(symbols.max()) + 1
    key = text.astype(np.int64) * width + symbols
    by = np.argsort(key, kind="stable")
    array, sorted_key = cell[by], key[by]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    heads = np.flatnonzero(new)
    sizes = np.zeros(n, kind)  # of the group that starts there
    sizes[heads] = np.diff(np.append(heads, n))
    label = np.full(n + len(lengths), -1, kind)  # where the group of a cell starts
    label[array] = np.repeat(heads, sizes[heads])
    place = np.zeros(n + len(lengths), kind)
    place[array] = np.arange(n)
    before = np.arange(n + len(lengths), dtype=kind) - 1
    before[first] = first
    _group(array, place, label, sizes, before, starts, starts + lengths)
    return _emit(label, before, first, starts, lengths, text)


def _group(array: np.ndarray, place: np.ndarray, label: np.ndarray, sizes: np.ndarray, before: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """The first phase: label becomes the start of the Lyndon group of each cell, before its pointer."""
    moved_now = np.zeros(len(label), bool)
    low, end = starts, ends
    while len(low):
        head = label[array[end - 1]]
        size = end - head
        group = array[ranges(head, size)]
        own, at = np.repeat(head, size), before[group]
        far = np.flatnonzero(label[at] >= own)
        while len(far):  # what lies between a cell and its pointer is in no lower group
            at[far] = before[at[far]]
            before[group[far]] = at[far]
            far = far[label[at[far]] >= own[far]]
        before[group] = at
        at = np.sort(at[label[at] >= 0])
        if len(at):
            run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            times = np.diff(np.append(run, len(at)))
            moved = at[run]
            old = label[moved]
            by = np.lexsort((times, old))
            moved, old, times = moved[by], old[by], times[by]
            change = np.concatenate([[True], old[1:] != old[:-1]])
            run = np.flatnonzero(change)
            count = np.diff(np.append(run, len(old)))
            top = old[run] + sizes[old[run]] - count  # the moved ones take the last places of their group
            slot = ranges(top, count)
            moved_now[moved] = True
            there = array[slot]
            there = there[~moved_now[there]]
            free = place[moved]
            free = free[free < np.repeat(top, count)]
            array[free], place[there] = there, free
            array[slot], place[moved] = moved, slot
            moved_now[moved] = False
            sizes[old[run]] -= count
            part = np.flatnonzero(change | np.concatenate([[True], times[1:] != times[:-1]]))
            count = np.diff(np.append(part, len(moved)))
            sizes[slot[part]] = count
            label[moved] = np.repeat(slot[part], count)
        more = head > low
        low, end = low[more], head[more]


def _emit(label: np.ndarray, before: np.ndarray, first: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The second phase: the order of each group, lowest suffix first."""
    array, free = np.zeros(len(text), label.dtype), np.arange(len(text), dtype=label.dtype)
    by = np.argsort(-lengths, kind="stable")
    starts, lengths, first = starts[by], lengths[by], first[by]
    array[starts] = first + lengths  # the last symbol is the lowest suffix
    free[starts] = starts + 1
    active = len(starts)
    for step in range(int(lengths[0])):
        while lengths[active - 1] <= step:
            active -= 1
        suffix = array[starts[:active] + step]
        cell, stop = suffix - 1, before[suffix]
        some = np.flatnonzero(cell > stop)
        cell, stop = cell[some], stop[some]
        while len(cell):
            at = label[cell]
            slot = free[at]
            array[slot] = cell
            free[at] = slot + 1
            cell = before[cell]
            more = cell > stop
            cell, stop = cell[more], stop[more]
    return array - text - 1
