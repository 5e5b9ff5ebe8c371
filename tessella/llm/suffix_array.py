"""Linear grouping suffix array construction, and the repeated windows of short strings that it finds.

Phase 1 sorts suffixes into groups of equal Lyndon prefix. Groups start as those of the first symbol and are processed
in descending order; each suffix of a group points to the nearest earlier suffix of a smaller group, and the suffixes
that are pointed to leave their groups for new ones just above, those pointed to more often higher. Phase 2 walks the
array from the left and puts the suffix before each one, and those along its pointers, next in their groups. No symbols
are renamed and nothing recurses.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of non-negative symbols; the end counts as smaller than any of them."""
    n = len(text)
    if not n:
        return []
    first = np.asarray(text)
    array = np.argsort(first, kind="stable")
    ordered = first[array]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, n])
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    group = np.empty(n, np.int64)
    group[array] = np.repeat(starts, sizes)
    size = np.zeros(n, np.int64)
    size[starts] = sizes
    # group[-1] is the place before the text: smaller than every group, it ends each walk to the left.
    array, place, group, size = array.tolist(), place.tolist(), [*group.tolist(), -1], size.tolist()
    pointer = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[array[end]]
        if start == end:
            i = array[end]
            j = i - 1
            while group[j] >= start:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                old = group[j]
                left = size[old]
                if left > 1:
                    at, last = place[j], old + left - 1
                    other = array[last]
                    array[at], array[last] = other, j
                    place[other], place[j] = at, last
                    size[old], size[last], group[j] = left - 1, 1, last
        else:
            times: dict[int, int] = {}
            for i in sorted(array[start : end + 1]):
                j = i - 1
                while group[j] >= start:
                    j = pointer[j]
                pointer[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j, n_times in times.items():
                moved.setdefault((n_times, group[j]), []).append(j)
            for n_times, old in sorted(moved, reverse=True):
                own = moved[n_times, old]
                left = size[old]
                if len(own) == left:
                    continue  # the whole group moves: its place stays
                last = old + left
                for j in own:
                    last -= 1
                    at, other = place[j], array[last]
                    array[at], array[last] = other, j
                    place[other], place[j] = at, last
                for j in own:
                    group[j] = last
                size[old], size[last] = left - len(own), len(own)
        end = start - 1
    out, following, placed = [-1] * n, list(range(n)), bytearray(n)
    for k in range(-1, n):
        j = (out[k] if k >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            own = group[j]
            out[following[own]] = j
            following[own] += 1
            placed[j] = 1
            j = pointer[j]
    return out


def repeated_windows(rows: list[tuple[bytes, bytes, bytes, int]], around: int) -> np.ndarray:
    """For each row (core, left, right, n) a bit mask of the windows that another row, or its own copies, hold too.

    A row stands ``n`` times for the string left + core + right, where rows of one family have the same core, written as
    one symbol of its own, and left and right have at most ``around`` bytes. Window ``a`` is the last ``a`` bytes of left,
    the core and the first ``around - a`` bytes of right: ``around + 1`` symbols that start at one place of the string.
    A row with ``n`` over 1 is written twice. The only row of a family is one symbol altogether; if that repeats, all its
    windows do, and -1 stands for a row without windows.
    """
    width, sizes = around + 1, Counter(r[0] for r in rows)
    symbols_of = {core: 257 + k for k, core in enumerate(sizes)}
    text, where, row_of, bit_of = [], [], [], []
    for k, (core, left, right, n) in enumerate(rows):
        windows = range(max(0, around - len(right)), len(left) + 1)
        for _ in range(min(n, 2)):
            at = len(text)
            if sizes[core] == 1:
                text += [symbols_of[core], 0]
                where.append(at)
                row_of.append(k)
                bit_of.append(-1)
                continue
            text += [b + 1 for b in left]
            text.append(symbols_of[core])
            text += [b + 1 for b in right]
            text.append(0)
            for a in windows:
                where.append(at + len(left) - a)
                row_of.append(k)
                bit_of.append(a)
    masks = np.zeros(len(rows), np.int64)
    if not where:
        return masks
    starts = np.full(len(text), -1)
    starts[where] = np.arange(len(where))
    order = starts[np.array(suffix_array(text))]
    order = order[order >= 0]
    symbols = np.array(text + [0] * width, np.int32)
    row_of, bit_of, places = np.array(row_of)[order], np.array(bit_of)[order], np.array(where)[order]
    same = symbols[places[1:]] == symbols[places[:-1]]
    for step in range(1, width):
        same &= (symbols[places[1:] + step] == symbols[places[:-1] + step]) | (bit_of[1:] < 0)
    twice = np.r_[same, False] | np.r_[False, same]
    one = twice & (bit_of < 0)
    for k in np.unique(row_of[one]).tolist():
        _, left, right, _ = rows[k]
        low, high = max(0, around - len(right)), len(left) + 1
        masks[k] = (1 << high) - (1 << low) if low < high else -1
    several = twice & (bit_of >= 0)
    np.bitwise_or.at(masks, row_of[several], np.int64(1) << bit_of[several].astype(np.int64))
    return masks
