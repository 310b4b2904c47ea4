"""Suffix arrays by induced sorting on whole arrays.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost
smaller ones are sorted by their substrings, recursively until all names differ; and all
others are induced from them bucket by bucket.  Buckets of neighbouring symbols with few
suffixes are handled together: rounds repeat until no suffix of the group induces
another one in it.  A symbol with many suffixes has a group of its own, whose rounds
touch only what the round before induced, so a long run of one symbol costs its length.
"""

from __future__ import annotations

import numpy as np

#: Suffixes that neighbouring buckets hold together, at most, and the most groups there are of a text.
GROUP, GROUPS = 1024, 256


def _smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is the sentinel."""
    starts = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1)
    heads = text[starts]
    rising = np.append(heads[:-1] < heads[1:], True)
    return np.repeat(rising, np.diff(np.append(starts, len(text))))


def _grouped(text: np.ndarray, size: int) -> np.ndarray:
    """Group of every symbol: ascending numbers from 0 on."""
    counts = np.bincount(text, minlength=size)
    most = max(GROUP, len(text) // GROUPS)
    alone = counts > most // 2
    # a new group where the running count passes another multiple, and around symbols that stand alone
    rest = np.cumsum(np.where(alone, 0, counts)) // most
    steps = np.append(False, (rest[1:] != rest[:-1]) | alone[1:] | alone[:-1])
    return np.cumsum(steps, dtype=np.int32)


def _dealt(queues: list[list[np.ndarray]], places: np.ndarray, groups: np.ndarray) -> None:
    """Append the places to the queues of their groups, in order."""
    if not len(places):
        return
    order = np.argsort(groups.astype(np.uint16) if len(queues) <= 1 << 16 else groups, kind="stable")
    places, groups = places[order], groups[order]
    cuts = np.append(0, np.flatnonzero(groups[1:] != groups[:-1]) + 1)
    for g, a, b in zip(groups[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(groups)).tolist()):
        queues[g].append(places[a:b])


def _order(symbols: np.ndarray, low: int, high: int, down: bool) -> np.ndarray:
    """Stable order of symbols from ``low`` to ``high``."""
    keys = high - symbols if down else symbols - low
    return np.argsort(keys.astype(np.uint16) if high - low < 1 << 16 else keys, kind="stable")


def _pass(text: np.ndarray, group: np.ndarray, kind: np.ndarray, seeds: list[list[np.ndarray]], bounds: list[tuple[int, int]], down: bool) -> list[list[np.ndarray]]:
    """Suffixes of one ``kind`` induced group by group, each group's in scan order.

    ``group`` has the group of each place and ``bounds`` the symbols of each group; a
    scan ``down`` goes from the last symbol to the first, and its lists are reversed.
    """
    empty = np.zeros(0, np.int32)
    found: list[list[np.ndarray]] = [[] for _ in seeds]
    for g in range(len(seeds) - 1, -1, -1) if down else range(len(seeds)):
        low, high = bounds[g]
        seeded = np.concatenate([empty, *seeds[g]])
        outer = np.concatenate([empty, *found[g]])
        if low == high:
            now, done = outer, []
            while len(now):
                done.append(now)
                ahead = now[now > 0] - 1
                ahead = ahead[kind[ahead]]
                groups = group[ahead]
                same = groups == g
                _dealt(found, ahead[~same], groups[~same])
                now = ahead[same]
            found[g] = done
            ahead = seeded[seeded > 0] - 1
            ahead = ahead[kind[ahead]]
            _dealt(found, ahead, group[ahead])
            continue
        inner = empty
        while True:
            every = np.concatenate((outer, inner, seeded))
            order = _order(text[every], low, high, down)
            scan = every[order]
            ahead = scan[scan > 0] - 1
            ahead = ahead[kind[ahead]]
            groups = group[ahead]
            same = groups == g
            new = ahead[same]
            if len(new) == len(inner):
                break
            inner = new
        found[g] = [scan[order < len(outer) + len(inner)]]
        _dealt(found, ahead[~same], groups[~same])
    return found


def _induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Suffix array induced from ``seeds``, leftmost smaller suffixes in order within each bucket."""
    empty = np.zeros(0, np.int32)
    of_symbol = _grouped(text, size)
    firsts = np.append(0, np.flatnonzero(np.diff(of_symbol)) + 1)
    bounds = list(zip(firsts.tolist(), (np.append(firsts[1:], size) - 1).tolist()))
    group = of_symbol[text]
    seeded: list[list[np.ndarray]] = [[] for _ in bounds]
    _dealt(seeded, seeds, group[seeds])
    larger = _pass(text, group, ~smaller, seeded, bounds, False)
    back = [[np.concatenate([empty, *x])[::-1]] for x in larger]
    less = _pass(text, group, smaller, back, bounds, True)
    out = []
    for (low, high), a, b in zip(bounds, larger, less):
        both = np.concatenate((empty, *a, np.concatenate([empty, *b])[::-1]))
        out.append(both if low == high else both[_order(text[both], low, high, False)])
    found = np.concatenate(out)
    return found if len(found) == len(text) else np.append(np.int32(len(text) - 1), found)  # nothing induces the sentinel


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of ``text`` in order; symbols are below ``size`` and the last is 0, alone."""
    text = text.astype(np.int32)
    smaller = _smaller(text)
    leftmost = np.flatnonzero(smaller & ~np.append(True, smaller[:-1])).astype(np.int32)
    if len(leftmost) == 0:
        return _induced(text, smaller, np.array([len(text) - 1], np.int32), size)
    rough = _induced(text, smaller, leftmost[np.argsort(text[leftmost], kind="stable")], size)
    mark = np.zeros(len(text), bool)
    mark[leftmost] = True
    ordered = rough[mark[rough]]
    ends = np.zeros(len(text), np.int32)
    ends[leftmost] = np.append(leftmost[1:], len(text) - 1) + 1
    # equal names: equal length and equal symbols, compared place by place while all agree
    a, b = ordered[:-1], ordered[1:]
    differs = ends[a] - a != ends[b] - b
    open_, at = np.flatnonzero(~differs), 0
    while len(open_):
        x, y = a[open_] + at, b[open_] + at
        on = x < ends[a[open_]]
        open_, x, y = open_[on], x[on], y[on]
        unequal = text[x] != text[y]
        differs[open_[unequal]] = True
        open_ = open_[~unequal]
        at += 1
    names = np.append(0, np.cumsum(differs))
    if names[-1] < len(ordered) - 1:
        by_place = np.empty(len(text), np.int32)
        by_place[ordered] = names
        reduced = by_place[leftmost]
        ordered = leftmost[suffix_array(np.append(reduced + 1, 0), int(names[-1]) + 2)[1:]]
    return _induced(text, smaller, ordered, size)


def same_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the texts at ``a`` and ``b`` agree in ``length`` bytes; compared in words while they do."""
    padded = np.append(text.astype(np.uint8), np.zeros(8, np.uint8))
    at_each = np.lib.stride_tricks.sliding_window_view(padded, 8)
    same = np.ones(len(a), bool)
    open_ = np.arange(len(a))
    for step in range(0, length, 8):
        k = min(step, max(0, length - 8))
        words = (at_each[a[open_] + k], at_each[b[open_] + k])
        if length < 8:
            words = tuple(w[:, :length] for w in words)
        equal = (words[0] == words[1]).all(axis=1)
        same[open_[~equal]] = False
        open_ = open_[equal]
    return same
