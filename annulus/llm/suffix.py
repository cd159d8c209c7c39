"""Suffix arrays in numpy by induced sorting, and permuted common prefixes.

Suffixes are classified by whether they are smaller than the next one; the substrings between leftmost
smaller ones are sorted and named, the string of names is sorted by recursion, and its order induces
that of all suffixes. With few symbols, as of bytes, a level induces bucket by bucket. With many, as
of names, buckets hold a place or two each, and all of them are induced at once: a suffix is sorted
by its (symbol, type) pairs up to the next leftmost smaller one and by that one's place, in passes
from left to right over the suffixes that are still tied. The work is bounded by the lengths of the
substrings, which add up to a small multiple of the string's for any text without very long runs.
"""

from __future__ import annotations

import numpy as np

#: Up to so many symbols a level is induced bucket by bucket; above, all buckets at once.
_BUCKETS = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the smallest and unique."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    smaller = np.empty(n, bool)
    smaller[-1] = True
    next_change = change[np.searchsorted(change, np.arange(n - 1))]
    smaller[:-1] = s[next_change] < s[next_change + 1]
    return smaller


class _Parts:
    """What each bucket has received, in order of arrival."""

    def __init__(self, symbols: int):
        self.new: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.all: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def put(self, places: np.ndarray, symbols: np.ndarray) -> None:
        if not len(places):
            return
        order = np.argsort(symbols, kind="stable")
        places, symbols = places[order], symbols[order]
        cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        for at, part in zip(symbols[cuts].tolist(), np.split(places, cuts[1:]), strict=True):
            self.new[at].append(part)

    def take(self, at: int) -> np.ndarray | None:
        """The next run of arrivals in bucket ``at``, if any."""
        if not self.new[at]:
            return None
        run = np.concatenate(self.new[at])
        self.new[at] = []
        self.all[at].append(run)
        return run


def _induce(s: np.ndarray, smaller: np.ndarray, minima: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes, sorted from the leftmost-smaller ones in the order given. Linear, a bucket at a time."""
    large, starts = _Parts(symbols), _Parts(symbols)
    starts.put(minima, s[minima])

    def before(places: np.ndarray, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        prior = places[places > 0] - 1
        prior = prior[smaller[prior] == kind]
        return prior, s[prior]

    for c in range(symbols):
        while (run := large.take(c)) is not None:
            large.put(*before(run, False))
        if (run := starts.take(c)) is not None:
            large.put(*before(run, False))
    small = _Parts(symbols)
    small.put(np.array([len(s) - 1]), s[-1:])  # the end, which is before none
    for c in range(symbols - 1, -1, -1):
        while (run := small.take(c)) is not None:
            small.put(*before(run, True))
        if large.all[c]:
            small.put(*before(np.concatenate(large.all[c])[::-1], True))
    parts = []
    for c in range(symbols):
        parts += large.all[c]
        if small.all[c]:
            parts.append(np.concatenate(small.all[c])[::-1])
    return np.concatenate(parts)


def _named(s: np.ndarray, ordered: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """A name for the leftmost-smaller substring at each of ``ordered``: equal ones share it, later ones are larger."""
    ends = np.empty(len(s), np.int64)
    ends[minima] = np.r_[minima[1:], len(s) - 1]  # with the first symbol of the next one
    a, b = ordered[:-1], ordered[1:]
    length = ends[a] - a
    same = length == ends[b] - b
    left, offset = np.flatnonzero(same), 0
    while len(left):
        equal = s[a[left] + offset] == s[b[left] + offset]
        same[left[~equal]] = False
        offset += 1
        left = left[equal & (offset <= length[left])]
    return np.r_[0, np.cumsum(~same)]


def _refined(s: np.ndarray, smaller: np.ndarray, starts: np.ndarray, is_minimum: np.ndarray, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in order of their (symbol, type) pairs up to the next leftmost smaller suffix, and which differ from the one before.

    With ``place``, the order of leftmost smaller suffixes, ties go by that of the one at the end.
    """
    pairs = 2 * s.astype(np.int64) + smaller  # of one symbol, those larger than the next suffix come first
    end = np.iinfo(np.int64).max if place is None else len(s) + 1
    order = starts[np.argsort(pairs[starts], kind="stable")]
    differs = np.r_[True, pairs[order[1:]] != pairs[order[:-1]]]
    open_ = ~(differs & np.r_[differs[1:], True])  # slots of the order whose group is larger than one
    offset = 0
    while open_.any():
        slots = np.flatnonzero(open_)
        group = np.cumsum(differs[slots]) - 1
        offset += 1
        at = order[slots] + offset
        over = at >= len(s)  # the last suffix is alone in its group, so this can't tell two apart
        at = np.minimum(at, len(s) - 1)
        value = np.where(over, 0, pairs[at] + 1)
        ended = is_minimum[at] & ~over
        if place is not None:
            # two passes, the last one by group: each is a stable sort
            tie = np.where(ended, place[at], 0)
            inner = np.argsort(tie, kind="stable")
        else:
            tie, inner = None, np.arange(len(slots))
        inner = inner[np.argsort(value[inner], kind="stable")]
        inner = inner[np.argsort(group[inner], kind="stable")]
        order[slots] = order[slots][inner]
        value, group, ended = value[inner], group[inner], ended[inner]
        new = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        if tie is not None:
            tie = tie[inner]
            new |= tie[1:] != tie[:-1]
        differs[slots] = np.r_[True, new]
        alone = differs[slots] & np.r_[differs[slots][1:], True]
        open_[slots] = ~alone & ~ended  # those at their end are as sorted as they get
    return order, differs


def _induced_wide(s: np.ndarray, smaller: np.ndarray, is_minimum: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    place = np.zeros(len(s), np.int64)
    place[ordered] = np.arange(1, len(ordered) + 1)
    return _refined(s, smaller, np.arange(len(s)), is_minimum, place)[0]


def suffix_array(s: np.ndarray, symbols: int, buckets: int = _BUCKETS) -> np.ndarray:
    """Of ``s``, whose last symbol is 0 and occurs once; ``symbols`` is over the largest symbol."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    wide = symbols > buckets
    smaller = _types(s)
    minima = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_minimum = np.zeros(len(s), bool)
    is_minimum[minima] = True
    names = np.empty(len(s), np.int64)
    if wide:
        ordered, differs = _refined(s, smaller, minima, is_minimum, None)
        names[ordered] = np.cumsum(differs) - 1
    else:
        first = _induce(s, smaller, minima, symbols)  # sorts the substrings between minima
        ordered = first[is_minimum[first]]
        names[ordered] = _named(s, ordered, minima)
    reduced = names[minima]
    if reduced.max() + 1 < len(minima):
        ordered = minima[suffix_array(reduced, int(reduced.max()) + 1, buckets)]
    return _induced_wide(s, smaller, is_minimum, ordered) if wide else _induce(s, smaller, ordered, symbols)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, stride: int = 32) -> np.ndarray:
    """For every suffix, in suffix order: the length, ``most`` at most, that it shares with the one before it.

    Permuted: computed in the order of the text, where a place shares at least one less than the place
    before it. Every ``stride``-th place is compared from the start, then those halfway between two,
    from what the place on their left leaves them, until all are known: linear in the text but for
    what the places of a stride gain over their neighbours. ``order`` begins with the last suffix.
    """
    n = len(text)
    before = np.full(n, n - 1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.r_[text, np.full(most, -1, text.dtype)]

    def extend(at: np.ndarray) -> None:
        there = before[at]
        at, there = at[at != order[0]], there[at != order[0]]
        left = np.arange(len(at))
        have = shared[at]
        while len(left):
            left = left[have[left] < most]
            same = (padded[at[left] + have[left]] == padded[there[left] + have[left]]) & (np.maximum(at[left], there[left]) + have[left] < n)
            left = left[same]
            have[left] += 1
        shared[at] = have

    extend(np.arange(0, n, stride))
    while stride > 1:
        half = stride // 2
        at = np.arange(half, n, stride)
        shared[at] = np.maximum(0, shared[at - half] - half)
        extend(at)
        stride = half
    return shared[order]
