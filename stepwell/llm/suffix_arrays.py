"""Suffix array of a shard in numpy: Larsson-Sadakane refinement and Kasai common prefixes."""

from __future__ import annotations

import numpy as np

#: Bytes that the first sort looks at.
WIDTH = 8
#: Common prefixes are compared anew after so many positions at the latest.
RESTART = 1024


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number, zeros beyond the end."""
    padded = np.r_[text, np.zeros(WIDTH, np.uint8)]
    out = np.zeros(len(text), np.uint64)
    for k in range(WIDTH):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Positions in order of at least ``depth`` bytes from each on.

    Ranks by ``h`` bytes give those by ``2 h``: a position is ordered by its own rank and that of the
    position ``h`` further on. Only groups of equal rank are sorted again.
    """
    n = len(text)
    order = np.argsort(words, kind="stable")
    fresh = np.r_[True, words[order[1:]] != words[order[:-1]]]
    rank = np.empty(n + 1, np.int64)
    # the rank of a group is the place of its first member
    firsts = np.flatnonzero(fresh)
    rank[order] = np.repeat(firsts, np.diff(np.r_[firsts, n]))
    rank[n] = -1
    h = WIDTH
    while h < depth:
        single = fresh & np.r_[fresh[1:], True]
        places = np.flatnonzero(~single)
        if not len(places):
            break
        at = order[places]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[places] = at
        new = np.r_[True, key[1:] != key[:-1]]
        fresh[places] |= new
        firsts = places[np.flatnonzero(new)]
        rank[at] = np.repeat(firsts, np.diff(np.r_[np.flatnonzero(new), len(places)]))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before it, exact up to ``most``.

    Kasai's order of work: from a position to the next the common prefix shrinks by one at most, and by
    exactly one where the neighbour moves along. Only the other positions are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    moves = np.zeros(n, bool)
    moves[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (text[:-1] == text[np.maximum(before[:-1], 0)])
    moves[::RESTART] = False
    compared = np.flatnonzero(~moves & (before >= 0))
    a, b = compared, before[compared]
    length = np.zeros(len(compared), np.int64)
    active = np.arange(len(compared))
    # other values follow from a compared one up to RESTART positions back, so these go beyond ``most``
    padded = np.r_[words, np.zeros(1, np.uint64)]
    while len(active):
        x, y = a[active] + length[active], b[active] + length[active]
        inside = np.maximum(x, y) < n
        differ = padded[np.minimum(x, n)] ^ padded[np.minimum(y, n)]
        same = np.full(len(active), WIDTH)
        for k in range(WIDTH - 1, -1, -1):
            same[(differ >> np.uint64(8 * (WIDTH - 1 - k))) & np.uint64(255) != 0] = k
        same = np.where(inside, np.minimum(same, np.maximum(n - np.maximum(x, y), 0)), 0)
        length[active] += same
        active = active[(same == WIDTH) & (length[active] < most + RESTART)]
    here = np.arange(n)
    end = here.copy()
    end[compared] += length
    value = np.maximum(end[np.maximum.accumulate(np.where(moves, 0, here))] - here, 0)
    return value[order]


def repeated_starts(text: np.ndarray, valid: np.ndarray, depth: int) -> np.ndarray:
    """Of the ``valid`` starts, those whose first ``depth`` bytes also start at another valid one."""
    words = eight_bytes(text)
    order = suffix_array(text, depth, words)
    common = common_prefixes(text, order, words, depth)
    places = np.flatnonzero(valid[order])
    out = np.zeros(len(text), bool)
    if len(places) > 1:
        # common prefix of valid neighbours: the least of those between them
        shared = np.minimum.reduceat(common[: places[-1] + 1], places[:-1] + 1) >= depth
        out[order[places[1:]][shared]] = True
        out[order[places[:-1]][shared]] = True
    return out
