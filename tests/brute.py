"""The operators over plain rows, one at a time, for small fixtures."""

from __future__ import annotations

import random
from itertools import product


def choices(rows, k, above):
    """Ascending choices of level k (1-based) under the values above it."""
    if any(v is None for v in above):
        return []
    return sorted({r[k - 1] for r in rows if list(r[: k - 1]) == list(above) and r[k - 1] is not None})


def resolve(rows, levels, request, start=1, stop=None, test_from=None, on_missing="first"):
    """Settled values and one (level, old, new, number of choices, kept) per refreshed level."""
    values = dict(zip(levels, request))
    steps = []
    for k in range(start + 1, (stop or len(levels)) + 1):
        level = levels[k - 1]
        old = values[level]
        tested = values[(test_from or {}).get(level, level)]
        offered = choices(rows, k, [values[c] for c in levels[: k - 1]])
        kept = tested is not None and tested in offered
        if kept:
            new = tested
        elif tested is None and on_missing == "skip":
            new = None
        else:
            new = offered[0] if offered else None
        values[level] = new
        steps.append((level, old, new, len(offered), kept))
    return tuple(values[c] for c in levels), steps


def first_invalid(rows, request):
    for k in range(1, len(request) + 1):
        prefix = request[:k]
        if None in prefix or not any(tuple(r[:k]) == tuple(prefix) for r in rows):
            return k
    return None


def absent(rows, cols):
    found = set()
    for i, j in ((i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))):
        a_values = {r[i] for r in rows} - {None}
        b_values = {r[j] for r in rows} - {None}
        seen = {(r[i], r[j]) for r in rows}
        found |= {(cols[i], str(a), cols[j], str(b)) for a, b in product(a_values, b_values) if (a, b) not in seen}
    return found


def random_rows(seed, n, sizes, nulls=0.0, hot=0.0):
    """Rows of numbered values per level, some null; ``hot`` is the share of one frequent top value."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        row = [f"v{pick.randrange(size)}" if pick.random() >= nulls else None for size in sizes]
        if pick.random() < hot:
            row[0] = "v0"
        rows.append(tuple(row))
    return rows
