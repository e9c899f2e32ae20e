"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes whose words are hashed at once, which bounds the memory beside the text.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Shares of the five words, and of shorter whole sequences by their length.
_SEEDS = np.random.default_rng(5).integers(1, 1 << 62, (6, SHINGLE), dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for i, base in enumerate((_ODD, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _pieces(body: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``PIECE`` bytes that end at a blank; a longer word stays whole."""
    at = 0
    while at < len(body):
        end = min(len(body), at + PIECE)
        if end < len(body):
            blanks = np.flatnonzero(_BLANK[body[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                while end < len(body) and not _BLANK[body[end]]:
                    end += 1
        yield at, end
        at = end


def _word_hashes(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, stop in _pieces(body):
        piece = body[at:stop]
        blank = np.r_[True, _BLANK[piece], True]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = _power_tables(len(piece) + 1)
        sums = np.r_[np.uint64(0), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)])]
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its five-word shingles.

    Words are runs of anything but U+0009 to U+000D and space; A-Z count as a-z. A text of fewer words
    is one shingle, its whole sequence; one without words has none.
    """
    out, some, size = [], [], 0
    for text in texts:
        body = text.encode("utf-8", "replace").lower()
        if some and size + len(body) > PIECE:
            out += _sets(some)
            some, size = [], 0
        some.append(body)
        size += len(body)
    return out + _sets(some) if some else out


def _sets(bodies: list[bytes]) -> list[np.ndarray]:
    lengths = np.array([len(b) + 1 for b in bodies])
    words, starts = _word_hashes(np.frombuffer(b" ".join(bodies), np.uint8))
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
    if len(words) >= SHINGLE:
        span = len(words) - SHINGLE + 1
        every = words[:span] * _SEEDS[5, 0]
        for k in range(1, SHINGLE):
            every += words[k : k + span] * _SEEDS[5, k]
        every = mixed(every)
    out = []
    for first, last in zip(bounds[:-1], bounds[1:]):
        n = last - first
        if n >= SHINGLE:
            out.append(np.unique(every[first : last - SHINGLE + 1]))
        elif n:
            out.append(mixed((words[first:last] * _SEEDS[n, :n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """One signed 64-bit number per set; different sets differ but for chance."""
    total = (mixed(hashes ^ _ODD) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mixed(np.array([total]))[0].astype(np.int64))


def prefix_length(n: int) -> int:
    """Two sets of similarity 0.75 share one of each other's first so many elements, in any common order."""
    return n - -(-3 * n // 4) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> tuple[bool, float]:
    """Whether the Jaccard similarity is 0.75 or more, exactly, and the distance."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return 100 * both >= 75 * union, 1 - both / union
