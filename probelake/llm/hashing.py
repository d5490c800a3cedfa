"""Word and window hashes in numpy: 64-bit polynomial hashes of a text's words and of every run of k words."""

from __future__ import annotations

import numpy as np

U = np.uint64
_R, _SEED = U(0x9E3779B97F4A7C15 | 1), 20240229
_table = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_inverse = U(pow(int(_R), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, which: str = "up") -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have)), _R if which == "up" else _inverse, np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[which] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """A hash for each word (run of anything but space and 9 to 13) of UTF-8 bytes."""
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = LOWER[b]
    inside = ~SPACE[b]
    edges = np.diff(inside.view(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        return np.zeros(0, np.uint64)
    sizes = end - first
    begin = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_table[b[inside]] * powers(int(sizes.max()))[at], begin)
        return mixed(h + sizes.astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k word hashes."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(n), out=sums[1:])
        return mixed((sums[k:] - sums[:-k]) * powers(n, "down")[: n - k + 1])


def run_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each run of word hashes [first, end)."""
    n = len(h)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(n), out=sums[1:])
        return mixed((sums[end] - sums[first]) * powers(n, "down")[first] + (end - first).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def sliding_first_min(a: np.ndarray, w: int) -> np.ndarray:
    """Position of the first least value in each window of w, by doubling."""
    at, width = np.arange(len(a)), 1

    def better(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(a[y] < a[x], y, x)

    while 2 * width <= w:
        at, width = better(at[:-width], at[width:]), 2 * width
    rest = w - width
    return better(at[: len(at) - rest], at[rest:]) if rest else at
