"""Character shingles of many texts at once, in NumPy.

A batch of texts is one array of code points; every step works on the whole batch, so the
cost a text is a few array operations and no Python loop runs over characters.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW48 = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def placed_shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hash of the shingle at every place of each text.

    Returns (hashes, starts): text i owns hashes[starts[i]:starts[i + 1]], in order of place. A
    text shorter than width is its own single shingle; so is the empty text.
    """
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    # filling characters behind each text: no shingle crosses a border, and short texts have one
    pad = "\uffff" * width
    points = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    begin = np.concatenate(([0], np.cumsum(length + width)[:-1]))
    many = np.maximum(length - width + 1, 1)
    h = np.zeros(max(len(points) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[k : len(points) - width + 1 + k] + np.uint64(1)
        h ^= h >> np.uint64(29)
    starts = np.concatenate(([0], np.cumsum(many)))
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], many) + np.repeat(begin, many)
    return mix(h[at]) & _LOW48, starts


def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 48-bit hashes.

    Returns (hashes, starts): text i owns hashes[starts[i]:starts[i + 1]], sorted. A text
    shorter than width is its own single shingle; so is the empty text. texts must be no
    more than 65,535.
    """
    n = len(texts)
    if n >= 1 << 16:
        raise ValueError("too many texts for one batch")
    hashes, places = placed_shingles(texts, width)
    key = hashes | (np.repeat(np.arange(n, dtype=np.uint64), np.diff(places)) << np.uint64(48))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    starts = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))
    return key & _LOW48, starts


def odd_sketches(hashes: np.ndarray, starts: np.ndarray, bits: int = 1024) -> np.ndarray:
    """Parities of each set's elements in `bits` cells, as a (sets, bits / 64) array.

    Every element in one set and not in the other flips one bit, so two sketches differ in no more
    bits than their sets in elements.
    """
    n = len(starts) - 1
    cell = np.repeat(np.arange(n, dtype=np.int64) * bits, np.diff(starts)) + (hashes & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64).reshape(n, bits // 64)


def most_apart(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements that sets of sizes a and b hold apart at most, if they share num/den of their union."""
    return (den - num) * (a + b) // (den + num)


def min_hashes(hashes: np.ndarray, starts: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """count independent 32-bit min-hashes of each set, as a (sets, count) array."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    short = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts) - 1, count), dtype=np.uint32)
    for i in range(len(starts) - 1):
        own = short[starts[i] : starts[i + 1]]
        best = None
        for a in range(0, len(own), 2048):
            part = own[a : a + 2048]
            low = ((part[None, :] ^ flip[:, None]) * odd[:, None]).min(axis=1)
            best = low if best is None else np.minimum(best, low)
        out[i] = best
    return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets share at least num/den of their union; exact integers."""
    small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if small * den < num * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * den >= num * (len(a) + len(b) - common)
