"""Keys that near sets share: groups of elements by which they meet without loss, in NumPy."""

from __future__ import annotations

import math

import numpy as np

from corpusmill.functions.shingles import mix

#: Counts of elements among sets, in so many buckets: 4 MB on the driver.
BUCKETS = 1 << 19
#: Ratio of the sizes that bound a class of sets, and partitions of a class for each that is probed.
CLASS_RATIO, SPARE = 1.35, 1.25


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def size_classes(most: int) -> np.ndarray:
    """Least sizes of the classes of sets, up to one above `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * CLASS_RATIO)))
    return np.array(out, dtype=np.int64)


def coarse_keys(sets: np.ndarray, starts: np.ndarray, counts: np.ndarray, num: int = 85, den: int = 100) -> list[np.ndarray]:
    """Keys of each set, partitions holding several shingles: far fewer unlike sets share one.

    A pair that is near lies in one class of sizes, the smaller set in its range and the larger
    not above it by more than near sets are apart; so a set stands in its own class and perhaps in
    the one below. Of a class whose sets hold at most d elements apart, some more than d + 1
    partitions are made by hash and d + 1 are probed, those of which the least candidates are
    expected, in one order for all sets. Partitions that differ are d at most, so the cheapest of
    those that agree is among the probed ones of both. A key is the whole content of a partition.
    """
    n = np.diff(starts)
    least = size_classes(int(n.max(initial=1)))
    own = np.searchsorted(least, n, side="right") - 1
    below = (own > 0) & (n * num <= least[own] * den)
    who = np.concatenate((np.arange(len(n)), np.flatnonzero(below)))  # a view is a set in a class
    cls = np.concatenate((own, own[below] - 1))
    apart = (den - num) * (least[cls + 1] - 1) // num
    parts = np.maximum(1, np.ceil((apart + 1) * SPARE).astype(np.int64))
    many = n[who]
    view = np.repeat(np.arange(len(who)), many)
    at = np.arange(len(view)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[who], many)
    h = sets[at]
    cell = (mix(h + np.uint64(77)) % parts[view].astype(np.uint64)).astype(np.int64)
    first = np.cumsum(parts) - parts
    place = first[view] + cell  # all partitions of all views, on end
    whole = int(parts.sum())
    size = np.bincount(place, minlength=whole)
    content = np.zeros(whole, dtype=np.uint64)
    np.add.at(content, place, mix(h + np.uint64(12345)))
    rare = np.full(whole, 1 << 40, dtype=np.int64)
    np.minimum.at(rare, place, counts[buckets(h)])
    # each further shingle divides the expected candidates; empty partitions come last
    expected = np.where(size > 0, rare >> (3 * np.minimum(size - 1, 12).clip(0)), 1 << 40)
    holder = np.repeat(np.arange(len(who)), parts)
    key = mix(content ^ mix((cls[holder].astype(np.uint64) << np.uint64(40)) + (np.arange(whole) - first[holder]).astype(np.uint64)))
    order = np.lexsort((key, expected, holder))
    rank = np.arange(whole) - first[holder]
    kept = order[rank <= apart[holder]]
    split = np.split(key[kept].view(np.int64), np.cumsum(apart + 1)[:-1])
    extra = {int(i): split[len(n) + k] for k, i in enumerate(np.flatnonzero(below))}
    return [np.concatenate((split[i], extra[i])) if i in extra else split[i] for i in range(len(n))]
