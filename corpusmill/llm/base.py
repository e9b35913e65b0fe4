"""What several operators share: one row a record, and text profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.keys import BUCKETS, buckets, coarse_keys, size_classes  # noqa: F401 - also used from here
from corpusmill.functions.shingles import min_hashes, shingle_sets
from corpusmill.session import table

#: Texts a NumPy batch; keeps the arrays of a batch in a few MB whatever the lengths.
_BATCH_CHARS, _BATCH_TEXTS = 2_000_000, 2_000


def samples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The admitted records with the columns asked for, repeated rows included."""
    return table(spark, sf_dir, "samples").select(*columns)


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Borders of runs of texts that are handled as one array."""
    begin, chars = 0, 0
    for i, text in enumerate(texts):
        if i > begin and (chars + len(text) > _BATCH_CHARS or i - begin >= _BATCH_TEXTS):
            yield begin, i
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def text_hash(squeezed: str) -> bytes:
    return hashlib.blake2b(squeezed.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """Texts that hold a shingle, by bucket of the shingle. texts: one column, squeezed.

    Tasks send one row a bucket that they met, which are added up before they reach the driver.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in frames:
            own = pdf.iloc[:, 0].tolist()
            for a, b in batches(own):
                total += np.bincount(buckets(shingle_sets(own[a:b])[0]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    sums = texts.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return counts


def rare_first(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the shingles of sorted sets, each set's rarest first; one order for all sets.

    By the count of the bucket, then by the hash.
    """
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    seen = np.minimum(counts[buckets(hashes)], (1 << 20) - 1).astype(np.uint64)
    # 16 bits of owner, 20 of count, 28 of hash; what is equal in all stays in the order of the hash
    return np.argsort((owner << np.uint64(48)) | (seen << np.uint64(28)) | (hashes >> np.uint64(20)), kind="stable")


def sketches(hashes: np.ndarray, starts: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """One bit of each of so many min-hashes of every set, as uint64; two sets that share s of their union agree in (1 + s) / 2 of them."""
    low = min_hashes(hashes, starts, bits, seed)
    return (((low >> np.uint32(7)) & np.uint32(1)).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


# ---------------------------------------------------------------- keys that near sets share

#: Least similarity of near texts, as a fraction of whole numbers.
NUM, DEN = 85, 100


def probed(a: np.ndarray) -> np.ndarray:
    """Single shingles that sets of a probe: one more than a near set can lack."""
    return a - -(-NUM * a // DEN) + 1


def single_keys(sets: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Keys of each set, partitions being single shingles: the rarest of them."""
    n = np.diff(starts)
    rank = np.arange(len(sets)) - np.repeat(starts[:-1], n)
    taken = rank < np.repeat(probed(n), n)
    return np.split(sets[rare_first(sets, starts, counts)][taken].view(np.int64), np.cumsum(probed(n))[:-1])


def chance_pairs(keys: list[np.ndarray]) -> float:
    """Pairs of sets that meet in a key."""
    _, c = np.unique(np.concatenate(keys), return_counts=True) if keys else (None, np.zeros(0))
    return float((c * (c - 1) / 2).sum())


def cheaper_keys(texts: DataFrame, total: int, counts: np.ndarray, sample: int = 2_000):
    """single_keys or coarse_keys, by the keys and the candidates to expect of `total` texts.

    Estimated on the texts of `sample` rows; only costs depend on it. A key counts as 25
    candidates, as it is sorted and sent and they are not.
    """
    some = list(dict.fromkeys(r[0] for r in texts.orderBy(F.xxhash64(texts.columns[0])).limit(sample).collect()))
    if len(some) < 2:
        return single_keys
    cost = {}
    for f in (single_keys, coarse_keys):
        keys = [k for a, b in batches(some) for k in f(*shingle_sets(some[a:b]), counts)]
        cost[f] = sum(map(len, keys)) * total / len(some) + 0.04 * chance_pairs(keys) * (total / len(some)) ** 2
    return min(cost, key=cost.get)
