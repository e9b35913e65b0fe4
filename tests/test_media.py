import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions.media import luma_hashes, perceptual_hash, rgb_identity


def luma_hash(a):
    return int(luma_hashes(a.reshape(1, -1))[0])


def test_hash_ignores_brightness_and_sees_structure(spark):
    rng = np.random.default_rng(1)
    a = rng.random((32, 32))
    assert luma_hash(a) == luma_hash(a * 0.5 + 10) and (luma_hash(a) ^ luma_hash(rng.random((32, 32)))).bit_count() > 10
    assert (luma_hash(a) ^ luma_hash(a + rng.normal(0, 0.001, a.shape))).bit_count() <= 2
    rows = [(a.ravel().tolist(),), ([1.0],), (None,)]
    got = [r.h for r in spark.createDataFrame(rows, "l array<double>").select(perceptual_hash(F.col("l")).alias("h")).collect()]
    assert got == [f"{luma_hash(a):016x}", None, None]


def test_hash_equals_the_sums_of_the_transform():
    a = np.random.default_rng(2).random((32, 32))
    terms = [sum(a[x, y] * np.cos(np.pi * u * (2 * x + 1) / 64) * np.cos(np.pi * v * (2 * y + 1) / 64) for x in range(32) for y in range(32)) for u in range(8) for v in range(8)]
    median = sorted(terms[1:])[31]
    assert luma_hash(a) == int("".join("1" if t > median else "0" for t in terms), 2)


def test_equal_bytes_of_other_shape_differ(spark):
    rows = [(2, 3, bytearray(b"abc")), (3, 2, bytearray(b"abc")), (2, 3, bytearray(b"abc")), (None, 3, bytearray(b"abc"))]
    h = [r.h for r in spark.createDataFrame(rows, "w int, h int, p binary").select(rgb_identity(F.col("w"), F.col("h"), F.col("p")).alias("h")).collect()]
    assert h[0] == h[2] != h[1] and h[3] is None
