import itertools
import random

from pyspark.sql import functions as F

from corpusmill.functions.text import py_squeezed
from corpusmill.operators import dedup


def test_exact_similarity_over_all_subsets(spark):
    sets = [set(c) for n in range(1, 7) for c in itertools.combinations("abcdef", n)] + [set(map(str, range(20))), set(map(str, range(17)))]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(999, []), (998, None)], "id long, tokens array<string>")
    got = {(r.a, r.b) for r in dedup.exact_similar(df).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(a & b) >= 85 * len(a | b)}
    assert got == want and (len(sets) - 2, len(sets) - 1) in got


def test_probe_limits_pairs(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a"])], "id long, tokens array<string>")
    assert {(r.a, r.b) for r in dedup.exact_similar(df, probe=F.col("id") == 1).collect()} == {(1, 2), (1, 3)}


def test_band_pairs_at_the_border(spark):
    base = 0x0123456789ABCDEF
    rows = [("a", base), ("b", base ^ 0b111), ("c", base ^ 0b1111), ("d", base), ("e", None)]
    got = {(r.a, r.b) for r in dedup.band_pairs(spark.createDataFrame(rows, "id string, v long"), "id", "v", dedup.TEXT_BANDS, 3).collect()}
    assert got == {("a", "b"), ("a", "d"), ("b", "d"), ("b", "c")}


def test_picture_bands_find_six_bits(spark):
    random.seed(3)
    values = [random.getrandbits(63) for _ in range(20)]
    rows = [(f"x{i}", v) for i, v in enumerate(values)]
    for i, v in enumerate(values):
        w = v
        for b in random.sample(range(63), 6 if i % 2 else 7):
            w ^= 1 << b
        rows.append((f"y{i}", w))
    got = {(r.a, r.b) for r in dedup.band_pairs(spark.createDataFrame(rows, "id string, v long"), "id", "v", dedup.PICTURE_BANDS, 6).collect()}
    want = {(min(a, b), max(a, b)) for (a, v), (b, w) in itertools.combinations(rows, 2) if (v ^ w).bit_count() <= 6}
    assert got == want and len(got) >= 10


def test_first_independent_equals_the_loop(spark):
    for seed in range(2):
        random.seed(seed)
        edges = {tuple(sorted(random.sample(range(30), 2))) for _ in range(35)}
        kept = []
        for n in range(30):
            if not any((k, n) in edges for k in kept):
                kept.append(n)
        got = dedup.first_independent(spark.range(30).withColumnRenamed("id", "node"), spark.createDataFrame(sorted(edges), "a long, b long"))
        assert sorted(r.node for r in got.filter("kept").collect()) == kept


def test_admission_equals_the_loop(spark):
    random.seed(5)
    edges = {tuple(sorted(random.sample(range(40), 2))) for _ in range(25)}
    question = [random.choice(["", "p", "q", None]) for _ in range(40)]
    kept, asked = [], {}
    for n in range(40):
        q = question[n] or ""
        if (q and asked.get(q, 0) >= 3) or any((k, n) in edges for k in kept):
            continue
        kept.append(n)
        asked[q] = asked.get(q, 0) + 1
    got = dedup.admitted(spark.createDataFrame(list(enumerate(question)), "node long, question string"), spark.createDataFrame(sorted(edges), "a long, b long"))
    assert sorted(r.node for r in got.filter("kept").collect()) == kept


def test_sim_hash_and_shingles(spark):
    texts = ["abcdefg", "", "x", None, "Straße  ｆｕｌｌ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    own = {r.id: r.tokens for r in dedup.shingle_table(df, "id", "text").collect()}
    for i, t in enumerate(texts):
        if t is not None:
            s = py_squeezed(t)
            assert len(own[i]) == len({s[k : k + 5] for k in range(max(1, len(s) - 4))})
    hashed = {r.id: r.h for r in df.select("id", dedup.sim_hash(F.col("text")).alias("h")).collect()}
    assert hashed[3] is None and hashed[0] is not None


def test_first_by_keeps_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, None, None)], "k long, _n string, o long")
    assert {(r.k, r._n) for r in dedup.first_by(df, ["k"], ["o"]).collect()} == {(1, "b"), (2, None)}
