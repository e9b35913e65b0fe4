"""Bytes that queries over many words or shingles shuffle and write, against those of their texts."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import decontam, dedup


@pytest.fixture
def shuffled(spark):
    """Bytes that a DataFrame's evaluation, with what its declaration runs, writes to shuffles."""
    sc = spark.sparkContext

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        store = sc._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def of(make) -> tuple[int, list]:
        before = total()
        rows = make().collect()
        return total() - before, rows

    return of


def texts(many: int, words: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(4_000)]
    return [" ".join(rng.choices(vocabulary, k=words)) for _ in range(many)]


def test_f1_training_texts_without_a_phrase_are_not_sent(spark, shuffled):
    held, train = texts(20, 60, 1), texts(600, 120, 2)
    train[7] = train[7] + " " + " ".join(held[3].split()[5:40])
    items = spark.createDataFrame([(f"i{k}", " ".join(t.split()[:9]), t) for k, t in enumerate(held)], "item string, prompt string, answer string")
    rows = spark.createDataFrame(list(enumerate(train)), "id long, text string")
    moved, got = shuffled(lambda: decontam.matches(rows, decontam.phrases(items)))
    assert [(r.id, r.item) for r in got] == [(7, "i3")]
    assert moved < 0.5 * sum(map(len, train))


def alike(sets: list[set]) -> set[tuple[int, int]]:
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (a or b) and 100 * len(a & b) >= 85 * len(a | b)}


def edited(many: int, words: int) -> list[str]:
    """Texts, of which every tenth is the one before with a word changed and every fiftieth a copy."""
    out = texts(many, words, 3)
    for k in range(10, many, 10):
        own = out[k - 1].split()
        out[k] = " ".join(own if k % 50 == 0 else [*own[: words // 2], "changed", *own[words // 2 + 1 :]])
    return out


def test_f2_sets_of_words_are_not_sent(spark, shuffled):
    some = edited(600, 100)
    df = spark.createDataFrame([(k, t.split()) for k, t in enumerate(some)] + [(601, []), (602, None)], "id long, tokens array<string>")
    moved, got = shuffled(lambda: dedup.exact_similar(df))
    assert {(r.a, r.b) for r in got} == alike([set(t.split()) for t in some]) and len(got) >= 50
    assert moved < sum(map(len, some))


def test_f3_sets_of_shingles_are_not_sent(spark, shuffled):
    some = edited(400, 60)
    rows = spark.createDataFrame([(k, t, True) for k, t in enumerate(some)] + [(900, " ", True), (901, "\n", True), (7, some[7], True)], "id long, x string, p boolean")
    moved, got = shuffled(lambda: dedup.near_sets(rows, dedup.shingles_of))
    flat = [t.replace(" ", "") for t in some]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in flat]
    assert sorted((r.a, r.b) for r in got) == sorted(alike(sets)) and len(got) >= 30
    assert all(r.overlap == len(sets[r.a] & sets[r.b]) and r.united == len(sets[r.a] | sets[r.b]) for r in got)
    assert moved < 10 * sum(map(len, some))  # most of it the table of counts, which has a bound


@pytest.mark.parametrize("name", ["f5_words", "f6_shingles"])
def test_held_rows_ask_and_all_answer(spark, shuffled, name):
    some = edited(400, 60)
    held = {k for k in range(400) if k % 20 in (0, 9)}
    rows = spark.createDataFrame([(k, t, k in held) for k, t in enumerate(some)], "id long, x string, p boolean")
    if name == "f5_words":
        sets = [set(t.split()) for t in some]
        moved, got = shuffled(lambda: dedup.exact_similar(rows.select("id", "p", F.split("x", " ").alias("tokens")), probe=F.col("p")))
    else:
        flat = [t.replace(" ", "") for t in some]
        sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in flat]
        moved, got = shuffled(lambda: dedup.near_sets(rows, dedup.shingles_of))
    assert sorted((r.a, r.b) for r in got) == sorted(p for p in alike(sets) if held & {*p}) and got
    assert moved < 10 * sum(map(len, some))  # most of it the table of counts, which has a bound


@pytest.mark.parametrize("name", ["f5_words", "f6_shingles"])
def test_keys_that_no_held_row_has_are_not_sent(spark, monkeypatch, name):
    sent = spark.sparkContext.accumulator(0)
    packed = dedup._packed

    def counted(part, take, *rest):
        sent.add(len(take))
        return packed(part, take, *rest)

    monkeypatch.setattr(dedup, "_packed", counted)
    some = edited(600, 60)
    held = {k for k in range(600) if k % 50 in (0, 9)}

    def run(p):
        before = sent.value
        rows = spark.createDataFrame([(k, t, p(k)) for k, t in enumerate(some)], "id long, x string, p boolean")
        if name == "f5_words":
            got = dedup.exact_similar(rows.select("id", "p", F.split("x", " ").alias("tokens")), probe=F.col("p")).collect()
        else:
            got = dedup.near_sets(rows, dedup.shingles_of).collect()
        return {(r.a, r.b) for r in got}, sent.value - before

    every, all_keys = run(lambda k: True)
    got, keys = run(lambda k: k in held)
    assert got == {p for p in every if held & {*p}} and got
    assert 0 < keys < 0.3 * all_keys


def test_filter_of_hashes_loses_none(spark):
    import numpy as np

    from corpusmill.operators import marks

    h = np.random.default_rng(5).integers(0, 1 << 64, 40_000, dtype=np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in h[:20_000].view(np.int64)], "x long")
    for bits in (1 << 16, marks.width(20_000, 16)):  # the first is full: nearly all pass, and none is lost
        own = marks.marks(rows, lambda frames: (pdf["x"].to_numpy().view(np.uint64) for pdf in frames), bits, 2)
        at = marks.passing(own, h, 2)
        assert set(range(20_000)) <= set(at.tolist())
    assert len(at) < 20_800


def test_parities_lose_no_near_set():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 20, 127, 128, 129, 140, 255, 258, 600, 2_100, 5_000):
        one = rng.integers(0, 1 << 48, n, dtype=np.uint64)
        sets += [np.unique(one), np.unique(np.concatenate((one[n // 20 :], rng.integers(0, 1 << 48, n // 12, dtype=np.uint64))))]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bits, words = dedup._parities(np.concatenate(sets), starts)
    a, b = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    apart = dedup._bits_apart(bits, np.cumsum(words) - words, words, a, b)
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(apart.tolist(), a.tolist(), b.tolist(), strict=True))


def test_f4_repeated_rows_match_once(spark):
    held = texts(3, 40, 5)
    items = spark.createDataFrame([(f"i{k}", None, t) for k, t in enumerate(held)], "item string, prompt string, answer string")
    rows = [(1, held[0], "a/b"), (1, held[0], "a/b"), (2, "x", "openai/human-eval"), (2, "x", "openai/human-eval"), (3, "x", None)]
    hit = decontam.all_matches(spark.createDataFrame(rows, "id long, text string, repo_id string"), decontam.phrases(items))
    assert sorted((r.id, r.item) for r in hit.collect()) == [(1, "i0"), (2, "upstream_repository")]
    groups = spark.createDataFrame([(1, "g"), (3, "g"), (2, "h"), (4, "k"), (5, None)], "id long, group_root string")
    assert sorted(r.id for r in decontam.excluded(groups, hit).collect()) == [1, 2, 3]


def test_f4_held_rows_are_parsed_once(spark, tmp_path):
    from corpusmill.plans import catalog

    some = texts(400, 40, 6)
    some[9], some[30] = some[0], " ".join([*some[20].split()[:30], "more"])
    rows = [(f"r{k}", t, None, "g" if k in (9, 11) else f"g{k}", "val" if k % 20 == 0 else "train") for k, t in enumerate(some)]
    spark.createDataFrame(rows, "id string, text string, payload string, group_root string, split string").coalesce(1).write.parquet(str(tmp_path / "samples.parquet"))
    sc = spark.sparkContext

    def read() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    before = read()
    got = catalog.QUERIES["contamination_groups"](spark, str(tmp_path)).collect()
    assert {r.id for r in got} == {"r9", "r11", "r30"}
    assert read() - before < 9 * len(rows)  # held rows three times a step, before
