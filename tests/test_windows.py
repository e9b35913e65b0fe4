import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import windows


def frame(spark, n=60, seed=1):
    random.seed(seed)
    rows = [(i, random.choice("abc"), random.randint(1, 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, domain string, n long")


def test_running_sum_over_all_rows(spark):
    rows, df = frame(spark)
    got = {r.id: r.cum for r in windows.running(df.repartition(7), "n", ["id"]).collect()}
    total = 0
    for i, _, n in rows:
        total += n
        assert got[i] == total


def test_mixture_equals_the_loop(spark):
    rows, df = frame(spark, 40, 2)
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    queue = {d: [r for r in rows if r[1] == d] for d in share}
    served, want = dict.fromkeys(share, 0), []
    while any(queue.values()):
        d = min((k for k in queue if queue[k]), key=lambda k: (served[k] / share[k], k))
        r = queue[d].pop(0)
        want.append(r[0])
        served[d] += r[2]
    got = [r.id for r in windows.mixture_order(df, share, ["id"], "domain", "n").orderBy("position").collect()]
    assert got == want


def test_budgets_stop_before_and_after(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id long, n long")
    assert sorted(r.id for r in windows.prefix_under(df, "n", ["id"], 11).collect()) == [1, 2]
    assert sorted(r.id for r in windows.prefix_over(df, "n", ["id"], 6).collect()) == [1, 2]


def test_windows_of_a_document(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1), ("c", 4), ("d", None)], "id string, n long")
    got = sorted((r.id, r.start, r.stop) for r in windows.document_windows(df, "n", 4).collect())
    assert got == [("a", 0, 4), ("a", 3, 7), ("a", 6, 10), ("c", 0, 4)]


def test_packing_and_batches(spark):
    df = spark.createDataFrame([(1, 4, "p", "s"), (2, 5, "p", "s"), (3, 3, "p", "s"), (4, 1, "q", "s")], "id long, n long, phase string, shard string")
    got = {r.id: (r.pack, r.segment, r.start) for r in windows.packed_in_order(df, ["shard"], "id", "n", 9).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 1, 4), 3: (1, 0, 0), 4: (1, 1, 3)}
    got = {r.id: r.batch for r in windows.microbatches(df, ["shard"], "id", "n", "phase", 2, 100).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}
    with pytest.raises(Exception, match="longer than the capacity"):
        windows.packed_in_order(df, ["shard"], "id", "n", 4).collect()


def test_identity_quota_never_exceeds(spark):
    df = spark.createDataFrame([(i, 10, i % 3 == 0, "s") for i in range(3000)], "id long, n long, flag boolean, shard string")
    kept = windows.identity_quota(df, ["shard"], "id", "n", "flag").filter("kept").groupBy("flag").agg(F.sum("n").alias("n")).collect()
    by = {r.flag: r.n for r in kept}
    assert 0 < by[True] <= 0.005 * (by[True] + by[False])


def test_review_quota_equals_seats(spark):
    counts = {"a": 50, "b": 10, "c": 1}
    df = spark.createDataFrame([("t", k, v) for k, v in counts.items()], "task string, source string, n long")
    seats = dict.fromkeys(counts, 1)
    while sum(seats.values()) < 20:
        k = max((k for k in counts if seats[k] < counts[k]), key=lambda k: (counts[k] / (seats[k] + 1), k))
        seats[k] += 1
    assert {r.source: r.seats for r in windows.review_quota(df, 20, ["task"], "source", "n").collect()} == seats


def test_running_sum_by_key_with_nulls(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(300)]
    got = {r.id: r.cum for r in windows.running(spark.createDataFrame(rows, "id long, k string, n long").repartition(9), "n", ["id"], ["k"]).collect()}
    total = {}
    for i, k, n in rows:
        total[k] = total.get(k, 0) + (n or 0)
        assert got[i] == total[k]


def test_media_mixture_spreads_media_over_the_budget(spark):
    rows = [(k, "text", 10, 0) for k in range(50)] + [(100 + k, "image", 10, 1) for k in range(3)] + [(200 + k, "video", 20, 2) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, kind string, tokens long, items long")
    out = windows.media_mixture(df, {"image": 6, "video": 4, "audio": 3}, 500, ["id"]).orderBy("position").collect()
    assert [r.position for r in out] == list(range(len(out))) and sum(r.tokens for r in out) == 500
    assert sum(r["items"] for r in out if r.kind == "image") == 6 and sum(r["items"] for r in out if r.kind == "video") == 4
    assert sorted((r.id, r.epoch) for r in out if r.kind == "image") == [(100, 0), (100, 1), (101, 0), (101, 1), (102, 0), (102, 1)]
    at, images = 0, 0
    for r in out:  # no kind is ever more than a row away from its share
        assert abs(images / 6 - at / 500) <= 1 / 6 + 0.1
        at, images = at + r.tokens, images + (r.kind == "image")
    assert windows.media_mixture(df.limit(0), {"image": 6}, 500, ["id"]).count() == 0


def test_sampler_resumes_inside_a_document(spark):
    df = spark.createDataFrame([(1, "a", 25), (2, "a", 10), (3, "b", 40), (4, "b", 0)], "id long, domain string, tokens long")
    whole = windows.resumed_windows(df, {"a": 0.5, "b": 0.5}, ["id"], 10, 0, 99).orderBy("position").collect()
    assert [(r.id, r.begin, r.served_tokens) for r in whole] == [(1, 0, 10), (3, 0, 10), (1, 10, 10), (3, 10, 10), (1, 20, 5), (3, 20, 10), (2, 0, 10), (3, 30, 10)]
    rest = windows.resumed_windows(df, {"a": 0.5, "b": 0.5}, ["id"], 10, 3, 4).orderBy("position").collect()
    assert [tuple(r) for r in rest] == [tuple(r) for r in whole[3:7]]


def test_cursor_over_epochs_has_no_rows_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id long")
    assert windows.epoch_cursor(empty, "id", 1, 0, 5).count() == 0
    full = windows.epoch_cursor(spark.range(7), "id", 1, 3, 11).collect()
    assert sorted(r.position for r in full) == list(range(3, 14))
