"""Queries of ordered operators: budgets, mixtures, quotas, windows, sampling, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import expr
from corpusmill.functions.labels import source_key
from corpusmill.operators import windows
from corpusmill.plans.corpus import RECORDS, SOURCE
from corpusmill.plans.registry import query
from corpusmill.session import table

SIZED = f"SELECT doc_id, {SOURCE} AS source, coalesce(length(text), 0)::BIGINT AS n FROM documents"


def _sized(spark, d):
    return table(spark, d, "documents").select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))


@query("review_sample_100", "W1 K8 F36", f"WITH r AS ({RECORDS}), n AS (SELECT source, task, id, row_number() OVER (PARTITION BY source, task ORDER BY id) AS rank FROM (SELECT {SOURCE} AS source, task, id FROM r)) SELECT * FROM n WHERE rank <= 100")
def _(spark, d):
    rows = table(spark, d, "samples").select(source_key(F.col("source")).alias("source"), "task", "id").dropDuplicates(["id"])
    return windows.first_n(rows, ["source", "task"], ["id"], 100)


@query(
    "review_quota", "A9",
    f"""WITH c AS (SELECT task, source, count(*) AS n FROM (SELECT DISTINCT id, {SOURCE} AS source, task FROM samples WHERE task IS NOT NULL) GROUP BY 1, 2), j AS (SELECT task, source, n, unnest(generate_series(1, least(n, 20))) AS j FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN j > 1 THEN 1 ELSE 0 END, n::DOUBLE / j DESC, source DESC) AS r FROM j) SELECT task, source, count(*) AS seats FROM s WHERE r <= 20 GROUP BY 1, 2""",
)
def _(spark, d):
    rows = table(spark, d, "samples").filter("task is not null").select("id", source_key(F.col("source")).alias("source"), "task").distinct()
    return windows.review_quota(rows.groupBy("task", "source").agg(F.count("*").alias("n")), 20, ["task"], "source", "n")


@query("topk_per_bucket", "W2 L3", f"WITH r AS (SELECT source, doc_id, sha256(concat('5:', doc_id)) AS u FROM ({SIZED})), n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY u DESC, doc_id) AS rank FROM r) SELECT * FROM n WHERE rank <= 10")
def _(spark, d):
    return windows.first_n(_sized(spark, d).withColumn("u", windows.seeded(5, F.col("doc_id"))), ["source"], [F.desc("u"), "doc_id"], 10).select("source", "doc_id", "rank")


@query("token_offsets", "W3 K4", f"SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS \"offset\" FROM ({SIZED})")
def _(spark, d):
    return windows.offsets(_sized(spark, d), "n", ["doc_id"]).select("doc_id", "n", "offset")


@query("compact_shards", "K5", f"SELECT shard, count(*) AS documents, sum(n)::BIGINT AS tokens FROM (SELECT n, floor((sum(n) OVER (ORDER BY doc_id) - n) / 100000)::BIGINT AS shard FROM ({SIZED})) GROUP BY shard")
def _(spark, d):
    return windows.shards(_sized(spark, d), "n", ["doc_id"], 100_000).groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"))


@query("budget_prefix", "W4 T1", f"SELECT doc_id, n FROM (SELECT *, sum(n) OVER (ORDER BY doc_id) AS c FROM ({SIZED})) WHERE c <= 300000")
def _(spark, d):
    return windows.prefix_under(_sized(spark, d), "n", ["doc_id"], 300_000).select("doc_id", "n")


@query("source_targets", "L10 L11 W5", f"SELECT source, doc_id FROM (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS c FROM ({SIZED})) WHERE c < 20000")
def _(spark, d):
    return windows.prefix_over(_sized(spark, d), "n", ["doc_id"], 20_000, ["source"]).select("source", "doc_id")


@query(
    "validation_panel", "W5 W12",
    f"WITH o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY sha256(concat('3:', doc_id)), doc_id) - n AS before FROM ({SIZED}) WHERE n > 0) SELECT doc_id, CASE WHEN before < 50000 THEN 'periodic' ELSE 'phase_end' END AS scope FROM o WHERE before < 200000",
)
def _(spark, d):
    rows = _sized(spark, d).filter("n > 0").withColumn("s", windows.seeded(3, F.col("doc_id")))
    own = windows.running(rows, "n", ["s", "doc_id"]).withColumn("before", F.col("cum") - F.col("n"))
    return own.filter("before < 200000").select("doc_id", F.when(F.col("before") < 50_000, "periodic").otherwise("phase_end").alias("scope"))


def _shares(spark, d):
    """Proportions of mix_targets, a row a source."""
    return {r.s: r.p for r in table(spark, d, "mix_targets").groupBy(source_key(F.col("source")).alias("s")).agg(F.sum("proportion").alias("p")).collect()}


@query(
    "mixture_order", "W6 A23",
    f"""WITH p AS (SELECT {SOURCE} AS source, sum(proportion) AS p FROM mix_targets GROUP BY 1), s AS (SELECT doc_id, source, n, p FROM ({SIZED}) JOIN p USING (source) WHERE p > 0),
c AS (SELECT doc_id, source, (sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n)::BIGINT / p AS served FROM s) SELECT doc_id, source, row_number() OVER (ORDER BY served, source, doc_id) - 1 AS position FROM c""",
)
def _(spark, d):
    return windows.mixture_order(_sized(spark, d), _shares(spark, d), ["doc_id"], "source", "n").select("doc_id", "source", "position")


@query(
    "resumed_windows", "T13 W6",
    f"""WITH p AS (SELECT {SOURCE} AS source, sum(proportion) AS p FROM mix_targets GROUP BY 1), w AS (SELECT doc_id, source, n, p, unnest(generate_series(0, ceil(n / 1000.0)::BIGINT - 1)) AS k FROM ({SIZED}) JOIN p USING (source) WHERE p > 0 AND n > 0),
v AS (SELECT *, least(1000, n - 1000 * k) AS t FROM w), c AS (SELECT doc_id, k, t, source, (sum(t) OVER (PARTITION BY source ORDER BY doc_id, k) - t)::BIGINT / p AS served FROM v), o AS (SELECT *, row_number() OVER (ORDER BY served, source, doc_id, k) - 1 AS position FROM c)
SELECT doc_id, k::INT AS "window", t::BIGINT AS served_tokens, position FROM o WHERE position >= (SELECT count(*) // 3 FROM v)""",
)
def _(spark, d):
    rows = _sized(spark, d)
    shares = _shares(spark, d)
    # a run that stopped after a third of the windows goes on to the end
    whole = rows.filter(F.col("source").isin([k for k, p in shares.items() if p > 0]) & (F.col("n") > 0)).agg(F.coalesce(F.sum(F.ceil(F.col("n") / 1000)), F.lit(0)).alias("n")).first().n
    return windows.resumed_windows(rows, shares, ["doc_id"], 1_000, whole // 3, whole, "source", "n").select("doc_id", "window", "served_tokens", "position")


@query("media_mixture", "T12")
def _(spark, d):
    rows = table(spark, d, "samples").select("id", "text", F.from_json(F.get_json_object("payload", "$.media"), "array<struct<kind:string>>").alias("m")).dropDuplicates(["id"])
    rows = rows.select("id", F.when(F.size("m") > 0, F.coalesce(F.col("m")[0]["kind"], F.lit("image"))).otherwise("text").alias("kind"), F.length("text").cast("long").alias("tokens"), F.greatest(F.size("m"), F.lit(0)).cast("long").alias("items"))
    held = rows.groupBy("kind").agg(F.sum("tokens").alias("t"), F.sum("items").alias("i")).collect()  # a row a kind
    return windows.media_mixture(rows, {r.kind: 2 * r.i for r in held if r.kind != "text"}, sum(r.t for r in held), ["id"]).select("id", "kind", "epoch", "position")


@query("document_windows", "T8", f"SELECT doc_id, start::BIGINT AS start, least(start + 512, n)::BIGINT AS stop FROM (SELECT doc_id, n, unnest(generate_series(0, n - 2, 511)) AS start FROM ({SIZED}) WHERE n >= 2)")
def _(spark, d):
    return windows.document_windows(_sized(spark, d), "n", 512).select("doc_id", F.col("start").cast("long"), F.col("stop").cast("long"))


@query("stream_windows", "T9", f"WITH o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS o FROM ({SIZED}) WHERE n > 0) SELECT doc_id, floor(o / 2048)::BIGINT AS first_window, floor((o + n - 1) / 2048)::BIGINT AS last_window FROM o")
def _(spark, d):
    return windows.stream_windows(_sized(spark, d), "n", ["doc_id"], 2_048).select("doc_id", "first_window", "last_window")


@query("pack_records", "T10")
def _(spark, d):
    rows = _sized(spark, d).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    longest = rows.agg(F.max("n")).first()[0] or 0
    return windows.packed_in_order(rows, ["shard"], "doc_id", "n", max(8_192, longest))


@query("microbatches", "T11")
def _(spark, d):
    rows = _sized(spark, d).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    return windows.microbatches(rows, ["shard"], "doc_id", "n", "source", 8, 16_384)


@query("identity_quota", "W11")
def _(spark, d):
    rows = _sized(spark, d).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16))).withColumn("flag", F.pmod(F.col("doc_id"), F.lit(7)) == 0)
    return windows.identity_quota(rows, ["shard"], "doc_id", "n", "flag")


@query("reservoir", "L2", "SELECT doc_id FROM documents ORDER BY sha256(concat('9:', doc_id)), doc_id LIMIT 200")
def _(spark, d):
    return windows.reservoir(table(spark, d, "documents").select("doc_id"), "doc_id", "doc_id", 200, 9)


@query("rank_stride", "L4 L3", "SELECT doc_id, row_number() OVER (ORDER BY sha256(concat('2:', doc_id)), doc_id) - 1 AS place, (row_number() OVER (ORDER BY sha256(concat('2:', doc_id)), doc_id) - 1) % 4 AS worker FROM documents")
def _(spark, d):
    return windows.rank_stride(table(spark, d, "documents").select("doc_id"), "doc_id", 2, 4)


@query(
    "epoch_cursor", "L5",
    "WITH s AS (SELECT count(*) AS k FROM documents), e AS (SELECT doc_id, unnest([0, 1, 2]) AS epoch FROM documents), n AS (SELECT doc_id, epoch, row_number() OVER (ORDER BY epoch, sha256(concat('4:', epoch, ':', doc_id)), doc_id) - 1 AS position FROM e) SELECT doc_id, epoch, position FROM n, s WHERE position >= k // 2 AND position < k // 2 + 2 * k",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id")
    k = rows.count()
    return windows.epoch_cursor(rows, "doc_id", 4, k // 2, 2 * k)


@query("first_fitting", "L6", f"WITH c AS (SELECT doc_id, source, n, row_number() OVER (PARTITION BY source ORDER BY sha256(concat(source, ':', doc_id)), doc_id) AS k FROM ({SIZED}) WHERE n BETWEEN 200 AND 400) SELECT source, doc_id, n FROM c WHERE k = 1")
def _(spark, d):
    rows = _sized(spark, d).withColumn("fits", F.col("n").between(200, 400))
    return windows.first_fitting(rows, ["source"], "source", "doc_id", "fits").select("source", "doc_id", "n")


U = "((('0x' || substr(sha256(concat('6:', doc_id)), 1, 8))::UBIGINT)::DOUBLE / 4294967296)"


@query("curriculum_lengths", "L12", f"SELECT doc_id, CASE WHEN {U} < 0.5 THEN 512 WHEN {U} < 0.8 THEN 2048 ELSE 8192 END::INT AS length FROM documents")
def _(spark, d):
    u = F.conv(F.substring(windows.seeded(6, F.col("doc_id")), 1, 8), 16, 10).cast("double") / 4294967296
    return table(spark, d, "documents").select("doc_id", windows.weighted_choice(u, {512: 5, 2048: 3, 8192: 2}).alias("length"))


STEP = "SELECT DISTINCT run, step, token_ledger.ce_tokens AS ce FROM run_metrics WHERE step IS NOT NULL AND token_ledger.ce_tokens IS NOT NULL"


def _steps(spark, d):
    return table(spark, d, "run_metrics").select("run", "step", F.col("token_ledger.ce_tokens").alias("ce")).dropna().distinct()


@query("schedule_factor", "C8", f"SELECT run, step, ce, round(CASE WHEN ce < 200000 THEN least(1.0::DOUBLE, greatest(1, ce) / 200000::DOUBLE) WHEN ce <= 1000000 THEN 1 ELSE 0.1 + 0.9::DOUBLE * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (ce - 1000000) / 3000000::DOUBLE))) END, 6) AS factor FROM ({STEP})")
def _(spark, d):
    return _steps(spark, d).withColumn("factor", F.round(expr.warm_flat_cosine(F.col("ce"), 0, 200_000, 1_000_000, 4_000_000), 6))


@query("batch_schedule", "C9 C10", f"SELECT run, step, ce, CASE WHEN ce >= 1000000 THEN 32768 WHEN ce >= 300000 THEN 16384 ELSE 8192 END AS target, least(8, greatest(1, (CASE WHEN ce >= 1000000 THEN 32768 WHEN ce >= 300000 THEN 16384 ELSE 8192 END) // 4096))::BIGINT AS rows_a_step FROM ({STEP})")
def _(spark, d):
    rows = _steps(spark, d).withColumn("target", expr.schedule_target(F.col("ce"), "0:8192,300000:16384,1000000:32768"))
    return rows.withColumn("rows_a_step", expr.microbatch(F.lit(8), F.col("target"), F.lit(4096)))


@query(
    "validation_milestones", "W7",
    f"WITH b AS (SELECT run, step, ce AS after, coalesce(lag(ce) OVER (PARTITION BY run ORDER BY step, ce), 0) AS before FROM ({STEP})) SELECT run, step FROM b WHERE after > before AND (least(before, 500000) // 50000 < least(after, 500000) // 50000 OR (after > 500000 AND (greatest(before, 500000) - 500000) // 200000 < (after - 500000) // 200000))",
)
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("step", "ce")
    rows = _steps(spark, d).withColumn("before", F.coalesce(F.lag("ce").over(w), F.lit(0)))
    return rows.filter(expr.crossed(F.col("before"), F.col("ce"), 500_000, 50_000, 200_000)).select("run", "step")
