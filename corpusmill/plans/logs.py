"""Queries over metric logs and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import reports
from corpusmill.plans.registry import query
from corpusmill.session import table
from corpusmill.streaming import logs

UNIQUE = "SELECT DISTINCT run, event, step, lm_loss, step_seconds, input_batch_actual, tokens_per_second, ce_per_second, token_ledger, logged_at, received_at FROM run_metrics"
REAL = "lm_loss IS NOT NULL AND NOT isnan(lm_loss)"


def _log(spark, d):
    return table(spark, d, "run_metrics").distinct()


@query(
    "metric_scalars", "P17 C13",
    f"""WITH r AS ({UNIQUE}), s AS (
SELECT run, step, CASE WHEN event = 'validation' THEN 'eval/' ELSE 'train/' END || 'lm_loss' AS tag, lm_loss AS value FROM r WHERE event IN ('train', 'validation') OR event IS NULL
UNION ALL SELECT run, step, CASE WHEN event = 'validation' THEN 'eval/' ELSE 'perf/' END || 'step_seconds', step_seconds FROM r WHERE event IN ('train', 'validation') OR event IS NULL
UNION ALL SELECT run, step, CASE WHEN event = 'validation' THEN 'eval/' ELSE 'train/' END || 'input_batch_actual', input_batch_actual::DOUBLE FROM r WHERE event IN ('train', 'validation') OR event IS NULL
UNION ALL SELECT run, step, CASE WHEN event = 'validation' THEN 'eval/tokens_per_second' ELSE 'perf/ce_per_second' END, tokens_per_second FROM r WHERE (event IN ('train', 'validation') OR event IS NULL) AND (event = 'validation' OR ce_per_second IS NULL)
UNION ALL SELECT run, step, CASE WHEN event = 'validation' THEN 'eval/' ELSE 'perf/' END || 'ce_per_second', ce_per_second FROM r WHERE event IN ('train', 'validation') OR event IS NULL
UNION ALL SELECT run, step, 'perf/input_per_second', input_batch_actual / step_seconds FROM r WHERE (event = 'train' OR event IS NULL) AND input_batch_actual > 0 AND step_seconds > 0
UNION ALL SELECT run, step, 'train/ce_tokens', token_ledger.ce_tokens::DOUBLE FROM r WHERE event = 'train' OR event IS NULL
UNION ALL SELECT run, step, 'train/input_tokens', token_ledger.input_tokens::DOUBLE FROM r WHERE event = 'train' OR event IS NULL
UNION ALL SELECT run, step, 'train/images', token_ledger.images::DOUBLE FROM r WHERE event = 'train' OR event IS NULL)
SELECT tag, count(*) AS n, round(sum(value), 2) AS total FROM s WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY tag""",
)
def _(spark, d):
    rows = _log(spark, d).withColumn("event", F.coalesce("event", F.lit("train")))
    return reports.scalars(rows, "pretrain").groupBy("tag").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("latest_per_run", "W8", "SELECT run, max_by(lm_loss, (logged_at, step, lm_loss)) FILTER (WHERE lm_loss IS NOT NULL) AS lm_loss, max_by(step, (logged_at, step, step)) FILTER (WHERE step IS NOT NULL) AS step FROM (SELECT run, logged_at, step, max(CASE WHEN NOT isnan(lm_loss) THEN lm_loss END) AS lm_loss FROM run_metrics WHERE logged_at IS NOT NULL AND step IS NOT NULL GROUP BY 1, 2, 3) GROUP BY run")
def _(spark, d):
    rows = table(spark, d, "run_metrics").filter("logged_at is not null and step is not null").groupBy("run", "logged_at", "step").agg(F.max(F.when(~F.isnan("lm_loss"), F.col("lm_loss"))).alias("lm_loss"))
    return reports.latest_fields(rows.withColumn("s", F.col("step")), "run", ["logged_at", "s"], ["lm_loss", "step"])


TRAIN = "SELECT run, step, max(step_seconds) AS step_seconds, max(input_batch_actual) AS inputs, max(CASE WHEN NOT isnan(ce_per_second) THEN ce_per_second END) AS speed, max(token_ledger.ce_tokens) AS ce FROM run_metrics WHERE event = 'train' AND step IS NOT NULL GROUP BY run, step"


def _train(spark, d):
    rows = table(spark, d, "run_metrics").filter("event = 'train' and step is not null")
    return rows.groupBy("run", "step").agg(F.max("step_seconds").alias("step_seconds"), F.max("input_batch_actual").alias("inputs"), F.max(F.when(~F.isnan("ce_per_second"), F.col("ce_per_second"))).alias("speed"), F.max("token_ledger.ce_tokens").alias("ce"))


@query("last20_mean", "W13 A16", f"SELECT run, step, round(avg(speed) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS mean_20 FROM ({TRAIN})")
def _(spark, d):
    return reports.last_mean(_train(spark, d), "run", ["step"], "speed").select("run", "step", F.round("mean_20", 4).alias("mean_20"))


@query(
    "run_progress", "A16",
    f"WITH t AS ({TRAIN}), n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, ce DESC) AS k FROM t WHERE speed IS NOT NULL), s AS (SELECT run, avg(speed) AS v, max(ce) AS done FROM n WHERE k <= 20 GROUP BY run) SELECT run, done, round(least(1.0, done / 5000000), 6) AS progress, round(greatest(0, 5000000 - done) / v / 3600, 6) AS eta_hours FROM s",
)
def _(spark, d):
    return reports.progress(_train(spark, d), "run", "ce", "speed", 5_000_000, ["step", "ce"])


@query("update_inputs", "A14", f"SELECT run, min(inputs) AS min_input, round(avg(inputs), 4) AS mean_input, max(inputs) AS max_input, count(inputs) AS updates FROM ({TRAIN}) GROUP BY run")
def _(spark, d):
    return reports.update_inputs(_train(spark, d), "run", "inputs")


EVENTS = "SELECT run, logged_at, max(event) AS event FROM run_metrics WHERE logged_at IS NOT NULL AND event IS NOT NULL GROUP BY 1, 2"


@query("state_changes", "W9 X2", f"SELECT run, logged_at, before, event FROM (SELECT *, lag(event) OVER (PARTITION BY run ORDER BY logged_at) AS before FROM ({EVENTS})) WHERE before IS DISTINCT FROM event")
def _(spark, d):
    rows = table(spark, d, "run_metrics").filter("logged_at is not null and event is not null").groupBy("run", "logged_at").agg(F.max("event").alias("event"))
    return reports.state_changes(rows, "run", ["logged_at"], "event").select("run", "logged_at", "before", "event")


@query("state_histogram", "A15 A25", f"SELECT state, count(*) AS runs FROM (SELECT run, max_by(event, logged_at) AS state FROM ({EVENTS}) GROUP BY run) GROUP BY state")
def _(spark, d):
    rows = table(spark, d, "run_metrics").filter("logged_at is not null and event is not null").groupBy("run", "logged_at").agg(F.max("event").alias("event"))
    return reports.latest_fields(rows, "run", ["logged_at"], ["event"]).groupBy(F.col("event").alias("state")).agg(F.count("*").alias("runs"))


@query("stale_runs", "X4", "WITH n AS (SELECT max(received_at) AS now FROM run_metrics), l AS (SELECT run, max(received_at) AS last_seen FROM run_metrics GROUP BY run) SELECT run, last_seen, (floor(epoch(now)) - floor(epoch(last_seen)))::BIGINT AS age_seconds, floor(epoch(now)) - floor(epoch(last_seen)) > 900 AS is_stale FROM l, n")
def _(spark, d):
    rows = table(spark, d, "run_metrics")
    now = rows.agg(F.max("received_at").alias("now")).first().now
    return reports.stale(rows, "run", "received_at", F.lit(now), 900)


@query("run_findings", "A22", f"SELECT run, string_agg(f, ',' ORDER BY f) AS findings FROM (SELECT run, unnest(list_filter([CASE WHEN count(speed) = 0 THEN 'missing_speed' END, CASE WHEN max(ce) IS NULL THEN 'missing_ce' END, CASE WHEN max(ce) > 2000000 + 8192 THEN 'overshoot' END], lambda x: x IS NOT NULL)) AS f FROM ({TRAIN}) GROUP BY run) GROUP BY run")
def _(spark, d):
    rows = _train(spark, d).groupBy("run").agg(F.max("speed").alias("speed"), F.max("ce").alias("ce")).withColumn("target", F.lit(2_000_000))
    out = reports.findings(rows, ["speed", "ce"], "target", "ce", F.lit(8_192))
    return out.filter(F.size("findings") > 0).select("run", F.array_join(F.array_sort("findings"), ",").alias("findings"))


@query("double_active", "W10 E6", f"SELECT substr(run, 1, 6) AS output, count(*) AS owners FROM (SELECT run, max_by(event, logged_at) AS state FROM ({EVENTS}) GROUP BY run) WHERE state IN ('train', 'validation') GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    rows = table(spark, d, "run_metrics").filter("logged_at is not null and event is not null").groupBy("run", "logged_at").agg(F.max("event").alias("event"))
    last = reports.latest_fields(rows, "run", ["logged_at"], ["event"]).withColumn("output", F.substring("run", 1, 6))
    return reports.double_active(last, "output", "event", ("train", "validation"))


@query("run_families", "J14 S15", "SELECT run AS path, CASE WHEN n = 1 THEN f END AS family, n AS hits FROM (SELECT run, max(f) AS f, count(f) AS n FROM (SELECT DISTINCT run FROM run_metrics) LEFT JOIN (VALUES ('run-0%', 'first'), ('run-%a', 'ends_in_a'), ('run-1%', 'second')) p(g, f) ON run LIKE g GROUP BY run)")
def _(spark, d):
    runs = table(spark, d, "run_metrics").select(F.col("run").alias("path")).distinct()
    patterns = spark.createDataFrame([("first", "run-0*"), ("ends_in_a", "run-*a"), ("second", "run-1*")], "family string, pattern string")
    return reports.family_of(runs, patterns)


@query(
    "run_assembly", "J10 P13",
    f"WITH s AS (SELECT run AS name, max_by(event, logged_at) AS state, max(logged_at) AS at FROM ({EVENTS}) GROUP BY run), p AS (SELECT DISTINCT run AS name FROM run_metrics) SELECT 'exp-' || substr(sha256(concat('host:', p.name)), 1, 12) AS experiment, p.name, coalesce(s.state, 'planned') AS state FROM p LEFT JOIN s USING (name)",
)
def _(spark, d):
    from corpusmill.functions.expr import short_id

    log = table(spark, d, "run_metrics")
    rows = log.filter("logged_at is not null and event is not null").groupBy("run", "logged_at").agg(F.max("event").alias("event"))
    queue = rows.select(F.col("run").alias("name"), F.col("event").alias("state"), F.col("logged_at").alias("updated_at"))
    plans = log.select(F.col("run").alias("name")).distinct()
    out = reports.assembled(plans, queue, queue.select("name", F.lit(None).cast("string").alias("state")).distinct())
    return out.select(short_id(F.lit("host"), F.col("name")).alias("experiment"), "name", "state")


@query("event_windows", "C12 A14", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    out = logs.windowed(table(spark, d, "events"), "ts", "6 hours", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("start", "event_type", "n", "total")


@query(
    "event_sessions", "C12",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 10 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def _(spark, d):
    return logs.sessions(table(spark, d, "events"), "ts", "10 hours", ["user_id"], F.count("*").alias("n")).select("user_id", "start", "n")


@query("event_running", "W13 C13", "SELECT event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS cents, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)::BIGINT AS last_20 FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return rows.select("event_id", F.sum("c").over(w).alias("cents"), F.sum("c").over(w.rowsBetween(-19, 0)).alias("last_20"))
