"""Counts, metric logs, run registries and evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import expr


def slice_counts(rows: DataFrame, keys: list[str], root: str = "group_root", tokens: str = "tokens") -> DataFrame:
    """keys, records, groups, tokens. Null tokens count 0."""
    return rows.groupBy(*keys).agg(F.count("*").alias("records"), F.countDistinct(root).alias("groups"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))


def distinct_media(rows: DataFrame, media: str, field: str, key: str = "split") -> DataFrame:
    """key, media: distinct values of a field of nested media."""
    return rows.select(key, F.explode(media).alias("_m")).groupBy(key).agg(F.countDistinct(F.col(f"_m.{field}")).alias("media"))


def length_histogram(rows: DataFrame, keys: list[str], length: str) -> DataFrame:
    """keys, class, records: lengths by 512, 1024, 2048, 4096, 8192, over. Null lengths have class null."""
    return rows.groupBy(*keys, expr.length_class(F.col(length)).alias("class")).agg(F.count("*").alias("records"))


def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: the mode; the smallest value wins ties. Nulls don't vote."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", (-F.col(value)).alias("v"))).alias(value), F.max("n").alias("votes"))


def reconciled(computed: DataFrame, stated: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows where recomputed counters and stated ones differ, either missing included."""
    c = computed.select(*keys, *[F.col(v).alias(f"computed_{v}") for v in values])
    s = stated.select(*keys, *[F.col(v).alias(f"stated_{v}") for v in values])
    bad = None
    for v in values:
        d = ~F.col(f"computed_{v}").eqNullSafe(F.col(f"stated_{v}"))
        bad = d if bad is None else bad | d
    return c.join(s, keys, "full").filter(bad)


def nested_profile(rows: DataFrame, keys: list[str], items: str) -> DataFrame:
    """keys, item, records: rows by an array's items (families, findings)."""
    return rows.select(*keys, F.explode_outer(items).alias("item")).groupBy(*keys, "item").agg(F.count("*").alias("records"))


def share_profile(rows: DataFrame, source: str, count: str, targets: DataFrame) -> DataFrame:
    """source, tokens, share, target: real shares against target shares; either side may be missing."""
    own = rows.groupBy(source).agg(F.sum(count).alias("tokens"))
    every = Window.partitionBy(F.lit(1))  # a row a source
    j = own.join(targets.select(source, "target"), source, "full").na.fill(0, ["tokens"])
    return j.select(source, "tokens", F.round(F.col("tokens") / F.sum("tokens").over(every), 6).alias("share"), "target")


# ---------------------------------------------------------------- metric logs


def scalars(rows: DataFrame, stage: str | None = None) -> DataFrame:
    """(run, step, tag, value): numbers of a metric row routed to train/, eval/ or perf/ tags.

    Events other than train and validation give nothing. The ledger's fields yield to top-level
    ones. tokens_per_second is ce_per_second in stages that count labels, unless that is given.
    Null and non-finite values are left out.
    """
    val = F.col("event").isin("validation", "eval")
    perf = {"step_seconds", "tokens_per_second", "ce_per_second", "input_per_second"}
    top = ["lm_loss", "step_seconds", "input_batch_actual", "tokens_per_second", "ce_per_second"]
    ledger = [f for f in rows.schema["token_ledger"].dataType.names if f not in top and f not in ("optimizer_updates", "step")]
    per_second = F.when((F.col("input_batch_actual") > 0) & (F.col("step_seconds") > 0), F.col("input_batch_actual") / F.col("step_seconds"))
    items = [(n, F.col(n).cast("double")) for n in top] + [("input_per_second", F.when(~val, per_second))] + [(n, F.when(~val, F.col(f"token_ledger.{n}").cast("double"))) for n in ledger]
    out = []
    for n, v in items:
        tag = F.when(val, f"eval/{n}").otherwise(f"perf/{n}" if n in perf else f"train/{n}")
        if n == "tokens_per_second" and stage in ("pretrain", "sft", "sparse_cpt"):
            v = F.when(val | F.col("ce_per_second").isNull(), v)
            tag = F.when(val, f"eval/{n}").otherwise("perf/ce_per_second")
        out.append(F.struct(tag.alias("tag"), v.alias("value")))
    known = rows.filter(F.coalesce("event", F.lit("train")).isin("train", "validation", "eval"))
    return known.select("run", "step", F.explode(F.array(*out)).alias("s")).select("run", "step", "s.tag", "s.value").filter(expr.is_real(F.col("value")))


def latest_fields(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """key and the last value of every field that isn't null, newest row first. Combined before the shuffle."""
    o = F.struct(*order)
    return rows.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), o)).alias(f) for f in fields])


def last_mean(rows: DataFrame, key: str, order: list, value: str, n: int = 20) -> DataFrame:
    """rows with the mean of the last n values up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn(f"mean_{n}", F.avg(value).over(w))


def progress(rows: DataFrame, key: str, done: str, speed: str, target: int, order: list, n: int = 20) -> DataFrame:
    """key, done, progress, eta_hours: from the newest count and the mean of the last n speeds."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    own = rows.filter(F.col(speed).isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    s = own.groupBy(key).agg(F.avg(speed).alias("_speed"), F.max(done).alias("done"))
    return s.select(key, "done", F.round(F.least(F.lit(1.0), F.col("done") / target), 6).alias("progress"), F.round(F.greatest(F.lit(0), target - F.col("done")) / F.col("_speed") / 3600, 6).alias("eta_hours"))


def state_changes(rows: DataFrame, key: str, order: list, state: str) -> DataFrame:
    """rows whose state differs from that of the row before; the first of a key counts as a change."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("before", F.lag(state).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("before").eqNullSafe(F.col(state))).drop("_n")


def double_active(rows: DataFrame, output: str, state: str, active: tuple[str, ...] = ("running",)) -> DataFrame:
    """output, owners: outputs that more than one active row claims."""
    return rows.filter(F.col(state).isin(*active)).groupBy(output).agg(F.count("*").alias("owners")).filter("owners > 1")


def stale(rows: DataFrame, key: str, seen: str, now: Column, seconds: int) -> DataFrame:
    """key, last_seen, age_seconds, is_stale against a time that the caller gives."""
    last = rows.groupBy(key).agg(F.max(seen).alias("last_seen"))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    return last.select(key, "last_seen", age.alias("age_seconds"), (age > seconds).alias("is_stale"))


def assembled(plans: DataFrame, queue: DataFrame, runs: DataFrame, key: str = "name") -> DataFrame:
    """plans with their newest queue state and run state; a plan without either keeps nulls."""
    newest = queue.groupBy(key).agg(F.max_by("state", "updated_at").alias("queue_state"), F.max("updated_at").alias("queued_at"))
    return plans.join(newest, key, "left").join(runs.select(key, F.col("state").alias("run_state")), key, "left").withColumn("state", F.coalesce("run_state", "queue_state", F.lit("planned")))


def family_of(runs: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """path, family, hits: the one family whose glob patterns match a path; an issue row (null family) otherwise.

    patterns: family, pattern; a hand-written list, collected with a bound of 1,000 rows, so
    that the theta join is one expression over the runs.
    """
    rows = patterns.select("family", "pattern").limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("too many patterns for one expression")
    like = lambda p: p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    if not rows:
        return runs.select(path, F.lit(None).cast("string").alias("family"), F.lit(0).alias("hits"))
    hit = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(path).like(like(r.pattern)), r.family) for r in rows])))
    return runs.select(path, F.when(F.size(hit) == 1, hit[0]).alias("family"), F.size(hit).alias("hits"))


def superseded(local: DataFrame, remote: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, aliases) of local rows: dropped where a remote row has the key, with its names recorded."""
    r = remote.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("aliases"))
    return local.join(r, key, "left_anti"), local.join(r, key).select(key, F.col("name"), "aliases")


def findings(rows: DataFrame, required: list[str], target: str, reached: str, slack: Column) -> DataFrame:
    """rows with an array of findings: missing fields, and overshoot of a target by more than the slack."""
    flags = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required] + [F.when(F.col(reached) > F.col(target) + slack, F.lit("overshoot"))]
    return rows.withColumn("findings", F.array_compact(F.array(*flags)))


def update_inputs(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, min, mean, max of a value, updates."""
    return rows.groupBy(key).agg(F.min(value).alias("min_input"), F.round(F.avg(value), 4).alias("mean_input"), F.max(value).alias("max_input"), F.count(value).alias("updates"))


# ---------------------------------------------------------------- evaluation


def generation_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, correct, total, tokens of generated answers."""
    return rows.groupBy(*keys).agg(F.sum(F.col("correct").cast("int")).alias("correct"), F.count("*").alias("total"), F.sum("tokens").alias("tokens"))


def token_loss(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nll, accuracy over tokens: rows hold summed nll, correct and tokens."""
    return rows.groupBy(*keys).agg((F.sum("nll") / F.sum("tokens")).alias("nll"), (F.sum("correct") / F.sum("tokens")).alias("accuracy"))


def preference_loss(rows: DataFrame, margin: str = "margin") -> DataFrame:
    """accuracy, ties, loss of preference margins: a margin above 0 is right, 0 a tie; loss is log(1 + exp(-m))."""
    m = F.col(margin)
    softplus = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    return rows.agg(F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.when(m == 0, 1.0).otherwise(0.0)).alias("ties"), F.avg(softplus).alias("loss"))


def group_advantage(rows: DataFrame, key: str, reward: str, floor: float = 1e-4) -> DataFrame:
    """rows with (reward - mean) / max(population deviation, floor) of their group.

    Means come from an aggregate, combined before the shuffle, and a join; a group of any size is no heavy window.
    """
    s = rows.groupBy(key).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    return rows.join(s, key).withColumn("advantage", (F.col(reward) - F.col("_m")) / F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(floor))).drop("_m", "_s")


def recall_at_1(queries: DataFrame, items: DataFrame, block: int = 2048) -> DataFrame:
    """queries, hits, recall, chance: share of queries whose nearest item (dot product) has their label.

    queries: qid, q, ql; items: iid, v, l. Blocks of queries meet blocks of items on executors,
    and only the best item of each query leaves a task. Ties go to the smaller id.
    """
    from corpusmill.operators.retrieval import nearest

    best = nearest(queries, items, block)
    own = queries.select("qid", "ql").join(best, "qid").join(items.select(F.col("iid"), F.col("l")), "iid")
    total = items.groupBy("l").agg(F.count("*").alias("n")).agg(F.lit(1).alias("k"), F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("t"))
    hits = own.agg(F.lit(1).alias("k"), F.count("*").alias("queries"), F.sum(F.when(F.col("ql") == F.col("l"), 1).otherwise(0)).alias("hits"))
    return hits.join(total, "k").select("queries", "hits", F.round(F.col("hits") / F.col("queries"), 6).alias("recall"), F.round(F.col("s") / (F.col("t") * F.col("t")), 6).alias("chance"))
