"""Ordered operators: budgets, mixtures, quotas, token windows, packing, sampling.

Global running sums go by range partitions with offsets, so that no task holds all rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import written


def running(rows: DataFrame, value: str, order: list[str], keys: list[str] | None = None, name: str = "cum") -> DataFrame:
    """rows with the running sum of value up to and including each row, in the order given.

    The sum runs over all rows, or within each of the keys. Rows are sorted by range partitions,
    and every partition adds the totals of those before it, so a key that a third of the rows
    share is spread over many tasks. Null values count as 0; a null key is a key.
    """
    keys = keys or []
    v = F.coalesce(F.col(value), F.lit(0))
    # written, since partition numbers must not change between the two passes
    part = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = part.groupBy(*keys, "_part").agg(F.sum(v).alias("_s"))  # a row a partition and key in it
    earlier = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    before = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (F.sum("_s").over(earlier) - F.col("_s")).alias("_before"))
    same = part["_part"] == before["_p"]
    for i, k in enumerate(keys):
        same = same & part[k].eqNullSafe(before[f"_k{i}"])
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = part.withColumn("_own", F.sum(v).over(w))
    return own.join(before, same).withColumn(name, F.col("_own") + F.col("_before")).select(*rows.columns, name)


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """rows numbered from 0 in an order, by range partitions."""
    return running(rows.withColumn("_one", F.lit(1)), "_one", order, name=name).withColumn(name, F.col(name) - 1).drop("_one")


def prefix_under(rows: DataFrame, value: str, order: list[str], budget: int) -> DataFrame:
    """Rows before the first that would exceed the budget; it and all behind are left out."""
    return running(rows, value, order).filter(F.col("cum") <= budget).drop("cum")


def prefix_over(rows: DataFrame, value: str, order: list[str], budget: int, keys: list[str] | None = None) -> DataFrame:
    """Rows up to and including the one that reaches the budget."""
    return running(rows, value, order, keys).filter(F.col("cum") - F.coalesce(F.col(value), F.lit(0)) < budget).drop("cum")


def first_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of every key. Spark keeps n rows a key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def offsets(rows: DataFrame, length: str, order: list[str]) -> DataFrame:
    """rows with the offset of their tokens in one concatenated file."""
    return running(rows, length, order).withColumn("offset", F.col("cum") - F.coalesce(F.col(length), F.lit(0))).drop("cum")


def shards(rows: DataFrame, tokens: str, order: list[str], size: int) -> DataFrame:
    """rows with the number of the shard that they begin in, shards being of `size` tokens."""
    return offsets(rows, tokens, order).withColumn("shard", F.floor(F.col("offset") / size))


def mixture_order(rows: DataFrame, proportions: dict[str, float], order: list[str], domain: str = "domain", count: str = "tokens") -> DataFrame:
    """rows with `position`: the order of a sampler that always serves the domain furthest behind its share.

    Equals the loop "next domain is the one with the least served / proportion, ties by name".
    Domains without a positive proportion are left out.
    """
    known = [k for k, p in proportions.items() if p > 0]
    share = F.create_map(*[x for k in known for x in (F.lit(k), F.lit(float(proportions[k])))])
    own = running(rows.filter(F.col(domain).isin(known)), count, order, [domain])
    behind = own.withColumn("served", (F.col("cum") - F.coalesce(F.col(count), F.lit(0))) / share[F.col(domain)])
    return numbered(behind, ["served", domain, *order], "position").drop("cum")


def review_quota(counts: DataFrame, seats: int, group: list[str], stratum: str, size: str) -> DataFrame:
    """group, stratum, seats: seats by highest size / (held + 1), one for each stratum first, ties by stratum descending.

    counts: a row a stratum; sizes limit the seats.
    """
    one = counts.select(*group, stratum, size, F.explode(F.sequence(F.lit(1), F.least(F.col(size), F.lit(seats)).cast("int"))).alias("j"))
    w = Window.partitionBy(*group).orderBy(F.when(F.col("j") > 1, 1).otherwise(0), F.desc(F.col(size) / F.col("j")), F.desc(stratum))
    return one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= seats).groupBy(*group, stratum).agg(F.count("*").alias("seats"))


def document_windows(rows: DataFrame, size: str, length: int) -> DataFrame:
    """rows with `start` and `stop` of every window of a document; windows overlap by one and never cross documents.

    Starts are 0, L - 1, ... below n - 1; a document of fewer than two tokens has none.
    """
    starts = F.when(F.col(size) >= 2, F.sequence(F.lit(0), (F.col(size) - 2).cast("int"), F.lit(length - 1)))
    return rows.withColumn("start", F.explode(starts)).withColumn("stop", F.least(F.col("start") + length, F.col(size).cast("int")))


def stream_windows(rows: DataFrame, size: str, order: list[str], length: int) -> DataFrame:
    """rows with first_window and last_window in a stream of all documents cut every `length` tokens."""
    o = offsets(rows.filter(F.col(size) > 0), size, order)
    return o.withColumn("first_window", F.floor(F.col("offset") / length)).withColumn("last_window", F.floor((F.col("offset") + F.col(size) - 1) / length)).drop("offset")


def folded(rows: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """A true fold: step(frame) per key on rows the caller has made small enough for one task."""
    return rows.groupBy(*keys).applyInPandas(step, schema)


def packed_in_order(rows: DataFrame, keys: list[str], order: str, size: str, capacity: int) -> DataFrame:
    """keys, order, size, pack, segment, start: whole records put into the open pack in order, a new one when full.

    A record longer than the capacity is an error. Keys are shards that bound what one task folds.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*keys, order, size]
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", pack int, segment int, start long"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        pack = segment = start = 0
        out = []
        for n in pdf[size]:
            if n > capacity:
                raise ValueError("a record is longer than the capacity")
            if start + n > capacity:
                pack, segment, start = pack + 1, 0, 0
            out.append((pack, segment, start))
            segment, start = segment + 1, start + int(n)
        pdf[["pack", "segment", "start"]] = pd.DataFrame(out, columns=["pack", "segment", "start"], index=pdf.index)
        return pdf

    return folded(rows.select(*names), keys, step, schema)


def microbatches(rows: DataFrame, keys: list[str], order: str, size: str, phase: str, most: int, padded: int) -> DataFrame:
    """keys, order, size, phase, batch: batches in order, closed by count, padded size or a change of phase."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*keys, order, size, phase]
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", batch int"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        batch, held, longest, current, out = 0, 0, 0, None, []
        for n, p in zip(pdf[size], pdf[phase], strict=True):
            if held and (held == most or max(longest, n) * (held + 1) > padded or p != current):
                batch, held, longest = batch + 1, 0, 0
            held, longest, current = held + 1, max(longest, n), p if held == 0 else current
            out.append(batch)
        pdf["batch"] = out
        return pdf

    return folded(rows.select(*names), keys, step, schema)


def identity_quota(rows: DataFrame, keys: list[str], order: str, count: str, flag: str, share: float = 0.005) -> DataFrame:
    """keys, order, count, flag, kept: flagged rows are kept while they stay within a share of what was admitted."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*keys, order, count, flag]
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", kept boolean"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        all_, own, kept = 0, 0, []
        for n, f in zip(pdf[count], pdf[flag], strict=True):
            ok = not f or own + n <= share * (all_ + n)
            if ok:
                all_ += n
                own += n if f else 0
            kept.append(bool(ok))
        pdf["kept"] = kept
        return pdf

    return folded(rows.select(*names), keys, step, schema)


def media_mixture(rows: DataFrame, goals: dict[str, int], budget: int, order: list[str], kind: str = "kind", tokens: str = "tokens", items: str = "items") -> DataFrame:
    """rows with `epoch`, `due` and `position`: kinds of media spread evenly over the tokens of a run.

    rows: a kind, tokens, and the number of pictures or clips of that kind; goals: kind -> items
    wanted by the end of the budget. A row is due at the share of its kind that is served before
    it: items against the goal, and for kinds without a goal tokens against what the budget
    leaves them together. Rows are served as they are due, media before text, in `order`; a kind
    that ends too early starts again. The place of a row is a rank, so no sampler has to be run.
    """
    goals = {k: g for k, g in goals.items() if g > 0}
    goal = F.create_map(*[x for k, g in goals.items() for x in (F.lit(k), F.lit(float(g)))]) if goals else F.lit(None).cast("map<string,double>")
    lane = rows.withColumn("_goal", F.try_element_at(goal, F.col(kind))).withColumn("_lane", F.when(F.col("_goal").isNotNull(), F.col(kind)).otherwise(""))
    lane = lane.withColumn("_v", F.when(F.col("_goal").isNotNull(), F.col(items)).otherwise(F.col(tokens)))
    held = {r["_lane"]: (r.v or 0, r.t or 0) for r in lane.groupBy("_lane").agg(F.sum("_v").alias("v"), F.sum(tokens).alias("t")).collect()}  # a row a kind
    media = sum(t * goals[k] / v for k, (v, t) in held.items() if k and v)
    wanted = {k: goals.get(k, max(0, budget - media)) for k, (v, _) in held.items() if v}
    plan = rows.sparkSession.createDataFrame([(k, float(w), float(held[k][0]), math.ceil(w / held[k][0])) for k, w in wanted.items() if w > 0], "_lane string, _wanted double, _held double, _epochs int")
    own = running(lane, "_v", ["_lane", *order], ["_lane"], "_cum").join(F.broadcast(plan), "_lane")
    each = own.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
    due = each.withColumn("due", (F.col("epoch") * F.col("_held") + F.col("_cum") - F.col("_v")) / F.col("_wanted")).filter("due < 1")
    placed = numbered(due.withColumn("_last", F.col("_lane") == ""), ["due", "_last", "_lane", "epoch", *order], "position")
    return placed.select(*rows.columns, "epoch", "due", "position")


def resumed_windows(rows: DataFrame, proportions: dict[str, float], order: list[str], length: int, start: int, count: int, domain: str = "domain", size: str = "tokens") -> DataFrame:
    """The `count` windows from `start` on of a mixture of documents cut into windows, with `window` and `position`.

    Documents are cut every `length` tokens, the domain furthest behind its share serves its next
    window, so a sampler that stopped inside a document goes on with the window after.
    """
    n = F.ceil(F.col(size) / length).cast("int")
    cut = rows.filter(F.col(size) > 0).withColumn("window", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = cut.withColumn("begin", F.col("window") * length).withColumn("served_tokens", F.least(F.lit(length), F.col(size) - F.col("begin")))
    placed = mixture_order(cut, proportions, [*order, "window"], domain, "served_tokens")
    return placed.filter(F.col("position").between(start, start + count - 1)).select(*rows.columns, "window", "begin", "served_tokens", "position")


# ---------------------------------------------------------------- sampling


def seeded(seed: int | str, *parts: Column) -> Column:
    """Sort key of a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def reservoir(rows: DataFrame, key: str, order: str, k: int, seed: int = 0) -> DataFrame:
    """k rows, each set equally likely, returned in source order. Distribution as Algorithm R, not its picks."""
    return rows.orderBy(seeded(seed, F.col(key)), key).limit(k).orderBy(order)


def rank_stride(rows: DataFrame, key: str, seed: int, world: int) -> DataFrame:
    """rows with their place in a fixed permutation and the worker that takes them."""
    return numbered(rows.withColumn("_s", seeded(seed, F.col(key))), ["_s", key], "place").withColumn("worker", F.col("place") % world).drop("_s")


def epoch_cursor(rows: DataFrame, key: str, seed: int, start: int, count: int) -> DataFrame:
    """The rows at `count` positions from `start` of an endless stream of reshuffled epochs, with epoch and position."""
    size = rows.count()
    if not size or count <= 0:
        return rows.withColumn("epoch", F.lit(0)).withColumn("position", F.lit(0).cast("long")).limit(0)
    first, last = start // size, (start + count - 1) // size
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(last))))
    out = numbered(each.withColumn("_s", seeded(seed, F.col("epoch"), F.col(key))), ["epoch", "_s", key], "position")
    return out.withColumn("position", F.col("position") + first * size).filter(F.col("position").between(start, start + count - 1)).drop("_s")


def weighted_choice(u: Column, weights: dict[int, float]) -> Column:
    """The value in whose cumulative weight a number of [0, 1) falls."""
    whole, cum, out = sum(weights.values()), 0.0, None
    for value, w in weights.items():
        cum += w / whole
        out = F.when(u < cum, value) if out is None else out.when(u < cum, value)
    return out.otherwise(list(weights)[-1])


def context_length(u: Column, phase_count: Column, weights: dict[int, float], most: int, ramp_length: int | None = None, ramp: int = 10_000_000) -> Column:
    """A random length of a curriculum; one length's weight may ramp up with a phase's progress."""
    own = {k: w for k, w in weights.items() if k <= most}
    if not own:
        raise ValueError("no length fits")
    w = [F.lit(v) * F.least(F.lit(1.0), phase_count / ramp) if k == ramp_length else F.lit(v) for k, v in own.items()]
    whole = w[0]
    for x in w[1:]:
        whole = whole + x
    cum, out = F.lit(0.0), None
    for k, x in zip(own, w, strict=True):
        cum = cum + x
        out = F.when(u * whole < cum, k) if out is None else out.when(u * whole < cum, k)
    return out.otherwise(list(own)[-1])


def first_fitting(rows: DataFrame, keys: list[str], identity: str, index: str, fits: str, seed: str = "") -> DataFrame:
    """For every key the first candidate that fits, in the order of sha256(identity:index)."""
    h = F.sha2(F.concat_ws(":", F.concat(F.lit(seed), F.col(identity).cast("string")), F.col(index).cast("string")), 256)
    names = rows.columns
    return rows.filter(F.col(fits)).groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(h.alias("h"), F.col(index))).alias("_r")).select("_r.*")
