"""Problem 3: splits that keep related records together.

Records are related through link keys and group roots; components of that relation get one
split each. The assignment starts from a hash of the component, then whole components are
moved and exchanged by annealing: large components first, against the whole deviation; then
the others in parallel, in parts of bounded size, each part correcting its share of what is
left. Several chains run side by side; the best state of all rounds is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import squeezed
from corpusmill.llm.base import samples
from corpusmill.operators.graph import components, star_edges
from corpusmill.session import forget, table, written

#: Components in one annealing task, and rounds and chains of the search.
PART, ROUNDS, CHAINS = 20_000, 3, 2
#: Labels that have a count of their own; rarer ones share CELLS counts by hash, each of which is balanced.
LABELS, CELLS = 31, 16
#: A component is large from this share of the smallest split on, so there are 20 / share at most.
LARGE = 0.05


def membership(links: DataFrame, records: DataFrame) -> DataFrame:
    """(id, key): every key of every record; link keys and group roots don't mix.

    Keys are compared squeezed (NFKC, case folded, no white space). Null or blank keys and ids
    without a record are dropped.
    """
    ids = records.select("id").dropna().distinct()
    by_link = links.select("id", F.concat(F.lit("k:"), squeezed(F.col("key"))).alias("key")).filter("key != 'k:'").distinct().join(ids, "id", "left_semi")
    by_root = records.select("id", F.concat(F.lit("r:"), squeezed(F.col("group_root"))).alias("key")).filter("id is not null and key != 'r:'").distinct()
    return by_link.unionByName(by_root)


def record_groups(links: DataFrame, records: DataFrame) -> DataFrame:
    """(id, group_id) of all records; group_id is the smallest id of the group."""
    ids = records.select("id").dropna().distinct()
    comps = components(star_edges(membership(links, records), "id", "key"))
    return ids.join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("group_id"))


def broken(links: DataFrame, records: DataFrame) -> DataFrame:
    """(id, group_id, splits): records of groups that hold two or more non-null splits."""
    comps = components(star_edges(membership(links, records), "id", "key")).select(F.col("node").alias("id"), F.col("root").alias("group_id"))
    own = comps.join(records.select("id", "split").dropDuplicates(["id"]), "id")
    bad = own.groupBy("group_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.countDistinct("split").alias("splits")).filter("lo != hi")
    return own.join(bad.select("group_id", "splits"), "group_id").select("id", "group_id", "splits")


# ---------------------------------------------------------------- assignment


def deviation(held: np.ndarray, goal: np.ndarray) -> float:
    """Sum of squared deviations, size fully and labels by a quarter, relative to the goals."""
    scale = np.maximum(goal.sum(axis=0, keepdims=True), 1.0)
    d = (held - goal) / scale
    return float((d[:, 0] ** 2).sum() + 0.25 * (d[:, 1:] ** 2).sum() / max(1, d.shape[1] - 1))


def anneal(weights: np.ndarray, at: np.ndarray, surplus: np.ndarray, scale: np.ndarray, seed: int) -> np.ndarray:
    """Splits of some components after moves and exchanges that bring the surplus to nothing.

    weights: (components, 1 + labels); surplus: (splits, 1 + labels), what these components
    hold too much in their present splits.
    """
    rng = np.random.default_rng(seed)
    n, splits = len(at), len(surplus)
    if n == 0 or splits < 2:
        return at
    factor = np.full(weights.shape[1], 0.25 / max(1, weights.shape[1] - 1))
    factor[0] = 1.0
    w, d, at = weights / scale, surplus / scale, at.copy()
    cost = float((d**2 * factor).sum())
    best, kept, log = cost, 0, []
    steps = 4 * n + 500  # n is PART or so at most
    heat, cool = max(cost / 50, 1e-14), (1e-4) ** (1 / steps)
    who, other, to, swap, luck = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, splits, steps), rng.random(steps) < 0.3, rng.random(steps)
    start = at.copy()
    for k in range(steps):
        i, j, heat = who[k], other[k], heat * cool
        a = at[i]
        b = at[j] if swap[k] else to[k]
        if a == b:
            continue
        move = w[i] - w[j] if swap[k] else w[i]
        change = float((factor * (2 * move * (d[b] - d[a]) + 2 * move * move)).sum())
        if change < 0 or luck[k] < math.exp(-min(change / heat, 700.0)):
            d[a] -= move
            d[b] += move
            at[i] = b
            log.append((i, b))
            if swap[k]:
                at[j] = a
                log.append((j, a))
            cost += change
            if cost < best:
                best, kept = cost, len(log)
    for i, b in log[:kept]:  # the best state on the way
        start[i] = b
    return start


def _annealing(surplus: np.ndarray, parts: int, scale: np.ndarray, turn: int):
    def on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id", ignore_index=True)
        chain, part = int(pdf["chain"].iloc[0]), int(pdf["part"].iloc[0])
        fair = surplus[chain] / (1 if part == -1 else parts)
        pdf["at"] = anneal(np.array(pdf["w"].tolist(), dtype=float), pdf["at"].to_numpy(), fair, scale, 1000 * turn + 100 * chain + part + 7)
        return pdf[["group_id", "w", "chain", "at"]]

    return on


def assign(groups: DataFrame, plan: list[tuple[str, float]]) -> DataFrame:
    """(group_id, split) for every group so that the shares of the plan are met.

    groups: id, group_id, label (null is a label of its own). Shares are scaled to sum 1. The
    result depends on nothing but the rows and the plan. An empty plan is an error.
    """
    spark = groups.sparkSession
    plan = [(n, s) for n, s in plan if n is not None and s and s > 0]
    total_share = sum(s for _, s in plan)
    if not total_share:
        raise ValueError("the plan has no positive share")
    plan = sorted((n, s / total_share) for n, s in plan)
    labels = [r.label for r in groups.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LABELS + 1).collect()]
    rare = len(labels) > LABELS
    labels = labels[:LABELS]
    mine = [F.col("label").eqNullSafe(F.lit(x)) for x in labels]
    if rare:
        own = F.coalesce(F.col("label").isin([x for x in labels if x is not None]), F.lit(None in labels))
        mine += [~own & (F.pmod(F.xxhash64("label"), F.lit(CELLS)) == c) for c in range(CELLS)]
    width = len(mine) + 1
    base = groups.groupBy("group_id").agg(F.array(F.count("*"), *[F.count(F.when(m, 1)) for m in mine]).alias("w"))
    u = F.pmod(F.xxhash64("group_id", "chain"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    at = F.lit(len(plan) - 1)
    for k in range(len(plan) - 2, -1, -1):
        at = F.when(u < sum(s for _, s in plan[: k + 1]), k).otherwise(at)
    state = written(base.withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(CHAINS)]))).withColumn("at", at.cast("int")))
    number = max(1, state.count() // CHAINS)
    parts = max(1, math.ceil(number / PART))

    def held(state: DataFrame) -> np.ndarray:
        out = np.zeros((CHAINS, len(plan), width))
        for r in state.groupBy("chain", "at").agg(*[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(width)]).collect():  # chains x splits rows
            out[r.chain, r["at"]] = [r[f"w{i}"] for i in range(width)]
        return out

    now = held(state)
    whole = now[0].sum(axis=0)
    goal = np.array([s for _, s in plan])[:, None] * whole[None, :]
    scale = np.maximum(whole, 1.0)
    large = max(2.0, LARGE * whole[0] * min(s for _, s in plan))
    best = min(((deviation(now[c], goal), 0, c) for c in range(CHAINS)), default=(math.inf, 0, 0))
    kept = state
    for turn in range(ROUNDS + 1):
        # the large ones move in the first turn only, the others in the later ones
        is_large = F.col("w")[0] >= large
        spread = F.pmod(F.xxhash64("group_id", F.lit(turn)), F.lit(parts))
        stay = state.filter(~is_large if turn == 0 else is_large)
        moved = state.filter(is_large if turn == 0 else ~is_large).withColumn("part", (F.lit(-1) if turn == 0 else spread).cast("int"))
        last, state = state, written(stay.unionByName(moved.groupBy("chain", "part").applyInPandas(_annealing(now - goal[None], parts, scale, turn), state.schema)))
        now = held(state)
        here = min((deviation(now[c], goal), turn + 1, c) for c in range(CHAINS))
        for old in {id(x): x for x in (last, kept)}.values():  # only the best state and the last are kept
            if old is not (kept if here >= best else None):
                forget(old)
        if here < best:
            best, kept = here, state
    name = F.lit(plan[-1][0])
    for k in range(len(plan) - 1):
        name = F.when(F.col("at") == k, plan[k][0]).otherwise(name)
    return kept.filter(F.col("chain") == best[2]).select("group_id", name.alias("split"))


# ---------------------------------------------------------------- queries


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "links").select("id", "key"), samples(spark, sf_dir, "id", "group_root", "split", "task")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id: every record of a group that holds two or more different non-null splits.

    Groups come from the same components that assignment() keeps together. Null keys, roots
    and splits, and ids without a record connect nothing; empty tables give no row.
    """
    return broken(*_tables(spark, sf_dir)).select("id")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, records = _tables(spark, sf_dir)
    own = record_groups(links, records)
    labels = records.select("id", F.col("task").alias("label"), F.col("split").alias("old")).dropDuplicates(["id"])
    groups = written(own.join(labels, "id"))
    plan = [(r.split, r.share) for r in table(spark, sf_dir, "split_plan").collect()]
    return groups.join(assign(groups, plan), "group_id")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, group_id, split: one split for all records of a group, shares as in split_plan."""
    return _assigned(spark, sf_dir).select("id", "group_id", "split")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, share, reached, records, moved: planned and reached shares, and records whose split changes."""
    done = _assigned(spark, sf_dir).groupBy("split").agg(F.count("*").alias("records"), F.sum(F.when(F.col("old").eqNullSafe(F.col("split")), 0).otherwise(1)).alias("moved"))
    plan = table(spark, sf_dir, "split_plan").filter("share > 0").select("split", "share")
    from pyspark.sql import Window

    shares = plan.join(done, "split", "left").na.fill(0, ["records", "moved"])
    w = Window.partitionBy(F.lit(1))  # one row a split
    return shares.select("split", F.round(F.col("share") / F.sum("share").over(w), 6).alias("share"), F.round(F.col("records") / F.sum("records").over(w), 6).alias("reached"), "records", "moved")
