"""Problem 7: sources combined to target shares of the tokens.

Sainte-Lague apportionment of blocks of equal size, twice: to the sources by highest quotients of
their proportions, none beyond what it holds times its epochs, then to the shards of each source
by their tokens. A shard's documents stand in a seeded order and are cut into blocks; its quota is
a number of whole passes over all of them and of further blocks, chosen by seed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.labels import source_key
from corpusmill.llm.sizes import token_sizes
from corpusmill.session import table, written

#: Tokens of a mixture as a share of those that its sources hold once.
FILL = 1.0
#: Blocks that a mixture is cut into while their size lies within these bounds (tokens).
BLOCKS, LEAST, MOST = 20_000, 256, 65_536
#: Rows of a shard of a source, about; there are as many shards as that needs.
SHARD_ROWS = 100_000


def sainte_lague(weights: Mapping, seats: int, caps: Mapping | None = None) -> dict:
    """Seats by highest quotients weight / (2 held + 1), ties by key; none beyond a cap.

    A bisection finds the quotient at which most seats are gone, a heap gives the last ones, so
    the time doesn't grow with the seats.
    """
    caps = caps or {}
    own = {k: (w, caps.get(k, math.inf)) for k, w in weights.items() if w > 0 and caps.get(k, 1) > 0}
    held = dict.fromkeys(weights, 0)
    if not own or seats <= 0:
        return held

    def at(q: float) -> dict:
        """Seats whose quotient is q or more."""
        return {k: int(min(c, max(0, math.floor((w / q + 1) / 2)))) for k, (w, c) in own.items()}

    high = 2 * max(w for w, _ in own.values())  # gives none
    low = min(w for w, _ in own.values()) / (2 * seats + 1)
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        if sum(at(mid).values()) <= seats:
            high = mid
        else:
            low = mid
    held |= at(high)
    left = seats - sum(held.values())
    queue = [(-w / (2 * held[k] + 1), k) for k, (w, c) in own.items() if held[k] < c]
    heapq.heapify(queue)
    while left > 0 and queue:
        _, k = heapq.heappop(queue)
        held[k] += 1
        left -= 1
        w, c = own[k]
        if held[k] < c:
            heapq.heappush(queue, (-w / (2 * held[k] + 1), k))
    return held


def mixed(sizes: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, seed: int = 11) -> DataFrame:
    """doc_id, source, tokens, repeats: which documents, how often.

    sizes: doc_id, source, tokens. total: tokens of the mixture; None takes FILL of what the
    sources hold. A source whose epochs don't reach its share is taken max_epochs times, and the
    blocks that it leaves go to the others by their quotients. Targets that are null or not
    positive, and sources without documents, give nothing. No document is taken more than
    max_epochs times; a document belongs to the block in which it begins.
    """
    spark = sizes.sparkSession
    goal: dict[str, float] = {}
    epochs: dict[str, int] = {}
    for s, p, e in targets:  # a row a source
        if s is not None and p is not None and p > 0 and (e is None or e > 0):
            goal[s] = goal.get(s, 0.0) + p
            epochs[s] = max(epochs.get(s, 0), e or 1)
    own = sizes.filter(F.col("source").isin(list(goal)) & (F.col("tokens") > 0)) if goal else sizes.limit(0)
    have = {r.source: (r.t, r.n) for r in own.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}  # a row a source
    goal = {s: p for s, p in goal.items() if s in have}
    if not goal:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, repeats int")
    total = int(FILL * sum(t for t, _ in have.values())) if total is None else total
    size = min(MOST, max(LEAST, -(-total // BLOCKS)))
    quota = sainte_lague(goal, total // size, {s: -(-have[s][0] // size) * epochs[s] for s in goal})
    plan = spark.createDataFrame([(s, int(quota[s]), epochs[s], -(-have[s][1] // SHARD_ROWS)) for s in goal], "source string, quota long, epochs int, shards int")
    placed = own.join(F.broadcast(plan.select("source", "shards")), "source").select("doc_id", "source", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")).cast("int").alias("shard"))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks of each shard of one source; a row a shard."""
        blocks = {k: -(-t // size) for k, t in zip(pdf["shard"], pdf["t"], strict=True)}
        got = sainte_lague(dict(zip(pdf["shard"], pdf["t"].astype(float), strict=True)), int(pdf["quota"].iloc[0]), {k: b * int(pdf["epochs"].iloc[0]) for k, b in blocks.items()})
        return pd.DataFrame({"source": pdf["source"], "shard": pdf["shard"], "blocks": [blocks[k] for k in pdf["shard"]], "quota": [got[k] for k in pdf["shard"]]})

    shards = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).join(F.broadcast(plan.select("source", "quota", "epochs")), "source")
    quotas = shards.groupBy("source").applyInPandas(share, "source string, shard int, blocks long, quota long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")  # SHARD_ROWS or so
    block = placed.withColumn("block", F.floor((F.sum("tokens").over(order) - F.col("tokens")) / size)).join(quotas, ["source", "shard"])
    turned = F.pmod(F.col("block") + F.xxhash64("source", "shard", F.lit(seed + 2)), F.col("blocks"))
    repeats = F.floor(F.col("quota") / F.col("blocks")) + F.when(turned < F.col("quota") % F.col("blocks"), 1).otherwise(0)
    return block.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).filter("repeats > 0")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets").select(source_key(F.col("source")).alias("source"), "proportion", "max_epochs")
    documents = table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    wanted = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # mix_targets has a row a source
    return written(token_sizes(wanted.select("doc_id", "source", "text"), "source string")), targets


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, repeats: the documents of the mixture of mix_targets.

    As many tokens as the target sources hold; a source at its epochs falls short of its share.
    Null and empty texts have no tokens and aren't taken; an empty table gives no row.
    """
    sizes, targets = _tables(spark, sf_dir)
    return mixed(sizes, [tuple(r) for r in targets.collect()])


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, reached, tokens, epochs, max_epochs, available, capped: planned and real shares.

    target is scaled to sum 1 over all rows; a source without documents reaches 0. capped tells
    that the epochs, not the share, set the tokens of a source.
    """
    sizes, targets = _tables(spark, sf_dir)
    done = mixed(sizes, [tuple(r) for r in targets.collect()]).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    every = Window.partitionBy(F.lit(1))  # a row a source
    out = targets.join(done, "source", "left").join(have, "source", "left").na.fill(0, ["tokens", "available"])
    epochs = F.when(F.col("available") > 0, F.col("tokens") / F.col("available")).otherwise(0.0)
    return out.select(
        "source", F.round(F.col("proportion") / F.sum("proportion").over(every), 6).alias("target"), F.round(F.col("tokens") / F.sum("tokens").over(every), 6).alias("reached"),
        "tokens", F.round(epochs, 4).alias("epochs"), "max_epochs", "available",
        ((F.col("available") > 0) & (F.col("tokens") / F.sum("tokens").over(every) < 0.99 * F.col("proportion") / F.sum("proportion").over(every)) & (epochs > 0.95 * F.col("max_epochs"))).alias("capped"),
    )
