"""Partition views: small overlays on an immutable base, and proofs about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective(base: DataFrame, val: DataFrame, excluded: DataFrame, test: DataFrame, root: str = "group_root") -> DataFrame:
    """base with the splits of an overlay: test over val over its own; excluded groups left out.

    The overlays hold group_root only; AQE broadcasts them if they are small.
    """
    v = val.select(F.col(root).alias("_v")).distinct()
    t = test.select(F.col(root).alias("_t")).distinct()
    out = base.join(v, base[root] == v["_v"], "left").join(t, base[root] == t["_t"], "left")
    out = out.withColumn("split", F.when(F.col("_t").isNotNull(), "test").when(F.col("_v").isNotNull(), "val").otherwise(F.col("split"))).drop("_v", "_t")
    return out.join(excluded.select(root).distinct(), root, "left_anti")


def relabelled(base: DataFrame, task: Column) -> DataFrame:
    """base with another task label and nothing else changed."""
    return base.withColumn("task", task)


def reservation_faults(base: DataFrame, val: DataFrame, excluded: DataFrame, test: DataFrame, root: str = "group_root") -> DataFrame:
    """(group_root, fault): overlays may move train to val, val to test, and drop train; nothing else.

    Also names groups that the base doesn't hold.
    """
    now = base.groupBy(root).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    of = lambda df, need, what: df.select(root).distinct().join(now, root, "left").select(root, F.when(F.col("lo").isNull(), "unknown_group").when((F.col("lo") != need) | (F.col("hi") != need), what).alias("fault"))
    out = of(val, "train", "val_from_held_out").unionByName(of(test, "val", "test_not_from_val")).unionByName(of(excluded, "train", "excluded_held_out"))
    return out.filter("fault is not null")


def too_few_held(rows: DataFrame, fraction: float, root: str = "group_root") -> DataFrame:
    """source, groups, held, needed: sources whose val groups are fewer than ceil(groups * fraction)."""
    c = rows.groupBy("source").agg(F.countDistinct(root).alias("groups"), F.countDistinct(F.when(F.col("split") == "val", F.col(root))).alias("held"))
    return c.withColumn("needed", F.ceil(F.col("groups") * F.lit(fraction))).filter("held < needed")


def conflict_overlay(conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(excluded, promoted) of components with several splits: train groups go, val goes to test beside a test group.

    conflicts: component, group_root, split.
    """
    anchor = conflicts.groupBy("component").agg(F.bool_or(F.col("split") == "test").alias("has_test"), F.countDistinct("split").alias("n")).filter("n > 1")
    j = conflicts.join(anchor, "component")
    return j.filter("split = 'train'").select("group_root").distinct(), j.filter("split = 'val' and has_test").select("group_root").distinct()


def delta(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, old, new, change): added, removed, unchanged, moved or forbidden members.

    Forbidden: held-out to train, and test to val.
    """
    j = old.select(key, F.col("split").alias("old")).join(new.select(key, F.col("split").alias("new")), key, "full")
    change = (
        F.when(F.col("old").isNull(), F.concat(F.lit("add_"), "new")).when(F.col("new").isNull(), F.concat(F.lit("remove_"), "old")).when(F.col("old") == F.col("new"), "unchanged")
        .when((F.col("new") == "train") | ((F.col("old") == "test") & (F.col("new") == "val")), "forbidden").otherwise("moved")
    )
    return j.withColumn("change", change)


def origin_faults(derived: DataFrame, origin: DataFrame) -> DataFrame:
    """(id, fault): derived records whose origin is missing, not pretraining text, or in another split."""
    o = origin.select(F.col("id").alias("origin_id"), F.col("split").alias("o_split"), F.col("stage").alias("o_stage"))
    j = derived.select("id", "origin_id", "split").join(o, "origin_id", "left")
    return j.select("id", F.when(F.col("o_split").isNull(), "missing_origin").when(F.col("o_stage") != "pretrain", "origin_not_pretraining").when(F.col("o_split") != F.col("split"), "split_mismatch").alias("fault")).filter("fault is not null")


def membership_digest(rows: DataFrame, key: str = "id") -> DataFrame:
    """split, records, digest: an order-free fingerprint of who is in which split.

    The digest is the sum of the rows' hashes, so it is combined before the shuffle.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "split"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("split").agg(F.count("*").alias("records"), F.sum(h).cast("string").alias("digest"))


def counter_faults(parent: DataFrame, removed: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys where parent - removed is not actual, or is negative."""
    side = lambda df, n: df.groupBy(*keys).agg(F.sum(value).alias(n))
    j = side(parent, "p").join(side(removed, "r"), keys, "full").join(side(actual, "a"), keys, "full").na.fill(0, ["p", "r", "a"])
    return j.filter((F.col("p") - F.col("r") != F.col("a")) | (F.col("p") < F.col("r")))


def composed(components: list[DataFrame], key: str = "id", root: str = "group_root") -> DataFrame:
    """Union of component corpora with their number; see composition_faults."""
    out = components[0].withColumn("component", F.lit(0))
    for i, c in enumerate(components[1:], 1):
        out = out.unionByName(c.withColumn("component", F.lit(i)), allowMissingColumns=True)
    return out


def composition_faults(rows: DataFrame, identities: list[str], key: str = "id") -> DataFrame:
    """(kind, value): samples in two components, and identities (group, media, origin) in two splits."""
    out = rows.groupBy(F.col(key).cast("string").alias("value")).agg(F.countDistinct("component").alias("n")).filter("n > 1").select(F.lit("sample").alias("kind"), "value")
    for c in identities:
        bad = rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.min("split").alias("lo"), F.max("split").alias("hi")).filter("lo != hi")
        out = out.unionByName(bad.select(F.lit(c).alias("kind"), "value"))
    return out


def rebound(media: DataFrame, texts: DataFrame, root: str = "group_root") -> DataFrame:
    """media records without the train groups that hold a record whose text origin is stale."""
    stale = origin_faults(media, texts).join(media.select("id", root, "split"), "id").filter("split = 'train'").select(root).distinct()
    return media.join(stale, root, "left_anti")


def equal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): rows that only one of two tables has, counted with their copies; equal tables have 0 and 0.

    One shuffle: rows of a count 1, rows of b count -1.
    """
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    gap = both.groupBy(*cols).agg(F.sum("_s").alias("g")).agg(F.sum(F.when(F.col("g") > 0, F.col("g"))).alias("l"), F.sum(F.when(F.col("g") < 0, -F.col("g"))).alias("r"))
    sides = F.array(F.struct(F.lit("left").alias("side"), F.coalesce("l", F.lit(0)).alias("rows")), F.struct(F.lit("right").alias("side"), F.coalesce("r", F.lit(0)).alias("rows")))
    return gap.select(F.explode(sides).alias("x")).select("x.side", "x.rows")


def span_merge(old: DataFrame, restored: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of restored in place of theirs, by position key."""
    cols = [c for c in old.columns if c != key]
    r = restored.select(key, F.struct(*cols).alias("_r"))
    return old.join(r, key, "left").select(key, *[F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in cols])
