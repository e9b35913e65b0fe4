"""Link keys, groups, hashed splits, locks and group-wide exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import expr
from corpusmill.operators.graph import components, star_edges

#: test beats val beats train.
RANK = {"train": 0, "val": 1, "test": 2}


def link_keys(source: Column, group: Column, question: Column, media: Column | None = None, repo: Column | None = None, document: Column | None = None) -> Column:
    """Array of the keys of a record; media is an array of structs with rgb_sha256, document_id, video_id, origin_id."""
    some = lambda prefix, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(prefix), c))
    keys = F.array_compact(F.array(F.when(group.isNotNull(), F.concat(F.lit("source-group:"), source, F.lit(":"), group)), some("question:", question), some("repo:", F.lit(None).cast("string") if repo is None else repo), some("document:", F.lit(None).cast("string") if document is None else document)))
    if media is None:
        return keys
    each = lambda p, f: F.transform(F.filter(media, lambda m: F.coalesce(m[f], F.lit("")) != ""), lambda m: F.concat(F.lit(p), m[f]))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(keys, *[F.coalesce(each(p, f), none) for p, f in (("rgb:", "rgb_sha256"), ("document_id:", "document_id"), ("video_id:", "video_id"), ("origin_id:", "origin_id"))]))


def grouped(links: DataFrame, rows: DataFrame, node: str = "id", key: str = "key") -> DataFrame:
    """rows with group_root, the smallest node of their component; a row without links is its own."""
    roots = components(star_edges(links, node, key)).select(F.col("node").alias(node), F.col("root"))
    return rows.join(roots, node, "left").withColumn("group_root", F.coalesce("root", node)).drop("root")


def hashed_split(root: Column, seed: int = 0, val: int = 50, test: int = 50) -> Column:
    """Split of a group by 16 hexadecimal digits modulo 10,000."""
    return expr.three_way(expr.bucket(seed, root), val, test)


def two_way_split(key: Column, seed: int = 0) -> Column:
    """Earlier scheme: 8 digits modulo 100, val below 2."""
    return F.when(expr.bucket(seed, key, 8, 100) < 2, "val").otherwise("train")


def second_split(key: Column) -> Column:
    """Scheme of the native schema: 8 digits of a digest modulo 10,000, train to 9,850, val to 9,900, else test."""
    b = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 10_000
    return F.when(b < 9850, "train").when(b < 9900, "val").otherwise("test")


def with_locks(rows: DataFrame, locks: DataFrame, root: str = "group_root", hashed: str = "split") -> DataFrame:
    """rows with the split that locks demand for their group: test over val over the hashed one.

    locks: group_root, split in (val, test). A lock on train is refused.
    """
    rank = F.when(F.col("split") == "test", 2).when(F.col("split") == "val", 1).otherwise(F.raise_error(F.lit("only val and test can be locked")).cast("int"))
    most = locks.groupBy(F.col(root).alias("_g")).agg(F.max(rank).alias("_r"))
    return rows.join(most, rows[root] == F.col("_g"), "left").withColumn(hashed, F.when(F.col("_r") == 2, "test").when(F.col("_r") == 1, "val").otherwise(F.col(hashed))).drop("_g", "_r")


def without_groups(rows: DataFrame, excluded: DataFrame, node: str = "id", root: str = "group_root") -> DataFrame:
    """rows without the whole groups of the excluded nodes."""
    bad = rows.join(excluded.select(node).distinct(), node, "left_semi").select(root).distinct()
    return rows.join(bad, root, "left_anti")


def merged_audits(edges: list[DataFrame], required: DataFrame) -> DataFrame:
    """(group_root, node, split): components over the edges of several audits; the required split is the highest.

    edges: a, b; required: node, split. A component without a required split has null.
    """
    union = edges[0].select("a", "b")
    for e in edges[1:]:
        union = union.unionByName(e.select("a", "b"))
    comps = components(union)
    rank = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])
    top = comps.join(required, "node").groupBy("root").agg(F.max_by("split", rank[F.col("split")]).alias("split"))
    return comps.join(top, "root", "left").select(F.col("root").alias("group_root"), "node", "split")


def identity_groups(groups: DataFrame, edges: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(components, conflicts) of groups of several inventories joined by reasons.

    groups: node, split; edges: (reason, a, b). conflicts: group_root, splits, nodes, reasons of
    components that hold more than one split.
    """
    tagged = None
    for reason, e in edges:
        one = e.select("a", "b", F.lit(reason).alias("reason"))
        tagged = one if tagged is None else tagged.unionByName(one)
    comps = components(tagged.select("a", "b")).select("node", F.col("root").alias("group_root"))
    own = groups.join(comps, "node", "left").withColumn("group_root", F.coalesce("group_root", "node"))
    why = tagged.join(comps.withColumnRenamed("node", "a"), "a").groupBy("group_root").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    bad = own.groupBy("group_root").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("nodes")).filter("splits > 1")
    return own, bad.join(why, "group_root", "left")


def incremental_groups(closed: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(node, root) after new edges met closed components: only labels that an edge touches move.

    closed: node, root. The result equals components over all edges.
    """
    label = closed.select(F.col("node"), F.col("root"))
    a = new_edges.select("a", "b").join(label.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a", "left")
    both = a.join(label.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b", "left")
    between = both.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    fresh = new_edges.select(F.col("a").alias("node")).union(new_edges.select("b")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("root"))
    return label.unionByName(fresh).join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))


def review_closure(candidates: DataFrame, decisions: DataFrame, key: str = "candidate") -> DataFrame:
    """(candidate, problem): what keeps a review from being closed: undecided, unknown, decided twice."""
    counts = decisions.groupBy(key).agg(F.count("*").alias("n"))
    j = candidates.select(key, F.lit(True).alias("is")).join(counts, key, "full")
    return j.select(key, F.when(F.col("is").isNull(), "unknown").when(F.col("n").isNull(), "undecided").when(F.col("n") > 1, "decided_twice").alias("problem")).filter("problem is not null")


def aliases(links: DataFrame, prefix: str, node: str = "id", key: str = "key") -> DataFrame:
    """(node, aliases): distinct keys of one prefix, in order, of every node that has some.

    An export of identities; a node's list is as long as its own keys.
    """
    return links.filter(F.col(key).startswith(prefix)).groupBy(node).agg(F.array_join(F.array_sort(F.collect_set(key)), "|").alias("aliases"))


def group_fractions(rows: DataFrame, source: str = "source", root: str = "group_root", split: str = "split") -> DataFrame:
    """source, split, groups, share: groups of a source by split. Counts in two steps, no window over rows."""
    each = rows.groupBy(source, split).agg(F.countDistinct(root).alias("groups"))
    whole = each.groupBy(source).agg(F.sum("groups").alias("_all"))
    return each.join(whole, source).select(source, split, "groups", F.round(F.col("groups") / F.col("_all"), 6).alias("share"))
