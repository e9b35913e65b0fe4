"""Connected components by hooking and contraction, on DataFrames only.

Each round hooks every node to its smallest neighbour, shortens the pointers, renames the
edges to the roots and drops what became loops or copies, so the edge table shrinks with
every round. A key that holds a third of all rows costs nothing extra: its members meet
their minimum in a pre-aggregated group, never in one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import forget, written

MAX_ROUNDS = 60


def star_edges(membership: DataFrame, node: str, key: str) -> DataFrame:
    """Edges (a, b), a > b, from every node to the smallest node of each of its keys.

    Null nodes or keys connect nothing; repeated rows count once.
    """
    rows = membership.select(F.col(node).alias("_n"), F.col(key).alias("_k")).dropna()
    least = rows.groupBy("_k").agg(F.min("_n").alias("b"), F.max("_n").alias("_m")).filter("b < _m").drop("_m")
    return rows.join(least, "_k").filter("_n > b").select(F.col("_n").alias("a"), "b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Nodes may be of any orderable type. Null ends, loops and repeated edges are ignored; an
    empty table gives an empty table.
    """
    left = written(
        edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    maps: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("p")).filter("p < a").select(F.col("a").alias("node"), F.col("p").alias("root")))
        while True:  # pointer jumping, two jumps a pass: the length of a chain falls to a quarter
            once = hook.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            twice = hook.select(F.col("node").alias("_up"), F.col("root").alias("_upper"))
            far = hook.join(once, "root", "left").join(twice, "_up", "left")
            jumped = written(far.select("node", F.coalesce("_upper", "_up", "root").alias("root"), F.col("_upper").isNotNull().alias("_moved")))
            forget(hook)
            hook = jumped.select("node", "root")
            if jumped.filter("_moved").isEmpty():
                break
        maps.append(hook)
        ra = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        new = written(moved.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        forget(left)
        left = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # resolved backwards: a node hooked in round i follows the maps of the later rounds
    done = maps[-1]
    for one in reversed(maps[:-1]):
        later = done.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        moved = one.join(later, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
        done = written(moved.unionByName(done))  # the plan would double with every round
    roots = done.select(F.col("root").alias("node"), "root").distinct()
    return done.unionByName(roots)
