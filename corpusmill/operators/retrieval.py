"""Nearest rows by dot product, exactly, and lookups in small tool tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
    """The best item of a block for every query of a block; ties go to the smaller id."""
    if not len(queries) or not len(items):
        return pd.DataFrame({"qid": [], "iid": [], "score": []}).astype({"qid": "int64", "iid": "int64", "score": "float64"})
    items = items.sort_values("iid")
    qid, iid = queries["qid"].to_numpy(np.int64), items["iid"].to_numpy(np.int64)
    s = np.stack(queries["q"].to_numpy()).astype(np.float64) @ np.stack(items["v"].to_numpy()).astype(np.float64).T
    s[qid[:, None] == iid[None, :]] = -np.inf
    at = s.argmax(axis=1)
    top = s[np.arange(len(qid)), at]
    ok = np.isfinite(top)
    return pd.DataFrame({"qid": qid[ok], "iid": iid[at[ok]], "score": top[ok]})


def nearest(queries: DataFrame, items: DataFrame, block: int = 2048) -> DataFrame:
    """(qid, iid, score): the item with the greatest dot product for every query, never the query itself.

    queries: qid, q; items: iid, v (arrays of one length). Queries with a null vector get none.
    Both sides are cut into blocks of some `block` rows by hash, and each pair of blocks is one
    matrix product on an executor; nothing passes the driver or is broadcast.
    """
    q = queries.filter("qid is not null and q is not null").select("qid", "q")
    v = items.filter("iid is not null and v is not null").select("iid", "v")
    qs, vs = (max(1, -(-df.count() // block)) for df in (q, v))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", number("qid", qs)).withColumn("vb", every(vs)).groupBy("qb", "vb")
    right = v.withColumn("vb", number("iid", vs)).withColumn("qb", every(qs)).groupBy("qb", "vb")
    met = left.cogroup(right).applyInPandas(lambda a, b: _best(a, b), "qid long, iid long, score double")
    return met.groupBy("qid").agg(F.min_by(F.struct("iid", "score"), F.struct((-F.col("score")).alias("s"), "iid")).alias("b")).select("qid", "b.iid", "b.score")


def lookup(rows: DataFrame, where: dict[str, object], columns: list[str], most: int = 32) -> DataFrame:
    """Columns of the rows that equal all given values; at most 32, the feature's bound."""
    for k, v in where.items():
        rows = rows.filter(F.col(k).eqNullSafe(F.lit(v)))
    return rows.select(*columns).limit(most)


def search(rows: DataFrame, query: str, text: str, order: str, most: int = 3) -> DataFrame:
    """The rows that hold most of the query's terms, with the number; none without any. Ties by order."""
    terms = query.casefold().split()
    if not terms:
        raise ValueError("a search needs a term")
    low, score = F.lower(text), F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(low, F.lit(t)), 1).otherwise(0)
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), order).limit(most)
