"""Problem 4: near copies of texts and pictures.

Both kinds go through the generalised pigeonhole: what two near items may differ in is bounded,
their bits are put into partitions, every partition gets a threshold of its own on estimated
candidate counts, partitions are probed, and every candidate is verified exactly. No pair is lost.

* Pictures: 64 bits of a perceptual hash, of which 6 may differ. Correlated bits share a
  partition, and dynamic programming gives thresholds t_i with sum(t_i + 1) = 7.
* Texts: a bit for each 5-character shingle. Thresholds are -1 (not probed) and 0 (probed), and
  one partition more is probed than near sets can differ in; with these two thresholds the
  programme is a choice of the partitions with the least estimated candidates, in one order for all
  texts, so the cheapest partition in which two near texts agree is among those that either probes
  (base.py). Partitions are single shingles or, where so many texts would share one that it
  costs more, groups of several: the cheaper of the two by keys and candidates estimated for the
  whole collection.

Candidates of texts pass three bounds before their texts are compared: the sizes of the sets, and
one-bit min-hashes in two parts, of which a near pair breaks either with a chance below 10^-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.shingles import jaccard_at_least, shingle_sets
from corpusmill.functions.text import py_squeezed
from corpusmill.llm.base import DEN, NUM, batches, cheaper_keys, samples, shingle_counts, single_keys, sketches, text_hash
from corpusmill.operators.graph import components, star_edges
from corpusmill.session import table, written

#: Pictures: most bits of difference.
BITS, RADIUS = 64, 6
#: Rows from which candidate counts are estimated; only costs depend on the estimate.
SAMPLE = 1_000
#: One-bit min-hashes beside each key and of each class, and how many may differ: at 85 % more do
#: in less than 1 of 10^8 pairs.
KEY_BITS, KEY_RADIUS, CLASS_BITS, CLASS_RADIUS = 48, 17, 64, 20
#: Classes whose ids are broadcast (8 bytes each) to pick their texts; more are joined.
PICKED = 500_000


# ---------------------------------------------------------------- thresholds


def bit_partitions(values: np.ndarray, total: int, bits: int = BITS, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition, sum(threshold + 1) = radius + 1.

    Bits are put together by correlation, greedily, into partitions of near equal size; for
    each number of partitions the thresholds come from dynamic programming on the share of
    sampled pairs within a threshold, and the cheapest number wins. A threshold of -1 means
    that the partition is not probed.
    """
    cells = ((values[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.float64)
    if len(values) > 2:
        centred = cells - cells.mean(axis=0)
        spread = np.maximum(np.sqrt((centred**2).sum(axis=0)), 1e-9)
        corr = np.abs(centred.T @ centred / spread[:, None] / spread[None, :])
    else:
        corr = np.eye(bits)
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for m in range(2, radius + 2):
        free, groups = set(range(bits)), []
        for g in range(m):
            room = len(free) // (m - g)
            group = [min(free)]
            free.discard(group[0])
            while len(group) < room:
                nxt = max(sorted(free), key=lambda b: corr[b, group].mean())
                group.append(nxt)
                free.discard(nxt)
            groups.append(group)
        hits = []
        for group in groups:
            part = cells[:, group]
            apart = part @ (1 - part.T) + (1 - part) @ part.T
            upper = apart[np.triu_indices(len(values), 1)]
            hits.append([float(np.mean(upper <= t)) if len(upper) else 0.5 ** len(group) for t in range(radius + 1)])
        price = lambda i, t: 0.0 if t < 0 else sum(math.comb(len(groups[i]), k) for k in range(t + 1)) + 1 + 0.5 * total * max(hits[i][t], 2.0 ** -len(groups[i]))
        table_ = {0: (0.0, ())}
        for i in range(m):
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, ts) in table_.items():
                for t in range(-1, radius - used + 1):
                    if t <= 3:
                        new = (c + price(i, t), (*ts, t))
                        if used + t + 1 not in step or new < step[used + t + 1]:
                            step[used + t + 1] = new
            table_ = step
        if radius + 1 in table_ and table_[radius + 1][0] < best[0]:
            c, ts = table_[radius + 1]
            best = (c, [(sum(1 << b for b in group), t) for group, t in zip(groups, ts, strict=True)])
    return [(mask, t) for mask, t in best[1] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---------------------------------------------------------------- pictures


def phash_bits(c: Column) -> Column:
    """The 64 bits of a perceptual hash as BIGINT; null where it isn't one.

    Takes capitals, a leading 0x, white space and missing leading zeros.
    """
    plain = F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    whole = F.lpad(plain, 16, "0")
    high = F.conv(F.substring(whole, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(whole, 9, 8), 16, 10).cast("long")
    return F.when(plain.rlike("^[0-9a-f]{1,16}$"), F.shiftleft(high, 32).bitwiseOR(low))


def _flipped(i: int, base: Column):
    return lambda f: F.struct(F.lit(i).alias("i"), base.bitwiseXOR(f).alias("v"))


def hamming_pairs(values: DataFrame, col: str, radius: int = RADIUS) -> DataFrame:
    """(x, y), x < y: all pairs of distinct 64-bit values that differ in at most radius bits.

    Exact, by the generalised pigeonhole. Nulls pair with nothing.
    """
    own = written(values.select(F.col(col).alias("x")).dropna().distinct())
    total = own.count()
    taken = np.array([r.x for r in own.orderBy(F.xxhash64("x")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    parts = bit_partitions(taken, total, BITS, radius)
    data, probe = [], []
    for i, (mask, t) in enumerate(parts):
        base = F.col("x").bitwiseAND(F.lit(_signed(mask)))
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [_signed(sum(1 << b for b in some)) for k in range(t + 1) for some in combinations(bits, k)]
        data.append(F.array(F.struct(F.lit(i).alias("i"), base.alias("v"))))
        probe.append(F.transform(F.array(*[F.lit(f) for f in flips]), _flipped(i, base)))
    if not parts:
        return own.select("x", F.col("x").alias("y")).limit(0)
    left = own.select("x", F.explode(F.concat(*probe)).alias("k")).select("x", "k.i", "k.v")
    right = own.select(F.col("x").alias("y"), F.explode(F.concat(*data)).alias("k")).select("y", "k.i", "k.v")
    near = left.join(right, ["i", "v"]).filter((F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius))
    return near.select("x", "y").distinct()


def picture_pairs(bands: DataFrame) -> DataFrame:
    """(id_a, id_b): different records that own pictures within RADIUS bits.

    Equal hashes are one class first, so a hash that a third of the rows share is probed once.
    """
    own = written(bands.select("id", phash_bits(F.col("phash")).alias("x")).dropna().distinct())
    near = hamming_pairs(own, "x")
    a, b = own.select(F.col("id").alias("a"), "x"), own.select(F.col("id").alias("b"), F.col("x").alias("y"))
    apart = near.join(a, "x").join(b, "y").select("a", "b").filter("a != b")
    same = a.join(own.select(F.col("id").alias("b"), "x"), "x").filter("a < b").select("a", "b")
    both = apart.unionByName(same)
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


# ---------------------------------------------------------------- texts


def _short(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(h[:8] for h in hashes), dtype=np.int64)


def text_members(records: DataFrame) -> DataFrame:
    """(id, th, rk, sk, text), written: the class of every record with a text; copies share th.

    th: 128-bit hash of the squeezed text; rk: its first 64 bits; sk: CLASS_BITS one-bit
    min-hashes; text is squeezed. Records whose text is null or blank have none; rows that come
    twice come twice.
    """

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = [(i, s) for i, t in zip(pdf["id"], pdf["text"], strict=True) if i is not None and t is not None and (s := py_squeezed(t))]
            ids, texts = [i for i, _ in own], [s for _, s in own]
            for a, b in batches(texts):
                th = [text_hash(t) for t in texts[a:b]]
                sk = sketches(*shingle_sets(texts[a:b]), CLASS_BITS, 2)
                yield pd.DataFrame({"id": ids[a:b], "th": th, "rk": _short(th), "sk": sk.view(np.int64), "text": texts[a:b]})

    return written(records.select("id", "text").mapInPandas(on, "id string, th binary, rk long, sk long, text string"))


def text_keys(members: DataFrame, shared: Broadcast, keys_of=single_keys) -> DataFrame:
    """(key, rk, w): a row for each class and partition that it probes; w packs KEY_BITS min-hash bits and the set's size.

    shared: shingle_counts of the texts; keys_of: single_keys or coarse_keys. Copies within a
    batch have one row.
    """

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = dict(zip(pdf["rk"], pdf["text"], strict=True))
            rks, texts = np.fromiter(own, dtype=np.int64, count=len(own)), list(own.values())
            for a, b in batches(texts):
                sets, starts = shingle_sets(texts[a:b])
                w = (sketches(sets, starts, KEY_BITS, 1) << np.uint64(16)) | np.minimum(np.diff(starts), 0xFFFF).astype(np.uint64)
                yield pd.DataFrame({"rk": rks[a:b], "w": w.view(np.int64), "keys": keys_of(sets, starts, shared.value)})

    rows = members.select("rk", "text").mapInPandas(on, "rk long, w long, keys array<long>")
    return rows.select(F.explode("keys").alias("key"), "rk", "w")


def class_candidates(keys: DataFrame, members: DataFrame) -> DataFrame:
    """(ra, rb), ra < rb, written: classes that share a probed shingle, of fitting sizes and sketches.

    A key that many classes probe is split over tasks by adaptive execution.
    """
    a = keys.select("key", F.col("rk").alias("ra"), F.col("w").alias("wa"))
    b = keys.select("key", F.col("rk").alias("rb"), F.col("w").alias("wb"))
    size = lambda w: F.col(w).bitwiseAND(F.lit(0xFFFF))
    fit = (size("wa") * DEN >= size("wb") * NUM) & (size("wb") * DEN >= size("wa") * NUM)
    alike = F.bit_count(F.shiftrightunsigned(F.col("wa").bitwiseXOR(F.col("wb")), 16)) <= KEY_RADIUS
    some = a.join(b, "key").filter((F.col("ra") < F.col("rb")) & fit & alike).select("ra", "rb").distinct()
    sk = members.groupBy("rk").agg(F.first("sk").alias("sk"))
    both = some.join(sk.select(F.col("rk").alias("ra"), F.col("sk").alias("sa")), "ra").join(sk.select(F.col("rk").alias("rb"), F.col("sk").alias("sb")), "rb")
    return written(both.filter(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= CLASS_RADIUS).select("ra", "rb"))


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for k in range(0, len(a), 500):
        left, right = a.iloc[k : k + 500].tolist(), b.iloc[k : k + 500].tolist()
        hashes, starts = shingle_sets(left + right)
        n = len(left)
        out += [jaccard_at_least(hashes[starts[i] : starts[i + 1]], hashes[starts[n + i] : starts[n + i + 1]], NUM, DEN) for i in range(n)]
    return pd.Series(out, dtype=bool)


def class_pairs(members: DataFrame) -> DataFrame:
    """(tha, thb): pairs of different text classes whose texts are near. Verified exactly."""
    counts = shingle_counts(members.select("text"))
    keys_of = cheaper_keys(members.select("text"), members.count(), counts)
    shared = members.sparkSession.sparkContext.broadcast(counts)
    cand = class_candidates(text_keys(members, shared, keys_of), members)
    shared.destroy()
    used = written(cand.select(F.col("ra").alias("rk")).unionByName(cand.select(F.col("rb").alias("rk"))).distinct())
    few = F.broadcast(used) if used.count() <= PICKED else used
    texts = written(members.select("rk", "th", "text").join(few, "rk", "left_semi").dropDuplicates(["th"]))
    a = texts.select(F.col("rk").alias("ra"), F.col("th").alias("tha"), F.col("text").alias("ta"))
    b = texts.select(F.col("rk").alias("rb"), F.col("th").alias("thb"), F.col("text").alias("tb"))
    near = F.pandas_udf(_near, "boolean")
    return cand.join(a, "ra").join(b, "rb").filter(near("ta", "tb")).select("tha", "thb")


def text_pairs(records: DataFrame) -> DataFrame:
    """(id_a, id_b): records whose texts are near, copies included, each pair once."""
    rows = text_members(records)
    members, pairs = rows.select("id", "th").distinct(), class_pairs(rows)
    a, b = members.select(F.col("id").alias("a"), F.col("th").alias("tha")), members.select(F.col("id").alias("b"), F.col("th").alias("thb"))
    apart = pairs.join(a, "tha").join(b, "thb").select("a", "b").filter("a != b")
    same = a.join(members.select(F.col("id").alias("b"), F.col("th").alias("tha")), "tha").filter("a < b").select("a", "b")
    return apart.unionByName(same).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


# ---------------------------------------------------------------- queries


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id_a, id_b: all pairs of near texts and of near pictures.

    Null or blank texts and hashes that aren't hashes pair with nothing; repeated rows are one
    record; an empty table gives no pair.
    """
    texts = text_pairs(samples(spark, sf_dir, "id", "text"))
    pictures = picture_pairs(table(spark, sf_dir, "image_bands"))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id_a", "id_b")
    return tag(texts, "text").unionByName(tag(pictures, "image"))


def _linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id, links) of members (id, c) of classes whose near pairs are (a, b), c being a class.

    links counts the other memberships in the own classes and all in those near them. Works on
    classes, so one that a third of the records share costs a row a record, not a row a pair.
    """
    size = members.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(size.select(F.col("c").alias("b"), "n"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("m"))
    each = members.join(size.select("c", "n"), "c").join(beside, "c", "left").groupBy("id").agg(F.sum(F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    reps = size.select("c", "rep")
    edges = pairs.join(reps.select(F.col("c").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("c").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    comps = components(star_edges(members, "id", "c").unionByName(edges)).select(F.col("node").alias("id"), F.col("root").alias("group_id"))
    return comps.join(each, "id").filter("links > 0")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, group_id, links: every record with a near copy, its group and its number of links.

    The group is named by its smallest id. links counts near texts, or near pictures, of other
    rows: a record with two pictures near one another counts them both.
    """
    records = samples(spark, sf_dir, "id", "text")
    members = text_members(records)
    texts = members.select("id", F.hex("th").alias("c")).distinct()
    near = written(class_pairs(members).select(F.hex("tha").alias("a"), F.hex("thb").alias("b")))
    own = written(table(spark, sf_dir, "image_bands").select("id", phash_bits(F.col("phash")).alias("c")).dropna().distinct())
    alike = written(hamming_pairs(own, "c").select(F.col("x").alias("a"), F.col("y").alias("b")))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "group_id", "links")
    return tag(_linked(texts, near), "text").unionByName(tag(_linked(own, alike), "image"))
