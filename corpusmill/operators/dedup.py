"""Exact and near deduplication, admission in arrival order, exact set-similarity join.

"First wins" loops are stated as sets: the kept rows are the lexicographically first maximal
independent set of a conflict graph, found in rounds over DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.keys import BUCKETS, CLASS_RATIO, buckets, coarse_keys
from corpusmill.functions.shingles import WIDTH, mix, most_apart, shingle_sets
from corpusmill.functions.text import py_squeezed
from corpusmill.operators.marks import marks, passing, width
from corpusmill.session import forget, written

MAX_ROUNDS = 200


def first_by(rows: DataFrame, keys: list[str], order: list[str], keep: int = 1) -> DataFrame:
    """The first `keep` rows of every key in an order; rows with a null key are one group a key.

    With keep = 1 the choice is an aggregate that is combined before the shuffle, so a key that
    a third of the rows share is no heavy partition.
    """
    if keep == 1:
        names = rows.columns
        packed = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
        return packed.select("_r.*")
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def duplicate_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows with `kept`: the smallest order value of their key. A null key is its own."""
    least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("kept"))
    return rows.join(least, key, "left").withColumn("kept", F.coalesce("kept", order))


def identity(text_fingerprint: Column, rgb: Column | None = None) -> Column:
    """Identity of a record: its text's fingerprint, with its pictures in order if it has any."""
    if rgb is None:
        return text_fingerprint
    return F.when(F.size(rgb) > 0, F.sha2(F.concat(text_fingerprint, F.lit("|media:"), F.array_join(rgb, "|")), 256)).otherwise(text_fingerprint)


def code_identity(text: Column) -> Column:
    """Identity of source code: its bytes, unchanged."""
    return F.sha2(F.concat(F.lit("source-code\x00"), text), 256)


# ---------------------------------------------------------------- sim hashes


def _votes(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """64-bit sim hash of each text from the hashes of its shingles: every bit by majority, ties give 1."""
    whole, out = np.bincount(owner, minlength=texts), np.zeros(texts, dtype=np.uint64)
    for bit in range(64):
        ones = np.bincount(owner[values >> np.uint64(bit) & np.uint64(1) == 1], minlength=texts)
        out |= (2 * ones >= whole).astype(np.uint64) << np.uint64(bit)
    return out


def sim_hash(texts: Column) -> Column:
    """64-bit sim hash of a text's shingles as BIGINT; ties give 1, the first bit is the highest.

    Shingles are hashed by BLAKE2b, as stored sim hashes are; a batch is counted bit by bit.
    """

    @F.pandas_udf("long")
    def on(s: pd.Series) -> pd.Series:
        given = [(i, py_squeezed(t)) for i, t in enumerate(s) if t is not None]
        out = pd.Series([None] * len(s), dtype="Int64")
        for k in range(0, len(given), 500):
            part = given[k : k + 500]
            each = [{c[i : i + WIDTH] for i in range(max(1, len(c) - WIDTH + 1))} for _, c in part]
            data = b"".join(blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest() for own in each for g in own)
            votes = _votes(np.frombuffer(data, dtype=">u8").astype(np.uint64), np.repeat(np.arange(len(part)), [len(x) for x in each]), len(part))
            out.iloc[[i for i, _ in part]] = votes.view(np.int64)
        return out

    return on(texts)


def parsed_sim_hash(c: Column) -> Column:
    """A stored hexadecimal sim hash as BIGINT; null where it is none."""
    plain = F.lpad(F.regexp_replace(F.lower(F.trim(c)), "^0x", ""), 16, "0")
    value = F.shiftleft(F.conv(F.substring(plain, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(plain, 9, 8), 16, 10).cast("long"))
    return F.when(plain.rlike("^[0-9a-f]{16}$"), value)


#: Bits (offset, width) of the bands that stored tables hold.
TEXT_BANDS = [(0, 16), (16, 16), (32, 16), (48, 16)]
PICTURE_BANDS = [(0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9)]


def band_masks(total: int, layout: list[tuple[int, int]], radius: int) -> list[int]:
    """Masks of bits of which two values within the radius agree in at least one, the cheapest for `total` values.

    With m bands they agree in m - radius of them, so every choice of that many bands is a mask:
    few short masks for small tables, more and longer ones where buckets would grow too full.
    """
    plans = [[((1 << w) - 1) << o for o, w in layout]]
    for same in (2, 3, 4):
        m = radius + same
        edges = [64 * i // m for i in range(m + 1)]
        own = [((1 << (b - a)) - 1) << a for a, b in pairwise(edges)]
        plans.append([sum(some) for some in combinations(own, same)])
    return min(plans, key=lambda masks: sum(1 + 0.5 * total / 2 ** x.bit_count() for x in masks))


def band_pairs(rows: DataFrame, key: str, value: str, layout: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b), a < b: rows whose 64-bit values differ in at most radius bits, radius < bands.

    Lossless, since some band must agree; see band_masks. Equal values are one class while bands
    are compared.
    """
    if radius >= len(layout):
        raise ValueError("needs more bands than differing bits")
    own = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).dropna().distinct()
    values = written(own.select("v").distinct())
    masks = [m - (1 << 64) if m >> 63 else m for m in band_masks(values.count(), layout, radius)]
    each = F.array(*[F.struct(F.lit(i).alias("band"), F.col("v").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    wide = values.select("v", F.explode(each).alias("b")).select("v", "b.band", "b.value")
    other = wide.select(F.col("v").alias("u"), "band", "value")
    near = wide.join(other, ["band", "value"]).filter((F.col("v") < F.col("u")) & (F.bit_count(F.col("v").bitwiseXOR(F.col("u"))) <= radius)).select("v", "u").distinct()
    x, y = own.select(F.col("k").alias("x"), "v"), own.select(F.col("k").alias("y"), F.col("v").alias("u"))
    apart = near.join(x, "v").join(y, "u").select("x", "y")
    same = x.join(y.withColumnRenamed("u", "v"), "v").filter("x < y").select("x", "y")
    return apart.unionByName(same).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


# ---------------------------------------------------------------- admission


def first_independent(nodes: DataFrame, conflicts: DataFrame, node: str = "node") -> DataFrame:
    """(node, kept): the set that a loop in node order keeps if it drops what conflicts with a kept one.

    conflicts: a, b in any direction. A node is kept once every earlier neighbour is dropped,
    dropped once an earlier neighbour is kept. Raises if a chain is longer than MAX_ROUNDS.
    """
    edges = written(conflicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    state = written(edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct().withColumn("s", F.lit(None).cast("boolean")))
    for _ in range(MAX_ROUNDS):
        seen = edges.join(state.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a").groupBy(F.col("b").alias("n")).agg(F.bool_or(F.coalesce("sa", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("sa"), F.lit(False))).alias("free"))
        new = written(state.join(seen, "n", "left").select("n", F.coalesce("s", F.when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("free", F.lit(True)), True)).alias("s")))
        forget(state)
        state = new
        if state.filter("s is null").isEmpty():
            break
    else:
        raise RuntimeError("the conflicts hold a longer chain than MAX_ROUNDS")
    return nodes.select(F.col(node).alias("n")).join(state, "n", "left").select(F.col("n").alias(node), F.coalesce("s", F.lit(True)).alias("kept"))


def admitted(rows: DataFrame, conflicts: DataFrame, cap: int = 3) -> DataFrame:
    """(node, kept): as first_independent, and at most `cap` kept rows of one non-empty question.

    rows: node, question. Rounds: dropped if an earlier neighbour is kept or `cap` earlier
    records of the question are; kept if every earlier neighbour is dropped and fewer than
    `cap` earlier ones of the question are kept or open.
    """
    base = written(rows.select("node", F.when(F.coalesce("question", F.lit("")) != "", F.col("question")).alias("q")).withColumn("s", F.lit(None).cast("boolean")))
    edges = written(conflicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    w = Window.partitionBy("q").orderBy("node")

    def nth(rows: DataFrame, name: str) -> DataFrame:
        """The `cap`-th node of every question; Spark keeps `cap` rows a question and task before the shuffle."""
        return rows.filter("q is not null").select("q", "node", F.row_number().over(w).alias("_n")).filter(F.col("_n") <= cap).filter(F.col("_n") == cap).select("q", F.col("node").alias(name))

    for _ in range(MAX_ROUNDS):
        seen = edges.join(base.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").groupBy(F.col("b").alias("node")).agg(F.bool_or(F.coalesce("sa", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("sa"), F.lit(False))).alias("free"))
        full, tight = nth(base.filter("s"), "full"), nth(base.filter("s is null or s"), "tight")
        j = base.join(seen, "node", "left").join(full, "q", "left").join(tight, "q", "left")
        # behind the cap-th kept record; not behind the cap-th that is kept or open
        out = F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("node") > F.col("full"), F.lit(False))
        stay = F.coalesce("free", F.lit(True)) & F.coalesce(F.col("node") <= F.col("tight"), F.lit(True))
        new = written(j.select("node", "q", F.coalesce("s", F.when(out, False).when(stay, True)).alias("s")))
        forget(base)
        base = new
        if base.filter("s is null").isEmpty():
            return base.select("node", F.col("s").alias("kept"))
    raise RuntimeError("admission did not settle in MAX_ROUNDS rounds")


# ---------------------------------------------------------------- exact set similarity


#: Elements and sets that are handled as one array; sets a part of the keys, and least parts where there are enough; keys that are sorted at once.
_BATCH, _SETS, _PART, _PARTS, _SORTED = 1_000_000, 2_000, 80_000, 12, 2_000_000
#: Classes whose ids are broadcast (8 bytes each) to pick their sets; more are joined.
PICKED = 500_000
#: Keys a set has by its elements, about; bits and probes of a key in the filter of the keys that ask.
_KEYS, _BITS, _PROBES = 0.4, 16, 2

#: From some values to the places of those that have a set, their sorted elements, and starts: set i owns elements[starts[i]:starts[i + 1]].
SetsOf = Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]]


def shingles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 5-character shingles; a blank text has no set."""
    own = [py_squeezed(t) for t in texts]
    keep = [i for i, t in enumerate(own) if t]
    return np.array(keep, dtype=np.int64), *shingle_sets([own[i] for i in keep])


def tokens_of(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of arrays of hashes; an empty array has no set."""
    own = [np.unique(np.asarray(x, dtype=np.int64).view(np.uint64)) for x in arrays]
    keep = [i for i, x in enumerate(own) if len(x)]
    return np.array(keep, dtype=np.int64), np.concatenate([np.zeros(0, np.uint64), *own]), np.concatenate(([0], np.cumsum([len(own[i]) for i in keep]))).astype(np.int64)


def _batched(frames: Iterator[pd.DataFrame], sets_of: SetsOf) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with a set, their elements, starts and classes; equal sets are one class, named by 64 bits of a hash."""
    for pdf in frames:
        begin, many = 0, 0
        sizes = [len(x) for x in pdf["x"]]
        for i in range(len(pdf) + 1):
            if i == len(pdf) or (i > begin and (many + sizes[i] > _BATCH or i - begin >= _SETS)):
                keep, h, starts = sets_of(pdf["x"].iloc[begin:i].tolist()) if i > begin else ((), None, None)
                if len(keep):
                    c = mix(np.add.reduceat(mix(h + np.uint64(4321)), starts[:-1]) + np.diff(starts).astype(np.uint64))
                    yield pdf.iloc[begin + keep], h, starts, c
                begin, many = i, 0
            many += sizes[i] if i < len(pdf) else 0


def _parities(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each set's elements in cells, two elements a cell at most, and the 64-bit words of each (a power of two).

    Two sets differ in at least as many elements as their parities in bits.
    """
    n = np.diff(starts)
    words = np.minimum(16, 1 << np.ceil(np.log2(np.maximum(n / 128, 1))).astype(np.int64))
    begin = np.cumsum(words) - words
    cell = (np.repeat(begin, n) << 6) + (mix(h + np.uint64(99)) & np.repeat(64 * words - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), words


def _packed(part: int, take: np.ndarray, own: np.ndarray, low: np.ndarray, c: np.ndarray, n: np.ndarray, asks: np.ndarray, bits: np.ndarray, words: np.ndarray) -> bytes:
    """The keys of a part as bytes: class, size, parities of each set that has some, then 5 bytes a key."""
    who, many = np.unique(own[take], return_counts=True)
    at = np.repeat((np.cumsum(words) - words)[who], words[who]) + np.arange(words[who].sum()) - np.repeat(np.cumsum(words[who]) - words[who], words[who])
    key = low[take]
    fields = (c[who], bits[at], n[who].astype(np.uint32), many.astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), words[who].astype(np.uint8), asks[who].astype(np.uint8), (key >> np.uint64(32)).astype(np.uint8))
    return np.array([len(who), len(at), len(take)], dtype=np.uint32).tobytes() + b"".join(x.tobytes() for x in fields)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    sets, words, keys = np.frombuffer(blob, dtype=np.uint32, count=3).tolist()
    out, at = [], 12
    for kind, many in ((np.uint64, sets), (np.uint64, words), (np.uint32, sets), (np.uint32, sets), (np.uint32, keys), (np.uint8, sets), (np.uint8, sets), (np.uint8, keys)):
        out.append(np.frombuffer(blob, dtype=kind, count=many, offset=at))
        at += out[-1].nbytes
    return out


def _bits_apart(bits: np.ndarray, begin: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the parities of sets a and b differ; the longer ones are folded."""
    out, least = np.zeros(len(a), dtype=np.int64), np.minimum(words[a], words[b])
    for m in np.unique(least).tolist():
        at = np.flatnonzero(least == m)
        x, y = a[at], b[at]
        for j in range(m):
            v = bits[begin[x] + j] ^ bits[begin[y] + j]
            for s in (x, y):
                for k in range(j + m, int(words[s].max()), m):
                    v ^= np.where(words[s] > k, bits[np.minimum(begin[s] + k, len(bits) - 1)], np.uint64(0))
            out[at] += np.bitwise_count(v)
    return out


def _meetings(blobs: list[bytes], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of a part that share a key, of which one asks, and whose sizes and parities fit."""
    c, bits, n, many, low, words, asks, high = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
    classes, first, number = np.unique(c, return_index=True, return_inverse=True)
    asked = np.bincount(number, weights=asks, minlength=len(classes)) > 0  # of copies, any
    begin, size, words = (np.cumsum(words, dtype=np.int64) - words)[first], n[first].astype(np.int64), words[first].astype(np.int64)
    owner, key = np.repeat(number, many), (high.astype(np.uint64) << np.uint64(32)) | low
    rounds = max(1, -(-len(key) // _SORTED))
    for r in range(rounds):
        mine = np.flatnonzero(key % np.uint64(rounds) == r)
        order = mine[np.lexsort((owner[mine], key[mine]))]
        k, o = key[order], owner[order]
        once = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
        k, o = k[once], o[once]
        last = np.searchsorted(k, k, side="right")
        left, found = np.arange(len(k)), []
        for s in range(1, len(k)):
            left = left[left + s < last[left]]
            if not len(left):
                break
            a, b = o[left], o[left + s]
            fits = (asked[a] | asked[b]) & (size[a] * den >= size[b] * num) & (size[b] * den >= size[a] * num)
            a, b = a[fits], b[fits]
            near = _bits_apart(bits, begin, words, a, b) <= most_apart(size[a], size[b], num, den)
            found.append(np.unique(np.minimum(a, b)[near] * len(classes) + np.maximum(a, b)[near]))
        if found:
            x, y = np.divmod(np.unique(np.concatenate(found)), len(classes))
            yield classes[x], classes[y]


def near_sets(rows: DataFrame, sets_of: SetsOf, num: int = 85, den: int = 100) -> DataFrame:
    """(a, b, overlap, united), a < b: all pairs of rows whose sets have overlap / union >= num / den, in integers.

    rows: id, x, p; x is what sets_of makes sets of, and pairs of which p holds for neither row are
    left out. Equal sets are one class. Classes meet by the keys of functions/keys.py, which lose
    no pair; keys are sent as packed bytes with each set's size and parities, which tell most
    chance meetings without loss, and never the sets. Where less than half of the elements are of
    rows with p, the keys of other rows are sent only if a filter says that one with p may have them.
    What is left is compared exactly. x is read again for every step instead of being written. Rows of
    one id are one row: of one of their sets.
    """
    if num * CLASS_RATIO < den:
        raise ValueError("sets that are less alike don't share keys")
    spark, kind, given = rows.sparkSession, rows.schema["id"].dataType.simpleString(), rows.schema["x"].dataType.simpleString()
    rows = rows.select("id", "x", "p").filter("id is not null and x is not null")

    def member(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _, starts, c in _batched(frames, sets_of):
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "c": c.view(np.int64), "n": np.diff(starts), "p": pdf["p"].to_numpy()})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for _, h, _, _ in _batched(frames, sets_of):
            total += np.bincount(buckets(h), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    members = written(rows.mapInPandas(member, f"id {kind}, c long, n long, p boolean").groupBy("id").agg(F.min(F.struct("c", "n")).alias("m"), F.bool_or("p").alias("p")).select("id", "m.c", "m.n", "p"))
    many, elements, asking = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("p"), F.col("n"))), F.lit(0))).first()
    parts = max(min(_PARTS, 1 + many // 5_000), many // _PART)
    sums = rows.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for _, h, starts, _ in _batched(frames, sets_of):
            yield np.concatenate(coarse_keys(h, starts, shared.value, num, den)).view(np.uint64)

    known = spark.sparkContext.broadcast(marks(rows.filter("p"), asked, width(int(_KEYS * asking), _BITS), _PROBES) if 2 * asking < elements else None)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, h, starts, c in _batched(frames, sets_of):
            keys = coarse_keys(h, starts, shared.value, num, den)
            own, key = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys).view(np.uint64)
            if known.value is not None:
                meets = pdf["p"].to_numpy(dtype=bool)[own]
                meets[passing(known.value, key, _PROBES)] = True
                own, key = own[meets], key[meets]
            part, low = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int32), key & np.uint64((1 << 40) - 1)
            bits, words = _parities(h, starts)
            asks, order = pdf["p"].to_numpy(dtype=bool), np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            some = [(p, order[ends[p] : ends[p + 1]]) for p in range(parts) if ends[p] < ends[p + 1]]
            yield pd.DataFrame({"part": [p for p, _ in some], "blob": [_packed(p, take, own, low, c, np.diff(starts), asks, bits, words) for p, take in some]})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs = [b for pdf in frames for b in pdf["blob"]]  # of one part
        for x, y in _meetings(blobs, num, den) if blobs else ():
            yield pd.DataFrame({"ca": x.view(np.int64), "cb": y.view(np.int64)})

    cand = written(rows.mapInPandas(keyed, "part int, blob binary").repartitionById(parts, F.col("part")).mapInPandas(meet, "ca long, cb long").distinct())
    shared.destroy()
    known.destroy()
    used = written(cand.select(F.col("ca").alias("c")).union(cand.select("cb")).distinct())
    few = used.count() <= PICKED
    picked = spark.sparkContext.broadcast(np.sort(used.toArrow()["c"].to_numpy()) if few else None)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _, _, c in _batched(frames, sets_of):
            own = c.view(np.int64)
            keep = np.isin(own, picked.value) if picked.value is not None else np.ones(len(own), dtype=bool)
            yield pd.DataFrame({"c": own[keep], "x": pdf["x"][keep]})

    found = rows.mapInPandas(pick, f"c long, x {given}")
    sets = written((found if few else found.join(used, "c", "left_semi")).dropDuplicates(["c"]))
    picked.destroy()

    @F.pandas_udf("overlap long, united long")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for k in range(0, len(a), 500):
            both = a.iloc[k : k + 500].tolist() + b.iloc[k : k + 500].tolist()
            _, h, starts = sets_of(both)
            own = [h[starts[i] : starts[i + 1]] for i in range(len(both))]
            half = len(both) // 2
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(own[:half], own[half:], strict=True)]
            out += [(o, len(x) + len(y) - o) for o, x, y in zip(common, own[:half], own[half:], strict=True)]
        return pd.DataFrame(out, columns=["overlap", "united"])

    left, right = sets.select(F.col("c").alias("ca"), F.col("x").alias("xa")), sets.select(F.col("c").alias("cb"), F.col("x").alias("xb"))
    near = cand.join(left, "ca").join(right, "cb").select("ca", "cb", compared("xa", "xb").alias("v")).select("ca", "cb", "v.*").filter(F.col("overlap") * den >= F.col("united") * num)
    x, y = members.select(F.col("id").alias("x"), F.col("c").alias("ca"), F.col("p").alias("px")), members.select(F.col("id").alias("y"), F.col("c").alias("cb"), F.col("p").alias("py"))
    apart = near.join(x, "ca").join(y, "cb").filter("px or py").select("x", "y", "overlap", "united")
    same = members.select(F.col("id").alias("x"), F.col("c").alias("cb"), "n", F.col("p").alias("px")).join(y, "cb").filter("x < y and (px or py)").select("x", "y", F.col("n").alias("overlap"), F.col("n").alias("united"))
    return apart.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap", "united")


def exact_similar(sets: DataFrame, num: int = 85, den: int = 100, probe: Column | None = None) -> DataFrame:
    """near_sets of sets: id, tokens (array).

    `probe` limits the pairs to those with at least one row for which it holds. Empty and null
    sets pair with nothing. Tokens are compared by 64 bits of a hash.
    """
    p = F.lit(True) if probe is None else F.coalesce(probe, F.lit(False))
    return near_sets(sets.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("x"), p.alias("p")), tokens_of, num, den)


def shingle_table(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tokens): hashed 5-character shingles of every text that isn't null."""

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [py_squeezed(t) for t in pdf["text"]]
            out = []
            for i in range(0, len(texts), 500):
                h, starts = shingle_sets(texts[i : i + 500])
                out += [h[starts[k] : starts[k + 1]].astype(np.int64) for k in range(len(starts) - 1)]
            yield pd.DataFrame({"id": pdf["id"], "tokens": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("id"), F.col(text).alias("text")).dropna().mapInPandas(on, f"id {kind}, tokens array<long>")

