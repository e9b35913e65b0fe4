"""Problem 1: records of the evaluation splits that also stand in the training split.

Evaluation texts, normalised, are sharded into blocks of bounded size; the passages of a block
become one Aho-Corasick automaton, and every distinct training text runs through it. Candidates
are compared exactly, and what of an evaluation text stands in near training texts is merged into
the coverage of that text. Records that open with the same question meet in an equi-join.

No near pair is lost: of an evaluation text with a distinct shingles, a near text lacks at most
a - ceil(0.85 a). The passages probed are the a - ceil(0.85 a) + 1 shingles that are rarest among
the training texts, so at least one of them stands in every near text, wherever the edits lie and
however often a text repeats itself. Before the exact comparison a candidate passes two bounds
that no near pair breaks: the sizes of the sets, and the bits in which their odd sketches differ.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.labels import source_key
from corpusmill.functions.shingles import WIDTH, jaccard_at_least, most_apart, odd_sketches, placed_shingles, shingle_sets
from corpusmill.functions.text import py_question, py_squeezed
from corpusmill.llm.base import DEN, NUM, batches, buckets, coarse_keys, probed, samples, shingle_counts, text_hash
from corpusmill.session import forget, written

#: Passages and characters of evaluation text in one automaton: bound what is broadcast (some
#: 15 MB) and the automaton in a Python worker (some 150 MB).
BLOCK_PROBES, BLOCK_CHARS = 1_200_000, 12_000_000
#: Candidates that are looked at as one array.
EXPANDED = 4_000_000


# ---------------------------------------------------------------- records and texts


def opening_key(payload: str | None) -> bytes | None:
    """Hash of the opening question with the pictures it is about; None where there is none.

    A payload that is null, torn or without a user turn with content has none.
    """
    if payload is None or '"turns"' not in payload:
        return None
    try:
        record = json.loads(payload)
        first = next((t.get("content") for t in record.get("turns") or [] if isinstance(t, dict) and t.get("role") == "user"), None)
        if not isinstance(first, str) or not first.strip():
            return None
        media = [str(m.get("rgb_sha256")) for m in record.get("media") or [] if isinstance(m, dict)]
    except (ValueError, AttributeError, TypeError):
        return None
    return text_hash(py_question(first) + "\x00" + "|".join(media))


def normalised(rows: DataFrame) -> DataFrame:
    """(id, split, source, th, qk, text) of every record with a split, written; text is squeezed.

    th and text are null for null and blank texts, qk where there is no opening question.
    """

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            squeezed = [(py_squeezed(t) or None) if t is not None else None for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "split": pdf["split"], "source": pdf["source"], "th": [s and text_hash(s) for s in squeezed], "qk": [opening_key(p) for p in pdf["payload"]], "text": squeezed})

    keyed = rows.select("id", "split", "source", "text", "payload").filter("id is not null and split is not null")
    return written(keyed.mapInPandas(on, "id string, split string, source string, th binary, qk binary, text string"))


def sides(rows: DataFrame) -> DataFrame:
    """(id, split, source, th, qk): the normalised records without their texts, repeated rows once."""
    return rows.select("id", "split", "source", "th", "qk").dropDuplicates(["id"])



def _held():
    return F.col("split").isin("val", "test")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(th, text, train, held), written: every text once, with the sides it stands on."""
    return written(rows.filter("th is not null").groupBy("th").agg(F.first("text").alias("text"), F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(_held()).alias("held")))


# ---------------------------------------------------------------- passages


def passages(text: str, counts: np.ndarray) -> np.ndarray:
    """Places of the shingles to probe, the rarest; where a shingle stands several times, the first."""
    each, first = np.unique(placed_shingles([text])[0], return_index=True)
    rare = np.lexsort((each, counts[buckets(each)]))
    return np.sort(first[rare[: probed(len(each))]])


def held_blocks(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(th, text, places, block), written: held-out texts with the passages to probe, in blocks."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(counts)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["places"] = [passages(t, shared.value).astype(np.int32) for t in pdf["text"]]
            yield pdf

    # shorter texts are near equal ones only
    own = written(texts.filter(f"held and length(text) >= {WIDTH}").select("th", "text").mapInPandas(choose, "th binary, text string, places array<int>"))
    shared.destroy()
    size = own.agg(F.sum(F.size("places")).alias("p"), F.sum(F.length("text")).alias("c")).first()
    number = max(1, -(-(size.p or 0) // BLOCK_PROBES), -(-(size.c or 0) // BLOCK_CHARS))
    out = written(own.withColumn("block", F.pmod(F.xxhash64("th"), F.lit(number)).cast("int")).repartitionByRange("block").sortWithinPartitions("block"))
    forget(own)
    return out


class Block:
    """Automaton over the probed passages of some evaluation texts."""

    def __init__(self, hashes: list[bytes], texts: list[str], places: list[np.ndarray]) -> None:
        self.hashes, self.texts = hashes, texts
        number: dict[str, int] = {}
        code = np.fromiter((number.setdefault(t[i : i + WIDTH], len(number)) for t, own in zip(texts, places, strict=True) for i in own.tolist()), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        order = np.argsort(code, kind="stable")
        self.owners = owner[order]
        self.starts = np.searchsorted(code[order], np.arange(len(number) + 1))
        self.automaton = ahocorasick.Automaton()
        for p, k in number.items():
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self.sizes = np.zeros(len(texts), dtype=np.int64)
        self.odd = np.zeros((len(texts), 16), dtype=np.uint64)
        for a, b in batches(texts):
            sets, starts = shingle_sets(texts[a:b])
            self.sizes[a:b], self.odd[a:b] = np.diff(starts), odd_sketches(sets, starts)

    def matched(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, passage) of every match, repeats included."""
        found = [np.fromiter((k for _, k in self.automaton.iter(t)), dtype=np.int64) for t in texts]
        return np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.concatenate(found)

    def candidates(self, texts: list[str], sizes: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Codes text * number of evaluation texts + evaluation text of all pairs within both bounds."""
        which, passage = self.matched(texts)
        many = self.starts[passage + 1] - self.starts[passage]
        upto, out, a = np.cumsum(many), [np.empty(0, np.int64)], 0
        while a < len(which):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + EXPANDED, side="right")))
            n = many[a:b]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[passage[a:b]], n)
            t, e = np.repeat(which[a:b], n), self.owners[at]
            fits = (sizes[t] * DEN >= self.sizes[e] * NUM) & (self.sizes[e] * DEN >= sizes[t] * NUM)
            code = np.unique(t[fits] * len(self.texts) + e[fits])
            t, e = np.divmod(code, len(self.texts))
            out.append(code[np.bitwise_count(odd[t] ^ self.odd[e]).sum(axis=1, dtype=np.int64) <= most_apart(sizes[t], self.sizes[e], NUM, DEN)])
            a = b
        return np.unique(np.concatenate(out))


def intervals(covered: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of true places."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


_built: dict[str, object] = {}


def _block(name: str, shared) -> Block:
    """The automaton of a broadcast block; a worker keeps the one it used last."""
    if _built.get("name") != name:
        _built.clear()
        _built["block"] = Block(*shared.value)
        _built["name"] = name
    return _built["block"]


_NEAR = "tt binary, te binary, begins array<int>, ends array<int>"


def _scan(name: str, shared):
    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _block(name, shared)
        for pdf in frames:
            own, hashes = pdf["text"].tolist(), pdf["th"].tolist()
            pairs, covered = [], {}
            for a, b in batches(own):
                some = own[a:b]
                sets, starts = shingle_sets(some)
                codes = block.candidates(some, np.diff(starts), odd_sketches(sets, starts))
                for t, e in zip(*(x.tolist() for x in np.divmod(codes, len(block.texts))), strict=True):
                    text, theirs = block.texts[e], sets[starts[t] : starts[t + 1]]
                    if hashes[a + t] == block.hashes[e] or not jaccard_at_least(theirs, shingle_sets([text])[0], NUM, DEN):
                        continue
                    pairs.append((hashes[a + t], block.hashes[e]))
                    hit = np.flatnonzero(np.isin(placed_shingles([text])[0], theirs))
                    mask = covered.setdefault(e, np.zeros(len(text), dtype=bool))
                    for k in range(WIDTH):
                        mask[hit + k] = True
            # what the texts of a batch cover of one evaluation text is merged before it leaves the task
            runs = [(block.hashes[e], *intervals(m)) for e, m in covered.items()]
            rows = [(*p, None, None) for p in pairs] + [(None, *r) for r in runs]
            if rows:
                yield pd.DataFrame(rows, columns=["tt", "te", "begins", "ends"], dtype=object)

    return on


def routed(train: DataFrame, blocks: DataFrame, counts: np.ndarray) -> DataFrame:
    """(th, text, block), written: training texts with the blocks that hold a text near them, and some others.

    Near texts share a key of several shingles (base.coarse_keys), so a text visits few blocks and
    no near pair is lost.
    """
    shared = train.sparkSession.sparkContext.broadcast(counts)

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own = pdf["text"].tolist()
            for a, b in batches(own):
                yield pd.DataFrame({"th": pdf["th"].iloc[a:b], "keys": coarse_keys(*shingle_sets(own[a:b]), shared.value)})

    keys = lambda df: df.select("th", "text").mapInPandas(on, "th binary, keys array<long>").select("th", F.explode("keys").alias("key"))
    held = keys(blocks).join(blocks.select("th", "block"), "th").select("key", "block").distinct()
    met = keys(train).join(held, "key").select("th", "block").distinct()
    out = written(train.join(met, "th").repartitionByRange("block").sortWithinPartitions("block"))
    shared.destroy()
    return out


def near_across(texts: DataFrame) -> DataFrame:
    """(tt, te, begins, ends): rows with tt are pairs of a training and a near held-out text, by
    their hashes; rows without hold intervals of te that stand in near training texts.

    One automaton a block. A block of bounded size is collected, broadcast, scanned with and
    destroyed before the next. A single block meets all training texts; where there are more,
    a text visits only those that it shares a key with.
    """
    spark = texts.sparkSession
    train = texts.filter("train").select("th", "text")
    counts = shingle_counts(train.select("text"))
    blocks = held_blocks(texts, counts)
    whole = texts.filter("train and held")
    out = whole.select(F.col("th").alias("tt"), F.col("th").alias("te"), F.lit(None).cast("array<int>").alias("begins"), F.lit(None).cast("array<int>").alias("ends"))
    out = out.unionByName(whole.select(F.lit(None).cast("binary").alias("tt"), F.col("th").alias("te"), F.array(F.lit(0)).alias("begins"), F.array(F.length("text")).alias("ends")))
    number = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    visits = train if number == 1 else routed(train, blocks, counts)
    for k in range(number):
        part = blocks.filter(F.col("block") == k).select("th", "text", "places").toArrow()  # BLOCK_PROBES and BLOCK_CHARS, about
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast((part["th"].to_pylist(), part["text"].to_pylist(), [np.asarray(p, dtype=np.int64) for p in part["places"].to_numpy()]))
        own = visits if number == 1 else visits.filter(F.col("block") == k).select("th", "text")
        found = written(own.mapInPandas(_scan(f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}", shared), _NEAR))
        shared.destroy()
        out = out.unionByName(found)
    return out


# ---------------------------------------------------------------- pairs and coverage


def text_pairs(near: DataFrame) -> DataFrame:
    return near.filter("tt is not null").select("tt", "te").distinct()


def coverage(near: DataFrame, texts: DataFrame) -> DataFrame:
    """(te, coverage): share of each held-out text's characters in the union of its matched intervals."""
    runs = near.filter("tt is null").select("te", F.explode(F.arrays_zip("begins", "ends")).alias("r")).select("te", "r.begins", "r.ends")
    before = Window.partitionBy("te").orderBy("begins", "ends").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("ends") - F.greatest(F.col("begins"), F.coalesce(F.max("ends").over(before), F.lit(0))))
    sums = runs.withColumn("new", new).groupBy("te").agg(F.sum("new").alias("chars"))
    return sums.join(texts.filter("held").select(F.col("th").alias("te"), F.length("text").alias("n")), "te").select("te", (F.col("chars") / F.col("n")).alias("coverage"))


def overlaps(rows: DataFrame) -> DataFrame:
    """(id_t, id_e): training and evaluation records that overlap, each pair once."""
    wide = normalised(rows)
    own = sides(wide)
    near = text_pairs(near_across(distinct_texts(wide)))
    train, held = own.filter("split = 'train'"), own.filter(_held())
    by_text = near.join(train.select(F.col("th").alias("tt"), F.col("id").alias("id_t")), "tt").join(held.select(F.col("th").alias("te"), F.col("id").alias("id_e")), "te").select("id_t", "id_e")
    by_question = train.filter("qk is not null").select("qk", F.col("id").alias("id_t")).join(held.filter("qk is not null").select("qk", F.col("id").alias("id_e")), "qk").select("id_t", "id_e")
    return by_text.unionByName(by_question).distinct()


_COLUMNS = ("id", "split", "source", "text", "payload")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_a, id_b: pairs of a training and an evaluation record with near texts or one question.

    Records without a split are on neither side. Null or blank texts are near nothing; an
    empty table gives no pair.
    """
    pairs = overlaps(samples(spark, sf_dir, *_COLUMNS))
    return pairs.select(F.least("id_t", "id_e").alias("id_a"), F.greatest("id_t", "id_e").alias("id_b"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, source, records, overlapping, near_pairs, question_pairs, mean_coverage: overlaps by evaluation split and source.

    source is spelled as in source_specs. near_pairs and question_pairs count training partners,
    a pair of both kinds in both. mean_coverage averages the covered shares of the records with a
    near training text. Counted by text and question, without writing pairs down.
    """
    wide = normalised(samples(spark, sf_dir, *_COLUMNS))
    own = sides(wide)
    texts = distinct_texts(wide)
    near = near_across(texts)
    train = own.filter("split = 'train'")
    copies = train.filter("th is not null").groupBy(F.col("th").alias("tt")).agg(F.count("*").alias("n"))
    partners = text_pairs(near).join(copies, "tt").groupBy(F.col("te").alias("th")).agg(F.sum("n").alias("n"))
    asked = train.filter("qk is not null").groupBy("qk").agg(F.count("*").alias("q"))
    held = own.filter(_held()).withColumn("source", source_key(F.col("source")))
    all_ = held.join(partners, "th", "left").join(coverage(near, texts).withColumnRenamed("te", "th"), "th", "left").join(asked, "qk", "left")
    return all_.groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count(F.coalesce("n", "q")).alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("near_pairs"), F.coalesce(F.sum("q"), F.lit(0)).alias("question_pairs"), F.round(F.avg("coverage"), 4).alias("mean_coverage")
    )
