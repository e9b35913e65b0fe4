"""Problem 2: tokens by source, language and task under an existing tokenizer.

Counts are exact: see bpe.Counter. Labels are cleaned first: sources by spelling, languages by
the text, with the tag as a fallback, tasks by the source's own where they are missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.labels import language_key, source_key
from corpusmill.llm.base import samples
from corpusmill.llm.bpe import TOKENIZERS, VOCABULARY, Counter, read_ranks
from corpusmill.llm.language import detect
from corpusmill.session import table

#: Counters of a worker, by the vocabulary's bytes, as one name may stand for several files.
_ready: dict[bytes, Counter] = {}


def token_counter(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY):
    """A function that gives the counter on a worker; the file (under 1 MB) is broadcast."""
    data = read_ranks(folder, name)
    shared, digest = spark.sparkContext.broadcast(data), hashlib.sha256(data).digest()

    def get() -> Counter:
        if digest not in _ready:
            _ready[digest] = Counter(shared.value)
        return _ready[digest]

    return get


def counted(records: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id, source, task, tag, tokens, chars, lang) a record; repeated rows once.

    records: id, source, task, tag, text. A null text has no tokens; lang is null where the
    text does not show it. Rows with a null id are dropped.
    """
    get = token_counter(records.sparkSession, folder, name)

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = get()
        for pdf in frames:
            texts = [t or "" for t in pdf.pop("text")]
            pdf["tokens"] = [count(t) for t in texts]
            pdf["chars"] = [len(t) for t in texts]
            pdf["lang"] = [detect(t) for t in texts]
            yield pdf

    return records.filter("id is not null").mapInPandas(on, "id string, source string, task string, tag string, tokens long, chars long, lang string").dropDuplicates(["id"])


def cleaned(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """The same rows with source as in specs, task filled from specs, lang from text, tag or specs."""
    known = specs.select(source_key(F.col("source")).alias("source"), F.col("task").alias("own_task"), F.when(F.size("langs") == 1, F.col("langs")[0]).alias("own_lang")).dropDuplicates(["source"])
    out = rows.withColumn("source", source_key(F.col("source"))).join(known, "source", "left")
    task = F.coalesce(F.when(F.trim("task") != "", F.trim("task")), F.col("own_task"), F.lit("unknown"))
    lang = F.coalesce("lang", language_key(F.col("tag")), "own_lang", F.lit("und"))
    return out.withColumn("task", task).withColumn("lang", lang).withColumn("source", F.coalesce("source", F.lit("unknown"))).drop("own_task", "own_lang", "tag")


def cube(rows: DataFrame, keys: list[str], sums: dict[str, Column], every: str = "(all)") -> DataFrame:
    """Totals for every subset of the keys; `every` stands for a key that was summed over.

    Groups by all keys first, so that the expansion meets one row a group, not one a record.
    """
    fine = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    wide = fine.cube(*keys).agg(*[F.sum(n).alias(n) for n in sums], *[F.grouping(k).alias(f"_{k}") for k in keys])
    return wide.select(*[F.when(F.col(f"_{k}") == 1, every).otherwise(F.col(k)).alias(k) for k in keys], *sums)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir, "id", "source", "task", "text", "payload")
    rows = rows.select("id", "source", "task", F.regexp_extract("payload", r'"lang"\s*:\s*"([^"]*)"', 1).alias("tag"), "text")
    return cleaned(counted(rows), table(spark, sf_dir, "source_specs"))


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, task, records, tokens, chars: totals of every slice; (all) sums over a label."""
    return cube(_records(spark, sf_dir), ["source", "lang", "task"], {"records": F.count("*"), "tokens": F.sum("tokens"), "chars": F.sum("chars")})


def per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, lang, task, tokens, chars: a row a record."""
    return _records(spark, sf_dir).select("id", "source", "lang", "task", "tokens", "chars")
