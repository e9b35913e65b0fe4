"""Sinks. Outputs are immutable: writing over an existing one is an error."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from corpusmill.operators.windows import shards


def _store(path: str):
    """(JVM, file system, path) of a place on any store that Spark knows."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_json(path: str, value: object) -> None:
    """A small JSON document, put in place by a rename; on any store that Spark knows."""
    jvm, store, target = _store(path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = store.create(part, True)
    try:
        out.write(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1).encode("utf-8"))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), store.getConf())
    option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    over = jvm.java.lang.reflect.Array.newInstance(option, 1)
    jvm.java.lang.reflect.Array.set(over, 0, option.getField("OVERWRITE").get(None))
    context.rename(store.makeQualified(part), store.makeQualified(target), over)


def digest(value: object) -> str:
    """SHA-256 of JSON with sorted keys and compact separators."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def jsonl_by_split(rows: DataFrame, path: str, split: str = "split") -> None:
    rows.write.mode("errorifexists").partitionBy(split).json(path)


def with_quarantine(rows: DataFrame, reason: str, good: str, bad: str) -> None:
    """Rows without a reason to one place, the others with it to another. Cache or write rows first if they are costly."""
    rows.filter(F.col(reason).isNull()).drop(reason).write.mode("errorifexists").parquet(good)
    rows.filter(F.col(reason).isNotNull()).write.mode("errorifexists").parquet(bad)


def ragged(rows: DataFrame, path: str) -> None:
    """Encoded rows (arrays of tokens and labels)."""
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def compact_shards(rows: DataFrame, path: str, tokens: str, order: list[str], size: int, kind: str | None = None) -> None:
    """Encoded rows in folders of at most about `size` tokens in order, one kind a folder."""
    cut = shards(rows.withColumn("_n", F.size(tokens)), "_n", order, size).drop("_n", "offset")
    keys = ["shard"] if kind is None else [kind, "shard"]
    cut.write.mode("errorifexists").partitionBy(*keys).option("compression", "zstd").parquet(path)


def csv_export(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns; nested values as JSON text."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = [F.to_json(c).alias(c) if isinstance(kinds[c], ArrayType | MapType | StructType) else F.col(c) for c in columns]
    rows.select(*out).write.mode("errorifexists").option("header", True).csv(path)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table for people of a report that is small already."""
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(head + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def rollout_log(rows: DataFrame, path: str, binding: dict) -> str:
    """Rollouts under a name that their binding determines; the same binding can't be written twice."""
    name = digest(binding)[:16]
    rows.withColumn("binding", F.lit(name)).write.mode("errorifexists").parquet(f"{path}/{name}")
    write_json(f"{path}/{name}.json", binding)
    return name


def require_space(path: str, incoming: int, reserve: int = 10 << 30) -> None:
    """An error unless the store of a path, which must exist, has room for the incoming bytes and a reserve."""
    _, store, at = _store(path)
    free = store.getStatus(at).getRemaining()
    if free - incoming < reserve:
        raise OSError(f"{free} bytes free, {incoming} coming in, {reserve} to stay free")


def manifest(rows: DataFrame, keys: list[str]) -> list[dict]:
    """Counts a manifest states, by few keys."""
    return [r.asDict() for r in rows.groupBy(*keys).agg(F.count("*").alias("records")).orderBy(*keys).collect()]
