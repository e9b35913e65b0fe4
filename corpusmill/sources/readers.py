"""Sources: files of records, metric logs, run folders, tables, archives.

Schemas are given, never inferred; torn rows go to a column, not to an error.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"
#: Longest line of a JSON lines file that is read, in bytes.
LINE_BYTES = 2 << 20

SAMPLES = "id string, stage string, source string, task string, first_question string, text string, payload string, simhash string, group_root string, split string"
METRICS = "run string, event string, step long, lm_loss double, step_seconds double, input_batch_actual long, tokens_per_second double, ce_per_second double, token_ledger struct<ce_tokens:long,input_tokens:long,optimizer_updates:long,images:long>, logged_at string, received_at string"


def shuffled_parquet(spark: SparkSession, path: str, seed: int, skip: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files in a seeded order with their origin (file:row) and place.

    The order depends on seed, file and row number only, so a later read may skip what an
    earlier one took.
    """
    from corpusmill.operators.windows import numbered

    raw = spark.read.parquet(path)
    raw = raw.select(*(columns or raw.columns), F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string")).alias("origin"))
    placed = numbered(raw.withColumn("_s", F.xxhash64(F.lit(seed), "origin")), ["_s", "origin"], "place").drop("_s")
    return placed.filter(F.col("place") >= skip)


def json_lines(spark: SparkSession, path: str, schema: str | StructType, limit: int | None = None) -> DataFrame:
    """Records of JSON lines, gzip or plain, with _corrupt for torn ones; the first `limit` by file and line."""
    ddl = f"{schema}, {CORRUPT} string" if isinstance(schema, str) else StructType([*schema.fields]).add(CORRUPT, "string")
    out = spark.read.schema(ddl).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return out if limit is None else out.limit(limit)


def bounded_lines(spark: SparkSession, path: str, schema: str, most: int = LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, audit) of JSON lines whose lines may be too long: those are skipped whole and counted.

    audit: lines, oversize, torn.
    """
    lines = spark.read.text(path)
    size = F.octet_length("value")
    parsed = lines.select("value", size.alias("n"), F.when(size <= most, F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})).alias("r"))
    good = parsed.filter(F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    audit = parsed.agg(F.count("*").alias("lines"), F.count(F.when(F.col("n") > most, 1)).alias("oversize"), F.count(F.when(F.col(f"r.{CORRUPT}").isNotNull(), 1)).alias("torn"))
    return good, audit


def canonical(spark: SparkSession, path: str) -> DataFrame:
    """The samples table; order only where it is written out."""
    return spark.read.schema(SAMPLES).parquet(path)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric log lines that are whole, with their file; torn lines are dropped."""
    rows = spark.read.schema(f"{METRICS}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.withColumn("file", F.col("_metadata.file_path")).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def run_files(spark: SparkSession, roots: list[str], schema: str, glob: str = "*.json") -> DataFrame:
    """One row a JSON document found under any root, with its path; torn documents have _corrupt."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("columnNameOfCorruptRecord", CORRUPT)
        .json(roots).withColumn("path", F.col("_metadata.file_path"))
    )


def devices(lines: DataFrame, column: str = "value") -> DataFrame:
    """index, name, used_mib, total_mib, free_mib of a device listing in CSV; malformed rows are dropped."""
    p = F.transform(F.split(column, ","), lambda x: F.trim(x))
    num = lambda i: F.regexp_replace(F.get(p, i), r"\s*MiB$", "").try_cast("long")
    out = lines.filter(F.size(p) == 4).select(F.get(p, 0).try_cast("int").alias("index"), F.get(p, 1).alias("name"), num(2).alias("used_mib"), num(3).alias("total_mib"))
    return out.dropna().withColumn("free_mib", F.col("total_mib") - F.col("used_mib"))


def free_devices(rows: DataFrame, count: int, least_mib: int, name: str | None = None) -> DataFrame:
    """The `count` devices with the most free memory, ties by index; in index order."""
    own = rows.filter(F.col("free_mib") >= least_mib)
    own = own if name is None else own.filter(F.contains("name", F.lit(name)))
    return own.orderBy(F.desc("free_mib"), "index").limit(count).orderBy("index")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 of files; see verified."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, stated: DataFrame) -> DataFrame:
    """(path, fault): files whose hash isn't the stated one, or that are missing."""
    j = stated.select("path", F.col("sha256").alias("_want")).join(found.select("path", "sha256"), "path", "left")
    return j.select("path", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("_want"), "hash_differs").alias("fault")).filter("fault is not null")


def safe_member(name: str) -> bool:
    """Whether an archive member's name stays inside its folder."""
    parts = name.split("/")
    return bool(name) and not name.startswith("/") and ".." not in parts and "\x00" not in name


def tar_pairs(spark: SparkSession, path: str, data: str = ".json", other: str = ".mp4") -> DataFrame:
    """archive, key, metadata, content of aligned member pairs; unsafe names are refused with an error.

    An archive is one row of the binary source, so it should stay well below executor memory.
    """

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                held: dict[str, dict[str, bytes]] = {}
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if not m.isfile():
                            continue
                        if not safe_member(m.name):
                            raise ValueError(f"unsafe member name in {archive}")
                        for end in (data, other):
                            if m.name.endswith(end):
                                held.setdefault(m.name[: -len(end)], {})[end] = tar.extractfile(m).read()
                for key, two in sorted(held.items()):
                    if len(two) == 2:
                        json.loads(two[data])
                        out.append((archive, key, two[data].decode("utf-8"), two[other]))
            yield pd.DataFrame(out, columns=["archive", "key", "metadata", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(on, "archive string, key string, metadata string, content binary")


def benchmark_items(rows: DataFrame, prompt: str, answer: str | None, role: str) -> DataFrame:
    """item, prompt, answer, role of one benchmark in the common shape."""
    own = F.lit(None).cast("string") if answer is None else F.col(answer).cast("string")
    return rows.select(F.col("item").cast("string").alias("item"), F.col(prompt).alias("prompt"), own.alias("answer"), F.lit(role).alias("role"))


def by_id(rows: DataFrame, ids: list[str], column: str = "id") -> DataFrame:
    """Rows of some ids; the predicate reaches the scan."""
    return rows.filter(F.col(column).isin(ids))
