"""Queries that write to a sink and give what stands there afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.labels import language_key
from corpusmill.operators import filters
from corpusmill.plans.corpus import QUALITY, RECORDS
from corpusmill.plans.registry import query
from corpusmill.plans.streams import place
from corpusmill.session import table
from corpusmill.sources import sinks


@query("quarantine_sink", "K3", f"SELECT reason IS NOT NULL AS quarantined, reason, count(*) AS lines, sum(coalesce(n_chars, 0))::BIGINT AS chars FROM (SELECT n_chars, {QUALITY} AS reason FROM documents) GROUP BY 1, 2")
def _(spark, d):
    good, bad = place(spark, "good"), place(spark, "bad")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", filters.quality(F.col("text"), language_key(F.col("lang"))).alias("reason"))
    sinks.with_quarantine(rows, "reason", good, bad)
    schema = "doc_id long, n_chars long"
    both = spark.read.schema(schema).parquet(good).withColumn("reason", F.lit(None).cast("string")).unionByName(spark.read.schema(f"{schema}, reason string").parquet(bad))
    return both.groupBy(F.col("reason").isNotNull().alias("quarantined"), "reason").agg(F.count("*").alias("lines"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


@query("jsonl_by_split", "K2", f"WITH r AS ({RECORDS}) SELECT split, count(*) AS records, sum(length(text))::BIGINT AS chars, min(id) AS first FROM r WHERE split IS NOT NULL GROUP BY split")
def _(spark, d):
    path = place(spark, "splits")
    sinks.jsonl_by_split(table(spark, d, "samples").select("id", "split", "text").dropDuplicates(["id"]).filter("split is not null"), path)
    rows = spark.read.schema("id string, text string, split string").json(path)
    return rows.groupBy("split").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"), F.min("id").alias("first"))


@query("csv_export", "K6", "SELECT source, license, to_json(langs)::VARCHAR AS langs FROM source_specs")
def _(spark, d):
    path = place(spark, "csv")
    sinks.csv_export(table(spark, d, "source_specs"), path, ["source", "license", "langs"])
    return spark.read.schema("source string, license string, langs string").option("header", True).option("escape", "\\").csv(path)


@query("rollout_log", "K9 K1 P12", """SELECT substr(sha256('{"policy":"p-1","tasks":["a","b"],"temperature":0.7}'), 1, 16) AS name, count(*) AS rollouts, 'p-1' AS policy FROM (SELECT DISTINCT id FROM samples WHERE stage = 'sft')""")
def _(spark, d):
    path = place(spark, "rollouts")
    rows = table(spark, d, "samples").filter("stage = 'sft'").select("id").distinct()
    name = sinks.rollout_log(rows, path, {"temperature": 0.7, "tasks": ["a", "b"], "policy": "p-1"})
    bound = spark.read.schema("policy string").option("multiLine", True).json(f"{path}/{name}.json")
    kept = spark.read.schema("id string, binding string").parquet(f"{path}/{name}").groupBy(F.col("binding").alias("name")).agg(F.count("*").alias("rollouts"))
    return kept.join(bound.withColumn("name", F.lit(name)), "name").select("name", "rollouts", "policy")


@query("markdown_report", "K7", "SELECT '| ' || source || ' | ' || stage || ' | ' || coalesce(license, '') || ' |' AS line FROM source_specs UNION ALL VALUES ('| source | stage | license |'), ('| --- | --- | --- |')")
def _(spark, d):
    rows = table(spark, d, "source_specs").select("source", "stage", "license").orderBy("source").collect()  # a row a source
    text = sinks.markdown([r.asDict() for r in rows], ["source", "stage", "license"])
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")
