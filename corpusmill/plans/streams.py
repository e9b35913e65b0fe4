"""Queries that run a stream to its end and give what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.session import own_folder, table
from corpusmill.streaming import logs


def _stream(spark, d, name, files=1):
    """Rows of a table as they are delivered, file by file; the table is one file or a folder of them."""
    rows = spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", files)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(path):
        return rows.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return rows.parquet(f"{d}/{name}.parquet")


def place(spark, name):
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("streamed_ingestion", "X1 X5 X6", "SELECT run, event, count(*) AS n, max(step) AS last_step FROM run_metrics GROUP BY run, event")
def _(spark, d):
    # stopped and taken up again: the second run goes on at the committed cursor and adds nothing twice
    out, checkpoint = place(spark, "ingested"), place(spark, "cursor")
    for _ in range(2):
        rows = _stream(spark, d, "run_metrics").select("run", "event", "step")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run string, event string, step long").parquet(out).groupBy("run", "event").agg(F.count("*").alias("n"), F.max("step").alias("last_step"))


@query("completion_hooks", "X3", "SELECT run, step, count(*) AS fired FROM (SELECT DISTINCT run, step FROM run_metrics WHERE event = 'complete' AND run IS NOT NULL AND step IS NOT NULL) GROUP BY run, step")
def _(spark, d):
    out, done = place(spark, "fired"), place(spark, "done")
    act = lambda new, number: new.write.mode("append").parquet(out)
    for k in range(2):  # a new stream over the same log, without its cursor: keys that fired don't fire again
        rows = _stream(spark, d, "run_metrics").filter("event = 'complete'").select("run", "step").dropna()
        logs.exactly_once(rows, place(spark, f"cursor-{k}"), done, ["run", "step"], act).awaitTermination()
    schema = "run string, step long"
    found = spark._jvm.org.apache.hadoop.fs.Path(out)
    rows = spark.read.schema(schema).parquet(out) if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found) else spark.createDataFrame([], schema)
    return rows.groupBy("run", "step").agg(F.count("*").alias("fired"))


@query("streamed_windows", "X1 A14", "SELECT time_bucket(INTERVAL 1 DAY, received_at)::TIMESTAMP AS start, run, count(*) AS n, sum(input_batch_actual)::BIGINT AS input FROM run_metrics WHERE received_at IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    # the state is kept by window and run; the last state of each is what the sink holds in the end
    out = place(spark, "windows")
    rows = logs.with_event_time(_stream(spark, d, "run_metrics").filter("received_at is not null"), "received_at", "3650 days")
    own = logs.windowed(rows, "received_at", "1 day", ["run"], F.count("*").alias("n"), F.sum("input_batch_actual").alias("input"))

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    own.writeStream.outputMode("update").option("checkpointLocation", place(spark, "cursor")).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema("start timestamp, end timestamp, run string, n long, input long, batch long").parquet(out)
    last = states.groupBy("start", "run").agg(F.max_by(F.struct("n", "input"), "batch").alias("x"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "run", "x.n", "x.input")
