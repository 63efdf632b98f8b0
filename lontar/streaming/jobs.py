"""The asynchronous job queue as tables and as a stream.

Jobs arrive as files. A document is claimed before it is run, so that each is run at most once: a repeated submission
changes nothing, and what an interrupted batch had claimed without a result counts as failed and isn't run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ("queued", "running", "done", "failed")


def state_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


SUMMARY = ("job_id", "document_id", "filename", "status", "created_at", "started_at", "finished_at", "duration_s", "error", "callback_status")


def summaries(jobs: DataFrame) -> DataFrame:
    """What is polled of a job: its state without its result."""
    return jobs.select(*[c for c in SUMMARY if c in jobs.columns])


def queue_positions(jobs: DataFrame, partition: str | None = None) -> DataFrame:
    """job_id and position of every queued job, first come first served; per partition column if one is named."""
    order = (Window.partitionBy(partition) if partition else Window.partitionBy()).orderBy("created_at", "job_id")
    return jobs.filter("status = 'queued'").select(*([partition] if partition else []), "job_id", F.row_number().over(order).alias("position"))


def newest(jobs: DataFrame, limit: int, partition: str) -> DataFrame:
    """The newest jobs of each partition."""
    order = Window.partitionBy(partition).orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def evict(jobs: DataFrame, keep: int, partition: str) -> DataFrame:
    """jobs without the oldest finished ones beyond ``keep`` in a partition; unfinished jobs always stay."""
    over = Window.partitionBy(partition)
    finished = F.col("status").isin("done", "failed")
    rank = F.row_number().over(over.orderBy(F.when(finished, 0).otherwise(1), "created_at", "job_id"))
    ranked = jobs.withColumn("total", F.count("*").over(over)).withColumn("rank", rank)
    return ranked.filter(~finished | (F.col("rank") > F.col("total") - keep)).drop("total", "rank")


def submitted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Job submissions as a file stream of JSON."""
    return spark.readStream.schema(schema).json(path)


BUCKETS = 64


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def run_queue(stream: DataFrame, checkpoint: str, runner: Callable[[DataFrame], DataFrame], store: str):
    """A started query that runs each new document at most once and appends its result to ``store``.

    Claims lie in ``store``-claims, by a bucket of the document, so that a batch reads the claims of its own buckets only.
    """

    def batch(jobs: DataFrame, number: int) -> None:
        spark, claims, attempt = jobs.sparkSession, f"{store}-claims", uuid.uuid4().hex
        docs = jobs.dropDuplicates(["document_id"]).withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int"))
        buckets = [r["bucket"] for r in docs.select("bucket").distinct().collect()]  # BUCKETS rows at most
        known = _stored(spark, claims)
        fresh = docs if known is None else docs.join(known.filter(F.col("bucket").isin(buckets)).select("document_id"), "document_id", "left_anti")
        fresh.select("document_id", F.lit(number).alias("batch"), F.lit(attempt).alias("attempt"), "bucket").write.mode("append").partitionBy("bucket").parquet(claims)
        own = spark.read.parquet(claims).filter(F.col("bucket").isin(buckets) & (F.col("batch") == number))
        docs = docs.drop("bucket")
        new = docs.join(own.filter(F.col("attempt") == attempt).select("document_id"), "document_id", "left_semi")
        cut = docs.join(own.filter(F.col("attempt") != attempt).select("document_id"), "document_id", "left_semi")
        results = _stored(spark, store)
        if results is not None:
            cut = cut.join(results.filter(F.col("batch") == number).select("document_id"), "document_id", "left_anti")
        failed = cut.withColumns({"status": F.lit("failed"), "error": F.lit("interrupted")})
        runner(new).unionByName(failed, allowMissingColumns=True).withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(store)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts by event type in tumbling windows; as a stream, state older than ``late`` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
