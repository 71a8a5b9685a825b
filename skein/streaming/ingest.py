"""Incremental edge ingest: a stream of events as edges from users to event types, with running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.storage import new_path


def edge_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """``(user_id, event_type, ts)`` as files of events arrive."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    return stream.select("user_id", "event_type", "ts")


def degree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, n_events, n_types)`` after the stream is drained: each micro-batch is reduced to one row per edge and appended, and degrees are read from the sums."""
    out, mark = new_path(spark, "edges"), new_path(spark, "progress")

    def append(batch: DataFrame, number: int) -> None:
        # a batch run again replaces its own folder
        batch.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = edge_stream(spark, f"{sf_dir}/events.parquet").writeStream.foreachBatch(append).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    edges = spark.read.schema("user_id long, event_type string, n long").parquet(out)
    per = edges.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))
    return per.groupBy("user_id").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_types"))
