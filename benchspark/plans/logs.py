"""The append logs read as streams, run to the end of the data at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchspark.plans import bindings as b
from benchspark.plans.assembly import ERROR_SUMMARY, SNAPSHOTS
from benchspark.plans.registry import query
from benchspark.session import shared_dir
from benchspark.streaming import logs


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table's files as a stream; files that arrive later are picked up by the next run."""
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    """SELECT sample_uid, model_key, min(pos) AS pos, arg_min(inference_answer, pos) AS inference_answer, arg_min(error, pos) AS error
FROM predictions GROUP BY 1, 2""",
    b.SCORING[:2],
)
def stream_first_rows(spark, sf):
    """Predictions, the first of each sample and model with its answer."""
    lines = stream_table(spark, sf, "lineitem")
    s = b.prediction_columns(lines).select("sample_uid", "model_key", "pos", "inference_answer", "error")
    out = shared_dir(spark, "predictions")
    logs.ingest_first(s, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").select(*s.columns)


@query(ERROR_SUMMARY)
def stream_error_counts(spark, sf):
    e = stream_table(spark, sf, "events").select(
        (F.col("user_id") % 5).cast("int").alias("task_id"), F.col("event_type").alias("stage"),
        F.when(F.col("value") > 10, "quota").otherwise("").alias("error_type"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k").cast("int") % 3).alias("model"),
    )
    out = shared_dir(spark, "errors")
    logs.error_counts(e, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return logs.error_totals(spark, f"{out}/counts")


@query(
    f"""WITH s AS (SELECT event_id AS pos, user_id % 4 + 1 AS task_id, true AS accepted FROM events WHERE event_type = 'purchase'), {SNAPSHOTS}
SELECT pos, CAST(total_accepts AS BIGINT) AS total_accepts, task1, task2, task3, task4, array_to_string(list_reverse(latest), ',') AS last_samples FROM a WHERE total_accepts % 5 = 0"""
)
def stream_accepts(spark, sf):
    """The snapshots that the batches of the accept log leave."""
    e = stream_table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("bundle_key"), (F.col("user_id") % 4 + 1).cast("int").alias("task_id")
    )
    out = shared_dir(spark, "accepts")
    logs.accept_log(e, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return logs.accept_snapshots(spark, f"{out}/log").withColumn("last_samples", F.array_join("last_samples", ","))
