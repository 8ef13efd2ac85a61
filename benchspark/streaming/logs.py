"""Append logs as streams.

The logs never forget an id, so duplicates are dropped without a watermark. The ids seen are stream state in RocksDB, and
running counts pass from batch to batch, so no batch reads what earlier ones have written.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from benchspark.operators.assemble import error_summary, progress, running_totals


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB: on disk, with changes uploaded per batch, not on the heap."""
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_first(
    stream: DataFrame, path: str, checkpoint: str, keys=("sample_uid", "model_key"), pos: str = "pos", available_now: bool = True
) -> StreamingQuery:
    """First row of every sample and model (S1), in one folder per micro-batch under ``path``.

    Within a micro-batch the row of the lowest ``pos`` is kept, then the one of the lowest content; a key that an earlier
    batch has seen is dropped. A key's first row with the time of its batch is stream state in RocksDB, so a batch looks up
    its own keys only and its cost does not grow with the log. A row is new where its time is the newest that its key has
    seen. A repeated batch has the time it had before and replaces its folder.
    """
    keys = list(keys)
    others = [c for c in stream.columns if c not in (*keys, pos)]
    row = F.struct(F.col("__time"), F.col(pos), *[F.col(c) for c in others])
    # a batch's time is fixed when the batch is planned
    seen = stream.withColumn("__time", F.current_timestamp()).groupBy(*keys).agg(F.min(row).alias("r"), F.max("__time").alias("now"))

    def save(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where(F.col("r.__time") == F.col("now")).select(*keys, f"r.{pos}", *[f"r.{c}" for c in others])
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = seen.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    with rocksdb_state(stream.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def error_counts(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Error counts of every micro-batch under ``path``.

    A batch writes its own folder, so a repeated batch replaces its counts instead of adding to them.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        error_summary(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def error_totals(spark: SparkSession, path: str, seed: DataFrame | None = None) -> DataFrame:
    """Running totals over all batches, on top of the totals of an earlier log if given."""
    counts = spark.read.parquet(path).select("dimension", "value", "n")
    if seed is not None:
        counts = counts.unionByName(seed.select("dimension", "value", "n"))
    return counts.groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def accept_log(
    stream: DataFrame, path: str, checkpoint: str, keys=("bundle_key", "task_id"), every: int = 5, last: int = 5, pos: str = "pos", available_now: bool = True
) -> StreamingQuery:
    """Accepted samples, each once, under ``path``/log, and the snapshots at every ``every``-th of them under ``path``/snapshots (S3).

    Samples count in the order of batch, then ``pos``. A batch takes over the counts and the last samples that the batch
    before has left under ``path``/totals, one row, and adds its own; nothing reads the log again. Seen keys are state in
    RocksDB. Every batch writes folders of its own, so a repeated batch replaces them.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        here = f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}/log/{here}")
        rows = spark.read.schema(batch.schema).parquet(f"{path}/log/{here}")
        before = spark.read.parquet(f"{path}/totals/batch={batch_id - 1}").first() if batch_id else None
        progress(rows, every, pos, last=last, start=before).write.mode("overwrite").parquet(f"{path}/snapshots/{here}")
        running_totals(rows, last, pos, before).write.mode("overwrite").parquet(f"{path}/totals/{here}")

    writer = stream.dropDuplicates(list(keys)).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    with rocksdb_state(spark):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def accept_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots that the batches of an accept log have left (S3)."""
    return spark.read.parquet(f"{path}/snapshots").drop("batch")
