"""Change feeds as streams: each micro-batch of a spool is applied to the stored table.

The stored table keeps, besides the live records, the last order key and state of every key it
has seen, so that a change that was already applied, or that comes too late, is told apart from
a new one. A batch touches the keys it names only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import replay, spool_changes

LOG = "change_no bigint, moment bigint, spool_seq int, op string, key string, payload string"


def read_spool(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder to which spool files are added, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_to_log(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a batch's usable changes to a log table, each batch once.

    A batch that is delivered again replaces its own part of the log, so nothing is doubled.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spool_changes(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def state(spark: SparkSession, path: str) -> DataFrame:
    """(rid, change_no, payload): the records live after all changes of a log, whatever the order in which they came."""
    log = spark.read.schema(LOG).parquet(f"{path}/batch=*")
    once = log.groupBy("change_no").agg(F.min_by(F.struct("moment", "spool_seq", "op", "key", "payload"), F.struct("moment", "spool_seq")).alias("c")).select("change_no", "c.*")
    return replay(once.withColumnRenamed("key", "rid"), "rid", ["moment", "spool_seq"], "change_no", "op", ["change_no", "payload"])


def start(stream: DataFrame, log: str, checkpoint: str, once: bool = True):
    """Starts the stream into a log; with ``once`` it ends when what is there has been read."""
    writer = stream.writeStream.foreachBatch(apply_to_log(log)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_per_hour(stream: DataFrame, time: str = "received_at", late: str = "2 days") -> DataFrame:
    """(window, action, n): changes received per hour and action; rows later than the watermark are left out of it."""
    at = stream.withColumn(time, F.col(time).cast("timestamp"))
    return at.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("window"), F.lower(F.trim("action")).alias("action")).agg(F.count("*").alias("n"))
