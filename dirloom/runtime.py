"""Session helpers shared by every operator: tables, bounded broadcasts, durable cuts."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes (as the planner knows them) up to which a side may be broadcast.
BROADCAST_BYTES = 16 << 20


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they see the same path; else it must be shipped with the job."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the optimizer's statistics: file sizes for scans, never less for what is derived of them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES, by: DataFrame | None = None, times: int = 1) -> DataFrame:
    """``df`` marked for broadcast if the plan's own statistics prove it small; no job is run.

    ``by`` is a frame of whose rows ``df`` has at most ``times`` as many, of no more bytes each,
    when ``df`` itself comes from an operation whose statistics say nothing. A larger side is
    returned unmarked: the join is then shuffled, and AQE splits its hot keys.
    """
    size = plan_bytes(df) if by is None else plan_bytes(by) * times
    return F.broadcast(df) if size <= max_bytes else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; its executors are this machine.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or f"file:/tmp/dirloom-{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later readers don't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, laid out by ``partition_by``; read back with pruning."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A frame that was cut, marked for broadcast if it has no more than ``max_rows`` rows, which are read from the cut to be counted. Its rows must be short."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
