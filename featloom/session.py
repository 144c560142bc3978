"""Session settings the jobs rely on: work folder, safe materialisation, parallel actions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is used only by a
    ``local`` master, where driver and executors share one disk.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="featloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so later jobs scan columns instead of recomputing, and survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/featloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_parallel(spark: SparkSession, jobs: Sequence[Callable], width: int = 4) -> list:
    """Run independent Spark actions from ``width`` driver threads, results in input order."""
    if len(jobs) <= 1 or width <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=width) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [future.result() for future in futures]
