"""The folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

#: Used only where a local session names no shared folder, as in tests.
FALLBACK_DIR = "file:///tmp/checkpoints/tidemark"
#: Rows with whole contents in one Arrow batch between the JVM and Python, at most.
CONTENT_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A cluster must name one: a folder of one machine would be lost with it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def tasks_of(spark: SparkSession) -> int:
    """Tasks that keep all cores busy, however few files or directories the rows come from."""
    return 2 * spark.sparkContext.defaultParallelism


def bounded_batches(spark: SparkSession) -> None:
    """With Spark's default of 10,000 rows a batch of contents grows with the input, in both processes of every task, until it is full."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > CONTENT_ROWS:
        spark.conf.set(key, str(CONTENT_ROWS))
