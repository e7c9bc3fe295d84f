"""Tables that cut a plan: written once, read back with their true size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is set and one machine does all
    (tests). On a cluster without one, executors would write to disks that others don't see: that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "engram-stage-tables")
    return at.rstrip("/")


@contextmanager
def _shuffle_files_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back.

    A lost executor then costs only the tasks of the running stage, and joins see the real size.
    Shuffle files of the write are dropped as soon as it ends.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    with _shuffle_files_end_with_the_write(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, parts: Iterator[DataFrame], schema: str, name: str) -> DataFrame:
    """The union of what each block gives. All but the last are written before the next block is read, so that the driver
    and the plan hold one block, however many queries there are."""
    done, last = [], None
    for part in parts:
        if last is not None:
            done.append(materialize(last, name))
        last = part
    if last is None:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, done, last)
