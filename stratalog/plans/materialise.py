"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Most files of a checkpoint for each core of the cluster.
FILES_PER_CORE = 2


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder of our own only where it is unset and the master is local."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratalog-"))
    return named or context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: computed once, so that partition numbers and range bounds stay what they are."""
    shared_folder(df.sparkSession)
    return df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism).checkpoint(eager=True)
