"""The corpus pipeline: quality classifier, near-duplicates, decontamination, mixing, sharding.

Each stage reads what the one before it wrote. The pipeline is part of the subpackage stratalog.llm.

For all stages: null ids and null or empty texts are rows like others, repeated rows are rows of their own unless the stage
says otherwise, very long texts are read whole, ties are broken by ids and hashes, an empty table gives an empty table, and
columns beside those of documents pass through, whatever their names, all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontaminate, mixing, quality, sharding, simhash
from stratalog.llm.common import checkpoint, ensure_checkpoint_dir, held_out_remainder

SHARDS = 8


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Without labels of both kinds among the documents the score is the same for
    all: none stays if only bad ones are labelled, else all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels, held_out_remainder(F.col("doc_id"), 5) != 0))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, or one of the group if it has none. Of repeated rows one
    stays; texts without words are one group."""
    return simhash.keep_one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak nothing; an empty benchmark changes nothing."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Those without words are not taken; a null source is a
    source; a single source is taken to its target too."""
    return mixing.resample_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; equal rows have slots of their own."""
    return sharding.shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: Hashes and trained models are not to be had in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, and removed when the next one is written.
    The result is written too, so nothing of the run but it is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.delete(path(before), True)
        before = f"{folder}/{name}"
    result = checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    files.delete(path(folder), True)
    return result


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
