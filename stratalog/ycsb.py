"""The batch harness: load, then mixes of reads, updates and scans, each batch one job or one commit.

Key choice is Zipf-like over the loaded keys. Keys are 24 bytes, so that none loses its digits. Figures are operations per
second of whole batches, not latencies of single operations.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import stats
from .operators.reads import next_rows
from .plans.materialise import materialise
from .store import Store

#: Shares of reads, updates, scans and inserts. Fixed values.
WORKLOADS = {"a": (0.5, 0.5, 0.0, 0.0), "b": (0.95, 0.05, 0.0, 0.0), "c": (1.0, 0.0, 0.0, 0.0), "e": (0.0, 0.0, 0.95, 0.05)}


def make_key(i: Column) -> Column:
    """'user' and 20 digits."""
    return F.encode(F.format_string("user%020d", i), "UTF-8")


def make_value(i: Column, size: int = 100) -> Column:
    """size bytes that repeat a text made of the number."""
    piece = F.concat(F.lit("v"), i.cast("string"), F.lit("."))
    return F.encode(F.substring(F.repeat(piece, size), 1, size), "UTF-8")


def zipf(n: int, theta: float = 0.99, size: int = 1, seed: int = 1) -> np.ndarray:
    """size ranks below n, rank r with a probability in proportion to 1 / (r + 1) ** theta, by the inverse of the
    continuous distribution."""
    u = np.random.default_rng(seed).random(size)
    top = (n + 1.0) ** (1 - theta)
    return np.minimum(((1 + u * (top - 1)) ** (1 / (1 - theta)) - 1).astype(np.int64), n - 1)


def zipf_column(n: int, theta: float = 0.99, seed: int = 1) -> Column:
    """The same as a Column, for keys drawn on the executors."""
    top = (n + 1.0) ** (1 - theta)
    return F.least(F.floor(F.pow(1 + F.rand(seed) * (top - 1), F.lit(1 / (1 - theta))) - 1), F.lit(n - 1)).cast("long")


@dataclass(frozen=True)
class Result:
    workload: str
    operations: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.operations / self.seconds


def load(spark: SparkSession, store: Store, records: int, value_size: int = 100) -> Result:
    began = time.perf_counter()
    store.write(spark.range(records).select(make_key(F.col("id")).alias("key"), make_value(F.col("id"), value_size).alias("value")))
    return Result("load", records, time.perf_counter() - began)


def run(spark: SparkSession, store: Store, workload: str, records: int, operations: int, value_size: int = 100, scan_keys: int = 100, seed: int = 1) -> Result:
    """One batch of a workload: its reads are one multi-get, its updates and inserts one commit, its scans one job."""
    reads, updates, scans, inserts = (int(operations * s) for s in WORKLOADS[workload])
    began = time.perf_counter()
    chosen = zipf_column(records, seed=seed)
    if updates or inserts:
        old = spark.range(updates).select(chosen.alias("i"))
        new = spark.range(records, records + inserts).select(F.col("id").alias("i"))
        store.write(old.unionByName(new).select(make_key(F.col("i")).alias("key"), make_value(F.col("i") + 1, value_size).alias("value")))
    if reads:
        keys = spark.range(reads).select(make_key(chosen).alias("key"))
        store.multi_get(keys).agg(F.count("value")).collect()
    if scans:
        _scans(spark, store, records, scans, scan_keys, seed).agg(F.count(F.lit(1))).collect()
    return Result(workload, reads + updates + scans + inserts, time.perf_counter() - began)


def _scans(spark: SparkSession, store: Store, records: int, scans: int, most: int, seed: int) -> DataFrame:
    """Rows of all scans: each starts at a key, drawn uniformly, and takes up to most of the next ones in key order."""
    starts = spark.range(scans).select(
        F.col("id").alias("scan"), make_key((F.rand(seed) * records).cast("long")).alias("start"), (F.rand(seed + 1) * most + 1).cast("int").alias("n")
    )
    return next_rows(store.scan(), materialise(starts))


def latencies(spark: SparkSession, store: Store, records: int, operations: int = 20, seed: int = 1) -> dict[str, dict[str, float]]:
    """Milliseconds of single operations, one after the other: median, 95th percentile and largest of gets, sets and scans of 100
    keys. A get or scan of files is a Spark job."""
    chosen = zipf(records, size=operations, seed=seed)
    named = [b"user%020d" % i for i in chosen]
    calls = {
        "get": lambda k: store.get(k),
        "set": lambda k: store.set(k, b"v" * 100),
        "get_buffered": lambda k: store.get(k),
        "scan": lambda k: store.scan(k).limit(100).collect(),
    }
    out = {}
    for name, call in calls.items():
        took = []
        for k in named:
            began = time.perf_counter()
            call(k)
            took.append((time.perf_counter() - began) * 1000)
        row = stats.percentiles(spark.createDataFrame([(t,) for t in took], "ms double"), "ms", (0.5, 0.95)).first()
        out[name] = {"p50": round(row["p50"], 3), "p95": round(row["p95"], 3), "max": round(row["max"], 3)}
    return out
