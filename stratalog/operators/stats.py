"""Folds over files and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.visibility import running_sum

#: Upper edges of the latency histogram in microseconds, inclusive. Fixed values.
EDGES = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 5000, 10000, 100000)


def level_stats(files: DataFrame) -> DataFrame:
    """Files and bytes of each level."""
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"))


def file_bounds(rows: DataFrame, file: str = "file", key: str = "key") -> DataFrame:
    """Smallest and largest key and sequence of each file, and its rows."""
    return rows.groupBy(file).agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("n_rows")
    )


def overlapping_files(files: DataFrame) -> DataFrame:
    """Pairs of files (a < b) whose key ranges meet, both ends included. The file table is metadata, not data."""
    a = files.select(F.col("file").alias("a"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"))
    b = files.select(F.col("file").alias("b"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"))
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("a_max") >= F.col("b_min")) & (F.col("b_max") >= F.col("a_min"))).select("a", "b")


def hit_rate(hits: Column, misses: Column) -> Column:
    """Share of hits; 0 without traffic."""
    return F.coalesce(hits / F.nullif(hits + misses, F.lit(0)), F.lit(0.0))


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """Mean, the values at index int(n * p) of the sorted list (n - 1 at most) for each p, and the largest.

    The values are counted first, so equal ones are one row; ranks are running sums over those counts, by ranges of values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_sum(counts, "v", F.col("n"), "upto")
    total = placed.agg(F.sum("n").alias("total"))  # one row
    placed = placed.join(F.broadcast(total))
    ranks = [F.least((F.col("total") * F.lit(p)).cast("long"), F.col("total") - 1) for p in shares]
    names = [f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}" for p in shares]
    return placed.agg(
        F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.max("v").alias("max"),
        *[F.min(F.when(F.col("upto") > r, F.col("v"))).alias(name) for r, name in zip(ranks, names, strict=True)],
    )


def histogram(rows: DataFrame, value: str, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Rows in each bucket: bucket i holds values up to edges[i], the last what is above all edges."""
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(F.col(value) <= F.lit(e), i).otherwise(bucket)
    return rows.filter(F.col(value).isNotNull()).groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
