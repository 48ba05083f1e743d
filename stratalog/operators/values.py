"""Large values apart from the log: placement, late materialisation, dead bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INLINE, POINTER


def placement(value: Column, threshold: int) -> Column:
    """Kind of a value: a pointer from threshold bytes on, inline below; 0 keeps all inline."""
    return F.when(F.lit(threshold > 0) & (F.octet_length(value) >= threshold), POINTER).otherwise(INLINE)


def separate(points: DataFrame, threshold: int, file_num: int) -> tuple[DataFrame, DataFrame]:
    """points with pointers in the place of large values, and the values (file_num, row_id, key, seq, value).

    A value is found by its key and sequence, which name a version, in the files of file_num; row_id, a hash of them, is what
    a pointer of fixed length holds. Both halves can be computed apart and again.
    """
    large = (F.col("kind") == INLINE) & (placement(F.col("value"), threshold) == POINTER)
    row = F.xxhash64("key", "seq")
    pointer = F.struct(F.lit(file_num).cast("int").alias("file_num"), row.alias("row_id"), F.octet_length("value").cast("int").alias("length"))
    log = points.withColumn("_large", large).select(
        "key", "seq", F.when(F.col("_large"), POINTER).otherwise(F.col("kind")).alias("kind"),
        F.when(~F.col("_large"), F.col("value")).alias("value"), F.when(F.col("_large"), pointer).otherwise(F.col("pointer")).alias("pointer"),
    )
    return log, points.filter(large).select(F.lit(file_num).cast("int").alias("file_num"), row.alias("row_id"), "key", "seq", "value")


def dereference(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows with the values that their pointers name: joined after visibility, so only survivors are looked up, and rows
    without a pointer take no part in the join."""
    v = values.select(F.col("file_num").alias("_f"), F.col("key").alias("_k"), F.col("seq").alias("_s"), F.col("value").alias("_value"))
    named = rows.filter(F.col("kind") == POINTER)
    found = named.join(v, (F.col("pointer.file_num") == F.col("_f")) & (F.col("key") == F.col("_k")) & (F.col("seq") == F.col("_s")), "left")
    found = found.withColumn("value", F.col("_value")).drop("_f", "_k", "_s", "_value")
    return rows.filter(F.col("kind") != POINTER).unionByName(found)


def dead_bytes(before: DataFrame, after: DataFrame, framing: int = 0) -> DataFrame:
    """Per value file: bytes whose last pointer a compaction dropped."""
    a = before.filter(F.col("kind") == POINTER).select("pointer.*", "key", "seq")
    b = after.filter(F.col("kind") == POINTER).select("key", "seq")
    return a.join(b, ["key", "seq"], "left_anti").groupBy("file_num").agg(F.sum(F.col("length") + framing).cast("long").alias("dead_bytes"))
