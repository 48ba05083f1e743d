"""Loading `key value` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key ends at the first space or tab; the rest, which may be empty, is the value.
LINE = "^([^ \\t]+)[ \\t]([\\s\\S]*)$"


def split_lines(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """key, value of each line. A line without a separator or with an empty key fails the query if strict, else it gives nulls."""
    text = F.col(column)
    good = text.rlike(LINE)
    key = F.when(good, F.regexp_extract(text, LINE, 1))
    if strict:
        key = F.coalesce(key, F.raise_error(F.concat(F.lit("no key and separator in line: "), F.coalesce(text, F.lit("")))).cast("string"))
    return lines.select(key.alias("key"), F.when(good, F.regexp_extract(text, LINE, 2)).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """key, value as bytes from a text file; empty lines are left out."""
    pairs = split_lines(spark.read.text(path).filter("value <> ''"))
    return pairs.select(F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"))
