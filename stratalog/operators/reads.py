"""Reads of a versioned log as DataFrame transformations. All of them work on any orderable key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import DELETE
from ..plans.materialise import materialise
from ..plans.visibility import latest, running_sum, version_ranks, visible


def in_range(lower, upper, key: str = "key") -> Column:
    """Half-open range [lower, upper); None is unbounded. Reaches the scan as pushed comparisons."""
    test = F.lit(True)
    if lower is not None:
        test = test & (F.col(key) >= F.lit(lower))
    if upper is not None:
        test = test & (F.col(key) < F.lit(upper))
    return test


def range_scan(points: DataFrame, ranges: DataFrame | None = None, snapshot: int | None = None, lower=None, upper=None, key: str = "key", n_ranges: int | None = None) -> DataFrame:
    """The visible rows of [lower, upper) in key order."""
    return visible(points.filter(in_range(lower, upper, key)), ranges, snapshot, (key,), n_ranges).orderBy(key)


def seek_ge(points: DataFrame, target, n: int, ranges: DataFrame | None = None, snapshot: int | None = None, lower=None, upper=None, key: str = "key", n_ranges: int | None = None) -> DataFrame:
    """The first n visible rows with a key not below target nor lower: top-k, no full sort."""
    start = target if lower is None or target > lower else lower
    return visible(points.filter(in_range(start, upper, key)), ranges, snapshot, (key,), n_ranges).orderBy(key).limit(n)


def next_rows(rows: DataFrame, starts: DataFrame, key: str = "key", start: str = "start", n: str = "n") -> DataFrame:
    """For every row of starts (start and n, and others) the next n rows of rows with a key not below start, in one job.

    rows has distinct keys. Keys and starts are ranked together, by ranges, so a start knows the rank of the key it meets
    first; the ranks that it wants are dealt out and met by an equality join. No pair of key and start is compared.
    """
    ends = rows.select(F.col(key).alias("_k"), F.lit(1).alias("_is_key")).unionByName(starts.select(F.col(start).alias("_k"), F.lit(0).alias("_is_key")).distinct())
    # of an equal start and key the start comes first: it counts the keys below it
    ranks = running_sum(ends.select(F.struct("_k", "_is_key").alias("_e"), "_is_key"), "_e", F.col("_is_key").cast("long"), "_upto")
    ranks = materialise(ranks.select("_e._k", "_e._is_key", "_upto"))
    firsts = ranks.filter("_is_key = 0").select(F.col("_k").alias("_start"), F.col("_upto").alias("_from"))
    wanted = starts.join(firsts, F.col(start) == F.col("_start")).drop("_start")
    wanted = wanted.withColumn("_rank", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + F.greatest(F.col(n), F.lit(1))))).filter(F.col(n) > 0).drop("_from")
    keys = ranks.filter("_is_key = 1").select(F.col("_k").alias(key), F.col("_upto").alias("_rank"))
    return wanted.join(keys, "_rank").drop("_rank").join(rows, key)


def point_get(points: DataFrame, value, ranges: DataFrame | None = None, snapshot: int | None = None, key: str = "key", n_ranges: int | None = None) -> DataFrame:
    """The visible row of one key, or none."""
    return visible(points.filter(F.col(key) == F.lit(value)), ranges, snapshot, (key,), n_ranges)


def multi_get(points: DataFrame, keys: DataFrame, ranges: DataFrame | None = None, snapshot: int | None = None, key: str = "key", n_ranges: int | None = None) -> DataFrame:
    """One row for each distinct key of keys: its visible row, or nulls. One job for the whole batch.

    The versions are cut down to the wanted keys before the newest is picked.
    """
    wanted = keys.select(key).distinct()
    found = visible(points.join(wanted, key, "left_semi"), ranges, snapshot, (key,), n_ranges)
    return wanted.join(found, key, "left")


def asof_get(points: DataFrame, probes: DataFrame, key: str = "key", at: str = "snapshot") -> DataFrame:
    """For each probe (key, snapshot) the newest version of the key not above the snapshot, deletes shown as such.

    Probes and versions are merged per key and the last version before each probe is carried along: one shuffle on the
    key, no pair of probe and version is made.
    """
    rest = [c for c in points.columns if c != key]
    versions = points.select(key, F.col("seq").alias("_at"), F.lit(0).alias("_probe"), F.struct(*rest).alias("_v"))
    asked = probes.select(key, F.col(at).alias("_at"), F.lit(1).alias("_probe"))
    merged = versions.unionByName(asked, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_near", F.last("_v", ignorenulls=True).over(order)).filter("_probe = 1")
    return carried.select(key, F.col("_at").alias(at), *[F.col(f"_near.{c}").alias(c) for c in rest])


def history(points: DataFrame, key: Sequence[str] = ("key",), payload: str = "value") -> DataFrame:
    """Every version with its rank (1 is the newest) and the payload of the version before it."""
    older = F.lag(payload).over(Window.partitionBy(*key).orderBy("seq", F.col("kind").desc()))
    return version_ranks(points, key).withColumn("previous", older)


def keys_only(points: DataFrame, ranges: DataFrame | None = None, snapshot: int | None = None, key: str = "key", n_ranges: int | None = None) -> DataFrame:
    """The visible keys; no payload column is read."""
    return visible(points.select(key, "seq", "kind"), ranges, snapshot, (key,), n_ranges).select(key)


def overlay(base: DataFrame, buffer: DataFrame, buffered_ranges: DataFrame | None = None, key: str = "key", lower=None, upper=None) -> DataFrame:
    """A transaction's view: base rows that the buffer does not touch, and the buffer's writes.

    buffer has the base's columns and kind; its deletes drop the key. A buffered range hides base rows, not the buffer's own
    writes. Bounds hold for both.
    """
    rest = base.filter(in_range(lower, upper, key)).join(buffer.select(key), key, "left_anti")
    if buffered_ranges is not None:
        covered = (F.col("start") <= F.col(key)) & (F.col(key) < F.col("end"))
        rest = rest.join(F.broadcast(buffered_ranges.select("start", "end")), covered, "left_anti")  # capped by the transaction's size
    writes = buffer.filter((F.col("kind") != DELETE) & in_range(lower, upper, key))
    return rest.unionByName(writes.select(*rest.columns))


def occ_conflicts(reads: DataFrame, writes: DataFrame, key: str = "key") -> DataFrame:
    """Reads (txn, read_ts, key) that a commit (commit_ts, key) after read_ts wrote: their transactions must abort.

    The newest commit per key decides, so a hot key is one row of the join.
    """
    last = writes.groupBy(key).agg(F.max("commit_ts").alias("_last"))
    return reads.join(last, key).filter(F.col("_last") > F.col("read_ts")).drop("_last")


def last_write_wins(writes: DataFrame, key: str = "key") -> DataFrame:
    """Blind writes (commit_ts, key, ...) never conflict; the last commit's stays."""
    return latest(writes.withColumnRenamed("commit_ts", "seq").withColumn("kind", F.lit(1)), None, (key,)).drop("kind").withColumnRenamed("seq", "commit_ts")
