"""Which versions a snapshot shows: the plans that every read is made of.

points has the key columns, seq, kind and payload columns; ranges has start, end and seq, of the key's type (for a composite
key the first key column). A snapshot S shows, for each key, the newest version with seq <= S, unless it is a delete or a
range tombstone with start <= key < end and seq < rseq <= S covers it. Equal sequences do not shadow: a point write beats a
range delete of its own transaction, whatever their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import DELETE
from .materialise import materialise

#: Tombstones up to which the anti join is a broadcast nested loop.
BROADCAST_RANGES = 64


def latest(points: DataFrame, snapshot: int | None = None, key: Sequence[str] = ("key",)) -> DataFrame:
    """The newest version of each key with seq <= snapshot, deletes included.

    The first row of each key's window: Spark keeps one row a key before the shuffle as well (a group limit), so that old
    versions and their payloads do not move, and payloads move once. Filters on the key columns that stand above this are
    pushed below the window by Catalyst, down to the scan. Of rows with equal key and seq that with the smallest kind, then
    with the smallest hash of its payload wins, so that the result does not depend on order.
    """
    rows = points if snapshot is None else points.filter(F.col("seq") <= snapshot)
    rest = [c for c in points.columns if c not in key and c not in ("seq", "kind")]
    order = [F.col("seq").desc(), F.col("kind"), *([F.xxhash64(*rest)] if rest else [])]
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(values: DataFrame, column: str, weight: Column, name: str) -> DataFrame:
    """values (distinct in column) with the sum of weight over all rows up to each, in the order of column: sums of ranges first,
    then sums inside each range, so no task has all rows."""
    parts = materialise(values.withColumn(name, weight).repartitionByRange(_partitions(values), column).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a proven bound
    starts = parts.groupBy("_p").agg(F.sum(name).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    up = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.sum(name).over(up)).drop("_p", "_before")


def ranked(values: DataFrame, column: str) -> DataFrame:
    """values (distinct) with _rank, 0, 1, ... in the order of column."""
    return running_sum(values, column, F.lit(1).cast("long"), "_rank").withColumn("_rank", F.col("_rank") - 1)


def disjoint_segments(ranges: DataFrame) -> DataFrame:
    """Ranges as disjoint segments (start, end, seq), each with the largest seq of the ranges that cover it.

    A segment tree in joins: boundaries are ranked, every range is cut into at most two aligned blocks of ranks per level,
    blocks keep their largest seq, and each gap between boundaries looks up the blocks above it. n log n rows move, and no
    pair of ranges is ever compared.
    """
    ranges = ranges.filter(F.col("start") < F.col("end"))
    bounds = materialise(ranked(ranges.select(F.col("start").alias("at")).union(ranges.select("end")).distinct(), "at"))
    levels = max(1, (bounds.count()).bit_length())
    first, last = bounds.select(F.col("at").alias("start"), F.col("_rank").alias("_a")), bounds.select(F.col("at").alias("end"), F.col("_rank").alias("_b"))
    blocks = ranges.join(first, "start").join(last, "end").withColumn(
        "_blocks",
        F.expr(f"""aggregate(sequence(0, {levels}), named_struct('a', _a, 'b', _b, 'out', cast(array() as array<struct<l: int, i: bigint>>)),
            (s, l) -> named_struct(
                'a', case when s.a < s.b then (s.a + s.a % 2) div 2 else s.a end,
                'b', case when s.a < s.b then (s.b - s.b % 2) div 2 else s.b end,
                'out', concat(s.out,
                    case when s.a < s.b and s.a % 2 = 1 then array(named_struct('l', l, 'i', s.a)) else cast(array() as array<struct<l: int, i: bigint>>) end,
                    case when s.a + s.a % 2 < s.b and s.b % 2 = 1 then array(named_struct('l', l, 'i', s.b - 1)) else cast(array() as array<struct<l: int, i: bigint>>) end)),
            s -> s.out)"""),
    )
    best = blocks.select(F.explode("_blocks").alias("_x"), "seq").groupBy("_x.l", "_x.i").agg(F.max("seq").alias("seq"))
    nexts = bounds.select((F.col("_rank") - 1).alias("_rank"), F.col("at").alias("end"))
    gaps = bounds.withColumnRenamed("at", "start").join(nexts, "_rank")
    up = gaps.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("i", F.expr("shiftright(_rank, l)"))
    return up.join(best, ["l", "i"]).groupBy("start", "end").agg(F.max("seq").alias("seq"))


def hidden_by_sweep(keys: DataFrame, segments: DataFrame) -> DataFrame:
    """Of keys (key, seq), those that a segment hides, for many segments: keys and segment starts are range-partitioned together,
    the last segment before each key is carried along inside a partition, and that of the partitions before is handed over
    by a table of one row per partition. Payloads take no part."""
    seg = segments.select(F.col("start").alias("_k"), F.lit(0).alias("_is_row"), F.struct("start", "end", "seq").alias("_seg"))
    both = keys.select(F.col("key").alias("_k"), F.lit(1).alias("_is_row"), F.col("seq").alias("_seq")).unionByName(seg, allowMissingColumns=True)
    both = materialise(both.repartitionByRange(_partitions(keys), "_k").withColumn("_p", F.spark_partition_id()))
    order = Window.partitionBy("_p").orderBy("_k", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_near", F.last("_seg", ignorenulls=True).over(order))
    # one row per partition: a proven bound
    ends = both.groupBy("_p").agg(F.max_by("_seg", F.when(F.col("_is_row") == 0, F.col("_k"))).alias("_end"))
    before = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_carried")
    found = swept.filter("_is_row = 1").join(F.broadcast(before), "_p").withColumn("_near", F.coalesce("_near", "_carried"))
    return found.filter((F.col("_k") < F.col("_near.end")) & (F.col("_near.seq") > F.col("_seq"))).select("_k", "_seq")


def few_ranges(ranges: DataFrame, limit: int = BROADCAST_RANGES) -> int:
    """How many tombstones there are, counted up to limit + 1."""
    return ranges.limit(limit + 1).count()


def not_covered(rows: DataFrame, ranges: DataFrame, snapshot: int | None = None, key: str = "key", n_ranges: int | None = None, limit: int = BROADCAST_RANGES) -> DataFrame:
    """rows without those that a range tombstone of the snapshot covers.

    n_ranges is the number of tombstones if the caller knows it, from the log for one; otherwise they are counted, up to
    limit. So many are broadcast into a nested loop; more are normalised to disjoint segments, which a sweep over keys and
    sequences alone compares with them, and what they hide is joined away.
    """
    if n_ranges == 0:
        return rows
    at = ranges if snapshot is None else ranges.filter(F.col("seq") <= snapshot)
    at = at.select(F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("seq").alias("_rseq"))
    if (few_ranges(at, limit) if n_ranges is None else n_ranges) > limit:
        segments = disjoint_segments(at.select(F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_rseq").alias("seq")))
        hidden = hidden_by_sweep(rows.select(F.col(key).alias("key"), "seq"), segments).distinct()
        return rows.join(hidden, (F.col(key) == F.col("_k")) & (F.col("seq") == F.col("_seq")), "left_anti")
    covered = (F.col("_start") <= F.col(key)) & (F.col(key) < F.col("_end")) & (F.col("_rseq") > F.col("seq"))
    return rows.join(F.broadcast(at), covered, "left_anti")


def visible(points: DataFrame, ranges: DataFrame | None = None, snapshot: int | None = None, key: Sequence[str] = ("key",), n_ranges: int | None = None, limit: int = BROADCAST_RANGES) -> DataFrame:
    """What a snapshot shows, unordered. Tombstones are applied after the newest version is picked: one that hides the
    newest hides all older ones, and if it does not, the older ones do not matter."""
    rows = latest(points, snapshot, key)
    if ranges is not None:
        rows = not_covered(rows, ranges, snapshot, key[0], n_ranges, limit)
    return rows.filter(F.col("kind") != DELETE)


def version_ranks(points: DataFrame, key: Sequence[str] = ("key",)) -> DataFrame:
    """Every version with its rank within the key, the newest first."""
    return points.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("seq").desc(), "kind")))
