"""Mixing sources to target weights with DataFrame operations alone.

Every row gets a hash-random key. Within each source the rows stand in the order of that key; the distributed prefix
sum has levels: sizes of key buckets are summed per source, then those of the keys in the one bucket in which a source's
budget ends, then those of the rows of the key in which it ends. Whole epochs come first, the rest is cut at the exact
budget.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, checkpoint, counted, fresh, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
#: Key buckets of each source; a bucket of the largest source is what one task sums row by row.
BUCKET_BITS = 12
#: Bits of a row's random key.
KEY_BITS = 60
#: Range partitions in which the sources are ranked.
RANK_PARTITIONS = 16


@dataclass(frozen=True)
class Columns:
    """Where the mix finds ids and sources, and how it sizes and tells apart texts."""

    id: str = "doc_id"
    source: str = "source"
    size: Callable[[], Column] = lambda: word_count(F.col("text"))
    mark: Callable[[], Column] = lambda: F.md5("text")


def hash_key(id: Column, mark: Column, seed: int) -> Column:
    """The random key of a row: bits of an MD5 sum, which other engines can compute too."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("")), F.coalesce(mark, F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def narrow_rows(docs: DataFrame, columns: Columns = Columns(), seed: int = 11) -> DataFrame:
    """doc_id, source, size and key of every row: all that the plan needs, without texts."""
    return docs.select(
        F.col(columns.id).alias("doc_id"), F.col(columns.source).alias("source"), columns.size().cast("long").alias("size"), hash_key(F.col(columns.id), columns.mark(), seed).alias("key")
    )


def _bucket(key: str = "key") -> Column:
    return F.shiftright(key, KEY_BITS - BUCKET_BITS)


def ranked_sources(totals: DataFrame) -> DataFrame:
    """totals with _rank, 0, 1, ... by the code points of _mix_source, null last: ranked by ranges, no task has them all."""
    order = [F.col("_mix_source").isNull(), F.col("_mix_source")]
    ranged = checkpoint(totals.repartitionByRange(RANK_PARTITIONS, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # at most RANK_PARTITIONS rows: a proven bound
    placed = ranged.join(F.broadcast(starts.drop("_n")), "_part")
    return placed.withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part", "_start")


def fill_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """sources with target: shares of share * all sizes by weight, none above max_epochs * its size, the excess reshared.

    The water level is found by repeated sums: sources at their limit leave, the rest is dealt anew by weight.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    s = checkpoint(sources.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * F.lit(float(max_epochs))))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, None
    while True:
        at_limit = F.col("_limit") <= F.col("_weight") * F.lit(level)
        row = s.agg(
            F.sum(F.when(at_limit, F.col("_limit"))).alias("used"), F.sum(F.when(~at_limit, F.col("_weight"))).alias("open"), F.count(F.when(at_limit, True)).alias("full")
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], max(0.0, total - (row["used"] or 0.0)) / row["open"]
    return s.withColumn("target", F.least(F.col("_limit"), F.col("_weight") * F.lit(level)) if row["open"] else F.col("_limit"))


@dataclass(frozen=True)
class MixPlan:
    """sources, a row for each: source, source_size, target, epochs (whole ones), rest (what the last epoch takes),
    cut_bucket and cut_before (where the rest ends, and the sizes before that bucket), cut_key and over (the key at which it
    ends, and what is left for its rows). bytes: of the names of the sources."""

    sources: DataFrame
    n_sources: int
    bytes: int

    def beside(self, rows: DataFrame, source: str, *taken: str) -> tuple[DataFrame, dict[str, str]]:
        """rows with the plan's columns of their source, and the names that these have among rows' own."""
        names = self.sources.columns
        own = dict(zip(names, fresh([*rows.columns, *taken], *[f"_plan_{n}" for n in names]), strict=True))
        renamed = self.sources.select(*[F.col(n).alias(own[n]) for n in names])
        return rows.join(broadcast_if_small(renamed, self.n_sources, self.bytes), F.col(source).eqNullSafe(F.col(own["source"])), "left"), own


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> MixPlan:
    """Targets and cuts of every source of rows (of narrow_rows). Rows and sources without words get nothing."""
    buckets = checkpoint(rows.groupBy("source", _bucket().alias("bucket")).agg(F.sum("size").alias("n")))
    ranked = ranked_sources(buckets.groupBy(F.col("source").alias("_mix_source")).agg(F.sum("n").alias("source_size")))
    targets = fill_targets(ranked, weights, share, max_epochs).withColumnRenamed("_mix_source", "source")
    budget = F.round("target").cast("long")
    targets = checkpoint(
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest")
    )
    n, size = counted(targets, "source")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cuts = sums.join(broadcast_if_small(targets.select(F.col("source").alias("_s"), "rest"), n, size), F.col("source").eqNullSafe(F.col("_s")))
    cuts = cuts.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    cuts = cuts.select(F.col("source").alias("_s"), F.col("bucket").alias("cut_bucket"), F.col("before").alias("cut_before"))
    plan = MixPlan(checkpoint(targets.join(broadcast_if_small(cuts, n, size), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")), n, size)
    # the one bucket in which a budget ends, summed by key: repeated rows are one row there
    edge, own = plan.beside(rows, "source")
    edge = edge.filter(_bucket() == F.col(own["cut_bucket"])).groupBy("source", "key", F.col(own["rest"]).alias("rest"), F.col(own["cut_before"]).alias("cut_before")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("over", F.col("rest") - F.col("cut_before") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = edge.filter((F.col("over") >= 0) & (F.col("over") < F.col("n"))).select(F.col("source").alias("_s"), F.col("key").alias("cut_key"), "over")
    sources = plan.sources.join(broadcast_if_small(edge, n, size), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return MixPlan(checkpoint(sources), n, size)


def _prefix(rows: DataFrame, source: str, size: str, total: str) -> DataFrame:
    """rows with the sum of the sizes before each, within its source, in any fixed order: sums of partitions first, so that no
    task has all rows of a source."""
    part, least, at = fresh([*rows.columns, total], "_part", "_before", "_at")
    held = checkpoint(rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    before = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(source, part).agg(F.sum(size).alias(least)).withColumn(least, F.coalesce(F.sum(least).over(before), F.lit(0)))
    s, p = fresh([*held.columns, total, least], "_s", "_p")
    held = held.join(sums.select(F.col(source).alias(s), F.col(part).alias(p), least), F.col(source).eqNullSafe(F.col(s)) & (F.col(part) == F.col(p)))
    inside = Window.partitionBy(source, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn(total, F.col(least) + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop(part, least, at, s, p)


def mix_documents(docs: DataFrame, columns: Columns = Columns(), seed: int = 11, **options) -> DataFrame:
    """Per document: doc_id, size (words), source_size, target, taken (words the mix takes, repeats counted).

    Null sources are one source, the last; null texts have size 0 and empty ones too, and nothing is taken of them. Repeated
    rows share a key; where a budget ends among them, all but one are taken whole or not at all. Very long texts count like
    others, and one may be cut. An empty table stays empty; columns that are not named in columns are not read.
    """
    rows = checkpoint(narrow_rows(docs, columns, seed))
    plan = plan_mix(rows, **options)
    beside, own = plan.beside(rows, "source")
    beside = beside.select("doc_id", "size", "source", "key", *[F.col(own[n]).alias(n) for n in plan.sources.columns if n != "source"])
    at_cut = F.coalesce(F.col("key") == F.col("cut_key"), F.lit(False))
    whole = F.col("epochs") * F.col("size")
    inside = beside.filter(~at_cut).withColumn("taken", whole + F.when(F.col("key") < F.col("cut_key"), F.col("size")).otherwise(0))
    edge = _prefix(beside.filter(at_cut), "source", "size", "_sum")
    edge = edge.withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("over") - F.col("_sum")))).drop("_sum")
    return inside.unionByName(edge).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def resample_documents(docs: DataFrame, columns: Columns = Columns(), seed: int = 11, **options) -> DataFrame:
    """docs as the mix wants them: each as often as its share of the mix rounds to, whole texts, the same columns.

    Rows without words (null and empty texts) are left out, null sources are one source, repeated rows are rows of their
    own, an empty table stays empty, and columns may have any names. Texts are read once for the plan and once for the
    result, and only those of the rows at whose key a budget ends, one of each source or its repeats, are moved.
    """
    plan = plan_mix(checkpoint(narrow_rows(docs, columns, seed)), **options)
    key, size, total, copies, copy = fresh(docs.columns, "_key", "_size", "_sum", "_copies", "_copy")
    rows, own = plan.beside(docs.withColumn(key, hash_key(F.col(columns.id), columns.mark(), seed)), columns.source, size, total, copies, copy)
    at_cut = F.coalesce(F.col(key) == F.col(own["cut_key"]), F.lit(False))
    inside = rows.filter(~at_cut & (columns.size() > 0)).withColumn(copies, F.col(own["epochs"]) + F.when(F.col(key) < F.col(own["cut_key"]), 1).otherwise(0))
    edge = _prefix(rows.filter(at_cut).withColumn(size, columns.size().cast("long")).filter(F.col(size) > 0), columns.source, size, total)
    taken = F.greatest(F.lit(0), F.least(F.col(size), F.col(own["over"]) - F.col(total)))
    edge = edge.withColumn(copies, F.col(own["epochs"]) + F.round(taken / F.col(size)).cast("long"))
    out = inside.select(*docs.columns, copies).unionByName(edge.select(*docs.columns, copies))
    return out.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
