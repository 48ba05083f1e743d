"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get consecutive numbers in the order of a content hash; a keyed Feistel network permutes the numbers
[0, n); shard = permuted mod shards and slot = permuted div shards. Shard and slot of any row number can be
computed anywhere from (n, shards, seed), and the inverse tells which row stands in a given shard and slot.

Equal rows are counted before they are numbered, so a group of repeated rows, however large, is one row until it
is dealt out again in blocks of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import FILES_PER_CORE, checkpoint

ROUNDS = 6
#: Number buckets: each is numbered by one task, and their counts are summed over this many rows.
BUCKET_BITS = 12
#: Repeated rows are dealt out in blocks of this length.
BLOCK = 4096


@dataclass(frozen=True)
class Feistel:
    """A permutation of [0, n): a balanced Feistel network on the least even number of bits that holds n, walked
    until the value falls below n (under four steps on average)."""

    n: int
    seed: int = 0

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(self.seed)).integers(1, 2**63, ROUNDS, dtype=np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        z = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        w, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> w, x & mask
        for key in self._keys()[::-1] if back else self._keys():
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << w) | right

    def permute(self, numbers: np.ndarray, back: bool = False) -> np.ndarray:
        x = np.asarray(numbers, dtype=np.uint64)
        if x.size and int(x.max()) >= self.n:
            raise ValueError("a row number is not below n")
        out = self._once(x, back)
        while (beyond := out >= np.uint64(self.n)).any():
            out[beyond] = self._once(out[beyond], back)
        return out.astype(np.int64)

    def place(self, number: int, shards: int) -> tuple[int, int]:
        """Shard and slot of a row number."""
        p = int(self.permute(np.array([number]))[0])
        return p % shards, p // shards

    def number_at(self, shard: int, slot: int, shards: int) -> int:
        """The row number that stands in a slot of a shard."""
        return int(self.permute(np.array([slot * shards + shard]), back=True)[0])


def number_rows(rows: DataFrame, hash_column: str) -> tuple[DataFrame, int]:
    """rows with a column row_number, 0 to n - 1 without gaps, in the unsigned order of hash_column, and n.

    Needs only the columns it is given; equal rows take consecutive numbers. Columns may hold nulls. No task sees
    more than one bucket of distinct rows or blocks of repeated ones.
    """
    columns = rows.columns
    bucket = F.shiftrightunsigned(F.col(hash_column), 64 - BUCKET_BITS)
    groups = checkpoint(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", bucket))
    per_bucket = groups.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
    starts = per_bucket.withColumn("_start", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_start"])
    n = groups.agg(F.sum("_copies")).first()[0] or 0
    within = Window.partitionBy("_bucket").orderBy(hash_column, *[c for c in columns if c != hash_column]).rowsBetween(Window.unboundedPreceding, -1)
    # at most 2 ** BUCKET_BITS rows of offsets: a proven bound
    placed = groups.join(F.broadcast(starts.drop("_n")), "_bucket").withColumn("_first", F.col("_start") + F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    few = placed.filter(F.col("_copies") <= BLOCK).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    blocks = placed.filter(F.col("_copies") > BLOCK).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {BLOCK}"))))
    many = (
        blocks.repartition(F.col("_first"), F.col("_block"))
        .withColumn("_k", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("_copies"), (F.col("_block") + 1) * BLOCK) - 1)))
        .drop("_block")
    )
    numbered = few.unionByName(many).withColumn("row_number", (F.col("_first") + F.col("_k")).cast("long"))
    return numbered.select(*columns, "row_number"), int(n)


def shard_rows(rows: DataFrame, hash_column: str, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """rows with row_number, shard int and slot long by the permutation; any two shards differ by one row at most.

    An empty table stays empty. rows may not have columns of those names already.
    """
    numbered, n = number_rows(rows, hash_column)
    numbered = numbered.coalesce(FILES_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    feistel = Feistel(max(n, 1), seed)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = feistel.permute(batch.column("row_number").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], [*batch.schema.names, "shard", "slot"]
            )

    return numbered.mapInArrow(place, f"{fields}, shard int, slot long")


def content_hash(id: Column, text: Column, seed: int) -> Column:
    """64 bits of an MD5 sum of id and text, which other engines can compute too."""
    joined = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(joined), 1, 16), 16, -10).cast("long")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes and one more), text_crc32, row_number, shard, slot.

    Null texts count as empty ones (size 1, crc 0), very long ones like others; null and repeated ids are numbered like any
    other, equal rows get numbers that follow each other; an empty table stays empty; other columns of docs are not read. Copies
    of a text are spread like all rows: the law is even row counts, not whole groups.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        content_hash(F.col(id_col), text, seed).alias("_hash"),
    )
    return shard_rows(narrow, "_hash", shards, seed).drop("_hash")
