"""Continuous ingest, and the current value of each key as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import DELETE
from ..store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None, order: str | None = None) -> StreamingQuery:
    """Appends each micro-batch (key, value, and kind if there are deletes) as one commit.

    Of several rows of a key in a batch the last by the column order stays; without one, the largest value, as a batch has
    no order of its own. A commit records the checkpoint folder and the number of its batch, so a batch that is replayed
    after a failure is known and appended once.
    """
    deletes = "kind" in stream.columns

    def append(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write(batch, deletes, order, source=checkpoint, batch=number)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_values(log: DataFrame) -> DataFrame:
    """The newest version per key of a streamed log (key, seq, kind, value), for the update mode: a row of key, seq, deleted and
    value for each key that a batch touched. Late older versions change nothing."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("seq", "kind", "value"), F.struct("seq", -F.col("kind"))).alias("_v"))
    gone = F.col("_v.kind") == DELETE
    return newest.select("key", F.col("_v.seq").alias("seq"), gone.alias("deleted"), F.when(~gone, F.col("_v.value")).alias("value"))


def published_watermark(log: DataFrame) -> DataFrame:
    """The largest sequence seen so far."""
    return log.agg(F.max("seq").alias("visible_seq"))
