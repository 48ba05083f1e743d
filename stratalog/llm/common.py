"""What the operators of this subpackage share: words, checkpoints, column picking."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, and a word, as Java and Python regular expressions read them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest number of rows that is ever broadcast; a table beyond it is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Largest size of the texts in such a table.
BROADCAST_BYTES = 32 << 20
#: Most files of a checkpoint for each core of the cluster.
FILES_PER_CORE = 2


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def word_array(text: Column) -> Column:
    """The words in order; an empty array for null and for blank texts."""
    trimmed = F.btrim(text_or_empty(text), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often a lambda inside body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where none is set, one of our own, but only in local
    mode: on a cluster executors do not share the driver's folders, and that is an error."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from those files: lineage ends, lost executors cost nothing.

    At most FILES_PER_CORE files a core, however many shuffle partitions there are: every file costs a creation, and on
    some file systems a helper process.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism).checkpoint(eager=True)


def counted(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Rows of df and about how many bytes its columns of variable length hold (columns: their names)."""
    size = sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("long") for c in columns), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def broadcast_if_small(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """A broadcast hint for a table whose counted rows, and counted bytes of variable length, are few; otherwise the join
    stays a shuffle that AQE may split."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, each with underscores in front until no column of taken is called so, whatever the case of its letters."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def held_out_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
