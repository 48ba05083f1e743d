"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints within RADIUS bits are linked. Each of the 64 bit positions carries a non-zero vector of RADIUS + 1 bits;
a table for every non-zero vector v keeps the positions whose vector has odd parity with v. The vectors of up to RADIUS
differing positions span less than the whole space, so some v is orthogonal to all of them, and its table keeps none of
the differing bits: every pair within the radius meets in at least one of the 31 tables.

Only distinct fingerprints go into the tables, so copies cost nothing there. Crowded buckets are dealt out by further
families of masks before any task sees them. Inside a bucket links are found as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices, texts
from .common import broadcast_if_small, checkpoint, fresh
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 14
#: Buckets above this many fingerprints are searched through a further family of masks, LEVELS families at most.
DENSE = 2048
LEVELS = 3

_FOLD = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, n: int = SHINGLE) -> list[int]:
    """XXH64 of every n-word shingle of the folded text, repeats included; of all its words if it has fewer; none of none."""
    words = text.translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [h(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [h(joined[a:b], SEED) for a, b in zip(starts[: 1 - n].tolist(), ends[n - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes) -> int:
    """64 bits; each is 1 if it is set in over half of the shingle hashes. 0 for a text without words."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.array(hashes[i : i + BLOCK], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t) for t in texts(batch.column("_text"))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), pa.array(found)], ["doc_id", "_row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, _row (a hash that tells different texts apart) and fp (64 bits in a bigint)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, _row long, fp long")


def covering_masks(radius: int = RADIUS, positions: np.ndarray | None = None, step: int = 0) -> np.ndarray:
    """2 ** (radius + 1) - 1 masks: any two words that differ in up to radius of the positions agree under one of them."""
    positions = np.arange(64) if positions is None else positions
    n = (1 << (radius + 1)) - 1
    vectors = 1 + (np.arange(len(positions)) * (2 * step + 1) + step) % n
    masks = np.zeros(n, np.uint64)
    for v in range(1, n + 1):
        odd = np.array([bin(int(x) & v).count("1") & 1 for x in vectors], bool)
        masks[v - 1] = np.bitwise_or.reduce(np.uint64(1) << positions[odd].astype(np.uint64), initial=np.uint64(0))
    return masks


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the graph that links fps within the radius: at most len(fps) - 1 of them."""
    left = fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                yield np.full(len(found), x), found
                frontier.extend(found)
                left = left[~near]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key; a bucket that goes on in the next batch is kept until it ends."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in _and_end(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy() for c in ("t", "key", "fp")]
                held = [np.r_[held[0], new[0].astype(np.int64)], np.r_[held[1], new[1]], np.r_[held[2], new[2].view(np.uint64)]]
            t, key, fp = held
            if not len(t):
                continue
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1])])
            end = len(t) if batch is None else cuts[-1]
            lengths = np.diff(np.r_[cuts, len(t)])
            us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            starts = cuts[(lengths == 2) & (cuts < end)]
            if len(starts):
                a, b = fp[starts], fp[starts + 1]
                near = np.bitwise_count(a ^ b) <= radius
                us.append(a[near])
                vs.append(b[near])
            for s, n in zip(cuts[(lengths > 2) & (cuts < end)], lengths[(lengths > 2) & (cuts < end)], strict=True):
                for a, b in _forest(fp[s : s + n], radius):
                    us.append(a)
                    vs.append(b)
            held = [x[end:] for x in held]
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            if len(u):
                pairs = np.unique(np.stack([u, v]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def mask_family(radius: int, level: int) -> list[tuple[int, int, int]]:
    """(node, table, mask) of a level: of the only node 0 first, then of every table of the level before. A mask holds the
    bits of its node's mask and those of a covering family over the bits that the node leaves open."""
    nodes = {0: 0} if level == 0 else {t: mask for _, t, mask in mask_family(radius, level - 1)}
    out = []
    for node, mask in nodes.items():
        free = np.array([i for i in range(64) if not (mask >> i) & 1])
        out += [(node, node * ((2 << radius) - 1) + i, mask | int(m)) for i, m in enumerate(covering_masks(radius, free, level))]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """u, v: links that connect what is linked; distinct has one row for each fingerprint fp.

    Buckets are counted before their rows move. Those of more than dense fingerprints are not sent to a task: their rows are
    dealt out by a second covering family on the bits that their mask leaves open, and, where these are crowded too, by a
    third, whose buckets have few open bits left and so few fingerprints. Every level is exact, as the first.
    """
    spark = distinct.sparkSession
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for _, t, m in mask_family(radius, 0)]))
    rows = distinct.select("fp", tables.alias("x")).select("x.t", "x.key", "fp")
    out = []
    for level in range(LEVELS):
        crowded = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dense).select("t", "key")
        n = crowded.count() if level + 1 < LEVELS else 0
        crowded = checkpoint(crowded) if n else crowded
        few = rows if not n else rows.join(broadcast_if_small(crowded, n), ["t", "key"], "left_anti")
        few = few.repartition("t", "key").sortWithinPartitions("t", "key")
        out.append(few.mapInArrow(_link(radius), "u long, v long"))
        if not n:
            break
        # at most 31 ** 3 rows: a proven bound
        family = spark.createDataFrame([(node, t, _signed(m)) for node, t, m in mask_family(radius, level + 1)], "node int, next int, mask long")
        many = rows.join(broadcast_if_small(crowded, n), ["t", "key"], "left_semi")
        many = many.join(F.broadcast(family), F.col("t") == F.col("node"))
        rows = checkpoint(many.select(F.col("next").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct())
    return reduce(DataFrame.unionByName, out)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, _row, fp, root (a fingerprint that names the group) and component_id, the smallest doc_id
    reachable over links.

    Texts without words share fingerprint 0 and so are one group. Null ids are grouped like others but never name a
    group, unless all ids of the group are null. Repeated rows stay as they are. Other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(link_fingerprints(distinct.select("fp"), radius))
    linked = checkpoint(distinct.join(nodes.withColumnRenamed("node", "fp"), "fp"))
    # written apart, so that a group of many fingerprints can be split in the join with its name
    names = checkpoint(linked.groupBy("root").agg(F.min("least").alias("name")))
    named = linked.select("fp", "root").join(names, "root")
    # so that both sides of the last join are plain shuffles: a fingerprint of very many copies can be split
    members = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("name", "least").alias("component_id"))
    members = checkpoint(members)
    return prints.join(members, "fp").select("doc_id", "_row", "fp", "root", "component_id")


def fingerprint_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_of_each_group(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all their columns, without the near-duplicates: of each group one row stays, that with the smallest id.

    Of rows of one id the one whose text has the smallest hash stays, of rows of one id and text any one. Null texts are empty
    ones without words; a group of null ids alone keeps one row. An empty table stays empty. Columns of any name pass.
    Only ids and hashes are shuffled; texts are only where the rows that go, or the repeated ones, are too many to broadcast.
    """
    found = near_duplicates(docs, radius, id_col, text_col)
    texts_of = checkpoint(found.groupBy("root", "doc_id", "_row").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id")))
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = checkpoint(texts_of.filter(named).groupBy("root").agg(F.min("_row").alias("_first")))
    stays = named & (F.col("_row") == F.col("_first"))
    marked = checkpoint(texts_of.join(first, "root").select("doc_id", "_row", "n", stays.alias("stays")).filter("not stays or n > 1"))
    counts = {r["stays"]: r["n"] for r in marked.groupBy("stays").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b, row, doc = fresh(docs.columns, "_a", "_b", "_row", "_doc")

    def these(stays: bool) -> DataFrame:
        part = marked.filter(F.col("stays") == F.lit(stays)).select(F.col("doc_id").alias(a), F.col("_row").alias(b))
        return broadcast_if_small(part, counts[stays])

    rows = docs.withColumn(row, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.col(row) == F.col(b))
    out = rows.join(these(False), same, "left_anti") if False in counts else rows
    if True not in counts:
        return out.select(*docs.columns)
    repeated = out.join(these(True), same, "left_semi").groupBy(F.col(id_col), F.col(row)).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias(doc))
    return out.join(these(True), same, "left_anti").select(*docs.columns).unionByName(repeated.select(f"{doc}.*"))
