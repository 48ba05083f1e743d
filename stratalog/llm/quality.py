"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words, word pairs and character n-grams (of 3 and 4 bytes, inside
words and their borders), and of a few shape tokens (length, share of repeated lines); a softmax over two classes
scores it. The vectors are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.

As the output is linear in the average, every bucket has one number in the end: its vector times the difference of the
two output rows. Scoring looks these numbers up for whole texts, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, slices, texts
from .common import checkpoint

#: Buckets of hashed features; shape tokens come after them.
BITS = 16
SHAPES = 24
DIM = 12
#: Most labelled rows of each class that the model is fitted on (the documented bound), chosen by a hash of their ids.
SAMPLE = 2500
#: Most bytes of features of these rows that the driver holds.
SAMPLE_BYTES = 96 << 20
#: Gradient steps, one text each, whatever the size of the sample.
STEPS = 24_000
RATE = 0.4
THRESHOLD = 0.3
#: Bytes of one text whose features are taken at once; what goes over the end of a part is carried on.
SPAN = 1 << 18

_K = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    z = (x ^ np.uint64(salt)) * _K
    z ^= z >> np.uint64(31)
    return ((z * _K) >> np.uint64(64 - BITS)).astype(np.int64)


def _spaces(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def _runs(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of False in space, whose ends count as True."""
    edges = np.flatnonzero(np.diff(np.r_[True, space, True]))
    return edges[0::2], edges[1::2]


def _word_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prefix = np.r_[np.uint64(0), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(c)), dtype=np.uint64)]
    return (prefix[ends] - prefix[starts]) * _powers(_BASE_BACK, len(c) + 1)[starts]


def _grams(c: np.ndarray, space: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the runs of 3 bytes whose middle, and of 4 bytes whose two middle ones, are no space."""
    wide = np.where(space, np.uint8(32), c).astype(np.uint64)
    three = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)
    inside = np.flatnonzero(~space[1:-1])
    yield inside, _bucket(three[inside], 3)
    four = three[:-1] | wide[3:] << np.uint64(24)
    inside = np.flatnonzero(~(space[1:-2] | space[2:-1]))
    yield inside, _bucket(four[inside], 4)


def byte_features(data: bytes, heads: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) arrays of all features in data, which begins and ends with a space. heads: where its texts begin, if
    it holds several; no pair goes from one to the next.

    Words and pairs are hashed as wholes; a pair of equal words has the same bucket whatever the word.
    """
    c = np.frombuffer(data, np.uint8)
    space = _spaces(c)
    starts, ends = _runs(space)
    if len(starts):
        words = _word_hashes(c, starts, ends)
        yield starts, _bucket(words, 1)
        owner = np.zeros(len(starts), np.int64) if heads is None else np.searchsorted(heads, starts, "right")
        second = 1 + np.flatnonzero(owner[1:] == owner[:-1])
        yield starts[second], _bucket(words[second] ^ words[second - 1], 2)
    yield from _grams(c, space)


def long_features(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of byte_features(b" " + text + b" "), found SPAN bytes at a time: a word or a run of bytes that goes over the
    end of a part is carried into the next one, so none is lost or cut, whether or not the text has blanks."""
    data = b" " + text + b" "
    open_hash, open_length, before = np.uint64(0), 0, np.zeros(0, np.uint64)
    for at in range(0, len(data), SPAN):
        c = np.frombuffer(data, np.uint8, min(SPAN, len(data) - at), at)
        starts, ends = _runs(_spaces(c))
        words = _word_hashes(c, starts, ends)
        if open_length and len(starts) and starts[0] == 0:
            with np.errstate(over="ignore"):
                words[0] = open_hash + words[0] * np.uint64(pow(_BASE, open_length, 1 << 64))
            length = open_length + int(ends[0])
        else:
            words = np.r_[open_hash, words] if open_length else words
            length = int(ends[-1] - starts[-1]) if len(starts) else 0
        open_length = 0
        if len(ends) and ends[-1] == len(c):
            open_hash, open_length = words[-1], length if len(ends) == 1 else int(ends[-1] - starts[-1])
            words = words[:-1]
        yield _bucket(words, 1)
        row = np.r_[before, words]
        yield _bucket(row[1:] ^ row[:-1], 2)
        before = row[-1:]
        # runs of bytes that begin in this part
        c = np.frombuffer(data, np.uint8, min(SPAN + 3, len(data) - at), at)
        if len(c) >= 4:
            for found, bucket in _grams(c, _spaces(c)):
                yield bucket[found < SPAN]
        elif len(c) == 3:
            yield next(_grams(np.r_[c, np.uint8(32)], _spaces(np.r_[c, np.uint8(32)])))[1][:0 if _spaces(c)[1] else 1]


def shape_tokens(text: bytes) -> list[int]:
    """Shape tokens: length class, share of repeated lines, share of words equal to the one before."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words) if words else 0.0

    def step(share: float) -> int:
        return sum(share > x for x in (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8))

    return [(1 << BITS) + x for x in (min(7, len(words).bit_length() // 2), 8 + step(again), 16 + step(same))]


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a whole text's features, without its shape tokens; two bytes each, as the sample is held by the
    driver, but four for the counts of a text with one that needs them."""
    total = np.zeros(1 << BITS, np.int64)
    for b in long_features(text) if len(text) > SPAN else (b for _, b in byte_features(b" " + text + b" ")):
        total += np.bincount(b, minlength=1 << BITS)
    ids = np.flatnonzero(total)
    counts = total[ids]
    return ids.astype(np.uint16), counts.astype(np.uint32 if counts.max(initial=0) > 65535 else np.uint16)


@dataclass(frozen=True)
class Model:
    """One number for each bucket and shape token, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, batch: list[bytes]) -> np.ndarray:
        """Probability of label 1 for every text."""
        sums, counts = np.zeros(len(batch)), np.zeros(len(batch))
        for a, b in pieces(batch):
            if len(batch[a]) > SPAN:  # a piece of its own
                for bucket in long_features(batch[a]):
                    sums[a] += self.weights[bucket].sum(dtype=np.float64)
                    counts[a] += len(bucket)
            else:
                sums[a:b], counts[a:b] = self._sums(batch[a:b])
        shapes = np.array([self.weights[shape_tokens(t)].sum() for t in batch])
        z = sums / np.maximum(counts, 1) + shapes + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def _sums(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join(b" " + t + b" " for t in batch)
        heads = np.cumsum([0, *(len(t) + 2 for t in batch)])[:-1]
        sums, counts = np.zeros(len(batch)), np.zeros(len(batch))
        for at, bucket in byte_features(data, heads):
            if not len(at):
                continue
            cuts = np.searchsorted(at, heads)
            value = np.r_[0.0, np.cumsum(self.weights[bucket], dtype=np.float64)]
            ends = np.r_[cuts[1:], len(at)]
            sums += value[ends] - value[cuts]
            counts += ends - cuts
        return sums, counts


def fit(rows: list[tuple[bytes, bytes, list[int], int]], weights: tuple[float, float], seed: int = 7) -> Model:
    """SGD over (bucket ids, counts, shape tokens, label) with class weights. Without both classes the score is constant."""
    labels = [r[3] for r in rows]
    if len(set(labels)) < 2:
        return Model(np.zeros((1 << BITS) + SHAPES, np.float32), 60.0 if labels and labels[0] else -60.0 if labels else 0.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1 / DIM, ((1 << BITS) + SHAPES, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-STEPS // len(rows)))])[:STEPS]
    for step, k in enumerate(order):
        packed, counts, shapes, y = rows[k]
        n = np.frombuffer(counts, np.uint16 if len(counts) == len(packed) else np.uint32).astype(np.float32)
        ids = np.r_[np.frombuffer(packed, np.uint16).astype(np.int64), np.array(shapes, np.int64)]
        share = np.r_[n / max(float(n.sum()), 1.0), np.ones(len(shapes), np.float32)].astype(np.float32)
        hidden = share @ table[ids]
        z = out @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        g = p * np.float32(RATE * (1 - step / STEPS) * weights[y])
        back = g @ out
        out -= g[:, None] * hidden
        bias -= g
        # the average's gradient is shared among its features; a text's rare features still move
        table[ids] -= np.sqrt(share)[:, None] * back
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(labels: DataFrame, label_col: str, learn: Column, per_class: int = SAMPLE) -> tuple[DataFrame, list[int]]:
    """At most per_class ids of each label among rows where learn holds, chosen by hash, and how many there are in all.

    An id with several labels counts once, with the larger one.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & learn).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [marks.filter(F.col("label") == y).orderBy(_order(), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), [totals.get(0, 0), totals.get(1, 0)]


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        values = texts(batch.column("_text"))
        found = [sparse(t) for t in values]
        packed = [pa.array([x[k].tobytes() for x in found]) for k in (0, 1)]
        shapes = pa.array([shape_tokens(t) for t in values], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *packed, shapes], ["doc_id", "label", "ids", "counts", "shapes"])


def bounded(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    """rows (doc_id, label and binary columns), written once; of each label only the first, in the order of the sample, whose
    binary columns come to half of limit bytes together, one at least."""
    rows = checkpoint(rows)
    size = sum(F.octet_length(c) for c in columns)
    sizes = rows.select("doc_id", "label", size.alias("size"), _order().alias("order")).collect()  # a row for each of the sample
    held = {0: 0, 1: 0}
    out = []
    for r in sorted(sizes, key=lambda r: (r["order"], r["doc_id"])):
        if not held[r["label"]] or held[r["label"]] + r["size"] <= limit // 2:
            held[r["label"]] += r["size"]
        else:
            out.append(r["doc_id"])
    return rows.filter(~F.col("doc_id").isin(out)) if out else rows


def _order() -> Column:
    return F.xxhash64(F.lit(3), "doc_id")


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", per_class: int = SAMPLE) -> Model:
    """The model from labelled documents where learn (a condition on labels.doc_id) holds.

    At most per_class rows of each label, and features of at most SAMPLE_BYTES, are used. A repeated id counts once, with the
    features that sort first; null ids and labels teach nothing, null texts are empty ones, very long texts are read whole.
    Without labels of both kinds, or without documents, the score is constant. Other columns are not read.
    """
    sample, totals = labelled_sample(labels, label_col, learn, per_class)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).join(F.broadcast(sample), "doc_id")  # 2 * per_class rows at most
    rows = picked.mapInArrow(_sparse_rows, "doc_id long, label int, ids binary, counts binary, shapes array<long>")
    one = F.min(F.struct("label", "ids", "counts", "shapes")).alias("_r")
    rows = bounded(rows.groupBy("doc_id").agg(one).select("doc_id", "_r.*"), SAMPLE_BYTES, "ids", "counts").orderBy("doc_id").collect()
    share = [totals[y] / max(1, sum(totals)) for y in (0, 1)]
    have = [max(1, sum(r["label"] == y for r in rows)) / max(1, len(rows)) for y in (0, 1)]
    return fit([(r["ids"], r["counts"], r["shapes"], r["label"]) for r in rows], (share[0] / have[0], share[1] / have[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and score. Null texts count as empty; repeated rows get equal scores; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(texts(batch.column("_text"))))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, all their columns, without those that score below threshold.

    Null and empty texts and very long ones are scored like any other, repeated rows alike; an empty table stays empty;
    columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = shared.value.scores(texts(batch.column(text_col))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
