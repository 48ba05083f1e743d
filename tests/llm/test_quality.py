from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import queries, quality
from stratalog.llm.common import held_out_remainder

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = queries.op3_quality(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) >= 0.95
    assert min(np.mean([p == y for p, y in held if y == k]) for k in (0, 1)) >= 0.8


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = held_out_remainder(F.col("doc_id"), 5) == 0
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x, ~held, per_class=60) for x in (labels, wrong))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_features_of_a_text_do_not_depend_on_its_pieces(monkeypatch):
    text = "Éan und the %%% words | of\na text, ".encode() * 50
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=(1 << quality.BITS) + quality.SHAPES).astype(np.float32), 0.1)
    whole = model.scores([text, b"", b"x"])
    singles = np.concatenate([model.scores([t]) for t in (text, b"", b"x")])
    assert np.allclose(whole, singles)
    ids, counts = quality.sparse(text)
    z = (model.weights[ids] * counts).sum() / counts.sum() + model.weights[quality.shape_tokens(text)].sum() + model.bias
    assert np.isclose(whole[0], 1 / (1 + np.exp(-z)))
    # parts of any size lose nothing, with blanks or without
    for other in (text, text.replace(b" ", b"").replace(b"\n", b""), b" \n ab" * 9):
        ids, counts = quality.sparse(other)
        score = model.scores([other])[0]
        for span in (1, 2, 3, 50, 200):
            monkeypatch.setattr(quality, "SPAN", span)
            cut_ids, cut_counts = quality.sparse(other)
            assert np.array_equal(ids, cut_ids) and np.array_equal(counts, cut_counts) and np.isclose(model.scores([other])[0], score)
        monkeypatch.undo()


def plain_score(model, text: str | None) -> float:
    """The score from the model's weights, feature by feature in plain Python."""

    def bucket(x: int, salt: int) -> int:
        z = (x ^ salt) * int(quality._K) % (1 << 64)
        return (z ^ z >> 31) * int(quality._K) % (1 << 64) >> 64 - quality.BITS

    def word(w: bytes) -> int:
        return sum((c + 1) * pow(quality._BASE, i, 1 << 64) for i, c in enumerate(w)) % (1 << 64)

    data = bytes(32 if 9 <= c <= 13 else c for c in b" " + (text or "").encode() + b" ")
    words = [word(w) for w in data.split(b" ") if w]
    found = [bucket(w, 1) for w in words] + [bucket(a ^ b, 2) for a, b in zip(words, words[1:], strict=False)]
    for n in (3, 4):
        runs = (data[i : i + n] for i in range(len(data) - n + 1))
        found += [bucket(int.from_bytes(x, "little"), n) for x in runs if b" " not in x[1:-1]]
    z = sum(float(model.weights[b]) for b in found) / max(1, len(found)) + float(model.weights[quality.shape_tokens((text or "").encode())].sum()) + model.bias
    return float(1 / (1 + np.exp(-z)))


def test_scores_are_the_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(abs(got[r["doc_id"]] - plain_score(model, r["text"])) < 1e-5 for r in docs.collect())


def test_a_sample_of_long_texts_is_bounded(spark):
    rows = spark.createDataFrame([(i, i % 2, b"x" * 1000) for i in range(40)], "doc_id long, label int, ids binary")
    kept = quality.bounded(rows, 6500, "ids").collect()
    assert sorted(r["label"] for r in kept) == [0, 0, 0, 1, 1, 1]
    assert {r["label"] for r in quality.bounded(rows, 10, "ids").collect()} == {0, 1}


def test_equal_words_share_a_pair_bucket():
    def pairs(t: bytes) -> set[int]:
        return {int(x) for x in list(quality.byte_features(t))[1][1]}

    assert pairs(b" same same ") == pairs(b" other other ") != pairs(b" same other ")


def test_edges(edge_docs, no_docs, some_labels, no_labels):
    learn = held_out_remainder(F.col("doc_id"), 5) != 9
    for labels in (some_labels, no_labels):
        model = quality.train(edge_docs, labels, learn)
        out = quality.score(edge_docs, model).collect()
        assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
        assert quality.keep_good(edge_docs, model).columns == edge_docs.columns
    assert quality.score(no_docs, quality.train(no_docs, no_labels, learn)).count() == 0


def test_training_and_scoring_count_alike():
    text = b"aaaa " * 70_000 + b"bb cc " * 9
    ids, counts = quality.sparse(text)
    assert counts.max() >= 70_000
    rows = [(ids.tobytes(), counts.tobytes(), quality.shape_tokens(text), 1), *[(*(x.tobytes() for x in quality.sparse(b"dd ee ff")), quality.shape_tokens(b"dd ee ff"), 0)] * 2]
    model = quality.fit(rows, (1.0, 1.0))
    z = (model.weights[ids] * (counts / counts.sum())).sum() + model.weights[quality.shape_tokens(text)].sum() + model.bias
    assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-6


def test_sample_is_as_large_as_documented():
    assert quality.SAMPLE == 2500
