from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import queries, toxicity
from stratalog.llm.common import held_out_remainder

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = queries.op7_toxicity(spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for p, y in held if y]) >= 0.8
    assert np.mean([p for p, y in held if not y]) <= 0.03


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(3)
    m, n, prior = len(toxicity.VOTERS), 60_000, 0.1
    y = rng.random(n) < prior
    rates = np.stack([np.full(m, 0.02), np.linspace(0.25, 0.8, m)])
    votes = rng.random((n, m)) < rates[y.astype(int)]
    votes[:, 1] = np.where(rng.random(n) < 0.8, votes[:, 0], votes[:, 1])  # the second voter mostly copies the first
    patterns, counts = np.unique(votes @ (1 << np.arange(m)), return_counts=True)
    model = toxicity.LabelModel.fit(patterns, counts, prior)
    free = [k for k in range(2, m)]
    assert np.abs(model.rates[1][free] - rates[1][free]).max() < 0.05
    assert model.correlation[0, 1] > 0.4 > np.abs(model.correlation[2, 3:]).max()
    assert model.share[0] < 0.8 < model.share[5]
    p = model.posterior(votes @ (1 << np.arange(m)))
    assert np.mean((p > 0.5) == y) > 0.98


def test_words_are_hashed_as_in_the_lists():
    text = "You are an IDIOT, and so pathetic!!!".encode()
    v = toxicity.Voters.build([[] for _ in range(toxicity.MINED)])
    bits = int(v.votes([text])[0])
    names = {n for k, n in enumerate(toxicity.VOTERS) if bits >> k & 1}
    assert {"insults", "contempt", "bangs", "you_are", "stacked"} <= names
    assert int(v.votes([b"a plain text", b"", b"Shitake"])[2]) == 0
    assert list(v.votes([text, b"plain", text])) == [bits, 0, bits]


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(0)
    c = toxicity.Classifier(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 1.0, -1.0)
    batch = [b"some words here", b"", "réeuxment und achlich".encode() * 9, b"x " * 999]
    whole = c.scores(batch)
    assert np.allclose(whole, np.concatenate([c.scores([t]) for t in batch]))
    monkeypatch.setattr(toxicity, "SPAN", 64)
    assert np.allclose(whole, np.concatenate([c.scores([t]) for t in batch]))


def test_edges(edge_docs, no_docs, some_labels, no_labels):
    learn = held_out_remainder(F.col("doc_id"), 4) != 9
    for labels in (some_labels, no_labels):
        out = toxicity.score(edge_docs, toxicity.train(edge_docs, labels, learn)).collect()
        assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(no_docs, toxicity.train(no_docs, no_labels, learn)).count() == 0


def test_lists_alone_decide_without_labels(spark, no_labels):
    docs = spark.createDataFrame([(1, "what a pathetic idiot you are, moron"), (2, "a plain text of words")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, no_labels, F.lit(True))).collect()}
    assert scores[1] > 0.3 > scores[2]


def test_the_classifier_learns_posteriors_of_all_votes(spark, monkeypatch):
    """Of labelled and of unlabelled texts alike, from the votes on the whole texts; labels are not among its targets."""
    texts = {1: "What a day, they are idiots!!! and more", 2: "a plain text of words", 3: "THE WHOLE TEXT IS LOUD AND NOTHING ELSE", 4: "you are pathetic", 5: "a calm text"}
    other = {11: "such an idiot and a moron!!!", 12: "calm words", 13: None}
    docs = spark.createDataFrame([*texts.items(), (2, "a plain text of words"), *other.items(), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_classifier
    monkeypatch.setattr(toxicity, "fit_classifier", lambda *a: seen.append(a) or fit(*a))
    model = toxicity.train(docs, labels, F.lit(True))
    sets, post, weight, y = seen[0][:4]
    assert len(sets) == len(post) == len(weight) == 8 and y.tolist() == [1, 0, 1, 0, 1]
    votes = model.voters.votes([t.encode() for t in texts.values()])
    assert np.allclose(post[:5], model.labels.posterior(votes))
    first = len(toxicity.LISTS)
    assert [int(p) >> first & 7 for p in votes] == [6, 0, 1, 4, 0]  # bits: shout, bangs, you_are
    assert sorted(post[5:]) == sorted(model.labels.posterior(model.voters.votes([(t or "").encode() for t in other.values()])))


def test_scores_are_the_brute_force(spark):
    """Every score from the classifier's weights, word by word in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    base, last = toxicity._BASE, (1 << 64) - 1

    def bucket(word: bytes, n: int = 0) -> int:
        h = sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(word)) + (n << 8) & last
        return (h ^ h >> 31) * int(toxicity._K) % (1 << 64) >> 64 - toxicity.BITS

    for r in docs.collect():
        words = set((r["text"] or "").encode().translate(toxicity._FOLD).split())
        found = {bucket(w) for w in words} | {bucket(w[:n], n) for w in words for n in toxicity.PREFIXES if len(w) > n}
        z = model.classifier.slope * sum(float(model.classifier.weights[b]) for b in found) + model.classifier.offset
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-6


def test_words_longer_than_a_part(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(100):
        text = bytes(rng.choice(list(b"abcdef     "), rng.integers(1, 90)))
        whole = np.unique(np.concatenate([np.zeros(0, np.int64), *toxicity.text_features(text)]))
        monkeypatch.setattr(toxicity, "SPAN", 11)
        assert np.array_equal(whole, toxicity.presence(text))
        monkeypatch.undo()


def test_votes_are_of_the_whole_text(monkeypatch):
    v = toxicity.Voters.build([[] for _ in range(toxicity.MINED)])
    shout, bangs, you_are, stacked = (1 << len(toxicity.LISTS) + k for k in range(4))
    loud = b"THIS TEXT IS LOUD FROM HERE TO ITS END " * 9
    assert [int(x) & shout for x in v.votes([b"mr smith said: " + loud, "¿¡漢字".encode() * 40 + loud * 3, b"The Words Begin Alone " * 9, loud])] == [shout, shout, 0, shout]
    monkeypatch.setattr(toxicity, "SPAN", 64)
    calm = b"some calm words " * 6
    apart = calm + b"an idiot " + calm + b"so pathetic " + calm
    votes = v.votes([apart]), v.votes([b"you are " + b"just " * 40 + b"stupid"]), v.votes([b"x" * 63 + b"!!!" + b"x" * 99]), v.votes([b"LOUD " * 30 + b"low " * 5])
    assert [int(x[0]) & m for x, m in zip(votes, (stacked, you_are, bangs, shout), strict=True)] == [stacked, you_are, bangs, shout]
