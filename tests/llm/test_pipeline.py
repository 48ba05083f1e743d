from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import brute
from test_mixing import WORD, targets
from test_quality import plain_score
from test_simhash import groups, plain_fingerprint

from stratalog.llm import quality
from stratalog.llm.common import held_out_remainder
from stratalog.llm.sharding import Feistel

SF = "/root/testdata/sf0.001"


def mixed(rows: list) -> list[int]:
    """Ids of a mix, each as often as it is taken, by sorting every source by its keys."""
    sizes, sources = Counter(), {}
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        key = hashlib.md5(f"11|{r['doc_id']}|{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()[:15]
        sources.setdefault(r["source"], []).append((key, n, r["doc_id"]))
    out = []
    for source, target in targets(dict(sizes)).items():
        budget = round(target)
        epochs, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        for _, n, doc in sorted(sources[source]):
            taken = max(0, min(n, rest))
            rest -= taken
            out += [doc] * (epochs + int(taken / n + 0.5) if n else 0)
    return sorted(out)


def sharded(rows: list) -> list[tuple]:
    """Shard and slot by numbering all rows in the order of their hashes and permuting every number by itself."""
    seed, shards = 20240229, corpus_pipeline.SHARDS
    order = sorted((hashlib.md5(f"{seed}|{r['doc_id']}|{r['text'] or ''}".encode()).hexdigest()[:16], r["doc_id"]) for r in rows)
    f = Feistel(len(order), seed)
    return sorted((doc, *f.place(i, shards)) for i, (_, doc) in enumerate(order))


def test_every_stage_is_the_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        seen[name], docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        assert name == "shard" or docs.columns == columns
    seen["end"] = docs.collect()

    def ids(rows: list) -> list[int]:
        return sorted(r["doc_id"] for r in rows)

    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(all_docs, spark.read.parquet(f"{SF}/labels.parquet"), held_out_remainder(F.col("doc_id"), 5) != 0)
    assert ids(seen["near_duplicates"]) == [r["doc_id"] for r in sorted(seen["quality"]) if plain_score(model, r["text"]) >= quality.THRESHOLD]
    rows = sorted(seen["near_duplicates"])
    names = groups([r["doc_id"] for r in rows], [plain_fingerprint(r["text"]) for r in rows])
    assert ids(seen["decontaminate"]) == [r["doc_id"] for r, name in zip(rows, names, strict=True) if r["doc_id"] == name]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {doc for doc, _ in brute([(r["doc_id"], r["text"]) for r in seen["decontaminate"]], items)}
    assert ids(seen["mix"]) == [i for i in ids(seen["decontaminate"]) if i not in leaks]
    assert ids(seen["shard"]) == mixed(seen["mix"])
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in seen["end"]) == sharded(seen["shard"])
    assert ids(corpus_pipeline.run(spark, SF).collect()) == ids(seen["end"])


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "shard" or out.columns == docs.columns)
        docs = out


def test_odd_documents(spark, edge_docs):
    """Null ids and texts, repeated and blank rows: each stage gives rows of its input, and the same ones for other column names."""
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    clash = docs.selectExpr("*", *(f"1 {c}" for c in ("_id", "_row", "_copies", "_rest", "_copy", "_mix_size", "_epochs", "target", "source_size", "_key", "_lost_id", "score")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, other = stage(spark, docs, SF), stage(spark, clash, SF)
        assert other.columns == clash.columns
        assert sorted(map(repr, other.select(*docs.columns).collect())) == sorted(map(repr, out.collect())), name
        assert {repr(r) for r in out.collect()} <= {repr(r) for r in docs.collect()}, name
    everything = corpus_pipeline.sharded(spark, docs, SF)
    assert everything.count() == docs.count() and {r["shard"] for r in everything.collect()} <= set(range(8))
