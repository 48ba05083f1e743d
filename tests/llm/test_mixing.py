from __future__ import annotations

import re
from collections import defaultdict

import pytest

from stratalog.llm.mixing import mix_documents, resample_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, share: float = 1.5) -> dict:
    """Brute force: deal, stop what is above its limit, deal the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        got = {s: left * weight[s] / total for s in free} if free else {}
        over = [s for s in free if got[s] >= 2 * sizes[s]]
        if not over:
            return fixed | got
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def check(docs, out):
    rows = {}
    for r in docs.select("doc_id", "text", "source").collect():
        rows.setdefault(r["doc_id"], []).append((len(WORD.findall(r["text"] or "")), r["source"]))
    sizes = defaultdict(int)
    for group in rows.values():
        for n, s in group:
            sizes[s] += n
    want = targets(sizes)
    taken = defaultdict(int)
    got = out.collect()
    assert len(got) == sum(map(len, rows.values()))
    for r in got:
        here = [s for n, s in rows[r["doc_id"]] if n == r["size"] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])]
        assert here and 0 <= r["taken"] <= 2 * r["size"]
        taken[here[0]] += r["taken"]
    if len(set(sizes.values())) == len(sizes):
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 1
    return {(r["doc_id"], r["size"]): r["taken"] for r in got}


def test_mix_is_the_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = check(docs, mix_documents(docs))
    again = check(docs.repartition(7), mix_documents(docs.repartition(7)))
    assert first == again


def test_one_source_holds_nearly_all(spark):
    rows = [(i, "w " * (i % 17 + 1), "big") for i in range(500)] + [(1000 + i, "w w w", s) for i, s in enumerate(["é", None, "", "z", "big2"])] + [(2000, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs, mix_documents(docs))


def test_edges(spark, edge_docs, no_docs):
    check(edge_docs, mix_documents(edge_docs))
    assert mix_documents(no_docs).count() == 0 and resample_documents(no_docs).count() == 0
    out = resample_documents(edge_docs)
    assert out.columns == edge_docs.columns


def test_resampled_rows_follow_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = {r["doc_id"]: round(r["taken"] / r["size"]) if r["size"] else 0 for r in mix_documents(docs).collect()}
    copies = {r["doc_id"]: r["count"] for r in resample_documents(docs).groupBy("doc_id").count().collect()}
    assert copies == {k: v for k, v in mixed.items() if v}


def test_repeats_that_hold_a_third(spark):
    """Equal rows share a key; a budget that ends among them takes some of them whole."""
    rows = [(1, "w w w", "a")] * 4000 + [(10 + i, "w " * (i % 9 + 1), "a") for i in range(3000)] + [(20_000 + i, "w w", "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix_documents(docs).collect()
    taken = {s: sum(r["taken"] for r in got if r["source_size"] == n) for s, n in (("a", 12000 + sum(i % 9 + 1 for i in range(3000))), ("b", 8000))}
    want = targets({"a": 12000 + sum(i % 9 + 1 for i in range(3000)), "b": 8000})
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    words = {s: sum(len(r["text"].split()) for r in resample_documents(docs).filter(f"source = '{s}'").collect()) for s in want}
    assert all(abs(words[s] - want[s]) <= 9 for s in want)


def test_columns_of_the_same_names_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = "_copies", "_copy", "_rest", "_epochs", "target", "source_size", "_key", "_size", "_sum", "_plan_rest", "_mix_key"
    clash = docs.selectExpr("*", *(f"{i} {c}" for i, c in enumerate(names)))
    out = resample_documents(clash)
    assert out.columns == clash.columns and all(r[c] == i for r in out.collect() for i, c in enumerate(names))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in resample_documents(docs).collect())
