from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import queries
from stratalog.llm.sharding import Feistel, shard_documents


@settings(deadline=None)
@given(st.integers(1, 3000), st.integers(0, 99))
def test_permutation_and_its_inverse(n, seed):
    f = Feistel(n, seed)
    p = f.permute(np.arange(n))
    assert sorted(p.tolist()) == list(range(n))
    assert (f.permute(p, back=True) == np.arange(n)).all()
    shard, slot = f.place(n // 2, 8)
    assert f.number_at(shard, slot, 8) == n // 2


def test_huge_domains():
    f = Feistel(10**13 + 7, 1)
    x = np.array([0, 1, 10**13, 10**13 + 6])
    assert (f.permute(f.permute(x), back=True) == x).all()
    with pytest.raises(ValueError, match="not below"):
        f.permute(np.array([10**13 + 7]))


def test_it_shuffles():
    p = Feistel(100_000, 3).permute(np.arange(100_000))
    assert abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02 and np.mean(np.abs(np.diff(p)) < 100) < 0.01


def lawful(rows, n: int) -> None:
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)}
    assert sum(map(len, slots.values())) == n == len(rows)
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    out = queries.op9_shard(spark, "/root/testdata/sf0.001").collect()
    lawful(out, len(texts))
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) and r["law"] == "rows" and r["grown_shard"] is None for r in out)


def test_reruns_on_other_partitions_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({tuple(r) for r in shard_documents(d).collect()} for d in (docs, docs.repartition(5)))
    assert a == b


def test_places_can_be_computed(spark):
    rows = shard_documents(spark.range(500).selectExpr("id doc_id", "cast(id as string) text"), 8, 5).collect()
    f = Feistel(500, 5)
    assert all(f.place(r["row_number"], 8) == (r["shard"], r["slot"]) for r in rows)


def test_a_third_of_the_rows_is_one_repeated_row(spark):
    docs = spark.range(20_000).selectExpr("if(id < 7000, -1, id) doc_id", "if(id < 7000, 'same', cast(id as string)) text")
    rows = shard_documents(docs).collect()
    lawful(rows, 20_000)
    assert set(Counter(r["shard"] for r in rows if r["doc_id"] == -1)) == set(range(8))


def test_edges(spark, edge_docs, no_docs):
    lawful(shard_documents(edge_docs).collect(), 12)
    assert shard_documents(no_docs).count() == 0
