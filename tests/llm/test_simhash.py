from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import components, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text: str | None) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids: list, fps: list[int]) -> dict:
    """Brute force over all pairs: the smallest id that each row reaches."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_query_is_the_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(docs, fps, groups([r["doc_id"] for r in docs], fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, "/root/testdata/sf0.001").collect()} == want


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
def test_every_pair_within_the_radius_meets(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    assert any((x & int(m)) == (y & int(m)) for m in simhash.covering_masks())


def test_masks_keep_about_half():
    masks = simhash.covering_masks()
    assert len(masks) == 31 and all(30 <= bin(int(m)).count("1") <= 35 for m in masks)


def crowd(seed: int, n: int, flips: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    out = set()
    while len(out) < n:
        x = int(base[rng.integers(6)])
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize(("flips", "dense"), [(3, 2048), (3, 8), (9, 8)])
def test_links_of_crowded_buckets(spark, flips, dense):
    """All that is linked is connected, whether or not buckets are dealt out by further masks."""
    fps = crowd(1, 400, flips)
    want = groups(list(range(len(fps))), [int(x) for x in fps])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.link_fingerprints(df, dense=dense)
    assert all(bin((r["u"] ^ r["v"]) % 2**64).count("1") <= 4 for r in links.collect())
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    least = {}
    for i, x in enumerate(fps.view(np.int64)):
        least.setdefault(roots.get(int(x), int(x)), i)
    assert [least[roots.get(int(x), int(x))] for x in fps.view(np.int64)] == want


def test_buckets_of_the_last_family_are_small():
    """A bucket that is not split further holds at most 2 ** 14 fingerprints: its masks leave so few bits open."""
    assert max(64 - bin(m).count("1") for _, _, m in simhash.mask_family(4, simhash.LEVELS - 1)) <= 14


def test_columns_of_the_same_names_pass(spark):
    rows = [(1, "one text of some words", 7, 8, 9, "x"), (1, "one text of some words", 7, 8, 9, "x"), (2, "one text of some words", 1, 2, 3, "y"), (3, "quite another text, of other words", 4, 5, 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _row long, _a long, _doc string")
    assert sorted(map(tuple, simhash.keep_one_of_each_group(docs).collect())) == [rows[0], rows[3]]


def test_texts_stay_where_they_are(spark):
    """Few rows go: they are broadcast, and the texts of the others are not shuffled."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = simhash.keep_one_of_each_group(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@settings(max_examples=5, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    best = {x: x for e in edges for x in e}
    for _ in best:
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    assert got == {x: r for x, r in best.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_edges(spark, edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(map(str, zip([r["doc_id"] for r in rows], fps, groups([r["doc_id"] for r in rows], fps), strict=True)))
    got = simhash.near_duplicates(edge_docs).collect()
    assert sorted(str((r["doc_id"], r["fp"] % 2**64, r["component_id"])) for r in got) == want
    kept = simhash.keep_one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(set(groups(list(range(len(rows))), fps)))
    nameless = spark.createDataFrame([(None, "one text of some words"), (None, "another one of other words"), (None, "one text of some words")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one_of_each_group(nameless).collect()) == ["another one of other words", "one text of some words"]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one_of_each_group(no_docs).count() == 0
