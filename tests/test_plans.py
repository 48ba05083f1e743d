"""Visibility and compaction plans against a model in plain Python, and the registered queries against DuckDB."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

from stratalog import queries
from stratalog.functions import crypto, keycodec
from stratalog.functions.checksum import _LIST, crc32c, crc32c_column, crc32c_rows
from stratalog.functions.text import human_bytes
from stratalog.model import Options
from stratalog.operators import reads, stats
from stratalog.plans import compaction, visibility
from stratalog.sources.lines import split_lines
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def model(points, ranges, snapshot):
    best = {}
    for k, s, kind, v in points:
        if s <= snapshot and (k not in best or s > best[k][0]):
            best[k] = (s, kind, v)
    return sorted(
        (k, s, v) for k, (s, kind, v) in best.items() if kind != 3 and not any(a <= k < b and s < r <= snapshot for a, b, r in ranges)
    )


def random_history(seed: int, n: int = 60):
    rng = random.Random(seed)
    points, ranges = [], []
    for s in range(1, n + 1):
        if rng.random() < 0.2:
            a, b = sorted(rng.sample(range(14), 2))
            ranges.append((a, b, s))
        else:
            points.append((rng.randrange(14), s, 3 if rng.random() < 0.2 else 1, s))
    return points, ranges


@pytest.fixture(scope="module")
def histories(spark):
    out = []
    for seed in range(4):
        points, ranges = random_history(seed)
        out.append((points, ranges, spark.createDataFrame(points, "key long, seq long, kind int, value long"), spark.createDataFrame(ranges or [], "start long, end long, seq long")))
    return out


@pytest.mark.parametrize("n_ranges", [1, visibility.BROADCAST_RANGES + 1, None])
def test_visible_is_the_model(histories, n_ranges):
    for points, ranges, p, r in histories:
        for snapshot in (7, 33, 60):
            got = [tuple(x) for x in visibility.visible(p, r, snapshot, n_ranges=n_ranges).select("key", "seq", "value").orderBy("key").collect()]
            assert got == model(points, ranges, snapshot)


def test_compaction_changes_no_readable_snapshot(histories):
    for points, ranges, p, r in histories[:2]:
        for floor, bottom in ((20, False), (20, True), (60, True)):
            kept = [tuple(x) for x in compaction.keep(p, r, floor, bottom, n_ranges=1).select("key", "seq", "kind", "value").collect()]
            assert len(kept) < len(points)
            for snapshot in (floor, 45, 60):
                if snapshot >= floor:
                    assert model(kept, ranges, snapshot) == model(points, ranges, snapshot)


def test_version_table(spark):
    p = spark.createDataFrame([("k", s, 1, f"v{s}") for s in (3, 7, 10)], "key string, seq long, kind int, value string")
    for snapshot, want in {2: None, 3: "v3", 5: "v3", 7: "v7", 9: "v7", 10: "v10", 1000: "v10"}.items():
        row = visibility.visible(p, None, snapshot).first()
        assert (row and row["value"]) == want


def test_the_key_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id key", "id seq", "1 kind", "id value").write.parquet(str(tmp_path / "log"))
    df = visibility.visible(spark.read.parquet(str(tmp_path / "log")).drop("value"), None, 500).filter("key = 7")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,7)" in plan and "LessThanOrEqual(seq,500)" in plan and "value" not in plan.split("ReadSchema")[1]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_versions_carry_their_payload_once(spark, tmp_path):
    """One row a key before the shuffle, and no payload in the order of the versions."""
    spark.range(1000).selectExpr("id % 50 key", "id seq", "1 kind", "repeat('x', 50) value").write.parquet(str(tmp_path / "log"))
    plan = plan_of(visibility.latest(spark.read.parquet(str(tmp_path / "log"))))
    assert plan.count("WindowGroupLimit") == 2 and "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_few_tombstones_are_counted_before_they_are_broadcast(spark):
    p = spark.range(500).selectExpr("id key", "id seq", "1 kind", "id value")
    few, many = (spark.range(n).selectExpr("id * 5 start", "id * 5 + 2 end", "1000 seq") for n in (60, 90))
    assert "BroadcastNestedLoopJoin" in plan_of(visibility.visible(p, few)) and "BroadcastNestedLoopJoin" not in plan_of(visibility.visible(p, many))
    assert visibility.visible(p, few).count() == 380 and visibility.visible(p, many).count() == 320
    assert visibility.visible(p, many, limit=100).count() == 320 and "BroadcastNestedLoopJoin" in plan_of(visibility.visible(p, many, limit=100))


def test_young_versions_are_merged_without_a_shuffle(spark):
    p = spark.range(500).selectExpr("id % 10 key", "id seq", "1 kind", "id value")
    plan = plan_of(compaction.keep(p, None, 100, False))
    assert plan.index("Union") < plan.index("Exchange") and plan.count("Exchange") == 1


def test_no_window_has_all_rows(spark):
    """Percentiles and ranks are summed by ranges first."""
    rows = spark.range(2000).selectExpr("cast(id * 7 % 1000 as double) v")
    row = stats.percentiles(rows, "v").first()
    want = sorted(float(i * 7 % 1000) for i in range(2000))
    assert (row["total"], row["p50"], row["p95"], row["p99"], row["p99_9"]) == (2000, want[1000], want[1900], want[1980], want[1998])
    ranks = {r["v"]: r["_rank"] for r in visibility.ranked(rows.distinct(), "v").collect()}
    assert ranks == {float(i): i for i in range(1000)}


def meta(path, level, low, high, seq=1, size=100):
    return compaction.FileMeta(path, "points", level, 1, size, low, high, seq, seq)


def test_picker_and_plans():
    files = [meta("a", 0, b"a", b"c", 1), meta("b", 0, b"c", b"f", 2), meta("c", 0, b"x", b"z", 3), meta("d", 1, b"e", b"g"), meta("e", 1, b"p", b"q")]
    plan = compaction.pick(files, Options(level0_trigger=3))
    assert [f.path for f in plan.inputs] == ["a", "b", "d"] and plan.level == 1
    assert compaction.pick(files, Options(level0_trigger=4)) is None
    sized = compaction.pick(files, Options(level0_trigger=9, level1_bytes=150))
    assert [f.path for f in sized.inputs] == ["d"] and sized.level == 2
    assert {f.path for f in compaction.plan_range(files, b"b", b"b").inputs} == {"a", "b", "d"}
    assert compaction.plan_range(files, b"h", b"i") is None
    assert len(compaction.plan_range(files, None, None).inputs) == 5
    assert compaction.target_bytes(3, Options(level1_bytes=10, level_multiplier=10)) == 1000
    assert not compaction.is_bottommost([files[0]], files[:1] + [meta("old", 4, b"a", b"b", 1)])


def test_crc32c(spark):
    want = {b"": 0, b"a": 0xC1D04330, b"abc": 0x364B3FB7, b"123456789": 0xE3069283}
    assert {k: crc32c(k) for k in want} == want
    assert crc32c(b"6789", crc32c(b"12345")) == want[b"123456789"]
    long = bytes(i * i % 251 for i in range(700_001))
    for data in (long, long[:131_072], long[:131_073]):
        bitwise = 0xFFFFFFFF
        for x in data:
            bitwise = bitwise >> 8 ^ _LIST[(bitwise ^ x) & 255]
        assert crc32c(data) == bitwise ^ 0xFFFFFFFF == crc32c(data[99:], crc32c(data[:99]))
    assert crc32c_rows([long, b"", b"123456789", long[:7]]).tolist() == [crc32c(long), 0, 0xE3069283, crc32c(long[:7])]
    df = spark.createDataFrame([(bytearray(k),) for k in want] + [(None,)], "b binary")
    assert {r["b"] and bytes(r["b"]): r["c"] for r in df.select("b", crc32c_column(F.col("b")).alias("c")).collect() if r["b"]} == {k: v for k, v in want.items() if k}


def test_codecs(spark):
    df = spark.createDataFrame([(bytearray(b"a"), 5, 1), (bytearray(b"ab"), 2**56 - 1, 3)], "k binary, s long, kind int")
    e = keycodec.encode_internal(F.col("k"), F.col("s"), F.col("kind"))
    got = df.select(F.hex(e).alias("h"), keycodec.user_key(e).alias("u"), keycodec.seq_of(e).alias("s"), keycodec.kind_of(e).alias("n")).collect()
    assert [(r["h"], bytes(r["u"]), r["s"], r["n"]) for r in got] == [("61FFFFFFFFFFFFFA01", b"a", 5, 1), ("61620000000000000003", b"ab", 2**56 - 1, 3)]
    ints = [-(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    enc = spark.createDataFrame([(i,) for i in ints], "i long").select("i", keycodec.ordered_int(F.col("i")).alias("b")).collect()
    assert [r["i"] for r in sorted(enc, key=lambda r: bytes(r["b"]))] == ints
    texts = ["", "a", "a\x00", "a\x00b", "ab", "b"]
    enc = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keycodec.composite(keycodec.ordered_text(F.col("t")), F.lit(b"z")).alias("b")).collect()
    assert [r["t"] for r in sorted(enc, key=lambda r: bytes(r["b"]))] == texts
    two = [keycodec.compare(F.lit("a"), F.lit(2), F.lit(k), F.lit(s)) for k, s in (("a", 1), ("a", 2), ("b", 1))]
    assert list(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(two)]).first()) == [-1, 0, -1]


def test_hkdf_vector_and_units():
    out = crypto.hkdf(bytes([0x0B] * 22), bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert out.hex().startswith("3cb25f25faacd57a90434f64d0362f2a") and len(out) == 42
    assert crypto.key_id(b"a" * 32) != crypto.key_id(b"b" * 32)
    assert [human_bytes(n) for n in (0, 1023, 1536, 1 << 30)] == ["0 B", "1023 B", "1.5 KiB", "1.0 GiB"]


def test_bad_lines_fail(spark):
    good = split_lines(spark.createDataFrame([("a  b c",), ("k\tv",), ("k ",)], "value string")).collect()
    assert [tuple(r) for r in good] == [("a", " b c"), ("k", "v"), ("k", "")]
    for bad in ("none", " value"):
        with pytest.raises(Exception, match="no key and separator"):
            split_lines(spark.createDataFrame([(bad,)], "value string")).collect()


def _plain(v):
    return f"{v:.6g}" if isinstance(v, float) else f"{float(v):.6g}" if hasattr(v, "as_tuple") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = queries.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = [tuple(map(_plain, r)) for r in df.select(*order).collect()]
    result = con.execute(queries.ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in order]
    want = [tuple(_plain(r[i]) for i in at) for r in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_next_rows_are_those_of_single_scans(spark):
    rows = spark.range(300).selectExpr("id * 3 key", "id value")
    starts = [(0, 0, 5), (1, 1, 4), (2, 3, 1), (3, 890, 9), (4, 897, 9), (5, 898, 9), (6, -5, 2), (7, 30, 0), (8, 1, 2)]
    got = {}
    for r in reads.next_rows(rows, spark.createDataFrame(starts, "scan int, start long, n int")).collect():
        got.setdefault(r["scan"], []).append((r["key"], r["value"]))
    want = {s: [(k, k // 3) for k in range(0, 900, 3) if k >= a][:n] for s, a, n in starts}
    assert {s: sorted(x) for s, x in got.items()} == {s: x for s, x in want.items() if x}
