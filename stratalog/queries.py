"""Registered queries over the driver's tables, with the SQL that gives the same rows.

The log is derived from all events: key user_id, sequence event_id + 1, a delete where the event is an error; a range tombstone
[user_id, user_id + 3) stands at every signup. Snapshots and floors are shares of the newest sequence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import crypto, keycodec
from .functions.checksum import POLYNOMIAL, crc32c_column
from .model import DELETE, INLINE
from .operators import reads, stats, values
from .plans import compaction, visibility
from .sources.lines import split_lines

#: Tenths of the newest sequence.
SNAPSHOT, FLOOR = 6, 4
SERIES = (1, 2, 4, 5, 7, 9)

LOG = """log AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS kind, value FROM events),
rt AS (SELECT user_id AS s, user_id + 3 AS e, event_id + 1 AS rseq FROM events WHERE event_type = 'signup')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", DELETE).otherwise(INLINE)
    points = e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), kind.alias("kind"), "value")
    marks = e.filter(F.col("event_type") == "signup")
    return points, marks.select(F.col("user_id").alias("start"), (F.col("user_id") + 3).alias("end"), (F.col("event_id") + 1).alias("seq"))


def _at(tenths: int) -> str:
    return f"(SELECT (max(event_id) + 1) * {tenths} // 10 FROM events)"


def _seq_at(spark: SparkSession, sf_dir: str, tenths: int) -> Column:
    """The sequence at a share of the log, as a subquery of the plan that uses it."""
    return table(spark, sf_dir, "events").agg(F.expr(f"(max(event_id) + 1) * {tenths} div 10").alias("at")).scalar()


def _visible_sql(snapshot: str = "9e18", log: str = "log") -> str:
    return f"""SELECT key, seq, value FROM (SELECT * FROM {log} WHERE seq <= {snapshot} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) l
        WHERE kind <> 3 AND NOT EXISTS (SELECT 1 FROM rt r WHERE r.s <= l.key AND l.key < r.e AND r.rseq > l.seq AND r.rseq <= {snapshot})"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {LOG} {_visible_sql()}")
def snapshot_visible(spark, d):
    """What the newest sequence shows."""
    points, ranges = events_log(spark, d)
    return visibility.visible(points, ranges).select("key", "seq", "value")


@query(f"WITH {LOG} {_visible_sql(_at(SNAPSHOT))}")
def snapshot_visible_loop(spark, d):
    """The plan for few tombstones, at an older snapshot: here for all of them, counted and found to fit a broadcast."""
    points, ranges = events_log(spark, d)
    return visibility.visible(points, ranges, _seq_at(spark, d, SNAPSHOT), limit=100_000).select("key", "seq", "value")


@query(f"WITH {LOG} {_visible_sql(_at(SNAPSHOT))}")
def snapshot_visible_sweep(spark, d):
    """The same by disjoint segments, the plan for many tombstones."""
    points, ranges = events_log(spark, d)
    return visibility.visible(points, ranges, _seq_at(spark, d, SNAPSHOT), limit=0).select("key", "seq", "value")


@query(f"WITH {LOG} SELECT key FROM ({_visible_sql(_at(SNAPSHOT))})")
def keys_only(spark, d):
    points, ranges = events_log(spark, d)
    return reads.keys_only(points, ranges, _seq_at(spark, d, SNAPSHOT))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey = 77")
def point_get(spark, d):
    return reads.point_get(_orders(spark, d), 77).select("key", "value")


@query(f"WITH {LOG} SELECT key, seq, value FROM (SELECT DISTINCT c_custkey AS key FROM customer) LEFT JOIN ({_visible_sql(_at(SNAPSHOT))}) USING (key)")
def multi_get(spark, d):
    points, ranges = events_log(spark, d)
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return reads.multi_get(points, keys, ranges, _seq_at(spark, d, SNAPSHOT)).select("key", "seq", "value")


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(INLINE).alias("kind"), F.col("o_totalprice").alias("value"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100 ORDER BY 1")
def range_scan(spark, d):
    return reads.range_scan(_orders(spark, d), lower=100, upper=1100).select("key", "value")


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey >= 500 ORDER BY 1 LIMIT 20")
def seek_ge_limit(spark, d):
    return reads.seek_ge(_orders(spark, d), 500, 20, lower=10).select("key", "value")


@query("SELECT min(o_orderkey) AS key FROM orders")
def first_key(spark, d):
    return reads.seek_ge(_orders(spark, d), 0, 1).select("key")


@query("""WITH page AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 50)) ORDER BY 1 LIMIT 50)
    SELECT key FROM page""")
def next_page(spark, d):
    """Keyset paging: the second page of 50 keys."""
    points = _orders(spark, d)
    last = reads.seek_ge(points, 0, 50).agg(F.max("key").alias("last")).scalar()
    return reads.seek_ge(points.filter(F.col("key") > last), 0, 50).select("key")


@query(f"WITH {LOG} SELECT key, value FROM ({_visible_sql(_at(9))}) WHERE key >= 10 AND key < 120 ORDER BY key")
def scan_after_range_delete(spark, d):
    points, ranges = events_log(spark, d)
    return reads.range_scan(points, ranges, _seq_at(spark, d, 9), 10, 120).select("key", "value")


@query(f"""WITH {LOG} SELECT key, seq, kind, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rank, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS previous FROM log""")
def history(spark, d):
    points, _ = events_log(spark, d)
    return reads.history(points).select("key", "seq", "kind", "rank", "value", "previous")


@query(f"WITH {LOG} " + " UNION ALL ".join(f"SELECT {s} AS tenths, count(*) AS n FROM ({_visible_sql(_at(s))})" for s in SERIES))
def asof_series(spark, d):
    points, ranges = events_log(spark, d)
    parts = [visibility.visible(points, ranges, _seq_at(spark, d, s)).agg(F.lit(s).alias("tenths"), F.count(F.lit(1)).alias("n")) for s in SERIES]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {LOG}, probes AS (SELECT user_id AS key, event_id AS snapshot FROM events)
    SELECT p.key, p.snapshot, l.seq, l.kind, l.value FROM probes p ASOF LEFT JOIN log l ON p.key = l.key AND p.snapshot >= l.seq""")
def asof_get(spark, d):
    points, _ = events_log(spark, d)
    probes = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("snapshot"))
    return reads.asof_get(points, probes).select("key", "snapshot", "seq", "kind", "value")


@query(f"""WITH {LOG}, base AS ({_visible_sql(_at(SNAPSHOT))}), buf AS (SELECT s_suppkey AS key, s_acctbal AS value, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 1 END AS kind FROM supplier)
    SELECT key, value FROM base b WHERE key >= 20 AND key < 140 AND NOT EXISTS (SELECT 1 FROM buf u WHERE u.key = b.key) AND NOT (key >= 60 AND key < 70)
    UNION ALL SELECT key, value FROM buf WHERE kind = 1 AND key >= 20 AND key < 140""")
def txn_overlay_scan(spark, d):
    """A transaction whose buffer is the supplier table, odd keys put and even ones deleted, and which deletes a range."""
    points, ranges = events_log(spark, d)
    base = visibility.visible(points, ranges, _seq_at(spark, d, SNAPSHOT)).select("key", "value")
    buffer = table(spark, d, "supplier")
    buffer = buffer.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"), F.when(F.col("s_suppkey") % 2 == 0, DELETE).otherwise(INLINE).alias("kind"))
    return reads.overlay(base, buffer, spark.createDataFrame([(60, 70)], "start long, end long"), "key", 20, 140)


@query(f"WITH {LOG}, own AS (SELECT s AS key, rseq AS seq, 1 AS kind, 0.5 AS value FROM rt) " + _visible_sql(log="own"))
def txn_point_beats_range(spark, d):
    """Point writes with the sequence of a range delete over them stay visible."""
    _, ranges = events_log(spark, d)
    own = ranges.select(F.col("start").alias("key"), "seq", F.lit(INLINE).alias("kind"), F.lit(0.5).alias("value"))
    return visibility.visible(own, ranges).select("key", "seq", "value")


@query("""WITH w AS (SELECT user_id AS key, max(event_id + 1) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT event_id AS txn, event_id + 1 AS read_ts, user_id AS key FROM events WHERE event_type = 'view')
    SELECT txn, read_ts, key FROM r JOIN w USING (key) WHERE last > read_ts""")
def occ_conflicts(spark, d):
    e = table(spark, d, "events")
    r = e.filter("event_type = 'view'").select(F.col("event_id").alias("txn"), (F.col("event_id") + 1).alias("read_ts"), F.col("user_id").alias("key"))
    w = e.filter("event_type = 'purchase'").select((F.col("event_id") + 1).alias("commit_ts"), F.col("user_id").alias("key"))
    return reads.occ_conflicts(r, w).select("txn", "read_ts", "key")


@query("SELECT user_id AS key, max(event_id) AS commit_ts, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def blind_writes(spark, d):
    w = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("commit_ts"), "value")
    return reads.last_write_wins(w).select("key", "commit_ts", "value")


_KEEP = f"""kept AS (SELECT * FROM log QUALIFY seq > {_at(FLOOR)} OR row_number() OVER (PARTITION BY key, seq <= {_at(FLOOR)} ORDER BY seq DESC) = 1)"""
_BOTTOM = f"""bottom AS (SELECT * FROM kept k WHERE seq > {_at(FLOOR)} OR (kind <> 3 AND NOT EXISTS (SELECT 1 FROM rt r WHERE r.s <= k.key AND k.key < r.e AND r.rseq > k.seq AND r.rseq <= {_at(FLOOR)})))"""


@query(f"WITH {LOG}, {_KEEP} SELECT key, seq, kind, value FROM kept")
def compact_keep(spark, d):
    points, ranges = events_log(spark, d)
    return compaction.keep(points, ranges, _seq_at(spark, d, FLOOR), False).select("key", "seq", "kind", "value")


@query(f"WITH {LOG}, {_KEEP} SELECT key, count(*) AS dropped FROM (SELECT key, seq FROM log EXCEPT SELECT key, seq FROM kept) GROUP BY key")
def compact_dropped(spark, d):
    points, ranges = events_log(spark, d)
    kept = compaction.keep(points, ranges, _seq_at(spark, d, FLOOR), False)
    return points.join(kept, ["key", "seq"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("dropped"))


@query(f"WITH {LOG}, {_KEEP}, {_BOTTOM} SELECT key, seq, kind, value FROM bottom")
def compact_bottommost(spark, d):
    points, ranges = events_log(spark, d)
    return compaction.keep(points, ranges, _seq_at(spark, d, FLOOR), True).select("key", "seq", "kind", "value")


@query(f"WITH {LOG} SELECT s AS start, e AS \"end\", rseq AS seq FROM rt WHERE rseq > {_at(FLOOR)}")
def compact_ranges(spark, d):
    _, ranges = events_log(spark, d)
    return compaction.keep_ranges(ranges, _seq_at(spark, d, FLOOR), True)


@query(f"WITH {LOG} " + " UNION ALL ".join(f"SELECT {s} AS tenths, 0::BIGINT AS different, count(*) AS n FROM ({_visible_sql(_at(s))})" for s in SERIES if s >= FLOOR))
def compaction_invariance(spark, d):
    points, ranges = events_log(spark, d)
    small = compaction.keep(points, ranges, _seq_at(spark, d, FLOOR), True)
    out = []
    for s in SERIES:
        if s >= FLOOR:
            a, b = (visibility.visible(p, ranges, _seq_at(spark, d, s)).select("key", "seq", F.lit(side).alias("side")) for side, p in ((0, points), (1, small)))
            one = a.unionByName(b).groupBy("key", "seq").agg(F.count(F.lit(1)).alias("k"), F.max("side").alias("side"))
            out.append(one.agg(F.lit(s).alias("tenths"), F.count(F.when(F.col("k") == 1, 1)).alias("different"), F.count(F.when(F.col("side") == 1, 1)).alias("n")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT doc_id AS key, doc_id + 1 AS seq, CASE WHEN strlen(text) >= 1024 THEN 2 ELSE 1 END AS kind, strlen(text) AS length FROM documents")
def value_placement(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("key"), (F.col("doc_id") + 1).alias("seq"), values.placement(F.col("text"), 1024).alias("kind"), F.octet_length("text").cast("long").alias("length"))


def _docs_log(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    points = docs.select(F.col("doc_id").alias("key"), (F.col("doc_id") + 1).alias("seq"), F.lit(INLINE).alias("kind"), F.encode("text", "UTF-8").alias("value"))
    return values.separate(points.withColumn("pointer", F.lit(None).cast("struct<file_num:int,row_id:bigint,length:int>")), 1024, 1)


@query("SELECT doc_id AS key, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def value_deref(spark, d):
    log, stored = _docs_log(spark, d)
    return values.dereference(log, stored).select("key", F.md5("value").alias("digest")).filter("digest is not null")


@query("SELECT 1 AS file_num, sum(strlen(text))::BIGINT AS dead_bytes FROM documents WHERE strlen(text) >= 1024 AND doc_id % 3 = 0")
def dead_bytes(spark, d):
    log, _ = _docs_log(spark, d)
    return values.dead_bytes(log, log.filter("key % 3 <> 0")).select("file_num", "dead_bytes")


_FILES = """files AS (SELECT l_orderkey * 64 // (SELECT max(l_orderkey) + 1 FROM lineitem) AS file, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, min(l_partkey) AS min_seq, max(l_partkey) AS max_seq, count(*) AS n_rows FROM lineitem GROUP BY 1)"""


def _file_rows(spark, d) -> DataFrame:
    """All rows of lineitem as those of 64 files, by ranges of keys."""
    lines = table(spark, d, "lineitem")
    end = lines.agg((F.max("l_orderkey") + 1).alias("end")).scalar()
    return lines.select(F.floor(F.col("l_orderkey") * 64 / end).cast("long").alias("file"), F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("seq"))


@query(f"WITH {_FILES} SELECT * FROM files")
def file_minmax(spark, d):
    return stats.file_bounds(_file_rows(spark, d))


@query(f"WITH {_FILES} SELECT (file % 4)::INT AS level, count(*) AS files, sum(n_rows * 100)::BIGINT AS bytes FROM files GROUP BY 1")
def level_stats(spark, d):
    files = stats.file_bounds(_file_rows(spark, d)).select((F.col("file") % 4).cast("int").alias("level"), (F.col("n_rows") * 100).alias("bytes"))
    return stats.level_stats(files)


@query(f"""WITH {_FILES}, lv AS (SELECT (file % 4)::INT AS level, sum(n_rows * 100) AS bytes, count(*) AS n FROM files GROUP BY 1),
    r AS (SELECT level, CASE WHEN level = 0 THEN n / 4.0 ELSE bytes / (100000.0 * pow(10, level - 1)) END AS ratio FROM lv)
    SELECT level, round(ratio, 6) AS ratio FROM r WHERE ratio >= 1 ORDER BY ratio DESC, level LIMIT 1""")
def level_pick(spark, d):
    from .model import Options

    rows = stats.file_bounds(_file_rows(spark, d)).collect()  # 64 rows
    files = [
        compaction.FileMeta(str(r["file"]), "points", r["file"] % 4, r["n_rows"], r["n_rows"] * 100, b"%020d" % r["min_key"], b"%020d" % r["max_key"], r["min_seq"], r["max_seq"])
        for r in rows
    ]
    plan = compaction.pick(files, Options(level1_bytes=100_000, level0_trigger=4))
    schema = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("ratio", T.DoubleType())])
    return spark.createDataFrame([] if plan is None else [(plan.level - 1, round(plan.ratio, 6))], schema)


_SPANS = f"""{_FILES}, spans AS (SELECT file, min_key, max_key + CASE WHEN file % 3 = 2 THEN 0 ELSE 100 END AS max_key FROM files)"""


def _spans(spark, d) -> DataFrame:
    """64 files of which each third one does not reach into the next."""
    files = stats.file_bounds(_file_rows(spark, d))
    return files.select("file", "min_key", (F.col("max_key") + F.when(F.col("file") % 3 == 2, 0).otherwise(100)).alias("max_key"))


@query(f"WITH {_SPANS} SELECT x.file AS a, y.file AS b FROM spans x, spans y WHERE x.file < y.file AND x.max_key >= y.min_key AND y.max_key >= x.min_key")
def file_overlap(spark, d):
    return stats.overlapping_files(_spans(spark, d))


@query(f"""WITH RECURSIVE {_SPANS}, hull AS (SELECT min_key AS lo, max_key AS hi, 0 AS k FROM (SELECT * FROM spans ORDER BY min_key, file LIMIT 1)
    UNION ALL SELECT (SELECT min(min_key) FROM spans s WHERE s.min_key <= h.hi AND s.max_key >= h.lo), (SELECT max(max_key) FROM spans s WHERE s.min_key <= h.hi AND s.max_key >= h.lo), k + 1 FROM hull h WHERE k < 45)
    SELECT file FROM spans, (SELECT lo, hi FROM hull ORDER BY k DESC LIMIT 1) h WHERE min_key <= h.hi AND max_key >= h.lo""")
def l0_expand(spark, d):
    rows = _spans(spark, d).collect()  # 64 rows
    files = [compaction.FileMeta(str(r["file"]), "points", 0, 1, 1, b"%020d" % r["min_key"], b"%020d" % r["max_key"], 1, 1) for r in rows]
    seed = min(files, key=lambda f: (f.min_key, int(f.path)))
    return spark.createDataFrame([(int(f.path),) for f in compaction.expand([seed], files)], "file long")


@query("SELECT event_id, hex(encode(props)) || lpad(hex(72057594037927935 - event_id), 14, '0') || '01' AS internal, event_id AS seq, 1 AS kind, hex(encode(props)) AS user_key FROM events")
def key_codec(spark, d):
    e = table(spark, d, "events").withColumn("_k", keycodec.encode_internal(F.encode("props", "UTF-8"), F.col("event_id"), F.lit(1)))
    return e.select("event_id", F.hex("_k").alias("internal"), keycodec.seq_of(F.col("_k")).alias("seq"), keycodec.kind_of(F.col("_k")).alias("kind"), F.hex(keycodec.user_key(F.col("_k"))).alias("user_key"))


@query("""SELECT event_id, CASE WHEN user_id < previous THEN -1 WHEN user_id > previous THEN 1 WHEN event_id > event_id - 1 THEN -1 END AS compared
    FROM (SELECT event_id, user_id, lag(user_id, 1, 0) OVER (ORDER BY event_id) AS previous FROM events)""")
def key_compare(spark, d):
    """Each event's key and sequence against those of the event before it: keys upwards, of equal keys sequences downwards."""
    e = table(spark, d, "events").select("event_id", "user_id")
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("previous"))
    both = e.join(before, "event_id", "left").fillna(0, ["previous"])
    encoded = [keycodec.ordered_int(F.col(c)) for c in ("user_id", "previous")]
    return both.select("event_id", keycodec.compare(encoded[0], F.col("event_id"), encoded[1], F.col("event_id") - 1).alias("compared"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey - 75) AS place FROM customer")
def ordered_int_key(spark, d):
    keys = table(spark, d, "customer").select("c_custkey", keycodec.ordered_int(F.col("c_custkey") - 75).alias("_k"))
    return visibility.ranked(keys, "_k").select("c_custkey", (F.col("_rank") + 1).alias("place"))


@query("SELECT doc_id, 1 AS file_num, doc_id * 7 - 300 AS row_id, n_chars::INT AS length FROM documents")
def pointer_codec(spark, d):
    p = F.struct(F.lit(1).alias("file_num"), (F.col("doc_id") * 7 - 300).alias("row_id"), F.col("n_chars").cast("int").alias("length"))
    return table(spark, d, "documents").select("doc_id", keycodec.decode_pointer(keycodec.encode_pointer(p)).alias("_p")).select("doc_id", "_p.*")


@query(f"""WITH RECURSIVE steps AS (SELECT unnest(range(0, 256)) AS i, unnest(range(0, 256)) AS c, 0 AS k
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}::BIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    effects AS (SELECT list(c ORDER BY i) AS effect FROM steps WHERE k = 8),
    p AS (SELECT p_partkey, list_transform(range(0, strlen(p_name)), lambda k: ('0x' || substr(hex(encode(p_name)), CAST(2 * k + 1 AS BIGINT), 2))::BIGINT) AS bytes FROM part)
    SELECT p_partkey, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, effect[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM p, effects""")
def crc32c(spark, d):
    return table(spark, d, "part").select("p_partkey", crc32c_column(F.encode("p_name", "UTF-8")).alias("crc"))


@query("SELECT p_partkey, p_name, true AS moved_refused FROM part")
def gcm_roundtrip(spark, d):
    secret = crypto.data_key(b"m" * 32, "query", "values")
    parts = table(spark, d, "part").withColumn("_key", keycodec.ordered_int(F.col("p_partkey")))
    aad = crypto.associated("value", F.col("_key"), F.col("p_partkey"))
    other = crypto.associated("value", F.col("_key"), F.col("p_partkey") + 1)
    sealed = parts.withColumn("_sealed", crypto.seal(F.encode("p_name", "UTF-8"), secret, aad))
    return sealed.select("p_partkey", F.decode(crypto.open_sealed(F.col("_sealed"), secret, aad), "UTF-8").alias("p_name"), crypto.try_open(F.col("_sealed"), secret, other).isNull().alias("moved_refused"))


@query("""WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT max(n) AS total, round(avg(v), 6) AS mean, max(v) AS max, max(CASE WHEN i = least((n * 0.5)::BIGINT, n - 1) THEN v END) AS p50,
    max(CASE WHEN i = least(floor(n * 0.95)::BIGINT, n - 1) THEN v END) AS p95, max(CASE WHEN i = least(floor(n * 0.99)::BIGINT, n - 1) THEN v END) AS p99,
    max(CASE WHEN i = least(floor(n * 0.999)::BIGINT, n - 1) THEN v END) AS p99_9 FROM s""")
def latency_percentiles(spark, d):
    return stats.percentiles(table(spark, d, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("SELECT CASE " + " ".join(f"WHEN value <= {e} THEN {i}" for i, e in enumerate(stats.EDGES)) + f" ELSE {len(stats.EDGES)} END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), "value")


@query("""SELECT user_id, coalesce(count(*) FILTER (event_type = 'view') * 1.0::DOUBLE / nullif(count(*) FILTER (event_type IN ('view', 'error')), 0), 0) AS rate FROM events GROUP BY 1""")
def hit_rate(spark, d):
    g = table(spark, d, "events").groupBy("user_id")
    counts = g.agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("h"), F.count(F.when(F.col("event_type") == "error", 1)).alias("m"))
    return counts.select("user_id", stats.hit_rate(F.col("h"), F.col("m")).alias("rate"))


@query("SELECT regexp_extract(p_name, '^([^ \\t]+)[ \\t](.*)$', 1) AS key, regexp_extract(p_name, '^([^ \\t]+)[ \\t](.*)$', 2) AS value FROM part WHERE p_name ~ '^[^ \\t]+[ \\t].*'")
def load_lines(spark, d):
    return split_lines(table(spark, d, "part").select(F.col("p_name").alias("value")), strict=False).filter("key is not null")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import store_queries  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import store_queries  # noqa: F401

    return dict(ORACLES)
