"""Registered queries that run the store itself over the driver's tables: log, transactions, compaction, backup, encryption, streams.

Every query opens a store in a folder of its own in the session's shared folder, works on it, writes down what it found and
removes the folder. Keys are the table's numbers as sortable text, so that SQL can say the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as units
from .model import BackPressureError, ConflictError, EncryptionError, Options, ReadOnlyError, TxnTooLargeError
from .operators import reads
from .plans.materialise import materialise, shared_folder
from .queries import query, table
from .sources.backup import restore
from .sources.files import Files
from .store import Store
from .streaming.ingest import current_values, ingest


def in_a_store(**options):
    """f(spark, sf_dir, open) with open(name, **more) for stores in a folder that is removed when the result is written."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
            opened: list[Store] = []

            def open_store(name: str = "db", **more) -> Store:
                opened.append(Store.open(spark, f"{folder}/{name}", Options(**(options | more))))
                return opened[-1]

            open_store.folder = folder
            try:
                return materialise(f(spark, d, open_store))
            finally:
                for s in opened:
                    s.close()
                Files(spark, folder).delete("")

        return run

    return wrap


def key_of(number: Column, letter: str = "k") -> Column:
    return F.encode(F.format_string(f"{letter}%09d", number.cast("long")), "UTF-8")


def name(number: int, letter: str = "k") -> bytes:
    return b"%s%09d" % (letter.encode(), number)


def shown(rows: DataFrame) -> DataFrame:
    """key and value as text."""
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def customers(spark: SparkSession, d: str, value: str = "c_name") -> DataFrame:
    return table(spark, d, "customer").select(key_of(F.col("c_custkey")).alias("key"), F.encode(F.col(value).cast("string"), "UTF-8").alias("value"))


_K = "format('k{:09d}', c_custkey)"


@query(f"SELECT {_K} AS key, c_name AS value FROM customer")
@in_a_store()
def store_bulk_scan(spark, d, open_store):
    """One commit of a table, read as it is sorted and pruned by files."""
    with open_store() as db:
        db.write(customers(spark, d))
        return materialise(shown(db.scan()))


@query(f"""WITH half AS (SELECT max(c_custkey) // 2 AS m FROM customer)
    SELECT {_K} AS key, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer, half
    WHERE c_custkey % 7 <> 0 AND (c_custkey % 5 = 0 OR c_custkey < m OR c_custkey >= m + 20)""")
@in_a_store(level0_trigger=2)
def store_layers(spark, d, open_store):
    """Puts, a range delete, puts over it and deletes, in files, buffers and merged files: deletes stay deleted."""
    c = table(spark, d, "customer")
    half = c.agg(F.max("c_custkey")).first()[0] // 2
    with open_store() as db:
        db.write(customers(spark, d))
        db.delete_range(name(half), name(half + 20))
        db.flush()
        db.compact_now()
        db.write(c.filter("c_custkey % 5 = 0").select(key_of(F.col("c_custkey")).alias("key"), F.encode("c_mktsegment", "UTF-8").alias("value")))
        gone = c.filter("c_custkey % 7 = 0").select(key_of(F.col("c_custkey")).alias("key"), F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("value"))
        db.write(gone, deletes=True)
        db.compact_range()
        return materialise(shown(db.scan()))


@query(f"""SELECT {_K} AS key, c_name AS value FROM customer WHERE c_nationkey >= 10 AND NOT EXISTS
    (SELECT 1 FROM supplier s WHERE s_suppkey * 10 <= c_custkey AND c_custkey < s_suppkey * 10 + 3)""")
@in_a_store()
def store_range_deletes(spark, d, open_store):
    """A range delete for every supplier in one commit, after the deletes of ten nations in another."""
    s = table(spark, d, "supplier")
    with open_store() as db:
        db.write(customers(spark, d))
        gone = table(spark, d, "customer").filter("c_nationkey < 10").select(key_of(F.col("c_custkey")).alias("key"), F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("value"))
        db.write(gone, deletes=True)
        db.delete_ranges(s.select(key_of(F.col("s_suppkey") * 10).alias("start"), key_of(F.col("s_suppkey") * 10 + 3).alias("end")))
        return materialise(shown(db.scan()))


@query("""SELECT n_nationkey AS nation, n_nationkey % 2 = 0 AS conflict, CASE WHEN n_nationkey % 2 = 0 THEN 'late' ELSE 'mine' END AS stays FROM nation""")
@in_a_store()
def store_conflicts(spark, d, open_store):
    """A transaction reads each nation's key; where another commit writes it first, the commit fails and changes nothing."""
    rows = table(spark, d, "nation").select("n_nationkey").collect()  # 25 rows
    out = []
    with open_store() as db:
        for (n,) in rows:
            db.set(name(n), b"old")
        for (n,) in rows:
            txn = db.begin()
            txn.get(name(n))
            txn.set(name(n), b"mine")
            if n % 2 == 0:
                db.set(name(n), b"late")
            try:
                txn.commit()
                lost = False
            except ConflictError:
                lost = True
            out.append((n, lost, db.get(name(n)).decode()))
        return spark.createDataFrame(out, "nation int, conflict boolean, stays string")


@query("""SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey BETWEEN 10 AND 12 THEN 'base' ELSE 'own' END AS inside,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey BETWEEN 10 AND 12 THEN 'base' ELSE 'own' END AS scanned, 'old' AS outside FROM nation""")
@in_a_store()
def store_read_your_writes(spark, d, open_store):
    """What a transaction with puts, deletes and a range delete sees by get and by scan, and what others see meanwhile."""
    numbers = [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows
    with open_store() as db:
        for n in numbers:
            db.set(name(n), b"old")
        with db.begin() as txn:
            txn.delete_range(name(0), name(10))
            for n in numbers:
                if n % 3 == 0:
                    txn.delete(name(n))
                elif not 10 <= n <= 12:
                    txn.set(name(n), b"own")
            scanned = {bytes(r["key"]): bytes(r["value"]).decode().replace("old", "base") for r in txn.scan().collect()}
            say = lambda v: None if v is None else v.decode().replace("old", "base")
            out = [(n, say(txn.get(name(n))), scanned.get(name(n)), db.get(name(n)).decode()) for n in numbers]
    return spark.createDataFrame(out, "nation int, inside string, scanned string, outside string")


@query("""SELECT r_regionkey AS region, least(count(*), 3) AS written, count(*) > 3 AS refused FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
@in_a_store(txn_max_keys=3)
def store_txn_caps(spark, d, open_store):
    """Each region's transaction puts its nations until the cap on keys refuses; what it had is committed."""
    rows = table(spark, d, "nation").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()  # 25 rows
    out = []
    with open_store() as db:
        for region in sorted({r[0] for r in rows}):
            refused = False
            with db.begin() as txn:
                for _, n in (r for r in rows if r[0] == region):
                    try:
                        txn.set(name(n, f"r{region}"), b"x")
                    except TxnTooLargeError:
                        refused = True
                txn.commit()
            out.append((region, db.scan(f"r{region}".encode(), f"r{region}~".encode()).count(), refused))
    return spark.createDataFrame(out, "region int, written long, refused boolean")


@query("""SELECT n_nationkey AS nation, n_nationkey + 1 AS attempts FROM nation WHERE n_nationkey < 4""")
@in_a_store()
def store_update_retries(spark, d, open_store):
    """An update whose first runs meet a conflict is run again until it commits: a counter loses no increment."""
    out = []
    with open_store() as db:
        for n in range(4):
            runs = []

            def add(txn, n=n, runs=runs):
                old = int(txn.get(name(n)) or b"0")
                if len(runs) < n:
                    db.set(name(n), b"%d" % (old + 1))
                runs.append(old)
                txn.set(name(n), b"%d" % (old + 1))

            db.update(add)
            out.append((n, int(db.get(name(n)))))
    return spark.createDataFrame(out, "nation int, attempts int")


@query("""SELECT n_regionkey AS region, (SELECT count(*) FROM customer JOIN nation m ON c_nationkey = m.n_nationkey WHERE m.n_regionkey <= n.n_regionkey) AS n,
    (SELECT count(*) FROM customer) AS now FROM nation n GROUP BY ALL""")
@in_a_store(level0_trigger=2)
def store_snapshots(spark, d, open_store):
    """A commit for each region and a snapshot after it; merges and a vacuum later, each still shows what it showed."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = sorted(r[0] for r in table(spark, d, "region").select("r_regionkey").collect())  # 5 rows
    with open_store() as db:
        taken = []
        for r in regions:
            db.write(c.filter(F.col("n_regionkey") == r).select(key_of(F.col("c_custkey")).alias("key"), F.encode("c_name", "UTF-8").alias("value")))
            taken.append((r, db.snapshot()))
        db.compact_range()
        db.vacuum()
        now = db.scan().count()
        out = [(r, s.scan().count(), now) for r, s in taken]
        for _, s in taken:
            s.close()
    return spark.createDataFrame(out, "region int, n long, now long")


@query("SELECT count(*) AS shown, count(*) AS after_vacuum, true AS kept_while_held, true AS gone_when_free FROM customer")
@in_a_store(level0_trigger=2)
def store_lazy_scan_survives_vacuum(spark, d, open_store):
    """A scan that was asked for but not run holds its files through writes, merges and a vacuum."""
    with open_store() as db:
        db.write(customers(spark, d))
        before, files = db.scan(), {f.path for f in db._version.files}
        db.write(customers(spark, d, "c_mktsegment"))
        db.compact_range()
        held = not files & set(db.vacuum())
        n, now = before.count(), db.scan().count()
        del before
        import gc

        gc.collect()
        return spark.createDataFrame([(n, now, held, files == set(db.vacuum()))], "shown long, after_vacuum long, kept_while_held boolean, gone_when_free boolean")


@query(f"SELECT {_K} AS key, c_mktsegment AS value, true AS one_version_each, 1::BIGINT AS max_level0 FROM customer")
@in_a_store(auto_compact=True, level0_trigger=2, level1_bytes=1 << 30)
def store_auto_compaction(spark, d, open_store):
    """Bulk writes that merge what is due by themselves: level 0 stays short, old versions go."""
    with open_store() as db:
        for column in ("c_name", "c_mktsegment", "c_name", "c_mktsegment"):
            db.write(customers(spark, d, column))
        level0 = min(1, db.stats().level_files[0])
        db.compact_range()
        one = db.points().count() == db.scan().count()
        return materialise(shown(db.scan()).select("key", "value", F.lit(one).alias("one_version_each"), F.lit(max(level0, 1)).cast("long").alias("max_level0")))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
@in_a_store(value_threshold=256)
def store_large_values(spark, d, open_store):
    """Texts from 256 bytes on are stored apart; a multi-get of all keys, over two commits and a merge, finds each of them."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", key_of(F.col("doc_id"), "d").alias("key"), F.encode("text", "UTF-8").alias("value"))
    with open_store() as db:
        db.write(rows.filter("doc_id % 2 = 0").select("key", F.encode(F.lit("old"), "UTF-8").alias("value")))
        db.write(rows.select("key", "value"))
        db.compact_range()
        found = db.multi_get(rows.select("key"))
        return materialise(rows.select("doc_id", "key").join(found, "key").select("doc_id", F.md5("value").alias("digest")))


@query("SELECT n_nationkey AS nation, 'v' || n_nationkey AS value, 26::BIGINT AS seq, true AS writes_refused FROM nation")
@in_a_store()
def store_reopen(spark, d, open_store):
    """Small commits survive closing, in the log alone; a reader without writing rights sees them."""
    numbers = [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows
    with open_store() as db:
        for n in numbers:
            db.set(name(n), b"v%d" % n)
        db.delete(b"nothing")
    with open_store(read_only=True) as db:
        try:
            db.set(b"x", b"y")
            refused = False
        except ReadOnlyError:
            refused = True
        return spark.createDataFrame([(n, db.get(name(n)).decode(), db.stats().seq, refused) for n in numbers], "nation int, value string, seq long, writes_refused boolean")


@query(f"SELECT {_K} AS key, c_name AS value FROM customer WHERE c_custkey % 3 <> 0")
@in_a_store()
def store_backup_restore(spark, d, open_store):
    """A backup taken between two commits, restored elsewhere: what was there when it was taken."""
    with open_store() as db:
        db.write(customers(spark, d))
        gone = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(key_of(F.col("c_custkey")).alias("key"), F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("value"))
        db.write(gone, deletes=True)
        db.backup(f"{open_store.folder}/backup")
        db.delete_range(name(0), name(10**9 - 1))
    restore(spark, f"{open_store.folder}/backup", f"{open_store.folder}/again")
    with open_store("again") as db:
        return materialise(shown(db.scan()))


@query(f"SELECT {_K} AS key, c_name AS value, false AS plain_on_disk, true AS refused_without_key FROM customer")
@in_a_store(value_threshold=0)
def store_encrypted(spark, d, open_store):
    """Values sealed in files and in log entries; opened by the key alone."""
    with open_store(master_key=b"k" * 32) as db:
        db.write(customers(spark, d).filter("key < 'k000000050'"))
        for r in customers(spark, d).filter("key >= 'k000000050' and key < 'k000000060'").collect():  # ten rows
            db.set(bytes(r["key"]), bytes(r["value"]))
        db.write(customers(spark, d).filter("key >= 'k000000060'"))
    try:
        open_store()
        refused = False
    except EncryptionError:
        refused = True
    with open_store(master_key=b"k" * 32) as db:
        plain = customers(spark, d).join(db.points().select("key", F.col("value").alias("stored")), "key").filter("value = stored").limit(1).count()
        return materialise(shown(db.scan()).select("key", "value", F.lit(plain > 0).alias("plain_on_disk"), F.lit(refused).alias("refused_without_key")))


@query("SELECT format('u{:09d}', user_id) AS key, CAST(max(event_id) AS VARCHAR) AS value, 1::BIGINT AS commits FROM events GROUP BY user_id")
@in_a_store()
def store_stream(spark, d, open_store):
    """The event table as a stream, the last event of a key by its number stays; a replayed batch is known."""
    with open_store() as db:
        src, state = f"{open_store.folder}/in", f"{open_store.folder}/state"
        e = table(spark, d, "events").select(key_of(F.col("user_id"), "u").alias("key"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value"), "event_id")
        e.write.parquet(src)
        ingest(spark.readStream.schema(e.schema).parquet(src), db, state, order="event_id").awaitTermination()
        seq = db.write(e.select("key", F.encode(F.lit("again"), "UTF-8").alias("value")), source=state, batch=0)
        return materialise(shown(db.scan()).withColumn("commits", F.lit(seq).cast("long")))


@query("SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) = 'error' AS deleted, CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(value, event_id) END AS value FROM events GROUP BY 1")
@in_a_store()
def stream_current_values(spark, d, open_store):
    """The changelog of the newest version per key, over the event table as a stream in two batches, at its end."""
    src, out = f"{open_store.folder}/in", f"{open_store.folder}/out"
    kind = F.when(F.col("event_type") == "error", 3).otherwise(1)
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), "value")
    for half in (1, 0):  # the newer half first: the older one is late
        e.filter(F.col("seq") % 2 == half).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    write = lambda batch, n: batch.withColumn("_n", F.lit(n)).write.mode("append").parquet(out)
    current_values(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{open_store.folder}/state").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(out)
    last = log.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c not in ("key", "_n")]), "_n").alias("_v"))
    return last.select("key", "_v.seq", "_v.deleted", "_v.value")


@query("""SELECT n_nationkey AS nation, (SELECT min(c_custkey) FROM customer WHERE c_custkey >= n_nationkey * 5) AS first,
    (SELECT c_custkey FROM customer WHERE c_custkey >= n_nationkey * 5 ORDER BY 1 LIMIT 1 OFFSET 2) AS third FROM nation""")
@in_a_store()
def store_iterator(spark, d, open_store):
    """For each nation a seek in one cursor over the customers, and two steps on."""
    numbers = [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 rows
    out = []
    with open_store() as db:
        db.write(customers(spark, d))
        with db.iterator() as cursor:
            for n in numbers:
                cursor.seek_ge(name(n * 5))
                first = int(cursor.key[1:])
                cursor.next()
                cursor.next()
                out.append((n, first, int(cursor.key[1:])))
    return spark.createDataFrame(out, "nation int, first long, third long")


@query(f"""SELECT {_K} AS key, unnest([2, 1])::BIGINT AS seq, unnest([1, 2])::INT AS rank, unnest([c_mktsegment, c_name]) AS value, unnest([c_name, NULL]) AS previous FROM customer""")
@in_a_store()
def store_history(spark, d, open_store):
    """Every stored version with its rank and the value before it."""
    with open_store() as db:
        db.write(customers(spark, d))
        db.write(customers(spark, d, "c_mktsegment"))
        h = db.history().select(F.decode("key", "UTF-8").alias("key"), "seq", "rank", F.decode("value", "UTF-8").alias("value"), F.decode("previous", "UTF-8").alias("previous"))
        return materialise(h)


@query("SELECT count(*) AS n, 3::BIGINT AS hits, 2::BIGINT AS misses, 0.6::DOUBLE AS rate FROM customer")
@in_a_store()
def store_cached_scans(spark, d, open_store):
    """A scan that is kept is read again until a commit makes it stale."""
    with open_store() as db:
        db.write(customers(spark, d))
        for _ in range(3):
            db.cached_scan().count()
        db.set(name(10**8), b"new")
        db.cached_scan().count()
        n = db.cached_scan().filter(F.col("key") < name(10**8)).count()
        c = db.stats().cache
        return spark.createDataFrame([(n, c.hits, c.misses, round(c.hit_rate(), 6))], "n long, hits long, misses long, rate double")


@query("""SELECT 6::BIGINT AS seq, 1::BIGINT AS buffered_ops, 11::BIGINT AS buffered_bytes, 4::BIGINT AS level0, 0::BIGINT AS level1, 0::BIGINT AS merged_level0, 1::BIGINT AS merged_level1,
    true AS refused, count(*) AS n, '1.5 KiB' AS size FROM customer""")
@in_a_store(max_level0_files=5, level0_trigger=4)
def store_stats(spark, d, open_store):
    """Counters before and after a merge, and the refusal of a bulk write while too many files wait for one."""
    few = lambda c: customers(spark, d, c).coalesce(1)
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with open_store() as db:
            for c in ("c_name", "c_mktsegment", "c_name"):
                db.write(few(c))
            db.delete(b"none")
            db.flush()
            db.set(name(1), b"x")
            db.write(few("c_name"))
            try:
                db.write(few("c_name"))
                refused = False
            except BackPressureError:
                refused = True
            s = db.stats()
            level0 = sum(1 for f in db._version.files if f.level == 0 and f.rows > 1)
            db.compact_range()
            m = db.stats()
            row = (s.seq, s.buffered_ops, s.buffered_bytes, level0, s.level_files[1], m.level_files[0], m.level_files[1], refused, db.scan().count(), units.human_bytes(1536))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
    return spark.createDataFrame([row], "seq long, buffered_ops long, buffered_bytes long, level0 long, level1 long, merged_level0 long, merged_level1 long, refused boolean, n long, size string")


@query("""SELECT n_nationkey AS nation, count(*) AS probes, count(*) FILTER (c_custkey IS NOT NULL) AS found FROM nation, unnest(range(0, 40)) u(i)
    LEFT JOIN customer ON c_custkey = n_nationkey * 100 + i GROUP BY 1""")
@in_a_store()
def store_multi_get(spark, d, open_store):
    """One job for all keys of a batch, present or not."""
    with open_store() as db:
        db.write(customers(spark, d))
        asked = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
        asked = asked.select("n_nationkey", key_of(F.col("n_nationkey") * 100 + F.col("i")).alias("key"))
        found = asked.join(db.multi_get(asked.select("key")), "key")
        return materialise(found.groupBy(F.col("n_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("probes"), F.count("value").alias("found")))


@query("SELECT 'missing' AS case, true AS found UNION ALL SELECT 'orphan', true UNION ALL SELECT 'sound', true")
@in_a_store()
def store_fsck(spark, d, open_store):
    """What the file check says of a sound store, of a stray file and of a lost one."""
    with open_store() as db:
        db.write(customers(spark, d))
        sound = not db.fsck() and not db.orphans()
        table(spark, d, "region").coalesce(1).write.parquet(db.files.at("data/stray"))
        orphan = len(db.orphans()) == 1
        db.files.delete(next(f.path for f in db._version.files))
        missing = any(x.startswith("missing") for x in db.fsck())
    return reduce(DataFrame.unionByName, [spark.createDataFrame([x], "case string, found boolean") for x in (("missing", missing), ("orphan", orphan), ("sound", sound))])


@query("""SELECT n_nationkey AS scan, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last
    FROM (SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_custkey >= n_nationkey * 7 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) <= 1 + n_nationkey * 4) GROUP BY 1""")
@in_a_store()
def store_many_scans(spark, d, open_store):
    """A scan of the next keys from a start for each nation, all in one job."""
    with open_store() as db:
        db.write(customers(spark, d))
        starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("scan"), key_of(F.col("n_nationkey") * 7).alias("start"), (F.col("n_nationkey") * 4 + 1).cast("int").alias("n"))
        number = F.substring(F.decode("key", "UTF-8"), 2, 9).cast("long")
        found = reads.next_rows(db.scan(), starts).groupBy(F.col("scan").cast("long").alias("scan"))
        return materialise(found.agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first"), F.max(number).alias("last")))
